"""Secret scans: credentials by pattern, and parts of credentials by their company.

Three kinds are reported wherever they stand (assign, access, hex). Three weaker kinds, an
identifier (a login, a key id, an e-mail address), a secret and an endpoint (a url, an address with a port, an IP
address), are each too common to report alone; they are joined by
position, and a weak part is reported only when its complement lies within ``scope`` code points:
an identifier or an endpoint needs a secret, a secret needs an identifier or an endpoint.
Strong finds count as complements: access as an identifier, assign and hex as secrets.

The join of intervals is a pass over each document's finds in order of place, which keeps the
nearest complement before and after; no pairs are made, however many finds a text holds.

Defined results: null and empty texts have no finds; a text of any length is scanned whole, in one task, each pattern
in time proportional to it; ties in place are ordered by kind; repeated rows each get their row; an empty table gives an empty table; other columns aren't read.
"""

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import Scratch, over_batches, stored, unpacked, whole

#: Code points between the starts of parts that belong together.
SCOPE = 300
#: Kinds in the order in which finds at one place are listed.
KINDS = ("assign", "access", "hex", "part_id", "part_secret", "part_endpoint")
# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# An identifier: a key id, a named login, or an e-mail address. Runs are matched from their first symbol on, so each is read once.
PART_ID = re.compile(
    r"""\b(?:ASIA|AIDA|AROA|AKIA)[A-Z0-9]{8,}|\b(?:user(?:name)?|login|client_id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
    r"""|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,}""",
    re.A,
)
# A secret: a long run of mixed symbols, or what is given under a further name of one.
# '=' may stand before a run (key=value), and it may have any length; a run is taken whole.
PART_SECRET = re.compile(
    r"""(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=])"""
    r"""|\b(?:pwd|passphrase|credentials?|(?:access|private|account)_?key)["']?\x20*[:=]\x20*["']?[^\s"',;]{6,}""",
    re.A,
)
# An endpoint: a url, an address with its port, or an IP address.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PART_ENDPOINT = re.compile(
    r"\b(?:https?|ftp|postgres|mysql|mongodb|redis|amqp)(?:ql|s)?(?:\+[A-Za-z0-9]+)*://[A-Za-z0-9_.:@/-]+"
    rf"|(?<![A-Za-z0-9_.-])(?:{_OCTET}\.){{3}}{_OCTET}(?::[0-9]{{1,5}})?(?![A-Za-z0-9_-]|\.[0-9])"
    r"|(?<![A-Za-z0-9_.-])[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,}:[0-9]{2,5}\b",
    re.A,
)
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def finds(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the strong finds and of the weak parts outside them; of a text without any secret, none."""
    text = text or ""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    strong = sorted((s, e) for s, _, e in out)
    # a weak part counts only beside a complement, and none stands without one of these
    secrets = [(m.start(), 4, m.end()) for m in PART_SECRET.finditer(text)]
    weak = secrets
    if secrets or strong:
        weak = secrets + [(m.start(), k, m.end()) for k, p in ((3, PART_ID), (5, PART_ENDPOINT)) for m in p.finditer(text)]
    at, end = 0, -1
    for s, k, e in sorted(weak):
        while at < len(strong) and strong[at][0] < e:
            end, at = max(end, strong[at][1]), at + 1
        if end <= s:
            out.append((s, k, e))
    return sorted(out)


FIELDS = {"row": "bigint", "doc_id": "bigint", "h1": "bigint", "h2": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "starts": "array<int>", "kinds": "array<int>", "ends": "array<int>"}


def _scanned(docs: DataFrame) -> DataFrame:
    def fn(c):
        got = [finds(t) for t in c["text"]]
        base = [[x for x in g if x[1] < 3] for g in got]
        return {
            "row": c["row"],
            "doc_id": c["doc_id"],
            "h1": c["h1"],
            "h2": c["h2"],
            **{f"n_{KINDS[k]}": [sum(x[1] == k for x in b) for b in base] for k in range(3)},
            "base_sha256": [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest() for b in base],
            **{n: [[x[i] for x in g] for g in got] for i, n in enumerate(("starts", "kinds", "ends"))},
        }

    return over_batches(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(h.alias(n) for n, h in _hashes(F.col("text")).items()), "text"), FIELDS, fn)


def _hashes(text: Column) -> dict[str, Column]:
    """128 bits of a text, by which rows of one id are told apart."""
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit("second"), text)}


def secret_scans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, found (array of start, kind, end), spans."""
    with Scratch(docs.sparkSession) as kept:
        return stored(_linked(kept.stored(_scanned(docs)), scope).drop("h1", "h2"))


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    each = rows.where(F.exists("kinds", lambda k: k >= 3)).select("row", F.explode(F.arrays_zip("starts", "kinds", "ends")).alias("f"))
    each = each.select("row", F.col("f.starts").alias("start"), F.col("f.kinds").alias("kind"), F.col("f.ends").alias("end"))
    role = F.when(F.col("kind").isin(1, 3), "i").when(F.col("kind") == 5, "e").otherwise("s")
    order = Window.partitionBy("row").orderBy("start", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = lambda r: (F.coalesce(F.col("start") - F.max(F.when(role == r, F.col("start"))).over(before) <= scope, F.lit(False)) | F.coalesce(F.min(F.when(role == r, F.col("start"))).over(after) - F.col("start") <= scope, F.lit(False)))
    linked = each.select("row", "start", "kind", "end", F.when(role == "s", near("i") | near("e")).otherwise(near("s")).alias("linked"))
    weak = linked.where("kind >= 3 AND linked").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))
    strong = F.filter(F.arrays_zip(F.col("starts").alias("start"), F.col("kinds").alias("kind"), F.col("ends").alias("end")), lambda f: f["kind"] < 3)
    strong = F.transform(strong, lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end")))
    out = rows.join(weak, "row", "left")
    found = F.array_sort(F.when(F.col("weak").isNull(), strong).otherwise(F.concat(strong, F.col("weak"))))
    names = F.array(*map(F.lit, KINDS))
    out = out.withColumn("found", F.transform(found, lambda f: F.struct(f["start"].alias("start"), F.get(names, f["kind"]).alias("kind"), f["end"].alias("end"))))
    spans = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return out.select("doc_id", "h1", "h2", "n_assign", "n_access", "n_hex", "base_sha256", "found", spans.alias("spans"))


MASK = "[secret]"


def redacted(docs: DataFrame, scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans give one mask. Columns as they were."""
    with Scratch(docs.sparkSession) as kept:
        found = stored(_linked(kept.stored(_scanned(docs)), scope).where(F.size("found") > 0).select("doc_id", "h1", "h2", F.col("found").alias("_found")))
    found = found.dropDuplicates(["doc_id", "h1", "h2"]).withColumnsRenamed({"doc_id": "_id", "h1": "_h1", "h2": "_h2"})
    # spans in order of start; each contributes what stands between the furthest end so far and its start
    step = lambda acc, f: F.struct(
        F.when(f["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, f["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], f["end"]).alias("at"),
    )
    done = lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text")))
    keyed = docs.select(whole(docs).alias("_all"), docs["doc_id"].alias("_doc"), docs["text"].alias("_text"), *(h.alias(f"_own_{n}") for n, h in _hashes(docs["text"]).items()))
    keyed = keyed.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own_h1") == F.col("_h1")) & (F.col("_own_h2") == F.col("_h2")), "left")
    text = F.when(F.col("_found").isNull(), F.col("_text")).otherwise(F.aggregate("_found", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, done))
    keyed = keyed.withColumn("_new", text)
    fresh = {"text": F.col("_new"), "n_chars": F.length("_new").cast("bigint")}
    return unpacked(keyed, "_all", docs.columns, fresh)
