"""URL templates and rules, k-d sharding, linked secrets and broken media against plain versions."""

import random
import re
import struct
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import gif_media, kd_sharding, language_id, packing, secret_scans, url_filters
from tallyforge.llm.common import ranked, stored
from test_set_operators import gif, plain_url


def plain_templates(rows):
    """(host, shape) to (template, rate), from (host, shape, bad) rows; paths no deeper than MAX_DEPTH."""
    tree = defaultdict(lambda: [0, 0, 0])
    for host, shape, bad in rows:
        for i, v in enumerate((1, bad is not None, bad or 0)):
            tree[host, shape][i] += v
    name = {k: "" for k in tree}
    for level in range(max((len(s) for _, s in tree), default=0)):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for (host, shape), sums in tree.items():
            if len(shape) > level:
                kids[host, name[host, shape]][shape[level]] = [a + b for a, b in zip(kids[host, name[host, shape]][shape[level]], sums, strict=True)]
        new = {}
        for node, of in kids.items():
            many = len(of) > url_filters.MAX_CHILDREN
            for segment, (pages, labelled, bad) in of.items():
                thin = pages < url_filters.PAGES_PER_CHILD
                pool = [v for v in of.values() if not many or (v[0] < url_filters.PAGES_PER_CHILD) == thin]
                n, b = sum(v[1] for v in pool), sum(v[2] for v in pool)
                rate = (b + 1) / (n + 2)
                alike = labelled and abs(bad / labelled - rate) <= url_filters.Z * (rate * (1 - rate) / labelled) ** 0.5
                merged = (many and thin and not labelled) or (len(pool) > 1 and alike)
                new[(*node, segment)] = ("*+" if many and not thin else "*") if merged else segment
        for host, shape in tree:
            if len(shape) > level:
                name[host, shape] += "/" + new[host, name[host, shape], shape[level]]
    rate = lambda own, prior: (own[1] + url_filters.SMOOTHING * prior) / (own[0] + url_filters.SMOOTHING)
    total, hosts, of = [0, 0], defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (host, shape), (_, labelled, bad) in tree.items():
        for sums in (total, hosts[host], of[host, name[host, shape]]):
            sums[0] += labelled
            sums[1] += bad
    prior = total[1] / max(total[0], 1)
    return {k: (name[k], rate(of[k[0], name[k]], rate(hosts[k[0]], prior))) for k in tree}


def test_templates_are_the_plain_ones(spark):
    r = random.Random(12)
    rows = []
    for _ in range(2000):
        host, depth = r.choice("ab") + ".com", r.randrange(0, 6)
        shape = tuple(r.choice(("new", "x", "y", f"v{r.randrange(40)}".translate(str.maketrans("0123456789", "qrstuvwxyz")))) for _ in range(depth))
        odds = 0.9 if "new" in shape[:1] else 0.5 if "x" in shape[1:3] else 0.1
        rows.append((host, shape, None if r.random() < 0.4 else int(r.random() < odds)))
    pages = spark.createDataFrame([(i, f"http://{h}/{'/'.join(s)}", b) for i, (h, s, b) in enumerate(rows)], "page_id long, url string, bad int")
    want = plain_templates(rows)
    for x in url_filters.judge(pages, []).collect():
        template, rate = want[x["host"], tuple(s for s in x["path"].split("/") if s)]
        assert x["template"] == template and abs(x["rate"] - rate) < 1e-9 and x["verdict"] == ("block" if rate >= url_filters.LIMIT else "allow")


def test_rules_as_a_table_are_those_of_a_list(spark):
    r = random.Random(3)
    domains = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "xa.com"]
    rules = sorted({f"{r.choice(domains)}/{r.choice(('', 'p', 'p/', 'p/q', 'q'))}" for _ in range(25)})
    rules = [(x, r.choice(("allow", "block"))) for x in rules]
    urls = [None, "", *(f"http://{r.choice([*domains, 'z.c.b.a.com', 'org', ''])}/{r.choice(('', 'p', 'p/', 'p/q/r', 'q'))}" for _ in range(120))]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, bad int")
    # without a slash, empty, null, and twice with different verdicts
    rules += [("b.a.com", "block"), ("xa", "block"), ("", "allow"), (None, "block"), ("net/p", "block"), ("net/p", "allow")]
    table = spark.createDataFrame(rules, url_filters.RULE)
    got = {x["page_id"]: tuple(x) for x in url_filters.judge(pages, table).collect()}
    assert got == {x["page_id"]: tuple(x) for x in url_filters.judge(pages, rules).collect()} and len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain_url(url)
        fits = [(-len(x), x) for x, _ in rules if x is not None for d, s, p in [x.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith(s + p)]
        assert got[i][3] == (min(fits)[1] if fits else None)


def plain_tree(rows, parts, base=0, target=None):
    """Shards by key: rows of (key, weight, x_size, x_lang, x_source)."""
    weight = sum(x[1] for x in rows)
    if target:
        parts = -(-weight // target) if len(rows) > 1 else 1
    if parts < 2 or not rows:
        return {x[0]: base for x in rows}
    spread = [(max(x[d] for x in rows) >> kd_sharding.LOW) - (min(x[d] for x in rows) >> kd_sharding.LOW) for d in (2, 3, 4)]
    d = 2 + spread.index(max(spread))
    rows = sorted(rows, key=lambda x: x[d])
    want, below, at = weight * (parts // 2) / parts, 0, 0
    while at < len(rows) - 1 and below + rows[at][1] < want:
        below += rows[at][1]
        at += 1
    if below + rows[at][1] - want <= want - below:
        at += 1
    low, high = rows[:at], rows[at:]
    return plain_tree(low, parts // 2, 2 * base if target else base, target) | plain_tree(high, parts - parts // 2, 2 * base + 1 if target else base + parts // 2, target)


@pytest.mark.parametrize("shards, target", [(8, None), (5, None), (None, 3000)])
def test_shards_are_the_plain_ones(spark, shards, target):
    r = random.Random(9)
    rows = [(i, "w " * r.randrange(1, 200) + str(r.randrange(40)), r.choice(["en", "fr", None]), f"s{r.randrange(9)}") for i in range(150)] + [(200 + i, "same", "en", "s1") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    key = F.xxhash64("text", F.col("text").isNull())
    size = F.octet_length("text") + 1
    grouped = docs.groupBy(key.alias("key")).agg(F.sum(size).alias("weight"), F.min(size).alias("size"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    plain = plain_tree([tuple(x) for x in kd_sharding._coordinates(grouped).collect()], shards or 1, 1 if target else 0, target)
    got = defaultdict(set)
    for x in kd_sharding.shard(docs.select("doc_id", "text", "lang", "source"), shards, target).join(docs.select("doc_id", key.alias("key")), "doc_id").collect():
        got[x["shard"]].add(x["key"])
    want = defaultdict(set)
    for k, v in plain.items():
        want[v].add(k)
    if target:
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        sizes = kd_sharding.shard(docs, None, target).groupBy("shard").agg(F.sum("size").alias("b"), F.countDistinct("text_crc32").alias("n")).collect()
        assert all(x["b"] <= target or x["n"] == 1 for x in sizes)
    else:
        assert got == want


PARTS = ["login: bob", "a.b@mail.example.com", "AKIA" + "Z" * 17, "AKIAABCDEFGH", "token = abcdef12", "0123456789abcdef" * 2, "aB3xYz" * 8, "pwd: hunter22", "access_key=Qwerty123", "https://db.example.com/x", "10.1.2.3:80", "db.example.com:5432", "300.1.2.3", "v1.2.3.4.5", "word", "é😀"]


def plain_spans(text, scope):
    kinds = [secret_scans.ASSIGN, secret_scans.ACCESS, secret_scans.HEX, secret_scans.PART_ID, secret_scans.PART_SECRET, secret_scans.PART_ENDPOINT]
    found = [(m.start(), k, m.end()) for k, p in enumerate(kinds) for m in p.finditer(text) if (k != 0 or len(m[2]) >= 6) and (k != 1 or len(m[0]) >= 20)]
    strong = [f for f in found if f[1] < 3]
    found = [f for f in found if f[1] < 3 or not any(s < f[2] and f[0] < e for s, _, e in strong)]
    role = lambda k: "i" if k in (1, 3) else "e" if k == 5 else "s"
    linked = [f for f in found if f[1] < 3 or any(abs(g[0] - f[0]) <= scope and (role(g[1]) in "ie") != (role(f[1]) in "ie") for g in found if g != f)]
    return ",".join(f"{secret_scans.KINDS[k]}:{s}:{e}" for s, k, e in sorted(linked))


def test_linked_secrets_are_the_plain_ones(spark):
    r = random.Random(7)
    texts = [None, "", *("".join(r.choice(PARTS) + r.choice((" ", "\n", ", ", " " * 30, " " * 70)) for _ in range(r.randrange(1, 9))) for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["spans"] for x in secret_scans.secret_scans(docs, scope=60).collect()}
    assert got == {i: plain_spans(t or "", 60) for i, t in enumerate(texts)} and sum("part_" in s for s in got.values()) > 100


def test_linked_secrets_in_the_supplied_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = secret_scans.secret_scans(docs).where("spans LIKE '%part_%'").collect()
    assert len(found) >= 20 and all(re.search("assign|hex|access|part_secret", x["spans"]) for x in found)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 1000), st.integers(0, 255))
def test_broken_gifs_never_crash(noise, at, value):
    whole = bytearray(gif([(0, 0, 2, 2, 1, None, 0, [1, 1, 1, 1]), (0, 0, 1, 1, 3, 2, 0, [2])], bytes(range(30))))
    whole[at % len(whole)] = value
    for data in (bytes(whole), bytes(whole[: at % len(whole)]), bytes(whole[:13]) + noise, b"GIF89a" + noise):
        try:
            for samples, canvas, _, _ in gif_media.decode_gif(data):
                assert gif_media.histogram(canvas).shape == (3, gif_media.BINS) and isinstance(samples, bytes)
        except gif_media.TooLarge:
            pass


def test_large_canvases_are_refused(spark):
    bomb = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    row = gif_media.frames(spark.createDataFrame([(1, bytearray(bomb))], "id long, gif binary")).collect()
    assert len(row) == 1 and row[0]["frame"] is None and row[0]["error"] == "65535 x 65535 pixels"
    out = gif_media.digests(spark.createDataFrame([(1, 0, bytearray(bomb)), (2, 0, None)], "doc_id long, n_bytes long, gif binary")).collect()
    assert {x["doc_id"]: (x["n_frames"], x["error"]) for x in out} == {1: (0, "65535 x 65535 pixels"), 2: (0, None)}


def test_histograms_by_colour():
    canvas = np.zeros((1, 4, 4), np.uint8)
    canvas[0, :, :3] = [(255, 0, 0), (0, 255, 0), (0, 255, 16), (9, 9, 9)]
    canvas[0, :3, 3] = 255  # the last is transparent
    red, green, blue = gif_media.histogram(canvas).tolist()
    assert (red[0], red[15], green[0], green[15], blue[0], blue[1]) == (2, 1, 1, 2, 2, 1)


WORD = st.one_of(st.sampled_from(["İ", "क़", "Å", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "we'LL", "ﬁ", "Σ", "́", "̇", " ", " ", "\u0085"]), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=4), st.text(alphabet="aBÉß1.,'!<|>", max_size=5))


@settings(max_examples=400, deadline=None)
@given(st.lists(WORD, max_size=8), st.sampled_from(["", " ", "\n", "\t", ", ", ".", "  "]))
def test_token_ids_are_the_librarys(words, between):
    text = between.join(words)
    want = np.array(library().encode(text, add_special_tokens=False).ids, "<u4")
    assert packing.token_bytes([text], packing.vocabulary("word_bpe_49k.json")) == [want.tobytes()]


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))


def test_ranks_without_keys(spark):
    df = stored(spark.range(500).selectExpr("id"))
    assert sorted(x["n"] for x in ranked(df, [], ["id"], "n", rows_per_bucket=50).collect()) == list(range(500))


def plain_language(text, model):
    """The nearest centroid, n-gram by n-gram."""
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    if not letters.strip():
        return "und", 0.0
    codes, mask = [ord(c) for c in " " + " ".join(letters.split()) + " "], (1 << 64) - 1
    counts = defaultdict(int)
    for i in range(len(codes)):
        h = 0
        for k, m in zip(range(3), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15), strict=True):
            if i + k < len(codes):
                h = (h + codes[i + k]) * m & mask
                counts[h >> 64 - language_id.BITS] += 1
    vector = {s: np.log1p(n) * model["idf"][s] for s, n in counts.items()}
    norm = sum(v * v for v in vector.values()) ** 0.5
    cosines = [sum(v * c[s] for s, v in vector.items()) / norm for c in model["centroids"]]
    best = int(np.argmax(cosines))
    return model["langs"][model["of"][best]], cosines[best]


def test_languages_are_those_of_the_plain_centroids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 3000")
    model = language_id.fit(docs, F.lit(True), 30)
    rows = docs.select("doc_id", "text").limit(60).collect()
    own = spark.createDataFrame([(r["doc_id"], False, r["text"]) for r in rows] + [(-1, False, "Ünï 漢字 ﬁ-x\n\ty1"), (-2, False, "12 .")], "doc_id long, held_out boolean, text string")
    texts = {r["doc_id"]: r["text"] for r in own.collect()}
    for r in language_id.predict(own, model).collect():
        lang, score = plain_language(texts[r["doc_id"]], model)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4


@pytest.mark.parametrize("langs", [("en", "fr"), ("fr", "en")])
def test_a_heavy_first_group_is_parted_from_the_rest(spark, langs):
    docs = spark.createDataFrame([(1, "w " * 4500, langs[0], "s"), (2, "short", langs[1], "s"), (3, "short", langs[1], "s")], "doc_id long, text string, lang string, source string")
    shards = {x["doc_id"]: x["shard"] for x in kd_sharding.shard(docs, None, 1950).collect()}
    assert shards[1] != shards[2] == shards[3]


def test_sharding_runs_few_jobs(spark):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 7), "en", f"s{i % 3}") for i in range(200)], "doc_id long, text string, lang string, source string")
    spark.sparkContext.setJobGroup("shards", "shards")
    try:
        out = kd_sharding.shard(docs, 8)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("shards"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert out.count() == 200 and jobs < 60
