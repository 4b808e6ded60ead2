"""Repeated passages: every byte covered by a 50-byte string that also starts in a document with a smaller id.

The suffixes of the corpus aren't sorted in one order, which no bounded task could hold: they are
parted by anchors, and every part is a merge of Burrows-Wheeler transforms of its own. A 50-byte
window has 31 substrings of 20 bytes; the one with the least hash is its anchor, which depends on
the window's bytes alone, so equal windows have equal anchors and meet in one part.

1. Equal texts become one, that of the smallest id; its copies are repeats as a whole.
2. Anchors, one for some sixteen bytes, are sent without their owners, to find those that several
   texts hold (shared_shingles); most occur once and end here.
3. Shared anchors are dealt by hash with a hash of their context, the 80
   bytes that hold all windows of the anchor. Where a context stands in a smaller document, all its
   windows are repeats. An anchor with one context only has no others.
4. For anchors with several contexts, the ends of repeats, each task transforms the contexts of its
   texts, a shard for each range of anchors. A range merges its shards' transforms by interleave
   refinement and takes the intervals with 50 bytes or more in common (bwt_merge).
   Anchors with more than ``WIDE`` contexts, whose parts could outgrow a task, are parted further, by the
   windows themselves, whose hashes are compared in the way of step 3.
5. Each text is read with its answers, and the covered bytes go.

Each task first settles what its own rows settle (the smallest document of each context stays), so a
passage that a third of all documents hold reaches another task once per task, not per document.

Defined results: null and empty texts, and those under 50 bytes, keep all; a null doc_id counts as
larger than all others; rows with equal doc_id are one document and don't repeat each other;
repeated rows get a row each; a text of any length is one row's work; an empty table gives an empty table; other
columns aren't read. In steps 1 and 3, and for wide anchors, strings are told apart by 128 bits, two independent hashes.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import bwt_merge, shared_shingles
from tallyforge.llm.common import Scratch, over_batches, stored, unpacked, whole

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM  # an anchor starts at most this far into a window
#: Hashes that a task holds before it passes them on, and hashes of a range.
BATCH_HASHES = 500_000
RANGE_HASHES = 1_200_000
#: Bytes of contexts that a task holds before it transforms them, and bytes of contexts of a range.
BATCH_BYTES = 4_000_000
RANGE_BYTES = 1_000_000
#: Contexts of an anchor beyond which its windows are compared one by one.
WIDE = 16
LAST = (1 << 63) - 1
_M = [np.uint64(m | 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


_N = [np.uint64(m | 1) for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def _doubled(x: np.ndarray, multipliers: list) -> list[np.ndarray]:
    """Hashes of 1, 2, 4, 8 and 16 symbols from each place on."""
    h, by = [x], 1
    for m in multipliers[:4]:
        h.append(h[-1][:-by] * m + h[-1][by:])
        by *= 2
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[1]
    return h ^ (h >> np.uint64(29))


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over n neighbours, for every start."""
    size, total = 1, len(x) - n + 1
    while size * 2 <= n:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[:total], x[n - size : n - size + total]) if size < n else x


class Anchors:
    """The windows of a text of at least 50 bytes, their anchors and contexts."""

    def __init__(self, raw: bytes):
        x = _symbols(raw)
        self.symbols, h = x, _doubled(x, _M)
        self.h16 = h[4]
        n = len(x) - GRAM + 1
        gram = _mixed(h[4][:n] * _M[4] + h[2][16 : 16 + n])[SPAN : SPAN + len(raw) - GRAM + 1]
        self.least = _slide(gram, SPAN + 1, np.minimum)  # by window
        padded = np.zeros(len(self.least) + 2 * SPAN, np.uint64)
        padded[SPAN : SPAN + len(self.least)] = self.least
        self.at = np.flatnonzero(_slide(padded, SPAN + 1, np.maximum) == gram)
        self.gram = gram[self.at]
        self.deal = _mixed(self.gram * _M[0])  # least hashes crowd at the low end; these don't

    def contexts(self, which: np.ndarray | slice, h16: np.ndarray | None = None) -> np.ndarray:
        """The first hash of the contexts of some anchors, or, by other ``h16``, the second."""
        h16 = self.h16 if h16 is None else h16
        at = self.at[which]
        c = h16[at]
        for k in (16, 32, 48, 64):
            c = c * _M[k // 16] + h16[at + k]
        return _mixed(c)

    def owners(self) -> np.ndarray:
        """Each window's anchor, the first of those with its least hash."""
        own = np.searchsorted(self.at, np.arange(len(self.least)))
        while len(wrong := np.flatnonzero(self.gram[own] != self.least)):
            own[wrong] += 1
        return own


def _symbols(raw: bytes) -> np.ndarray:
    """The bytes as numbers; sentinels stand for what lies outside the text, so a context at its end is like none elsewhere."""
    x = np.full(len(raw) + 2 * SPAN, 256, np.uint64)
    x[SPAN : SPAN + len(raw)] = np.frombuffer(raw, np.uint8)
    x += np.uint64(1)
    return x


def _windows(starts: np.ndarray, h2: np.ndarray, h16: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start there, from those of 2 and 16 symbols."""
    i = starts + SPAN
    return _mixed(((h16[i] * _M[0] + h16[i + 16]) * _M[2] + h16[i + 32]) * _M[3] + h2[i + 48])


BLOCK = {"part": "int", "keys": "binary", "ids": "binary", "counts": "binary", "groups": "binary", "strings": "binary", "seconds": "binary", "starts": "binary", "lengths": "binary"}
ANSWER = {"part": "int", "keys": "binary", "repeated": "binary", "open": "binary", "wide": "binary", "runs": "binary"}
_DDL = lambda fields: ", ".join(f"{k} {v}" for k, v in fields.items())
_SCHEMA = lambda fields: pa.schema([(k, {"int": pa.int32(), "bigint": pa.int64()}.get(v, pa.binary())) for k, v in fields.items()])


def _runs(starts: np.ndarray, lengths: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Runs of windows as numbers: the first start, 27 bits of their anchor, and how many (``SPAN`` + 1 at most) where an anchor is given."""
    run = starts.astype(np.uint64) << np.uint64(32) | lengths.astype(np.uint64)
    return run if group is None else run | (group.astype(np.uint64) & np.uint64(0xFFFFFFE0))


def _answers(key: np.ndarray, kind: np.ndarray, values: np.ndarray, parts: int) -> dict:
    """Rows of ANSWER, dealt by document: the documents, how many values of each kind they have (repeated, open, wide), and the values in that order."""
    part = (key.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((kind, key, part))
    key, kind, values, part = key[order], kind[order], values[order], part[order]
    out = {k: [] for k in ANSWER}
    if len(key):
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        counts = [np.add.reduceat((kind == k).astype(np.int32), head) for k in range(3)]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        edge = np.r_[first, len(part)].tolist()
        edge_head = np.searchsorted(head, edge).tolist()
        for p, a, b, i, j in zip(part[first].tolist(), edge, edge[1:], edge_head, edge_head[1:], strict=False):
            row = (p, key[head[i:j]].tobytes(), *(n[i:j].astype(np.int32).tobytes() for n in counts), values[a:b].tobytes())
            for name, v in zip(ANSWER, row, strict=True):
                out[name].append(v)
    return out


def _shared(x: np.ndarray) -> np.ndarray:
    """Where the values stand that occur more than once."""
    order = np.argsort(x)
    new = np.r_[True, x[order][1:] != x[order][:-1]] if len(x) else np.zeros(0, bool)
    return order[np.repeat((n := np.diff(np.r_[np.flatnonzero(new), len(x)])) > 1, n)]


def _settled(group: np.ndarray, string: np.ndarray, second: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order of the entries; in it, where strings begin, and which entries stand in a larger document than their string's smallest."""
    order = np.lexsort((doc, string, group))
    g, s, t, d = group[order], string[order], second[order], doc[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
    if (~first[1:] & (t[1:] != t[:-1])).any():  # one first hash of two strings
        order = np.lexsort((doc, second, string, group))
        g, s, t, d = group[order], string[order], second[order], doc[order]
        first[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    head = np.flatnonzero(first)
    repeated = d > np.repeat(d[head], np.diff(np.r_[head, len(d)]))
    return order, first, repeated


def _dealt(entries, ranges: int, parts: int):
    """Rows of BLOCK from (key, id, groups, strings, their second hashes, starts and lengths of their runs of windows) of documents: firsts by range of group, settled repeats by document (behind the ranges).

    Within its range a group goes by 32 bits, which can only open a window to the exact comparison; groups that are
    the strings themselves aren't sent.
    """

    def flush(held):
        sizes = np.fromiter((len(x[2]) for x in held), np.int64, len(held))
        owner = np.repeat(np.arange(len(held)), sizes)
        alone = held[0][2] is held[0][3]
        group, string, second, start, length = (np.concatenate([x[i] for x in held]) for i in range(2, 7))
        keys, ids = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
        some = _shared(string)  # most strings occur once
        order, _, repeated = _settled(group[some], string[some], second[some], ids[owner[some]])
        gone, stay = some[order[repeated]], np.ones(len(group), bool)
        stay[gone] = False
        done = _answers(keys[owner[gone]], np.zeros(len(gone), np.int8), _runs(start[gone], length[gone]), parts)
        n = len(done["part"])
        yield {k: [b""] * n for k in BLOCK} | {"part": [ranges + p for p in done["part"]], "keys": done["keys"], "counts": done["repeated"], "strings": done["runs"]}
        stay = np.flatnonzero(stay)
        part = (((group[stay] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        stay = stay[np.argsort(part, kind="stable")]
        edge = np.searchsorted(np.sort(part), np.arange(ranges + 1))
        out = {k: [] for k in BLOCK}
        for r in np.flatnonzero(np.diff(edge)).tolist():
            own = stay[edge[r] : edge[r + 1]]
            who, counts = np.unique(owner[own], return_counts=True)
            for name, v in zip(BLOCK, (r, keys[who].tobytes(), ids[who].tobytes(), counts.astype(np.int32).tobytes(), b"" if alone else group[own].astype(np.uint32).tobytes(), string[own].tobytes(), second[own].tobytes(), start[own].astype(np.uint32).tobytes(), length[own].astype(np.uint8).tobytes()), strict=True):
                out[name].append(v)
        yield out

    held, n = [], 0
    for x in entries:
        if len(x[2]):
            held.append(x)
            n += len(x[2])
        if n > BATCH_HASHES:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def _resolved(blocks: DataFrame, ranges: int, parts: int, wide: int, texts: "Texts") -> DataFrame:
    """Answers to blocks of hashes: repeated are strings that a smaller document has; open and wide those of groups with several strings, or very many."""

    def fn(table: pa.Table) -> pa.Table:
        get = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        if table.column("part")[0].as_py() >= ranges:
            out = {k: table.column(c).to_pylist() for k, c in zip(("part", "keys", "repeated", "runs"), ("part", "keys", "counts", "strings"), strict=True)}
            none = [bytes(len(x)) for x in out["repeated"]]
            return pa.Table.from_pydict(out | {"part": [p - ranges for p in out["part"]], "open": none, "wide": none}, schema=_SCHEMA(ANSWER))
        group, string, second, counts = get("groups", np.uint32), get("strings", np.uint64), get("seconds", np.uint64), get("counts", np.int32)
        grouped = len(group) > 0
        group = group if grouped else string
        some = _shared(group)  # an anchor that occurs once has nothing to tell
        owner = np.repeat(np.arange(len(counts)), counts)[some]
        key, doc, group, string, second = get("keys", np.int64)[owner], get("ids", np.int64)[owner], group[some], string[some], second[some]
        order, first, repeated = _settled(group, string, second, doc)
        g = group[order]
        head = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
        runs = np.diff(np.r_[np.flatnonzero(head), len(g)])
        at, d = np.flatnonzero(head), doc[order]
        strings = np.repeat(np.add.reduceat(first.astype(np.int64), at), runs) if len(g) else runs
        shared = np.repeat(np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at), runs) if len(g) else head
        told = repeated | ((strings > 1) & shared)
        kind = np.where(repeated, 0, np.where(strings > wide, 2, 1)).astype(np.int8)
        own = order[told]
        run = _runs(get("starts", np.uint32)[some][own], get("lengths", np.uint8)[some][own], group[own] if grouped else None)
        # only open runs need their anchor
        run = np.where(kind[told] == 1, run, run & np.uint64(0xFFFFFFFF0000001F))
        return pa.Table.from_pydict(_answers(key[own], kind[told], run, parts), schema=_SCHEMA(ANSWER))

    return _by_text(blocks.groupBy("part").applyInArrow(fn, _DDL(ANSWER)), texts)


class Texts:
    """The different texts in a table bucketed by their 128-bit key, so that what is told about them joins without moving them.

    uid numbers them; first is the smallest id that a text has (``LAST`` for null).
    """

    KEY = ["key", "key2"]

    def __init__(self, rows: DataFrame, kept: Scratch):
        self.spark, self.kept, self.name = rows.sparkSession, kept, f"texts_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        distinct = rows.groupBy(*self.KEY).agg(F.min_by("text", "id").alias("text"), F.min("id").alias("first")).withColumn("uid", F.monotonically_increasing_id())
        distinct.write.bucketBy(buckets, *self.KEY).saveAsTable(self.name, format="parquet", mode="overwrite", compression="zstd")
        self.table = self.spark.table(self.name)
        self.names = kept.stored(self.table.select("uid", *self.KEY))

    def told(self, answers: DataFrame) -> DataFrame:
        """``answers`` (uid and more), stored with the texts' keys."""
        return self.kept.stored(answers.join(self.names, "uid").drop("uid"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _shared_anchors(texts: Texts, total: int) -> DataFrame:
    """Key and shared anchors (sorted hashes) of the texts that have any."""

    def of(c):
        for uid, text in zip(c["uid"], c["text"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) >= LENGTH:
                yield (uid,), np.unique(Anchors(raw).deal)

    def fn(table: pa.Table) -> dict:
        record, settled, told = shared_shingles.directory(table, 1)
        owner, flat, _ = shared_shingles.held(settled, told)
        order = np.lexsort((flat, owner))
        edge = np.searchsorted(owner[order], np.arange(len(record) + 1)).tolist()
        some = [i for i in range(len(record)) if edge[i] < edge[i + 1]]
        return {"uid": record[some, 0], "shared": [flat[order[edge[i] : edge[i + 1]]].tobytes() for i in some]}

    ranges = max(8, -(-total // 16 // shared_shingles.RANGE_SHINGLES))
    cells = shared_shingles.dealt(texts.table.select("uid", "text"), of, ranges)
    return texts.told(shared_shingles.by_batch(shared_shingles.answered(cells, ranges, True), {"uid": "bigint", "shared": "binary"}, fn))


def _by_text(answers: DataFrame, texts: Texts) -> DataFrame:
    """A row per text with answers: key and the values of each kind."""
    kinds = ("repeated", "open", "wide")

    def fn(table: pa.Table) -> pa.Table:
        get = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        keys, values = get("keys", np.int64), get("runs", np.uint64)
        edge = np.r_[0, np.cumsum(np.stack([get(k, np.int32) for k in kinds], 1).astype(np.int64))].tolist()
        told: dict[int, tuple[list, ...]] = {}
        for i, key in enumerate(keys.tolist()):
            own = told.setdefault(key, ([], [], []))
            for k in range(3):
                own[k].append(values[edge[3 * i + k] : edge[3 * i + k + 1]].tobytes())
        out = {"uid": list(told)} | {name: [b"".join(x[k]) for x in told.values()] for k, name in enumerate(kinds)}
        return pa.Table.from_pydict(out, schema=_SCHEMA({"uid": "bigint"} | dict.fromkeys(kinds, "binary")))

    return texts.told(answers.groupBy("part").applyInArrow(fn, "uid bigint, repeated binary, open binary, wide binary"))


SHARD = {"part": "int", "keys": "binary", "ids": "binary", "starts": "binary", "transform": "binary"}


def _shards(entries, ranges: int):
    """Rows of SHARD from (key, id, bits of the anchors, starts, contexts) of documents: a batch's contexts by range of their anchors, transformed."""

    def flush(held):
        owner = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        keys, ids = (np.array([x[i] for x in held], np.int64)[owner] for i in (0, 1))
        grams, starts = (np.concatenate([x[i] for x in held]) for i in (2, 3))
        strings = [s for x in held for s in x[4]]
        part = (_mixed(grams * _M[0]) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(ranges + 1))
        out = {k: [] for k in SHARD}
        for r in np.flatnonzero(np.diff(edge)).tolist():
            own = order[edge[r] : edge[r + 1]]
            row = (r, keys[own].tobytes(), ids[own].tobytes(), starts[own].astype(np.int32).tobytes(), bwt_merge.transform([strings[i] for i in own.tolist()]))
            for name, v in zip(SHARD, row, strict=True):
                out[name].append(v)
        return out

    held, n = [], 0
    for x in entries:
        if len(x[2]):
            held.append(x)
            n += sum(map(len, x[4]))
        if n > BATCH_BYTES:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def _merged(shards: DataFrame, parts: int, texts: Texts) -> DataFrame:
    """Each range's transforms merged; per text the runs of windows that a smaller document has, as first start << 32 | how many."""

    def fn(table: pa.Table) -> pa.Table:
        each = lambda name, kind: [np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
        keys, ids, starts = (np.concatenate(each(n, k)) for n, k in (("keys", np.int64), ("ids", np.int64), ("starts", np.int32)))
        string, offset, interval = bwt_merge.repeats([(b, len(k)) for b, k in zip(table.column("transform").to_pylist(), each("keys", np.int64), strict=True)], LENGTH)
        doc = ids[string]
        head = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]]) if len(doc) else np.zeros(0, np.int64)
        gone = doc > np.repeat(np.minimum.reduceat(doc, head), np.diff(np.r_[head, len(doc)])) if len(doc) else np.zeros(0, bool)
        place = np.sort(string[gone].astype(np.int64) << 20 | offset[gone])
        head = np.flatnonzero(np.r_[True, np.diff(place) > 1]) if len(place) else np.zeros(0, np.int64)
        of = place[head] >> 20
        run = _runs(starts[of] + (place[head] & 0xFFFFF), np.diff(np.r_[head, len(place)]))
        return pa.Table.from_pydict(_answers(keys[of], np.zeros(len(of), np.int8), run, parts), schema=_SCHEMA(ANSWER))

    return _by_text(shards.groupBy("part").applyInArrow(fn, _DDL(ANSWER)), texts)


def _covered(size: int, *runs: bytes | None) -> np.ndarray:
    """Which bytes of a text of that size go."""
    cover = np.zeros(size + 1, np.int64)
    run = np.frombuffer(b"".join(x or b"" for x in runs), np.int64)
    if len(run):
        np.add.at(cover, run >> 32, 1)
        np.add.at(cover, (run >> 32) + (run & 0xFFFFFFFF) - 1 + LENGTH, -1)
    return np.cumsum(cover[:-1]) > 0


RESULT = {"key": "bigint", "key2": "bigint", "first": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "kept": "string"}


def _removed(texts: Texts, total: int, wide: int, keep: bool) -> DataFrame:
    """Rows of RESULT, one a text; kept only where bytes go, and with ``keep``."""
    table, on = texts.table, Texts.KEY
    ranges = max(8, -(-total // 16 // RANGE_HASHES))
    parts = max(8, ranges // 4)

    def anchors(c):
        def of():
            for uid, first, text, shared in zip(c["uid"], c["first"], c["text"], c["shared"], strict=True):
                a = Anchors(text.encode("utf-8", "surrogatepass"))
                own = np.flatnonzero(np.isin(a.deal, np.frombuffer(shared, np.uint64)))
                # an anchor's own windows are a run, as anchors take turns from the left
                of = a.owners()
                starts, ends = np.searchsorted(of, own), np.searchsorted(of, own, "right")
                own, starts, ends = own[ends > starts], starts[ends > starts], ends[ends > starts]
                yield uid, first, a.deal[own], a.contexts(own), a.contexts(own, _doubled(a.symbols, _N)[4]), starts, ends - starts

        return _dealt(of(), ranges, parts)

    def contexts_of(c):
        def of():
            for uid, first, text, opened in zip(c["uid"], c["first"], c["text"], c["open"], strict=True):
                raw, run = text.encode("utf-8", "surrogatepass"), np.frombuffer(opened, np.uint64)
                starts = (run >> np.uint64(32)).astype(np.int64)
                ends = starts + (run & np.uint64(31)).astype(np.int64) + LENGTH - 1
                yield uid, first, run & np.uint64(0xFFFFFFE0), starts, [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]

        return _shards(of(), merges)

    def windows_of(c):
        def of():
            for uid, first, text, opened in zip(c["uid"], c["first"], c["text"], c["wide"], strict=True):
                run = np.frombuffer(opened, np.int64)
                n = run & 31
                starts = np.repeat((run >> 32) - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
                x = _symbols(text.encode("utf-8", "surrogatepass"))
                (_, h2, _, _, h16), (_, s2, _, _, s16) = _doubled(x, _M), _doubled(x, _N)
                h = _windows(starts, h2, h16)
                yield uid, first, h, h, _windows(starts, s2, s16), starts, np.ones(len(starts), np.int64)

        return _dealt(of(), ranges, parts)

    def final(c):
        for i in range(0, len(c["key"]), 256):
            out = {k: [] for k in RESULT}
            for key, key2, first, text, *told in zip(*(c[n][i : i + 256] for n in ("key", "key2", "first", "text", "repeated", "windows", "runs")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone = _covered(len(raw), *told)
                n, kept = int(gone.sum()), raw
                if n:
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
                row = (key, key2, first, n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep and n else None)
                for k, v in zip(RESULT, row, strict=True):
                    out[k].append(v)
            yield out

    shared = _shared_anchors(texts, total)
    contexts = _resolved(over_batches(table.join(shared, on).select("uid", "first", "text", "shared"), BLOCK, anchors), ranges, parts, wide, texts)
    open_ = contexts.where(F.octet_length("open") > 0).select(*on, "open")
    bytes_ = (contexts.agg(F.sum(F.octet_length("open"))).first()[0] or 0) // 8 * (LENGTH + SPAN)
    merges = max(8, -(-bytes_ // RANGE_BYTES))
    runs = _merged(over_batches(table.join(open_, on).select("uid", "first", "text", "open"), SHARD, contexts_of), parts, texts)
    told = table.join(contexts.select(*on, "repeated"), on, "left").join(runs.select(*on, F.col("repeated").alias("runs")), on, "left")
    many = contexts.where(F.octet_length("wide") > 0).select(*on, "wide")
    if many.isEmpty():
        told = told.withColumn("windows", F.lit(None).cast("binary"))
    else:
        windows = _resolved(over_batches(table.join(many, on).select("uid", "first", "text", "wide"), BLOCK, windows_of), ranges, parts, wide, texts)
        told = told.join(windows.select(*on, F.col("repeated").alias("windows")), on, "left")
    return texts.kept.stored(over_batches(told.select(*on, "first", "text", "repeated", "windows", "runs"), RESULT, final))


def repeated_bytes(docs: DataFrame, texts: bool = False, wide: int = WIDE) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts``, also the text's key and key2, and kept.

    kept is the remaining bytes as text, without characters of which only a part is left; null where all remain.
    """
    with Scratch(docs.sparkSession) as kept:
        each = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumns(keys("text"))
        rows = kept.stored(each.select("doc_id", "id", *Texts.KEY, F.octet_length("text").cast("bigint").alias("n_bytes")))
        total = rows.agg(F.sum("n_bytes")).first()[0] or 0
        distinct = Texts(each, kept)
        try:
            results = _removed(distinct, total, wide, texts)
        finally:
            distinct.drop()
        # copies of a text with a larger id are repeats as a whole
        out = rows.join(results, Texts.KEY)
        copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
        out = out.select(
            "doc_id",
            "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(copy, 1).otherwise(F.col("n_spans")).cast("bigint").alias("n_spans"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
            *Texts.KEY,
            F.when(copy, "").otherwise(F.col("kept")).alias("kept"),
        )
        return stored(out if texts else out.drop(*Texts.KEY, "kept"))


def keys(text: str) -> dict[str, Column]:
    """128 bits of a text as two longs, from independent seeds."""
    return {"key": F.xxhash64(text), "key2": F.xxhash64(F.lit(1), text)}


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and more) without repeated bytes; texts without any, null ones among them, stay as they are."""
    changed = repeated_bytes(docs.select("doc_id", "text"), texts=True).where("n_removed > 0")
    changed = changed.select(F.col("doc_id").alias("_id"), *Texts.KEY, "kept").dropDuplicates(["_id", *Texts.KEY])
    keyed = docs.select(docs["doc_id"].alias("_doc"), docs["text"].alias("_text"), whole(docs).alias("_all"))
    keyed = keyed.withColumn("_filled", F.coalesce("_text", F.lit("")))
    of = keys("_filled")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (of["key"] == F.col("key")) & (of["key2"] == F.col("key2"))
    joined = keyed.join(changed, same, "left").withColumn("_new", F.coalesce("kept", "_text"))
    fresh = {"text": F.col("_new"), "n_chars": F.length("_new").cast("bigint")}
    return unpacked(joined, "_all", docs.columns, fresh)
