"""N-gram Jaccard self-join in the metric space of shingle sets: which documents are linked, directly or by others.

Distance is one minus Jaccard similarity, a metric; two documents link at similarity
``PERCENT`` or more. Documents without a shingle in common all lie at distance 1 from each other,
where pivots tell nothing, so what can't link is parted first, and nothing is lost by it:

1. In order of hash value, all but a fourth of a set's shingles are also its partner's. So of the set's first
   shingles (its head: a fourth and ``HEAD`` of it) a link shares most of ``HEAD``; a set whose head
   others share less has no partner. Only heads are shuffled here (shared_shingles).
2. What is left is fetched as whole sets, and counted again: a set links only if ``PERCENT`` of its shingles
   are shared. A link must share one of each partner's rarest few shingles (prefix filter), so the
   components of "holds the same rare shingle" are regions that no link leaves.
3. A region larger than a task takes pivots. Points within the radius of one are linked with it. Every
   point belongs to the Voronoi cell of its nearest pivot, or, beyond ``FAR`` of all, to the
   rest; points that aren't in the region's main component by now are open, and are replicated to all cells where
   the triangle inequality allows a partner. Cells without open points are done; small ones are joined;
   others take pivots of their own, and so on. Where a cell has few open points, or pivots part
   nothing any more, they are compared with all of the cell in blocks.
4. A task joins its regions exactly: pivots with windows by the triangle inequality, then lists of rare
   shingles. Within a component no further pairs are compared, and none are ever emitted: only links that
   join components. A group of copies of any size thus costs a few passes.

Equal sets are one point, told by 128 bits; shingles are told apart by 64-bit hashes, within pairs that are compared.

Defined results: null and empty texts have no shingle, n_shingles 0, and are linked with
nothing, so each is its own component; with one to four words the whole sequence is one
shingle; a text of any length is one set, in one task; rows with equal doc_id are rows of one document, and where all ids of a component are
null, so is its component_id; an empty table gives an empty table; other columns aren't read.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm import shared_shingles
from tallyforge.llm.common import Scratch, over_batches, stored, unpacked, whole, worker_cache
from tallyforge.llm.components import components

WORDS = 5
PERCENT = 75
RADIUS = 1 - PERCENT / 100
#: The part of a set's shingles that its head has beyond those that a partner may lack.
HEAD = Fraction(1, 10)
#: Shingles, and points, of a region that one task joins.
REGION_SHINGLES = 4_000_000
REGION_POINTS = 40_000
#: Pivots of a large region, and pivots whose distances a task keeps.
PIVOTS = 16
#: Points that a task compares with a point at once.
BLOCK = 128
#: Distance from all pivots beyond which a point belongs to the rest.
FAR = 0.5
#: A cell that keeps more than this part of its region's open points isn't parted again by pivots.
STUCK = 0.9
#: Words whose hash a worker keeps.
CACHED_WORDS = 300_000
LAST = (1 << 63) - 1
_LOWER = bytes(range(256)).lower()
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def needed(n):
    """The least number of common shingles that a set of n shares with any partner."""
    return -(-PERCENT * n // 100)


def told(n: int) -> int:
    """How many common shingles the heads of two sets of n have at least."""
    return 1 + n * HEAD.numerator // HEAD.denominator


class _Words(dict):
    """Hashes of words, made when first asked for: a text's words are looked up once, without a set of them."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    cache = worker_cache(("shingles",))
    known = cache.setdefault("words", _Words())
    if len(known) > CACHED_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total *= _A
        total += h[i : i + n]
    total ^= total >> np.uint64(29)
    total *= _B
    total ^= total >> np.uint64(32)
    total.sort()
    return total[shared_shingles.heads(total)]


def head(s: np.ndarray) -> np.ndarray:
    return s[: len(s) - needed(len(s)) + told(len(s))]


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs."""
    key = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63)


POINT = {"doc_id": "bigint", "text_key": "bigint", "k1": "bigint", "k2": "bigint", "n": "bigint", "head": "binary"}


def points(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set key, n and head of every row."""

    def fn(c):
        for i in range(0, len(c["text"]), 1024):
            sets = [shingles(t) for t in c["text"][i : i + 1024]]
            keys = [set_key(s) for s in sets]
            yield {
                "doc_id": c["doc_id"][i : i + 1024], "text_key": c["text_key"][i : i + 1024], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys],
                "n": [len(s) for s in sets], "head": [head(s).tobytes() for s in sets],
            }

    return over_batches(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), POINT, fn)


def _ranges(shingles_: int | None, size: int) -> int:
    return max(8, -(-(shingles_ or 0) // size))


def _may_link(each: DataFrame, range_shingles: int) -> DataFrame:
    """One row (id, text_key) for each set of which enough of the head is shared. Copies count as others here, which only keeps more."""

    def of(c):
        seen = set()
        for doc, *record, h in zip(*(c[k] for k in POINT), strict=True):
            key = tuple(record[1:3])
            if record[3] and key not in seen:
                seen.add(key)
                yield (LAST if doc is None else doc, *record), np.frombuffer(h, np.uint64)

    fields = {k: POINT[k] for k in ("text_key", "k1", "k2")} | {"id": "bigint"}

    def able(table: pa.Table) -> dict:
        record, settled, answers = shared_shingles.directory(table, 5)
        count = shared_shingles.counted(settled, len(record)) + shared_shingles.counted(answers, len(record))
        # the smallest partner has needed(n) shingles
        least = 1 + needed(record[:, 4]) * HEAD.numerator // HEAD.denominator
        record = record[count >= least]
        return {"id": record[:, 0], "text_key": record[:, 1], "k1": record[:, 2], "k2": record[:, 3]}

    total = each.agg(F.sum(F.octet_length("head"))).first()[0] or 0
    ranges = _ranges(total // 8, range_shingles)
    cells = shared_shingles.dealt(each.select(*POINT), of, ranges)
    left = shared_shingles.by_batch(shared_shingles.answered(cells, ranges, False), fields, able)
    return left.groupBy("k1", "k2").agg(F.min(F.struct("id", "text_key")).alias("one")).select("one.*")


ABLE = {"k1": "bigint", "k2": "bigint", "n": "bigint", "m": "bigint", "shingles": "binary", "rarest": "array<bigint>"}


def _able(docs: DataFrame, may: DataFrame, each: DataFrame, kept: Scratch, range_shingles: int) -> DataFrame:
    """The points that share enough to link: pid, key, n, their m shared shingles, and the rarest few, of which a link shares one.

    A set that several batches hold, as rows that are equal in all do, is a point in each.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    # merged at any size, so that a small input is joined like a large one
    texts = texts.join(may.hint("merge"), ["id", "text_key"], "left_semi")

    def of(c):
        seen = set()
        for text in c["text"]:
            s = shingles(text)
            if (key := set_key(s)) not in seen:
                seen.add(key)
                yield (*key, len(s)), s

    def rare(table: pa.Table) -> dict:
        record, settled, answers = shared_shingles.directory(table, 3)
        owner, flat, frequency = shared_shingles.held(settled, answers)
        order = np.lexsort((flat, frequency, owner))
        owner, flat = owner[order], flat[order]
        edge = np.searchsorted(owner, np.arange(len(record) + 1)).tolist()
        out = {k: [] for k in ABLE}
        for (k1, k2, n), a, b in zip(record.tolist(), edge, edge[1:], strict=False):
            if b - a < needed(n):
                continue
            row = (k1, k2, n, b - a, np.sort(flat[a:b]).tobytes(), flat[a : a + (b - a) - needed(n) + 1].view(np.int64))
            for name, v in zip(ABLE, row, strict=True):
                out[name].append(v)
        return out

    total = each.join(may, (F.coalesce(each["doc_id"], F.lit(LAST)) == may["id"]) & (each["text_key"] == may["text_key"]), "left_semi").agg(F.sum("n")).first()[0]
    ranges = _ranges(total, range_shingles)
    cells = shared_shingles.dealt(texts.select("text"), of, ranges)
    rows = shared_shingles.by_batch(shared_shingles.answered(cells, ranges, True), ABLE, rare)
    return kept.stored(rows.withColumn("pid", F.monotonically_increasing_id()))


class Region:
    """Points of a region as flat arrays; links found so far as labels."""

    def __init__(self, n: np.ndarray, sets: list[np.ndarray], label: np.ndarray | None = None):
        g = len(n)
        self.n, self.label = n, np.arange(g) if label is None else label.copy()
        self.members = {x: np.flatnonzero(self.label == x) for x in np.unique(self.label).tolist()} if label is not None else {i: np.array([i]) for i in range(g)}
        self.size = np.fromiter(map(len, sets), np.int64, g)
        self.edge = np.r_[0, np.cumsum(self.size)]
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        # each point's rarest shingles within the region, and who else has them so
        _, value, count = np.unique(self.flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(g), self.size)
        shared = count[value] > 1
        value, owner = value[shared], owner[shared]
        order = np.lexsort((value, count[value], owner))
        value, owner = value[order], owner[order]
        size = np.bincount(owner, minlength=g)
        place = np.arange(len(owner)) - np.r_[0, np.cumsum(size)][owner]
        first = place < size[owner] - needed(n)[owner] + 1
        value, owner = value[first], owner[first]
        self.list_edge = np.searchsorted(owner, np.arange(g + 1))
        order = np.argsort(value, kind="stable")
        self.holder = owner[order]
        new = shared_shingles.heads(value[order])
        start = np.flatnonzero(new)
        self.list_start, self.list_end = start, np.r_[start[1:], len(order)]
        self.list = np.empty(len(order), np.int64)
        self.list[order] = np.cumsum(new) - 1
        self.closed = self.list_end - self.list_start < 2

    def set(self, i: int) -> np.ndarray:
        return self.flat[self.edge[i] : self.edge[i + 1]]

    def common(self, pivot: np.ndarray, among: np.ndarray | None) -> np.ndarray:
        """How many shingles of ``pivot`` each point has, or each of ``among``."""
        if among is None:
            flat, sizes = self.flat, self.size
        else:
            flat, sizes = np.concatenate([self.set(i) for i in among.tolist()]), self.size[among]
        at = np.searchsorted(pivot, flat)
        hit = pivot[np.minimum(at, len(pivot) - 1)] == flat
        total = np.r_[0, np.cumsum(hit)]
        edge = np.r_[0, np.cumsum(sizes)]
        return total[edge[1:]] - total[edge[:-1]]

    def merge(self, a: int, b: int) -> None:
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        own = self.members.pop(b)
        self.label[own] = a
        self.members[a] = np.r_[self.members[a], own]

    def partners(self, q: int) -> np.ndarray:
        """Points of other components in the lists of q's rarest shingles; lists within one component are closed for good."""
        lists = self.list[self.list_edge[q] : self.list_edge[q + 1]]
        lists = lists[~self.closed[lists]]
        if not len(lists):
            return lists
        length = self.list_end[lists] - self.list_start[lists]
        begin = np.r_[0, np.cumsum(length)[:-1]]
        holders = self.holder[np.arange(int(length.sum())) + np.repeat(self.list_start[lists] - begin, length)]
        other = self.label[holders] != self.label[q]
        self.closed[lists[~np.logical_or.reduceat(other, begin)]] = True
        return np.unique(holders[other])

    def link(self, q: int, among: np.ndarray, both: np.ndarray, links: list) -> None:
        for x in among[100 * both >= PERCENT * (self.n[among] + self.n[q] - both)].tolist():
            if self.label[x] != self.label[q]:
                links.append((q, x))
                self.merge(int(self.label[q]), int(self.label[x]))

    def joined(self, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join components: of all pairs, or of those with one of ``probes``.

        After some points the largest component is the main one, whose points needn't ask: those outside ask them.
        """
        links, distances, main = [], [], None
        asked = np.zeros(len(self.n), bool)
        for turn, q in enumerate(range(len(self.n)) if probes is None else probes.tolist()):
            if turn == PIVOTS:
                main = max(self.members.values(), key=len)[0]
            if main is not None and self.label[q] == self.label[main]:
                continue
            asked[q] = True
            among = self.partners(q)
            among = among[~asked[among]]
            # sizes too far apart are too far apart, the distance to the empty set in the space of symmetric differences
            among = among[100 * np.minimum(self.n[among], self.n[q]) >= PERCENT * np.maximum(self.n[among], self.n[q])]
            for d in distances:
                among = among[np.abs(d[among] - d[q]) <= RADIUS + 1e-9]
            if not len(among):
                continue
            if len(distances) < PIVOTS and 4 * len(among) > len(self.n):
                both = self.common(self.set(q), None)
                distances.append(1 - both / (self.n + self.n[q] - both))
                self.link(q, among, both[among], links)
                if len(self.members) == 1:
                    break
                continue
            while len(among):  # once q has joined a component, no more of it are looked at
                block = among[:BLOCK]
                self.link(q, block, self.common(self.set(q), block), links)
                among = among[BLOCK:]
                among = among[self.label[among] != self.label[q]]
        return links


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
LINK = "u bigint, v bigint"


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]


def _small(rows: DataFrame) -> DataFrame:
    """Links of regions that fit one task, several to a bin: ``rows`` (bin, region, pid, n, shingles, label, open)."""

    def fn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("region", "ascending"), ("pid", "ascending")])
        region, pid, n, label, opened = (table.column(c).to_numpy(zero_copy_only=False) for c in ("region", "pid", "n", "label", "open"))
        sets, u, v = _sets(table), [], []
        head = np.flatnonzero(shared_shingles.heads(region))
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(region)], strict=True):
            own = Region(n[a:b], sets[a:b], np.unique(label[a:b], return_inverse=True)[1])
            for x, y in own.joined(np.flatnonzero(opened[a:b])):
                u.append(int(pid[a + x]))
                v.append(int(pid[a + y]))
        return pa.table({"u": u, "v": v}, schema=LINKS)

    return rows.groupBy("bin").applyInArrow(fn, LINK)


PLACED = {"region": "bigint", "pid": "bigint", "n": "bigint", "m": "bigint", "shingles": "binary", "label": "bigint", "opened": "bigint", "cell": "int", "visits": "array<int>", "near": "array<bigint>"}


def _around_pivots(rows: DataFrame, region_shingles: int) -> DataFrame:
    """Rows of PLACED: each point's Voronoi cell, the further cells where it may have a partner, and the pivots it links with."""
    weights = rows.groupBy("region").agg(F.ceil(F.sum("m") / region_shingles).alias("chunks"))
    by_hash = Window.partitionBy("region").orderBy(F.desc("open"), F.xxhash64("pid"), "pid")
    chosen = rows.select("region", "pid", "open").withColumn("i", F.row_number().over(by_hash)).where(F.col("i") <= PIVOTS).select("region", "pid")
    chunked = rows.join(weights, "region")
    pivots = chunked.join(chosen, ["region", "pid"], "left_semi").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("pid", F.lit(1)), F.col("chunks"))).withColumn("pivot", F.lit(False)).unionByName(pivots.withColumn("pivot", F.lit(True)))
    schema = pa.schema([(k, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}[v]) for k, v in PLACED.items()])

    def fn(table: pa.Table) -> pa.Table:
        is_pivot = table.column("pivot").to_numpy(zero_copy_only=False)
        order = np.argsort(table.column("pid").to_numpy()[is_pivot])
        pivots, own = table.filter(pa.array(is_pivot)).take(pa.array(order)), table.filter(pa.array(~is_pivot))
        n, pid, p_n, p_pid = own.column("n").to_numpy(), own.column("pid").to_numpy(), pivots.column("n").to_numpy(), pivots.column("pid").to_numpy()
        sets = _sets(own)
        flat, edge = np.concatenate([np.zeros(0, np.uint64), *sets]), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
        both = np.zeros((len(own), len(p_n)), np.int64)
        for k, s in enumerate(_sets(pivots)):
            hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
            total = np.r_[0, np.cumsum(hit)]
            both[:, k] = total[edge[1:]] - total[edge[:-1]]
        union = n[:, None] + p_n[None, :] - both
        d = 1 - both / union
        least = d.min(axis=1)
        rest = len(p_n)
        cell = np.where(least < FAR, d.argmin(axis=1), rest)
        # a partner whose nearest pivot is k lies nearer to k than FAR, and no further from it than from this point's own pivot
        visit = (d < FAR + RADIUS + 1e-9) & (d <= least[:, None] + 2 * RADIUS + 1e-9)
        visit = np.c_[visit, least >= FAR - RADIUS - 1e-9]
        visit[np.arange(len(own)), cell] = False
        near = (100 * both >= PERCENT * union) & (pid[:, None] != p_pid[None, :])
        return pa.Table.from_pydict(
            {k: own.column(k) for k in ("region", "pid", "n", "m", "shingles", "label", "opened")}
            | {"cell": cell.astype(np.int32), "visits": [np.flatnonzero(v).astype(np.int32) for v in visit], "near": [p_pid[v] for v in near]},
            schema=schema,
        )

    return chunked.groupBy("region", "chunk").applyInArrow(fn, ", ".join(f"{k} {v}" for k, v in PLACED.items()))


def _in_blocks(rows: DataFrame, region_shingles: int) -> DataFrame:
    """Links of the open points of each region with all of it."""
    weights = rows.groupBy("region").agg(F.ceil(F.sum(F.when(F.col("open"), F.col("m"))) / region_shingles).alias("blocks"), F.ceil(F.sum("m") / region_shingles).alias("chunks"))
    rest = rows.join(weights, "region")
    columns = ["region", "block", "chunk", "pid", "n", "shingles", "label", "open"]
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = rest.where("open").withColumn("block", F.pmod(F.xxhash64("pid", F.lit(2)), "blocks")).withColumn("chunk", all_("chunks")).select(*columns)
    right = rest.withColumn("chunk", F.pmod(F.xxhash64("pid", F.lit(3)), "chunks")).withColumn("block", all_("blocks")).withColumn("open", F.lit(False)).select(*columns)

    def fn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("open", "descending"), ("pid", "ascending")])
        pid, n, label, opened = (table.column(c).to_numpy(zero_copy_only=False) for c in ("pid", "n", "label", "open"))
        found = Region(n, _sets(table), np.unique(label, return_inverse=True)[1]).joined(np.flatnonzero(opened))
        return pa.table({"u": [int(pid[x]) for x, _ in found], "v": [int(pid[y]) for _, y in found]}, schema=LINKS)

    return left.unionByName(right).groupBy("region", "block", "chunk").applyInArrow(fn, LINK)


class Limits:
    """What one task joins."""

    def __init__(self, shingles_: int, points_: int):
        self.shingles, self.points = shingles_, points_

    def fitting(self, rows: DataFrame) -> DataFrame:
        """``rows`` (region, m and more) with fits: whether their region fits a task."""
        weights = rows.groupBy("region").agg(((F.sum("m") <= self.shingles) & (F.count(F.lit(1)) <= self.points)).alias("fits"))
        return rows.join(weights, "region")

    def binned(self, rows: DataFrame) -> DataFrame:
        """``rows`` (region, m, fits and more) that fit, with their bin."""
        rows = rows.where("fits").drop("fits")
        bins = max(1, -(-(rows.agg(F.sum("m")).first()[0] or 0) // self.shingles)) * 32
        return rows.withColumn("bin", F.pmod(F.xxhash64("region"), F.lit(bins)))


def _links(able: DataFrame, regions: DataFrame, limits: Limits, kept: Scratch) -> DataFrame:
    """Links within ``regions`` (pid, region) of ``able`` points."""
    where = kept.stored(limits.fitting(regions.join(able.select("pid", "m"), "pid")))
    points_ = able.select("pid", "n", "shingles", F.col("pid").alias("label"), F.lit(True).alias("open"))
    links = [kept.stored(_small(points_.join(limits.binned(where), "pid")))]
    large = points_.join(where.where("NOT fits").drop("fits"), "pid").withColumn("opened", F.lit(LAST))
    while not large.isEmpty():
        large = kept.stored(large)
        placed = kept.stored(_around_pivots(large, limits.shingles))
        near = kept.stored(placed.select(F.col("pid").alias("u"), F.explode("near").alias("v")))
        links.append(near)
        # labels so far: those that came along, joined by the new links
        told_ = near.unionByName(placed.where("pid <> label").select(F.col("pid").alias("u"), F.col("label").alias("v")))
        labels = components(told_, kept).select(F.col("node").alias("pid"), "root")
        placed = kept.stored(placed.drop("near").join(labels, "pid", "left").withColumn("label", F.coalesce("root", "pid")).drop("root"))
        main = placed.groupBy("region", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
        placed = placed.join(main.where("labels > 1"), "region").withColumn("open", F.col("label") != F.col("main"))
        to = F.explode(F.when(F.col("open"), F.concat(F.array("cell"), "visits")).otherwise(F.array("cell")))
        placed = placed.withColumn("to", to).withColumn("region", F.xxhash64("region", "to")).select("region", "pid", "n", "m", "shingles", "label", "open", "opened")
        placed = kept.stored(placed)
        opens = placed.where("open").groupBy("region").agg(F.sum("m").alias("now"))
        placed = kept.stored(limits.fitting(placed.join(opens, "region")))  # cells without open points are done
        links.append(kept.stored(_small(limits.binned(placed.drop("now", "opened")))))
        rest = placed.where("NOT fits").drop("fits")
        done = (F.col("now") <= limits.shingles) | (F.col("now") > STUCK * F.col("opened"))
        links.append(kept.stored(_in_blocks(rest.where(done), limits.shingles)))
        large = rest.where(~done).withColumn("opened", F.col("now")).drop("now")
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def linked(docs: DataFrame, region_shingles: int = REGION_SHINGLES, range_shingles: int = shared_shingles.RANGE_SHINGLES, region_points: int = REGION_POINTS) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, text_key (xxhash64 of the text), n_shingles, component_id."""
    with Scratch(docs.sparkSession) as kept:
        each = kept.stored(points(docs))
        may = kept.stored(_may_link(each, range_shingles))
        able = _able(docs, may, each, kept, range_shingles)
        rare = able.select("pid", F.explode("rarest").alias("shingle"))
        hubs = rare.groupBy("shingle").agg(F.min("pid").alias("hub"), F.max("pid").alias("other")).where("hub < other").select("shingle", "hub")
        regions = components(rare.join(hubs, "shingle").select(F.col("pid").alias("u"), F.col("hub").alias("v")), kept)
        regions = regions.select(F.col("node").alias("pid"), F.col("root").alias("region"))
        regions = regions.unionByName(regions.select(F.col("region").alias("pid"), "region").distinct()).distinct()
        roots = components(_links(able, regions, Limits(region_shingles, region_points), kept), kept)
        roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct()
        roots = able.select("k1", "k2", F.col("pid").alias("node")).join(roots, "node").select("k1", "k2", "root").distinct()
        # equal sets first, then linked ones
        sets = each.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("own")).join(roots, ["k1", "k2"], "left")
        least = sets.where("root IS NOT NULL").groupBy("root").agg(F.min("own").alias("least"))
        sets = sets.join(least, "root", "left").select("k1", "k2", F.coalesce("least", "own").alias("component_id"))
        out = each.drop("head").join(sets, ["k1", "k2"], "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return stored(out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id")))


def one_of_each(docs: DataFrame, **sizes) -> DataFrame:
    """``docs`` (doc_id, text and more) with the document of the smallest id of every component; rows of one document stay or go together.

    Of copies that all have null ids, all stay.
    """
    verdicts = linked(docs.select("doc_id", "text"), **sizes).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = verdicts.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_stays"))
    keyed = docs.select(docs["doc_id"].alias("_doc"), F.xxhash64(docs["text"]).alias("_key"), whole(docs).alias("_all"))
    kept = keyed.join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_stays")), "left_semi")
    return unpacked(kept, "_all", docs.columns, {})
