"""K-d tree sharding: halves of equal bytes along the widest metadata dimension.

Rows with equal texts are a group and stay together. A group has three coordinates: its text's
size (logarithm), its least language and its least source, the latter two by hash. Every node
of the tree is split along the coordinate that spreads the most in it, where half of its bytes lie on
either side (k // 2 parts of k for other numbers of shards), until the leaves are as many as
asked for, or hold no more than the target bytes. A coordinate's low bits are a hash of the
text, so ties in size or language can be split anywhere.

Split points are found in three rounds, all nodes of a level at once and in one job: bytes are summed into bins of the interval
that holds the wanted point, and the bin that holds it is the next interval, down to a single value. The tree is a table of
nodes; the groups find their leaf by joining its levels, and are written anew only every ``REWRITE`` levels. The nodes of level
l are at most 2 ** l, so those of the first levels are broadcast; later ones, each a small part of the bytes, are joined by shuffle.

Defined results: a null text is a group of its own (size 1, crc 0); null lang or source count
as values; a group larger than a shard's part fills a shard alone, so sizes can't be equal then; texts of any length count by their size
alone; groups with one value in all coordinates (ties of 40 bits of a hash) stay together; repeated rows each get their slot; an empty table gives an empty table; other columns aren't read.
"""

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import Scratch, ranked, stored

#: Bits of a coordinate: the metadata's, then the text hash's.
HIGH, LOW = 20, 40
#: Rounds a level, and the bins of a round that together tell all values of a coordinate apart.
ROUNDS, BINS = 3, 1 << 20
#: Levels whose nodes, at most 2 ** level, are broadcast.
BROADCAST_LEVELS = 14
#: Levels after which the groups are written with their nodes.
REWRITE = 4
DIMENSIONS = ("size", "lang", "source")


def _coordinates(groups: DataFrame) -> DataFrame:
    unit = {
        "size": F.least(F.log2(F.col("size").cast("double")) / 40, F.lit(0.999999)),
        "lang": F.pmod(F.xxhash64("lang"), F.lit(1 << HIGH)) / (1 << HIGH),
        "source": F.pmod(F.xxhash64("source"), F.lit(1 << HIGH)) / (1 << HIGH),
    }
    low = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << LOW))
    return groups.select("key", "weight", *((F.floor(unit[d] * (1 << HIGH)).cast("bigint") * (1 << LOW) + low).alias(f"x_{d}") for d in DIMENSIONS))


def _of(dim: Column) -> Column:
    """A group's coordinate along its node's dimension."""
    return F.coalesce(*(F.when(dim == d, F.col(f"x_{d}")) for d in DIMENSIONS))


def _open_nodes(groups: DataFrame, target: int | None) -> DataFrame:
    """The nodes to split: node, parts, dim, least (its coordinates' first), lo and hi of the interval, weight, want (the bytes of the left side), below (bytes left of lo)."""
    spread = [F.struct((F.shiftright(F.max(f"x_{d}"), LOW) - F.shiftright(F.min(f"x_{d}"), LOW)).alias("wide"), F.lit(-i).alias("i"), F.lit(d).alias("dim"), F.min(f"x_{d}").alias("lo"), F.max(f"x_{d}").alias("hi")) for i, d in enumerate(DIMENSIONS)]
    nodes = groups.groupBy("node").agg(F.sum("weight").alias("weight"), F.max("parts").alias("parts"), F.greatest(*spread).alias("on"))
    if target:
        nodes = nodes.withColumn("parts", F.when(F.col("on.lo") < F.col("on.hi"), F.ceil(F.col("weight") / target)).otherwise(1).cast("bigint"))
    want = F.col("weight") * F.floor(F.col("parts") / 2) / F.col("parts")
    return nodes.where("parts > 1").select("node", "parts", "on.dim", F.col("on.lo").alias("least"), "on.lo", "on.hi", "weight", want.alias("want"), F.lit(0).cast("bigint").alias("below"))


def _round(groups: DataFrame, state: DataFrame) -> DataFrame:
    """The state of each node after one more round; at is the split, once bins are single values."""
    step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / BINS)).cast("bigint")
    inside = groups.drop("parts").join(state.withColumnRenamed("weight", "all"), "node").withColumns({"step": step, "x": _of(F.col("dim"))}).where("x >= lo AND x <= hi")
    bins = inside.groupBy("node", F.expr("(x - lo) div step").alias("bin")).agg(F.sum("weight").alias("w"), F.max("x").alias("top"), *(F.first(c).alias(c) for c in ("parts", "dim", "least", "lo", "step", "all", "want", "below")))
    by_bin = Window.partitionBy("node").orderBy("bin")  # at most BINS rows
    bins = bins.withColumn("upto", F.col("below") + F.sum("w").over(by_bin)).withColumn("before", F.lag("top").over(by_bin))
    holds = F.struct((F.col("upto") < F.col("want")).alias("short"), F.when(F.col("upto") < F.col("want"), -F.col("bin")).otherwise(F.col("bin")).alias("bin"))
    held = bins.groupBy("node").agg(F.min_by(F.struct(*bins.columns), holds).alias("b")).select("b.*")
    less = F.col("upto") - F.col("w")
    # the value falls to the side that leaves the halves closer
    at = F.when(F.col("upto") - F.col("want") <= F.col("want") - less, F.col("top")).otherwise(F.coalesce("before", F.col("lo") - 1))
    lo = F.col("lo") + F.col("bin") * F.col("step")
    return held.select("node", "parts", "dim", "least", lo.alias("lo"), (lo + F.col("step") - 1).alias("hi"), F.col("all").alias("weight"), "want", less.alias("below"), at.alias("at"))


def _splits(groups: DataFrame, target: int | None, hint) -> DataFrame:
    """The split of every open node: node, of (its parts), dim, at (coordinates up to this go left)."""
    state = _open_nodes(groups, target)
    for _ in range(ROUNDS):
        state = _round(groups, hint(state.drop("at")))
    # by target bytes, a first group larger than the left side's bytes is the left side, so that every split parts something
    at = F.greatest("at", "least") if target else F.col("at")
    return state.select("node", F.col("parts").alias("of"), "dim", at.alias("at"))


def _descended(groups: DataFrame, splits: DataFrame) -> DataFrame:
    """``groups`` one level further down."""
    right, left_parts = _of(F.col("dim")) > F.col("at"), F.floor(F.col("of") / 2).cast("bigint")
    split = lambda name, is_left, is_right: F.when(F.col("at").isNull(), F.col(name)).when(right, is_right).otherwise(is_left).alias(name)
    return groups.join(splits, "node", "left").select(
        "key", "weight", *(f"x_{d}" for d in DIMENSIONS),
        split("node", 2 * F.col("node"), 2 * F.col("node") + 1),
        split("parts", left_parts, F.col("of") - left_parts),
        split("base", F.col("base"), F.col("base") + left_parts),
    )


def _tree(groups: DataFrame, shards: int, target: int | None, kept: Scratch) -> DataFrame:
    """``groups`` with node, the path to its leaf as a number, and base, the first of the shards that the leaf stands for."""
    groups = groups.withColumns({"node": F.lit(1).cast("bigint"), "parts": F.lit(shards).cast("bigint"), "base": F.lit(0).cast("bigint")})
    for level in count():
        if not target and 1 << level >= shards:
            return groups
        hint = F.broadcast if level <= BROADCAST_LEVELS else lambda df: df
        splits = kept.stored(_splits(groups, target, hint))
        if target and splits.isEmpty():
            return groups
        groups = _descended(groups, hint(splits))
        if level % REWRITE == REWRITE - 1:
            groups = kept.stored(groups)


def shard(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) as doc_id, size, text_crc32, shard and slot (gapless from 0 in its shard).

    Either ``shards``, or ``target_bytes``, which no leaf exceeds that holds more than a single group.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    crc = F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint")
    key = F.xxhash64("text", F.col("text").isNull())
    with Scratch(docs.sparkSession) as kept:
        rows = kept.stored(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), key.alias("key"), "lang", "source"))
        grouped = rows.groupBy("key").agg(F.sum("size").alias("weight"), F.min("size").alias("size"), F.min("lang").alias("lang"), F.min("source").alias("source"))
        groups = _tree(kept.stored(_coordinates(grouped)), shards or 1, target_bytes, kept)
        if target_bytes:
            leaves = groups.select("node").distinct()
            groups = groups.drop("base").join(ranked(kept.stored(leaves), [], ["node"], "base"), "node")
        placed = groups.select("key", F.col("base").cast("int").alias("shard"))
        out = kept.stored(rows.select("doc_id", "size", "text_crc32", "key").join(placed, "key").drop("key"))
        return stored(ranked(out, ["shard"], ["doc_id", "text_crc32"], "slot"))
