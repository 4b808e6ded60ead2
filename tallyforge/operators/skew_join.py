"""Equi-joins whose heavy keys are found by a mergeable sketch and split over many tasks.

Outside what the reference describes: a general addition.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with more than this part of a side's rows is heavy.
SHARE = 1 / 256


class HeavyHitters:
    """Counters of at most ``size`` values. Each undercounts by at most ``error``, and error * (size + 1) <= all rows added.

    Batches are merged whole: counters are summed, and while there are too many the largest that
    must go is taken off from all. Sums of several sketches' counters undercount by the sum of their errors at most.
    """

    def __init__(self, size: int):
        self.size, self.error = size, 0
        self.values, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        counts = np.ones(len(values), np.int64) if counts is None else counts
        self.values, inverse = np.unique(np.concatenate([self.values, values]), return_inverse=True)
        self.counts = np.bincount(inverse, np.concatenate([self.counts, counts]), len(self.values)).astype(np.int64)
        if len(self.values) > self.size:
            off = np.partition(self.counts, len(self.counts) - self.size - 1)[len(self.counts) - self.size - 1]
            self.error += int(off)
            left = self.counts > off
            self.values, self.counts = self.values[left], self.counts[left] - off

    def merge(self, other: "HeavyHitters") -> None:
        self.error += other.error
        self.add(other.values, other.counts)


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*(F.col(k) for k in keys))


def heavy_keys(df: DataFrame, keys: list[str], share: float = SHARE) -> DataFrame:
    """The keys without nulls that have at least ``share`` of the rows of ``df``, with their exact ``rows``: 1 / share keys at most.

    Each task sketches the hashes of its keys with 2 / share counters; the sketches' counters are
    summed by hash, of which at most 2 / share reach half the share; only rows of those are counted by key.
    An empty table has none.
    """
    size = int(np.ceil(2 / share))

    def sketch(batches):
        seen, rows = HeavyHitters(size), 0
        for b in batches:
            seen.add(b.column(0).to_numpy())
            rows += b.num_rows
        # the last row has the number of rows: no value of its own
        values = pa.array([*seen.values.tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([values, pa.array([*seen.counts.tolist(), rows], pa.int64()), pa.array([0] * len(values), pa.int32())], ["_hash", "_count", "_all"])

    valid = df.select(*keys).na.drop("any")
    sums = valid.select(key_hash(keys).alias("_hash")).mapInArrow(sketch, "_hash long, _count long, _all int").groupBy("_all", "_hash").agg(F.sum("_count").alias("_count"))
    total = sums.where("_hash IS NULL").select("_all", F.col("_count").alias("_total"))
    candidates = sums.where("_hash IS NOT NULL").join(F.broadcast(total), "_all").where(F.col("_count") * 2 >= F.col("_total") * F.lit(share)).select("_hash", "_total")
    marked = valid.withColumn("_hash", key_hash(keys)).join(F.broadcast(candidates), "_hash")
    counted = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.first("_total").alias("_total"))
    return counted.where(F.col("rows") >= F.col("_total") * F.lit(share)).select(*keys, "rows", "_total")


def row_hash(df: DataFrame) -> Column:
    """A hash of all of a row's values; it depends on nothing else, so a task that runs again gives the same."""
    plain = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields if not _has_map(f.dataType)]
    return F.xxhash64(F.lit(17), *plain)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or type(kind).__name__ == "VariantType"


def _cells(left: DataFrame, right: DataFrame | None, on: list[str], share: float) -> DataFrame:
    """(on, l cells, r cells) of the keys that are heavy on a side: as many cells as its rows have shares of that side."""
    cells = F.ceil(F.col("rows") / (F.col("_total") * F.lit(share))).cast("int")
    l_side = heavy_keys(left, on, share).select(*on, cells.alias("_lc"))
    if right is None:
        return l_side.withColumn("_rc", F.lit(1))
    r_side = heavy_keys(right, on, share).select(*on, cells.alias("_rc"))
    return l_side.join(r_side, on, "full").select(*on, F.coalesce("_lc", F.lit(1)).alias("_lc"), F.coalesce("_rc", F.lit(1)).alias("_rc"))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: float = SHARE, salt: Column | None = None) -> DataFrame:
    """``left.join(right, on, how)`` with each heavy key dealt over a grid of cells; how: inner, left, right, full, semi or anti.

    A key that is heavy on the left has its left rows dealt over ``_lc`` cells and its right rows
    copied to each; one that is heavy on the right the other way round; one that is heavy on both meets in a grid, where
    a row is copied along the other side's cells. No cell has more than about ``share`` of a side. In outer joins a copy that finds no partner in its cell is dropped
    where its key is heavy on the other side, as it then has partners in other cells.

    Rows are dealt by a hash of all their values, or by ``salt``, an expression on columns that both sides have, where rows are
    repeated as a whole; it must not depend on the order of rows. Null keys match nothing and are dealt over all
    cells. Columns of either side are kept; those with the same name stay doubled, as in Spark's join; names that begin with two underscores and
    ``cell`` are reserved. Empty sides are allowed.
    """
    how = {"outer": "full", "left_outer": "left", "right_outer": "right", "full_outer": "full", "left_semi": "semi", "left_anti": "anti"}.get(how, how)
    if how not in ("inner", "left", "right", "full", "semi", "anti"):
        raise ValueError(f"no such join: {how}")
    one_sided = how in ("semi", "anti")
    if one_sided:
        right = right.select(*on).distinct()
    cells = F.broadcast(_cells(left, None if one_sided else right, on, share))
    spread = F.lit(int(np.ceil(1 / share)))
    unkeyed = F.greatest(*(F.col(k).isNull() for k in on)) if len(on) > 1 else F.col(on[0]).isNull()

    def dealt(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        """Its own cell by the salt, a copy for each of the other side's cells."""
        by = salt if salt is not None else row_hash(side)
        rows = side.withColumn("__cell_salt", by).join(cells, on, "left")
        number = F.when(unkeyed, F.pmod("__cell_salt", spread)).otherwise(F.pmod("__cell_salt", F.coalesce(F.col(mine), F.lit(1)))).cast("int")
        rows = rows.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(theirs), F.lit(1)) - 1)))
        return rows.withColumn(f"{own}_copied", F.coalesce(F.col(theirs), F.lit(1)) > 1).drop("__cell_salt", "_lc", "_rc")

    a = dealt(left, "__cell_l", "__cell_r", "_lc", "_rc")
    b = dealt(right, "__cell_r", "__cell_l", "_rc", "_lc")
    # never broadcast by itself: the estimate is that of the rows before they are copied, and the driver would hold them all
    out = a.join(b.hint("merge"), [*on, "__cell_l", "__cell_r"], {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    if how in ("left", "full"):  # __cell_r_copied is null where no right row was found
        out = out.where(~(F.coalesce("__cell_l_copied", F.lit(False)) & F.col("__cell_r_copied").isNull()))
    if how in ("right", "full"):
        out = out.where(~(F.coalesce("__cell_r_copied", F.lit(False)) & F.col("__cell_l_copied").isNull()))
    return out.drop("__cell_l", "__cell_r", "__cell_l_copied", "__cell_r_copied")
