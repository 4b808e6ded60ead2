"""Top k rows of each group, with bounds that keep the scan of the wide columns away from rows that can't be among them.

``top_k`` reads the table twice. First only the groups' keys and the ordering columns: each task keeps k rows of a group, so a
group with any part of all rows leaves k rows a task, and the k-th row of each group is its bound. The groups'
bounds are merged into one for each of at most ``RANGES`` ranges of the first key: the least of them. Then all columns are read under the filter "a row of this
range lies at or beyond its range's bound", which reaches the scan, where statistics of files and row groups skip what lies below.
Of the rows that pass, too, each task keeps k of a group before they are shuffled and numbered.

The filter's ranges are all that the driver sees. The fewer rows are asked for, the higher are the bounds and the less is read; how much is
skipped depends on how the table is laid out: by key or by the ordered value it is most, at random nearly nothing, and the
result is the same. Keys that aren't numbers, dates or timestamps make one range.

Defined results: larger values come first, nulls last, ``ties`` decide between equal values, smaller first and nulls first; rows
equal in all of these keep any of them; groups with fewer rows than k keep all; a null key is a group like others; NaN is the largest value,
if the files' writer leaves out the statistics of columns that hold it, as Spark's does; an empty
table or k of 0 gives no row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Ranges of keys with a bound of their own.
RANGES = 32
RANK = "_rank"


def _ordered(keys: list[str], by: str, ties: list[str]):
    return Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *(F.col(t).asc_nulls_first() for t in ties))


def _first(df: DataFrame, keys: list[str], by: str, ties: list[str], k: int, rank: str = RANK) -> DataFrame:
    # the limit on the row number is applied in each task before the shuffle
    return df.withColumn(rank, F.row_number().over(_ordered(keys, by, ties))).where(F.col(rank) <= k)


def group_bounds(df: DataFrame, keys: list[str], by: str, ties: list[str], k: int) -> DataFrame:
    """The keys and bound of each group: the value of its k-th row, or of its last; null if nulls are among its first k rows."""
    kept = _first(df.select(*keys, by, *(t for t in ties if t not in (*keys, by))), keys, by, ties, k)
    return kept.groupBy(*keys).agg(F.max_by(F.struct(F.col(by).alias("v")), RANK)["v"].alias("_bound"))


def scan_filter(bounds: DataFrame, key: str, by: str, ranges: int = RANGES) -> Column | None:
    """What rows of the first k must satisfy, by ranges of ``key``; None where nothing can be skipped.

    A range that has a null bound is read whole.
    """
    sortable = isinstance(bounds.schema[key].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    number = F.col(key).cast("double") if isinstance(bounds.schema[key].dataType, T.NumericType) else F.unix_micros(F.col(key).cast("timestamp"))
    cuts = []
    if sortable:
        fractions = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(bounds.agg(F.percentile_approx(number, fractions).alias("q")).first()["q"] or []))
    of = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < number)) if cuts else F.lit(0))
    found = bounds.groupBy(of.alias("range")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min("_bound").alias("bound"), F.max(F.col("_bound").isNull()).alias("whole")).collect()
    if not found or (len(found) == 1 and found[0]["whole"]):
        return None
    parts = []
    for x in found:
        inside = F.col(key).isNull() if x["range"] < 0 else F.lit(True) if not sortable else (F.col(key) >= F.lit(x["lo"])) & (F.col(key) <= F.lit(x["hi"]))
        parts.append(inside if x["whole"] else inside & (F.col(by) >= F.lit(x["bound"])))
    return reduce(lambda a, b: a | b, parts)


def top_k(df: DataFrame, keys: list[str], by: str, ties: list[str], k: int, stored, rank: str = "rank", ranges: int = RANGES) -> DataFrame:
    """The first k rows of each group of ``df``, all columns and their ``rank`` from 1; ``stored`` keeps a table in the shared folder."""
    keep = scan_filter(stored(group_bounds(df, keys, by, ties, k)), keys[0], by, ranges)
    return _first(df if keep is None else df.where(keep), keys, by, ties, k, rank).select(*df.columns, rank)
