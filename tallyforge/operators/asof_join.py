"""As-of joins: each left row gets the right row of its key that is nearest in time.

Outside what the reference describes: a general addition.
"""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.skew_join import SHARE, heavy_keys, row_hash
from tallyforge.storage import stored

#: Time ranges of a heavy key.
RANGES = 64


def ordinal(df: DataFrame, column: str) -> Column:
    """A time or number as a number that orders alike: microseconds, days, or itself."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    raise TypeError(f"{column} has no order in time: {kind.simpleString()}")


def time_ranges(rows: DataFrame, by: list[str], share: float, ranges: int) -> DataFrame:
    """(by, _borders): quantiles of ``_o`` of each heavy key of ``rows``, so that at most ``ranges`` ranges hold about as many rows each.

    They are stored: quantiles of many rows depend on the order in which these come, and a plan that reads borders twice must not find them moved.
    """
    heavy = heavy_keys(rows.select(*by), by, share).select(*by)
    cuts = [i / ranges for i in range(1, ranges)]
    return stored(rows.join(F.broadcast(heavy), by).groupBy(*by).agg(F.percentile_approx("_o", cuts, 1000).alias("_borders")))


def borders_before() -> tuple[Column, Column]:
    """How many of a row's ``_borders``, none where its key isn't heavy, are below its ``_o``, and how many at or below it."""
    count = lambda c: F.coalesce(F.when(F.col("_borders").isNotNull(), F.size(c)), F.lit(0))
    return count(F.filter("_borders", lambda b: b < F.col("_o"))), count(F.filter("_borders", lambda b: b <= F.col("_o")))


def _matched(left: DataFrame, right: DataFrame, by: list[str], name: str, forward: bool, exact: bool, share: float, ranges: int) -> DataFrame:
    """``left`` (by, _t, _row) with ``name``: the struct of the nearest row of ``right`` (by, _t, _right)."""
    sign = (lambda c: -c) if forward else (lambda c: c)
    # the rows of both sides in one order; of right rows of one time only the greatest counts
    single = right.groupBy(*by, sign(F.col("_t")).alias("_o")).agg(F.max("_right").alias("_right"))
    lefts = left.withColumn("_o", sign(F.col("_t")))
    both_keys = lefts.select(*by, "_o").unionByName(single.select(*by, "_o"))
    borders = F.broadcast(time_ranges(both_keys, by, share, ranges))

    below, upto = borders_before()
    # a time so frequent that it is several borders: its left rows are dealt over the ranges between those
    first = F.when(upto > below, below + 1).otherwise(upto)
    l_rows = lefts.join(borders, by, "left").withColumn("_range", (first + F.pmod(row_hash(lefts.select("_row")), F.greatest(upto - below, F.lit(1)))).cast("int"))
    r_rows = single.join(borders, by, "left").withColumn("_range", (first if exact else upto).cast("int"))

    columns = [c for c in left.columns if c not in (*by, "_t", "_row")]  # results of an earlier pass
    l_rows = l_rows.select(*by, "_t", "_o", "_range", F.lit(1 if exact else 0).alias("_side"), F.col("_row"), F.lit(None).cast(single.schema["_right"].dataType).alias("_right"), *columns, F.lit(True).alias("_is_left"))
    empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns]
    merged = l_rows.unionByName(r_rows.select(*by, F.lit(None).cast(left.schema["_t"].dataType).alias("_t"), "_o", "_range", F.lit(0 if exact else 1).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_right", *empty, F.lit(False).alias("_is_left")))
    upwards = Window.partitionBy(*by, "_range").orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("_found", F.last("_right", ignorenulls=True).over(upwards)).where("_is_left")

    # what each range of a heavy key takes over from the ranges before it: as many rows as heavy keys have ranges
    last = r_rows.where("_borders IS NOT NULL").groupBy(*by, "_range").agg(F.max_by("_right", "_o").alias("_last"))
    all_ranges = borders.select(*by, F.explode(F.sequence(F.lit(0), F.size("_borders"))).alias("_range"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_ranges.join(last, [*by, "_range"], "left").select(*by, "_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    out = found.join(F.broadcast(carried), [*by, "_range"], "left")
    return out.select(*by, "_t", "_row", *columns, F.coalesce("_found", "_carried").alias(name))


def asof_join(left: DataFrame, right: DataFrame, time: str, by: list[str], right_time: str | None = None, direction: str = "backward", tolerance: float | timedelta | None = None, exact: bool = True, suffix: str = "_right", share: float = SHARE, ranges: int = RANGES) -> DataFrame:
    """All rows of ``left`` with the columns of the row of ``right`` that has the same ``by`` and is nearest in time, or nulls.

    direction: backward (the last at or before the row's time), forward (the first at or after) or nearest (of both, the earlier one on a tie).
    exact: whether equal times count. tolerance: the largest distance, in microseconds or as a timedelta for timestamps, in days for dates,
    else in the numbers' unit.

    The rows of both sides are put in one order by key and time and the last right row is carried along. A key with at least ``share`` of all
    rows is cut into time ranges of about equal size (found by a job while the plan is made, and stored), each worked on by itself, and its ranges take over the last right row of those
    before; so one key, and even one time of it, spreads over many tasks.

    Defined results: of right rows of one key and time the one with the greatest other columns, in order, counts
    (nulls are least); rows with a null or NaN time or a null key match nothing, and left ones are kept; repeated left rows are kept each; either side may be
    empty. Right columns whose names the left has get the suffix.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no such direction: {direction}")
    right_time = right_time or time
    payload = [c for c in right.columns if c not in by]
    names = [c + suffix if c in left.columns else c for c in payload]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    keys = [f"_k{i}" for i in range(len(by))]
    own = left.select(*(quoted(c).alias(k) for c, k in zip(by, keys, strict=True)), ordinal(left, time).alias("_t"), F.struct(*(quoted(c) for c in left.columns)).alias("_row"))
    other = right.select(*(quoted(c).alias(k) for c, k in zip(by, keys, strict=True)), ordinal(right, right_time).alias("_t"), F.struct(ordinal(right, right_time).alias("_time"), F.struct(*(quoted(c) for c in payload)).alias("_payload")).alias("_right"))
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*keys, "_t"])
    valid = own.where(complete)
    other = other.where(complete)
    found = valid
    for name in ("backward", "forward"):
        if direction in (name, "nearest"):
            found = _matched(found, other, keys, f"_{name}", name == "forward", exact, share, ranges)
    distance = lambda c: F.abs(F.col(c)["_time"] - F.col("_t"))
    if direction == "nearest":
        later = F.col("_backward").isNull() | (F.col("_forward").isNotNull() & (distance("_forward") < distance("_backward")))
        found = found.withColumn("_match", F.when(later, F.col("_forward")).otherwise(F.col("_backward")))
    else:
        found = found.withColumnRenamed(f"_{direction}", "_match")
    if tolerance is not None:
        limit = round(tolerance / timedelta(microseconds=1)) if isinstance(tolerance, timedelta) else tolerance
        found = found.withColumn("_match", F.when(distance("_match") <= F.lit(limit), F.col("_match")))
    found = found.select("_row", "_match").unionByName(own.where(f"NOT ({complete})").select("_row"), allowMissingColumns=True)
    return found.select(*(F.col("_row")[c].alias(c) for c in left.columns), *(F.col("_match")["_payload"][c].alias(n) for c, n in zip(payload, names, strict=True)))
