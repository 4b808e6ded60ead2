"""Joins of points with intervals, and of overlapping intervals, through levels of bins; totals of them without pairs.

Outside what the reference describes: a general addition.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.asof_join import RANGES, borders_before, ordinal, time_ranges
from tallyforge.operators.skew_join import SHARE, row_hash, skew_join

#: The width of bins grows by this power of two from level to level.
STEP = 2
#: The level of intervals of no length among numbers with fractions, and the last levels, whose one bin holds all.
NARROWEST, LAST_WHOLE, LAST = -40, 62, 1022
#: Stands for no value among whole numbers of which the least is looked for.
NONE = np.iinfo(np.int64).max


def level(start: Column, end: Column, whole: bool) -> Column:
    """The least level whose bins are wider than the interval is long, so that it touches two bins at most."""
    length = end.cast("double") - start.cast("double")
    low, high = (0, LAST_WHOLE) if whole else (NARROWEST, LAST)
    rough = F.when(length > 0, F.least(F.greatest(F.ceil(F.log2(length) / STEP) * STEP, F.lit(low)), F.lit(high))).otherwise(F.lit(low)).cast("int")
    return F.least(F.when(F.pow(F.lit(2.0), rough) <= length, rough + STEP).otherwise(rough), F.lit(high))


def bin_of(value: Column, lvl: Column, whole: bool) -> Column:
    """The value over two to the level, rounded down: a long for whole numbers, else a double without a fraction."""
    if whole:
        return F.when(lvl < LAST_WHOLE, F.call_function("shiftright", value, lvl)).otherwise(F.lit(0).cast("long"))
    scaled = value / F.pow(F.lit(2.0), lvl)
    return F.when(lvl < LAST, scaled - F.pmod(scaled, F.lit(1.0))).otherwise(F.lit(0.0))


def _indexed(intervals: DataFrame, whole: bool) -> DataFrame:
    """Each interval (_s, _e) with its level and a row for each of the two bins at most that it touches there."""
    rows = intervals.withColumn("_level", level(F.col("_s"), F.col("_e"), whole))
    bins = F.array_distinct(F.array(*(bin_of(F.col(c), F.col("_level"), whole) for c in ("_s", "_e"))))
    return rows.withColumn("_bin", F.explode(bins))


def _found(points: DataFrame, intervals: DataFrame, keys: list[str], whole: bool, open_start: bool, open_end: bool, share: float) -> DataFrame:
    """Rows of ``points`` (keys, _p, ...) with those of ``intervals`` (keys, _s, _e, ...) that hold the point."""
    indexed = _indexed(intervals, whole)
    # a point asks each level that occurs for its own bin: 32 levels at most for whole numbers, 532 for others
    levels = sorted(r[0] for r in indexed.select("_level").distinct().collect())
    probes = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    probes = probes.withColumn("_bin", bin_of(F.col("_p"), F.col("_level"), whole))
    after = F.col("_p") > F.col("_s") if open_start else F.col("_p") >= F.col("_s")
    until = F.col("_p") < F.col("_e") if open_end else F.col("_p") <= F.col("_e")
    return skew_join(probes, indexed, [*keys, "_level", "_bin"], "inner", share).where(after & until).drop("_level", "_bin")


def _struct(df: DataFrame) -> Column:
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def _keyed(df: DataFrame, by: list[str], name: str, **numbers: Column) -> DataFrame:
    """Keys _k0, _k1 ..., the numbers, and the whole row as a struct."""
    return df.select(*(F.col("`" + c.replace("`", "``") + "`").alias(f"_k{i}") for i, c in enumerate(by)), *(v.alias(k) for k, v in numbers.items()), _struct(df).alias(name))


def _whole(*numbers: tuple[DataFrame, str]) -> bool:
    kinds = {df.select(ordinal(df, c).alias("x")).schema["x"].dataType.typeName() for df, c in numbers}
    return kinds == {"long"}


def _columns(out: DataFrame, left: DataFrame, right: DataFrame, by: list[str], suffix: str) -> DataFrame:
    rest = [c for c in right.columns if c not in by]
    return out.select(*(F.col("_left")[c].alias(c) for c in left.columns), *(F.col("_right")[c].alias(c + suffix if c in left.columns else c) for c in rest))


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: list[str] = (), how: str = "inner", closed: str = "both", suffix: str = "_right", share: float = SHARE) -> DataFrame:
    """Points with all intervals of the same ``by`` that hold them; how: inner or left; closed: both, left, right or neither.

    An interval lies at the level whose bins are as wide as it is long, in two bins at most, however long it is; a point asks one bin of each level. So a bin's intervals are about as long as
    the bin, and what is compared is within a small factor of what is found where they lie evenly. Bins that many share are
    split by ``skew_join``. The levels that occur are asked for by a small job while the plan is made.

    Defined results: nulls and NaN, in ``by`` too, match nothing; an interval that ends before it starts holds nothing, one that ends where
    it starts holds that point if both ends are closed; repeated rows match each; either side may be empty. Whole numbers, dates, timestamps and
    numbers with fractions are allowed; both sides must be of one kind. Right columns whose names the left has get the suffix.
    """
    if how not in ("inner", "left") or closed not in ("both", "left", "right", "neither"):
        raise ValueError(f"no such join: {how}, {closed}")
    by = list(by)
    whole = _whole((points, point), (intervals, start), (intervals, end))
    keys, kind = [f"_k{i}" for i in range(len(by))], "long" if whole else "double"
    p = _keyed(points, by, "_left", _p=ordinal(points, point).cast(kind))
    i = _keyed(intervals, by, "_right", _s=ordinal(intervals, start).cast(kind), _e=ordinal(intervals, end).cast(kind))
    valid = " AND ".join(f"{k} IS NOT NULL" for k in [*keys, "_p"])
    i = i.where(" AND ".join([*(f"{k} IS NOT NULL" for k in keys), "_s <= _e"]))
    found = _found(p.where(valid), i, keys, whole, closed in ("right", "neither"), closed in ("left", "neither"), share)
    pairs = _columns(found, points, intervals, by, suffix)
    if how == "inner":
        return pairs
    # rows without a pair: equal rows have equal pairs, so they may be told apart by their values
    alone = p.select("_left").join(found.select("_left").distinct(), "_left", "left_anti")
    return pairs.unionByName(_columns(alone.withColumn("_right", F.lit(None).cast(found.schema["_right"].dataType)), points, intervals, by, suffix))


def overlap_join(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, by: list[str] = (), suffix: str = "_right", share: float = SHARE) -> DataFrame:
    """All pairs of closed intervals of the same ``by`` that share a point.

    Two intervals overlap when the left one starts in the right one, or the right one starts in the left one after its start; these
    cases exclude each other, and each is a ``range_join`` of starts. Nulls, reversed intervals and columns as there.
    """
    by = list(by)
    whole = _whole((left, left_start), (left, left_end), (right, right_start), (right, right_end))
    keys, kind = [f"_k{i}" for i in range(len(by))], "long" if whole else "double"

    def side(df, start, end, name):
        rows = _keyed(df, by, name, _s=ordinal(df, start).cast(kind), _e=ordinal(df, end).cast(kind))
        return rows.where(" AND ".join([*(f"{k} IS NOT NULL" for k in keys), "_s <= _e"]))

    a, b = side(left, left_start, left_end, "_left"), side(right, right_start, right_end, "_right")
    starts = lambda rows, name: rows.select(*keys, F.col("_s").alias("_p"), name)
    first = _found(starts(a, "_left"), b, keys, whole, False, False, share)
    second = _found(starts(b, "_right"), a, keys, whole, True, False, share)
    return _columns(first.select("_left", "_right").unionByName(second.select("_left", "_right")), left, right, by, suffix)


def _running(rows: DataFrame, keys: list[str], names: list[str], share: float, ranges: int) -> DataFrame:
    """Those of ``rows`` (keys, _o, _side, _row, names) that have a ``_row``, each with the sums of ``names`` up to it by key, in order of ``_o`` and ``_side``.

    Sides: 0 counts for rows of the same ``_o``, 1 are those rows, 2 counts for later ones only. Heavy keys are cut into ranges of ``_o``, to each of which the totals of those before are added.
    """
    borders = F.broadcast(time_ranges(rows.select(*keys, "_o"), keys, share, ranges))
    below, upto = borders_before()
    # a number that is several borders: its rows are dealt over the ranges between those, sums for them lie before, others behind
    first = F.when(upto > below, below + 1).otherwise(upto)
    spread = first + F.pmod(row_hash(rows.select("_row")), F.greatest(upto - below, F.lit(1)))
    rows = rows.join(borders, keys, "left").withColumn("_range", F.when(F.col("_side") == 0, first).when(F.col("_side") == 1, spread).otherwise(upto).cast("int"))
    order = Window.partitionBy(*keys, "_range").orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(*keys, "_range", "_row", *(F.sum(n).over(order).alias(n) for n in names)).where("_row IS NOT NULL")
    totals = rows.where("_borders IS NOT NULL AND _side <> 1").groupBy(*keys, "_range").agg(*(F.sum(n).alias(n) for n in names))
    every = borders.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_borders"))).alias("_range"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(totals, [*keys, "_range"], "left").select(*keys, "_range", *(F.sum(n).over(before).alias(f"_before_{n}") for n in names))
    out = sums.join(F.broadcast(carried), [*keys, "_range"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("_row", *(zero(F.col(n)) + zero(F.col(f"_before_{n}")) for n in names)).toDF("_row", *names)


def range_totals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: list[str], totals: dict[str, Column], closed: str = "both", share: float = SHARE, ranges: int = RANGES) -> DataFrame:
    """All points with totals of the intervals of the same ``by`` that hold them: what grouping a left ``range_join`` gives, without its pairs.

    ``totals`` names sums of whole or decimal numbers of the intervals' rows, exact and without order; nulls count as zero, and so do points that no
    interval holds. An interval adds its numbers where it starts and takes them off where it ends; a point has the sum of all before it. So the work
    grows with the rows, however many intervals hold a point. Intervals' ends of one time are summed before they are sorted, and heavy keys are cut into
    ranges, as in ``asof_join``. Nulls, NaN and reversed intervals as in ``range_join``.
    """
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError(f"no such intervals: {closed}")
    by = list(by)
    whole = _whole((points, point), (intervals, start), (intervals, end))
    keys, names, kind = [f"_k{i}" for i in range(len(by))], [f"_n{i}" for i in range(len(totals))], "long" if whole else "double"
    p = _keyed(points, by, "_row", _o=ordinal(points, point).cast(kind))
    i = _keyed(intervals, by, "_right", _s=ordinal(intervals, start).cast(kind), _e=ordinal(intervals, end).cast(kind), **{n: F.coalesce(c, F.lit(0)) for n, c in zip(names, totals.values(), strict=True)})
    valid = " AND ".join(f"{k} IS NOT NULL" for k in [*keys, "_o"])
    i = i.where(" AND ".join([*(f"{k} IS NOT NULL" for k in keys), "_s <= _e" if closed == "both" else "_s < _e"]))
    starts = i.select(*keys, F.col("_s").alias("_o"), F.lit(0 if closed in ("both", "left") else 2).alias("_side"), *names)
    ends = i.select(*keys, F.col("_e").alias("_o"), F.lit(2 if closed in ("both", "right") else 0).alias("_side"), *(-F.col(n) for n in names)).toDF(*starts.columns)
    edges = starts.unionByName(ends).groupBy(*keys, "_o", "_side").agg(*(F.sum(n).alias(n) for n in names))
    asked = p.where(valid).select(*keys, "_o", F.lit(1).alias("_side"), "_row")
    found = _running(asked.unionByName(edges, allowMissingColumns=True), keys, names, share, ranges)
    found = found.unionByName(p.where(f"NOT ({valid})").select("_row", *(F.lit(0).alias(n) for n in names)))
    return found.select(*(F.col("_row")[c].alias(c) for c in points.columns), *(F.col(n).alias(c) for n, c in zip(names, totals, strict=True)))


def _two_least(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The least value of both and the next different one, where each has these two."""
    low, high = np.minimum(a[0], b[0]), np.maximum(a[0], b[0])
    return low, np.minimum(np.where(high > low, high, NONE), np.minimum(a[1], b[1]))


def _nodes(first: np.ndarray, last: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, nodes), some at a time: the nodes of a binary tree over ``size`` leaves that together hold the leaves from first to before last of each place."""
    left, right = first + size, last + size
    while (left < right).any():
        odd = np.flatnonzero((left < right) & (left & 1 == 1))
        yield odd, left[odd]
        left[odd] += 1
        odd = np.flatnonzero((left < right) & (right & 1 == 1))
        right[odd] -= 1
        yield odd, right[odd]
        left, right = left >> 1, right >> 1


def least_overlapping(start: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value among the intervals that share a point with each interval, itself included, and the next different one; ``NONE`` if there is none.

    In order of start, an interval holds the starts of a stretch of others. Its partners are those of the stretch, whose least values a tree over the order tells, and
    the intervals whose stretches hold it, which leave their values at the tree's nodes.
    """
    order = np.argsort(start, kind="stable")
    s, v, n = start[order], value[order], len(order)
    first, last = np.searchsorted(s, s, "left"), np.searchsorted(s, end[order], "right")
    size = 1 << max(n - 1, 0).bit_length()
    low, high = np.full(2 * size, NONE), np.full(2 * size, NONE)
    low[size : size + n] = v
    at = size
    while at > 1:
        low[at // 2 : at], high[at // 2 : at] = _two_least((low[at : 2 * at : 2], high[at : 2 * at : 2]), (low[at + 1 : 2 * at : 2], high[at + 1 : 2 * at : 2]))
        at //= 2
    found, left_low, left_high = (np.full(n, NONE), np.full(n, NONE)), np.full(2 * size, NONE), np.full(2 * size, NONE)
    for places, nodes in _nodes(first, last, size):
        found[0][places], found[1][places] = _two_least((found[0][places], found[1][places]), (low[nodes], high[nodes]))
        np.minimum.at(left_low, nodes, v[places])
    for places, nodes in _nodes(first, last, size):
        np.minimum.at(left_high, nodes, np.where(v[places] > left_low[nodes], v[places], NONE))
    at = 1
    while at < size:
        above = np.repeat(left_low[at : 2 * at], 2), np.repeat(left_high[at : 2 * at], 2)
        left_low[2 * at : 4 * at], left_high[2 * at : 4 * at] = _two_least((left_low[2 * at : 4 * at], left_high[2 * at : 4 * at]), above)
        at *= 2
    both = _two_least(found, (left_low[size : size + n], left_high[size : size + n]))
    out = np.empty(n, np.int64), np.empty(n, np.int64)
    out[0][order], out[1][order] = both
    return out


def _other(first: np.ndarray, second: np.ndarray, value: np.ndarray) -> pa.Array:
    """The least value that isn't the own one, null if there is none."""
    least = np.where(first == value, second, first)
    return pa.array(least, pa.int64(), mask=least == NONE)


def _overlapping(rows: DataFrame, keys: list[str], share: float, ranges: int) -> DataFrame:
    """``rows`` (keys, _s, _e, _value) as keys, _value, _n and _least: how many rows of the key overlap those of the value, themselves included, and the least other value."""
    edges = rows.select(*keys, F.col("_s").alias("_o")).unionByName(rows.select(*keys, F.col("_e").alias("_o")))
    borders = F.broadcast(time_ranges(edges, keys, share, ranges))
    place = lambda c: F.when(F.col("_borders").isNotNull(), F.size(F.filter("_borders", lambda b: b <= F.col(c)))).otherwise(0)
    rows = rows.join(borders, keys, "left").withColumn("_first", place("_s")).withColumn("_last", place("_e"))
    cell = [*keys, "_first", "_last"]

    # of each heavy key and pair of ranges: the number of its rows and their two least values; ranges * ranges / 2 of a key at most
    heavy = rows.where("_borders IS NOT NULL").select(*cell, "_value")
    least = heavy.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("_low"))
    further = heavy.join(F.broadcast(least), cell).where("_value > _low").groupBy(*cell).agg(F.min("_value").alias("_high"))
    cells = least.join(F.broadcast(further), cell, "left")

    def across(table: pa.Table) -> pa.Table:
        """What rows of a cell have beyond the two ranges in which they start and end."""
        first, last, n = (table.column(c).to_numpy() for c in ("_first", "_last", "_rows"))
        starts, ends = (np.r_[0, np.cumsum(np.bincount(x, n, int(last.max()) + 1).astype(np.int64))] for x in (first, last))
        high = table.column("_high")
        value = np.r_[table.column("_low").to_numpy(), high.drop_null().to_numpy()]
        told = high.is_valid().to_numpy()
        v_first, v_last = np.r_[first, first[told]], np.r_[last, last[told]]
        order = np.argsort(value, kind="stable")
        value, v_first, v_last = value[order], v_first[order], v_last[order]
        two = [[], []]
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            v = value[((v_first < a) & (v_last > a)) | ((v_first > a) & (v_first < b))]
            next_ = v[v > v[0]] if len(v) else v
            two[0].append(int(v[0]) if len(v) else None)
            two[1].append(int(next_[0]) if len(next_) else None)
        out = table.select(cell).append_column("_across", pa.array(starts[last] - ends[first]))
        return out.append_column("_low", pa.array(two[0], pa.int64())).append_column("_high", pa.array(two[1], pa.int64()))

    kinds = {f: f"`{f}` {rows.schema[f].dataType.simpleString()}" for f in [*cell, "_value"]}
    around = cells.groupBy(*keys).applyInArrow(across, ", ".join([*(kinds[c] for c in cell), "_across long", "_low long", "_high long"]))

    def within(table: pa.Table) -> pa.Table:
        """Rows that start or end in a range, as far as they lie in it."""
        s, e, value, first, last, own = (table.column(c).to_numpy() for c in ("_s", "_e", "_value", "_first", "_last", "_range"))
        starts, ends = first == own, last == own
        until = np.searchsorted(np.sort(s[starts]), e, "right")
        before = np.searchsorted(np.sort(e[ends]), s, "left")
        lowest, highest = (-np.inf, np.inf) if s.dtype.kind == "f" else (np.iinfo(np.int64).min, np.iinfo(np.int64).max)
        low, high = least_overlapping(np.where(starts, s, lowest), np.where(ends, e, highest), value)
        out = table.select([*cell, "_value"]).append_column("_starts", pa.array(starts))
        return out.append_column("_n", pa.array(np.where(ends, until, 0) - np.where(starts, before, 0))).append_column("_least", _other(low, high, value))

    local = rows.select(*cell, "_s", "_e", "_value", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_range"))
    local = local.groupBy(*keys, "_range").applyInArrow(within, ", ".join([*kinds.values(), "_starts boolean", "_n long", "_least long"]))
    joined = local.join(F.broadcast(around), cell, "left")
    n = F.col("_n") + F.when(F.col("_starts"), F.coalesce("_across", F.lit(0))).otherwise(0)
    return joined.groupBy(*keys, "_value").agg(F.sum(n).alias("_n"), F.min(F.least("_least", F.when(F.col("_low") == F.col("_value"), F.col("_high")).otherwise(F.col("_low")))).alias("_least"))


def overlap_totals(rows: DataFrame, start: str, end: str, by: list[str], value: str, n: str, least: str, share: float = SHARE, ranges: int = RANGES) -> DataFrame:
    """For each ``by`` and ``value``, how many pairs its intervals make with overlapping ones of the same ``by`` and another value, and the least such value.

    That is what grouping an ``overlap_join`` of ``rows`` with itself gives, without its pairs: columns ``by``, ``value``, ``n`` and ``least``, where there is a pair. What overlaps an interval is what starts until
    its end, less what ends before its start. For least values heavy keys are cut into ranges, as in ``range_totals``: a row meets the rows that start or end
    in the two ranges of its own start and end, in a task for each, and of the others only the two least values of each pair of ranges. So the work
    grows with the rows and their logarithm. A task holds the rows of one range, or of one key that isn't heavy; a time isn't parted.

    Values are whole numbers. Nulls, NaN and reversed intervals as in ``range_join``; rows without a value match nothing. Values that several rows of a ``by`` share are counted
    by a job while the plan is made, and so are their pairs with themselves.
    """
    by = list(by)
    whole = _whole((rows, start), (rows, end))
    keys, kind = [f"_k{i}" for i in range(len(by))], "long" if whole else "double"
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    r = rows.select(*(quoted(c).alias(k) for c, k in zip(by, keys, strict=True)), ordinal(rows, start).cast(kind).alias("_s"), ordinal(rows, end).cast(kind).alias("_e"), quoted(value).cast("long").alias("_value"))
    r = r.where(" AND ".join([*(f"{k} IS NOT NULL" for k in keys), "_value IS NOT NULL", "_s <= _e"]))
    found = _overlapping(r, keys, share, ranges)
    own = F.lit(1)
    twice = r.groupBy(*keys, "_value").count().where("count > 1").drop("count")
    if not twice.isEmpty():
        again = r.join(twice, [*keys, "_value"], "left_semi").withColumn("_own", F.col("_value"))
        same = _overlapping(again, [*keys, "_own"], share, ranges).select(*keys, "_value", F.col("_n").alias("_same"))
        found, own = found.join(same, [*keys, "_value"], "left"), F.coalesce("_same", F.lit(1))
    found = found.withColumn("_n", F.col("_n") - own).where("_n > 0")
    return found.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), F.col("_value").cast(rows.schema[value].dataType).alias(value), F.col("_n").alias(n), F.coalesce("_least", F.lit(int(NONE))).alias(least))
