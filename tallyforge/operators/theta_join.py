"""Joins on two inequalities, by tiles of both orders and bit sets within a tile.

Outside what the reference describes: a general addition.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.asof_join import ordinal
from tallyforge.operators.skew_join import row_hash

#: Stripes of each order, a power of two; rows of a side that are compared in one task at once.
STRIPES, BLOCK_ROWS = 64, 50_000
#: Pairs that a task sends on at once, and those of one more row.
SENT_PAIRS = 100_000
#: Rows of a side that meet all of as many of the other in one cell; pairs of cells for each task that makes them, and the most such tasks.
CELL_ROWS, TASK_PAIRS, TASKS = 4_000, 5_000_000, 2_000


def bit_set_pairs(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, x_equal: bool, y_equal: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) with lx < rx and ly < ry, or <= where equal is allowed, some at a time.

    The right rows lie in order of x, and a permutation leads from their order of y to that. Left rows are taken
    from the largest y down; before each, the right rows whose y has come into reach set their bits; its partners
    are the bits set behind its own place in the order of x.
    """
    by_x = np.argsort(rx, kind="stable")
    place = np.empty(len(rx), np.int64)
    place[by_x] = np.arange(len(rx))
    down = np.argsort(ry, kind="stable")[::-1]
    permutation = place[down]
    order = np.argsort(ly, kind="stable")[::-1]
    reach = len(ry) - np.searchsorted(ry[down][::-1], ly[order], side="left" if y_equal else "right")
    begin = np.searchsorted(rx[by_x], lx[order], side="left" if x_equal else "right")
    bits, done, out_l, out_r, held = np.zeros(len(rx), bool), 0, [], [], 0
    for i, until, at in zip(order.tolist(), reach.tolist(), begin.tolist(), strict=True):
        bits[permutation[done:until]] = True
        done = until
        if found := np.count_nonzero(bits[at:]):
            out_l.append(np.full(found, i))
            out_r.append(np.flatnonzero(bits[at:]) + at)
            held += found
        if held >= SENT_PAIRS:
            yield np.concatenate(out_l), by_x[np.concatenate(out_r)]
            out_l, out_r, held = [], [], 0
    if held:
        yield np.concatenate(out_l), by_x[np.concatenate(out_r)]


def bit_set_join(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, x_equal: bool, y_equal: bool) -> tuple[np.ndarray, np.ndarray]:
    """All of ``bit_set_pairs`` at once."""
    left, right = zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *bit_set_pairs(lx, ly, rx, ry, x_equal, y_equal), strict=True)
    return np.concatenate(left), np.concatenate(right)


def _oriented(df: DataFrame, column: str, op: str) -> Column:
    """The column as a number, in reversed order for > and >=."""
    c = ordinal(df, column)
    if op[0] == "<":
        return c
    whole = isinstance(df.select(c.alias("c")).schema["c"].dataType, T.LongType)
    return F.bitwise_not(c) if whole else -c


def _stripe(column: str, borders: list, stripes: int) -> Column:
    """The number of borders at or below the value."""
    if not borders:
        return F.lit(0)
    cuts = F.array(*map(F.lit, borders))
    return F.least(F.size(F.filter(cuts, lambda b: b <= F.col(column))), F.lit(stripes - 1))


def keys_of(stripe: int, stripes: int, left: bool) -> list[int]:
    """The nodes by which a stripe meets others: its own, as a negative number, and nodes of the binary tree over all stripes.

    A left row names the nodes that together hold the stripes behind its own, a right row all nodes above its
    own stripe; so each pair of different stripes in order meets in one node.
    """
    leaf, out = stripes + stripe, [-1 - stripe]
    while leaf > 1:
        if left and leaf % 2 == 0:
            out.append(leaf + 1)
        if not left:
            out.append(leaf)
        leaf //= 2
    return out


def theta_join(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], suffix: str = "_right", stripes: int = STRIPES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs for which both conditions hold, each (left column, one of < <= > >=, right column).

    Rows beyond all of the other side go first. Both orders of the others are cut at quantiles into stripes, and a row lies in the tile of its stripes. Tiles meet in nodes of the binary trees over the stripes of each order:
    where both orders are parted, all pairs of a node are results and an equi-join makes them without a comparison, dealt over a grid of cells of at most about ``CELL_ROWS`` rows of each side; where
    tiles share a stripe and their least and greatest values there settle nothing, ``bit_set_join`` compares blocks of at most about ``block_rows`` rows of each side, and a task holds two blocks and few of their pairs. A row is copied only to
    nodes in which the other side has rows, as told by the tiles' counts and bounds, of which there are at most stripes * stripes a side, whatever the
    size of the tables; these are found by jobs while the plan is made.

    Defined results: nulls and NaN match nothing; repeated rows match each; sides may be empty. Whole numbers, dates, timestamps and numbers with
    fractions are allowed, both columns of a condition of one kind. Right columns whose names the left has get the suffix.
    """
    for _, op, _ in (first, second):
        if op not in ("<", "<=", ">", ">="):
            raise ValueError(f"no such inequality: {op}")
    if stripes & (stripes - 1):
        raise ValueError("stripes must be a power of two")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")

    def side(df, at, name):
        values = [_oriented(df, c[at], c[1]).alias(v) for c, v in ((first, "_x"), (second, "_y"))]
        row = F.struct(*(quoted(c) for c in df.columns))
        kind = df.select(row.alias("r")).schema["r"].dataType.simpleString()  # without "not null", as Arrow gives it back
        return df.select(*values, row.cast(kind).alias(name)).where("_x IS NOT NULL AND _y IS NOT NULL")

    a, b = side(left, 0, "_left"), side(right, 2, "_right")
    for v in ("_x", "_y"):
        if a.schema[v].dataType != b.schema[v].dataType:
            raise TypeError("both sides of a condition must be of one kind")
    equal = {"_x": first[1][1:] == "=", "_y": second[1][1:] == "="}
    greatest, least = b.agg(F.max("_x").alias("_x"), F.max("_y").alias("_y")).first(), a.agg(F.min("_x").alias("_x"), F.min("_y").alias("_y")).first()
    for v in ("_x", "_y"):
        kind = a.schema[v].dataType
        below, above = F.lit(greatest[v]).cast(kind), F.lit(least[v]).cast(kind)
        a, b = a.where(F.col(v) <= below if equal[v] else F.col(v) < below), b.where(F.col(v) >= above if equal[v] else F.col(v) > above)
    both = a.select("_x", "_y").unionByName(b.select("_x", "_y"))
    cuts = [i / stripes for i in range(1, stripes)]
    borders = both.agg(F.percentile_approx("_x", cuts, 10_000).alias("x"), F.percentile_approx("_y", cuts, 10_000).alias("y")).first()
    tiled = lambda df: df.withColumn("_sx", _stripe("_x", sorted(set(borders["x"] or [])), stripes)).withColumn("_sy", _stripe("_y", sorted(set(borders["y"] or [])), stripes))
    a, b = tiled(a), tiled(b)
    bounds = [f(v).alias(f"{v}{n}") for v in ("_x", "_y") for n, f in (("_min", F.min), ("_max", F.max))]
    tiles = [df.groupBy("_sx", "_sy").agg(F.count(F.lit(1)).alias("_n"), *bounds).collect() for df in (a, b)]

    # rows of each node and their bounds
    rows: list[dict] = [{}, {}]
    for i in (0, 1):
        for sx, sy, n, *ends in tiles[i]:
            for kx in keys_of(sx, stripes, i == 0):
                for ky in keys_of(sy, stripes, i == 0):
                    m, x0, x1, y0, y1 = rows[i].get((kx, ky), (0, *ends))
                    rows[i][kx, ky] = (m + n, min(x0, ends[0]), max(x1, ends[1]), min(y0, ends[2]), max(y1, ends[3]))

    def settled(key: int, v: str, l_min, l_max, r_min, r_max) -> bool | None:
        """Whether all pairs of a node hold in an order, or none; else nothing."""
        if key > 0 or l_max < r_min or (equal[v] and l_max == r_min):
            return True
        return False if l_min > r_max or (not equal[v] and l_min == r_max) else None

    # nodes with pairs: whether their orders are settled, and blocks of each side
    nodes, made = {}, 0
    for (kx, ky), (n, *x, y0, y1) in rows[0].items():
        if other := rows[1].get((kx, ky)):
            m, *u, v0, v1 = other
            x_all, y_all = settled(kx, "_x", *x, *u), settled(ky, "_y", y0, y1, v0, v1)
            if x_all is not False and y_all is not False:
                size = CELL_ROWS if x_all and y_all else block_rows
                nodes[kx, ky] = (x_all is True, y_all is True, -(-n // size), -(-m // size))
                made += n * m if x_all and y_all else 0
    spark, listed = left.sparkSession, []
    for i in (0, 1):
        met = [(sx, sy, kx, ky, *nodes[kx, ky][:2], nodes[kx, ky][2 + i], nodes[kx, ky][3 - i]) for sx, sy, *_ in tiles[i] for kx in keys_of(sx, stripes, i == 0) for ky in keys_of(sy, stripes, i == 0) if (kx, ky) in nodes]
        listed.append(F.broadcast(spark.createDataFrame(met, "_sx int, _sy int, _kx int, _ky int, _x_all boolean, _y_all boolean, _own int, _other int")))
    a, b = a.join(listed[0], ["_sx", "_sy"]), b.join(listed[1], ["_sx", "_sy"])

    def dealt(df, own, other, name):
        """A row's own block by a hash of its values, copied to each block of the other side."""
        number = F.pmod(row_hash(df.select("_x", "_y", name)), F.col("_own")).cast("int").alias(own)
        return df.select("_kx", "_ky", "_x_all", "_y_all", number, F.explode(F.sequence(F.lit(0), F.col("_other") - 1)).alias(other), "_x", "_y", name)

    node, parted = ["_kx", "_ky", "_i", "_j"], F.col("_x_all") & F.col("_y_all")
    l_rows, r_rows = dealt(a, "_i", "_j", "_left"), dealt(b, "_j", "_i", "_right")
    # a number of tasks that follows the pairs: by the rows' bytes there would be few
    tasks = max(1, min(TASKS, -(-made // TASK_PAIRS)))
    cells = lambda rows_, name: rows_.where(parted).select(*node, name).repartition(tasks, *node)
    pairs = cells(l_rows, "_left").join(cells(r_rows, "_right").hint("merge"), node).select("_left", "_right")
    kinds = {f: f"`{f}` {rows_.schema[f].dataType.simpleString()}" for rows_, f in ((a, "_left"), (b, "_right"))}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of both sides, told apart by _is_left; its pairs are sent as they are found, as there may be the product of the blocks."""
        table = pa.Table.from_batches(list(batches))
        ls, rs = table.filter(table["_is_left"]).combine_chunks(), table.filter(pc.invert(table["_is_left"])).combine_chunks()
        if not (len(ls) and len(rs)):
            return
        x = [t["_x"].to_numpy() for t in (ls, rs)]
        y = [t["_y"].to_numpy() for t in (ls, rs)]
        if ls["_x_all"][0].as_py():  # all are in reach
            x = [np.zeros(len(x[0])), np.ones(len(x[1]))]
        if ls["_y_all"][0].as_py():
            y = [np.zeros(len(y[0])), np.ones(len(y[1]))]
        for i, j in bit_set_pairs(x[0], y[0], x[1], y[1], equal["_x"], equal["_y"]):
            yield from pa.Table.from_arrays([ls["_left"].take(pa.array(i)), rs["_right"].take(pa.array(j))], ["_left", "_right"]).combine_chunks().to_batches()

    tagged = lambda rows_, is_left: rows_.where(~parted).select(*node, "_x_all", "_y_all", F.lit(is_left).alias("_is_left"), "_x", "_y", *(F.col(f) if f in rows_.columns else F.lit(None).cast(k.split("` ", 1)[1]).alias(f) for f, k in kinds.items()))
    met = tagged(l_rows, True).unionByName(tagged(r_rows, False)).groupBy(*node).applyInArrow(compared, ", ".join(kinds.values()))
    out = pairs.unionByName(met)
    return out.select(*(F.col("_left")[c].alias(c) for c in left.columns), *(F.col("_right")[c].alias(c + suffix if c in left.columns else c) for c in right.columns))
