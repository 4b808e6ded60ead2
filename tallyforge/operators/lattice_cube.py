"""Grouping sets with exact distinct counts, coarser groupings made from finer ones.

Outside what the reference describes: a general addition.
"""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cube_sets(columns: list[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(columns), -1, -1) for c in combinations(columns, n)]


def rollup_sets(columns: list[str]) -> list[tuple[str, ...]]:
    return [tuple(columns[:n]) for n in range(len(columns), -1, -1)]


def parents(columns: list[str], sets: list[tuple[str, ...]], sizes: dict[str, int]) -> dict[tuple[str, ...], tuple[str, ...]]:
    """For each grouping the finer one that it is made from: of those wanted the one with the fewest expected groups, else all columns."""
    whole, out = tuple(columns), {}
    for s in sets:
        expected = lambda p: (_product(sizes[c] for c in p), p)
        out[s] = min((p for p in {*sets, whole} if set(s) < set(p)), key=expected, default=whole)
    return out


def _product(values) -> int:
    out = 1
    for v in values:
        out *= max(v, 1)
    return out


def lattice(df: DataFrame, columns: list[str], sets: list[tuple[str, ...]], distinct: str, sums: dict[str, str], stored) -> DataFrame:
    """A row for each group of each set: the columns (null where not of the set), ``grouping`` as in SQL's grouping_id, ``n`` rows, ``distinct`` values and sums.

    ``distinct`` names a column of whole numbers, whose nulls don't count; ``sums`` gives output names by columns; ``stored`` writes a table
    to the shared folder and reads it again. Each group's distinct values are bitmaps, one for each 32,768 neighbouring
    numbers that occur. The rows are read once, for the states by all columns; every coarser grouping takes the or of a finer one's
    bitmaps, the one with the fewest groups, so nothing is multiplied by the number of sets, and one group's bitmaps are spread by number range and pre-aggregated.

    A null in a column is a group as any other. The grouping without columns has a row for an empty table too, as in SQL.
    """
    states = df.select(*columns, F.bitmap_bucket_number(F.col(distinct)).alias("_bucket"), F.bitmap_bit_position(F.col(distinct)).alias("_bit"), *(F.col(c).alias(f"_{n}") for n, c in sums.items()))
    own = lambda: [F.sum(f"_{n}").alias(f"_{n}") for n in sums]
    # bits of null are none: their bucket is null, and its bitmap isn't counted
    finest = stored(states.groupBy(*columns, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.bitmap_construct_agg(F.coalesce("_bit", F.lit(0))).alias("_bits"), *own()))
    sizes = finest.agg(*(F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(columns))).first()
    origin = parents(columns, sets, {c: sizes[i] for i, c in enumerate(columns)})
    made: dict[tuple[str, ...], DataFrame] = {tuple(columns): finest}

    def state(s: tuple[str, ...]) -> DataFrame:
        if s not in made:
            made[s] = state(origin[s]).groupBy(*s, "_bucket").agg(F.sum("_n").alias("_n"), F.bitmap_or_agg("_bits").alias("_bits"), *own())
        return made[s]

    out = None
    for s in sets:
        count = F.when(F.col("_bucket").isNotNull(), F.bitmap_count("_bits")).otherwise(0)
        rows = state(s).groupBy(*s).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(count), F.lit(0)).alias("distinct"), *(F.sum(f"_{n}").alias(n) for n in sums))
        level = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        shown = [F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns]
        rows = rows.select(*shown, F.lit(level).cast("long").alias("grouping"), "n", "distinct", *sums)
        out = rows if out is None else out.unionByName(rows)
    return out
