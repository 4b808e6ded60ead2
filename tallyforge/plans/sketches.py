"""Registered queries of sketches and grouping sets over the supplied tables, and their SQL; outside what the reference describes."""

from pyspark.sql import functions as F

from tallyforge.operators.lattice_cube import cube_sets, lattice
from tallyforge.operators.quantile_sketch import quantile_sketches, quantiles
from tallyforge.sources import table
from tallyforge.storage import stored

FRACTIONS = [0.01, 0.25, 0.5, 0.75, 0.99]


def price_quantiles(spark, sf_dir):
    """Estimated quantiles of prices by return flag, held against all rows: is each rank within the sketch's own bound?"""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    found = quantiles(quantile_sketches(lines, "price", ["flag"], size=128), FRACTIONS, ["flag"])
    ranks = lines.join(F.broadcast(found), "flag").groupBy("flag", "fraction", "n", "error").agg(F.sum((F.col("price") < F.col("value")).cast("long")).alias("below"), F.sum((F.col("price") <= F.col("value")).cast("long")).alias("upto"))
    due = F.ceil(F.col("fraction") * F.col("n"))
    within = (F.col("upto") >= due - F.col("error")) & (F.col("below") <= due + F.col("error"))
    return ranks.select("flag", "fraction", "n", within.alias("within"), (F.col("error") * 20 < F.col("n")).alias("small"))


CUBE = ["flag", "status", "line", "year"]


def line_cube(spark, sf_dir):
    """The cube of line items by four columns, with exact numbers of parts; a star where a column isn't grouped by."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("string").alias("line"), F.year("l_shipdate").cast("string").alias("year"),
        "l_partkey", F.col("l_quantity").cast("decimal(18,2)").alias("q"),
    )
    out = lattice(lines, CUBE, cube_sets(CUBE), "l_partkey", {"quantity": "q"}, stored)
    return out.select(*(F.coalesce(c, F.lit("*")).alias(c) for c in CUBE), "grouping", "n", F.col("distinct").alias("parts"), F.col("quantity").cast("decimal(18,2)").alias("quantity"))


QUERIES = {"sketch_quantiles": price_quantiles, "cube_lattice": line_cube}

ORACLE_SQL = {
    "sketch_quantiles": f"""
SELECT l_returnflag AS flag, fraction, count(*) AS n, true AS within, true AS small
FROM lineitem, (VALUES {", ".join(f"(CAST({f} AS DOUBLE))" for f in FRACTIONS)}) f(fraction) GROUP BY l_returnflag, fraction""",
    "cube_lattice": """
WITH l AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(l_linenumber AS VARCHAR) AS line, CAST(year(l_shipdate) AS VARCHAR) AS year, l_partkey, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem)
SELECT coalesce(flag, '*') AS flag, coalesce(status, '*') AS status, coalesce(line, '*') AS line, coalesce(year, '*') AS year,
  CAST(grouping_id(flag, status, line, year) AS BIGINT) AS grouping, count(*) AS n, count(DISTINCT l_partkey) AS parts, CAST(sum(q) AS DECIMAL(18,2)) AS quantity
FROM l GROUP BY CUBE (flag, status, line, year)""",
}
