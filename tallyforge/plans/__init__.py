"""The registered valuation queries over the supplied tables, and their SQL.

The tables hold no businesses, so each supplier stands in for one: revenue is the discounted
price of its line items, operating expenses the list price of the parts sold, owner's pay its
positive balance, one-time costs the discounts on returned items. The multiples are
placeholders. The figures only exercise the formulas.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import functions as V
from tallyforge.operators import value_businesses, with_earnings, with_starting_multiple
from tallyforge.sources import TRADE_MULTIPLE, table

#: Fixed placeholder multiples by stand-in trade.
PLACEHOLDERS = (("trade0", "3.00"), ("trade1", "3.50"), ("trade2", "4.00"))


def multiples(spark: SparkSession) -> DataFrame:
    from decimal import Decimal

    return spark.createDataFrame([(t, Decimal(m)) for t, m in PLACEHOLDERS], TRADE_MULTIPLE)


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as business inputs. Money is decimal before it is summed, so no sum depends on row order."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    sums = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("l_suppkey")
        .agg(
            F.sum(money("l_extendedprice") * (1 - money("l_discount"))).cast("decimal(18,2)").alias("revenue"),
            F.sum(money("l_quantity") * money("p_retailprice")).cast("decimal(18,2)").alias("operating_expenses"),
            F.sum(F.when(F.col("l_returnflag") == "R", money("l_extendedprice") * money("l_discount")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)").alias("one_time_costs"),
        )
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return suppliers.join(sums, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.concat(F.lit("trade"), (F.col("s_suppkey") % 4).cast("string")).alias("trade"),
        "revenue",
        "operating_expenses",
        F.greatest(money("s_acctbal"), F.lit(0).cast("decimal(18,2)")).alias("owner_pay"),
        "one_time_costs",
        F.when(F.col("s_suppkey") % 10 == 0, F.lit("4.25")).cast("decimal(4,2)").alias("multiple_override"),
    )


def starting_multiple(spark, sf_dir):
    return with_starting_multiple(businesses(spark, sf_dir), multiples(spark)).select("id", "trade", "multiple")


def adjusted_multiple(spark, sf_dir):
    rows = with_starting_multiple(businesses(spark, sf_dir), multiples(spark))
    return rows.select("id", V.chosen_multiple(F.col("multiple"), F.col("multiple_override")).alias("multiple"))


def earnings(spark, sf_dir):
    return with_earnings(businesses(spark, sf_dir)).select("id", "ebitda")


def adjusted_earnings(spark, sf_dir):
    return with_earnings(businesses(spark, sf_dir)).select("id", "adjusted_ebitda")


def estimated_value(spark, sf_dir):
    return valuation(spark, sf_dir).select("id", "value_mid")


def value_range(spark, sf_dir):
    return valuation(spark, sf_dir).select("id", "value_low", "value_high")


def margin(spark, sf_dir):
    return valuation(spark, sf_dir).select("id", "ebitda_margin")


def valuation(spark, sf_dir):
    return value_businesses(businesses(spark, sf_dir), multiples(spark))


QUERIES = {
    "a1_starting_multiple": starting_multiple,
    "a2_adjusted_multiple": adjusted_multiple,
    "a3_ebitda": earnings,
    "a4_adjusted_ebitda": adjusted_earnings,
    "a5_estimated_value": estimated_value,
    "a6_value_range": value_range,
    "a7_ebitda_margin": margin,
    "valuation": valuation,
}

_BASE = """
WITH sums AS (
  SELECT l_suppkey,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DECIMAL(18,2)) AS revenue,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS operating_expenses,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS one_time_costs
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey),
multiples(trade, starting) AS (VALUES %s),
base AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, 'trade' || CAST(s_suppkey %% 4 AS VARCHAR) AS trade, revenue,
    revenue - operating_expenses AS ebitda,
    revenue - operating_expenses + greatest(CAST(s_acctbal AS DECIMAL(18,2)), 0) + one_time_costs AS adjusted,
    CASE WHEN s_suppkey %% 10 = 0 THEN 4.25 END AS override
  FROM supplier LEFT JOIN sums ON s_suppkey = l_suppkey),
v AS (
  SELECT id, base.trade AS trade, CAST(starting AS DECIMAL(4,2)) AS starting, CAST(coalesce(override, starting) AS DECIMAL(4,2)) AS multiple,
    CAST(revenue AS DOUBLE) AS revenue, CAST(ebitda AS DECIMAL(18,2)) AS ebitda, CAST(adjusted AS DECIMAL(18,2)) AS adjusted_ebitda
  FROM base LEFT JOIN multiples ON base.trade = multiples.trade)
""" % ", ".join(f"('{t}', {m})" for t, m in PLACEHOLDERS)

_AT = "CAST(adjusted_ebitda * CAST(multiple + %s AS DECIMAL(6,2)) AS DECIMAL(18,2))"
_MARGIN = "round(CAST(ebitda AS DOUBLE) / nullif(revenue, 0), 6)"

ORACLE_SQL = {
    "a1_starting_multiple": _BASE + "SELECT id, trade, starting AS multiple FROM v",
    "a2_adjusted_multiple": _BASE + "SELECT id, multiple FROM v",
    "a3_ebitda": _BASE + "SELECT id, ebitda FROM v",
    "a4_adjusted_ebitda": _BASE + "SELECT id, adjusted_ebitda FROM v",
    "a5_estimated_value": _BASE + f"SELECT id, {_AT % '0'} AS value_mid FROM v",
    "a6_value_range": _BASE + f"SELECT id, {_AT % '-0.5'} AS value_low, {_AT % '0.5'} AS value_high FROM v",
    "a7_ebitda_margin": _BASE + f"SELECT id, {_MARGIN} AS ebitda_margin FROM v",
    "valuation": _BASE + f"SELECT id, ebitda, adjusted_ebitda, multiple, {_AT % '0'} AS value_mid, {_AT % '-0.5'} AS value_low, {_AT % '0.5'} AS value_high, {_MARGIN} AS ebitda_margin FROM v",
}

# general operators beside the reference's, in modules of their own
from tallyforge.plans import joins, shredded, sketches, streams, topk  # noqa: E402

for _module in (joins, streams, sketches, shredded, topk):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
