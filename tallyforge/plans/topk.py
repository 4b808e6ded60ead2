"""Registered queries of the first rows by group over the supplied tables, and their SQL; outside what the reference describes."""

from pyspark.sql import functions as F

from tallyforge.operators.topk import top_k
from tallyforge.sources import table
from tallyforge.storage import stored

K = 3


def dearest_orders(spark, sf_dir):
    """Each customer's three dearest orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    return top_k(orders, ["o_custkey"], "price", ["o_orderkey"], K, stored)


def last_lines(spark, sf_dir):
    """The three line items shipped last of each supplier and return flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"))
    out = top_k(lines, ["l_suppkey", "l_returnflag"], "l_shipdate", ["l_orderkey", "l_linenumber"], K, stored)
    return out.select("l_suppkey", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), "l_orderkey", "l_linenumber", "quantity", "rank")


QUERIES = {"topk_orders": dearest_orders, "topk_lines": last_lines}

ORACLE_SQL = {
    "topk_orders": f"""
SELECT o_custkey, o_orderkey, o_totalprice AS price, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST) AS INTEGER) AS rank
FROM orders QUALIFY rank <= {K}""",
    "topk_lines": f"""
SELECT l_suppkey, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS quantity,
  CAST(row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate DESC NULLS LAST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST) AS INTEGER) AS rank
FROM lineitem QUALIFY rank <= {K}""",
}
