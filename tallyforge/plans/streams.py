"""Registered queries of the streaming additions over the supplied tables, and their SQL; outside what the reference describes."""

from pyspark.sql import functions as F

from tallyforge.plans.joins import HOT_USER
from tallyforge.sources import table
from tallyforge.storage import shared_folder
from tallyforge.streaming.kept_aggregate import KeptAggregate
from tallyforge.streaming.sessions import batch_sessions, replayed, standing

HOUR_US = 3_600_000_000
GAP_US = 2 * HOUR_US


def _users(events):
    return events.withColumn("user", F.when(F.col("event_id") % 3 == 0, F.lit(HOT_USER).cast("long")).otherwise(F.col("user_id")))


def _named(sessions):
    return sessions.select(F.col("key").alias("user"), "start", "last", "n", "total")


def sessions(spark, sf_dir):
    """Users' sessions with gaps of two hours at most, through a stream's state; values in cents."""
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as a stream takes no single file by its name
    stream = _users(spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet"))
    changes = replayed(spark, stream, "user", "ts", F.round(F.col("value") * 100), GAP_US, 24 * HOUR_US, shared_folder(spark))
    return _named(standing(changes))


def sessions_of_table(spark, sf_dir):
    """The same sessions of the table as a whole."""
    return _named(batch_sessions(_users(table(spark, sf_dir, "events")), "user", "ts", F.round(F.col("value") * 100), GAP_US))


def kept_orders(spark, sf_dir):
    """Prices by priority, kept over three batches: all orders come, those that are open go again, and the last batch is replayed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(14,2)").alias("price"), "o_orderkey", "o_orderstatus")
    kept = KeptAggregate(spark, shared_folder(spark), ["priority"], "price")
    kept.apply(o.where("o_orderkey % 2 = 0").withColumn("sign", F.lit(1)), 0)
    last = o.where("o_orderkey % 2 = 1").withColumn("sign", F.lit(1)).unionByName(o.where("o_orderstatus = 'O'").withColumn("sign", F.lit(-1)))
    for _ in range(2):
        kept.apply(last, 1)
    return kept.aggregates().select("priority", "n", F.col("total").cast("decimal(18,2)").alias("total"), "least", "greatest")


QUERIES = {"stream_sessions": sessions, "batch_sessions": sessions_of_table, "kept_aggregate": kept_orders}

_SQL = f"""
WITH e AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {HOT_USER} ELSE user_id END AS user_, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_ ORDER BY us, event_id) <= {GAP_US} THEN 0 ELSE 1 END AS opens FROM e),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_ ORDER BY us, event_id) AS number FROM marked)
SELECT user_ AS "user", min(us) AS start, max(us) AS last, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM numbered GROUP BY user_, number
"""

ORACLE_SQL = {
    "stream_sessions": _SQL,
    "batch_sessions": _SQL,
    "kept_aggregate": """
WITH o AS (SELECT o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(14,2)) AS price FROM orders WHERE o_orderstatus <> 'O')
SELECT priority, count(*) AS n, CAST(sum(price) AS DECIMAL(18,2)) AS total, min(price) AS least, max(price) AS greatest FROM o GROUP BY priority""",
}
