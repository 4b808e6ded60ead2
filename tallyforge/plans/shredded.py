"""Registered queries of shredded JSON over the supplied tables, and their SQL; outside what the reference describes."""

from pyspark.sql import functions as F

from tallyforge.functions.shredding import paths, plan, shred
from tallyforge.sources import table


def props(spark, sf_dir):
    """Events' properties as typed columns, chosen by what the texts hold, by event type."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    chosen = plan(events, "props")
    return shred(events, "props", chosen, prefix="p_").select("event_id", "event_type", "p_k", F.coalesce("rest", F.lit("")).alias("rest"))


def props_paths(spark, sf_dir):
    """What the properties hold: rows by path and kind."""
    return paths(table(spark, sf_dir, "events"), "props")


QUERIES = {"json_shredded": props, "json_paths": props_paths}

ORACLE_SQL = {
    "json_shredded": "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS p_k, '' AS rest FROM events",
    "json_paths": "SELECT 'k' AS path, 'long' AS kind, count(*) AS rows FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')",
}
