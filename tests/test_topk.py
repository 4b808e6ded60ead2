"""First rows by group with bounds on the scan, against SQL and a plain version."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from compare import same
from tallyforge import plans
from tallyforge.operators.topk import group_bounds, scan_filter, top_k
from tallyforge.storage import stored

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["topk_orders", "topk_lines"])
def test_query_equals_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, SF).toPandas(), duck(plans.ORACLE_SQL[name], SF))


def plain(rows, k):
    groups = defaultdict(list)
    for g, h, v, i in rows:
        groups[g, h].append((v is None, -(v or 0), i, v))
    return Counter((g, h, x[3], x[2], n + 1) for (g, h), own in groups.items() for n, x in enumerate(sorted(own)[:k]))


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_rows_are_the_plain_ones(spark, k):
    r = random.Random(k)
    # one key has a third of the rows; values tie, keys and values may be null
    rows = [(7 if i % 3 == 0 else r.choice([None, *range(-5, 40)]), r.choice(["a", "b.c", None]), r.choice([None, *range(30)]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g int, h string, v long, i long").repartition(5)
    for ranges in (1, 4):
        assert Counter(map(tuple, top_k(df, ["g", "h"], "v", ["i"], k, stored, ranges=ranges).collect())) == plain(rows, k)
    by_text = top_k(df, ["h", "g"], "v", ["i"], k, stored).select("g", "h", "v", "i", "rank")
    assert Counter(map(tuple, by_text.collect())) == plain(rows, k)


def test_empty_and_none(spark):
    df = spark.createDataFrame([(1, 2, 3)], "g int, v int, i int")
    assert top_k(df.limit(0), ["g"], "v", ["i"], 2, stored).count() == 0
    assert top_k(df, ["g"], "v", ["i"], 0, stored).count() == 0
    assert top_k(df, ["g"], "v", ["i"], 2, stored).columns == ["g", "v", "i", "rank"]


def test_dates_make_ranges(spark):
    df = spark.range(400).selectExpr("date_add(date'2020-01-01', cast(id % 40 as int)) AS g", "id AS v", "id AS i")
    got = top_k(df, ["g"], "v", ["i"], 2, stored, ranges=4)
    assert got.count() == 80 and got.agg(F.min("v")).first()[0] == 320


def rows_scanned(df):
    """Rows that leave the scan, after row groups were skipped."""
    ran = df._jdf.queryExecution()
    ran.toRdd().count()
    return ran.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_the_fewer_rows_the_less_is_read(spark, tmp_path):
    n = 200_000
    # laid out by value, in row groups of some thousand rows
    table = spark.range(n).selectExpr("id % 50 AS g", "id DIV 10 AS v", "id AS i", "repeat('x', 40) AS wide")
    table.coalesce(1).sortWithinPartitions("v").write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 8 << 10).option("parquet.enable.dictionary", "false").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = {}
        for k in (1, 1000, 4000):
            bounds = stored(group_bounds(df, ["g"], "v", ["i"], k))
            read[k] = rows_scanned(df.where(scan_filter(bounds, "g", "v")))
            assert top_k(df, ["g"], "v", ["i"], k, stored).count() == 50 * k
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert read[1] < read[1000] < read[4000] == n and read[1] * 10 < n


def test_tasks_limit_groups_before_the_shuffle(spark):
    df = spark.range(0, 10_000, 1, 8).selectExpr("id % 3 AS g", "id AS v", "id AS i")
    plan = group_bounds(df, ["g"], "v", ["i"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
