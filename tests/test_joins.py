"""Skew-split, as-of and interval joins against plain versions and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import same
from tallyforge import plans
from tallyforge.operators.asof_join import asof_join
from tallyforge.operators.interval_join import least_overlapping, overlap_join, overlap_totals, range_join, range_totals
from tallyforge.operators.skew_join import HeavyHitters, heavy_keys, skew_join

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["join_asof", "join_range", "join_overlap", "join_skewed"])
def test_queries_equal_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, SF).toPandas(), duck(plans.ORACLE_SQL[name], SF))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=60), max_size=6), st.integers(1, 5))
def test_sketches_bound_their_error(parts, size):
    whole = HeavyHitters(size)
    for part in parts:
        one = HeavyHitters(size)
        for i in range(0, len(part), 7):
            one.add(np.array(part[i : i + 7], np.int64))
        whole.merge(one)
    true = Counter(v for p in parts for v in p)
    got = dict(zip(whole.values.tolist(), whole.counts.tolist(), strict=True))
    assert len(got) <= size and whole.error * (size + 1) <= sum(true.values())
    assert all(true[v] - whole.error <= got.get(v, 0) <= true[v] for v in true)


def test_heavy_keys_are_exact(spark):
    df = spark.range(9000, numPartitions=7).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 10 = 1 THEN NULL ELSE id END AS k", "CASE WHEN id % 3 = 0 THEN 'a' ELSE string(id % 50) END AS j")
    n = df.where("k IS NOT NULL").count()
    assert [tuple(r) for r in heavy_keys(df, ["k", "j"], 0.05).collect()] == [(1, "a", 3000, n)]
    assert heavy_keys(df.limit(0), ["k"]).collect() == []


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(5)
    key = lambda: r.choice([1] * 40 + [2] * 40 + [None] * 8 + list(range(3, 60)))
    left = [(key(), r.choice("ab"), i // 2) for i in range(300)]
    right = [(r.choice([1] * 30 + [3] * 30 + [None] * 9 + list(range(4, 90))), r.choice("ab"), i, {"m": i}) for i in range(260)]
    return (spark.createDataFrame(left, "k int, j string, l int").repartition(3), spark.createDataFrame(right, "k int, j string, r int, m map<string,int>").repartition(4))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_skew_join_is_the_join(sides, how):
    left, right = sides
    for on, share in ((["k"], 0.05), (["k", "j"], 0.03)):
        own = left if len(on) == 2 else left.withColumnRenamed("j", "j1")
        got, plain = skew_join(own, right, on, how, share), own.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
        assert got.columns == plain.columns
        assert Counter(map(repr, got.collect())) == Counter(map(repr, plain.collect()))
    assert skew_join(left.limit(0), right, ["k"], "right").count() == right.count()
    assert skew_join(left, right.limit(0), ["k"], how).count() == (left.count() if how in ("left", "full", "anti") else 0)
    with pytest.raises(ValueError, match="no such join"):
        skew_join(left, right, ["k"], "cross")


@pytest.mark.parametrize("how", ["inner", "left", "anti"])
def test_no_side_is_broadcast(spark, how):
    """However small a side looks while the query runs, packed as it is: the driver must not hold it."""
    a, b = spark.range(90).selectExpr("id AS k", "id AS l"), spark.range(90).selectExpr("id AS k", "id AS r")
    joined = skew_join(a, b, ["k"], how)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.search(r"SortMergeJoin[^\[]*\[[^]]*__cell_l", plan) and not re.search(r"BroadcastHashJoin[^\[]*\[[^]]*__cell_l", plan)


@pytest.fixture
def without_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def most(df, rows):
    """The largest task's part of all rows."""
    used = F.max(F.xxhash64(*df.columns))  # else columns and their windows are pruned
    n = [r[1] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)), used).collect()]
    return max(n) / rows


def test_a_third_of_the_rows_reaches_many_tasks(spark, without_adaptive):
    left = spark.range(60_000, numPartitions=8).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS l")
    right = spark.range(20_000, numPartitions=4).selectExpr("id AS k", "id AS r").hint("merge")
    assert most(left.join(right.hint("merge"), "k", "left"), 60_000) > 1 / 3
    assert most(skew_join(left, right, ["k"], "left"), 60_000) < 0.12
    times = left.select("k", F.col("l").alias("t"), "l")
    other = right.select(F.lit(7).cast("long").alias("k"), (F.col("r") * 3).alias("t"), "r")
    joined = asof_join(times, other, "t", ["k"])
    assert most(joined, 60_000) < 0.12 and joined.where("k = 7 AND r IS NULL").count() == 0
    one_time = times.withColumn("t", F.when(F.col("k") == 7, F.lit(5).cast("long")).otherwise(F.col("t")))
    joined = asof_join(one_time, other, "t", ["k"])
    assert most(joined, 60_000) < 0.12 and joined.where("k = 7").select("r").distinct().collect() == [(1,)]


def plain_asof(left, right, direction, tolerance, exact):
    out = []
    for k, t, i in left:
        near = []
        for k2, t2, v in right:
            if None in (k, t, k2, t2) or k != k2 or (not exact and t == t2):
                continue
            if direction in ("backward", "nearest") and t2 <= t:
                near.append(((t - t2, 0), (v is not None, v or 0), (t2, v)))
            if direction in ("forward", "nearest") and t2 >= t:
                near.append(((t2 - t, 1 if t2 > t else 0), (v is not None, v or 0), (t2, v)))
        best = None
        if near:
            d = min(n[0] for n in near)
            best = max((n for n in near if n[0] == d), key=lambda n: n[1])
            if tolerance is not None and d[0] > tolerance:
                best = None
        out.append((k, t, i, *(best[2] if best else (None, None))))
    return Counter(out)


@pytest.mark.parametrize(("direction", "exact", "tolerance"), [("backward", True, None), ("backward", False, 3), ("forward", True, 3), ("forward", False, None), ("nearest", True, 3), ("nearest", False, None)])
def test_asof_is_the_plain_one(spark, direction, exact, tolerance):
    r = random.Random(11)
    row = lambda i: (r.choice([1] * 30 + [None, 2, 3, 4]), r.choice([None, *[10] * 9, *range(60)]), i)
    left, right = [row(i // 2) for i in range(160)], [row(r.choice([None, i])) for i in range(50)]
    a, b = spark.createDataFrame(left, "k int, t int, v int").repartition(3), spark.createDataFrame(right, "k int, t int, v int").repartition(2)
    got = asof_join(a, b, "t", ["k"], direction=direction, tolerance=tolerance, exact=exact, share=0.1, ranges=8)
    assert got.columns == ["k", "t", "v", "t_right", "v_right"]
    assert Counter(map(tuple, got.collect())) == plain_asof(left, right, direction, tolerance, exact)


def test_borders_are_found_once(spark):
    """A plan that finds the quantiles anew at each place where it needs them may find others there."""
    a = spark.range(60).selectExpr("1 AS k", "id AS t")
    plan = asof_join(a, a, "t", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan


def test_asof_times_and_empty_sides(spark):
    a = spark.sql("SELECT 'x' AS `k.a`, timestamp'2024-01-01 00:00:01' AS t, map('a', 1) AS m UNION ALL SELECT 'x', timestamp'1960-01-01', map()")
    b = spark.sql("SELECT 'x' AS `k.a`, timestamp'1970-01-01' AS s, array(1, 2) AS v")
    assert {r["t"].year: r["v"] for r in asof_join(a, b, "t", ["k.a"], right_time="s").collect()} == {2024: [1, 2], 1960: None}
    assert asof_join(a, b.limit(0), "t", ["k.a"], right_time="s").count() == 2 and asof_join(a.limit(0), b, "t", ["k.a"], right_time="s").count() == 0
    d = spark.sql("SELECT 1 AS k, double('NaN') AS t UNION ALL SELECT 1, 2.5D")
    assert sorted((r["t"] == r["t"], r["v"] or 0) for r in asof_join(d, spark.sql("SELECT 1 AS k, 2.5D AS t, 9 AS v"), "t", ["k"]).collect())[-1] == (True, 9)
    with pytest.raises(TypeError):
        asof_join(a.withColumn("t", F.lit("x")), b, "t", ["k.a"], right_time="s")
    with pytest.raises(ValueError, match="no such direction"):
        asof_join(a, b, "t", ["k.a"], direction="up")


def plain_range(points, intervals, closed, how):
    out = Counter()
    for k, p, i in points:
        n = 0
        for k2, s, e, j in intervals:
            if None in (k, p, k2, s, e) or k != k2 or s > e or p != p:
                continue
            if (s <= p if closed in ("both", "left") else s < p) and (p <= e if closed in ("both", "right") else p < e):
                out[k, p, i, s, e, j] += 1
                n += 1
        if not n and how == "left":
            out[k, p, i, None, None, None] += 1
    return out


@pytest.mark.parametrize(("kind", "closed"), [("long", "both"), ("long", "left"), ("double", "right"), ("double", "neither"), ("double", "both")])
def test_range_join_is_the_plain_one(spark, kind, closed):
    r = random.Random(21)
    big = [2**62, -(2**62), 2**63 - 1, -(2**63), 0] if kind == "long" else [1e300, -1e300, float("inf"), float("-inf"), 0.0, 1e-30]
    number = lambda: r.choice(big) if r.random() < 0.1 else r.randint(-300, 300) * (1 if kind == "long" else 0.37)
    points = [(r.choice([1, 1, 1, 2, None]), r.choice([None, number(), number(), number(), number()]), i // 2) for i in range(120)]
    intervals = []
    for i in range(80):
        s = number()
        long = r.choice([0, 1, 2, 7, 100, 600]) * (1 if kind == "long" else 0.31)
        e = number() if r.random() < 0.2 else s if abs(s) > 2**60 else s + long
        intervals.append((r.choice([1, 1, 2, None]), r.choice([s, s, s, s, None]), e, i))
    a, b = spark.createDataFrame(points, f"k int, p {kind}, i int"), spark.createDataFrame(intervals, f"k int, s {kind}, e {kind}, j int")
    for how in ("inner", "left"):
        got = range_join(a, b, "p", "s", "e", ["k"], how=how, closed=closed, share=0.1)
        assert Counter(map(tuple, got.collect())) == plain_range(points, intervals, closed, how)
    assert range_join(a.limit(0), b, "p", "s", "e", ["k"], "left").count() == 0 and range_join(a, b.limit(0), "p", "s", "e").count() == 0


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
def test_totals_are_those_of_the_pairs(spark, closed):
    r = random.Random(31)
    points = [(r.choice([1] * 9 + [2, None]), r.choice([*[50] * 9, None, *range(0, 100, 3)]), i // 2) for i in range(200)]
    intervals = [(r.choice([1] * 9 + [2, None]), s, s + r.choice([-1, 0, 0, 1, 9, 80]), r.choice([None, 5, 7])) for s in (r.choice([50, 50, *range(90)]) for _ in range(150))]
    a, b = spark.createDataFrame(points, "k int, p int, i int").repartition(3), spark.createDataFrame(intervals, "k int, s int, e int, v int")
    got = range_totals(a, b, "p", "s", "e", ["k"], {"n": F.lit(1), "v": F.col("v")}, closed, share=0.2, ranges=8)
    pairs = range_join(a.distinct(), b, "p", "s", "e", ["k"], "left", closed).groupBy("k", "p", "i").agg(F.count("s"), F.coalesce(F.sum("v"), F.lit(0)))
    each = {tuple(x)[:3]: tuple(x) for x in pairs.collect()}
    assert Counter(map(tuple, got.collect())) == Counter(each[p] for p in points)
    assert range_totals(a, b.limit(0), "p", "s", "e", ["k"], {"n": F.lit(1)}).where("n = 0").count() == 200


def test_the_query_of_ranges_makes_no_pairs(spark):
    """It counts and sums what holds a point; the pairs would grow with the square of the tables."""
    plan = plans.QUERIES["join_range"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" not in plan and "_level" not in plan


def test_overlaps_are_the_plain_ones(spark):
    r = random.Random(22)
    rows = [(r.choice([1, 1, 2, None]), s, s + r.choice([-1, 0, 0, 3, 40, 5000, 2**40]), i) for i in range(90) for s in [r.choice([r.randint(0, 200), None, -(2**50)])] if s is not None]
    df = spark.createDataFrame(rows, "k int, s long, e long, i int")
    got = overlap_join(df, df, "s", "e", "s", "e", ["k"], share=0.1)
    plain = Counter((*a, *b[1:]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2])
    assert Counter(map(tuple, got.collect())) == plain
    assert overlap_join(df, df, "s", "e", "s", "e").count() >= sum(plain.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 9), st.integers(-4, 9)), max_size=40))
def test_least_values_of_overlaps(rows):
    s, long, v = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    low, high = least_overlapping(s, s + long, v)
    for i, got in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        values = sorted(set(v[(s <= s[i] + long[i]) & (s + long >= s[i])].tolist()))
        assert got == tuple([*values, 2**63 - 1][:2])


@pytest.mark.parametrize("kind", ["long", "double"])
def test_totals_of_overlaps_are_those_of_the_pairs(spark, kind):
    r = random.Random(41)
    for repeated in (1, 3):  # values of one row, and of several
        rows = [(r.choice([1] * 12 + [2, 3, None]), s, s + r.choice([-1, 0, 0, 1, 9, 40, 200]), r.choice([None, *[i // repeated] * 9])) for i in range(240) for s in [r.choice([50, 50, None, *range(200)])] if s is not None]
        df = spark.createDataFrame([(k, s * (1 if kind == "long" else 0.5), e * (1 if kind == "long" else 0.5), v) for k, s, e, v in rows], f"k int, s {kind}, e {kind}, v long").repartition(3)
        got = overlap_totals(df, "s", "e", ["k"], "v", "n", "least", share=0.2, ranges=8)
        pairs = overlap_join(df, df, "s", "e", "s", "e", ["k"]).where("v <> v_right").groupBy("k", "v").agg(F.count("s"), F.min("v_right"))
        assert got.columns == ["k", "v", "n", "least"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) != []
    assert overlap_totals(df.limit(0), "s", "e", ["k"], "v", "n", "least").count() == 0


def test_the_query_of_overlaps_has_every_user(spark):
    """The user with a third of the orders too, without making their pairs."""
    found = plans.QUERIES["join_overlap"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" not in plan and "_level" not in plan
    assert found.where("o_orderkey % 3 = 0").count() == plans.joins.orders(spark, SF).where("o_orderkey % 3 = 0").count()


def test_no_nested_loop_in_the_plan(spark, without_adaptive):
    for name in ("join_range", "join_overlap"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
