"""The join on two inequalities against plain versions and SQL."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import same
from tallyforge import plans
from tallyforge.operators import theta_join as theta
from tallyforge.operators.theta_join import bit_set_join, keys_of, theta_join

SF = "/root/testdata/sf0.01"
HOLDS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def test_query_equals_sql(spark, duck):
    got = plans.QUERIES["join_theta"](spark, SF).toPandas()
    assert len(got) > 1000
    same(got, duck(plans.ORACLE_SQL["join_theta"], SF))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=30), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=30), st.booleans(), st.booleans())
def test_bit_sets_find_all_pairs(left, right, x_equal, y_equal):
    arrays = [np.array([p[k] for p in side], np.int64) for side in (left, right) for k in (0, 1)]
    got = Counter(zip(*(v.tolist() for v in bit_set_join(*arrays, x_equal, y_equal)), strict=True))
    holds = lambda a, b, e: a <= b if e else a < b
    assert got == Counter((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if holds(a[0], b[0], x_equal) and holds(a[1], b[1], y_equal))


def test_pairs_come_a_few_at_a_time():
    """A block's pairs may be as many as the product of its sides."""
    places = np.arange(3000)
    sizes = [len(i) for i, _ in theta.bit_set_pairs(places, -places, places + 3000, places + 3000, False, False)]
    assert sum(sizes) == 3000**2 and max(sizes) < theta.SENT_PAIRS + 3000


def test_stripes_meet_once():
    for a in range(16):
        for b in range(16):
            meet = set(keys_of(a, 16, True)) & set(keys_of(b, 16, False))
            assert len(meet) == (a <= b) and (a != b or meet == {-1 - a})


@pytest.mark.parametrize(("one", "two", "kind"), [("<", ">", "int"), ("<=", "<=", "double"), (">", ">=", "long")])
def test_theta_is_the_plain_one(spark, one, two, kind):
    r = random.Random(3)
    odd = [None, None, float("nan"), float("inf")] if kind == "double" else [None, -(2**31) if kind == "int" else -(2**63), 5, 5]
    value = lambda: r.choice(odd) if r.random() < 0.1 else r.choice([3] * 8 + list(range(40)))
    fit = (lambda v: None if v is None else float(v)) if kind == "double" else lambda v: v
    left, right = [(fit(value()), fit(value()), i // 2) for i in range(150)], [(fit(value()), fit(value()), i) for i in range(130)]
    a, b = spark.createDataFrame(left, f"x {kind}, y {kind}, i int"), spark.createDataFrame(right, f"x {kind}, z {kind}, j int")
    got = theta_join(a, b, ("x", one, "x"), ("y", two, "z"), stripes=8, block_rows=20)
    assert got.columns == ["x", "y", "i", "x_right", "z", "j"]
    ok = lambda op, u, v: u is not None and v is not None and u == u and v == v and HOLDS[op](u, v)
    assert Counter(map(tuple, got.collect())) == Counter((*u, *v) for u in left for v in right if ok(one, u[0], v[0]) and ok(two, u[1], v[1]))


def test_few_rows_are_compared(spark):
    """Nodes whose rows are compared hold far fewer pairs than all."""
    a = spark.range(4000).selectExpr("id AS i", "id * 7919 % 4001 AS x", "id * 104729 % 4003 AS y")
    b = a.selectExpr("i AS j", "x AS u", "y + 3900 AS v")
    got = theta_join(a, b, ("x", "<", "u"), ("y", ">", "v"))
    low = b.where("v < 4003").collect()
    assert got.count() == sum(p["x"] < q["u"] and p["y"] > q["v"] for p in a.collect() for q in low)
    # stripes by rank, about as the quantiles give them; pairs in nodes where an order isn't parted
    tiles = lambda rows: Counter((r["sx"], r["sy"]) for r in rows.selectExpr("int(x * 64 / 4001) AS sx", "int(y * 64 / 4003) AS sy").collect())
    nodes = []
    for side, rows in ((True, tiles(a)), (False, tiles(b.selectExpr("u AS x", "4002 - (v - 3900) AS y")))):
        nodes.append(Counter())
        for (sx, sy), n in rows.items():
            for kx in keys_of(sx, theta.STRIPES, side):
                for ky in keys_of(sy, theta.STRIPES, side):
                    nodes[-1][kx, ky] += n
    compared = sum(n * nodes[1][k] for k, n in nodes[0].items() if min(k) < 0)
    assert 0 < compared < 0.05 * 4000**2


def test_pairs_of_one_node_reach_many_tasks(spark):
    """All rows of one side below all of the other meet in one node; its pairs are the product of the sides."""
    a = spark.range(8500).selectExpr("id AS x", "id AS y")
    b = a.selectExpr("x + 8500 AS u", "y + 8500 AS v")
    made = [r["count"] for r in theta_join(a, b, ("x", "<", "u"), ("y", "<", "v")).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 8500**2 and max(made) < 0.4 * 8500**2


def test_stripes_of_one_value(spark):
    """Stripes whose bounds tell that all of their pairs hold, or none."""
    a, b = (spark.range(600).selectExpr("id % 6 AS x", "id % 5 AS y", f"id AS {i}") for i in "ij")
    for op, n in (("<", 15 * 10), ("<=", 21 * 15)):
        met = [(r["i"], r["j"]) for r in theta_join(a, b, ("x", op, "x"), ("y", op, "y")).collect()]
        assert len(set(met)) == len(met) == n * 20**2


def test_empty_sides_and_wrong_conditions(spark):
    a = spark.range(5).selectExpr("id AS x", "id AS y")
    assert theta_join(a.limit(0), a, ("x", "<", "x"), ("y", "<", "y")).count() == theta_join(a, a.limit(0), ("x", "<", "x"), ("y", "<", "y")).count() == 0
    with pytest.raises(ValueError, match="no such inequality"):
        theta_join(a, a, ("x", "=", "x"), ("y", "<", "y"))
    with pytest.raises(ValueError, match="power of two"):
        theta_join(a, a, ("x", "<", "x"), ("y", "<", "y"), stripes=6)
    with pytest.raises(TypeError):
        theta_join(a, a.selectExpr("double(x) AS x", "y"), ("x", "<", "x"), ("y", "<", "y"))
