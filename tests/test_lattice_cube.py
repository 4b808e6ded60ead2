"""Grouping sets from finer states against SQL and plain sets."""

import random
from collections import Counter

from compare import same
from tallyforge import plans
from tallyforge.operators.lattice_cube import cube_sets, lattice, parents, rollup_sets
from tallyforge.storage import stored

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark, duck):
    same(plans.QUERIES["cube_lattice"](spark, SF).toPandas(), duck(plans.ORACLE_SQL["cube_lattice"], SF))


def test_coarser_sets_come_from_the_smallest(spark):
    sizes = {"a": 1000, "b": 5, "c": 2}
    of = parents(["a", "b", "c"], cube_sets(["a", "b", "c"]), sizes)
    assert of[("b",)] == ("b", "c") and of[()] == ("c",) and of[("a",)] == ("a", "c") and of[("a", "b")] == ("a", "b", "c")
    assert rollup_sets(["a", "b"]) == [("a", "b"), ("a",), ()]
    assert parents(["a", "b"], [("b",), ()], {"a": 9, "b": 3}) == {("b",): ("a", "b"), (): ("b",)}


def test_groups_are_the_plain_ones(spark):
    r = random.Random(6)
    rows = [(r.choice(["x", "y", None]), r.choice([1, 2, None]), r.choice([None, r.randint(0, 40), r.randint(-(10**12), 10**12), 32768, 32767]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a string, b int, v long, w long").repartition(4)
    for sets in (cube_sets(["a", "b"]), [("b",), ()]):
        expected = Counter()
        for s in sets:
            groups: dict = {}
            for a, b, v, w in rows:
                groups.setdefault((a if "a" in s else None, b if "b" in s else None), []).append((v, w))
            level = (0 if "a" in s else 2) + (0 if "b" in s else 1)
            for k, own in groups.items():
                expected[(*k, level, len(own), len({v for v, _ in own} - {None}), sum(w for _, w in own))] += 1
        assert Counter(map(tuple, lattice(df, ["a", "b"], sets, "v", {"w": "w"}, stored).collect())) == expected
    assert [tuple(x) for x in lattice(df.limit(0), ["a", "b"], cube_sets(["a", "b"]), "v", {"w": "w"}, stored).collect()] == [(None, None, 3, 0, 0, None)]


def test_less_is_shuffled_than_by_expanding(spark):
    """Rows enter the states once; Spark's own cube multiplies them by the number of sets before it aggregates."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_returnflag AS a", "l_linestatus AS b", "l_linenumber AS c", "l_suppkey AS v")
    states = lines.groupBy("a", "b", "c").count().count()
    expanded = lines.cube("a", "b", "c").agg({"v": "count"}).count()
    plan = lattice(lines, ["a", "b", "c"], cube_sets(["a", "b", "c"]), "v", {}, stored)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "a#" in plan and states < expanded
