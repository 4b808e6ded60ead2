import json
from decimal import Decimal

import pytest

from compare import same
from tallyforge import plans
from tallyforge.operators import value_businesses, with_starting_multiple
from tallyforge.sources import BUSINESS, TRADE_MULTIPLE, read_businesses
from tallyforge.streaming import value_stream

D = lambda x: None if x is None else Decimal(str(x))

INPUTS = [
    ("b1", "hvac", 1000000, 700000, 100000, 50000, None),
    ("b2", "plumbing", 500000, 650000, 40000, 10000, None),
    ("b3", "roofing", 0, 0, 0, 0, None),
    ("b4", "cleaning", 250000, 200000, None, 5000, None),
    ("b5", "unlisted", 300000, 200000, 50000, 0, None),
    ("b6", "hvac", 800000, 600000, 80000, 0, "4.25"),
    ("b7", "hvac", 100000, 250000, 150000, 0, None),
]
EXPECTED = {
    "b1": (300000, 450000, 3.5, 1575000, 1350000, 1800000, 0.3),
    "b2": (-150000, -100000, 3.25, -325000, -275000, -375000, -0.3),
    "b3": (0, 0, 2.5, 0, 0, 0, None),
    "b4": (50000, None, 3.0, None, None, None, 0.2),
    "b5": (100000, 150000, None, None, None, None, 0.333333),
    "b6": (200000, 280000, 4.25, 1190000, 1050000, 1330000, 0.25),
    "b7": (-150000, 0, 3.5, 0, 0, 0, -1.5),
}
MULTIPLES = [("hvac", "3.50"), ("plumbing", "3.25"), ("roofing", "2.50"), ("cleaning", "3.00")]


def inputs(spark):
    return spark.createDataFrame([(a, b, *map(D, rest)) for a, b, *rest in INPUTS], BUSINESS)


def multiples(spark, rows=MULTIPLES):
    return spark.createDataFrame([(t, D(m)) for t, m in rows], TRADE_MULTIPLE)


def check(rows):
    got = {r["id"]: tuple(None if x is None else float(x) for x in r[1:]) for r in rows}
    assert got == {k: tuple(None if x is None else float(x) for x in v) for k, v in EXPECTED.items()}


def test_golden_rows(spark):
    check(value_businesses(inputs(spark), multiples(spark)).collect())


def test_shuffled_lookup_gives_the_same(spark):
    joined = with_starting_multiple(inputs(spark), multiples(spark), broadcast_rows=1)
    assert {r["id"]: r["multiple"] for r in joined.collect()}["b5"] is None and joined.count() == 7


def test_doubled_trade_doubles_no_business(spark):
    assert value_businesses(inputs(spark), multiples(spark, [*MULTIPLES, ("hvac", "9.00")])).count() == 7


def test_empty(spark):
    assert value_businesses(inputs(spark).limit(0), multiples(spark)).count() == 0


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [dict(zip(BUSINESS.names, (a, b, *(None if x is None else float(x) for x in rest)), strict=True)) for a, b, *rest in INPUTS]
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    check(value_businesses(read_businesses(spark, str(tmp_path / "in"), "json"), multiples(spark)).collect())
    q = value_stream(spark, str(tmp_path / "in"), multiples(spark)).writeStream.format("memory").queryName("valued").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    check(spark.table("valued").collect())


@pytest.mark.parametrize("name", plans.QUERIES)
def test_against_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas(), duck(plans.ORACLE_SQL[name], "/root/testdata/sf0.01"))


def test_layout_does_not_matter(spark):
    a = value_businesses(inputs(spark).repartition(8), multiples(spark)).collect()
    check(a)
