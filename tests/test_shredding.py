"""Shredded JSON: round trips, conflicting kinds, nulls and texts that stay whole."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import same
from tallyforge import plans
from tallyforge.functions.shredding import name_of, parsed, path_of, paths, plan, shred, unshred

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["json_shredded", "json_paths"])
def test_queries_equal_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, SF).toPandas(), duck(plans.ORACLE_SQL[name], SF))


@given(st.lists(st.text(alphabet="a.\\b ", max_size=4), min_size=1, max_size=4).map(tuple))
def test_names_of_paths(path):
    assert path_of(name_of(path)) == path


TEXTS = [
    None, "{}", "[]", "7", "null", "not json", '{"a": 1', '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', '{"a": "\\ud800"}', '{"a": "\\ud83d\\ude00é\\n"}',
    '{"a": 1, "b": {"c": "x", "d": null}}', '{"a": 1.0, "b": {"c": 2}}', '{"a": true, "b": 5}', '{"a": null}', '{"a": 9223372036854775808, "b": {}}', '{"a": -9223372036854775808}',
    '{"a.b": 1, "a": {"b": 2}}', '{"": 3, "A": 4}', '{"l": [1, {"a": 2}], "f": 0.1, "t": false}', '{"b": {"c": "", "e": {"f": {}}}}', '{"a": 1, "b": {"c": "y"}}', ' {"f" : 1e2 , "a":-0.0} ', '{"t": true, "f": 1e-7, "b": {"c": "z"}}',
]


def equal(a, b):
    """The same value, and the same text where it is no plain object."""
    if a is None or b is None or parsed(a) is None:
        return a == b
    kinds = lambda v: {k: kinds(x) for k, x in sorted(v.items())} if isinstance(v, dict) else [kinds(x) for x in v] if isinstance(v, list) else (type(v).__name__, repr(v))
    return kinds(json.loads(a)) == kinds(json.loads(b))


def round_trip(spark, texts, columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "`id.x` int, j string").repartition(3)
    chosen = plan(df, "j", columns=columns, share=0.0)
    out = shred(df, "j", chosen, prefix="p_")
    assert len(chosen) <= columns and out.columns == ["id.x", *("p_" + p for p, _ in chosen), "rest"]
    back = out.select(F.col("`id.x`").alias("i"), unshred([F.col("`p_" + p.replace("`", "``") + "`") for p, _ in chosen], chosen, F.col("rest")).alias("j"), "rest")
    rows = {r["i"]: r for r in back.collect()}
    for i, t in enumerate(texts):
        assert equal(t, rows[i]["j"]), (t, rows[i]["j"], chosen)
    return chosen, out


@pytest.mark.parametrize("columns", [0, 2, 50])
def test_round_trip(spark, columns):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        chosen, out = round_trip(spark, TEXTS, columns)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    kinds = dict(chosen)
    if columns == 50:
        assert kinds["a"] == "long" and kinds["b.c"] == "string" and kinds["a\\.b"] == "long" and kinds["f"] == "double" and kinds["t"] == "boolean"
        assert out.schema["p_f"].dataType.simpleString() == "double"


SCALAR = st.none() | st.booleans() | st.integers(-(2**64), 2**64) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=4)
VALUE = st.recursive(SCALAR, lambda v: st.lists(v, max_size=2) | st.dictionaries(st.sampled_from(["a", "b", "c.d", ""]), v, max_size=3), max_leaves=8)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b", "x"]), VALUE, max_size=3).map(json.dumps), min_size=1, max_size=40))
def test_round_trip_of_any_objects(spark, texts):
    round_trip(spark, texts, 20)


def test_paths_are_counted_and_empty_tables(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "j string")
    found = {(r["path"], r["kind"]): r["rows"] for r in paths(df, "j").collect()}
    assert found["a", "long"] == 3 and found["a", "double"] == 2 and found["a", "boolean"] == 1 and found["b.c", "long"] == 1 and ("l", "string") not in found
    assert plan(df.limit(0), "j") == [] and shred(df.limit(0), "j", [("a", "long")]).count() == 0
