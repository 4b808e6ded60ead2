"""Sketches' ranks against exact ones, merged in any order and across runs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import same
from tallyforge import plans
from tallyforge.operators.quantile_sketch import Compactor, merge_sketches, quantile_sketches, quantiles
from tallyforge.storage import shared_folder

SF = "/root/testdata/sf0.01"
FRACTIONS = [0.0, 0.001, 0.1, 0.5, 0.9, 1.0]


def within(values, found, error):
    """Each estimate's exact rank is within the bound of what was asked for."""
    values = np.sort(values)
    for q, v in zip(FRACTIONS, found, strict=True):
        due = max(np.ceil(q * len(values)), 1)
        assert np.searchsorted(values, v, "right") >= due - error and np.searchsorted(values, v, "left") <= due + error


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 99), max_size=80), max_size=8), st.integers(1, 9), st.randoms())
def test_errors_are_bounded_in_any_order(parts, size, r):
    sketches = []
    for part in parts:
        one = Compactor(size)
        for i in range(0, len(part), 11):
            one.add(np.array(part[i : i + 11], float))
        sketches.append(Compactor.from_bytes(one.to_bytes()))
    while len(sketches) > 1:
        r.shuffle(sketches)
        sketches[0].merge(sketches.pop())
    values = np.array([v for p in parts for v in p], float)
    if sketches:
        assert sketches[0].n == len(values) == sum(len(v) << h for h, v in enumerate(sketches[0].levels))
        if len(values):
            within(values, sketches[0].quantiles(FRACTIONS), sketches[0].error)
        else:
            assert sketches[0].quantiles([0.5]) == [None]


def test_the_stated_bound_for_single_values():
    s, r = Compactor(64), random.Random(1)
    values = [r.random() for _ in range(20_000)]
    for v in values:
        s.add(np.array([v]))
    assert s.error <= 20_000 / 64 * (np.log2(20_000 / 64) + 1) and s.held() <= 65 * len(s.levels)
    within(np.array(values), s.quantiles(FRACTIONS), s.error)
    with pytest.raises(ValueError, match="version"):
        Compactor.from_bytes(bytes(48))


@pytest.mark.parametrize(("n", "parts", "batch"), [(1_200_000, 6, 1365), (3_000_000, 400, 3333), (100_000, 1, 1)])
def test_the_error_stays_small_however_many_values(n, parts, batch):
    values, sketches = np.random.default_rng(2).random(n), []
    for part in np.array_split(values, parts):
        sketches.append(Compactor(128))
        for i in range(0, len(part), batch):
            sketches[-1].add(part[i : i + batch])
    whole = sketches[0]
    for other in sketches[1:]:
        whole.merge(other)
    assert whole.n == n and whole.error * 20 < n and whole.held() < 10_000
    within(values, whole.quantiles(FRACTIONS), whole.error)


def test_sketches_of_the_first_version_are_read():
    old = Compactor.from_bytes(np.array([1, 4, 6, 3, 2, 2, 2, 2], "<i8").tobytes() + np.array([1, 2, 3, 4], "<f8").tobytes())
    assert (old.n, old.error, old.held()) == (6, 3, 4) and Compactor.from_bytes(old.to_bytes()).error == 3


def test_query_equals_sql(spark, duck):
    same(plans.QUERIES["sketch_quantiles"](spark, SF).toPandas(), duck(plans.ORACLE_SQL["sketch_quantiles"], SF))


def test_runs_are_merged_from_storage(spark):
    """Sketches of two runs, written and read again, are those of both tables within their bound."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_returnflag AS f", "l_extendedprice AS v", "l_orderkey AS k")
    folder = shared_folder(spark)
    for run in (0, 1):
        quantile_sketches(lines.where(f"k % 2 = {run}").repartition(5), "v", ["f"], size=64).write.mode("append").parquet(folder)
    both = merge_sketches(spark.read.parquet(folder), ["f"])
    rows = quantiles(both, FRACTIONS, ["f"]).toPandas()
    exact = lines.toPandas()
    for flag, own in rows.groupby("f"):
        values = exact[exact["f"] == flag]["v"].to_numpy()
        assert own["n"].iloc[0] == len(values) and own["error"].iloc[0] < len(values) / 20
        within(values, own.sort_values("fraction")["value"].tolist(), own["error"].iloc[0])


def test_nulls_groups_and_empty_tables(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', 1.0D), (NULL, 'a', 2.0D), (NULL, 'a', 4.0D), (2, 'b', NULL), (3, NULL, double('NaN')) t(`k.x`, j, v)").withColumnRenamed("k.x", "k")
    rows = {(r["k"], r["j"]): (r["n"], r["value"]) for r in quantiles(quantile_sketches(df, "v", ["k", "j"]), [0.5], ["k", "j"]).collect()}
    assert rows == {(1, "a"): (1, 1.0), (None, "a"): (2, 2.0)}
    assert [tuple(r) for r in quantiles(quantile_sketches(df, "v"), [1.0]).collect()] == [(3, 0, 1.0, 4.0)]
    assert quantile_sketches(df.limit(0), "v", ["k"]).count() == 0
