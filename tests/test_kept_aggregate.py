"""Aggregates kept over batches against recomputing them, with replays and failures."""

import random
from collections import defaultdict

import pytest

from compare import same
from tallyforge import plans
from tallyforge.storage import shared_folder
from tallyforge.streaming.kept_aggregate import KeptAggregate

SF = "/root/testdata/sf0.01"
SCHEMA = "k string, v long, sign int"


def test_query_equals_sql(spark, duck):
    same(plans.QUERIES["kept_aggregate"](spark, SF).toPandas(), duck(plans.ORACLE_SQL["kept_aggregate"], SF))


def plain(rows):
    by = defaultdict(lambda: defaultdict(int))
    for k, v, s in rows:
        by[k][v] += s
    out = {}
    for k, values in by.items():
        n = sum(values.values())
        there = [v for v, c in values.items() if c > 0 and v is not None]
        numbers = [v * c for v, c in values.items() if v is not None and c]
        if n > 0:
            out[k] = (n, sum(numbers) if numbers else None, min(there, default=None), max(there, default=None))
    return out


def test_batches_replays_and_failures(spark):
    r = random.Random(9)
    kept = KeptAggregate(spark, shared_folder(spark), ["k"], "v")
    with pytest.raises(ValueError, match="no batch"):
        kept.aggregates()
    rows, standing = [], []
    for number in range(4):
        come = [(r.choice(["a", "a", "b", None]), r.choice([None, *range(9)]), 1) for _ in range(30)]
        go = [(k, v, -1) for k, v, _ in r.sample(standing, min(12, len(standing)))]
        standing += come
        for k, v, _ in go:
            standing.remove((k, v, 1))
        batch = spark.createDataFrame(come + go, SCHEMA)
        rows += come + go
        if number == 2:  # a writer that failed leaves files without a mark
            spark.createDataFrame([("a", 99, 1)], "k string, v long, times long").write.parquet(kept._path(number))
            kept._files()[0].delete(spark._jvm.org.apache.hadoop.fs.Path(f"{kept._path(number)}/_SUCCESS"), False)
        assert kept.apply(batch, number) and not kept.apply(batch, number) and not kept.apply(batch, number - 1)
        assert {x["k"]: tuple(x)[1:] for x in kept.aggregates().collect()} == plain(rows)
    assert kept.versions() == [2, 3]
    assert kept.apply(spark.createDataFrame([], SCHEMA), 9) and kept.versions() == [3, 9]
    # a row that goes before it comes
    kept.apply(spark.createDataFrame([("z", 5, -1)], SCHEMA), 10)
    assert "z" not in {x["k"] for x in kept.aggregates().collect()}
    kept.apply(spark.createDataFrame([("z", 5, 1), ("z", 6, 1)], SCHEMA), 11)
    assert {x["k"]: tuple(x)[1:] for x in kept.aggregates().collect()}["z"] == (1, 6, 6, 6)


def test_as_the_sink_of_a_stream(spark):
    folder = shared_folder(spark)
    for i in range(3):
        spark.createDataFrame([("a", i, 1), ("b", 10 * i, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/p={i}")
    kept = KeptAggregate(spark, f"{folder}/state", ["k"], "v")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for _ in range(2):  # a second start finds nothing new
        stream.writeStream.foreachBatch(kept.apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert {x["k"]: tuple(x)[1:] for x in kept.aggregates().collect()} == {"a": (3, 3, 0, 2), "b": (3, 30, 0, 20)}
