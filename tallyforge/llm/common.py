"""Shared helpers: the shared scratch folder, Arrow batches in and out, ranks without one task."""

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ARROW = {
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in fields.items())


def arrow_schema(fields: dict[str, str]) -> pa.Schema:
    return pa.schema([(k, ARROW[t]) for k, t in fields.items()])


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, only the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Where that is unset, a local folder serves a local master, as in tests; on a cluster, where
    executors wouldn't see each other's files, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: later jobs neither recompute it nor lose it with an executor.

    For results; it stays until the program ends. What is only needed on the way goes to ``Scratch``.
    """
    path = f"{scratch(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    out = _written(df, path)
    _results.append((df.sparkSession, path))
    return out


_results: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _clear() -> None:
    for spark, path in _results:
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for what a query stores on its way; it goes when the block ends, so return nothing lazy that reads it.

    with Scratch(spark) as kept:
        rows = kept.stored(...)
        return stored(...)
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{scratch(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> "Scratch":
        return self

    def stored(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.path}/{self.count}")

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.path)


_worker: dict = {"owner": None, "cache": {}}


def worker_cache(owner: tuple) -> dict:
    """A dict that a Python worker keeps from task to task, for one operator at a time: another's takes its place, so they don't add up."""
    if _worker["owner"] != owner:
        _worker["cache"].clear()
        _worker.update(owner=owner, cache={})
    return _worker["cache"]


def over_batches(df: DataFrame, fields: dict[str, str], fn) -> DataFrame:
    """``fn`` over Arrow batches, Spark dealing out the rows.

    fn takes {column: list of values} and returns {column: list} or an iterable of those.
    """
    names, schema = df.columns, arrow_schema(fields)

    def run(batches):
        for b in batches:
            out = fn({n: b.column(i).to_pylist() for i, n in enumerate(names)})
            for part in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([pa.array(part[k], schema.field(k).type) for k in fields], schema=schema)

    return df.mapInArrow(run, ddl(fields))


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names."""
    return F.struct(*(df[quoted(c)] for c in df.columns))


def quoted(name: str) -> str:
    """A column's name as Spark reads it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def unpacked(df: DataFrame, struct: str, columns: list[str], fresh: dict[str, Column]) -> DataFrame:
    """The fields of ``struct`` as columns again, those in ``fresh`` by new values."""
    return df.select(*(fresh[c].alias(c) if c in fresh else F.col(struct).getField(c).alias(c) for c in columns))


def joined_with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, how: str = "inner", parts: int = 256) -> DataFrame:
    """``rows`` with the other columns of ``groups``, which has a row a key and in ``weight`` how many of ``rows`` have it; how: inner or left.

    A key with more than one row in ``parts`` is hot. There are fewer than ``parts`` of them, so they are broadcast, and their
    rows go past the shuffle by keys with a salt from all of a row's values; so no task has more of a key than that, whatever
    the planner does. ``groups`` should be stored: it is read three times. Keys aren't null; empty tables are allowed.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * parts > F.lit(total)
    values = [c for c in groups.columns if c != weight and c not in keys]
    hot = groups.where(is_hot).select(*keys, F.struct(*values).alias("_hot"))
    none = F.least(F.col(weight), F.lit(0)).cast("int")  # 0, but no literal, which the optimizer would take out of the join's keys
    rest = groups.where(~is_hot).select(*keys, none.alias("_salt"), F.struct(*values).alias("_rest"))
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) + 1).cast("int")
    out = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(rest, [*keys, "_salt"], "left").withColumn("_value", F.coalesce("_hot", "_rest"))
    if how == "inner":
        out = out.where(F.col("_value").isNotNull())
    return out.select(*rows.columns, "_value.*")


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str, rows_per_bucket: int = 10_000) -> DataFrame:
    """Adds ``name``: gapless numbers from 0 within each key, whatever the size of a key.

    Rows fall by a hash of their order columns into buckets; a bucket is numbered by itself and
    starts where the smaller buckets of its key end. So a key with all rows is numbered by many
    tasks. ``df`` should be stored: it is read three times. Equal rows may swap numbers.
    """
    n = df.count()
    buckets = 1 << max(0, (n // rows_per_bucket).bit_length())
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    each = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = df.withColumn("_own", F.row_number().over(within) - 1)
    return numbered.join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + F.col("_own")).drop("_bucket", "_start", "_own")
