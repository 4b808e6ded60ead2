"""Readers for the tables and typed schemas for business inputs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MULTIPLE = T.DecimalType(4, 2)

BUSINESS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("trade", T.StringType()),
        T.StructField("revenue", MONEY),
        T.StructField("operating_expenses", MONEY),
        T.StructField("owner_pay", MONEY),
        T.StructField("one_time_costs", MONEY),
        T.StructField("multiple_override", MULTIPLE),
    ]
)

TRADE_MULTIPLE = T.StructType([T.StructField("trade", T.StringType()), T.StructField("multiple", MULTIPLE)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_businesses(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Business inputs from Parquet, CSV, JSON or ORC, under the fixed schema (never inferred)."""
    return spark.read.format(kind).schema(BUSINESS).options(**options).load(path)
