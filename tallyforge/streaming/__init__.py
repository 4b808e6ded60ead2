"""The valuation over a stream of business inputs: an addition, outside what the reference describes."""

from pyspark.sql import DataFrame, SparkSession

from tallyforge.operators import value_businesses
from tallyforge.sources import BUSINESS


def value_stream(spark: SparkSession, path: str, multiples: DataFrame, kind: str = "json") -> DataFrame:
    """A streaming DataFrame of valuations of files that arrive in ``path``; stateless, so append mode works."""
    return value_businesses(spark.readStream.schema(BUSINESS).format(kind).load(path), multiples)
