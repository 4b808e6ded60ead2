"""DataFrame operators of the valuation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import functions as V

#: Rows of a multiples table that are still broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def with_starting_multiple(businesses: DataFrame, multiples: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of the trade's starting multiple.

    A trade that isn't listed, or null, gets a null multiple. A trade listed twice takes its
    smallest multiple, so no business is ever doubled. The lookup is broadcast only after a
    count of at most ``broadcast_rows`` + 1 rows, a small job run while the plan is made, shows that it is small.
    """
    lookup = multiples.groupBy("trade").agg(F.min("multiple").alias("multiple"))
    small = multiples.limit(broadcast_rows + 1).count() <= broadcast_rows
    return businesses.drop("multiple").join(F.broadcast(lookup) if small else lookup, "trade", "left")


def with_earnings(businesses: DataFrame) -> DataFrame:
    """Adds ``ebitda`` and ``adjusted_ebitda``."""
    out = businesses.withColumn("ebitda", V.ebitda(F.col("revenue"), F.col("operating_expenses")))
    return out.withColumn("adjusted_ebitda", V.adjusted_ebitda(F.col("ebitda"), F.col("owner_pay"), F.col("one_time_costs")))


def value_businesses(businesses: DataFrame, multiples: DataFrame) -> DataFrame:
    """The whole valuation, one row per business, with no shuffle of the businesses.

    Nulls propagate: a blank add-back gives a null value, an unlisted trade a null multiple.
    With negative adjusted EBITDA ``value_low`` exceeds ``value_high``, as the formula has it.
    """
    rows = with_earnings(with_starting_multiple(businesses, multiples))
    rows = rows.withColumn("multiple", V.chosen_multiple(F.col("multiple"), F.col("multiple_override")))
    adjusted, multiple = F.col("adjusted_ebitda"), F.col("multiple")
    return rows.select(
        "id",
        "ebitda",
        "adjusted_ebitda",
        "multiple",
        V.value(adjusted, multiple).alias("value_mid"),
        V.value(adjusted, multiple, f"-{V.HALF_RANGE}").alias("value_low"),
        V.value(adjusted, multiple, V.HALF_RANGE).alias("value_high"),
        V.ebitda_margin(F.col("ebitda"), F.col("revenue")).alias("ebitda_margin"),
    )
