"""Column expressions of the valuation: all native, all null-propagating."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Half the width of the value range, in multiples.
HALF_RANGE = "0.50"


def ebitda(revenue: Column, operating_expenses: Column) -> Column:
    """Revenue less operating expenses."""
    return (revenue - operating_expenses).cast(MONEY)


def adjusted_ebitda(ebitda_: Column, owner_pay: Column, one_time_costs: Column) -> Column:
    """EBITDA plus both add-backs; a missing add-back leaves it unknown."""
    return (ebitda_ + owner_pay + one_time_costs).cast(MONEY)


def chosen_multiple(starting: Column, override: Column) -> Column:
    """The caller's multiple where given, else the trade's starting one."""
    return F.coalesce(override, starting).cast("decimal(4,2)")


def value(adjusted: Column, multiple: Column, shift: str = "0.00") -> Column:
    """Adjusted EBITDA times the multiple moved by ``shift``."""
    return (adjusted * (multiple + F.lit(shift).cast("decimal(4,2)"))).cast(MONEY)


def ebitda_margin(ebitda_: Column, revenue: Column) -> Column:
    """EBITDA over revenue, to six places; null at zero revenue."""
    return F.round(ebitda_.cast("double") / F.nullif(revenue.cast("double"), F.lit(0.0)), 6)
