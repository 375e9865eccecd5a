"""Columns with the dialect's semantics where Spark's differ.

Everything is an expression of built-in functions, so it stays in generated code, is pushed down like
any other expression, and aggregates keep their partial step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a: Column | str, b: Column | str) -> Column:
    """Integer division: truncates, and is NULL for a zero divisor."""
    a, b = _col(a).cast("bigint"), _col(b).cast("bigint")
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))


def divide(a: Column | str, b: Column | str) -> Column:
    """Division of floats and decimals: NULL for a zero divisor."""
    return F.try_divide(_col(a), _col(b))


def modulo(a: Column | str, b: Column | str) -> Column:
    return _col(a) % _col(b)


def as_bool(c: Column | str) -> Column:
    """Numbers in logical places: anything but 0 is true."""
    return _col(c) != 0


def as_int(c: Column | str) -> Column:
    """Booleans as the numbers 1 and 0."""
    return _col(c).cast("bigint")


def number_of(c: Column | str) -> Column:
    """Text in numeric aggregates: its trimmed number, else 0; NULL stays NULL."""
    c = _col(c)
    return F.when(c.isNotNull(), F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0)))


def total(c: Column | str) -> Column:
    """SUM as a double that is 0.0 on no rows."""
    return F.coalesce(F.sum(_col(c).cast("double")), F.lit(0.0))


def total_distinct(c: Column | str) -> Column:
    return F.coalesce(F.sum_distinct(_col(c).cast("double")), F.lit(0.0))


def sum_text(c: Column | str) -> Column:
    return F.sum(number_of(c))


def avg_decimal(c: Column | str, precision: int, scale: int) -> Column:
    """AVG that keeps a decimal's type, rounding half away from zero."""
    wide = F.sum(_col(c).cast(f"decimal({min(38, precision + 10)},{scale})"))
    return F.round(F.try_divide(wide, F.count(_col(c)).cast("decimal(20,0)")), scale).cast(f"decimal({precision},{scale})")


def sum_decimal(c: Column | str, precision: int, scale: int) -> Column:
    """SUM that keeps a decimal's type; too large a sum is an error."""
    return F.sum(_col(c)).cast(f"decimal({precision},{scale})")


def count_nulls(c: Column | str) -> Column:
    return F.count_if(_col(c).isNull())


def group_concat(c: Column | str, separator: str = ",", distinct: bool = False) -> Column:
    """Values joined in their order; NULLs are skipped and none gives NULL.

    The order is that of the values, as rows of a distributed table have none.  A group's values come
    together in one row of the result, whatever computes it, so it is as long as its group.
    """
    c = _col(c).cast("string")
    values = F.array_sort(F.collect_set(c) if distinct else F.collect_list(c))
    return F.when(F.size(values) > 0, F.array_join(values, separator))


def in_empty(negated: bool = False) -> Column:
    """``x IN ()``: false, and true negated, also for NULL."""
    return F.lit(negated)


def order(c: Column | str, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """Sort keys: NULLs last ascending and first descending unless said otherwise."""
    c = _col(c)
    first = descending if nulls_first is None else nulls_first
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def add_interval(date: Column | str, months: int = 0, days: int = 0) -> Column:
    """Date plus months, clamped to the month's end, and then days; a date."""
    return F.date_add(F.add_months(_col(date).cast("date"), months), days)


def date_diff(a: Column | str, b: Column | str) -> Column:
    """Days between two dates."""
    return F.datediff(_col(a), _col(b)).cast("bigint")
