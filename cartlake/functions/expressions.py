"""Column expressions shared by the business queries. All of them stay inside codegen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# File naming of exported text.
DEFAULT_NAME_PREFIX = "hello_world_"
TEXT_SUFFIX = ".txt"
STAMP_FORMAT = "%Y%m%d_%H%M%S"

CSV_NULL = "\\N"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating-point quotient; NULL instead of an error for an empty group."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(F.lit(100.0).cast("double") * part, whole)


def mean(column: str | Column) -> Column:
    """Average as double from an exact sum, so that decimals do not lose digits on the way."""
    return ratio(F.sum(column), F.count(column))


def line_revenue() -> Column:
    return F.col("quantity") * F.col("unit_price")


def month_of(date: str | Column) -> Column:
    """First day of the month, as a DATE (independent of the session time zone)."""
    return F.trunc(date, "MM")


def previous_month(month: str | Column) -> Column:
    return F.add_months(month, -1)


def order_frequency_segment(order_count: Column) -> Column:
    # The published segment names and bounds.
    return (
        F.when(order_count >= 10, F.lit("High Frequency"))
        .when(order_count >= 5, F.lit("Medium Frequency"))
        .otherwise(F.lit("Low Frequency"))
    )


def text_file_name(name: Column, now: datetime) -> Column:
    """The given name, or a time-stamped one where it is missing; always with the text suffix."""
    default = F.lit(DEFAULT_NAME_PREFIX + now.strftime(STAMP_FORMAT))
    chosen = F.when(name.isNull() | (name == ""), default).otherwise(name)
    return F.when(chosen.endswith(TEXT_SUFFIX), chosen).otherwise(F.concat(chosen, F.lit(TEXT_SUFFIX)))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def escape_lines(text: Column) -> Column:
    """The text on one line: backslashes doubled, line breaks as backslash and letter."""
    once = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(once, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape_lines(text: Column) -> Column:
    """The inverse of ``escape_lines``. Between doubled backslashes the single ones are unambiguous."""
    parts = F.transform(F.split(text, r"\\\\"), lambda part: F.replace(
        F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(parts, "\\")
