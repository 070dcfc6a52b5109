"""Rows in the order of a space-filling curve, so that predicates on each of several columns skip files.

Each column's values are cut into ranges of about equally many rows; the bits of the range numbers,
interleaved, are a row's place on the curve. Neighbours on the curve are near in all columns, so every row
group covers a small part of each.
"""

from __future__ import annotations

from functools import reduce
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges per column, as a power of two; their bounds come back to the driver.
BITS = 8
QUANTILE_ACCURACY = 10_000
PLACE = "_place"


def as_number(df: DataFrame, column: str) -> Column:
    """A double in the order of the column's values; of texts the first six bytes count. NULL is NaN."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif isinstance(kind, T.TimestampNTZType):
        value = F.unix_micros(value.cast("timestamp"))
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, T.StringType):
        value = F.conv(F.rpad(F.substring(F.hex(value), 1, 12), 12, "0"), 16, 10)
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


def ranges(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list[float]]:
    """Bounds that cut each column into at most 2^bits ranges, from one pass with quantile sketches."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.select([F.nanvl(as_number(df, c), F.lit(None)).alias(c) for c in columns]).agg(*[
        F.percentile_approx(f"`{c}`", shares, QUANTILE_ACCURACY).alias(c) for c in columns]).first()
    return {c: sorted({b for b in found[c] or [] if isfinite(b)}) for c in columns}


def interleaved(numbers: list[Column], bits: int) -> Column:
    """The bits of several numbers in turn, the highest ones first."""
    n = len(numbers)
    parts = [F.shiftleft(F.shiftright(number, bit).bitwiseAND(F.lit(1).cast("long")), bit * n + n - 1 - i)
             for i, number in enumerate(numbers) for bit in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def with_place(df: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """``df`` with each row's place on the curve; NULLs have a range of their own, the last one."""
    bounds, numbers = ranges(df, columns, bits), []
    for i, c in enumerate(columns):
        if not bounds[c]:  # no value at all
            numbers.append(F.lit(0).cast("long"))
            continue
        # A range ends below its bound, so a value with many rows is one range.
        splits = [float("-inf"), *bounds[c], float("inf")]
        df = Bucketizer(splits=splits, inputCol=f"_n{i}", outputCol=f"_r{i}", handleInvalid="keep").transform(
            df.withColumn(f"_n{i}", as_number(df, c)))
        numbers.append(F.col(f"_r{i}").cast("long"))
    place = interleaved(numbers, bits + 1)  # one more for NULL
    return df.withColumn(PLACE, place).drop(*[f"_{k}{i}" for k in "nr" for i in range(len(columns))])


def clustered(df: DataFrame, columns: list[str], partitions: int, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in ``partitions`` ranges of the curve, sorted along it (inside each value of ``within``).

    Rows of one place are spread by a hash of the row, so a place with very many rows is not one task.
    """
    hashed = [f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, T.MapType)]
    placed = with_place(df, columns)
    keys = [*within, PLACE]
    return placed.repartitionByRange(partitions, *keys, F.xxhash64(*hashed)).sortWithinPartitions(*keys).drop(PLACE)
