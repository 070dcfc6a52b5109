"""Foreign keys of new rows: a stored Bloom filter of the parent keys says which few need an exact look.

The filter is a table of bitmaps, built and asked with built-in functions only. A key sets PROBES bits. A key
with a bit that is not set has no parent for certain; of the keys whose bits are all set a small share has
none either, so these are compared with the parents themselves. New parent keys are added by uniting
bitmaps, without a scan of the old ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a key sets, and bits per key of the filter: about 0.24 % of foreign keys without a parent pass it.
PROBES = 4
BITS_PER_KEY = 16
#: Bits of one bitmap, as the built-in functions have them.
BITMAP_BITS = 32768


def filter_bits(keys: int) -> int:
    """Size of a filter for so many keys, a whole number of bitmaps; keep it for all later additions."""
    return max(1, math.ceil(keys * BITS_PER_KEY / BITMAP_BITS)) * BITMAP_BITS


def error_rate(keys: int, bits: int) -> float:
    """Share of absent keys that pass a filter with so many keys."""
    return (1 - math.exp(-PROBES * keys / bits)) ** PROBES


def _places(key: Column, bits: int) -> Column:
    """The bits of a key, the first being 1 as in the built-in functions."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(bits).cast("long")) + 1 for probe in range(PROBES)])


def key_filter(parents: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, bits) of the parents' keys. At most bits / 8 bytes, however many parents there are."""
    places = parents.where(F.col(key).isNotNull()).select(F.explode(_places(F.col(key), bits)).alias("place"))
    return places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def united(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of several filters of one size."""
    rows = filters[0]
    for other in filters[1:]:
        rows = rows.unionAll(other)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def without_parent(keys: DataFrame, key: str, filter_: DataFrame, bits: int) -> DataFrame:
    """``keys`` (distinct) with ``absent``: True where the filter proves that there is no parent."""
    placed = keys.select(F.col(key), F.explode(_places(F.col(key), bits)).alias("place"))
    asked = placed.withColumn("bucket", F.bitmap_bucket_number("place")).join(filter_, "bucket", "left")
    found = _is_set(F.col("bits"), F.bitmap_bit_position("place"))
    return asked.groupBy(key).agg((~F.bool_and(found)).alias("absent"))


def new_orphans(new_rows: DataFrame, column: str, parents: DataFrame, key: str, filter_: DataFrame, bits: int) -> DataFrame:
    """(column, occurrences) of the foreign keys in ``new_rows`` without a parent, exactly.

    New rows are counted per key first, so a hot key is one row. Keys that the filter proves absent are
    orphans; the parents are asked only for the others, and their side of that join is a scan of one column
    against the new rows' few keys, never a shuffle of new rows.
    """
    counted = new_rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("occurrences"))
    judged = counted.join(without_parent(counted.select(column), column, filter_, bits), column)
    passed = judged.where(~F.col("absent")).select(column, "occurrences")
    exact = passed.join(parents.select(F.col(key).alias(column)), column, "left_anti")
    return judged.where("absent").select(column, "occurrences").unionByName(exact)
