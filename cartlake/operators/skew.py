"""Hot keys: finding them with a sketch, and joins that split them over many tasks.

A key is hot when it has more rows than half of what a task should get. Only the rows of hot keys get a
salt, a number below the key's pieces, and only the other side's rows of these keys are repeated, once
per piece; all other rows are joined as they are. The salt is a hash of the whole row, so a task that runs
again deals the same rows to the same pieces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A hot key is cut into pieces of this share of what a task should get.
PIECE_SHARE = 0.25
#: The sketch follows so many items for every one that can be hot; its error is then far below their counts.
TRACKED_PER_HOT = 16
SALT = "_salt"


@dataclass(frozen=True)
class HotKeys:
    """Hot values of a column with their number of pieces; NULL may be one of them."""

    pieces: dict[Any, int]
    kind: T.DataType

    @property
    def values(self) -> list:
        return [v for v in self.pieces if v is not None]

    @property
    def total(self) -> int:
        return sum(self.pieces.values())

    def holds(self, key: Column) -> Column:
        """Whether the key is hot; never NULL."""
        known = F.coalesce(key.isin(self.values), F.lit(False)) if self.values else F.lit(False)
        return known | key.isNull() if None in self.pieces else known

    def holds_in_any_bucket(self, key: Column) -> Column:
        """The same in a form from which Spark takes no choice of buckets, so that files are cut by size."""
        return self.holds(key) | (F.size(F.array_compact(F.array(key))) > 1)

    def misses(self, key: Column) -> Column:
        """Whether the key is not hot; never NULL, and in a form that skips files of hot keys only."""
        other = key.isNotNull() if None in self.pieces else F.lit(True)
        return other & (key.isNull() | ~key.isin(self.values)) if self.values else other

    def pieces_of(self, key: Column) -> Column:
        """The pieces of a key, 1 where it is not hot."""
        if not self.values:
            return F.when(key.isNull(), F.lit(self.pieces.get(None, 1))).otherwise(1)
        known = F.create_map(*(F.lit(x) for v in self.values for x in (F.lit(v).cast(self.kind), self.pieces[v])))
        return F.when(key.isNull(), F.lit(self.pieces.get(None, 1))).when(
            key.isin(self.values), known[key]).otherwise(1)

    def table(self, df: DataFrame) -> DataFrame:
        """(_key, _pieces) of the values; at most two rows per task."""
        schema = T.StructType([T.StructField("_key", self.kind), T.StructField("_pieces", T.IntegerType())])
        return df.sparkSession.createDataFrame([(v, self.pieces[v]) for v in self.values], schema)


def task_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, tasks: int | None = None) -> HotKeys:
    """Values of ``key`` with more than half of a task's fair share of the rows.

    One pass over one column with a frequent-items sketch per task, merged into one; the sketch and the
    at most 2 * ``tasks`` values that come back do not grow with the table.
    """
    tasks = tasks or task_count(df)
    most = 2 * tasks
    tracked = min(1_000_000, max(1024, TRACKED_PER_HOT * most))
    found = df.select(F.col(key).alias("k")).agg(
        F.expr(f"approx_top_k(k, {most}, {tracked})").alias("top"), F.count("*").alias("n")).first()
    fair = found["n"] / tasks
    return HotKeys({r["item"]: math.ceil(r["count"] / (fair * PIECE_SHARE)) for r in found["top"] or []
                    if r["count"] > fair / 2}, df.schema[key].dataType)


def _salt(df: DataFrame, pieces: Column) -> Column:
    hashed = [f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, T.MapType)]
    return F.pmod(F.xxhash64(*hashed), pieces.cast("long")).cast("int")


def salted(df: DataFrame, key: str, hot: HotKeys) -> DataFrame:
    """``df`` with the salt of each row: 0 but for hot keys."""
    if not hot.pieces:
        return df.withColumn(SALT, F.lit(0))
    return df.select("*", _salt(df, hot.pieces_of(F.col(key))).alias(SALT))


def repeated_for_salts(df: DataFrame, key: str, hot: HotKeys) -> DataFrame:
    """``df`` with one row for each salt that its key can have; NULL keys meet nothing and are not repeated."""
    if not hot.pieces:
        return df.withColumn(SALT, F.lit(0))
    if not hot.values:  # 0, but not as a literal: Spark would leave it out of the shuffle, which then splits no NULLs
        return df.withColumn(SALT, _salt(df.select(key), F.lit(1)))
    with_pieces = df.join(F.broadcast(hot.table(df)), F.col(key) == F.col("_key"), "left")
    return with_pieces.select(*df.columns, F.explode(F.sequence(
        F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)).alias(SALT))


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", tasks: int | None = None,
                hot: HotKeys | None = None) -> DataFrame:
    """Join on one column in which hot keys of ``left`` are split over several tasks; rows as of a plain join.

    For joins that keep rows of the left side only: inner, left, left_semi, left_anti. Where the right side
    is small enough to be broadcast, Spark does so and the salts cost nothing but their computation.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would return the repeated rows of the right side")
    hot = hot or hot_keys(left, on, tasks)
    return salted(left, on, hot).join(repeated_for_salts(right, on, hot), [on, SALT], how).drop(SALT)


def bucketed_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", tasks: int | None = None,
                  hot: HotKeys | None = None) -> DataFrame:
    """The same for two tables that are bucketed by ``on``: buckets meet without a shuffle, but for hot keys.

    A bucket is one task, so rows of hot keys are read apart and joined by salt. The filter of all other rows
    skips the files of hot keys; that of the hot rows names no bucket and no join lies between it and the
    shuffle, so Spark cuts the files by size instead of giving a bucket with a whole hot key to one task.
    """
    hot = hot or hot_keys(left, on, tasks)
    if not hot.pieces:
        return left.join(right, on, how)
    rest = left.where(hot.misses(F.col(on))).join(right, on, how)
    split = salted_join(left.where(hot.holds_in_any_bucket(F.col(on))), right.where(hot.holds(F.col(on))), on, how, hot=hot)
    return rest.unionByName(split)


def dealt_to_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` dealt out for writing ``buckets`` buckets: one task each, and further ones for pieces of hot keys.

    A hot key's pieces become files of their own in its bucket.
    """
    hot = hot_keys(df, key, buckets)
    if not hot.pieces:
        return df.repartition(buckets, key)
    parts = [df.where(hot.misses(F.col(key))).repartition(buckets, key),
             salted(df.where(hot.holds(F.col(key))), key, hot).repartition(min(hot.total, 2 * buckets), key, SALT).drop(SALT)]
    return reduce(DataFrame.unionByName, parts)
