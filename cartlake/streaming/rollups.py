"""Metric roll-ups of several grains from stored states that merge.

The state of an interval is (samples, total, maximum). A batch of a stream writes the states of its own events
per minute, whatever their time: nothing is kept in memory between batches, no event is too late, and a batch
that runs again replaces its folder. Coarser grains are merged from the next finer one, never from events.
Rolling up writes all grains as of a batch; a reader takes these and merges the few batches since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.session import run_dir
from cartlake.streaming import versions

#: Each grain is a multiple of the one before.
GRAINS = ("1 minute", "5 minutes", "1 hour", "1 day")
STATE = ["samples", "total", "maximum"]


def minute_states(samples: DataFrame, metric: str, value: str, time: str = "ts", grain: str = GRAINS[0]) -> DataFrame:
    """window_start, metric and the state of every interval with an event; partly aggregated before the shuffle."""
    measured = F.col(value).cast("decimal(38,6)")
    found = samples.where(F.col(time).isNotNull()).groupBy(F.window(time, grain).getField("start").cast("timestamp_ntz").alias("window_start"),
                            F.col(metric).cast("string").alias("metric"))
    return found.agg(F.count(value).alias("samples"), F.sum(measured).cast("decimal(38,6)").alias("total"),
                     F.max(measured).alias("maximum"))


def merged(states: DataFrame, grain: str) -> DataFrame:
    """The states of a coarser grain (or of the same, put together from several batches)."""
    start = F.window("window_start", grain).getField("start").cast("timestamp_ntz")
    return states.groupBy(start.alias("window_start"), "metric").agg(
        F.sum("samples").alias("samples"), F.sum("total").cast("decimal(38,6)").alias("total"), F.max("maximum").alias("maximum"))


STATES = T.StructType([
    T.StructField("window_start", T.TimestampNTZType()), T.StructField("metric", T.StringType()),
    T.StructField("samples", T.LongType()), T.StructField("total", T.DecimalType(38, 6)),
    T.StructField("maximum", T.DecimalType(38, 6))])


def figures(states: DataFrame, grain: str) -> DataFrame:
    """window_start, window_end, metric, samples, average and maximum."""
    end = F.expr(f"window_start + INTERVAL {grain}")
    return states.select(
        "window_start", end.alias("window_end"), "metric", "samples",
        F.try_divide(F.col("total").cast("double"), F.col("samples").cast("double")).alias("average"),
        F.col("maximum").cast("double").alias("maximum"))


def _slot(grain: str) -> str:
    return grain.replace(" ", "-")


def store_states(samples: DataFrame, metric: str, value: str, path: str | None = None, time: str = "ts",
                 full_every: int = versions.FULL_EVERY) -> str:
    """Process all available events of a stream into minute states; returns the folder that ``read_grain`` takes."""
    spark = samples.sparkSession
    path = path or run_dir(spark, "metric-states")

    def write(events: DataFrame, batch: int) -> None:
        versions.write_changes(minute_states(events, metric, value, time), f"{path}/{_slot(GRAINS[0])}", batch)
        if batch % full_every == full_every - 1:
            roll_up(events.sparkSession, path, batch)

    query = (samples.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return path


def roll_up(spark: SparkSession, path: str, batch: int) -> None:
    """Write every grain as of ``batch``, each from the one below; finer folders of batches can go afterwards."""
    states = versions.read_versions(spark, f"{path}/{_slot(GRAINS[0])}", STATES, batch + 1).drop(versions.BATCH)
    for grain in GRAINS:
        folder = f"{path}/{_slot(grain)}"
        versions.write_full(merged(states, grain), folder, batch)
        states = spark.read.schema(STATES).parquet(f"{folder}/full/{versions.BATCH}={batch}")


def read_grain(spark: SparkSession, path: str, grain: str) -> DataFrame:
    """The figures of one grain: what was rolled up, merged with the batches since.

    Of minute states only those since the last roll-up are read.
    """
    finest = f"{path}/{_slot(GRAINS[0])}"
    if grain == GRAINS[0]:
        return figures(merged(versions.read_versions(spark, finest, STATES).drop(versions.BATCH), grain), grain)
    folder = f"{path}/{_slot(grain)}"
    done = versions.full_number(spark, folder)
    rolled = [] if done is None else [f"{folder}/full/{versions.BATCH}={done}"]
    recent = versions.folders_before(spark, finest) if done is None else versions.changes_after(spark, finest, done)
    states = [spark.read.schema(STATES).parquet(*folders) for folders in (rolled, recent) if folders]
    if not states:
        return figures(spark.createDataFrame([], STATES), grain)
    return figures(merged(states[0].unionAll(states[1]) if len(states) > 1 else states[0], grain), grain)
