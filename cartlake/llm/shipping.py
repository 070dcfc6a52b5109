"""Broadcast of objects whose classes the executors cannot import."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function for use inside tasks that gives ``value``; only for values of a fixed, small size."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)
