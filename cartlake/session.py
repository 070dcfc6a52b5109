"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

ADVISORY_PARTITION_BYTES = 128 * 1024 * 1024


def build_session(app_name: str = "cartlake", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(ADVISORY_PARTITION_BYTES))
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent, a folder given to ``SparkContext.setCheckpointDir`` counts. There is no
    other fallback: a machine-local folder would be invisible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured.rstrip("/")


def _work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cartlake/{spark.sparkContext.applicationId}"


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so no run can clobber another."""
    return f"{_work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_run_dirs(spark: SparkSession) -> bool:
    """Delete all working folders of this application; call it when no result of it is needed any more.

    Folders of applications that ended without doing so carry their id and can be deleted the same way.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_work_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def session_with(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """``spark`` if it has these settings, or else a session of its own that also has them; the given one stays as it is."""
    given = spark.conf.getAll
    if settings.items() <= given.items():
        return spark
    own = spark.newSession()
    fresh = own.conf.getAll
    for key, value in {**given, **settings}.items():
        if fresh.get(key) != value and own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own
