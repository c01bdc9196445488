"""Session set-up and the shared folder for intermediate data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# What a stream takes along when it starts, whatever store its session keeps state in.
STREAM_DEFAULTS = {
    # a commit uploads what changed, not whole state files
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # counting the rows of the state would read each key once more
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # expired state goes with the next batch that has data
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

# Settings the plans rely on. Broadcast joins are left to the optimizer, which
# only picks one when the (estimated or, under AQE, measured) size is below
# spark.sql.autoBroadcastJoinThreshold.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans are built anew for every micro-batch and every refresh; recording
    # the call site of each column would take longer than planning them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    **STREAM_DEFAULTS,
}


def build_session(app_name: str = "palisade", **conf: str) -> SparkSession:
    """A session with the defaults above; keyword values win, `_` reads as `.`."""
    builder = SparkSession.builder.appName(app_name)
    overrides = {key.replace("_", "."): value for key, value in conf.items()}
    for key, value in {**DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """Streams started within have :data:`STREAM_DEFAULTS`, but for what the session sets itself.

    A stream copies the settings of its session when it starts, so the session
    is left as it was.
    """
    added = [key for key in STREAM_DEFAULTS if spark.conf.get(key, None) is None]
    try:
        for key in added:
            spark.conf.set(key, STREAM_DEFAULTS[key])
        yield
    finally:
        for key in added:
            spark.conf.unset(key)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local session may run without the setting: it gets a temporary
    folder, which is also made its checkpoint folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = configured or spark.sparkContext.getCheckpointDir()
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(
            "spark.checkpoint.dir must name a folder every executor can reach"
        )
    current = tempfile.mkdtemp(prefix="palisade-")
    spark.sparkContext.setCheckpointDir(current)
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
