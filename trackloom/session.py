"""Session helpers: settings the operators rely on and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trackloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, AQE and Arrow on; other settings stay the cluster's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # files go with the last reference to them
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to /tmp only for a local master."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, reachable from every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are planned and run inside go when the query ends.

    Otherwise they stay until the driver happens to collect its garbage, and the steps of an iteration pile up.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so an iterative plan neither grows nor recomputes, nor leaves shuffle files behind."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, which nothing else runs again


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Deal rows evenly over four tasks a core, or ``least`` if more, before a step that costs much for each row.

    A small file has few row groups, and their number, not the cluster's, is otherwise the number of tasks.
    The count is stated, so adaptive execution does not merge the partitions again for being small.
    """
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, least), *keys)
