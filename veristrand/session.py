"""Session settings and the reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for removing a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders written on the way to a result, see ``concluded``.
_way: ContextVar[list[str] | None] = ContextVar("way", default=None)


def local_session(cores: int | str = "*", app: str = "veristrand", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would lose data with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="veristrand-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage on reliable storage, so a lost executor costs no recomputation."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def staged(frame: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder of ``spark.checkpoint.dir`` and read from there.

    What follows starts from the files: a lost executor repeats nothing before them, ids given
    to the rows stay as they are, and Spark knows the table's size. What was shuffled for
    them goes from the executors' disks once they are written.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    if _way.get() is not None:
        _way.get().append(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes the folders of staged tables that nothing reads any more."""
    for frame in frames:
        for folder in {unquote(file.rsplit("/", 1)[0]) for file in frame.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith("staged-"):
                raise ValueError(f"Not a staged table: {folder}")
            _removed(spark, folder)


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def concluded(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, staged; the tables that were staged on the way to it are removed from the shared folder."""
    outer, own = _way.get(), []
    token = _way.set(own)
    try:
        result = staged(make())
    finally:
        _way.reset(token)
    *way, last = own
    for folder in way:
        _removed(spark, folder)
    if outer is not None:
        outer.append(last)
    return result
