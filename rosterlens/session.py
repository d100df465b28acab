"""Session defaults and lineage cutting.

Iterative operators cut their lineage by writing a table into the cluster's shared
checkpoint folder (``spark.checkpoint.dir``). A written table survives the loss of
executors, is columnar, and gives the planner a real size for its join choices.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "rosterlens", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    return _own_root()


@functools.cache
def _own_root() -> str:
    """A folder of this process, for sessions without executors and without the setting."""
    return tempfile.mkdtemp(prefix="rosterlens-")


def app_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; ``drop_stages`` deletes it."""
    return f"{stage_root(spark)}/rosterlens/{spark.sparkContext.applicationId}"


def drop(df: DataFrame) -> None:
    """Delete the table behind a staged DataFrame that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, label: str, reader: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back, in the ``reader`` session if given."""
    spark = reader or df.sparkSession
    path = f"{app_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if (inside := getattr(_scope, "paths", None)) is not None:
        inside.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scope = threading.local()


@contextlib.contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that this thread stages inside, at the end: for jobs that repeat in one application, such as batches of a stream."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, outer
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even work for a step that makes many rows of each row: as many parts as a shuffle has.

    The plain shuffle would be merged by its small input size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(app_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
