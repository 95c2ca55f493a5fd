"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN = "opsboard.shared.dir"
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; a local session may do without.

    A folder that only ``setCheckpointDir`` names will do unless it lies on the driver's own disk.
    """
    context = spark.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
        if folder is not None and folder.startswith("file:") and not local:
            folder = None
    if folder is None:
        if not local:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get(_OWN, None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="opsboard-")
            spark.conf.set(_OWN, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whatever executors are lost later."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Within it, what a write shuffled leaves the disks when the write ends; else it would stay there until the
    driver next collects garbage, which a driver with memory to spare may not do before the job is over."""
    before = spark.conf.get(_LET_GO, None)
    spark.conf.set(_LET_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LET_GO)
        else:
            spark.conf.set(_LET_GO, before)


def table_or_empty(spark: SparkSession, path: str, struct: T.StructType) -> DataFrame:
    """The parquet table at ``path``; without rows while there is none."""
    try:
        return spark.read.schema(struct).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], struct)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of a table that this library wrote, on whatever store it lies."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
