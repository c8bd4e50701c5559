"""Shared tables of a job: where they lie, how they are written and dropped."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are broadcast up to so many rows (8 bytes each); beyond that a shuffled join takes their place.
BROADCAST_IDS = 1_000_000
#: So for rows of several numbers.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session that names none gets a temporary one: executors of a
    cluster could not read one of the driver's."""
    where = spark.conf.get("spark.checkpoint.dir", "")
    if not where and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="vicinage-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, reread, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, through the file system of their path."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small or iterated table."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of a job are deleted when the job ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it is proven to have no more than so many rows; else joins shuffle."""
    few = len(df.limit(rows + 1).groupBy().count().filter(f"count <= {rows}").take(1)) == 1
    return F.broadcast(df) if few else df


def only_ids(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (or with left_anti is not) among ``ids``, without a shuffle of ``df`` while the ids are few."""
    return df.join(small(ids, BROADCAST_IDS), key, how)
