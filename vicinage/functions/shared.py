"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.RLock()
#: Of each session, how many ``shuffles_dropped`` are open and the setting before the first.
_DROPPING: dict = {}


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session that names none gets a temporary folder: executors of a cluster could not read one of the
    driver's."""
    with _LOCK:
        if spark.sparkContext.getCheckpointDir() is None:
            where = spark.conf.get("spark.checkpoint.dir", "")
            if not where and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="vicinage-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint. It keeps partitions and their order, and the size that Spark estimated for the plan before it."""
    _folder(df.sparkSession)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing will read any more."""
    spark = df.sparkSession
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if found.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a job are deleted when the job ends, not when the driver next collects garbage. Threads may share it."""
    name, key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", id(spark._jsparkSession)
    with _LOCK:
        many, before = _DROPPING.get(key, (0, spark.conf.get(name, None)))
        _DROPPING[key] = many + 1, before
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        with _LOCK:
            many, before = _DROPPING.pop(key)
            if many > 1:
                _DROPPING[key] = many - 1, before
            else:
                spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def at_once(spark: SparkSession, f: Callable, over: Iterable, most: int = 4) -> list:
    """f of each, in the given order, some at a time: jobs of small tables mostly wait for the driver."""
    over = list(over)
    if len(over) < 2:
        return [f(x) for x in over]
    with ThreadPoolExecutor(min(most, len(over))) as pool:
        return [w.result() for w in [pool.submit(inheritable_thread_target(spark)(f), x) for x in over]]


def written(df: DataFrame) -> DataFrame:
    """The rows from files beside the checkpoints, with the files' size. Spark takes a join for as large as the product of its sides and a
    checkpoint for as large as its plan, so where checkpoints are joined round after round the digits of that number double each time, and
    planning comes to do nothing but multiply them. Partitions and order are not kept."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged_batches(parts: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches of about so many bytes, as each batch costs time on its way out of a task."""
    held, have = [], 0
    for part in parts:
        held.append(part)
        have += part.nbytes + 64
        if have >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, have = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def numbered(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """The rows with their number by ``key``, from 1, and written: ranges of the key are sorted in tasks of their own, and only the
    number of rows of each range goes through the driver."""
    rows = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    part, before, offsets = F.shiftright("__at", 33), 0, []
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    first = df.sparkSession.createDataFrame(offsets, "__part long, __first long")
    found = rows.withColumn("__part", part).join(F.broadcast(first), "__part")
    return found.withColumn(name, F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__first")
