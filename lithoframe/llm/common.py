"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
HOT = 1024  # a key is hot if it has more than this part of all rows, so fewer keys than that are


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recounted(docs: DataFrame) -> DataFrame:
    """Documents whose texts have changed, with n_chars, where there is one, set anew."""
    return docs.withColumns({"n_chars": F.length("text").cast("bigint")} if "n_chars" in docs.columns else {})


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. Only a local master, as in tests, gets a temporary one where none is named."""
    context = spark.sparkContext
    if found := context.getConf().get(CHECKPOINT_KEY):
        return found.rstrip("/")
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lithoframe-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder: later work starts there, also after an executor is lost.

    Spark removes the files once nothing refers to them (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def freed(run: Callable, *forget: Callable[[], None]) -> Callable:
    """run, for mapInArrow, with its memory given back when a task ends: Python workers live on, beside all that later stages take.

    forget: functions that empty the memos that run fills.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return task


def give_back() -> None:
    """Free memory goes to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hot_keys(counts: DataFrame, total: int) -> list[tuple]:
    """counts(key, n, ...) of at most total rows -> (key, tasks that its rows are spread over, ...), fewer than HOT of them, for met()."""
    limit = max(1, -(-total // HOT))
    return [(r[0], -(-r[1] // limit), *r[2:]) for r in counts.where(F.col(counts.columns[1]) > limit).collect()]


def met(rows: DataFrame, keyed: DataFrame, key: str, hot: list[tuple[int, int]], by: list[str]) -> DataFrame:
    """The inner join of rows with keyed, one row a key, where no task gets all rows of a hot key: they are spread by a hash of `by`."""
    if not hot:
        return rows.join(keyed, key)
    salts = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} bigint, __salts bigint"))  # fewer than HOT rows
    one = F.coalesce("__salts", F.lit(1))
    left = rows.join(salts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), one)).drop("__salts")
    right = keyed.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1))).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")
