"""Helpers shared by the training-data operators: shared storage, Arrow mapping, id hashing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes after which an Arrow batch ends, so that long texts don't meet in one batch.
BATCH_ROWS, BATCH_BYTES = 1024, 16_000_000


def with_checkpoints(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder: the cluster's spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
    elif sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoints-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    with_checkpoints(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when the driver's JVM collects them, which a small driver of many plans hardly does by itself."""
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_AT_EXIT: list[Callable[[], object]] = []


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when this Python process ends: results that are still to be read come from it."""
    if not _AT_EXIT:
        atexit.register(remove_all)
    place, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    _AT_EXIT.append(lambda: place.getFileSystem(conf).delete(place, True))


def remove_all() -> None:
    """Delete what remove_at_exit() has been told of. A JVM that is gone already can't; what it has left stays."""
    while _AT_EXIT:
        with contextlib.suppress(Py4JError, OSError):
            _AT_EXIT.pop()()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session end at BATCH_ROWS rows or BATCH_BYTES bytes. It is the session's setting, as plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What empties a module's caches in this Python worker, and the module whose work it does now.
_CACHES: dict[str, Callable[[], object]] = {}
_AT_WORK = [""]


def has_caches(module: str, empty: Callable[[], object]) -> None:
    """empty() frees the module's caches when the worker goes over to another module's work."""
    _CACHES[module] = empty


def at_work(module: str) -> None:
    """A worker that goes over to another operator drops the caches of those before, so that they don't add up."""
    if _AT_WORK[0] != module:
        for name, empty in _CACHES.items():
            if name != module:
                empty()
        _AT_WORK[0] = module


def map_arrow(df: DataFrame, of: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema) -> DataFrame:
    """mapInArrow with batches of bounded rows; of() gets a batch and returns one batch, or yields several."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work(of.__module__)
        for batch in batches:
            got = of(batch)
            if got is None:
                continue
            if isinstance(got, pa.RecordBatch):
                yield got
            else:
                yield from got

    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
