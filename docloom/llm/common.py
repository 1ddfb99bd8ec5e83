"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import cut, discard, scratch, shared_folder, table

#: Texts are worked on in slices of at most this many bytes (one row at least).
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to Python, where the session has a larger bound.
BATCH_BYTES = 8 << 20

#: Largest number of rows that any operator here broadcasts; beyond it the same
#: join runs as a shuffle join.
BROADCAST_ROWS = 2_000_000


__all__ = ["BROADCAST_ROWS", "bounded_broadcast", "cut", "discard", "held_out", "id_crc", "map_arrow", "map_texts", "read", "scratch", "settle", "shared_folder", "slices"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(column: str, divisor: int, remainder: int) -> Column:
    """Whether the id falls in the held-out fold; false for a null id."""
    return F.coalesce(id_crc(column) % divisor == remainder, F.lit(False))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more than BROADCAST_ROWS rows (of a few numbers each)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the named text column holds at most limit bytes a slice (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def tidy() -> None:
    """Gives memory that a task has freed back to the system, as Python workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Has the driver let go of what finished plans held, and give the memory back to the system.

    Spark deletes shuffle files and broadcasts only when the driver's garbage is collected, and a driver with room left
    puts that off: between the rounds of an iterative operator its heap and the executors' disks would fill meanwhile.
    """
    gc.collect()  # a plan lives in the JVM as long as Python refers to it
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # not all JVMs have this command
        # The server's own class is hidden, so the method is taken from its interface.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    tidy()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, tidying up behind itself."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, so that a batch of long texts is no larger than one of short ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = re.fullmatch(r"(-?[0-9]+)b?", spark.conf.get(name))
    # A bound with another unit is the user's own.
    if bound and (int(bound[1]) <= 0 or int(bound[1]) > BATCH_BYTES):
        spark.conf.set(name, f"{BATCH_BYTES}b")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with batches of bounded size and memory given back after each task."""
    small_batches(df.sparkSession)
    return df.mapInArrow(tidied(run), schema)


def map_texts(df: DataFrame, schema, func: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], column: str = "text") -> DataFrame:
    """Runs func on slices of df; column names the text that bounds a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield from func(part)

    return map_arrow(df, run, schema)
