"""Helpers shared by the operators of this subpackage: bounded batches, freed memory, written tables, components."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import connected_components, forget, fresh_path, shared_dir
from ..operators.iterate import settled as written

_libc = ctypes.CDLL(None)
#: Most bytes and rows of an Arrow batch that goes to a Python worker.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2048
_LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": (BATCH_BYTES, "67108864b"), "spark.sql.execution.arrow.maxRecordsPerBatch": (BATCH_ROWS, "10000")}


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as texts may be long; settings other than Spark's defaults stay."""
    for key, (mine, default) in _LIMITS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, mine)


def one_blas_thread() -> None:
    """Let numpy's matrix products take one thread: a task has one core, and OpenBLAS's threads wait by spinning."""
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:  # no such list on this system: the products take what threads they like
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def release() -> None:
    """Give freed memory back to the system at the end of a task: Python workers live on and work for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of(col: Column) -> Column:
    """CRC-32 of a value as text, as an unsigned long."""
    return F.crc32(col.cast("string").cast("binary"))


__all__ = ["bound_batches", "connected_components", "crc32_of", "forget", "fresh_path", "one_blas_thread", "release", "shared_dir", "table", "written"]
