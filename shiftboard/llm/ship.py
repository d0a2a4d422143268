"""Python steps on executors, which need this package there."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import words

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per session.

    Spark's own file transfer carries them; the archive on the driver is not read by anything else.
    """
    sc = spark.sparkContext
    if getattr(sc, "_text_package_sent", False):
        return
    above = os.path.dirname(PACKAGE)
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(PACKAGE)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, above))
    sc.addPyFile(archive)
    sc._text_package_sent = True


_RESIDENT: dict[str, Any] = {}


def resident(key: str, build: Callable[[], Any]) -> Any:
    """A large object that a worker process keeps from task to task: one at a time."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        release()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def release() -> None:
    """Give memory that earlier steps used in this worker process back to the system."""
    words.clear_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed arrays otherwise
    if trim:
        trim(0)


def forget() -> None:
    """Free what an earlier operator's tasks left in this worker process."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()


def map_arrow(d: DataFrame, step: Callable, schema: str | StructType, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with this package at hand on every executor.

    ``keeps``: the step uses ``resident``.  Workers serve many operators in turn, so any other step frees it first.
    """
    package(d.sparkSession)
    if keeps:
        return d.mapInArrow(step, schema)

    def alone(batches: Iterator) -> Iterator:
        forget()
        yield from step(batches)

    return d.mapInArrow(alone, schema)
