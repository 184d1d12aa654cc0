"""Datasets that many queries read: bars, costs, the path, features. Each is built once for a state of its source and kept.

A dataset is known by its name, its folder and the files of the source table (path, size, time of change), so changed
files make a new version; within an application all queries read the same written one. Versions lie in the scratch
folder (spark.checkpoint.dir) and end with it.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.manifest import staged

_kept: dict[tuple, DataFrame] = {}
_locks: dict[tuple, threading.RLock] = {}
_guard = threading.Lock()


def state_of(spark: SparkSession, path: str) -> tuple:
    """What a table's files are: path, bytes and time of change of each, as the file system lists them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = fs.listStatus(place)  # of a file: itself
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in listed))


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], source: str = "events") -> DataFrame:
    """The dataset ``name`` of a folder: written by the first who asks, read by all others while the source is as it was."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _guard:
        lock = _locks.setdefault(key, threading.RLock())
    with lock:
        state = state_of(spark, f"{sf_dir}/{source}.parquet")
        if (*key, state) not in _kept:
            _kept[(*key, state)] = staged(build(), name)
        return _kept[(*key, state)]
