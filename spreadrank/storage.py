"""Intermediate tables on shared storage.

Loops cut their lineage by writing a table and reading it back, so a lost executor costs the
re-read of a file and not a recomputation of all earlier rounds.
"""

from __future__ import annotations

import hashlib
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Where nothing is set, a session whose executors are threads of its own process gets a folder of its own;
    any other is refused, because a folder on one machine would not be visible to the executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="spreadrank-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_scratch: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    base = _scratch[-1] if _scratch else f"{work_dir(spark)}/spreadrank"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the table read back."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Partitions of about 128 MB, and enough of them to keep the cores busy on middling data. For
    layouts that no result depends on."""
    by_size = math.ceil(rows * row_bytes / (128 << 20))
    by_cores = min(spark.sparkContext.defaultParallelism, math.ceil(rows / 20_000))
    return max(1, by_size, by_cores)


def fixed_plans(spark: SparkSession) -> SparkSession:
    """A session like the caller's whose plans are fixed up front, since only they keep a layout.

    Tables written by one session are read by the other; the caller's settings stay as they are.
    """
    fixed = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and fixed.conf.isModifiable(key):
            fixed.conf.set(key, value)
    fixed.conf.set("spark.sql.adaptive.enabled", "false")
    return fixed


def checkpoint_hashed(df: DataFrame, parts: int, keys: list[str]) -> DataFrame:
    """Checkpoint ``df``, of a ``fixed_plans`` session, hashed and sorted by ``keys``. Joins on ``keys`` then neither
    shuffle nor sort this side again."""
    work_dir(df.sparkSession)
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).checkpoint()


def checkpoint_grouped(df: DataFrame, parts: int, keys: list[str], groups: list[str], value: str) -> DataFrame:
    """Collect ``value`` per ``groups`` (which begin with ``keys``) into the array ``entries``, and
    checkpoint the result as ``checkpoint_hashed`` does.

    The result is also cached; what an executor takes with it is read from the checkpoint again. The
    caller unpersists it.
    """
    work_dir(df.sparkSession)
    grouped = (
        df.repartition(parts, *keys).groupBy(*groups).agg(F.collect_list(value).alias("entries")).select(*keys, "entries")
    )
    return grouped.sortWithinPartitions(*keys).checkpoint().persist()


def _files(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace the table at ``path`` by what ``write`` writes to the folder it is given.

    The new table is written whole beside the old one, which stays readable until then; two renames put it in its place. A
    write that fails leaves the old table. If the process ends between the renames, the old table is put
    back by the next ``publish`` to the path.
    """
    path = path.rstrip("/")
    parent, _, name = path.rpartition("/")
    target, files = _files(spark, path)
    old, _ = _files(spark, f"{parent}/_{name}.old")
    if files.exists(old):
        if files.exists(target):
            files.delete(old, True)
        elif not files.rename(old, target):
            raise OSError(f"could not put {old} back")
    fresh = f"{parent}/_{name}.{uuid.uuid4().hex}"
    made, _ = _files(spark, fresh)
    try:
        write(fresh)
        if files.exists(target) and not files.rename(target, old):
            raise OSError(f"could not move {path} away")
        if not files.rename(made, target):
            files.rename(old, target)
            raise OSError(f"could not move {fresh} to {path}")
    finally:
        files.delete(made, True)
    files.delete(old, True)


class Ledger:
    """Finished stages of a run in a folder of their own, keyed by the input's files and the settings. A later run with the same
    key takes up what is there; a stage counts as finished once its table is whole."""

    def __init__(self, spark: SparkSession, source: str, settings: object):
        self.spark = spark
        where, files = _files(spark, source)
        listed = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.globStatus(where) or [])
        inside = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(where))
        key = hashlib.sha256(repr((listed, inside, settings)).encode()).hexdigest()[:32]
        self.folder = f"{work_dir(spark)}/spreadrank/ledger-{key}"

    def stage(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            made = make()
            made.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def close(self) -> None:
        where, files = _files(self.spark, self.folder)
        files.delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the intermediate tables written inside, deleted at the end with all of them.
    Results must have been written elsewhere by then."""
    folder = f"{work_dir(spark)}/spreadrank/run-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        where, files = _files(spark, folder)
        files.delete(where, True)
