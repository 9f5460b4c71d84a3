"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spreadrank.workers import ship

#: Bytes of rows that a worker turns into Python objects at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of the C library where it is glibc.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_held: dict[tuple, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """A table that a worker makes once and keeps for its next tasks. Workers outlive their stage, so the
    tables of one module are dropped when a worker comes to need another's."""
    key = (make.__module__, name)
    if key not in _held:
        for other in [k for k in _held if k[0] != key[0]]:
            del _held[other]
        _held[key] = make()
    return _held[key]


def map_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    ship(df.sparkSession)
    module = run.__module__

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if module != __name__:
            drop_others(module)
        yield from run(batches)
        give_back()

    return df.mapInArrow(alone, schema)


def drop_others(module: str) -> None:
    """Begin a task of ``module`` without the tables of others, and without what tasks of other kinds have left."""
    for other in [k for k in _held if k[0] != module]:
        del _held[other]
    give_back()


def give_back() -> None:
    """Return what is free to the system. A worker goes on to the tasks of other stages beside an executor whose own memory
    stays as large as it has been, and what a task has dropped would else remain the worker's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``SLICE_BYTES``, which bounds what a worker holds as Python objects."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def per_row(
    df: DataFrame,
    keep: list[str],
    value: str,
    columns: str,
    make: Callable[[], Callable[[list], list[pa.Array]]],
) -> DataFrame:
    """The columns ``keep`` and the new ``columns`` for each row of ``df``, made from column ``value``.

    ``make`` runs once in a task and returns a function from a batch's values to one Arrow array per
    new column. Rows are neither dropped nor matched up again by id, so null and repeated ids do no harm. A new
    column that is called like one of ``keep`` gets an underscore more.
    """
    source = list(dict.fromkeys([*keep, value]))
    at, width = source.index(value), len(keep)
    new = [T.StructField(fresh(df.select(*keep), field.name), field.dataType) for field in T.StructType.fromDDL(columns)]
    schema = T.StructType([*(df.schema[name] for name in keep), *new])
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(make.__module__)
        work = make()
        for part in sliced(batches):
            arrays = work(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:width], *arrays], names=names)

    return map_arrow(df.select(*source), run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    """A list array without a detour over Python's type inference."""
    offsets, flat = [0], []
    for row in rows:
        flat.extend(row)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
