"""The most similar nodes of many nodes at once.

Rows are dealt into blocks by the nearest of some pivots, so a block is a cone around its mean direction, and a block that is too large
is split by a hash. The nodes asked for travel in blocks of their own, one row each, to the blocks of rows. A task
multiplies the two blocks as matrices and keeps the ``n`` best of each node it has met; a block is skipped where its
cone cannot hold anything better than the n-th best so far. The tasks' best are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.functions.columns import l2_norm
from spreadrank.params import DEFAULTS
from spreadrank.storage import materialize
from spreadrank.workers import ship

MOST_PIVOTS = 1024
# Similarities are compared to this many digits, so equal vectors are ties wherever they lie.
DIGITS = 12
# Nodes asked for that are multiplied with a block at a time, and blocks of them that a task holds.
NODES_AT_ONCE, MOST_HELD = 64, 32
PACKED = "{0} long, {0}_ids array<string>, {0}_units array<double>, {0}_mean array<double>, {0}_width double"


def _pack(rows: DataFrame, name: str, key: str) -> DataFrame:
    """A row per ``key``: ids, unit vectors end to end, the mean direction and the widest angle from it."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids = table.column("id").to_pylist()
        units = table.column("unit").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        mean = units.mean(axis=0)
        mean /= max(np.linalg.norm(mean), 1e-300)
        width = float(np.arccos(np.clip(units @ mean, -1, 1)).max()) + 1e-9
        made = {name: [table.column(key)[0].as_py()], f"{name}_ids": [ids], f"{name}_units": [units.ravel()]}
        return pa.table(made | {f"{name}_mean": [mean.tolist()], f"{name}_width": [width]})

    return rows.select("id", "unit", key).groupBy(key).applyInArrow(pack, PACKED.format(name))


def _by_pivot(rows: DataFrame, count: int, block_rows: int) -> DataFrame:
    """``id, unit, block``: each row with the block it belongs to."""
    pivots = rows.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, -(-count // block_rows))).collect()
    held = rows.sparkSession.sparkContext.broadcast(np.array([r.unit for r in pivots]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                near = np.round(units @ held.value.T, DIGITS).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], names=["id", "unit", "pivot"])

    near = materialize(rows.select("id", "unit").mapInArrow(run, "id string, unit array<double>, pivot long"), "near")
    sizes = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * block_rows)).alias("pieces"))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces"))
    return near.join(F.broadcast(sizes), "pivot").select("id", "unit", (F.col("pivot") * (1 << 32) + piece).alias("block"))


class _Best:
    """The ``n`` best rows of each node of a block of nodes so far."""

    def __init__(self, ids: list[str], units: np.ndarray, n: int):
        self.ids, self.units, self.n = ids, units, n
        self.found: list[list[tuple[float, str]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -2.0)

    def meet(self, ids: list[str], units: np.ndarray, mean: np.ndarray, width: float) -> None:
        apart = np.arccos(np.clip(self.units @ mean, -1, 1))
        reach = np.cos(np.maximum(0.0, apart - width)) + 10.0**-DIGITS
        open_rows = np.flatnonzero(reach >= self.floor)
        if not len(open_rows):
            return
        for begin in range(0, len(open_rows), NODES_AT_ONCE):
            some = open_rows[begin : begin + NODES_AT_ONCE]
            self._take(some, np.round(self.units[some] @ units.T, DIGITS), ids)

    def _take(self, rows: np.ndarray, near: np.ndarray, ids: list[str]) -> None:
        for at, scores in zip(rows, near):
            best = self.found[at]
            # One more than asked for, since the node itself may be among them.
            k = min(len(scores), self.n + 1)
            edge = max(self.floor[at], np.partition(scores, -k)[-k])
            best += [(-float(scores[i]), ids[i]) for i in np.flatnonzero(scores >= edge) if ids[i] != self.ids[at]]
            best.sort()
            del best[self.n :]
            if len(best) == self.n:
                self.floor[at] = -best[-1][0]

    def rows(self) -> pa.RecordBatch:
        made = [(node, i, -s) for node, best in zip(self.ids, self.found) for s, i in best]
        kinds = (pa.string(), pa.string(), pa.float64())
        columns = zip(*made) if made else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "id", "similarity"])


def _numbers(batch: pa.RecordBatch, name: str, at: int) -> np.ndarray:
    """The array in a row, as it lies in the batch."""
    return batch.column(name)[at].values.to_numpy()


def most_similar_many(
    vectors: DataFrame, wanted: DataFrame, n: int = DEFAULTS.most_similar_n, block_rows: int = 8192, wanted_rows: int = 1024
) -> DataFrame:
    """``(node, rank, id, similarity)``: the ``n`` other nodes closest by cosine to each node in ``wanted(id)``.

    Equal similarities go by id. Unknown nodes, and nodes whose vector is missing or has no length, have no rows and are in none.
    """
    ship(vectors.sparkSession)
    length = l2_norm(F.col("vector"))
    unit = F.transform("vector", lambda v: v.cast("double") / F.col("length"))
    rows = vectors.select("id", "vector", length.alias("length")).filter("length > 0").select("id", unit.alias("unit"))
    rows = materialize(rows, "units")
    asked = materialize(rows.join(wanted.select("id").distinct(), "id", "left_semi"), "asked")
    schema = "node string, id string, similarity double"
    count, n_asked = rows.count(), asked.count()
    if not n_asked:
        return vectors.sparkSession.createDataFrame([], "node string, rank int, id string, similarity double")
    blocks = materialize(_pack(_by_pivot(rows, count, block_rows), "block", "block"), "blocks")
    dealt = asked.withColumn("asked", F.pmod(F.xxhash64("id"), F.lit(-(-n_asked // wanted_rows))))
    pairs = _pack(dealt, "asked", "asked").join(blocks).withColumn("lot", F.pmod(F.xxhash64("block"), F.lit(16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, _Best] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                asked = batch.column("asked")[at].as_py()
                own = met.get(asked)
                if own is None:
                    if len(met) == MOST_HELD:
                        # What is left of a block of nodes here begins anew; the best of both are merged by rank.
                        yield met.pop(next(iter(met))).rows()
                    ids = batch.column("asked_ids")[at].as_py()
                    # A copy, since a view would keep the whole batch.
                    own = met[asked] = _Best(ids, _numbers(batch, "asked_units", at).reshape(len(ids), -1).copy(), n)
                ids = batch.column("block_ids")[at].as_py()
                units = _numbers(batch, "block_units", at).reshape(len(ids), -1)
                own.meet(ids, units, _numbers(batch, "block_mean", at), batch.column("block_width")[at].as_py())
        for own in met.values():
            yield own.rows()

    found = pairs.repartition("asked", "lot").drop("lot", "asked_mean", "asked_width").mapInArrow(run, schema)
    order = Window.partitionBy("node").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("node", "rank", "id", "similarity")
