"""Nearest neighbours by cosine with multi-index hashing.

A rotation learned on a bounded sample (``sample_rows``) turns vectors into binary codes, the signs of the rotated
vector. The rows are dealt into blocks by a hash of the id. In a block each code is cut into substrings
of about log2(rows) bits and every substring has a direct-address table. Two codes within distance
r agree up to r // m bits in one of the m substrings, so probing all values that far from the query's
substrings finds every code within the radius; those are reranked by their vectors, in double precision.

The radius grows until it is certain enough that nothing nearer is outside: a vector at the angle of the k-th
best so far has a code distance of about bits * angle / pi, and the radius must exceed that by ``sigmas``
standard deviations. Nothing else ends the search: no bucket, probe or candidate count is bounded. With two
standard deviations at least 97 of 100 neighbours are found.

Queries meet the rows block by block: each block of rows with each block of queries, both of bounded size, and the
best ``k`` of each are merged. Rows with a null id, or a vector that is null, zero, or holds a null or non-finite
component, take no part. Vectors are compared with those of their own length only, and each length has its own
rotation and its own search. Of rows with the same id and length the one with the least vector counts; an id with
vectors of several lengths has neighbours, ranked from 1, for each. Ties in score go to the smaller id. Columns other than id
and vector are not read, so their names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.storage import materialize
from spreadrank.workers import ship

MAX_BITS = 64


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` (doubles) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), sound.alias("sound")).filter(
        F.col("id").isNotNull() & F.col("sound") & F.exists("vector", lambda x: x != 0.0)
    )
    return found.groupBy("id", F.size("vector").alias("dims")).agg(F.min("vector").alias("vector"))


def learn_rotation(sample: np.ndarray, rounds: int = 30) -> np.ndarray:
    """A rotation, most variance first, then turned so that the signs lose least."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    bits = min(MAX_BITS, unit.shape[1])
    _, basis = np.linalg.eigh(unit.T @ unit)
    basis = basis[:, ::-1][:, :bits]
    flat = unit @ basis
    turn, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (left @ right).T
    return basis @ turn


class Block:
    """Codes of some vectors, and a table for each substring."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray):
        self.ids, self.vectors, self.rotation = ids, vectors, rotation
        self.bits = rotation.shape[1]
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / self.lengths[:, None]
        parts = max(1, round(self.bits / max(4.0, min(16.0, np.log2(len(ids) + 1)))))
        self.cuts = np.linspace(0, self.bits, parts + 1).astype(int)
        codes = self.unit @ rotation > 0
        self.codes = self._packed(codes)
        self.tables = []
        for part in self._parts(codes):
            width = 1 << (self.cuts[len(self.tables) + 1] - self.cuts[len(self.tables)])
            order = np.argsort(part, kind="stable")
            self.tables.append((order, np.searchsorted(part[order], np.arange(width + 1))))

    def _packed(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def _parts(self, codes: np.ndarray) -> list[np.ndarray]:
        return [
            (codes[:, a:b].astype(np.int64) << np.arange(b - a)).sum(axis=1) for a, b in zip(self.cuts[:-1], self.cuts[1:])
        ]

    def search(self, own_id: int, vector: np.ndarray, k: int, sigmas: float) -> list[tuple[int, float]]:
        """The ``k`` nearest rows found, nearest first, of equals the least id."""
        length = np.sqrt((vector * vector).sum())
        unit = vector / length
        bit = (unit @ self.rotation > 0)[None, :]
        probes = [int(p[0]) for p in self._parts(bit)]
        code = self._packed(bit)[0]
        unseen = self.ids != own_id
        # Retrieved but outside the radius so far, with the distance; and what was reranked, with the cosine.
        waiting, apart = np.empty(0, np.int64), np.empty(0, np.uint8)
        found, near = np.empty(0, np.int64), np.empty(0)
        widest = int(max(np.diff(self.cuts)))
        for level in range(widest + 1):
            for (order, ends), probe, bits in zip(self.tables, probes, np.diff(self.cuts)):
                values = probe ^ masks(int(bits), level)
                first, count = ends[values], ends[values + 1] - ends[values]
                hit = count > 0
                first, count = first[hit], count[hit]
                at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                rows = order[at]
                rows = rows[unseen[rows]]
                unseen[rows] = False
                waiting = np.concatenate((waiting, rows))
                apart = np.concatenate((apart, np.bitwise_count(self.codes[rows] ^ code)))
            radius = self.bits if level == widest else len(probes) * (level + 1) - 1
            inside = apart <= radius
            fresh, waiting, apart = waiting[inside], waiting[~inside], apart[~inside]
            found, near = np.concatenate((found, fresh)), np.concatenate((near, self.unit[fresh] @ unit))
            if len(found) >= k:
                edge = np.partition(near, -k)[-k]
                if radius >= self._needed(edge, sigmas):
                    break
        if len(found) > k:
            found = found[near >= np.partition(near, -k)[-k] - 1e-9]
        exact = (self.vectors[found] * vector).sum(axis=1) / (self.lengths[found] * length)
        best = np.lexsort((self.ids[found], -exact))[:k]
        return [(int(self.ids[found[i]]), float(exact[i])) for i in best]

    def _needed(self, cosine: float, sigmas: float) -> float:
        share = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        return self.bits * share + sigmas * np.sqrt(self.bits * share * (1 - share))


_MASKS: dict[tuple[int, int], np.ndarray] = {}


def masks(bits: int, ones: int) -> np.ndarray:
    """All numbers of ``bits`` bits with that many ones."""
    if (bits, ones) not in _MASKS:
        every = np.arange(1 << bits, dtype=np.int64)
        _MASKS[bits, ones] = every[np.bitwise_count(every) == ones]
    return _MASKS[bits, ones]


def _arrays(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    values = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, values.reshape(-1, dims)


def nearest(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    sigmas: float = 2.0,
    block_rows: int = 8192,
    query_rows: int = 4096,
    sample_rows: int = 10_000,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for each row for which ``is_query``,
    a condition on ``id``, holds."""
    spark = df.sparkSession
    ship(spark)
    vectors = materialize(usable(df, id_col, vector_col), "vectors")
    lengths = vectors.groupBy("dims").count().orderBy("dims").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    made = [
        _nearest(vectors.filter(F.col("dims") == n.dims), n["count"], n.dims, is_query, k, sigmas, block_rows, query_rows, sample_rows)
        for n in lengths
    ]
    return reduce(DataFrame.unionByName, made) if made else empty


def _nearest(
    vectors: DataFrame,
    rows: int,
    dims: int,
    is_query: Column,
    k: int,
    sigmas: float,
    block_rows: int,
    query_rows: int,
    sample_rows: int,
) -> DataFrame:
    """The neighbours among ``rows`` vectors of one length."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    queries = vectors.filter(is_query)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").collect()
    rotation = spark.sparkContext.broadcast(learn_rotation(np.array([r.vector for r in sample])))

    blocks, query_blocks = -(-rows // block_rows), -(-max(1, queries.count()) // query_rows)

    def dealt(side: DataFrame, name: str, count: int, other: str, times: int) -> DataFrame:
        """Rows with a block of their own side, repeated for every block of the other."""
        own = F.pmod(F.xxhash64("id", F.lit(name)), F.lit(count)).cast("int").alias(name)
        return side.select("id", "vector", own, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other))

    index = dealt(vectors, "block", blocks, "query_block", query_blocks)
    asked = dealt(queries, "query_block", query_blocks, "block", blocks)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        made: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            block = Block(*_arrays(left, dims), rotation.value)
            for own, vector in zip(*_arrays(right, dims)):
                made += [(int(own), other, score) for other, score in block.search(int(own), vector, k, sigmas)]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        columns = zip(*made) if made else ((), (), ())
        return pa.table(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["query_id", "vec_id", "score"]
        )

    keys = ["block", "query_block"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
