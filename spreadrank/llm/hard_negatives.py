"""Hard negatives from an STR-packed R-tree.

The rows are tiled by sort-tile-recursive: the coordinate with the most variance cuts them at its quantiles into slabs, the next one each
slab, until a tile holds about ``tile_rows`` rows; a tile with more (equal values cannot be cut) is split by a hash of the id. A tile
is one row of a table, with its bounding box. Inside it the rows are packed the same way into leaves of ``LEAF`` rows below
nodes of ``FAN`` leaves, each with its box.

For an anchor a, the inner product with any row of the box [lo, hi] lies, coordinate by coordinate, between the smaller and the
larger of a*lo and a*hi, so their sums bound its score. A search goes through the boxes of a tile best first, from a queue ordered by
the upper bound, and leaves out those that lie outside the anchor's score windows or strictly below the k-th best it has. The
anchors of a tile travel together, as one row, to every other tile that the interval of their own box against the tile's box does
not rule out: first to the tile with the highest upper bound and their own, then, with the k-th best found there as a floor, to the
others. No candidate, box or queue is capped, so the result is exact: it does not depend on the tiling.

Positives of an anchor are the ``n_positive`` rows of its label with the highest scores; negatives of the pair are the ``n_negative``
highest rows of other labels with ``low * positive <= 100 * negative <= high * positive``. Equal scores go by the smaller id.

Components become ``floor(scale * x)``, as whole numbers; scores are exact within 64 bits, and saturate beyond. Rows with a null id or label, a null
or empty vector, or a null or non-finite component take no part. Rows are compared with rows of their vector length only.
Of rows with one id the one with the least label, then the least vector, counts, so repeated rows are one row. Anchors without
positives and pairs without negatives have no row; an empty table gives an empty result. Other columns may have any name. Anchors that
all share one score window or one tile are cut by the hash like any others.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.llm.common import map_arrow
from spreadrank.storage import materialize

LEAF = 64
FAN = 16
# Scores of products below this are exact in doubles; larger ones are worked out with Python's whole numbers.
EXACT = 2.0**52
LEAST, MOST = -(2**63), 2**63 - 1


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, label: Column | None) -> DataFrame:
    """``id, label, vector`` of the rows that take part, the components as whole numbers in doubles."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"), sound.alias("sound")
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("sound") & (F.size("vector") > 0))
    # floor() of a double is a long in Spark, so what does not fit one is left as the whole number it is.
    scaled = F.transform("vector", lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = rows.select("id", (F.col("label") if label is None else label).alias("label"), scaled.alias("vector"))
    least = F.min(F.struct("label", "vector")).alias("row")
    return rows.groupBy("id").agg(least).select("id", "row.label", "row.vector", F.size("row.vector").alias("dims"))


def str_order(vectors: np.ndarray, size: int) -> np.ndarray:
    """An order in which runs of ``size`` rows are the leaves of a sort-tile-recursive packing."""
    dims = np.argsort(-vectors.var(axis=0), kind="stable")

    def tile(rows: np.ndarray, depth: int) -> np.ndarray:
        leaves = -(-len(rows) // size)
        if leaves <= 1 or depth == len(dims):
            return rows
        levels = max(1, min(len(dims) - depth, int(np.ceil(np.log2(leaves) / 2))))
        slabs = max(2, int(np.ceil(leaves ** (1 / levels))))
        # Slabs hold whole leaves, so that runs of ``size`` rows do not straddle two of them.
        run = -(-leaves // slabs) * size
        ordered = rows[np.argsort(vectors[rows, dims[depth]], kind="stable")]
        return np.concatenate([tile(ordered[at : at + run], depth + 1) for at in range(0, len(ordered), run)])

    return tile(np.arange(len(vectors)), 0)


def boxes(values: np.ndarray, highs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinates of runs of ``size`` rows."""
    starts = np.arange(0, len(values), size)
    return np.minimum.reduceat(values, starts, axis=0), np.maximum.reduceat(highs, starts, axis=0)


class Tile:
    """Rows of a tile in packed order with the boxes above them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.leaf_lo, self.leaf_hi = boxes(vectors, vectors, LEAF)
        self.node_lo, self.node_hi = boxes(self.leaf_lo, self.leaf_hi, FAN)
        self.reach = np.abs(vectors).max(initial=0.0)

    def intervals(self, anchors: np.ndarray):
        """For every anchor, the lower and upper bounds of the nodes and of the leaves. Rounding is allowed for."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        slack = np.abs(anchors).sum(axis=1)[:, None] * self.reach
        slack = np.where(slack < EXACT, 0.0, slack * 1e-12)
        made = []
        for lo, hi in ((self.node_lo, self.node_hi), (self.leaf_lo, self.leaf_hi)):
            made += [up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack]
        return made

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        held = self.vectors[rows]
        if np.abs(anchor).sum() * self.reach < EXACT:
            return (held @ anchor).astype(np.int64)
        whole = [int(a) for a in anchor]
        sums = (sum(int(x) * a for x, a in zip(row, whole)) for row in held)
        return np.array([min(MOST, max(LEAST, s)) for s in sums], np.int64)


class Goal(NamedTuple):
    """What is looked for: the best ``k`` scores from ``low`` to ``high``, none below ``floor``."""

    low: int
    high: int
    floor: int
    k: int


class Found:
    """The best rows of a goal so far."""

    def __init__(self, goal: Goal):
        self.goal, self.floor = goal, max(goal.low, goal.floor)
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.floor) & (scores <= self.goal.high)
        if good.any():
            scores, ids = np.concatenate((self.scores, scores[good])), np.concatenate((self.ids, ids[good]))
            order = np.lexsort((ids, -scores))[: self.goal.k]
            self.scores, self.ids = scores[order], ids[order]
            if len(order) == self.goal.k:
                self.floor = max(self.floor, int(self.scores[-1]))


def best_first(tile: Tile, own_id: int, label: int, anchor: np.ndarray, bounds: list, same: bool, goals: list[Goal]) -> list[Found]:
    """The rows of ``tile`` that meet the goals, for one anchor: of its label if ``same``, else of the others."""
    node_lo, node_hi, leaf_lo, leaf_hi = bounds
    found = [Found(g) for g in goals]

    def wanted(lo: float, hi: float) -> bool:
        return any(hi >= f.floor and lo <= f.goal.high for f in found)

    queue = [(-hi, 0, n) for n, (lo, hi) in enumerate(zip(node_lo, node_hi)) if wanted(lo, hi)]
    heapq.heapify(queue)
    # Leaves at the head of the queue are scored together, more of them the longer the search goes on.
    ready, together = [], 1
    while queue or ready:
        if queue and len(ready) < together:
            upper, is_leaf, n = heapq.heappop(queue)
            if not wanted((leaf_lo if is_leaf else node_lo)[n], -upper):
                continue
            if is_leaf:
                ready.append(n)
            else:
                for leaf in range(n * FAN, min((n + 1) * FAN, len(leaf_hi))):
                    if wanted(leaf_lo[leaf], leaf_hi[leaf]):
                        heapq.heappush(queue, (-leaf_hi[leaf], 1, leaf))
            continue
        rows = np.concatenate([np.arange(n * LEAF, min((n + 1) * LEAF, len(tile.ids))) for n in ready])
        rows = rows[((tile.labels[rows] == label) == same) & (tile.ids[rows] != own_id)]
        scores = tile.scores(rows, anchor)
        for f in found:
            f.add(scores, tile.ids[rows])
        ready, together = [], min(together * 2, 64)
    return found


# Tiles


def cut_points(vectors: DataFrame, rows: int, dims: int, tile_rows: int) -> DataFrame:
    """``id, label, vector, tile``: the rows with the tile they belong to."""
    tiles = -(-rows // tile_rows)
    spread = vectors.select(*(F.var_pop(F.col("vector")[d]).alias(str(d)) for d in range(dims))).first()
    order = sorted(range(dims), key=lambda d: (-(spread[d] or 0.0), d))
    levels = max(1, min(dims, int(np.ceil(np.log2(max(2, tiles)) / 2)))) if tiles > 1 else 0
    made = vectors.withColumn("tile", F.lit(0).cast("long"))
    for level in range(levels):
        slabs = int(np.ceil(tiles ** (1 / levels)))
        value = F.col("vector")[order[level]]
        shares = [i / slabs for i in range(1, slabs)]
        cuts = made.groupBy("tile").agg(F.percentile_approx(value, shares, 10_000).alias("cuts"))
        # A row per slab so far, of which there are no more than tiles.
        place = F.size(F.filter("cuts", lambda c: c <= value))
        made = made.join(cuts, "tile").withColumn("tile", (F.col("tile") * slabs + place).cast("long")).drop("cuts")
    sizes = made.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * tile_rows)).alias("pieces"))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("long")
    return made.join(sizes, "tile").withColumn("piece", piece).drop("pieces")


TILE = "tile long, ids binary, labels binary, vectors binary, lo array<double>, hi array<double>"


def _arrays(packed: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(packed[c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(packed["vectors"], np.float64).reshape(-1, dims)


def pack_tiles(dealt: DataFrame, dims: int) -> DataFrame:
    """A row for each tile, its vectors packed."""

    def pack(rows: pa.Table) -> pa.Table:
        ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        by_id = np.argsort(ids)
        at = by_id[str_order(vectors[by_id], LEAF)]
        made = {
            "tile": [rows.column("number")[0].as_py()],
            "ids": [ids[at].tobytes()],
            "labels": [labels[at].tobytes()],
            "vectors": [vectors[at].tobytes()],
            "lo": [vectors.min(axis=0).tolist()],
            "hi": [vectors.max(axis=0).tolist()],
        }
        return pa.table(made)

    number = F.xxhash64("tile", "piece").alias("number")
    return dealt.select("id", "label", "vector", number).groupBy("number").applyInArrow(pack, TILE)


def pack_anchors(anchors: DataFrame, dims: int) -> DataFrame:
    """A row for the anchors of each tile, and their own box."""

    def pack(rows: pa.Table) -> pa.Table:
        vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        made = {
            "block": [rows.column("number")[0].as_py()],
            "ids": [rows.column("id").to_numpy().tobytes()],
            "labels": [rows.column("label").to_numpy().tobytes()],
            "vectors": [vectors.tobytes()],
            "goals": [np.concatenate(rows.column("goals").to_pylist()).astype(np.int64).tobytes() if rows.num_rows else b""],
            "n_goals": [rows.column("n_goals").to_pylist()],
            "a_lo": [vectors.min(axis=0).tolist()],
            "a_hi": [vectors.max(axis=0).tolist()],
            "least": [min(rows.column("least").to_pylist())],
            "most": [max(rows.column("most").to_pylist())],
        }
        return pa.table(made)

    schema = (
        "block long, ids binary, labels binary, vectors binary, goals binary, n_goals array<bigint>, "
        "a_lo array<double>, a_hi array<double>, least long, most long"
    )
    return anchors.groupBy("number").applyInArrow(pack, schema)


def box_interval(lower: bool) -> Column:
    """The least (or largest) inner product of points in the boxes [a_lo, a_hi] and [lo, hi], rounded outwards."""
    ends = F.arrays_zip("a_lo", "a_hi", "lo", "hi")

    def part(e: Column) -> Column:
        products = [e[a] * e[b] for a in ("a_lo", "a_hi") for b in ("lo", "hi")]
        return (F.least if lower else F.greatest)(*products)

    total = F.aggregate(F.transform(ends, part), F.lit(0.0), lambda s, x: s + x)
    margin = F.abs(total) * 1e-9 + F.aggregate(F.transform(ends, lambda e: F.abs(part(e))), F.lit(0.0), lambda s, x: s + x) * 1e-12
    return total - margin if lower else total + margin


FOUND = "anchor_id long, label long, goal int, other_id long, score long"


def visit(pairs: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """What the anchors of each row find in the tile of the row. ``pairs`` has the columns of both."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                tile = Tile(*_arrays({"ids": row["t_ids"], "labels": row["t_labels"], "vectors": row["t_vectors"]}, dims))
                ids, labels, vectors = _arrays(row, dims)
                goals, ends = np.frombuffer(row["goals"], np.int64).reshape(-1, 3), np.cumsum([0, *row["n_goals"]])
                bounds = tile.intervals(vectors)
                made: list[tuple] = []
                for i, own_id in enumerate(ids):
                    asked = [Goal(*map(int, g), k) for g in goals[ends[i] : ends[i + 1]]]
                    met = best_first(tile, own_id, labels[i], vectors[i], [b[i] for b in bounds], same, asked)
                    for g, f in enumerate(met):
                        made += [(int(own_id), int(labels[i]), g, int(o), int(s)) for o, s in zip(f.ids, f.scores)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = zip(*made) if made else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor_id", "label", "goal", "other_id", "score"]
                )

    wanted = ["ids", "labels", "vectors", "goals", "n_goals", "t_ids", "t_labels", "t_vectors"]
    return map_arrow(pairs.select(*wanted), run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows for each anchor and goal, ranked from 1."""
    order = Window.partitionBy("anchor_id", "goal").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(tiles: DataFrame, anchors: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """``anchor_id, label, goal, other_id, score, rank`` for ``anchors(id, label, vector, number, windows)``, where ``windows`` are
    structs of the least and the largest score looked for."""
    sides = tiles.select("tile", "lo", "hi", F.col("ids").alias("t_ids"), F.col("labels").alias("t_labels"), F.col("vectors").alias("t_vectors"))

    def packed(rows: DataFrame, floor: Callable[[Column], Column]) -> DataFrame:
        goals = F.flatten(F.transform("windows", lambda w, i: F.array(w["low"], w["high"], floor(i))))
        least = F.array_min(F.transform("windows", lambda w, i: F.greatest(w["low"], floor(i))))
        own = rows.select(
            "id",
            "label",
            "vector",
            "number",
            goals.alias("goals"),
            F.size("windows").alias("n_goals"),
            least.alias("least"),
            F.array_max("windows.high").alias("most"),
        )
        return materialize(pack_anchors(own, dims), "blocks")

    def open_pairs(blocks: DataFrame) -> DataFrame:
        """Blocks of anchors with the tiles that may hold what they look for: the boxes alone are met here, a row per block and tile."""
        met = blocks.select("block", "a_lo", "a_hi", "least", "most").join(tiles.select("tile", "lo", "hi"))
        ruled = met.select("block", "tile", box_interval(True).alias("lower"), box_interval(False).alias("upper"), "least", "most")
        return ruled.filter((F.col("upper") >= F.col("least")) & (F.col("lower") <= F.col("most"))).select("block", "tile", "upper")

    def joined(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
        return pairs.join(blocks, "block").join(sides, "tile")

    blocks = packed(anchors, lambda i: F.lit(LEAST))
    pairs = materialize(open_pairs(blocks), "pairs")
    nearest = Window.partitionBy("block").orderBy(F.desc("upper"), "tile")
    first = pairs.withColumn("place", F.row_number().over(nearest)).filter((F.col("place") == 1) | (F.col("block") == F.col("tile")))
    first = materialize(first.select("block", "tile"), "first")
    early = materialize(best(visit(joined(first, blocks), dims, same, k), k), "early")

    # The k-th best so far, for the goals that have as many.
    floors = early.filter(F.col("rank") == k).groupBy("anchor_id").agg(
        F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("floors")
    )
    raised = anchors.join(floors, anchors["id"] == F.col("anchor_id"), "left").drop("anchor_id")
    blocks = packed(raised, lambda i: F.coalesce(F.try_element_at("floors", i), F.lit(LEAST)))
    rest = open_pairs(blocks).join(first, ["block", "tile"], "left_anti")
    late = visit(joined(rest, blocks), dims, same, k)
    return best(early.drop("rank").unionByName(late), k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    low: int = 50,
    high: int = 95,
    n_positive: int = 5,
    n_negative: int = 3,
    tile_rows: int = 8192,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id``; ``label``, an expression on ``id`` and ``label``, replaces the label if given.
    """
    vectors = materialize(usable(df, id_col, vector_col, label_col, scale, label), "vectors")
    lengths = vectors.groupBy("dims").count().orderBy("dims").collect()
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    made = [df.sparkSession.createDataFrame([], names)]
    for n in lengths:
        alike = vectors.filter(F.col("dims") == n.dims).drop("dims")
        made.append(_mine(alike, n["count"], n.dims, is_anchor, low, high, n_positive, n_negative, tile_rows))
    return reduce(DataFrame.unionByName, made)


def _mine(vectors, rows, dims, is_anchor, low, high, n_positive, n_negative, tile_rows) -> DataFrame:
    """The negatives among ``rows`` vectors of one length."""
    dealt = materialize(cut_points(vectors, rows, dims, tile_rows), "dealt")
    tiles = materialize(pack_tiles(dealt, dims), "tiles")
    anchors = dealt.filter(is_anchor).select("id", "label", "vector", F.xxhash64("tile", "piece").alias("number"))

    everything = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    positives = materialize(search(tiles, anchors.withColumn("windows", everything), dims, True, n_positive), "positives")

    # low * positive <= 100 * negative <= high * positive, in whole numbers.
    window = F.struct(
        F.expr(f"cast(-floor(cast(-score as decimal(38, 0)) * {low} / 100) as bigint)").alias("low"),
        F.expr(f"cast(floor(cast(score as decimal(38, 0)) * {high} / 100) as bigint)").alias("high"),
        F.col("rank"),
    )
    windows = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", window.alias("w")))).alias("windows"))
    windows = windows.select(F.col("anchor_id").alias("id"), F.transform("windows", lambda w: w["w"]).alias("windows"))
    negatives = search(tiles, anchors.join(windows, "id"), dims, False, n_negative)
    pairs = positives.select("anchor_id", (F.col("rank") - 1).alias("goal"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(
        negatives.select("anchor_id", "goal", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")),
        ["anchor_id", "goal"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
