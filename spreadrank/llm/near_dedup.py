"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document is the set of its distinct word shingles, as 64-bit hashes. Its sketch is filled in rounds: each
round hashes every element to a bin and a value, and a bin keeps the least value of the first round that
reached it. After ``SIZE`` rounds every element is also sent to one fixed bin a round, so all bins get filled, and the
share of equal bins of two sketches is concentrated about their Jaccard similarity. Two sets with similarity
0.8 agree in one of ``BANDS`` bands of ``ROWS`` bins with a chance of 1 - 2e-5, and all that agree are looked at.

Documents with the same set form one class, found by a 128-bit digest, and only classes are compared. No
bucket is expanded into its pairs:
1. Each class is compared with the least and the greatest class of its buckets, and the likeliest of these
   pairs of each class are verified. That joins nearly all that belongs together.
2. In buckets that still hold several components, the classes outside the largest one meet the bucket's others,
   in packs of bounded size whose sketches are compared as matrices. A pack emits a spanning forest of what
   may be linked, and the components of that are families: no link leads out of one.
3. In families with several components, the classes outside the largest one meet the others in packs again, with
   their texts, and all pairs that may be linked are verified on the full sets unless links found before
   have joined them. A pack emits the links that join something new.
So every link between classes that share a bucket counts, and the rows made grow with the classes and not with
their pairs. A pair may be linked if the sizes allow it and the sketches agree in ``MIN_AGREE`` of the
bins, which is more than five standard deviations below what the threshold gives.

Null texts and texts without words are empty sets, linked with nothing. Rows without an id take no part and
stay. Rows with the same id and text are copies of each other; the same id with other texts joins the
components of all its texts only if those are linked. Very long texts count with all their shingles. Columns other than id and text
are not read for the links, and ``keep_one`` passes them on whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.common import fresh, map_arrow, per_row, sliced, type_of
from spreadrank.llm.components import connected_components
from spreadrank.operators.skew import lookup
from spreadrank.storage import materialize

ROWS, BANDS = 5, 28
#: Bins of a sketch; the bands take the first ones. Four bits of each are kept for the comparison, in which
#: sets of similarity 0.8 agree in 0.8125 of the bins, with a standard deviation of 0.0173.
SIZE = 512
MIN_AGREE = 0.72
#: Classes that are compared with as many others at once, and bytes of them.
PACK = 256
PACK_BYTES = 8 << 20
#: Ids that are broadcast at most, 16 bytes each; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000

# Space and the five control characters are 0x20 and 0x09-0x0D; all else is part of a word.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The ascending hashes of the distinct shingles; of fewer words, the sequence counts as one."""
    # Only the space is left to split at: other bytes that split() takes for blanks are below 0x1F and word parts.
    found = [w for w in (text or "").encode().translate(FOLDED).split(b" ") if w]
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    total = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * U(0x9E3779B97F4A7C15) + hashes[i : len(found) - width + 1 + i])
    return np.unique(total)


def class_of(items: np.ndarray) -> bytes | None:
    """The 128-bit digest of a set; none for the empty one."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def sketch(items: np.ndarray, size: int = SIZE) -> np.ndarray:
    """``size`` bins, each with the round in its upper 12 bits and the value in the others."""
    bins = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    start, step = 0, max(1, 4 * size // len(items))
    while start < 2 * size:
        rounds = np.arange(start, min(start + step, size if start < size else 2 * size), dtype=np.uint64)[:, None]
        values = mixed(items[None, :] + mixed(rounds * U(0x9E3779B97F4A7C15) + U(1)))
        if start < size:
            at = ((values & U(0xFFFFFFFF)) * U(size)) >> U(32)
        else:
            at = np.broadcast_to(rounds - U(size), values.shape)
        np.minimum.at(bins, at.ravel().astype(np.int64), ((rounds << U(52)) | (mixed(values) >> U(12))).ravel())
        if not (bins == np.iinfo(np.uint64).max).any():
            break
        start += len(rounds)
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in bins[: ROWS * BANDS].reshape(BANDS, ROWS).T:
        keys = mixed(keys * U(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def nibbles(bins: np.ndarray) -> bytes:
    """Four bits of each bin, two bins to a byte."""
    low = (mixed(bins) & U(15)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal bins, of sketches as rows of bytes; the shapes are broadcast."""
    apart = left ^ right
    return ((apart < 16).sum(axis=-1) + (apart & 15 == 0).sum(axis=-1)) / SIZE


def _described(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, n, class, bands, sketch`` of each row; the last three are null for an empty set."""

    def run(batches):
        for batch in sliced(batches):
            n, classes, bands, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                items = shingles(text, words)
                n.append(len(items))
                classes.append(class_of(items))
                if len(items):
                    bins = sketch(items)
                    bands.append(band_keys(bins))
                    sketches.append(nibbles(bins))
                else:
                    bands.append(np.empty(0, np.int64))
                    sketches.append(None)
            ends = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(classes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands) if bands else [], pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=["id", "n", "class", "bands", "sketch"],
            )

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, run, f"id {type_of(df, id_col)}, n long, class binary, bands array<long>, sketch binary")


def _alike(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """``a, b, agree`` of the pairs that sizes and sketches allow to be linked."""
    own = nodes.select("node", "n", "sketch")
    first = own.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    second = own.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    # The smaller set can be the whole intersection, the larger the whole union.
    both = pairs.join(first, "a").join(second, "b").filter(small * 100 >= large * threshold)

    def run(batches):
        for batch in sliced(batches):
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SIZE // 2) for i in (2, 3)
            )
            agree = agreement(left, right)
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree)], names=["a", "b", "agree"])
            yield made.filter(pa.array(agree >= MIN_AGREE))

    return map_arrow(both.select("a", "b", "sketch_a", "sketch_b"), run, "a long, b long, agree double")


def _packed(rows: DataFrame, key: str, name: str, columns: list[str], size) -> DataFrame:
    """``key, name``: the rows of each key in arrays of about ``PACK`` entries and ``PACK_BYTES``; ``size`` is a
    row's bytes."""
    packs = F.ceil(F.greatest(F.count(F.lit(1)) / PACK, F.sum(size) / PACK_BYTES)).alias("packs")
    dealt = rows.join(rows.groupBy(key).agg(packs), key).withColumn("pack", F.pmod(F.xxhash64("node"), F.col("packs")))
    entries = dealt.groupBy(key, "pack").agg(F.collect_list(F.struct(*columns)).alias(name))
    return entries.withColumnRenamed("pack", f"{name}_pack")


def _meet(rows: DataFrame, key: str, columns: list[str], size) -> DataFrame:
    """``left, right``: for each key with several components, packs of the rows outside its largest one, each
    with every pack of all its rows. ``rows`` has ``node, root, n, sketch`` and ``columns``."""
    sizes = rows.groupBy(key, "root").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy(key).agg(
        F.max_by("root", F.struct("size", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")
    )
    several = materialize(rows.join(largest.filter("roots > 1").select(key, "largest"), key), "several")
    names = ["node", "root", "n", "sketch", *columns]
    left = _packed(several.filter("root != largest"), key, "left", names, size)
    met = left.join(_packed(several, key, "right", names, size), key)
    # A meeting is much work on few bytes, so small shuffle partitions are not to be put together.
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return met.repartition(parts, key, "left_pack", "right_pack").select("left", "right")


class Pack:
    def __init__(self, entries: pa.ListScalar):
        rows = entries.values
        self.node, self.root, self.n = (rows.field(name).to_numpy() for name in ("node", "root", "n"))
        self.sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.texts = rows.field("text").to_pylist() if rows.type.get_field_index("text") >= 0 else None
        self.sets: dict[int, np.ndarray] = {}

    def set(self, at: int, words: int) -> np.ndarray:
        if at not in self.sets:
            self.sets[at] = shingles(self.texts[at], words)
        return self.sets[at]


def _joined(met: DataFrame, threshold: int, words: int | None) -> DataFrame:
    """``a, b``: of each two packs, pairs that join all components that may be linked or, with ``words``, that are."""

    def pairs(x: Pack, y: Pack):
        # Components so far, those that meet here joined.
        root_x, root_y = x.root.copy(), y.root.copy()
        for i in range(len(x.node)):
            small, large = np.minimum(x.n[i], y.n), np.maximum(x.n[i], y.n)
            at = np.flatnonzero((root_y != root_x[i]) & (small * 100 >= large * threshold))
            agree = agreement(x.sketch[i][None, :], y.sketch[at])
            at, agree = at[agree >= MIN_AGREE], agree[agree >= MIN_AGREE]
            for j in at[np.argsort(-agree, kind="stable")]:
                one, two = root_x[i], root_y[j]
                if one != two and (words is None or similar(x.set(i, words), y.set(j, words), threshold)):
                    root_x[root_x == two] = one
                    root_y[root_y == two] = one
                    yield x.node[i], y.node[j]

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                found = np.array(list(pairs(Pack(left), Pack(right))), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"]
                )

    return map_arrow(met, run, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _linked(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs whose full sets are similar enough. A pair's two texts meet in a shuffle by the pair."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).join(texts, "node")
    met = ends.groupBy("a", "b").agg(
        F.max(F.when(F.col("node") == F.col("a"), F.col("text"))).alias("text_a"),
        F.max(F.when(F.col("node") == F.col("b"), F.col("text"))).alias("text_b"),
    )

    def run(batches):
        for batch in sliced(batches):
            linked = [
                similar(shingles(one, words), shingles(other, words), threshold)
                for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return map_arrow(met, run, "a long, b long")


def _texts(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """``node, text`` of the wanted classes (``node, id, class``). Where rows share an id, the text whose
    set is the class's is taken."""
    few = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.join(F.broadcast(wanted) if few else wanted, "id")

    def run(batches):
        for batch in sliced(batches):
            texts, classes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            same = [class_of(shingles(t, words)) == c for t, c in zip(texts, classes)]
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    return map_arrow(found.select("node", "text", "class"), run, "node long, text string").groupBy("node").agg(
        F.min("text").alias("text")
    )


def _with_root(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    named = roots.select("node", F.col("root").alias("_root"))
    return rows.join(named, "node", "left").withColumn(name, F.coalesce("_root", "node")).drop("_root")


def _judged(df: DataFrame, id_col: str, text_col: str, words: int, threshold: int) -> DataFrame:
    """``id, n, class, component_id, first_class`` of each row. The class, the least id of the component and the
    least class with that id are null for empty sets and rows without an id."""
    rows = materialize(_described(df, id_col, text_col, words), "described")
    n_rows = rows.count()
    set_rows = rows.filter("class is not null and id is not null")
    classes = set_rows.groupBy("class").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last")
    # Buckets with more than one class: bucket, class and the bucket's least class.
    shared = materialize(keyed.join(heads, "key"), "buckets")
    ends = F.explode(F.array(F.struct(F.col("head").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("last").alias("b"))))
    stars = shared.select(ends.alias("pair")).select("pair.a", "pair.b").filter("a < b").distinct()
    alike = materialize(_alike(stars, nodes, threshold), "alike")
    either = F.array(
        F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))
    )
    sides = alike.select("agree", F.explode(either).alias("side")).select("agree", "side.x", "side.y")
    best = sides.groupBy("x").agg(F.max_by("y", F.struct("agree", -F.col("y"))).alias("y"))
    best = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    wanted = nodes.select("node", "id", "class")
    ends = best.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts(df, id_col, text_col, wanted.join(ends, "node"), words)
    links = materialize(_linked(best, texts, words, threshold), "links")
    roots = connected_components(links)

    described = nodes.select("node", "n", "sketch")
    member = _with_root(shared.select("key", "node").join(described, "node"), roots, "root")
    maybe = materialize(_joined(_meet(member, "key", [], F.lit(SIZE)), threshold, None), "maybe")
    families = connected_components(maybe.unionByName(links))
    # The classes that may still be linked with another component, and all others of their families.
    inside = _with_root(_with_root(described.join(families.select("node"), "node", "left_semi").unionByName(
        described.join(families.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
    ), families, "family"), roots, "root")
    open_families = inside.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    inside = materialize(inside.join(open_families.select("family"), "family", "left_semi"), "families")
    texts = _texts(df, id_col, text_col, wanted.join(inside.select("node"), "node"), words)
    met = _meet(inside.join(texts, "node"), "family", ["text"], F.octet_length("text") + SIZE)
    more = materialize(_joined(met, threshold, words), "links")
    roots = connected_components(links.unionByName(more))

    grouped = nodes.select("class", "node", "id").join(roots, "node", "left")
    grouped = grouped.select("class", "id", F.coalesce("root", "node").alias("root"))
    first = F.min_by("class", F.struct("id", "class")).alias("first_class")
    names = grouped.groupBy("root").agg(F.min("id").alias("component_id"), first)
    named = grouped.join(names, "root").select("class", "component_id", "first_class")
    plain = rows.select("id", "n", F.when(F.col("id").isNotNull(), F.col("class")).alias("class"))
    return lookup(plain, named, ["class"], n_rows, "left")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of each row: sets of ``words``-word shingles are linked when 100 *
    intersection >= ``threshold`` * union; a component is named by its least id, whose rows are kept."""
    component = F.coalesce("component_id", "id")
    return _judged(df, id_col, text_col, words, threshold).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each component of ``df``, one with the least id. If several rows have that id, they are of the
    least class with it, and of these the row with the least text, then the least as JSON, stays. Rows without an id or
    words stay. A row is dropped for its own text: others with its id do not go with it."""
    stays = F.col("class").isNull() | ((F.col("id") == F.col("component_id")) & (F.col("class") == F.col("first_class")))
    found = _judged(df, id_col, text_col, words, threshold).filter("id is not null").select("id", "class", stays.alias("stays"))
    verdicts = found.groupBy("id", "class").agg(F.count(F.lit(1)).alias("n"), F.max("stays").alias("stays"))
    verdicts = materialize(verdicts, "verdicts")
    name = fresh(df, "_id")
    by_id = verdicts.groupBy(F.col("id").alias(name)).agg(
        F.sum("n").alias("n"), F.max("stays").alias("stays"), F.max(F.col("class").isNotNull()).alias("words")
    )

    def of(ids: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        few = ids.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        return rows.join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col(name), how)

    rest = of(materialize(by_id.filter("not stays").select(name), "gone"), "left_anti", df)
    # Ids with several rows, not all of which go: the id does not tell which.
    several = materialize(by_id.filter("stays and n > 1 and words").select(name), "several")
    if several.isEmpty():
        return rest

    def work():
        def run(texts):
            return [pa.array([class_of(shingles(t, words)) for t in texts], pa.binary())]

        return run

    shared = of(several, "left_semi", rest).select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    classed = materialize(per_row(shared, ["doc", "text"], "text", "class binary", work), "classed")
    # Rows of one id and class are put together before they are shuffled, so no key is too large for the join.
    least = F.min_by("doc", F.struct("text", F.to_json("doc"))).alias("doc")
    one = classed.filter("class is not null").groupBy(F.col("doc").getField(id_col).alias("id"), "class").agg(least)
    one = one.join(verdicts.filter("stays and class is not null").select("id", "class"), ["id", "class"], "left_semi")
    chosen = classed.filter("class is null").select("doc").unionByName(one.select("doc"))
    return of(several, "left_anti", rest).unionByName(chosen.select("doc.*"))
