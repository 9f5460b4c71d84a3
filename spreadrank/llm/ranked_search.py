"""Ranked lexical search with hashed max-sketches.

The index has a row per document: its terms and how often each occurs, packed, and a sketch, an array of bytes onto which the
terms are hashed and that keeps the largest count at each place. A term's impact grows with its count, so
the impact of the count at a query term's place is at least the term's own, and the sum over the query is an upper
bound of the document's score. A sketch is as wide as the power of two next to ``FILL`` places a distinct term, so
long documents are bounded as closely as short ones; counts above 254 are kept as 255, which stands for any.

A search reads the index once for every ``BATCHES_PER_PASS`` batches of items. A task looks up what the impact of each of their terms
is at most in a chunk of documents; the bounds of an item are the product of its weights with the rows of its own terms. It
goes through each item's documents by descending bound: these are scored exactly, until the bound is below the worst of the best ``k``
the task has seen. The tasks' best are merged. Nothing but bounds ends a search.

Scores are whole numbers: with N documents that have terms, L their terms, n a document's, df and tf as usual, a term weighs
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``, ``m = 50 + (50 n N) div L``, and the score is the sum of
``w * ((10^9 tf) div (1000 tf + 20 m))`` over the item's distinct terms.

Terms are runs of digits, letters of ASCII and all characters beyond it; only A-Z are lower-cased. Null and empty texts
have none, are counted nowhere and are never found; an item without terms finds nothing. Every row of the documents is a document
of its own, so repeated rows have a rank each; of equal scores the smaller id comes first and null ids last. Items with the same
id (null is an id) are one item with the terms of all. Empty tables give an empty result. Only the id and the text are read, so
other columns may have any name. A text is handled whole: a task holds one text's terms and a sketch of up to 16 bytes
for each of them, and a batch of items holds ``batch_terms`` terms in expectation, or one item if that has more. A chunk has fewer documents if the items have many
distinct terms, so a task's two tables of impacts have some ``CELLS`` numbers each.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.llm.common import map_arrow, sliced
from spreadrank.storage import materialize

FILL = 8
LEAST_WIDTH = 64
ANY_COUNT = 255
# The most documents whose bounds are looked up together, the least, and the numbers that a task holds for those between.
CHUNK = 1024
LEAST_CHUNK = 32
CELLS = 1 << 21
CHUNK_BYTES = 8 << 20

# Batches of items that share a reading of the index.
BATCHES_PER_PASS = 16

# Separators become blanks and A-Z lower case; bytes of UTF-8 sequences stay.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def fold(places: np.ndarray, counts: np.ndarray) -> bytes:
    """The sketch of a document from the hashes of its distinct terms and their counts."""
    width = max(LEAST_WIDTH, 1 << int(FILL * len(places) - 1).bit_length())
    sketch = np.zeros(width, np.uint8)
    np.maximum.at(sketch, places & (width - 1), np.minimum(counts, ANY_COUNT).astype(np.uint8))
    return sketch.tobytes()


def _index_rows(batches):
    for part in sliced(batches):
        terms, counts, sketches, sizes = [], [], [], []
        for text in part.column(1).cast(pa.binary()).to_pylist():
            found = Counter(terms_of(text or b""))
            numbers = np.fromiter(found.values(), np.int64, len(found))
            terms.append(b" ".join(found))
            counts.append(numbers.tobytes())
            sizes.append(int(numbers.sum()))
            places = np.fromiter(map(crc32, found), np.int64, len(found))
            sketches.append(fold(places, numbers) if found else b"")
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(counts, pa.binary()),
                pa.array(sketches, pa.binary()),
            ],
            names=["id", "n_terms", "terms", "counts", "sketch"],
        )


def terms_and_sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_terms, terms, counts, sketch`` of each row, also of those without terms: the distinct terms with a blank between
    them, and their counts as packed 64-bit numbers."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, _index_rows, "id long, n_terms long, terms string, counts binary, sketch binary")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, written to the shared folder."""
    return materialize(terms_and_sketches(docs, id_col, text_col).filter("n_terms > 0"), "search-index")


def weighted_terms(index: DataFrame, items: DataFrame, n_docs: int, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term, weight``: the distinct terms of each item that occur in the index."""
    term = F.explode(F.split("terms", " ")).alias("term")
    asked = terms_and_sketches(items, id_col, text_col).filter("n_terms > 0").select(F.col("id").alias("item_id"), term)
    df = index.select(term).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    return asked.distinct().join(df, "term").select("item_id", "term", weight.cast("long").alias("weight"))


class Batch:
    """Some items, prepared for the look-ups."""

    def __init__(self, rows: list):
        self.terms = sorted({r.term for r in rows})
        place = {t: i for i, t in enumerate(self.terms)}
        self.hashes = np.array([crc32(t.encode()) for t in self.terms], np.int64)
        asked: dict = {}
        for r in rows:
            asked.setdefault(r.item_id, []).append((place[r.term], r.weight))
        self.items = sorted(asked, key=lambda i: (i is None, i))
        self.asked = [tuple(np.array(c, np.int64) for c in zip(*sorted(asked[i]))) for i in self.items]


def impact(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


class Best:
    """The best ``k`` documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores, self.ids, self.nulls = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= self.floor
        if not good.any():
            return
        scores, ids, nulls = (
            np.concatenate((old, new[good]))
            for old, new in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls))
        )
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.scores[-1]))


class Search:
    """A task's search of its documents for the items of a batch."""

    def __init__(self, batch: Batch, n_docs: int, n_terms: int, k: int):
        self.batch, self.n_docs, self.n_terms = batch, n_docs, n_terms
        self.chunk_rows = max(LEAST_CHUNK, min(CHUNK, CELLS // max(1, len(batch.terms))))
        # Impacts and weights are whole numbers below 2^24. The margin covers the rounding of as many additions in single precision.
        self.raised = [(weight * (1 + 2.0**-23 * (16 + len(weight)))).astype(np.float32) for _, weight in batch.asked]
        self.value_set = pa.array(batch.terms, pa.string())
        self.best = [Best(k) for _ in batch.items]

    def most(self, sketches: list[bytes], m: np.ndarray) -> np.ndarray:
        """What the impact of each term of the batch is at most, a row per term and a column per document."""
        made = np.empty((len(self.batch.terms), len(sketches)), np.float32)
        widths = np.array([len(s) for s in sketches])
        for width in np.unique(widths):
            columns = np.flatnonzero(widths == width)
            held = np.frombuffer(b"".join(sketches[i] for i in columns), np.uint8).reshape(len(columns), width)
            counts = np.ascontiguousarray(held.T)[self.batch.hashes & (int(width) - 1)]
            bound = counts.astype(np.float32)
            bound /= bound + (m[columns] * 0.02).astype(np.float32)
            bound *= 1e6
            bound[counts == ANY_COUNT] = 1e6
            if columns[-1] - columns[0] + 1 == len(columns):
                made[:, columns[0] : columns[-1] + 1] = bound
            else:
                made[:, columns] = bound
        return made

    def bounds(self, sketches: list[bytes], m: np.ndarray) -> np.ndarray:
        """Upper bounds, a row per document and a column per item."""
        most = self.most(sketches, m)
        return np.array([raised @ most[at] for raised, (at, _) in zip(self.raised, self.batch.asked)]).T

    def impacts(self, part: pa.RecordBatch, rows: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The impact of each term of the batch in each of the documents ``rows``, a row per document."""
        held = part.take(pa.array(rows))
        terms = pc.split_pattern(held.column(2), " ")
        doc = np.repeat(np.arange(len(rows)), np.diff(terms.offsets.to_numpy()))
        code = pc.index_in(terms.flatten(), self.value_set)
        known = code.is_valid().to_numpy(zero_copy_only=False)
        counts = np.frombuffer(b"".join(held.column(3).to_pylist()), np.int64)[known]
        made = np.zeros((len(self.batch.terms), len(rows)), np.float32)
        made[code.drop_null().to_numpy(), doc[known]] = impact(counts, m[rows][doc[known]])
        return made.T

    def chunk(self, part: pa.RecordBatch) -> None:
        # Sketches of one width beside each other.
        part = part.take(pa.array(np.argsort(pc.binary_length(part.column(4)).to_numpy(), kind="stable")))
        m = 50 + (50 * part.column(1).to_numpy() * self.n_docs) // self.n_terms
        nulls = part.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = part.column(0).fill_null(0).to_numpy()
        most, impacts = self.most(part.column(4).to_pylist(), m), None
        for best, raised, (at, weight) in zip(self.best, self.raised, self.batch.asked):
            bounds = raised @ most.take(at, 0)
            rows = np.flatnonzero(bounds >= best.floor)
            if not len(rows):
                continue
            if impacts is None:
                impacts = self.impacts(part, np.arange(part.num_rows), m).T
            own_impacts = impacts.take(at, 0)
            # In single precision, rounded up; what is left is scored in whole numbers.
            rows = rows[(raised @ own_impacts)[rows] >= best.floor]
            rows = rows[np.argsort(-bounds[rows], kind="stable")]
            step, start = 64, 0
            while start < len(rows) and bounds[rows[start]] >= best.floor:
                own = rows[start : start + step]
                best.add(weight @ own_impacts.take(own, 1).astype(np.int64), ids[own], nulls[own])
                start, step = start + step, step * 2

    def results(self) -> pa.RecordBatch:
        made = [
            (item, None if null else int(doc), int(score))
            for item, best in zip(self.batch.items, self.best)
            for score, doc, null in zip(best.scores, best.ids, best.nulls)
        ]
        columns = zip(*made) if made else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])


def search_batch(index: DataFrame, rows: list, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item_id, doc_id, score``: each task's best documents of the items in ``rows``."""
    batch = index.sparkSession.sparkContext.broadcast(Batch(rows))

    def run(batches):
        search = Search(batch.value, n_docs, n_terms, k)
        for part in batches:
            step = max(1, min(search.chunk_rows, part.num_rows * CHUNK_BYTES // max(1, part.nbytes)))
            for at in range(0, part.num_rows, step):
                search.chunk(part.slice(at, step))
        yield search.results()

    return map_arrow(index, run, "item_id long, doc_id long, score long")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    batch_terms: int = 8192,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    index = build_index(docs, doc_id, doc_text)
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n_terms")).first()
    asked = materialize(weighted_terms(index, items, n_docs, item_id, item_text).filter("weight > 0"), "asked")
    count = -(-asked.count() // batch_terms)
    dealt = asked.withColumn("batch", F.pmod(F.xxhash64("item_id"), F.lit(max(1, count))))
    found = [spark.createDataFrame([], "item_id long, doc_id long, score long")]
    for b in range(0, count, BATCHES_PER_PASS):
        rows = dealt.filter(F.col("batch").between(b, b + BATCHES_PER_PASS - 1)).collect()
        if rows:
            found.append(materialize(search_batch(index, rows, n_docs, n_terms, k), "found"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
