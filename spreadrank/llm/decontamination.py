"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Texts are cut into words of letters and digits, A-Z lower-cased. A window is ``window`` consecutive words of
an item, or all words of a shorter one. The automaton's symbols are words, so a text is scanned once, word
by word, and what matches is known by word place and mapped back to code points of the original.

The automaton is built in each Python worker from broadcast items; nothing is shuffled. Items with more than
``block_words`` words in all are dealt out over several blocks, longer items cut into pieces that share all but
one word of a window. Each block has its own pass over the documents, which writes them again with what was hit so far,
so driver and workers hold one block at a time, however large the benchmark is.

Null texts, documents' and items', have no words. Items that occur several times count once by id; an item
without an id makes words hit but is not listed. Each document row gives a row, whatever its id, so repeated rows
give repeated results; empty texts have no words, and very long ones are scanned whole, one at a time. Without documents the
result is empty, without items nothing is hit. A result column that is called like one of ``keep`` gets an underscore more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.common import fresh, lists, map_arrow, per_row, sliced
from spreadrank.storage import materialize

# Code points 0x30-0x39 and 0x61-0x7A and all from 0x80 on are parts of words, once A-Z are lower-cased.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
OTHER = "\0"
RUN = pa.struct([("first", pa.int64()), ("after", pa.int64())])
RUNS = "array<struct<first:long,after:long>>"


def words_of(text: str | None) -> list[bytes]:
    """The words, in UTF-8: every byte of a character beyond ASCII is 0x80 or more."""
    return (text or "").encode().translate(FOLDED).split()


class Windows:
    """The automaton over the windows of ``items``, pairs of id and text."""

    def __init__(self, items: list[tuple], window: int):
        self.symbols: dict[bytes, str] = {}
        found: dict[str, set] = {}
        for item, text in items:
            own = "".join(map(self._symbol, words_of(text)))
            for at in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(own[at : at + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for key, ids in found.items():
            self.automaton.add_word(key, (len(key), ids))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def _symbol(self, word: bytes) -> str:
        # One code point per word, past the surrogates, which no string may hold.
        return self.symbols.setdefault(word, chr(0xE000 + len(self.symbols)))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, set]]:
        """First word, word after the last, and items of each occurrence."""
        if self.empty:
            return []
        get = self.symbols.get
        text = "".join([get(w, OTHER) for w in words])
        return [(end + 1 - n, end + 1, ids) for end, (n, ids) in self.automaton.iter(text)]


@lru_cache(maxsize=1)
def _windows(items: tuple, window: int) -> Windows:
    return Windows(list(items), window)


def _spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans, end exclusive, of the runs of hit words."""
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def _pieces(items: DataFrame, window: int, block_words: int) -> DataFrame:
    """``item, words, n``: the items and their numbers of words; those longer than a block in pieces."""

    def run(batches):
        for batch in sliced(batches):
            made = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) <= max(window, block_words):
                    made.append((item, text, len(words)))
                    continue
                step = max(1, block_words - window + 1)
                for at in range(0, len(words) - window + 1, step):
                    own = words[at : min(at + step, len(words) - window + 1) + window - 1]
                    made.append((item, b" ".join(own).decode(), len(own)))
            columns = zip(*made) if made else ((), (), ())
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "words", "n"])

    return map_arrow(items, run, "item string, words string, n long")


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[tuple]:
    """The items, pairs of id and text, in blocks of at most ``block_words`` words or a window; one block at least."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("words"))
    items = items.filter(F.col("words").isNotNull()).distinct()
    held, size = [], 0
    for item, words, n in _pieces(items, window, block_words).filter("n > 0").orderBy("item", "words").toLocalIterator():
        if held and size + n > block_words:
            yield tuple(held)
            held, size = [], 0
        held.append((item, words))
        size += n
    yield tuple(held)


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_words: int = 500_000,
) -> DataFrame:
    """The columns ``keep`` and ``n_words, n_hit, items, spans`` of each row.

    ``n_hit`` counts the words inside occurrences of windows, ``items`` lists the ids they are from, as
    strings in order, ``spans`` gives the runs of hit words as (start, end) in code points.
    """
    context = df.sparkSession.sparkContext
    parts = blocks(benchmark, item_col, item_text_col, window, block_words)
    part, following = next(parts), next(parts, None)
    if following is None:
        return _last(df, keep, text_col, context.broadcast(part), window)
    # The text, what was hit so far and the columns to keep, where their names meet no others.
    none = F.array().cast(RUNS).alias("runs"), F.array().cast("array<string>").alias("items")
    rows = df.select(F.struct(*keep).alias("doc"), F.struct(F.col(text_col).alias("text"), *none).alias("seen"))
    while following is not None:
        sent = context.broadcast(part)
        marked = per_row(rows, ["doc", "seen"], "seen", f"runs {RUNS}, items array<string>", _marks(sent, window))
        seen = F.struct(F.col("seen.text").alias("text"), "runs", "items").alias("seen")
        rows = materialize(marked.select("doc", seen), "marked")
        sent.destroy()
        part, following = following, next(parts, None)
    new, kept = ("n_words", "n_hit", "items", "spans"), df.select(*keep)
    return _last(rows, ["doc"], "seen", context.broadcast(part), window).select(
        *[F.col("doc").getField(c).alias(c) for c in keep], *[F.col(c).alias(fresh(kept, c)) for c in new]
    )


def _hits(automaton: Windows, words: list[bytes], runs: list, items: list) -> tuple[list[tuple[int, int]], list[str]]:
    """The runs of words, end exclusive, and the ids hit, with those of earlier passes."""
    found = automaton.scan(words)
    if not found and not runs:
        return [], []
    edge = np.zeros(len(words) + 1, np.int64)
    for first, after, *_ in [*found, *((r["first"], r["after"]) for r in runs)]:
        edge[first] += 1
        edge[after] -= 1
    hit = (np.cumsum(edge[:-1]) > 0).astype(np.int8)
    ends = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])))).tolist()
    return list(zip(ends[::2], ends[1::2])), sorted(set(items).union(*(x[2] for x in found)) - {None})


def _marks(sent, window: int):
    """The work of all passes but the last."""

    def work():
        automaton = _windows(sent.value, window)

        def run(rows):
            made = [_hits(automaton, words_of(r["text"]), r["runs"], r["items"]) for r in rows]
            return [
                lists([[{"first": a, "after": b} for a, b in runs] for runs, _ in made], RUN),
                lists([ids for _, ids in made], pa.string()),
            ]

        return run

    return work


def _last(df: DataFrame, keep: list[str], value: str, sent, window: int) -> DataFrame:
    def work():
        automaton = _windows(sent.value, window)

        def run(values):
            n_words, n_hit, ids, spans = [], [], [], []
            for value in values:
                text, runs, items = (value["text"], value["runs"], value["items"]) if isinstance(value, dict) else (value, [], [])
                words = words_of(text)
                runs, items = _hits(automaton, words, runs, items)
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in runs))
                ids.append(items)
                spans.append([{"start": a, "end": b} for a, b in _spans(text, runs)] if runs else [])
            return [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                lists(ids, pa.string()),
                lists(spans, pa.struct([("start", pa.int64()), ("end", pa.int64())])),
            ]

        return run

    return per_row(
        df, keep, value, "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>", work
    )
