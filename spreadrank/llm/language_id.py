"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a text's most frequent n-grams. A document's profile is compared with each
language's by the out-of-place distance: the sum, over its n-grams, of how far apart the two ranks are, or the
profile's length where the language does not have the n-gram. The nearest language wins, of equals the
first by name; the score is 1 - distance / greatest possible distance.

N-grams have one to three characters of lower-cased letters, each word with a blank on either side. Three
code points fit into 63 bits, so an n-gram is a number and equal numbers are equal n-grams. Ties in
frequency go to the smaller number. Profiles are learned from all documents of the training
table, by counts added up over the cluster; a profile has ``size`` n-grams and there are at most
``max_langs`` of them, which bounds what is collected and broadcast.

A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned. Rows
with a null or empty language or text are not learned from. Each row gives a row, whatever its id, and repeated rows
count as often as they occur. Very long texts count as a whole; their n-grams are held at once, some 40 bytes a character. An
empty table gives an empty result. A result column that is called like one of ``keep`` gets an underscore more.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.llm.common import held, map_arrow, per_row, sliced

UNKNOWN = "und"
BLANK = 0x20
BITS = 21


def letters() -> np.ndarray:
    return held("letters", _letters)


def _letters() -> np.ndarray:
    """Lower case of each letter by code point, a blank for all else."""
    table = np.full(sys.maxunicode + 1, BLANK, np.uint32)
    for code in range(sys.maxunicode + 1):
        if (char := chr(code)).isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, ascending, and how often each occurs."""
    codes = letters()[np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "replace"), "<u4")]
    blank = codes == BLANK
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.int64)
    if len(codes) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (codes[:-1] << BITS) | codes[1:]
    three = (two[:-1] << BITS) | codes[2:]
    return np.unique(np.concatenate((codes[codes != BLANK], two, three)), return_counts=True)


def top(found: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The n-grams in order of rank; ``found`` ascends, so a stable sort settles ties."""
    return found[np.argsort(-counts, kind="stable")[:size]]


def learn(df: DataFrame, text_col: str, lang_col: str, size: int = 300, max_langs: int = 1000) -> DataFrame:
    """``lang, gram, place``: the profile of each language, places from 0."""

    def run(batches):
        for batch in sliced(batches):
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(grams(text))
            for lang, made in by_lang.items():
                found, at = np.unique(np.concatenate([g for g, _ in made]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in made]), minlength=len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    labelled = df.filter(F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), text_col)
    counted = map_arrow(labelled, run, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Tasks keep their own first rows only, if the number itself is what is filtered.
    ranked = summed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    profiles = ranked.select("lang", "gram", (F.col("place") - 1).alias("place")).limit(size * max_langs + 1)
    return profiles


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
        # The place of each n-gram in each language; where it has none, a place too far to be right.
        self.places = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for lang, gram, place in rows:
            self.places[self.langs.index(lang), np.searchsorted(self.grams, gram)] = place

    def judge(self, text: str | None) -> tuple[str, float]:
        own = top(*grams(text), self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own).clip(max=len(self.grams) - 1)
        places = np.where(self.grams[at] == own, self.places[:, at], -1)
        apart = np.where(places >= 0, np.abs(places - np.arange(len(own))), self.size)
        distance = apart.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(own))


def identify(
    df: DataFrame, profiles: DataFrame, keep: list[str], text_col: str = "text", size: int = 300, max_langs: int = 1000
) -> DataFrame:
    """The columns ``keep`` and ``lang_pred, score`` of each row."""
    rows = [(r.lang, r.gram, r.place) for r in profiles.collect()]
    if len(rows) > size * max_langs:
        raise ValueError(f"more than {max_langs} languages")
    sent = df.sparkSession.sparkContext.broadcast(Profiles(rows, size))

    def work():
        known = sent.value

        def run(texts):
            made = [known.judge(t) for t in texts]
            return [pa.array([a for a, _ in made], pa.string()), pa.array([b for _, b in made], pa.float64())]

        return run

    return per_row(df, keep, text_col, "lang_pred string, score double", work)


def in_training(id_col: str) -> F.Column:
    """Two of three ids, by a checksum of the id's text; a null id is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
