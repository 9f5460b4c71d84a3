"""Token counts of whole texts, without making token ids.

The tokenizer cuts a text into pre-tokens and the number of pieces of a pre-token does not depend on
its neighbours. So one scan gives the pre-token frequencies of every document, the pieces of a distinct
pre-token are counted once, and a join and a sum give the counts.

Frequent pre-tokens would be hot keys of that join. The most frequent ones of a bounded sample of
documents (``head_docs``, ``head_size``: bounds, not switches) are counted first and joined in the scan
itself, from a broadcast of at most ``head_size`` short strings. The others, a small part of all
occurrences, are joined by a shuffle. Which way a pre-token goes changes no result.

Null texts count as empty. Rows are counted one by one, whatever their ids: repeated rows give repeated
results, null ids stay null. Columns other than id and text are not read, so their names do no harm. Very long texts are cut
into pre-tokens whole, one at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spreadrank.llm.common import held, lists, map_arrow, per_row
from spreadrank.storage import materialize

# Fixed value: how the tokenizer of lower-case words cuts normalised text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Below this code point lower-casing and classes are the same in all Unicode versions, and text is in NFC.
PLAIN_BELOW = "ɐ"
MAX_HEAD_CHARS = 64


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PreTokens:
    """Cuts texts into pre-tokens and counts the pieces of a pre-token, as the library does."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.to_char = byte_alphabet()
        self.to_byte = {c: b for b, c in self.to_char.items()}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.foreign = re.compile(f"[{PLAIN_BELOW}-\U0010ffff]")
        self.cut = regex.compile(PRE_TOKEN.replace(r"\s", r"\t-\r\x20\x85\xa0"))

    def of(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special tokens stand between them."""
        if not self.special.search(text):
            return self._plain(text), 0
        words: list[str] = []
        parts = self.special.split(text)
        for part in parts:
            words += self._plain(part)
        return words, len(parts) - 1

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not self.foreign.search(text):
            return self.cut.findall(text.lower())
        t = self.tokenizer
        made = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        return [bytes(map(self.to_byte.__getitem__, word)).decode("utf-8", "surrogateescape") for word, _ in made]

    def pieces(self, word: str) -> int:
        shown = "".join(map(self.to_char.__getitem__, word.encode("utf-8", "surrogateescape")))
        return len(self.tokenizer.model.tokenize(shown))


def pre_tokens(path: str) -> PreTokens:
    def make() -> PreTokens:
        return PreTokens(path)

    return held(path, make)


def _counted(words: DataFrame, path: str) -> DataFrame:
    """``word, pieces`` for each row of the table ``word``."""

    def run(batches):
        cutter = pre_tokens(path)
        for batch in batches:
            n = [cutter.pieces(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["word", "pieces"])

    return map_arrow(words, run, "word string, pieces long")


def frequent_words(df: DataFrame, path: str, text: str, head_docs: int, head_size: int) -> dict[str, int]:
    """Pieces of at most ``head_size`` pre-tokens, the ones in most documents of a sample."""

    def work():
        cutter = pre_tokens(path)

        def run(texts):
            seen: Counter = Counter()
            for value in texts:
                seen.update({w for w in cutter.of(value or "")[0] if len(w) <= MAX_HEAD_CHARS})
            rows = [list(seen)] + [[]] * (len(texts) - 1)
            counts = [list(seen.values())] + [[]] * (len(texts) - 1)
            return [lists(rows, pa.string()), lists(counts, pa.int64())]

        return run

    share = min(1.0, head_docs / max(1, df.count()))
    sample = (df if share == 1.0 else df.sample(share, seed=1)).select(F.lit(0).alias("one"), text)
    seen = per_row(sample, ["one"], text, "words array<string>, n array<long>", work)
    seen = seen.select(F.explode(F.arrays_zip("words", "n")).alias("w")).groupBy(F.col("w.words").alias("word"))
    best = seen.agg(F.sum("w.n").alias("n")).orderBy(F.desc("n"), "word").limit(head_size).select("word")
    return {r.word: r.pieces for r in _counted(best, path).collect()}


def token_counts(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_docs: int = 10_000,
    head_size: int = 100_000,
) -> DataFrame:
    """``id, n_bytes, n_tokens`` of every row; ``path`` is the tokenizer's file on every machine."""
    head = df.sparkSession.sparkContext.broadcast(frequent_words(df, path, text_col, head_docs, head_size))

    def work():
        cutter, known = pre_tokens(path), head.value

        def run(texts):
            size, total, words, counts = [], [], [], []
            for value in texts:
                value = value or ""
                found, n = cutter.of(value)
                rest, times = [], []
                for word, count in Counter(found).items():
                    if (pieces := known.get(word)) is None:
                        rest.append(word)
                        times.append(count)
                    else:
                        n += pieces * count
                size.append(len(value.encode()))
                total.append(n)
                words.append(rest)
                counts.append(times)
            return [
                pa.array(size, pa.int64()),
                pa.array(total, pa.int64()),
                lists(words, pa.string()),
                lists(counts, pa.int32()),
            ]

        return run

    scanned = per_row(df, [id_col], text_col, "n_bytes long, head long, words array<string>, times array<int>", work)
    docs = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "pretokens")
    rare = docs.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    rare = rare.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    pieces = _counted(rare.select("word").distinct(), path)
    sums = rare.join(pieces, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("tail"))
    return docs.join(sums, "row", "left").select(
        id_col, "n_bytes", (F.col("head") + F.coalesce("tail", F.lit(0))).alias("n_tokens")
    )
