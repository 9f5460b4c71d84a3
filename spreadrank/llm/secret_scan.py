"""Secret scanning: fixed patterns, and character Markov models for random strings.

One scan finds, per text, the secrets of the fixed patterns and the candidates: long runs of characters that
keys are made of, outside those secrets. A candidate is a secret when the log-likelihood ratio of its pairs of characters,
random string against ordinary identifier, is at least ``limit`` on average, so the limit means the same at every length.

Both models are trained from labelled samples. Random strings are ``SAMPLES`` draws from the alphabets in which keys are
written. Ordinary identifiers are ``SAMPLES`` names, paths, numbers, dates and rules, put together in the usual styles from
``SAMPLE_WORDS`` of the corpus's own words (those of least digest, so they do not depend on the layout); half of their model is
the pairs of characters in all runs of all documents that are too short to be candidates. Candidates train nothing. Every second sample is
held out, and the limit is what all but ``MAX_FALSE`` of the held-out identifiers stay below, ``LEAST_LIMIT`` at least.

Null texts count as empty, and empty texts have no spans. Very long texts are scanned whole, one at a time, and a long run is judged
as one candidate. Each row gives a row, whatever its id, also rows that are repeated; other columns are not read, and ``redact``
passes on those that are asked for (a result column that is called like one of them gets an underscore more). Of spans that start together the one listed
first in ``KINDS`` comes first. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.common import lists, map_arrow, per_row, sliced, type_of
from spreadrank.storage import materialize

# The patterns and least lengths that define a base secret, in the order of their kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# The alphabets of random strings.
KEY_ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
)
SAMPLES = 20_000
SAMPLE_WORDS = 2_000
MAX_FALSE = 0.001
LEAST_LIMIT = 1.2

PRIOR = 20.0
EDGE = len(ALPHABET)
WIDTH = EDGE + 1
CODES = np.full(256, EDGE, np.uint8)
CODES[list(ALPHABET.encode())] = np.arange(EDGE)

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run is matched whole from its start, so a least length in the pattern drops just the short runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)

SPANS = "array<struct<start:int,end:int,kind:string>>"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, end, kind`` (place in KINDS) of the base secrets, in order of start and kind."""
    found = [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(*m.span(), 1) for m in _ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of the text that no span covers."""
    parts, at = [], 0
    for start, end, _ in spans:
        if start > at:
            parts.append((at, start))
        at = max(at, end)
    return [*parts, (at, len(text))] if at < len(text) else parts


def _pairs(text: str) -> np.ndarray:
    """Codes of neighbouring characters, as one number each, with an edge before and after."""
    codes = CODES[np.frombuffer(b"\0" + text.encode("utf-8", "replace") + b"\0", np.uint8)].astype(np.int32)
    return codes[:-1] * WIDTH + codes[1:]


class LeastWords:
    """The ``size`` words of least digest among all that are shown."""

    def __init__(self, size: int):
        self.size, self.kept, self.heap = size, set(), []

    def add(self, words: set[str]) -> None:
        for word in words - self.kept:
            key = -zlib.crc32(word.encode()), word
            if len(self.heap) < self.size:
                heapq.heappush(self.heap, key)
            elif key > self.heap[0]:
                self.kept.discard(heapq.heapreplace(self.heap, key)[1])
            else:
                continue
            self.kept.add(word)


def _scan(df: DataFrame, id_col: str, text_col: str, min_candidate: int) -> DataFrame:
    """A row per document, and for each task rows of pair counts (``_pair`` not null) and words (``_word`` not null)."""
    kind = type_of(df, id_col)
    candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min_candidate)
    word = re.compile(r"(?<![A-Za-z])[A-Za-z]{3,12}(?![A-Za-z])")

    def run(batches):
        counts, words = np.zeros(WIDTH * WIDTH, np.int64), LeastWords(SAMPLE_WORDS)
        schema = None
        for batch in sliced(batches):
            schema = batch.schema.field(0).type
            base, more = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans, free = base_spans(text), []
                for start, end in _outside(text, spans):
                    free += [(m.start(), m.end()) for m in candidate.finditer(text, start, end)]
                for start, end in _outside(text, sorted([*spans, *((a, b, 3) for a, b in free)])):
                    piece = text[start:end]
                    counts += np.bincount(_pairs(piece), minlength=WIDTH * WIDTH)
                    words.add(set(word.findall(piece)))
                base.append([{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in spans])
                more.append([{"start": a, "end": b, "value": text[a:b]} for a, b in free])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    lists(base, SPAN),
                    lists(more, CANDIDATE),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.string()),
                ],
                names=names,
            )
        pair, kept = np.nonzero(counts)[0], sorted(words.kept)
        n = len(pair) + len(kept)
        if schema is not None and n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, schema),
                    pa.nulls(n, pa.list_(SPAN)),
                    pa.nulls(n, pa.list_(CANDIDATE)),
                    pa.array([*pair.tolist(), *[None] * len(kept)], pa.int32()),
                    pa.array([*counts[pair].tolist(), *[None] * len(kept)], pa.int64()),
                    pa.array([*[None] * len(pair), *kept], pa.string()),
                ],
                names=names,
            )

    names = [id_col, "_base", "_more", "_pair", "_n", "_word"]
    return map_arrow(
        df.select(id_col, text_col),
        run,
        f"`{id_col}` {kind}, _base {SPANS}, _more array<struct<start:int,end:int,value:string>>, _pair int, _n long, _word string",
    )


def key_samples(number: int, seed: int = 0) -> list[str]:
    """Labelled random strings of 16 to 40 characters, the alphabets in turn."""
    rnd = random.Random(seed)
    return ["".join(rnd.choices(KEY_ALPHABETS[i % len(KEY_ALPHABETS)], k=rnd.randint(16, 40))) for i in range(number)]


def identifier_samples(words: list[str], number: int, min_length: int, seed: int = 1) -> list[str]:
    """Labelled ordinary identifiers of ``min_length`` characters or a few more, the styles in turn. Without words
    they are numbers, dates and rules only."""
    rnd = random.Random(seed)

    def digits(least: int, most: int) -> str:
        return "".join(rnd.choices("0123456789", k=rnd.randint(least, most)))

    def date() -> str:
        joint = rnd.choice(("-", "/", ""))
        return joint.join((f"{rnd.randint(1900, 2099)}", f"{rnd.randint(1, 12):02}", f"{rnd.randint(1, 28):02}"))

    def named(joint: str, case) -> str:
        made = case(rnd.choice(words))
        while len(made) < min_length:
            more = rnd.choice(words) if rnd.random() < 0.9 else digits(1, 4)
            made += joint + case(more)
        return made + (joint + digits(1, 4) if rnd.random() < 0.2 else "")

    def filled(part, joint: str) -> str:
        made = part()
        while len(made) < min_length:
            made += joint + part()
        return made

    plain = [
        lambda: digits(min_length, min_length + 16),
        lambda: "".join(str((start + i) % 10) for start in [rnd.randint(0, 9)] for i in range(rnd.randint(min_length, min_length + 8))),
        lambda: filled(date, rnd.choice("-_/=")),
        lambda: filled(lambda: digits(1, 5), rnd.choice("-_/+=")),
        lambda: rnd.choice("-_=+/") * rnd.randint(min_length, 4 * min_length),
        lambda: rnd.choice(ALPHABET) * rnd.randint(min_length, 2 * min_length),
    ]
    styles = [
        lambda: named("_", str.lower),
        lambda: named("-", str.lower),
        lambda: named("/", str.lower),
        lambda: named("", str.lower),
        lambda: named("", str.capitalize),
        lambda: named("_", str.upper),
        lambda: named("-", str.capitalize),
        lambda: named(rnd.choice("=+"), str.lower),
        lambda: filled(lambda: rnd.choice((date, lambda: rnd.choice(words).lower()))(), rnd.choice("-_/")),
        lambda: named("", str.capitalize)[0].lower() + named("", str.capitalize)[1:],
    ]
    made = [*styles, *plain] if words else plain
    return [made[i % len(made)]() for i in range(number)]


def _chances(counts: np.ndarray) -> np.ndarray:
    """Of each character after each other: smoothed by ``PRIOR`` of the characters overall, and those by one each."""
    single = counts.sum(axis=0) + 1.0
    return (counts + PRIOR * single / single.sum()) / (counts.sum(axis=1, keepdims=True) + PRIOR)


def _counted(samples: list[str]) -> np.ndarray:
    counts = np.zeros(WIDTH * WIDTH)
    for value in samples:
        counts += np.bincount(_pairs(value), minlength=WIDTH * WIDTH)
    return counts.reshape(WIDTH, WIDTH)


class Models:
    """The log-likelihood ratio of each pair of characters, and the limit from the held-out samples."""

    def __init__(self, corpus: np.ndarray, words: list[str], min_candidate: int, limit: float | None = None):
        ordinary, keys = identifier_samples(words, SAMPLES, min_candidate), key_samples(SAMPLES)
        corpus = corpus.reshape(WIDTH, WIDTH).copy()
        corpus[EDGE, EDGE] = 0
        # The styles and the alphabets come in turn: halves, so that both have all of them.
        half = SAMPLES // 2
        likely = 0.5 * _chances(corpus) + 0.5 * _chances(_counted(ordinary[:half]))
        self.table = (np.log(_chances(_counted(keys[:half]))) - np.log(likely)).ravel()
        if limit is None:
            limit = max(LEAST_LIMIT, float(np.quantile([self.ratio(v) for v in ordinary[half:]], 1 - MAX_FALSE)))
        self.limit = limit
        self.recall = float(np.mean([self.is_secret(v) for v in keys[half:]]))

    def ratio(self, value: str) -> float:
        """Mean over the value's pairs of characters, those with its ends included."""
        return float(self.table[_pairs(value)].mean())

    def is_secret(self, value: str) -> bool:
        return self.ratio(value) >= self.limit


def learn(scanned: DataFrame, min_candidate: int, limit: float | None) -> Models:
    """From all pair counts, at most 68 x 68 rows, and the ``SAMPLE_WORDS`` words of least digest."""
    counts = np.zeros(WIDTH * WIDTH)
    for row in scanned.filter("_pair is not null").groupBy("_pair").agg(F.sum("_n").alias("n")).collect():
        counts[row["_pair"]] = row["n"]
    words = scanned.filter("_word is not null").select("_word").distinct()
    least = words.orderBy(F.crc32(F.col("_word").cast("binary")), F.desc("_word")).limit(SAMPLE_WORDS).collect()
    return Models(counts, [r["_word"] for r in least], min_candidate, limit)


def scan_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_candidate: int = 16,
    limit: float | None = None,
) -> DataFrame:
    """``id, base, spans`` of each row: arrays of (start, end, kind), in code points, end exclusive, in
    order of start and kind. ``base`` has what the fixed patterns find, ``spans`` also what the models add. ``limit`` is
    the least mean ratio of a secret, by default what the held-out samples give."""
    scanned = materialize(_scan(df, id_col, text_col, min_candidate), "secrets")
    model = df.sparkSession.sparkContext.broadcast(learn(scanned, min_candidate, limit))

    def run(batches):
        models = model.value
        for batch in batches:
            spans = []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = [
                    {"start": c["start"], "end": c["end"], "kind": KINDS[3]}
                    for c in more
                    if models.is_secret(c["value"])
                ]
                both = base + found
                spans.append(sorted(both, key=lambda s: (s["start"], KINDS.index(s["kind"]))) if found else base)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(spans, SPAN)], names=names)

    names = [id_col, "base", "spans"]
    docs = scanned.filter("_pair is null and _word is null").select(id_col, "_base", "_more")
    return map_arrow(docs, run, f"`{id_col}` {type_of(df, id_col)}, base {SPANS}, spans {SPANS}")


def redact(
    df: DataFrame,
    keep: list[str],
    text_col: str = "text",
    mark: str = "[SECRET]",
    min_candidate: int = 16,
    limit: float | None = None,
) -> DataFrame:
    """The columns ``keep`` and ``redacted, n_secrets`` of each row: the text with every secret replaced by ``mark``
    (null stays null). The models are learned as in ``scan_secrets``; the text is scanned a second time, so that
    it need not be written out in between."""
    one = df.select(F.lit(0).alias("none"), text_col)
    scanned = materialize(_scan(one, "none", text_col, min_candidate).filter("_pair is not null or _word is not null"), "pairs")
    model = df.sparkSession.sparkContext.broadcast(learn(scanned, min_candidate, limit))
    candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min_candidate)

    def work():
        models = model.value

        def run(texts):
            made, counts = [], []
            for text in texts:
                spans = base_spans(text or "")
                for start, end in _outside(text or "", spans):
                    for m in candidate.finditer(text, start, end):
                        if models.is_secret(m[0]):
                            spans.append((*m.span(), 3))
                counts.append(len(spans))
                if spans:
                    kept = _outside(text, sorted(spans))
                    text = _joined(text, kept, mark)
                made.append(text)
            return [pa.array(made, pa.string()), pa.array(counts, pa.int64())]

        return run

    return per_row(df, keep, text_col, "redacted string, n_secrets long", work)


def _joined(text: str, kept: list[tuple[int, int]], mark: str) -> str:
    """The kept parts, with one mark for each gap."""
    out, at = [], 0
    for start, end in kept:
        if start > at:
            out.append(mark)
        out.append(text[start:end])
        at = end
    return "".join([*out, mark] if at < len(text) else out)
