"""Byte-level BPE as a transducer: encoding, and decoding as a stream.

Merging by rank gives every prefix of a pre-token one result, and a list of tokens is the result for
its bytes exactly when each two neighbours are the result for theirs. So the last token of every prefix
can be told from the last tokens of shorter ones, and the merges compile into a finite-state transducer:
its state is each place where the unfinished end of the input may begin a longer token, with the tokens
chosen up to there. What all these choices share is emitted, so
a token leaves after a lookahead of at most the longest token. States are made when first reached, and
forgotten together when a piece begins and there are more than ``MAX_STATES`` of them; a piece adds a state a byte at most.

Decoding looks up the bytes of each id and feeds them, chunk by chunk, to an incremental UTF-8 decoder,
which keeps the bytes of an unfinished character between two chunks.

Null texts are encoded as empty, and empty texts have no ids. Very long texts are encoded whole, one at a time. Each row gives a
row, whatever its id, and repeated rows give repeated results; columns not asked for are not read. An empty table gives an
empty result. A result column that is called like one of ``keep`` gets an underscore more.
"""

from __future__ import annotations

import base64
import codecs
import gc
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spreadrank.llm.common import held, per_row

#: States and whole pieces a worker remembers. That many take some 450 MB; a fifth of them 150 MB, at
#: about twice the time on text with as many rare words as there are frequent ones.
MAX_STATES, MAX_PIECES = 300_000, 600_000
MAX_PAIRS = 150_000
MAX_KEPT_PIECE = 32
DECODE_CHUNK = 65_536
NEVER = 1 << 62
NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[bytes]:
    """Merge the neighbours of lowest rank, the leftmost of equals, while there are any ranked ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NEVER))
        if ranks.get(parts[best] + parts[best + 1], NEVER) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def packed(ids) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class Transducer:
    """Tokens are known by their ranks, unfinished tokens by their node in the vocabulary's trie, and states by
    number. A state is, for each place where the unfinished end may begin a token, longest first, the node and
    the tokens chosen up to there since the last one emitted, and that last one where it still matters. Thousands
    of states are kept, so each is one string of numbers."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.trie: dict[int, int] = {}
        self.rank_at, self.inner = [NONE], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                if (below := self.trie.get(node << 8 | byte)) is None:
                    below = self.trie[node << 8 | byte] = len(self.rank_at)
                    self.rank_at.append(NONE)
                    self.inner.append(False)
                node = below
            self.rank_at[node] = rank
        self.edges: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.clear()

    def clear(self) -> None:
        self.pairs: dict[tuple[int, int], bool] = {}
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        # By state << 8 | byte: the next state times two, plus one where something is emitted; and what.
        self.next: dict[int, int] = {}
        self.out: dict[int, bytes] = {}
        # What is left to emit if the input ends in a state.
        self.rest: dict[int, bytes] = {}
        self.state([(0, ())], NONE)

    def state(self, starts: list[tuple[int, tuple]], last: int) -> int:
        numbers = [last]
        for node, path in starts:
            numbers += (node, len(path), *path)
        key = array("i", numbers).tobytes()
        if (found := self.numbers.get(key)) is None:
            found = self.numbers[key] = len(self.states)
            self.states.append(key)
        return found

    def starts(self, state: int) -> tuple[list[tuple[int, tuple]], int]:
        numbers, at, found = array("i", self.states[state]), 1, []
        while at < len(numbers):
            end = at + 2 + numbers[at + 1]
            found.append((numbers[at], tuple(numbers[at + 2 : end])))
            at = end
        return found, numbers[0]

    def edge(self, rank: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at the left (0) or right (-1) end of a token while it is being merged,
        each with the rank of the merge that uses it up. Empty if merging does not make the token."""
        if (found := self.edges.get((rank, side))) is None:
            found, used, part = [], NEVER, self.tokens[rank]
            while True:
                found.append((part, used))
                if len(part) == 1:
                    break
                used = self.ranks[part]
                halves = merge(part, self.ranks, used)
                if len(halves) != 2:
                    found = []
                    break
                part = halves[side]
            self.edges[rank, side] = found
        return found

    def follows(self, last: int, rank: int) -> bool:
        """Whether merging leaves the two side by side: no merge across their border comes before the
        merges that use up its two sides. Of equal ranks the left one comes first."""
        right = self.edge(rank, 0)
        if last == NONE or not right:
            return bool(right)
        known = self.ranks
        for a, before in self.edge(last, -1):
            for b, until in right:
                across = known.get(a + b, NEVER)
                if across < before and across <= until:
                    return False
        return True

    def step(self, state: int, byte: int) -> int:
        """Work out the entry of ``next``, and of ``out``, for a state and a byte."""
        trie, here, paths = self.trie, None, []
        starts, last = self.starts(state)
        for node, path in starts:
            below = trie.get(node << 8 | byte)
            if below is None:
                continue
            if here is None and (rank := self.rank_at[below]) != NONE:
                pair = (path[-1] if path else last, rank)
                if (fits := self.pairs.get(pair)) is None:
                    if len(self.pairs) >= MAX_PAIRS:
                        self.pairs.clear()
                    fits = self.pairs[pair] = self.follows(*pair)
                if fits:
                    here = (*path, rank)
            if self.inner[below]:
                paths.append((below, path))
        if here is None:
            raise ValueError("the vocabulary has no token for a byte")
        shared = len(here)
        for _, path in paths:
            shared = min(shared, len(path))
            while path[:shared] != here[:shared]:
                shared -= 1
        paths.append((0, here))
        key = state << 8 | byte
        if shared:
            paths = [(node, path[shared:]) for node, path in paths]
            last = here[shared - 1]
            self.out[key] = packed(here[:shared])
        kept = last if any(not path for _, path in paths) else NONE
        found = self.next[key] = self.state(paths, kept) << 1 | bool(shared)
        return found

    def encode(self, piece: bytes) -> bytes:
        if (whole := self.ranks.get(piece)) is not None:
            return whole.to_bytes(4, "little")
        if len(self.states) > self.max_states:
            self.clear()
        known, out, state, ids = self.next, self.out, 0, []
        for byte in piece:
            key = state << 8 | byte
            step = known.get(key)
            if step is None:
                step = self.step(state, byte)
            if step & 1:
                ids.append(out[key])
            state = step >> 1
        if (rest := self.rest.get(state)) is None:
            rest = self.rest[state] = packed(self.starts(state)[0][-1][1])
        ids.append(rest)
        return b"".join(ids)


class Codec:
    """Encodes texts match by match, and decodes ids."""

    def __init__(self, path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        self.ranks, self.cut = read_ranks(path), regex.compile(pattern)
        self.max_states, self.max_pieces = max_states, max_pieces
        self.known: dict[str, bytes] = {}
        self.transducer: Transducer | None = None
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> bytes:
        pieces = self.cut.findall(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self.piece(p) if ids is None else ids for p, ids in zip(pieces, found)]
        return b"".join(found)

    def piece(self, piece: str) -> bytes:
        if (ids := self.known.get(piece)) is None:
            if self.transducer is None:
                self.transducer = Transducer(self.ranks, self.max_states)
            ids = self.transducer.encode(piece.encode())
            if len(piece) <= MAX_KEPT_PIECE:
                if len(self.known) >= self.max_pieces:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def decode(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """The bytes, and whether they are UTF-8. Ids beyond the vocabulary raise IndexError."""
        decoder, parts, clean = codecs.getincrementaldecoder("utf-8")(), [], True
        for at in range(0, len(ids), DECODE_CHUNK):
            parts.append(b"".join(map(self.tokens.__getitem__, ids[at : at + DECODE_CHUNK].tolist())))
            clean = clean and _feeds(decoder, parts[-1], False)
        return b"".join(parts), clean and _feeds(decoder, b"", True)


def _feeds(decoder: codecs.IncrementalDecoder, chunk: bytes, final: bool) -> bool:
    try:
        decoder.decode(chunk, final)
    except UnicodeDecodeError:
        return False
    return True


def codec(path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> Codec:
    # The tables are a great many objects that stay; looking through them for garbage is in vain.
    gc.set_threshold(100_000, 20, 100)

    def make() -> Codec:
        return Codec(path, pattern, max_states, max_pieces)

    return held(f"{path} {pattern} {max_states} {max_pieces}", make)


def encode(df: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, and ``n_tokens, ids``: the ids as little-endian unsigned 32-bit integers."""

    def work():
        own = codec(path, pattern)

        def run(texts):
            made = [own.encode(t or "") for t in texts]
            return [pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(made, pa.binary())]

        return run

    return per_row(df, keep, text_col, "n_tokens long, ids binary", work)


def decode(df: DataFrame, path: str, pattern: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep``, and ``decoded, valid_utf8`` for ids as ``encode`` writes them; null ids are none."""

    def work():
        own = codec(path, pattern)

        def run(values):
            made = [own.decode(np.frombuffer(v or b"", dtype="<u4")) for v in values]
            return [pa.array([b for b, _ in made], pa.binary()), pa.array([v for _, v in made], pa.bool_())]

        return run

    return per_row(df, keep, ids_col, "decoded binary, valid_utf8 boolean", work)


def encode_and_decode(
    df: DataFrame,
    path: str,
    pattern: str,
    keep: list[str],
    text_col: str = "text",
    max_states: int = MAX_STATES,
    max_pieces: int = MAX_PIECES,
) -> DataFrame:
    """The columns ``keep`` and ``n_tokens, ids, decoded, valid_utf8``: both steps in one pass over the rows, which
    spares sending the ids out of the workers and back."""

    def work():
        own = codec(path, pattern, max_states, max_pieces)

        def run(texts):
            ids = [own.encode(t or "") for t in texts]
            made = [own.decode(np.frombuffer(i, dtype="<u4")) for i in ids]
            return [
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array([b for b, _ in made], pa.binary()),
                pa.array([v for _, v in made], pa.bool_()),
            ]

        return run

    return per_row(df, keep, text_col, "n_tokens long, ids binary, decoded binary, valid_utf8 boolean", work)
