"""The contracts of the queries, written down as plainly as possible, over rows of a small table."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer


def token_counts(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, text in docs:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        yield doc_id, len((text or "").encode()), n, n > 2048


def byte_bpe(docs):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        packed = b"".join(struct.pack("<I", i) for i in ids)
        yield doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def decontamination(docs, items, window=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for item, text in items:
        words = word.findall(lower(text or ""))
        for at in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[at : at + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        words = word.findall(lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                if ids := windows.get(tuple(words[at : at + size])):
                    hit.update(range(at, at + size))
                    found |= ids
        listed = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        yield doc_id, len(words), len(hit), len(listed), digest, bool(hit)


def base_secrets(docs):
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for doc_id, text in docs:
        text = text or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.A) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spans.sort()
        joined = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
        count = [sum(s[1] == k for s in spans) for k in range(3)]
        yield doc_id, *count, hashlib.sha256(joined.encode()).hexdigest(), joined


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def language(docs, size=300):
    """Rows (doc_id, text, lang); plain strings and dictionaries for the profiles."""
    from collections import Counter

    def grams(text):
        kept = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
        kept = " " + " ".join(kept.split()) + " "
        if not kept.strip():
            return Counter()
        return Counter(
            kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1) if kept[i : i + n] != " "
        )

    def ranked(counts):
        order = sorted(counts, key=lambda g: (-counts[g], sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))))
        return order[:size]

    learned = {}
    for doc_id, text, lang in docs:
        if lang and text is not None and doc_id is not None and not held_out(doc_id):
            learned.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in learned.items()}
    for doc_id, text, _ in docs:
        own = ranked(grams(text))
        if not own or not profiles:
            yield doc_id, held_out(doc_id), "und", 0.0
            continue
        far = {
            lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()
        }
        best = min(sorted(far), key=far.get)
        yield doc_id, held_out(doc_id), best, 1 - far[best] / (size * len(own))


def warc(pages):
    """Rows (page_id, html)."""
    last = {}
    for page_id, html in pages:
        last[html or ""] = max(last.get(html or "", page_id), page_id)
    for page_id, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = last[html or ""] == page_id
        yield page_id, len(data), digest, "response" if first else "revisit", None if first else last[html or ""]


def near_duplicates(docs, words=2, threshold=80):
    """All pairs that share a shingle."""
    from collections import Counter, defaultdict

    word = re.compile("[^\x20\x09-\x0d]+")
    sets, posting = [], defaultdict(list)
    for at, (_, text) in enumerate(docs):
        found = word.findall(lower(text or ""))
        own = {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
        sets.append(own)
        for s in own:
            posting[s].append(at)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for at, own in enumerate(sets):
        shared = Counter(other for s in own for other in posting[s] if other < at)
        for other, n in shared.items():
            if 100 * n >= threshold * (len(own) + len(sets[other]) - n):
                root[find(at)] = find(other)
    least = {}
    for at, (doc_id, _) in enumerate(docs):
        least[find(at)] = min(least.get(find(at), doc_id), doc_id)
    for at, (doc_id, _) in enumerate(docs):
        yield doc_id, len(sets[at]), least[find(at)], doc_id == least[find(at)]
