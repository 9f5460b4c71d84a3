"""Hard negatives and ranked search against plain Python, with nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadrank.llm import hard_negatives, language_id, ranked_search, url_filter
from spreadrank.llm.hard_negatives import Goal, Tile, best_first, str_order

SF_DIR = "/root/testdata/sf0.01"


def brute_negatives(rows, every, low=50, high=95, n_positive=5, n_negative=3):
    """``rows`` are (id, label, whole numbers)."""
    made = []
    for a, a_label, a_vector in rows:
        if a % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(a_vector, v)), i, label == a_label)
            for i, label, v in rows
            if i != a and len(v) == len(a_vector)
        ]
        for negated, positive, _ in sorted(s for s in scored if s[2])[:n_positive]:
            p = -negated
            inside = sorted(s for s in scored if not s[2] and low * p <= -100 * s[0] <= high * p)
            made += [(a, positive, rank, s[1], p, -s[0]) for rank, s in enumerate(inside[:n_negative], 1)]
    return Counter(made)


NAMES = "vec_id long, embedding array<double>, label int, id long, tile long, number int, windows string, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, "w", 4) for i, v, label in rows], NAMES)


def mined(df, every=5, **settings):
    made = hard_negatives.hard_negatives(df, F.col("id") % every == 0, **settings)
    return Counter(map(tuple, made.collect()))


@pytest.mark.parametrize("tile_rows", [40, 8192])
def test_hard_negatives_of_odd_rows(spark, tile_rows):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.2, 1) for _ in range(6)], rng.randrange(3)) for i in range(150)]
    # Ties, a third of all rows alike, another length, negative scores only, and rows that take no part.
    rows += [(200 + i, [0.5, 0.25, 0.0, -0.5, 1.0, 0.0], i % 2) for i in range(80)]
    rows += [(300 + i, [rng.random(), -rng.random()], i % 2) for i in range(20)]
    rows += [(350, [-1.0, 0.0, 0.0], 0), (355, [1.0, 0.0, 0.0], 0), (356, [1.0, 0.0, 0.0], 1)]
    sound = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows]
    odd = [
        (None, [1.0] * 6, 1),
        (400, None, 1),
        (405, [1.0] * 6, None),
        (410, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
        (415, [float("nan")] * 6, 1),
        (420, [float("inf")] * 6, 1),
        (425, [], 1),
    ]
    made = mined(vectors(spark, rows + odd + rows[:30]), tile_rows=tile_rows)
    assert made == brute_negatives(sound, 5)
    assert len(made) > 100


def test_hard_negatives_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() * 2.0**22 for _ in range(4)], i % 2) for i in range(40)]
    sound = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows]
    assert mined(vectors(spark, rows)) == brute_negatives(sound, 5)


def test_hard_negatives_of_little(spark):
    assert mined(vectors(spark, [])) == Counter()
    assert mined(vectors(spark, [(5, [1.0], 0)])) == Counter()
    assert mined(vectors(spark, [(5, [1.0], 0), (6, [1.0], 0)])) == Counter()


def test_boxes_hold_their_rows_and_prune():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 400, (40, 16))
    held = np.rint(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 10, (6000, 16)))
    at = str_order(held, hard_negatives.LEAF)
    assert sorted(at) == list(range(6000))
    tile = Tile(np.arange(6000)[at], np.zeros(6000, np.int64), held[at])
    anchor = held[0]
    bounds = [b[0] for b in tile.intervals(anchor[None, :])]
    scores = held[at] @ anchor
    for leaf in range(len(tile.leaf_lo)):
        own = scores[leaf * hard_negatives.LEAF : (leaf + 1) * hard_negatives.LEAF]
        assert bounds[2][leaf] <= own.min() and own.max() <= bounds[3][leaf]
    looked = []
    score = tile.scores
    tile.scores = lambda rows, a: looked.append(len(rows)) or score(rows, a)
    goals = [Goal(-(2**63), 2**63 - 1, -(2**63), 5), Goal(int(scores.max() * 0.5), int(scores.max() * 0.8), -(2**63), 3)]
    for goal in goals:
        looked.clear()
        (found,) = best_first(tile, 0, 0, anchor, bounds, True, [goal])
        fit = sorted((-s, i) for s, i in zip(scores, tile.ids) if i != 0 and goal.low <= s <= goal.high)
        assert list(zip(-found.scores, found.ids)) == fit[: goal.k]
        assert sum(looked) < 3000


# Ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=50):
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, Counter(t), len(t)) for i, t in found if t]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, counts, _ in found for t in counts)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    made = []
    for item, wanted in asked.items():
        weights = {t: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) for t in wanted if df[t]}
        scored = []
        for doc, counts, n in found:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(w * (10**9 * counts[t] // (1000 * counts[t] + 20 * m)) for t, w in weights.items() if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        made += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return Counter(made)


def texts(spark, rows, id_name):
    names = f"{id_name} long, text string, terms int, sketch string, rank int, score int, batch int"
    return spark.createDataFrame([(*r, 1, "s", 2, 3, 4) for r in rows], names)


def searched(spark, docs, items, **settings):
    made = ranked_search.ranked_search(texts(spark, docs, "doc_id"), texts(spark, items, "item_id"), **settings)
    return Counter(map(tuple, made.collect()))


def odd_docs():
    rng = random.Random(5)
    words = [f"wort{i}" for i in range(300)] + ["ñandú", "漢字", "İ", "x"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(200)]
    docs += [(500 + i, "Copy of one, copy of ALL; wort1!") for i in range(120)]
    docs += [(7, docs[7][1]), (None, "wort1 wort2"), (None, "wort1 wort2"), (900, None), (901, ""), (902, " \x00\x7f--")]
    docs += [(903, "wort3 " * 100_000), (904, " ".join(f"a{i}" for i in range(60_000)) + " wort4")]
    return docs


ITEMS = [
    (1, "wort1 WORT1 wort2"),
    (2, "copy-of ñandú İ"),
    (3, "nowhere"),
    (4, None),
    (5, "!!"),
    (None, "wort5 wort6"),
    (6, "wort3 wort4 a17"),
    (6, "wort9"),
    (6, "wort9"),
]


@pytest.mark.parametrize("settings", [{}, {"k": 3, "batch_terms": 2}])
def test_ranked_search_of_odd_texts(spark, settings):
    docs = odd_docs()
    assert searched(spark, docs, ITEMS, **settings) == brute_search(docs, ITEMS, settings.get("k", 50))


def test_ranked_search_of_little(spark):
    assert searched(spark, [], ITEMS) == Counter()
    assert searched(spark, odd_docs()[:5], []) == Counter()
    assert searched(spark, [(1, None), (2, "")], ITEMS) == Counter()


def test_batches_of_items_share_a_reading_of_the_index(spark, monkeypatch):
    docs, read, search = odd_docs(), [], ranked_search.search_batch

    def counted(index, rows, *settings):
        read.append({r.item_id for r in rows})
        return search(index, rows, *settings)

    monkeypatch.setattr(ranked_search, "search_batch", counted)
    items = [(i, f"wort{i} wort{i + 1}") for i in range(20)]
    assert searched(spark, docs, items, k=2, batch_terms=4) == brute_search(docs, items, 2)
    # 40 terms make ten batches.
    assert len(read) == 1
    monkeypatch.setattr(ranked_search, "BATCHES_PER_PASS", 3)
    assert searched(spark, docs, items, k=2, batch_terms=4) == brute_search(docs, items, 2)
    assert 2 <= len(read[1:]) <= 4 and set.union(*read[1:]) == set(range(20))


def test_chunks_of_any_size_find_the_same(spark):
    index = ranked_search.build_index(texts(spark, odd_docs(), "doc_id")).toArrow().combine_chunks().to_batches()[0]
    many = " ".join(f"wort{i}" for i in range(300)) + " x a17"

    class Row:
        def __init__(self, item_id, term, weight):
            self.item_id, self.term, self.weight = item_id, term, weight

    # Weights up to the greatest, and so many terms that single precision rounds.
    rows = [Row(i, t, 1 + (i * 7919 + j * 104729) % 16_000_000) for i in range(6) for j, t in enumerate(many.split()[i::2])]
    batch, n_terms, made = ranked_search.Batch(rows), sum(index.column(1).to_pylist()), []
    for step in 7, 64, index.num_rows:
        search = ranked_search.Search(batch, index.num_rows, n_terms, 20)
        for at in range(0, index.num_rows, step):
            search.chunk(index.slice(at, step))
        made.append(search.results().to_pylist())
    m = 50 + (50 * index.column(1).to_numpy() * index.num_rows) // n_terms
    impacts = search.impacts(index, np.arange(index.num_rows), m).astype(np.int64)
    exact = np.array([impacts[:, at] @ weight for at, weight in batch.asked]).T
    assert (search.bounds(index.column(4).to_pylist(), m) >= exact).all()
    best = -np.sort(-exact, axis=0)[:20].T
    for found in made:
        assert [r["score"] for r in found] == [v for scores in best.tolist() for v in scores if v > 0]
        assert Counter(map(str, found)) == Counter(map(str, made[0]))


def test_chunks_shrink_with_the_terms_of_the_items():
    def search(n):
        batch = ranked_search.Batch([])
        batch.terms = [f"t{i}" for i in range(n)]
        return ranked_search.Search(batch, 1, 1, 1)

    assert search(10).chunk_rows == ranked_search.CHUNK
    assert 32 < search(10_000).chunk_rows <= ranked_search.CELLS // 10_000
    assert search(1_000_000).chunk_rows == ranked_search.LEAST_CHUNK


def test_sketches_bound_the_scores_and_prune(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    text_of = dict(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    index = ranked_search.build_index(texts(spark, docs, "doc_id")).toArrow().combine_chunks().to_batches()[0]
    rows = index.to_pylist()
    held = [(r["id"], dict(zip(r["terms"].split(), np.frombuffer(r["counts"], np.int64))), r["n_terms"]) for r in rows]
    assert all(counts == Counter(terms(text_of[i])) for i, counts, _ in held)
    n_terms, df = sum(h[2] for h in held), Counter(t for h in held for t in h[1])

    class Row:
        def __init__(self, item_id, term):
            self.item_id, self.term = item_id, term
            self.weight = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[term] + 1)))

    rows = [Row(i, t) for i, text in items for t in set(terms(text)) if df[t]]
    search = ranked_search.Search(ranked_search.Batch(rows), len(held), n_terms, 50)
    m = 50 + (50 * np.array([h[2] for h in held]) * len(held)) // n_terms
    bounds = search.bounds(index.column(4).to_pylist(), m)
    impacts = search.impacts(index, np.arange(len(held)), m)
    exact = np.array([impacts[:, at] @ weight for at, weight in search.batch.asked]).T
    assert (bounds >= exact).all()
    kth = -np.sort(-exact, axis=0)[49]
    assert (bounds < kth).mean() > 0.1


def test_a_rule_keeps_its_border_between_host_and_path(spark):
    pages = spark.createDataFrame([(1, "http://net/x"), (2, "http://a.ne/t/x")], "page_id long, url string")
    rules = [("ne", "t/", "block"), ("ne", "/t/", "block"), ("com", "/", "allow")]
    made = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {r.page_id: (r.rule, r.verdict) for r in made.collect()} == {1: (None, "allow"), 2: ("ne/t/", "block")}


def test_profiles_are_cut_before_the_shuffle(spark, capsys):
    docs = spark.createDataFrame([("some text", "en"), ("ein Text", "de")], "text string, lang string")
    language_id.learn(docs, "text", "lang").explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
