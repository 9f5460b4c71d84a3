"""Nulls, empty tables, repeated rows, ties, long texts and odd inputs of each operator."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from spreadrank.llm import (
    byte_bpe,
    components,
    decontamination,
    hilbert_shards,
    language_id,
    mih,
    near_dedup,
    secret_scan,
    token_counts,
    url_filter,
    warc,
)
from tests.llm import brute

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Columns that the operators use for themselves, and the last one for good measure.
CLASHING = "doc_id long, text string, row int, n_tokens string, words int, id int, node int, class int, class_id int"
LONG = "Ein langer Text, ñandú ***!! " * 40_000
ODD = [
    (1, None),
    (None, "a text without an id"),
    (2, ""),
    (3, "  \n\t "),
    (4, "The same text. The same text."),
    (4, "The same text. The same text."),
    (5, "ZWJ \U0001f469‍\U0001f4bb é é ﬁ İstanbul <|endoftext|> ΣΑΣ 漢字 \x1c x\x85y"),
    (6, LONG),
    (7, "x" * 200_000),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 2, 3, 4, 5, 6) for r in rows], CLASHING)


def found(df):
    return Counter(map(tuple, df.collect()))


# op1


def test_token_counts_of_odd_texts(spark):
    expected = Counter(r[:3] for r in brute.token_counts(ODD))
    for head in (0, 3, 100_000):
        made = token_counts.token_counts(table(spark, ODD), WORDS, head_docs=4, head_size=head)
        assert found(made) == expected
    assert found(token_counts.token_counts(table(spark, []), WORDS)) == Counter()


def test_pre_tokens_are_the_librarys():
    cutter = token_counts.pre_tokens(WORDS)
    for code in range(0x250):
        text = f"a{chr(code)}b1{chr(code)} {chr(code)}{chr(code)}'s"
        words, special = cutter.of(text)
        own = sum(map(cutter.pieces, words)) + special
        assert own == len(cutter.tokenizer.encode(text, add_special_tokens=False).ids), hex(code)


# op2


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, vector string")


def neighbours(df, k=5):
    made = mih.nearest(df, F.col("id") % 2 == 0, k=k).collect()
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in made}


def test_neighbours_with_ties_nulls_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]),
        (2, [1.0, 0.0]),
        (1, [1.0, 0.0]),
        (5, [2.0, 0.0]),
        (3, [0.0, 1.0]),
        (3, [0.0, 1.0]),
        (4, None),
        (6, [0.0, 0.0]),
        (8, [nan, 1.0]),
        (10, [inf, 1.0]),
        (12, [None, 1.0]),
        (14, [1.0, 0.0, 0.0]),
        (None, [1.0, 0.0]),
    ]
    made = neighbours(vectors(spark, [(*r, None, "x", "y") for r in rows]))
    assert {q for q, _ in made} == {0, 2}
    assert [made[0, r][0] for r in (1, 2, 3, 4)] == [1, 2, 5, 3] and (0, 5) not in made
    assert [made[2, r][0] for r in (1, 2, 3, 4)] == [0, 1, 5, 3]
    assert made[0, 1][1] == 1.0 and made[0, 4][1] == 0.0
    assert neighbours(vectors(spark, [])) == {}
    assert neighbours(vectors(spark, [(0, [1.0], 1, "", "")])) == {}


def test_vectors_of_each_length_have_neighbours(spark):
    rng = np.random.default_rng(8)
    one = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    two = [(i, rng.normal(size=6).tolist()) for i in range(100, 112)] + [(0, rng.normal(size=6).tolist())]
    made = mih.nearest(vectors(spark, [(*r, None, "", "") for r in one + two]), F.col("id") % 2 == 0, k=3, sigmas=6.0)
    alone = [mih.nearest(vectors(spark, [(*r, None, "", "") for r in part]), F.col("id") % 2 == 0, k=3, sigmas=6.0) for part in (one, two)]
    assert found(made) == found(alone[0]) + found(alone[1])
    assert {r.query_id for r in made.collect()} == {i for i, _ in one + two if i % 2 == 0}


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(800, 32))
    data[400:] = data[:400] + 0.05 * rng.normal(size=(400, 32))
    block = mih.Block(np.arange(800), data, mih.learn_rotation(data))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = 0
    for i in range(100):
        cosine = unit @ unit[i]
        cosine[i] = -2
        hits += len({x for x, _ in block.search(i, data[i], 5, 2.0)} & set(np.argsort(-cosine)[:5]))
    assert hits >= 475
    assert sum(len(mih.masks(10, w)) for w in range(11)) == 1024


def test_many_blocks_give_the_same_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), None, "", "") for i in range(300)]
    df = vectors(spark, rows)
    one = mih.nearest(df, F.col("id") % 10 == 0, sigmas=6.0)
    many = mih.nearest(df, F.col("id") % 10 == 0, sigmas=6.0, block_rows=50, query_rows=7)
    assert found(one) == found(many)


# op3


def test_archives_round_trip(spark, tmp_path):
    rows = [
        (1, "http://a/\r\nX: y", "<p>é</p>" * 50_000),
        (2, "http://b/", "<p>é</p>" * 50_000),
        (3, None, None),
        (4, "http://d/", ""),
        (5, "http://e/", "short"),
        (5, "http://e2/", "short"),
        (9, "http://f/", "short"),
        (None, "http://g/", "short"),
        (None, "http://h/", None),
        (7, "http://i/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    ]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "page_id long, url string, html string, chunk int, id string, digest string")
    manifest = warc.write_archives(df, str(tmp_path / "out"), chunk_bytes=1000, file_bytes=2000)
    read = warc.read_archives(manifest, chunk_bytes=777)
    pieces = {}
    for r in read.collect():
        assert len(r.data) <= 777
        pieces.setdefault((r.record_id, r.target_uri), []).append(r)
    assert len(pieces) == len(rows)
    by_uri = {uri: sorted(p, key=lambda r: r.chunk) for (_, uri), p in pieces.items()}

    def record(uri):
        parts = by_uri[uri]
        assert [p.chunk for p in parts] == list(range(len(parts))) and [p.last for p in parts] == [False] * (len(parts) - 1) + [True]
        last = parts[-1]
        assert last.digest == last.payload_digest
        return last.record_type, last.refers_to, last.n_bytes, b"".join(p.data for p in parts).decode()

    long = rows[1][2]
    assert record("http://b/") == ("response", None, len(long.encode()), long)
    assert record("http://a/%0D%0AX:%20y") == ("revisit", "<urn:x-record:2>", len(long.encode()), "")
    assert record("http://d/") == ("response", None, 0, "")
    assert record("") == ("revisit", "<urn:x-record:4>", 0, "")
    assert record("http://e/") == record("http://e2/") == ("revisit", "<urn:x-record:9>", 5, "")
    assert record("http://f/") == ("response", None, 5, "short")
    assert record("http://g/") == ("response", None, 5, "short")
    assert record("http://i/") == ("response", None, len(rows[9][2]), rows[9][2])
    told = base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
    assert by_uri["http://b/"][-1].digest == told
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 1
    none = warc.write_archives(df, str(tmp_path / "none"), min_revisit=10**9)
    assert {r.record_type for r in warc.read_archives(none).select("record_type").collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


# op4


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_transducer_equals_merging():
    own, exact, rnd = byte_bpe.codec(RANKS, PATTERN), library(), random.Random(4)
    small = byte_bpe.Transducer(own.ranks, max_states=50)
    ranges = [(97, 103), (32, 127), (0x20, 0x800), (0x4E00, 0x4F00), (0x1F300, 0x1F700), (0x300, 0x340)]
    for _ in range(400):
        text = "".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(1, 80)))
        ids = exact.encode_ordinary(text)
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
        pieces = regex.findall(PATTERN, text)
        assert b"".join(small.encode(p.encode()) for p in pieces) == own.encode(text)


def test_tokens_leave_after_bounded_lookahead():
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS))
    longest, state, waiting = max(map(len, machine.ranks)), 0, 0
    for byte in b"thequickbrownfoxjumpsoverthelazydog" * 200:
        step = machine.next.get(state << 8 | byte) or machine.step(state, byte)
        state, waiting = step >> 1, 0 if step & 1 else waiting + 1
        assert waiting <= 2 * longest and len(machine.starts(state)[0]) <= longest


def test_codec_of_odd_texts(spark):
    ids = byte_bpe.encode(table(spark, ODD), RANKS, PATTERN, ["doc_id", "n_tokens", "words"][:1])
    made = byte_bpe.decode(ids, RANKS, PATTERN, ["doc_id", "n_tokens", "ids"])
    made = made.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256))
    assert found(made) == Counter(brute.byte_bpe(ODD))
    assert byte_bpe.encode(table(spark, []), RANKS, PATTERN, ["doc_id"]).count() == 0


def test_decoding_tells_what_is_not_utf8():
    own = byte_bpe.codec(RANKS, PATTERN)
    half = own.ranks["é".encode()[:1]]
    assert own.decode(np.array([half], "<u4")) == (b"\xc3", False)
    ids = np.frombuffer(own.encode("é漢" * 50_000), "<u4")
    assert own.decode(ids) == (("é漢" * 50_000).encode(), True)


# op5


def near(spark, rows, words=2):
    return found(near_dedup.near_duplicates(table(spark, rows), words=words))


def test_near_duplicates_of_odd_texts(spark):
    rows = [(d, t) for d, t in ODD if d is not None and d != 7]
    assert near(spark, rows) == Counter(brute.near_duplicates(rows))
    made = near_dedup.near_duplicates(table(spark, ODD), words=2).filter("doc_id is null").collect()
    assert [tuple(r) for r in made] == [(None, 4, None, True)]
    assert near(spark, []) == Counter()
    assert near(spark, [(1, None), (2, "")]) == Counter([(1, 0, 1, True), (2, 0, 2, True)])


def test_near_duplicates_with_large_groups_and_common_passages(spark):
    rnd = random.Random(7)
    word = lambda: "w%d" % rnd.randrange(400)
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(100, 160)]
    for i in range(200, 320):  # near copies, some further from each other than the threshold allows
        text = list(base)
        for _ in range(rnd.randrange(0, 8)):
            text[rnd.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    for i in range(400, 480):  # a shared passage in unlike texts
        rows.append((i, " ".join(passage + [word() for _ in range(rnd.randrange(5, 60))])))
    for i in range(500, 540):
        rows.append((i, " ".join(word() for _ in range(rnd.randrange(1, 6)))))
    rnd.shuffle(rows)
    for words in (2, 5):
        made = found(near_dedup.near_duplicates(table(spark, rows), words=words))
        assert made == Counter(brute.near_duplicates(rows, words=words))


def test_one_row_of_each_component_stays(spark):
    rnd = random.Random(5)
    a, b, c, d = (" ".join("w%d" % rnd.randrange(10_000) for _ in range(100)) for _ in range(4))
    rows = [
        (3, a),
        (7, a),  # a copy of 3
        (7, b),  # unlike all others
        (7, None),
        (8, b + " end"),  # a near copy of (7, b)
        (10, c),
        (10, c),
        (10, c.upper()),
        (10, c + " end"),  # with the same id, but another set
        (11, c),
        (12, d),
        (13, d),
        (13, d),
        (None, a),
        (None, a),
        (14, ""),
        (14, ""),
    ]
    names = "doc_id long, text string, _id int, class int, doc int, id map<string,int>"
    df = spark.createDataFrame([(*r, 1, i, 3, {"x": i}) for i, r in enumerate(rows)], names)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    made = kept.collect()
    plain = Counter((r.doc_id, r.text) for r in made)
    tens = [r for r in made if r.doc_id == 10]
    assert len(tens) == 1 and tens[0].text.lower() in (c, c + " end")
    del plain[10, tens[0].text]
    assert plain == Counter([(3, a), (7, b), (7, None), (12, d), (None, a), (None, a), (14, ""), (14, "")])
    assert all(r.id == {"x": r["class"]} and rows[r["class"]] == (r.doc_id, r.text) for r in made)
    again = near_dedup.keep_one(df.repartition(7, "class")).collect()
    assert sorted(made, key=lambda r: r["class"]) == sorted(again, key=lambda r: r["class"])
    assert near_dedup.keep_one(df.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (1, 3, 40, 2000):
        own = np.unique(rng.integers(0, 2**63, 2 * size).astype(np.uint64))
        bins = near_dedup.sketch(own)
        assert (bins != np.iinfo(np.uint64).max).all() and len(bins) == near_dedup.SIZE
        assert (near_dedup.sketch(own[::-1]) == bins).all()
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    shares = [(near_dedup.sketch(pool[:1000]) == near_dedup.sketch(np.concatenate((pool[:900], pool[1000 + i : 1100 + i])))).mean() for i in range(0, 1800, 100)]
    assert abs(np.mean(shares) - 900 / 1100) < 0.03


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 300), (401, 400)]
    edges += [(1000 + rnd.randrange(80), 1000 + rnd.randrange(80)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    made = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in made} == {(x, find(x)) for x in root if find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# op6


def test_url_parts_and_precedence(spark):
    rules = spark.createDataFrame(
        [
            ("com", "/", "allow"),
            ("Example.com", "/en/", "block"),
            ("www.example.com", "/en/", "allow"),
            ("net", None, "block"),
            ("a.net", "", "block"),
            ("a.net", "", "allow"),
            ("same.org", "/x", "allow"),
            ("sub.same.org", "", "block"),
            (None, "/", "block"),
            ("", "/", "block"),
            ("lost.org", "/", None),
        ],
        "host string, path string, verdict string",
    )
    urls = {
        "http://EXAMPLE.com/en/x?y#z": ("example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://m.example.com/english": ("m.example.com", "/english", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "other"),
        "http://example.com?/en/": ("example.com", "", None, "other"),
        "x://b.net#/": ("b.net", "", "net", "block"),
        "http://a.net/p://q/": ("a.net", "/p://q/", "a.net", "block"),
        "http://sub.same.org/xy": ("sub.same.org", "/xy", "sub.same.org", "block"),
        "http://lost.org/": ("lost.org", "/", None, "other"),
        "http:///en/": ("", "/en/", None, "other"),
        "no mark": ("", "", None, "other"),
        "": ("", "", None, "other"),
        None: ("", "", None, "other"),
    }
    rows = [(i, u, 1, "r") for i, u in enumerate(urls)] + [(None, "x://b.net", 1, "r")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, row int, host string")
    expected = Counter((i, *urls[u]) for i, u in enumerate(urls))
    expected[(None, "b.net", "", "net", "block")] = 2
    for most in (100, 0):
        assert found(url_filter.filter_urls(df, rules, default="other", max_broadcast=most)) == expected
    assert found(url_filter.filter_urls(df, rules.limit(0))) == Counter((r[0], *(urls.get(r[1]) or ("b.net", ""))[:2], None, "allow") for r in rows)
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_native_operators_run_no_python(spark):
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plans = [url_filter.filter_urls(df, rules), hilbert_shards.shard_rows(df, ["page_id", "url"], ["page_id"], 2)]
    for made in plans:
        plan = made._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


# op7


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_each_cell_once_and_moves_by_one(spark, dims, bits):
    names = [f"x{i}" for i in range(dims)]
    cells = spark.range(1 << bits * dims).select(
        *[(F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1))).cast("int").alias(n) for i, n in enumerate(names)]
    )
    made = cells.select(hilbert_shards.hilbert_index([F.col(n) for n in names], bits).alias("h"), *names).collect()
    path = [tuple(r)[1:] for r in sorted(made)]
    assert [r.h for r in sorted(made)] == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(i % 7, None if i % 5 == 0 else f"s{i % 3}", float(i % 11) if i % 4 else None, i % 2) for i in range(103)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size double, row int")
    made = hilbert_shards.shard_rows(df, ["source", "size"], ["doc_id", "row"], 4)
    got = made.collect()
    assert Counter((r.doc_id, r.source, r.size, r.row) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 4
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    hilbert_shards.write_shards(made, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 103
    few = hilbert_shards.shard_rows(df.limit(2), ["source"], ["doc_id"], 16).collect()
    assert sorted(r.slot for r in few) == [0, 0]
    assert hilbert_shards.shard_rows(df.limit(0), ["source", "size"], ["doc_id"], 4).count() == 0


def test_sources_with_a_common_prefix_prune(spark, tmp_path):
    rows = [(i, f"common_crawl_{i % 4}", i // 4) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    made = hilbert_shards.shard_rows(df, ["source", "size"], ["doc_id"], 16)
    hilbert_shards.write_shards(made, str(tmp_path / "out"))
    spans = []
    for file in (tmp_path / "out").rglob("*.parquet"):
        data = pq.ParquetFile(file).metadata
        names = [data.row_group(0).column(i).path_in_schema for i in range(data.num_columns)]
        stats = {n: data.row_group(0).column(i).statistics for i, n in enumerate(names)}
        spans.append((stats["source"].min, stats["source"].max, stats["size"].min, stats["size"].max))
    assert len(spans) >= 16
    for source in range(4):
        assert sum(a <= f"common_crawl_{source}" <= b for a, b, _, _ in spans) <= len(spans) // 2
    for size in (0, 30, 60, 99):
        assert sum(a <= size <= b for _, _, a, b in spans) <= len(spans) // 2


def test_value_cells_are_shares_of_rows_before(spark):
    rnd = random.Random(4)
    common = "a text whose first characters are those of all others "
    values = [rnd.choice([None, "", "é", "long" * 5000, "hot", "hot", "hot", common + str(rnd.randrange(40))]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    rows = hilbert_shards.packed(df).repartition(5)
    made = rows.select("row.value", hilbert_shards.value_cell(rows, "value", 5).alias("cell")).collect()
    order = sorted(values, key=lambda v: (v is not None, (v or "").encode()))
    first = {}
    for at, value in enumerate(order):
        first.setdefault(value, at)
    assert Counter(map(tuple, made)) == Counter((v, first[v] * 32 // 500) for v in values)


def test_shards_keep_columns_of_any_name(spark):
    names = ["curve", "shard", "Slot", "row", "_row", "_part", "part", "rank", "_number0", "a.b", "all"]
    df = spark.createDataFrame([tuple(range(i, i + len(names))) for i in range(20)] * 2, [f"c{i}" for i in range(len(names))])
    df = df.toDF(*names)
    made = hilbert_shards.shard_rows(df, ["curve", "row"], ["shard", "a.b"], 3)
    assert made.columns == [*names, "curve_", "shard_", "slot_"]
    assert sorted(tuple(r)[: len(names)] for r in made.collect()) == sorted(map(tuple, df.collect()))
    dated = spark.sql("select date'2024-01-01' + cast(id as int) d, id % 2 = 0 b, id from range(64)")
    days = hilbert_shards.shard_rows(dated, ["d", "b"], ["id"], 4).groupBy("shard").agg(F.max("d") - F.min("d")).collect()
    assert len(days) == 4


# op8


def test_language_of_odd_texts(spark):
    rows = [(i, t, "xx" if i == 4 else "yy" if i == 6 else None) for i, t in ODD if i != 7]
    rows += [(20, "1234 !!", "zz"), (21, "a", ""), (8, "the same", "xx"), (None, "the text", "qq")]
    df = spark.createDataFrame([(*r, 0.5, "p") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    profiles = language_id.learn(df.filter(language_id.in_training("doc_id")), "text", "lang")
    made = language_id.identify(df, profiles, ["doc_id"]).select(
        "doc_id", language_id.held_out("doc_id"), "lang_pred", F.round("score", 9)
    )
    assert found(made) == Counter((a, b, c, round(d, 9)) for a, b, c, d in brute.language(rows))
    none = language_id.learn(df.limit(0), "text", "lang")
    assert {tuple(r) for r in language_id.identify(df, none, ["doc_id"]).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert language_id.identify(df.limit(0), profiles, ["doc_id"]).count() == 0


# op9


def test_decontamination_of_odd_texts(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten + " eleven"), (1, ten + " eleven"), (2, "Three, WORDS: only"), (3, None), (4, "... !"), (None, "no id here"), (5, "ß é"), (10, ten)]
    docs = [
        (1, "zero " + ten.upper().replace(" ", "--") + " Eleven twelve"),
        (2, "three words, only three words only"),
        (3, None),
        (None, ten),
        (4, "here is no id here at all"),
        (5, "Ss ß É ß é!"),
        (6, ten[:-4]),
        (6, ten[:-4]),
        (7, (ten + " ") * 3000),
    ]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    for block in (500_000, 8):
        made = decontamination.decontaminate(table(spark, docs), bench, ["doc_id"], block_words=block)
        made = made.select(
            "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.concat_ws(",", "items"), 256), F.expr("n_hit > 0")
        )
        assert found(made) == Counter(brute.decontamination(docs, items))
    first = decontamination.decontaminate(table(spark, docs[:1]), bench, ["doc_id"]).first()
    text = docs[0][1]
    assert [text[s.start : s.end] for s in first.spans] == [text[5 : text.index(" twelve")]]
    nothing = decontamination.decontaminate(table(spark, docs), bench.limit(0), ["doc_id"])
    assert nothing.filter("n_hit > 0").count() == 0
    assert decontamination.decontaminate(table(spark, []), bench, ["doc_id"]).count() == 0


def test_large_benchmarks_take_a_block_at_a_time(spark):
    rnd = random.Random(9)
    number = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    items = [(i, number(rnd.randrange(1, 40))) for i in range(40)] + [(40, number(500))]
    docs = [(i, number(5) + " " + " ".join(t.split()[-15:]) + " " + number(5)) for i, t in items]
    docs += [(99, " ".join(t for _, t in items[::3])), (100, items[40][1][100:]), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    parts = list(decontamination.blocks(bench, "item_id", "text", 10, 300))
    assert max(sum(len(decontamination.words_of(t)) for _, t in part) for part in parts) <= 300 and len(parts) > 4
    made = decontamination.decontaminate(table(spark, docs), bench, ["doc_id"], block_words=300).select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.concat_ws(",", "items"), 256), F.expr("n_hit > 0")
    )
    assert found(made) == Counter(brute.decontamination(docs, items))


# op10


def test_base_patterns():
    texts = [
        "PassWord: abcdef token='abc' token=token: abcdefg",
        'api_key"="x.y/z+1=" apikey == secret',
        "AKIA" + "A" * 15 + " AKIA" + "A" * 16 + " AKIAAKIA" + "Z" * 12,
        "deadbeef" * 3 + "g" + "0123456789abcdef0123456",
        "paſſword=abcdefgh toKen=abcdefgh",
        "passwd =  " + "0" * 30,
    ]
    for text in texts:
        expected = next(iter(brute.base_secrets([(1, text)])))
        spans = secret_scan.base_spans(text)
        assert ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, b, k in spans) == expected[-1]


def test_models_tell_keys_from_words(spark):
    rnd = random.Random(9)
    key = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    prose = "the quick brown fox jumps over the lazy dog and the international organisation of standards "
    rows = [(i, f"{prose} secret = {key(24)} {prose}") for i in range(60)]
    hidden = key(32)
    rows += [(100, f"é {hidden} {prose}"), (101, "internationalorganisation " + prose), (102, None), (None, ""), (103, "x" * 100_000)]
    made = {r.doc_id: r for r in secret_scan.scan_secrets(table(spark, rows)).collect()}
    assert [tuple(s) for s in made[100].spans] == [(2, 34, "markov")] and not made[100].base
    assert all(not made[i].spans for i in (101, 102, None))
    assert all([s.kind for s in made[i].base] == ["assign"] for i in range(60))
    redacted = {r.doc_id: r for r in secret_scan.redact(table(spark, rows), ["doc_id"]).collect()}
    assert redacted[100].redacted == f"é [SECRET] {prose}" and redacted[102].redacted is None
    assert redacted[0].redacted == f"{prose} [SECRET] {prose}" and redacted[0].n_secrets == 1
    assert secret_scan.scan_secrets(table(spark, [])).count() == 0
    assert secret_scan.redact(table(spark, []), ["doc_id"]).count() == 0


def test_planted_keys_are_found_and_ordinary_runs_left_alone(spark):
    """Recall by length of keys that no pattern fits, and no false hits, in the texts of the smallest tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rnd = random.Random(17)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = {(n, i): "".join(rnd.choice(letters) for _ in range(n)) for n in (16, 20, 24, 32, 40) for i in range(100)}
    rows = [(10**6 + n * 1000 + i, f"see {key} there") for (n, i), key in planted.items()]
    ordinary = [
        "123456789012345678", "2023-11-14-2023-12-24", "-" * 28, "=" * 80, "4111-1111-1111-1111", "4929381332664295",
        "getElementsByClassName", "max_shuffle_partitions_per_task", "en/2024/05/17/news/index", "SPARK_EXECUTOR_MEMORY_OVERHEAD",
        "internationalisation", "application/x-www-form-urlencoded", "20240101000000000", "+" * 16, "a" * 40, "0" * 16, "1/2/3/4/5/6/7/8/9/10",
    ]
    rows += [(2 * 10**6 + i, f"see {value} there") for i, value in enumerate(ordinary)]
    made = secret_scan.scan_secrets(docs.unionByName(table(spark, rows).select("doc_id", "text")))
    found = {r.doc_id: [tuple(s) for s in r.spans if s.kind == "markov"] for r in made.collect()}
    for n, least in ((16, 0.95), (20, 0.97), (24, 0.98), (32, 0.99), (40, 0.99)):
        right = [found[10**6 + n * 1000 + i] == [(4, 4 + n, "markov")] for i in range(100)]
        assert sum(right) >= least * 100, (n, sum(right))
    assert [v for i, v in enumerate(ordinary) if found[2 * 10**6 + i]] == []
    assert all(not spans for doc, spans in found.items() if doc < 10**6)


def test_limit_of_the_models(spark):
    """The models against a plain count of pairs, and any layout gives the same words and counts."""
    prose = ["the committee of the national assembly met in the evening", "prices and wages rose by one tenth in 2023-10-11"]
    df = table(spark, [(i, prose[i % 2] + f" item{i % 7}") for i in range(40)])
    models = [
        secret_scan.learn(secret_scan._scan(d, "doc_id", "text", 16), 16, None) for d in (df.repartition(6), df.coalesce(1))
    ]
    assert (models[0].table == models[1].table).all() and models[0].limit == models[1].limit >= secret_scan.LEAST_LIMIT
    assert models[0].recall > 0.95
    words = sorted({w for t in prose for w in t.split() if w.isalpha() and 3 <= len(w) <= 12} | {"item"})
    words.sort(key=lambda w: (zlib.crc32(w.encode()), [-ord(c) for c in w]))
    half = secret_scan.SAMPLES // 2

    def chances(strings):
        pairs = Counter(
            (a if a in secret_scan.ALPHABET else "", b if b in secret_scan.ALPHABET else "")
            for s in strings for a, b in zip(["", *s], [*s, ""])
        )
        del pairs["", ""]
        seconds, firsts = Counter(), Counter()
        for (a, b), n in pairs.items():
            firsts[a] += n
            seconds[b] += n
        total = sum(seconds.values()) + secret_scan.WIDTH
        return lambda a, b: (pairs[a, b] + 20 * (seconds[b] + 1) / total) / (firsts[a] + 20)

    corpus = chances([prose[i % 2] + f" item{i % 7}" for i in range(40)])
    named = chances(secret_scan.identifier_samples(words, 2 * half, 16)[:half])
    keys = chances(secret_scan.key_samples(2 * half)[:half])
    for value in ("abcDEF123456-_/=+9", "theNationalAssembly"):
        pairs = list(zip(["", *value], [*value, ""]))
        mean = sum(math.log(keys(a, b) / (corpus(a, b) / 2 + named(a, b) / 2)) for a, b in pairs) / len(pairs)
        assert models[0].ratio(value) == pytest.approx(mean)


def test_result_columns_called_like_kept_ones(spark):
    names = ["lang_pred", "score", "n_words", "n_hit", "items", "spans", "redacted", "n_secrets", "n_tokens", "IDS", "decoded", "valid_utf8"]
    df = table(spark, [(1, "one two"), (1, None)]).select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    items = spark.createDataFrame([("a", "one two"), ("b", "three four")], "item_id string, text string")
    profiles = language_id.learn(df.withColumn("lang", F.lit("en")), "text", "lang")
    results = [
        language_id.identify(df, profiles, names),
        decontamination.decontaminate(df, items, names, window=2),
        decontamination.decontaminate(df, items, names, window=2, block_words=2),
        secret_scan.redact(df, names),
        byte_bpe.encode_and_decode(df, RANKS, PATTERN, names),
    ]
    for made in results:
        assert made.columns[: len(names)] == names and all(c.endswith("_") for c in made.columns[len(names) :])
        assert len({c.lower() for c in made.columns}) == len(made.columns)
        assert [tuple(r)[: len(names)] for r in made.collect()] == [tuple(range(len(names)))] * 2


def test_a_task_gives_back_what_it_has_dropped(spark, monkeypatch):
    import gc
    import weakref

    from spreadrank.llm import common

    class Ring:
        pass

    ring = Ring()
    ring.self, seen = ring, weakref.ref(ring)
    trimmed = []
    monkeypatch.setattr(common, "_trim", trimmed.append)
    gc.disable()
    try:
        del ring
        common.give_back()
        assert seen() is None and trimmed == [0]
    finally:
        gc.enable()
