"""From raw documents to token ids: a stage a step, each reading what its predecessor kept.

1. ``language_id`` learns the languages from the labelled documents and drops those that are in none of them: without
   letters, or unlabelled and without an n-gram of any profile.
2. ``near_dedup`` keeps one document, the one with the least id, of each group of near-duplicates: five-word
   shingles, a similarity of 0.8 or more.
3. ``decontamination`` drops the documents that hold a passage of the benchmark.
4. ``secret_scan`` replaces secrets by a mark and keeps the document.
5. ``byte_bpe`` encodes what is left, decodes it again and says whether that gave the same text.

All columns of the documents are passed on, whatever their names, up to the last stage. Each stage has a defined
result for null and empty texts, null and repeated ids and empty tables; see the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadrank.llm import byte_bpe, decontamination, language_id, near_dedup, secret_scan
from spreadrank.llm.common import table
from spreadrank.storage import materialize

#: Between 0, the score of a text without an n-gram of any profile, and 1 / 300^2, the least score of all others. What
#: prose scores depends on its length and script, so no greater score is asked for.
MIN_SCORE = 0.5 / 300**2

#: Bounds on what an encoding worker remembers, some 150 MB: the workers of earlier stages live on beside it.
STATES, PIECES = 60_000, 100_000

#: No SQL: profiles, sketches and the transducer are out of its reach; tests compare with plain Python.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as column ``doc``, where their names meet no others."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "text")


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of before, in their order; ``new`` ones in place of the old."""
    old = {c: F.col("text") if c == "text" else F.col("doc").getField(c) for c in columns}
    return df.select(*[new.get(c, old[c]).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.learn(docs, "text", "lang")
    judged = language_id.identify(packed(docs), profiles, ["doc", "text"])
    # A labelled text with letters is in its language, also if it is too short to have one of the frequent n-grams.
    labelled = F.coalesce(F.col("doc").getField("lang") != "", F.lit(False))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (labelled | (F.col("score") >= MIN_SCORE))
    return unpacked(judged.filter(known), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, words=5, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontamination.decontaminate(packed(docs), table(spark, sf_dir, "benchmark"), ["doc", "text"])
    return unpacked(marked.filter("n_hit = 0"), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = secret_scan.redact(packed(docs), ["doc"])
    length = F.when(F.col("n_secrets") > 0, F.char_length("redacted").cast("long")).otherwise(F.col("doc.n_chars"))
    return unpacked(made, docs.columns, text=F.col("redacted"), n_chars=length)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    texts = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    back = byte_bpe.encode_and_decode(texts, path, pattern, ["doc_id", "text_sha256"], max_states=STATES, max_pieces=PIECES)
    digest = F.sha2("decoded", 256)
    return back.select(
        "doc_id", "n_tokens", "ids", digest.alias("decoded_sha256"), (digest == F.col("text_sha256")).alias("same_text")
    )


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode_and_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
