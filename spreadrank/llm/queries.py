"""The queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from spreadrank.llm import (
    byte_bpe,
    decontamination,
    hard_negatives,
    hilbert_shards,
    language_id,
    main_text,
    mih,
    near_dedup,
    ranked_search,
    secret_scan,
    token_counts,
    url_filter,
    warc,
)
from spreadrank.llm.common import table


def op1_token_counts(spark, sf_dir):
    counts = token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_multi_index_hashing(spark, sf_dir):
    return mih.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_warc(spark, sf_dir):
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(manifest).filter("last")
    return records.select(
        warc.id_in("record_id").cast("long").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        warc.id_in("refers_to").cast("long").alias("refers_to"),
    )


def op4_byte_bpe(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    made = byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), path, pattern, ["doc_id"])
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "valid_utf8",
    )


def op5_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, threshold=80)


# The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


OP6_SQL = """
with cut as (
  select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) end as rest from pages
), parts as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
    row_number() over () as n
  from cut
), rules(rule_host, rule_path, rule_verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best as (
  select n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
  from parts join rules
    on ('.' || host) like ('%.' || rule_host) and starts_with(path, rule_path)
  group by n
)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from parts left join best using (n)
"""


def op7_hilbert_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        "lang",
        "n_chars",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    made = hilbert_shards.shard_rows(docs, ["source", "lang", "n_chars"], ["text_crc32", "doc_id", "size"], 16)
    return made.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.filter(language_id.in_training("doc_id")), "text", "lang")
    made = language_id.identify(docs, profiles, ["doc_id"])
    return made.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark, sf_dir):
    made = decontamination.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]
    )
    return made.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_secret_scan(spark, sf_dir):
    made = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return made.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op11_hard_negatives(spark, sf_dir):
    changed = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, changed)


OP11_SQL = """
with sound as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.id as anchor_id, a.label = b.label as same, b.id as other_id,
    cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
  from sound a join sound b on a.id % 50 = 0 and a.id <> b.id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id,
  cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as integer) as rank,
  other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""


def op12_ranked_search(spark, sf_dir):
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), held as (select r, doc_id, terms, len(terms) as n from docs where len(terms) > 0),
totals as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from held),
tfs as (select r, term, count(*) as tf from (select r, unnest(terms) as term from held) group by all),
dfs as (select term, count(*) as df from tfs group by term),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), weighed as (
  select item_id, term, cast(floor(1000 * ln((2.0::double * big_n + 2) / (2.0::double * df + 1))) as bigint) as w
  from asked join dfs using (term), totals
), scored as (
  select item_id, r, any_value(doc_id) as doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) as bigint) as score
  from weighed join tfs using (term) join held using (r), totals
  group by item_id, r
), ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
  from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""


def op13_main_text(spark, sf_dir):
    return main_text.extract_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_multi_index_hashing": op2_multi_index_hashing,
    "op3_warc": op3_warc,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_near_dedup": op5_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scan": op10_secret_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ranked_search": op12_ranked_search,
    "op13_main_text": op13_main_text,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op6_url_filter": OP6_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
}
