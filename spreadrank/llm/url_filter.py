"""URL filters by host and path rules, with DataFrame functions only.

A rule names a host and a path; it fits a url of that host or a subdomain whose path starts with the
rule's, and of all rules that fit the longest decides. Each url is expanded into the expressions a rule could
have been written as: every host suffix of as many labels, and path prefix of as many characters, as some rule
has. Expressions and rules are hashed; an equi-join on the first 32 bits of the digest finds the
few that may be equal and the whole digest confirms them. Rules up to ``max_broadcast`` rows are counted and
broadcast, more are joined by a shuffle in which hot expressions are split off (``skew.lookup``).

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path, and no rule fits. Rules
without a host or verdict are left out; of two rules with the same host and path ``block`` counts; of two
equally long that fit, the one with the longer host. Each row gives a row, whatever its id, and repeated rows give repeated
results; very long urls are expanded up to the longest rule only. Columns other than id and url are not read, so their names do
no harm. An empty table gives an empty result, and without rules every url has the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadrank.operators.skew import lookup

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_HEX = 8


# Between host and path in what is digested; neither of a url's can hold it.
BORDER = "#"


def host_and_path(url: Column) -> tuple[Column, Column]:
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_digests(rules: DataFrame) -> DataFrame:
    """``prefix`` and the rules whose digest begins with it."""
    named = rules.filter("host is not null and host != '' and verdict is not null").select(
        F.translate("host", UPPER, UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    one = named.groupBy("host", "path").agg(
        F.max_by("verdict", F.struct(F.col("verdict") == "block", "verdict")).alias("verdict")
    )
    text = F.concat("host", "path")
    bordered = F.concat("host", F.lit(BORDER), "path")
    entry = F.struct(
        F.length(text).alias("length"),
        F.length("host").alias("host_length"),
        text.alias("rule"),
        "verdict",
        F.sha2(bordered, 256).alias("digest"),
    )
    keyed = one.select(entry.alias("entry")).withColumn("prefix", F.substring("entry.digest", 1, PREFIX_HEX))
    return keyed.groupBy("prefix").agg(F.collect_list("entry").alias("entries"))


def filter_urls(
    df: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_broadcast: int = 100_000,
) -> DataFrame:
    """``id, host, path, rule, verdict`` of each row; ``rules`` has host, path and verdict (allow or block)."""
    known = rule_digests(rules)
    # How many labels and path characters the rules have: a handful of pairs.
    labels = F.size(F.split(F.col("host"), r"\."))
    shapes = (
        rules.filter("host is not null and host != ''")
        .select(labels.alias("labels"), F.length(F.coalesce("path", F.lit(""))).alias("chars"))
        .distinct()
        .collect()
    )
    host, path = host_and_path(F.col(url_col))
    urls = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).select(
        F.monotonically_increasing_id().alias("row"), "*"
    )
    parts = F.split("host", r"\.")
    expressions = [
        F.when(
            (F.col("host") != "") & (F.size(parts) >= s.labels) & (F.length("path") >= s.chars),
            F.concat(F.substring_index("host", ".", -s.labels), F.lit(BORDER), F.substring("path", 1, s.chars)),
        )
        for s in sorted(shapes)
    ]
    made = F.array_compact(F.array(*expressions)) if expressions else F.array().cast("array<string>")
    exploded = urls.select("*", F.explode_outer(made).alias("text")).withColumn("digest", F.sha2("text", 256))
    exploded = exploded.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)).drop("text")
    if rules.limit(max_broadcast + 1).count() <= max_broadcast:
        found = exploded.join(F.broadcast(known), "prefix", "left")
    else:
        rows = df.count() * max(1, len(expressions))
        found = lookup(exploded, known, ["prefix"], rows, "left")
    fits = F.filter("entries", lambda e: e["digest"] == F.col("digest"))
    found = found.withColumn("best", F.try_element_at(fits, F.lit(1)))
    judged = found.groupBy("row").agg(
        F.first("id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best")
    )
    return judged.select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
