from __future__ import annotations

import math

import pytest

from spreadrank.operators.cleaning import clean_interactions
from spreadrank.params import Params
from spreadrank.plans import preprocess
from spreadrank.sources.interactions import (
    CSV,
    SCHEMA,
    input_uri,
    load_interactions,
    stage_interactions,
)
from spreadrank.sources.reports import save_report

DIRTY = """tweet_id,src_user_id,dst_user_id,interaction_type,veracity,timestamp
t1,a,b,rt,fake,1
t1,a,c,rt,real,2
,a,d,rt,fake,3
,b,d,rt,fake,4
t5,a,a,rt,fake,5
t6,a,b,rt,Fake,6
t7,a,,rt,fake,7
t8,b,a,reply,unverified,xx
t9,a,b,reply, fake,9
"""


@pytest.fixture()
def dirty(tmp_path):
    path = tmp_path / "interactions.csv"
    path.write_text(DIRTY)
    return str(path)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_csv_keeps_white_space_and_nulls_bad_numbers(spark, dirty):
    rows = {(r.tweet_id, r.timestamp): r for r in load_interactions(spark, dirty).collect()}
    assert len(rows) == 9
    assert rows[("t8", None)].veracity == "unverified"
    assert rows[("t9", 9)].veracity == " fake"
    assert rows[("t7", 7)].dst_user_id is None


def test_edges_of_the_dirty_log(spark, dirty):
    rows = preprocess.run_preprocessing(spark, dirty).orderBy("src_user_id", "dst_user_id").collect()
    found = [
        (r.src_user_id, r.dst_user_id, r.veracity_score, r.interaction_count, r.interaction_type,
         round(r.edge_weight, 6))
        for r in rows
    ]
    assert found == [
        ("a", "b", 1.0, 1, "rt", 1.693147),
        ("a", "d", 1.0, 1, "rt", 1.693147),
        ("b", "a", 0.5, 1, "reply", 1.193147),
    ]


def test_threshold_is_on_the_edge_weight(spark, dirty):
    table = preprocess.run_preprocessing(spark, dirty, params=Params(min_edge_weight=1.5))
    assert table.count() == 2


def test_stage_counts(spark, dirty):
    counts = preprocess.stage_counts(load_interactions(spark, dirty)).collect()
    assert {r.stage: r.rows for r in counts} == {"loaded": 9, "cleaned": 3, "edges": 3}


def test_label_filter_comes_after_the_repeats(spark):
    rows = log(spark, ("t", "a", "b", "rt", "satire", 1), ("t", "a", "b", "rt", "fake", 2))
    assert clean_interactions(rows).count() == 0


def test_key_of_repeats_can_be_chosen(spark):
    rows = log(spark, ("t", "a", "b", "rt", "fake", 1), ("t", "c", "b", "rt", "fake", 2))
    assert clean_interactions(rows).count() == 1
    assert clean_interactions(rows, ("tweet_id", "src_user_id")).count() == 2


def test_two_tweets_add_up(spark):
    rows = log(spark, ("t1", "a", "b", "rt", "fake", 2), ("t2", "a", "b", "reply", "real", 1))
    (edge,) = preprocess.edge_table(rows).collect()
    assert (edge.veracity_score, edge.interaction_count, edge.interaction_type) == (1.2, 2, "reply")
    assert edge.edge_weight == pytest.approx(1.2 + math.log(3))


def test_unused_type_is_not_read_for_the_weight_alone(spark, dirty):
    table = preprocess.run_preprocessing(spark, dirty).select("src_user_id", "dst_user_id", "edge_weight")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan
    assert "IsNotNull(dst_user_id)" in plan


def test_staging_replaces_the_target(spark, dirty, tmp_path):
    target = str(tmp_path / "staged")
    for _ in range(2):
        copy = stage_interactions(spark, dirty, target)
    assert copy.count() == 9
    assert preprocess.run_preprocessing(spark, target).count() == 3
    as_parquet = stage_interactions(spark, dirty, str(tmp_path / "p"), "csv")
    assert as_parquet.count() == 9


def test_staging_raises_when_the_source_is_missing(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stage_interactions(spark, str(tmp_path / "none.csv"), str(tmp_path / "out"))


def test_input_uri():
    assert input_uri(None, "/in/", "/x/log.csv") == "/x/log.csv"
    assert input_uri("hdfs://h:9000", "/in/", "/x/log.csv") == "hdfs://h:9000/in/interactions.csv"


def test_report_has_the_rank_first(spark, tmp_path):
    table = spark.createDataFrame([("n1", 0.7, 1)], "node_id string, influence_score double, rank int")
    path = save_report(table, str(tmp_path / "report"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["rank", "node_id", "influence_score"]
    assert back.collect()[0].asDict() == {"rank": "1", "node_id": "n1", "influence_score": "0.7"}


ODD = [
    ["t1", "a", "b", "rt", " fake", "1"],
    ["t2", "a", "c ", "rt", "fake", "xx"],
    ["t 3", ' "a"', "d\\", "r,t", "fake ", " 4"],
    ["", "a,b", 'q"', "\\", "real", "5"],
]


def test_staging_keeps_every_value(spark, tmp_path):
    import csv

    source = tmp_path / "odd.csv"
    with source.open("w", newline="") as out:
        csv.writer(out).writerows([SCHEMA.names, *ODD])
    copy = stage_interactions(spark, str(source), str(tmp_path / "staged"))
    assert sorted(copy.collect(), key=str) == sorted(load_interactions(spark, str(source)).collect(), key=str)
    texts = spark.read.options(**CSV).csv(str(tmp_path / "staged")).collect()
    expected = [tuple(v if v else None for v in row) for row in ODD]
    assert sorted(map(tuple, texts), key=str) == sorted(expected, key=str)
    edges = {(r.src_user_id, r.dst_user_id) for r in preprocess.run_preprocessing(spark, str(tmp_path / "staged")).collect()}
    assert edges == {("a", "c "), ("a,b", 'q"')}


def test_reports_keep_ids_apart(spark, tmp_path):
    table = spark.createDataFrame([(1, " n1 "), (2, "n1"), (3, 'n"1,')], "rank int, node_id string")
    back = spark.read.options(**CSV).csv(save_report(table, str(tmp_path / "report")))
    assert {r.node_id for r in back.collect()} == {" n1 ", "n1", 'n"1,'}


def test_weights_are_settings(spark, dirty):
    log = load_interactions(spark, dirty)
    params = Params(veracity_weights=(("Fake", 2.0), ("fake", 0.25)))
    scores = [r.veracity_score for r in preprocess.edge_table(log, params).collect()]
    assert sorted(scores) == [0.25, 2.25]
