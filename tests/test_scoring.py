from __future__ import annotations

import pytest

from spreadrank.operators import community, scoring, subgraph
from spreadrank.operators.ranking import rank_rows, top_n
from spreadrank.params import SkewLimits
from spreadrank.plans.influence import run_influence_scoring, top_spreaders

NODES = [("n1", 2.0, 0.2, 4.0), ("n2", 1.0, 0.4, 0.0), ("n3", 1.5, 0.4, 2.0)]
COLUMNS = "node_id string, emb_norm double, pagerank double, weighted_outdegree double"


def test_scores(spark):
    ranked = rank_rows(scoring.score(spark.createDataFrame(NODES, COLUMNS)), "influence_score", "node_id")
    rows = [(r.rank, r.node_id, round(r.influence_score, 9)) for r in ranked.orderBy("rank").collect()]
    assert rows == [(1, "n1", 0.7), (2, "n3", 0.65), (3, "n2", 0.3)]


def test_constant_column_scales_to_zero(spark):
    rows = [(n, 2.0, p, w) for n, _, p, w in NODES]
    scored = scoring.score(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {r.node_id: round(r.influence_score, 9) for r in scored} == {"n3": 0.5, "n1": 0.4, "n2": 0.3}
    assert {r.emb_norm_n for r in scored} == {0.0}


def test_missing_measures_are_zero(spark):
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    ranks = spark.createDataFrame([("a", 0.5), ("z", 0.5)], "id string, pagerank double")
    degree = spark.createDataFrame([("z", 1.0)], "id string, weighted_outdegree double")
    rows = run_influence_scoring(vectors, ranks, degree).orderBy("rank").collect()
    assert [(r.node_id, r.emb_norm, r.pagerank, r.weighted_outdegree) for r in rows] == [
        ("a", 5.0, 0.5, 0.0), ("b", 1.0, 0.0, 0.0),
    ]


def test_ranks_over_many_partitions(spark):
    table = spark.range(5000).selectExpr(
        "concat('k', id) as key", "cast((id * 7919) % 613 as double) as score"
    ).repartition(7)
    ranked = rank_rows(table, "score", "key").orderBy("rank").collect()
    expected = sorted(table.collect(), key=lambda r: (-r.score, r.key))
    assert [(r.rank, r.key) for r in ranked] == [(i + 1, r.key) for i, r in enumerate(expected)]
    best = top_n(table, "score", "key", 10).orderBy("rank").collect()
    assert [(r.rank, r.key) for r in best] == [(i + 1, r.key) for i, r in enumerate(expected[:10])]


CLUSTERS = [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 0)]
INFLUENCE = [("a", 0.7), ("b", 0.3), ("c", 0.65), ("d", 0.1), ("e", 0.0)]


def bridges(spark, graph, clusters, influence, **more):
    table = community.find_bridges(
        graph,
        spark.createDataFrame(clusters, "id string, cluster int"),
        spark.createDataFrame(influence, "node_id string, influence_score double"),
        **more,
    )
    return [
        (r.rank, r.node_id, r.own_cluster, r.n_communities_connected,
         None if r.bridge_score is None else round(r.bridge_score, 9))
        for r in table.orderBy("rank").collect()
    ]


@pytest.mark.parametrize("limits", [SkewLimits(), SkewLimits(min_rows=1, max_hot=100)])
def test_bridges(spark, five, limits):
    assert bridges(spark, five, CLUSTERS, INFLUENCE, limits=limits) == [
        (1, "a", 0, 1, 0.7), (2, "c", 1, 1, 0.65), (3, "b", 1, 2, 0.6), (4, "d", 2, 1, 0.1),
    ]


def test_bridges_with_gaps(spark, five):
    found = bridges(spark, five, CLUSTERS[:4], INFLUENCE[1:])
    assert found == [(1, "c", 1, 1, 0.65), (2, "b", 1, 1, 0.3), (3, "d", 2, 1, 0.1), (4, "a", 0, 1, None)]
    assert [r[1] for r in bridges(spark, five, CLUSTERS, INFLUENCE, min_communities=2)] == ["b"]


def test_no_successors_gives_an_empty_table(spark):
    from spreadrank.operators.graph import graph_from_edges

    empty = graph_from_edges(spark.createDataFrame([], "src string, dst string, weight double"))
    assert bridges(spark, empty, CLUSTERS, INFLUENCE) == []


def test_successor_without_cluster_counts_as_none(spark, five):
    found = {r[1]: r[3] for r in bridges(spark, five, [("c", 1), ("d", 0)], INFLUENCE)}
    assert found == {"c": 0, "d": 0}


def test_chart_tables(spark, five):
    influence = spark.createDataFrame(INFLUENCE[:4], "node_id string, influence_score double")
    clusters = spark.createDataFrame(CLUSTERS[:4], "id string, cluster int")
    nodes, edges = subgraph.network_map(five, influence, clusters, top=2)
    found = {r.id: (round(r.size, 6), r.cluster, r.is_top) for r in nodes.collect()}
    assert found == {"a": (2200.0, 0, True), "b": (1000.0, 1, False), "c": (2050.0, 1, True)}
    assert max(r.weight_share for r in edges.collect()) == 1.0
    points = spark.createDataFrame([(c[0], 0.0, 1.0) for c in CLUSTERS], "id string, x double, y double")
    scatter = {r.id: r for r in subgraph.cluster_scatter(points, influence, clusters, top=2).collect()}
    assert scatter["e"].size == pytest.approx(35.0) and scatter["e"].cluster == 0
    assert subgraph.sample_points(points, 3).count() == 3
    bars = subgraph.spreader_bars(influence, 3).collect()
    assert [(r.node_id, r.label) for r in bars] == [("b", "0.300"), ("c", "0.650"), ("a", "0.700")]


def test_top_spreaders(spark):
    table = spark.createDataFrame(INFLUENCE, "node_id string, influence_score double")
    assert [(r.rank, r.node_id) for r in top_spreaders(table, 2).collect()] == [(1, "a"), (2, "c")]
