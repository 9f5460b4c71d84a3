"""One callable per query: (spark, sf_dir) -> DataFrame. Numbers are rounded for comparison.

Sums of weights have nine decimals, so they are rounded to nine: to fewer, the two engines would have ties to settle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadrank.operators import community, embedding, graph, kmeans, pagerank, projection, scoring, similarity, subgraph, walks
from spreadrank.functions.columns import l2_norm, squared_distance
from spreadrank.operators import second_order
from spreadrank.operators.cleaning import clean_interactions
from spreadrank.operators.skipgram import train_skipgram
from spreadrank.params import DEFAULTS, Params
from spreadrank.plans import communities, influence, preprocess, run
from spreadrank.sources.interactions import CSV, stage_interactions
from spreadrank.sources.reports import save_report
from spreadrank.storage import materialize, new_folder
from workload import adapter


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def graph_of(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return graph.build_graph(preprocess.edge_table(adapter.interactions(spark, sf_dir)))


def scores_of(spark: SparkSession, sf_dir: str, g: graph.Graph) -> DataFrame:
    norms = scoring.embedding_norms(adapter.stand_in_vectors(spark, sf_dir))
    return scoring.build_scores(norms, pagerank.compute_pagerank(g), graph.weighted_outdegree(g))


def influence_of(spark: SparkSession, sf_dir: str, g: graph.Graph) -> DataFrame:
    return influence.run_influence_scoring(
        adapter.stand_in_vectors(spark, sf_dir),
        pagerank.compute_pagerank(g),
        graph.weighted_outdegree(g),
    )


SCALED = ["emb_norm_n", "pagerank_n", "outdegree_n"]
MEASURES = ["emb_norm", "pagerank"]


def q_clean(spark, sf):
    return clean_interactions(adapter.interactions(spark, sf))


def q_weighted(spark, sf):
    return preprocess.weighted_interactions(adapter.interactions(spark, sf))


def q_edges(spark, sf):
    return rounded(
        preprocess.edge_table(adapter.interactions(spark, sf)), "veracity_score", "edge_weight"
    )


def q_edges_min_weight(spark, sf):
    table = preprocess.edge_table(adapter.interactions(spark, sf), Params(min_edge_weight=1.5))
    return rounded(table, "veracity_score", "edge_weight")


def q_stage_counts(spark, sf):
    return preprocess.stage_counts(adapter.interactions(spark, sf))


def q_observed_counts(spark, sf):
    """The stage counts as they are seen while the edges are written."""
    return preprocess.observed_edges(adapter.interactions(spark, sf))[1]


def q_report_round_trip(spark, sf):
    """The ranked report, published twice and read back."""
    path = new_folder(spark, "report")
    save_report(spark.range(3).withColumnRenamed("id", "rank"), path)
    save_report(influence_of(spark, sf, graph_of(spark, sf)), path)
    back = spark.read.options(**CSV).csv(path)
    return back.select(F.col("rank").cast("long").alias("rank"), "node_id", F.round(F.col("influence_score").cast("double"), 6).alias("influence_score"))


def q_graph_nodes(spark, sf):
    return graph_of(spark, sf).nodes


def q_graph_stats(spark, sf):
    return graph.graph_stats(graph_of(spark, sf))


def q_top5(spark, sf):
    return rounded(graph.top_by_outdegree(graph_of(spark, sf)), "weighted_outdegree", digits=9)


def q_weighted_outdegree(spark, sf):
    return rounded(graph.weighted_outdegree(graph_of(spark, sf)), "weighted_outdegree", digits=9)


def q_outdegree(spark, sf):
    return graph.outdegree(graph_of(spark, sf))


def q_pagerank(spark, sf):
    return rounded(pagerank.compute_pagerank(graph_of(spark, sf)), "pagerank", digits=9)


def q_transition_prob(spark, sf):
    return rounded(rounded(graph.transition_probabilities(graph_of(spark, sf)), "weight", digits=9), "prob", digits=8)


def q_second_order(spark, sf):
    table = second_order.second_order_totals(graph_of(spark, sf))
    return rounded(rounded(table, "total", digits=9), "prob_return", "prob_common", "prob_far")


def q_transition_bias(spark, sf):
    g = graph_of(spark, sf)
    seen = second_order.observed_transitions(walks.generate_walks(g))
    return rounded(rounded(second_order.transition_bias(g, seen), "bias", digits=9), "prob")


def q_walks(spark, sf):
    return walks.generate_walks(graph_of(spark, sf))


def q_walks_vocab(spark, sf):
    return walks.ranked_vocabulary(walks.generate_walks(graph_of(spark, sf)))


def q_csv_round_trip(spark, sf):
    """The log as CSV, staged, and read again: every value is what it was."""
    source, target = new_folder(spark, "log"), new_folder(spark, "staged")
    adapter.interactions(spark, sf).write.options(**CSV).csv(source)
    return stage_interactions(spark, source, target)


def q_sample_nodes(spark, sf):
    return graph.sample_graph(graph_of(spark, sf), 50)[0]


def q_sample_edges(spark, sf):
    return rounded(graph.sample_graph(graph_of(spark, sf), 50)[1], "weight", digits=9)


def q_ego_network(spark, sf):
    g = graph_of(spark, sf)
    nodes, edges = subgraph.ego_network(g, influence_of(spark, sf, g))
    return rounded(edges, "weight", digits=9)


def q_embedding_norm(spark, sf):
    return rounded(scoring.embedding_norms(adapter.stand_in_vectors(spark, sf)), "emb_norm")


def q_most_similar(spark, sf):
    return rounded(embedding.most_similar(adapter.stand_in_vectors(spark, sf), "u7"), "similarity")


def q_most_similar_unknown(spark, sf):
    return embedding.most_similar(adapter.stand_in_vectors(spark, sf), "nobody")


def q_most_similar_many(spark, sf):
    vectors = adapter.stand_in_vectors(spark, sf)
    wanted = vectors.filter(F.substring("id", 2, 20).cast("long") % 25 == 0).select("id")
    return rounded(similarity.most_similar_many(vectors, wanted), "similarity")


def q_score_inputs(spark, sf):
    return rounded(rounded(scores_of(spark, sf, graph_of(spark, sf)), *MEASURES), "weighted_outdegree", digits=9)


def q_score_scaled(spark, sf):
    scaled = scoring.scale_columns(scores_of(spark, sf, graph_of(spark, sf)))
    return rounded(scaled.select("node_id", *SCALED), *SCALED)


def q_influence(spark, sf):
    ranked = influence_of(spark, sf, graph_of(spark, sf))
    return rounded(rounded(ranked, *MEASURES, *SCALED, "influence_score"), "weighted_outdegree", digits=9)


def q_top_spreaders(spark, sf):
    scored = scoring.score(scores_of(spark, sf, graph_of(spark, sf)))
    best = influence.top_spreaders(scored)
    return rounded(best.select("rank", "node_id", "influence_score"), "influence_score")


def q_nearest_centroid(spark, sf):
    vectors = adapter.stand_in_vectors(spark, sf)
    centers = community.centroids(vectors, adapter.stand_in_clusters(spark, sf))
    return community.nearest_centroid(vectors, centers)


def q_community_sizes(spark, sf):
    return community.community_sizes(adapter.stand_in_clusters(spark, sf), 4)


def q_bridges(spark, sf):
    g = graph_of(spark, sf)
    clusters = adapter.stand_in_clusters(spark, sf)
    bridges = community.find_bridges(g, clusters, influence_of(spark, sf, g))
    return rounded(bridges, "influence_score", "bridge_score")


def q_plot_network_nodes(spark, sf):
    g = graph_of(spark, sf)
    clusters = adapter.stand_in_clusters(spark, sf)
    return rounded(subgraph.network_map(g, influence_of(spark, sf, g), clusters)[0], "size", digits=4)


def q_plot_network_edges(spark, sf):
    g = graph_of(spark, sf)
    clusters = adapter.stand_in_clusters(spark, sf)
    return rounded(subgraph.network_map(g, influence_of(spark, sf, g), clusters)[1], "weight_share")


def q_plot_points(spark, sf):
    g = graph_of(spark, sf)
    points = adapter.stand_in_points(spark, sf)
    clusters = adapter.stand_in_clusters(spark, sf)
    table = subgraph.cluster_scatter(points, influence_of(spark, sf, g), clusters, n=100)
    return rounded(rounded(table, "size", digits=4), "x", "y")


def q_plot_bars(spark, sf):
    return rounded(
        subgraph.spreader_bars(influence_of(spark, sf, graph_of(spark, sf))), "influence_score"
    )


def q_successors(spark, sf):
    g = graph_of(spark, sf)
    best = subgraph.best_nodes(influence_of(spark, sf, g), 10)
    return rounded(graph.successors(g, best), "weight", digits=9)


def sound(vectors: DataFrame) -> DataFrame:
    """What must hold of every trained vector; its numbers are learned and in no SQL. Vectors that training has not moved are
    within 0.5 / 8 of zero."""
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = l2_norm(F.col("vector")) > 0.1
    return vectors.select("id", F.size("vector").alias("length"), finite.alias("finite"), moved.alias("moved"))


def q_skipgram(spark, sf):
    paths = materialize(walks.generate_walks(graph_of(spark, sf)), "walks")
    return sound(train_skipgram(paths, walks.vocabulary(paths), dim=64, epochs=3))


def q_node2vec(spark, sf):
    return sound(embedding.run_node2vec(graph_of(spark, sf)))


def q_kmeans(spark, sf):
    """Whether each label is one of the three and that of the nearest mean of a label's vectors, and whether these
    labels cost as little as the cheapest of the ten runs."""
    vectors = materialize(adapter.stand_in_vectors(spark, sf), "vectors")
    clusters = materialize(community.cluster_nodes(vectors), "clusters")
    means = community.centroids(vectors, clusters)
    far = squared_distance(F.col("vector"), F.col("centroid"))
    apart = vectors.crossJoin(F.broadcast(means.limit(3))).select("id", F.col("cluster").alias("mean"), far.alias("far"))
    nearest = apart.groupBy("id").agg(F.min("far").alias("least"), F.collect_list(F.struct("mean", "far")).alias("each"))
    own = F.filter("each", lambda m: m["mean"] == F.col("cluster"))[0]["far"]
    rows = materialize(clusters.join(nearest, "id").withColumn("own", own), "kmeans")
    runs = kmeans.fit_all(vectors, DEFAULTS.n_clusters, DEFAULTS.seed, DEFAULTS.kmeans_restarts)
    least = min((r.cost for r in runs), default=0.0)
    cost = rows.agg(F.coalesce(F.sum("own"), F.lit(0.0))).first()[0]
    return rows.select(
        "id",
        F.col("cluster").between(0, 2).alias("is_label"),
        (F.col("own") <= F.col("least") + 1e-3).alias("is_nearest"),
        F.lit(len({r.cost for r in runs}) > 0 and cost <= least * (1 + 1e-4) + 1e-6).alias("is_cheapest"),
    )


def q_pca(spark, sf):
    """What must hold of principal components: centred, uncorrelated, the first with more variance."""
    points = projection.project(adapter.stand_in_vectors(spark, sf))

    def zero(value):
        return F.abs(F.round(value, 6))

    return points.agg(
        F.count(F.lit(1)).alias("n"),
        zero(F.avg("x")).alias("mean_x"),
        zero(F.avg("y")).alias("mean_y"),
        zero(F.covar_pop("x", "y")).alias("covariance"),
        (F.var_pop("x") > F.var_pop("y")).alias("variance_falls"),
    )


def q_pca_covariance(spark, sf):
    """Covariance of each pair of components, from which the axes are made."""
    known = projection.moments(adapter.stand_in_vectors(spark, sf))
    if known is None:
        return spark.createDataFrame([], "i int, j int, covariance double")
    table = [(i, j, float(v)) for i, line in enumerate(known.covariance) for j, v in enumerate(line) if i <= j]
    return rounded(spark.createDataFrame(table, "i int, j int, covariance double"), "covariance", digits=9)


def q_pca_projection(spark, sf):
    """Every vector's place in the plane."""
    return rounded(projection.project(adapter.stand_in_vectors(spark, sf)), "x", "y")


def q_clustering_bridges(spark, sf):
    """Every node with successors and a cluster; clusters are learned, so only what must hold of a row."""
    g = graph_of(spark, sf)
    tables = communities.run_clustering(
        adapter.stand_in_vectors(spark, sf), g, influence_of(spark, sf, g)
    )
    number = F.col("n_communities_connected")
    product = F.col("influence_score") * number
    return tables["bridges"].select(
        "node_id",
        (F.abs(F.col("bridge_score") - product) < 1e-12).alias("score_is_product"),
        number.between(0, 3).alias("count_in_range"),
    )


def q_full_run(spark, sf):
    """The whole run; of its influence table the columns that do not rest on learned vectors."""
    table = run.run(adapter.interactions(spark, sf))["influence"]
    table = table.select("node_id", "pagerank", "weighted_outdegree", "pagerank_n", "outdegree_n")
    return rounded(rounded(table, "pagerank", "weighted_outdegree", digits=9), "pagerank_n", "outdegree_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_round_trip": q_csv_round_trip,
    "clean_interactions": q_clean,
    "weighted_interactions": q_weighted,
    "edges": q_edges,
    "edges_min_weight": q_edges_min_weight,
    "stage_counts": q_stage_counts,
    "observed_counts": q_observed_counts,
    "report_round_trip": q_report_round_trip,
    "graph_nodes": q_graph_nodes,
    "graph_stats": q_graph_stats,
    "top5_outdegree": q_top5,
    "weighted_outdegree": q_weighted_outdegree,
    "outdegree": q_outdegree,
    "pagerank": q_pagerank,
    "transition_prob": q_transition_prob,
    "second_order_prob": q_second_order,
    "transition_bias": q_transition_bias,
    "walks": q_walks,
    "walks_vocab": q_walks_vocab,
    "sample_graph": q_sample_nodes,
    "sample_graph_edges": q_sample_edges,
    "ego_network": q_ego_network,
    "embedding_norm": q_embedding_norm,
    "most_similar": q_most_similar,
    "most_similar_unknown": q_most_similar_unknown,
    "most_similar_many": q_most_similar_many,
    "score_inputs": q_score_inputs,
    "score_scaled": q_score_scaled,
    "influence": q_influence,
    "top_spreaders": q_top_spreaders,
    "nearest_centroid": q_nearest_centroid,
    "community_sizes": q_community_sizes,
    "bridges": q_bridges,
    "plot_network_nodes": q_plot_network_nodes,
    "plot_network_edges": q_plot_network_edges,
    "plot_points": q_plot_points,
    "plot_bars": q_plot_bars,
    "successors": q_successors,
    "skipgram_in_tables": q_skipgram,
    "node2vec_vectors": q_node2vec,
    "kmeans_clusters": q_kmeans,
    "pca_points": q_pca,
    "pca_covariance": q_pca_covariance,
    "pca_projection": q_pca_projection,
    "clustering_bridges": q_clustering_bridges,
    "full_run": q_full_run,
}
