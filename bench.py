"""Times the headline stages and prints one line of JSON.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of cores. Stages run one after the other on the
tables the earlier ones wrote, so every stage is timed once and on its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spreadrank.operators import community, embedding, graph, pagerank, projection, second_order, walks  # noqa: E402
from spreadrank.params import DEFAULTS  # noqa: E402
from spreadrank.plans import influence, preprocess  # noqa: E402
from spreadrank.sources.random_graph import random_graph  # noqa: E402
from spreadrank.storage import materialize  # noqa: E402
from tests.session import new_session  # noqa: E402
from workload import adapter  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = new_session()
    times: dict[str, float] = {}

    def timed(name, work):
        begin = time.time()
        result = work()
        times[name] = round(time.time() - begin, 3)
        return result

    def written(df):
        return materialize(df, "bench")

    spark.range(1000).selectExpr("sum(id)").collect()
    log = timed("adapter", lambda: written(adapter.interactions(spark, sf_dir)))
    edges = timed("edges", lambda: written(preprocess.edge_table(log)))
    g = timed("graph", lambda: graph.build_graph(edges))
    ranks = timed("pagerank", lambda: pagerank.compute_pagerank(g))
    degree = timed("weighted_outdegree", lambda: written(graph.weighted_outdegree(g)))
    timed("transition_prob", lambda: written(graph.transition_probabilities(g)))
    timed("second_order_prob", lambda: written(second_order.second_order_totals(g)))
    paths = timed("walks_10x30", lambda: written(walks.generate_walks(g)))
    vectors = timed("train_64", lambda: written(embedding.train_embeddings(paths)))
    scored = timed("influence", lambda: influence.run_influence_scoring(vectors, ranks, degree))
    clusters = timed("kmeans", lambda: written(community.cluster_nodes(vectors)))
    timed("pca", lambda: written(projection.project(vectors)))
    timed("bridges", lambda: written(community.find_bridges(g, clusters, scored)))

    # The timing procedure of the baseline: random graph, 5 walks of 20 nodes, 32 dimensions.
    for n in (100, 500, 1000):
        drawn = timed(
            f"random_{n}_graph",
            lambda n=n: graph.graph_from_edges(
                random_graph(spark, n).selectExpr(
                    "cast(src as string) src", "cast(dst as string) dst", "weight"
                )
            ),
        )
        trips = timed(f"random_{n}_walks", lambda drawn=drawn: written(walks.generate_walks(drawn, 5, 20)))
        timed(
            f"random_{n}_train",
            lambda trips=trips: written(embedding.train_embeddings(trips, dim=32, epochs=2, seed=DEFAULTS.seed)),
        )

    print(
        json.dumps(
            {
                "metric": "sum of stage times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
