"""Settings of the whole run, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field

# The weight of an interaction by the veracity of its content.
VERACITY_WEIGHTS = (("fake", 1.0), ("unverified", 0.5), ("real", 0.2))


@dataclass(frozen=True)
class SkewLimits:
    """When a key counts as hot.

    A key is hot when it holds more than ``threshold(rows)`` of ``rows`` rows. At most ``max_hot``
    keys can be, so a table with one row per hot key is small enough to broadcast at any scale.
    """

    min_rows: int = 10_000_000
    max_hot: int = 100_000

    def threshold(self, rows: int) -> int:
        return max(self.min_rows, rows // self.max_hot)


@dataclass(frozen=True)
class Params:
    """The defaults are those of the published procedure."""

    # Interactions with other labels are dropped. Scores are added up in whole millionths, so more
    # than six digits of a weight are rounded off.
    veracity_weights: tuple[tuple[str, float], ...] = VERACITY_WEIGHTS
    # edges
    min_edge_weight: float = 0.1
    # PageRank: the damping factor is 0.15, so 0.85 of the rank is teleported every round
    damping: float = 0.15
    # the ranks together may change by this much per node, or by the absolute tolerance if there is one
    pagerank_tol: float = 1e-6
    pagerank_abs_tol: float | None = None
    pagerank_max_iter: int = 100
    # walks
    walk_length: int = 30
    num_walks: int = 10
    p: float = 1.0
    q: float = 0.5
    # embedding
    embedding_dim: int = 64
    window: int = 5
    epochs: int = 3
    seed: int = 42
    # influence score: embedding norm, PageRank, weighted out-degree
    alpha: float = 0.3
    beta: float = 0.3
    gamma: float = 0.4
    # communities and reports
    n_clusters: int = 3
    kmeans_restarts: int = 10
    top_n: int = 10
    most_similar_n: int = 5
    plot_points: int = 2000
    # random graphs
    edge_prob: float = 0.15
    fake_ratio: float = 0.7
    # execution
    skew: SkewLimits = field(default_factory=SkewLimits)


DEFAULTS = Params()
