from __future__ import annotations

import pytest

from spreadrank import storage
from spreadrank.operators import graph as g
from spreadrank.operators import pagerank, second_order, skew
from spreadrank.operators.pagerank import NotConverged, compute_pagerank
from spreadrank.operators.second_order import second_order_totals, transition_bias
from spreadrank.operators.skew import hot_keys
from spreadrank.params import SkewLimits
from spreadrank.sources.random_graph import random_graph

TINY = SkewLimits(min_rows=1, max_hot=100)


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_measures(five):
    assert as_dict(g.weighted_outdegree(five)) == pytest.approx(
        {"a": 2.6, "b": 3.0, "c": 0.89, "d": 1.0, "e": 0.0}
    )
    assert as_dict(g.outdegree(five)) == {"a": 2, "b": 2, "c": 1, "d": 1, "e": 0}
    assert g.graph_stats(five).collect()[0] == (5, 6, True)
    assert [r.id for r in g.top_by_outdegree(five, 3).collect()] == ["b", "a", "d"]


@pytest.mark.parametrize("limits", [SkewLimits(), TINY])
def test_pagerank(five, limits):
    ranks = as_dict(compute_pagerank(five, limits=limits))
    assert {k: round(v, 6) for k, v in ranks.items()} == {
        "a": 0.233135, "b": 0.198399, "c": 0.208471, "d": 0.175534, "e": 0.184462,
    }
    assert sum(ranks.values()) == pytest.approx(1.0)


def test_pagerank_stops_at_the_limit(five):
    with pytest.raises(NotConverged):
        compute_pagerank(five, max_iter=2)


def test_pagerank_of_nothing(spark):
    empty = g.graph_from_edges(spark.createDataFrame([], "src string, dst string, weight double"))
    assert compute_pagerank(empty).count() == 0


@pytest.mark.parametrize("limits", [SkewLimits(), TINY])
def test_transition_probabilities(five, limits):
    rows = g.transition_probabilities(five, limits).collect()
    probs = {(r.src, r.dst): r.prob for r in rows}
    assert probs[("a", "b")] == pytest.approx(1.7 / 2.6)
    assert probs[("a", "c")] == pytest.approx(0.9 / 2.6)
    assert len(rows) == 6


def test_sample(five):
    nodes, edges = g.sample_graph(five, 2)
    assert {r.id for r in nodes.collect()} == {"a", "b"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "b")}
    _, edges = g.sample_graph(five, 3)
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")}


def brute_force(rows, p, q):
    out = {}
    for s, d, w in rows:
        out.setdefault(s, {})[d] = w
    totals, moves = {}, {}
    for prev, cur, _ in rows:
        bias = {
            d: w / p if d == prev else w if d in out[prev] else w / q
            for d, w in out.get(cur, {}).items()
        }
        if bias:
            totals[prev, cur] = sum(bias.values())
            for d, b in bias.items():
                moves[prev, cur, d] = (b, b / totals[prev, cur])
    return totals, moves


@pytest.mark.parametrize("limits", [SkewLimits(), TINY])
@pytest.mark.parametrize("p,q", [(1.0, 0.5), (2.0, 0.5), (0.25, 3.0)])
def test_second_order(spark, five, limits, p, q):
    rows = [tuple(r) for r in five.edges.collect()]
    totals, moves = brute_force(rows, p, q)
    found = second_order_totals(five, p, q, limits).collect()
    assert {(r.prev, r.cur): r.total for r in found} == pytest.approx(totals)
    for r in found:
        assert r.prob_return + r.prob_common + r.prob_far == pytest.approx(1.0)
    asked = spark.createDataFrame(list(moves), "prev string, cur string, dst string")
    biased = transition_bias(five, asked, p, q, limits).collect()
    assert {(r.prev, r.cur, r.dst): r.bias for r in biased} == pytest.approx(
        {k: v[0] for k, v in moves.items()}
    )
    assert {(r.prev, r.cur, r.dst): r.prob for r in biased} == pytest.approx(
        {k: v[1] for k, v in moves.items()}
    )


def test_bias_of_the_worked_example(spark, five):
    asked = spark.createDataFrame(
        [("a", "b", "c"), ("a", "b", "e"), ("c", "a", "b"), ("c", "a", "c"), ("a", "b", "d")],
        "prev string, cur string, dst string",
    )
    probs = {(r.prev, r.cur, r.dst): r.prob for r in transition_bias(five, asked).collect()}
    assert probs == pytest.approx(
        {
            ("a", "b", "c"): 2.1 / 3.9,
            ("a", "b", "e"): 1.8 / 3.9,
            ("c", "a", "b"): 3.4 / 4.3,
            ("c", "a", "c"): 0.9 / 4.3,
        }
    )


def test_random_graph(spark):
    table = random_graph(spark, 100).toPandas()
    assert 1485 - 180 < len(table) < 1485 + 180
    assert not table.duplicated(["src", "dst"]).any()
    assert (table.src != table.dst).all()
    assert set(table.weight) == {1.0, 0.2}
    assert abs((table.weight == 1.0).mean() - 0.7) < 0.05
    assert table.dst.between(0, 99).all()
    assert sorted(table.itertuples(index=False)) == sorted(
        random_graph(spark, 100).repartition(3).toPandas().itertuples(index=False)
    )


def test_random_graph_goes_on_where_the_first_draws_end_early(spark, monkeypatch):
    from spreadrank.sources import random_graph as module

    whole = sorted(random_graph(spark, 60).collect())
    monkeypatch.setattr(module, "draws_per_source", lambda n, p: 5)
    assert sorted(random_graph(spark, 60).collect()) == whole


def test_complete_random_graph(spark):
    assert random_graph(spark, 20, edge_prob=1.0).count() == 20 * 19


@pytest.fixture(scope="module")
def tangle(spark):
    """A graph whose weights add up differently in another order."""
    import random

    rnd = random.Random(11)
    pairs = {(rnd.randrange(40), rnd.randrange(40) if i % 3 else 0) for i in range(500)}
    return [(f"n{a}", f"n{b}", rnd.random() * 3 + 1 / 3) for a, b in sorted(pairs) if a != b]


def test_sums_and_walks_do_not_depend_on_the_order_of_the_rows(spark, tangle):
    import random

    from spreadrank.operators.walks import generate_walks

    def measures(rows, parts):
        table = spark.createDataFrame(rows, "src string, dst string, weight double").repartition(parts, "dst")
        graph = g.graph_from_edges(table)
        walks = sorted(generate_walks(graph, 2, 6).collect())
        return as_dict(g.weighted_outdegree(graph)), as_dict(compute_pagerank(graph)), walks

    mixed = random.Random(5).sample(tangle, len(tangle))
    assert measures(tangle, 3) == measures(mixed, 7)


@pytest.mark.parametrize("limits", [SkewLimits(), TINY])
def test_a_round_shuffles_the_ranks_and_no_edges(spark, tangle, monkeypatch, limits):
    graph = g.graph_from_edges(spark.createDataFrame(tangle, "src string, dst string, weight double"))
    looked = []
    monkeypatch.setattr(pagerank, "partitions_for", lambda *a: 3)
    monkeypatch.setattr(pagerank, "hot_keys", lambda *a, **k: looked.append(1) or hot_keys(*a, **k))
    layout = pagerank.lay_out(graph, limits)
    assert len(looked) == (limits is TINY)
    ranks = storage.materialize(
        g.out_totals(graph.edges).selectExpr("src as id", "out_weight", "0.1D as rank"), "ranks"
    )
    plan = pagerank.inflows(layout, ranks)._jdf.queryExecution().executedPlan().toString()
    by_source = [line for line in plan.splitlines() if "Exchange hashpartitioning(src" in line]
    assert len(by_source) == 1 and plan.count("Scan ExistingRDD") == 1
    compute_pagerank(graph, limits=limits)
    assert len(looked) == 2 * (limits is TINY)


def test_absolute_tolerance_runs_on(five):
    few, many = compute_pagerank(five, tol=1.0), compute_pagerank(five, tol=1.0, abs_tol=1e-9)
    assert as_dict(few) != as_dict(many)
    assert as_dict(many) == pytest.approx(as_dict(compute_pagerank(five, rounds=40)), abs=1e-8)


def test_only_asked_states_are_worked_out(spark, five):
    whole = {(r.prev, r.cur): r.total for r in second_order_totals(five).collect()}
    asked = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "b"), ("x", "y")], "prev string, cur string")
    some = second_order_totals(five, asked=asked)
    assert {(r.prev, r.cur): r.total for r in some.collect()} == {k: whole[k] for k in [("a", "b"), ("c", "a")]}


@pytest.mark.parametrize("packed", [0, 4, 256])
def test_packed_and_listed_successors_agree(spark, monkeypatch, packed):
    rows = [(f"n{i}", f"n{j}", 1.0 + (i * 5 + j) % 7 / 3) for i in range(12) for j in range(12) if i != j and (i * j + j) % 12 < i]
    graph = g.graph_from_edges(spark.createDataFrame(rows, "src string, dst string, weight double"))
    monkeypatch.setattr(second_order, "PACKED", packed)
    for limits in (SkewLimits(), TINY):
        totals = {(r.prev, r.cur): r.total for r in second_order_totals(graph, 2.0, 0.5, limits).collect()}
        assert totals == pytest.approx(brute_force([tuple(r) for r in graph.edges.collect()], 2.0, 0.5)[0])


def test_few_successors_are_not_listed_one_by_one(five, monkeypatch):
    def listed(*args):
        raise AssertionError("a row per successor")

    monkeypatch.setattr(second_order, "salted_join", listed)
    assert second_order_totals(five).count() == 5


def test_transitions_are_joined_once_without_hot_keys(spark, five, monkeypatch):
    def branch(*args):
        raise AssertionError("read a second time for keys that are not there")

    monkeypatch.setattr(skew, "split_join", branch)
    asked = spark.createDataFrame([("a", "b", "c"), ("a", "b", "e")], "prev string, cur string, dst string")
    # More rows than the least that can be hot, but no key with so many.
    assert transition_bias(five, asked, limits=SkewLimits(min_rows=1, max_hot=1)).count() == 2


def moves_of_all_states(spark, edges):
    """Every (prev, cur, dst) of an edge and any node, some of them twice, and states that are no edge."""
    nodes = sorted({e[0] for e in edges} | {e[1] for e in edges})
    asked = [(a, b, c) for a, b, _ in edges for c in nodes] + [(nodes[0], nodes[0], nodes[1]), (nodes[-1], nodes[0], None)]
    return spark.createDataFrame(asked + asked[:5], "prev string, cur string, dst string")


def test_transitions_of_a_state_travel_as_one_row(spark, five, monkeypatch):
    asked = moves_of_all_states(spark, [tuple(r) for r in five.edges.collect()])

    def looked_up(*args):
        raise AssertionError("a row for each transition")

    monkeypatch.setattr(second_order, "second_order_totals", looked_up)
    assert transition_bias(five, asked).count() > 0


@pytest.mark.parametrize("packed, max_hot", [(0, 100_000), (1, 100_000), (2, 100_000), (2, 0), (256, 100_000)])
def test_biases_are_the_same_by_row_and_by_state(spark, monkeypatch, packed, max_hot):
    edges = [
        ("a", "b,", 0.1), ("a", "~1", 0.7), ("a", "d", 1.3), ("b,", "a", 0.4), ("b,", "d", 0.2), ("b,", "~1", 2.0), ("~1", "a", 0.3), ("~1", "~1", 0.6), ("d", "", 5.0), ("", "d", 0.9),
    ]
    weight = {(a, b): w for a, b, w in edges}
    graph = g.graph_from_edges(spark.createDataFrame(edges, "src string, dst string, weight double"))
    asked = moves_of_all_states(spark, edges)
    p, q = 4.0, 0.5

    def bias(a, b, c):
        return weight[b, c] / p if c == a else weight[b, c] if (a, c) in weight else weight[b, c] / q

    expected = {}
    for a, b, _ in edges:
        each = {c: bias(a, b, c) for (s, c) in weight if s == b}
        # A node that is both the previous one and a successor of it counts in the total as shared too.
        total = sum(
            weight[b, c] * ((c == a) / p + ((a, c) in weight) + (1 - (c == a) - ((a, c) in weight)) / q) for c in each
        )
        expected |= {(a, b, c): (w, w / total) for c, w in each.items()}
    monkeypatch.setattr(second_order, "PACKED", packed)
    found = transition_bias(graph, asked, p, q, SkewLimits(max_hot=max_hot)).collect()
    assert len(found) == len(expected)
    assert {(r.prev, r.cur, r.dst): (pytest.approx(r.bias), pytest.approx(r.prob)) for r in found} == expected
