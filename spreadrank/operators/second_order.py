"""The second-order walk distribution as a table.

For a walker that came from ``prev`` to ``cur``, a successor of ``cur`` weighs ``w/p`` if it is
``prev``, ``w`` if it is also a successor of ``prev``, and ``w/q`` otherwise. Listing all (prev, cur,
successor) would pair each node's in-edges with its out-edges. The sum of the weights needs less:
the total out-weight of ``cur``, the back edge, and the successors shared by ``prev`` and ``cur``.
The shared ones are found from whichever end of the edge has fewer successors, which is the usual
way to enumerate triangles. Where both ends have up to ``PACKED`` successors, these travel as one array to the row
of the other end and are intersected there; of the other edges each successor is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadrank.functions.columns import billionths
from spreadrank.operators.graph import Graph, out_totals
from spreadrank.operators.skew import lookup, salted_join
from spreadrank.params import DEFAULTS, SkewLimits
from spreadrank.storage import materialize

# The most successors of a node that travel as one array, some 10 KB.
PACKED = 256
# Rows with such arrays are split off from fewer rows of a key on, and fewer of them are broadcast.
MOST_WIDE, MOST_WIDE_KEYS = 1_000_000, 2_000


def second_order_totals(
    graph: Graph,
    p: float = DEFAULTS.p,
    q: float = DEFAULTS.q,
    limits: SkewLimits = DEFAULTS.skew,
    asked: DataFrame | None = None,
) -> DataFrame:
    """One row per edge ``prev -> cur`` whose ``cur`` has successors:
    ``(prev, cur, total, prob_return, prob_common, prob_far)``.

    ``total`` is the sum of biased weights; the probabilities are of going back, to a shared
    successor, and to any other node. With ``asked(prev, cur)`` only these states are worked out.
    """
    out = out_totals(graph.edges)
    n = graph.n_edges
    pairs = graph.edges.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    if asked is not None:
        pairs = materialize(pairs.join(asked.select("prev", "cur"), ["prev", "cur"], "left_semi"), "pairs")
    states = lookup(
        pairs,
        out.select(F.col("src").alias("prev"), F.col("out_degree").alias("prev_degree")),
        ["prev"], n, limits=limits,
    )
    states = lookup(
        states,
        out.select(F.col("src").alias("cur"), "out_weight", F.col("out_degree").alias("cur_degree")),
        ["cur"], n, limits=limits, counted=pairs,
    )
    reverse = graph.edges.select(
        F.col("src").alias("cur"), F.col("dst").alias("prev"), F.col("weight").alias("back")
    )
    states = materialize(
        states.join(reverse, ["prev", "cur"], "left").withColumn("back", F.coalesce("back", F.lit(0.0))),
        "states",
    )

    packable = (F.col("prev_degree") <= PACKED) & (F.col("cur_degree") <= PACKED)
    # One row per successor of the smaller end. Many of them can ask for the same edge of a hub.
    least = F.when(~packable, F.least("prev_degree", "cur_degree"))
    n_packable, rows = states.agg(F.count(F.when(packable, 1)), F.coalesce(F.sum(least), F.lit(0))).first()
    found = []
    if n_packable or not rows:
        found.append(_with_packed(graph, states.filter(packable), n_packable, limits))
    if rows:
        listed = states.filter(~packable)
        shared = _shared_weight(graph, listed, rows, limits)
        found.append(listed.join(shared, ["prev", "cur"], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0))))
    columns = ["prev", "cur", "out_weight", "back", "shared"]
    weighed = found[0].select(*columns)
    for more in found[1:]:
        weighed = weighed.unionByName(more.select(*columns))
    back = F.col("back") / p
    far = (F.col("out_weight") - F.col("back") - F.col("shared")) / q
    weighed = weighed.withColumn("total", back + F.col("shared") + far)
    return weighed.select(
        "prev",
        "cur",
        "total",
        (back / F.col("total")).alias("prob_return"),
        (F.col("shared") / F.col("total")).alias("prob_common"),
        (far / F.col("total")).alias("prob_far"),
    )


def _ends(states: DataFrame, *more: str) -> DataFrame:
    """The states with the end of fewer successors as ``near``, the other one as ``far``."""
    from_prev = F.col("prev_degree") <= F.col("cur_degree")
    return states.select(
        "prev",
        "cur",
        F.when(from_prev, F.col("prev")).otherwise(F.col("cur")).alias("near"),
        F.when(from_prev, F.col("cur")).otherwise(F.col("prev")).alias("far"),
        from_prev.alias("from_prev"),
        *more,
    )


def _successors(graph: Graph, limits: SkewLimits) -> DataFrame:
    """``(src, ids, weights, out_weight)``, written, of the nodes with up to ``PACKED`` successors."""
    totals = out_totals(graph.edges)
    few = totals.filter(F.col("out_degree") <= PACKED).select("src")
    packed = lookup(graph.edges, few, ["src"], graph.n_edges, limits=limits).filter(F.col("dst").isNotNull())
    packed = packed.groupBy("src").agg(
        F.collect_list(F.struct("dst", "weight")).alias("to"), F.sum(billionths(F.col("weight"))).cast("double").alias("out_weight")
    )
    return materialize(
        packed.select("src", F.col("to.dst").alias("ids"), F.col("to.weight").alias("weights"), "out_weight"), "successors"
    )


def _shared(both: Column, ids: Column, weights: Column) -> Column:
    """The sum of the ``weights`` to the nodes in ``both``, each in the place that it has in ``ids``.

    Added up as decimals, see ``billionths``; this width leaves room for a sum of ``PACKED`` of them."""
    return F.aggregate(
        both,
        F.lit(0).cast("decimal(37,9)"),
        lambda sum_, x: (sum_ + billionths(F.element_at(weights, F.array_position(ids, x).cast("int")))).cast("decimal(37,9)"),
    ).cast("double")


def _with_packed(graph: Graph, states: DataFrame, rows: int, limits: SkewLimits) -> DataFrame:
    """The ``rows`` states with ``shared``, the weight from ``cur`` to the successors of both ends, which have up to ``PACKED``."""
    packed = _successors(graph, limits)
    wide = SkewLimits(min(limits.min_rows, MOST_WIDE), min(limits.max_hot, MOST_WIDE_KEYS))
    ends = _ends(states, "out_weight", "back")
    # What is on the way to the other end: the weights only if they are those of ``cur``.
    weights = F.when(~F.col("from_prev"), F.col("weights")).alias("near_weights")
    near = packed.select(F.col("src").alias("near"), F.col("ids").alias("near_ids"), "weights")
    met = lookup(ends, near, ["near"], rows, limits=wide)
    met = met.select(*ends.columns, "near_ids", weights)
    far = packed.select(F.col("src").alias("far"), F.col("ids").alias("far_ids"), F.col("weights").alias("far_weights"))
    met = lookup(met, far, ["far"], rows, limits=wide, counted=ends)

    ids = F.when(F.col("from_prev"), F.col("far_ids")).otherwise(F.col("near_ids"))
    weights = F.when(F.col("from_prev"), F.col("far_weights")).otherwise(F.col("near_weights"))
    shared = _shared(F.array_intersect("near_ids", "far_ids"), ids, weights)
    return met.withColumn("shared", shared)


def _shared_weight(graph: Graph, states: DataFrame, rows: int, limits: SkewLimits) -> DataFrame:
    """``(prev, cur, shared)``: weight from ``cur`` to the successors of both ends, of which the smaller have ``rows`` together."""
    ends = _ends(states)
    near = graph.edges.select(
        F.col("src").alias("near"), "dst", F.col("weight").alias("near_weight")
    )
    other = graph.edges.select(
        F.col("src").alias("far"), "dst", F.col("weight").alias("far_weight")
    )
    met = salted_join(ends, near, ["near"], ["prev", "cur"], graph.n_edges, limits)
    if rows > limits.min_rows:
        met = materialize(met, "met")
    met = lookup(met, other, ["far", "dst"], rows, limits=limits)
    from_cur = F.when(F.col("from_prev"), F.col("far_weight")).otherwise(F.col("near_weight"))
    return met.groupBy("prev", "cur").agg(F.sum(billionths(from_cur)).cast("double").alias("shared"))


def transition_bias(
    graph: Graph,
    transitions: DataFrame,
    p: float = DEFAULTS.p,
    q: float = DEFAULTS.q,
    limits: SkewLimits = DEFAULTS.skew,
) -> DataFrame:
    """Biased weight and probability of given ``(prev, cur, dst)`` transitions.

    Transitions whose ``cur -> dst`` is no edge are left out, as are those whose ``prev -> cur`` is none. Where both ends have up to
    ``PACKED`` successors the transitions of a state travel as one row.
    """
    moves = transitions.select("prev", "cur", "dst")
    wide = out_totals(graph.edges).filter(F.col("out_degree") > PACKED).select("src", F.lit(True).alias("wide"))
    wide = materialize(wide, "wide")
    n_wide = wide.count()
    if not n_wide:
        return _bias_packed(graph, moves, p, q, limits)
    # Written, since both kinds of states read it.
    moves = materialize(moves.distinct(), "moves")
    rows = moves.count() if n_wide > limits.max_hot else 0
    marked = moves
    for end in ("prev", "cur"):
        ends = wide.select(F.col("src").alias(end), F.col("wide").alias(f"{end}_wide"))
        if n_wide > limits.max_hot:
            marked = lookup(marked, ends, [end], rows, "left", limits, moves)
        else:
            marked = marked.join(F.broadcast(ends), end, "left")
    marked = marked.withColumn("wide", F.coalesce("prev_wide", "cur_wide", F.lit(False)))
    marked = materialize(marked.select("prev", "cur", "dst", "wide"), "marked")
    few = _bias_packed(graph, marked.filter(~F.col("wide")), p, q, limits)
    return few.unionByName(_bias_listed(graph, marked.filter("wide").select("prev", "cur", "dst"), p, q, limits))


def _without_comma(node: Column) -> Column:
    return F.replace(F.replace(node, F.lit("~"), F.lit("~0")), F.lit(","), F.lit("~1"))


def _bias(p: float, q: float, dst: Column, prev: Column, weight: Column, common: Column) -> Column:
    return F.when(dst == prev, weight / p).when(common, weight).otherwise(weight / q)


def _bias_packed(graph: Graph, moves: DataFrame, p: float, q: float, limits: SkewLimits) -> DataFrame:
    """``transition_bias`` of moves, some of them repeated, between nodes of up to ``PACKED`` successors: the state's moves and the
    successors of ``prev`` travel as arrays to those of ``cur``, where all is known."""
    out = _successors(graph, limits)
    # A row a state, so that its key columns and the successors of ``prev`` travel once for all of its moves.
    states = moves.groupBy("prev", "cur").agg(F.collect_set("dst").alias("dsts"))
    states = materialize(states, "asked")
    rows = states.count()
    wide = SkewLimits(min(limits.min_rows, MOST_WIDE), min(limits.max_hot, MOST_WIDE_KEYS))
    from_prev = out.select(F.col("src").alias("prev"), "ids")
    met = lookup(states, from_prev, ["prev"], rows, limits=wide).filter(F.array_contains("ids", F.col("cur")))
    # On the way as one text, which is half as long as an array of them.
    met = met.select("prev", "cur", "dsts", F.array_join(F.transform("ids", _without_comma), ",").alias("listed"))
    from_cur = out.select(F.col("src").alias("cur"), "ids", "weights", "out_weight", F.transform("ids", _without_comma).alias("codes"))
    met = lookup(met, from_cur, ["cur"], rows, limits=wide, counted=states).withColumn("prev_codes", F.split("listed", ",", -1))

    def weight_to(node: Column) -> Column:
        return F.element_at("weights", F.array_position("ids", node).cast("int"))

    back = F.when(F.array_contains("ids", F.col("prev")), weight_to(F.col("prev"))).otherwise(F.lit(0.0))
    shared = _shared(F.array_intersect("prev_codes", "codes"), F.col("codes"), F.col("weights"))
    total = F.col("back") / p + F.col("shared") + (F.col("out_weight") - F.col("back") - F.col("shared")) / q
    edges = F.filter("dsts", lambda d: F.array_contains("ids", d))
    moved = F.transform(
        edges,
        lambda d: F.struct(
            d.alias("dst"), _bias(p, q, d, F.col("prev"), weight_to(d), F.array_contains("prev_codes", _without_comma(d))).alias("bias")
        ),
    )
    weighed = met.withColumns({"back": back, "shared": shared, "moved": moved}).select(
        "prev", "cur", total.alias("total"), F.explode("moved").alias("move")
    )
    return weighed.select(
        "prev", "cur", "move.dst", "move.bias", (F.col("move.bias") / F.col("total")).alias("prob")
    )


def _bias_listed(graph: Graph, moves: DataFrame, p: float, q: float, limits: SkewLimits) -> DataFrame:
    """``transition_bias`` of distinct moves, one row each, which are written."""
    rows = moves.count()
    weights = graph.edges.select(F.col("src").alias("cur"), "dst", "weight")
    known = graph.edges.select(F.col("src").alias("prev"), "dst", F.lit(True).alias("common"))
    states = materialize(moves.select("prev", "cur").distinct(), "asked")
    totals = second_order_totals(graph, p, q, limits, states).select("prev", "cur", "total")
    found = lookup(moves, weights, ["cur", "dst"], rows, limits=limits)
    found = lookup(found, known, ["prev", "dst"], rows, "left", limits, moves)
    found = lookup(found, totals, ["prev", "cur"], rows, limits=limits, counted=moves)
    bias = _bias(p, q, F.col("dst"), F.col("prev"), F.col("weight"), F.col("common"))
    return found.select("prev", "cur", "dst", bias.alias("bias"), (bias / F.col("total")).alias("prob"))


def observed_transitions(walks: DataFrame) -> DataFrame:
    """Distinct ``(prev, cur, dst)`` that occur in walks; a window group is one walk."""
    along = Window.partitionBy("walk_id").orderBy("step")
    return (
        walks.select(
            F.col("node").alias("prev"),
            F.lead("node", 1).over(along).alias("cur"),
            F.lead("node", 2).over(along).alias("dst"),
        )
        .filter(F.col("dst").isNotNull())
        .distinct()
    )
