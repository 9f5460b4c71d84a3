"""Shards that are runs of a Hilbert curve over several metadata columns, with DataFrame functions only.

Each column is cut into 2^bits cells at its quantiles, in the order of its whole values. The cells'
place on the Hilbert curve is a fold over their bits with a table of the curve's states. Rows are sorted by that place
and cut into runs, so neighbours in all columns share a shard and the least and greatest value of each column
in a file let a reader skip it.

Numbers are cut at approximate percentiles. Of any other type the distinct values are counted and sorted, and a value's
cell is the share of rows before it, so values of 2^-bits of the rows or more never share a cell with the next, however alike
they begin. What reaches the driver is one value per cell.

Runs are cut by number of rows: shard sizes differ by one at most. Positions come from a range-partitioned sort and an
offset per partition, never from one task over all rows; ties on the curve are ordered by the columns ``ties``, then by the
rows' place in the files, so neither a hot cell nor repeated rows end up in one partition. A null counts as the least value; empty
texts come next. Very long texts may be rows' values, and of a dimension too, where one per cell is held as a whole.
Repeated rows are each kept, in neighbouring places. An empty table gives an empty result. All columns of the input are kept,
whatever their names; where one is called like a new column, the new one gets an underscore more.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadrank.llm.common import fresh
from spreadrank.storage import materialize


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each state and each choice of one bit per dimension: the place among the 2^dims cells of the
    next level, and the state there. A state is an entry corner and a direction."""
    size = 1 << dims

    def turn(value: int, by: int) -> int:
        by %= dims
        return ((value << by) | (value >> (dims - by))) & (size - 1)

    gray = [i ^ (i >> 1) for i in range(size)]
    place = {g: i for i, g in enumerate(gray)}
    enter = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]

    def ones(i: int) -> int:
        return ((i + 1) & -(i + 1)).bit_length() - 1

    heading = [0] + [(ones(i) if i % 2 else ones(i - 1)) % dims for i in range(1, size)]
    places, states = [], []
    for corner, way, bits in product(range(size), range(dims), range(size)):
        w = place[turn(bits ^ corner, dims - (way + 1) % dims)]
        places.append(w)
        states.append((corner ^ turn(enter[w], way + 1)) * dims + (way + heading[w] + 1) % dims)
    return places, states


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the curve of a cell with ``bits`` bits in each dimension."""
    dims, size = len(cells), 1 << len(cells)
    places, states = (F.array(*map(F.lit, table)) for table in curve_tables(dims))

    def step(acc: Column, level: Column) -> Column:
        chosen = sum(
            (F.call_function("shiftright", cell, level).bitwiseAND(F.lit(1)) * F.lit(1 << i) for i, cell in enumerate(cells)),
            F.lit(0),
        )
        at = acc["state"] * F.lit(size) + chosen
        return F.struct(
            (acc["place"] * F.lit(size) + F.get(places, at)).cast("long").alias("place"),
            F.get(states, at).cast("int").alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).cast("int").alias("state"))
    return F.aggregate(F.array(*map(F.lit, range(bits - 1, -1, -1))), start, step)["place"]


def packed(df: DataFrame) -> DataFrame:
    """All columns as column ``row``, where their names meet no others."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _field(name: str) -> Column:
    return F.col("row").getField(name)


def number_cell(rows: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """The cell of each numeric dimension: how many of its 2^bits - 1 percentiles the value exceeds."""
    if not dims:
        return []
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    values = [_field(name).cast("double") for name in dims]
    cuts = rows.agg(*[F.percentile_approx(v, shares).alias(f"c{i}") for i, v in enumerate(values)]).first()
    cells = []
    for value, limits in zip(values, cuts):
        held = F.array(*map(F.lit, limits)) if limits else F.array().cast("array<double>")
        cells.append(F.size(F.filter(held, _below(value))))
    return cells


def _below(value: Column):
    return lambda cut: cut < F.coalesce(value, cut)


def value_cell(rows: DataFrame, name: str, bits: int) -> Column:
    """The cell of a dimension of any type that can be sorted: the share of all rows that come before its value, in
    2^bits-ths."""
    counts = materialize(rows.groupBy(_field(name).alias("value")).agg(F.count(F.lit(1)).alias("n")), "values")
    ordered = materialize(counts.orderBy("value").withColumn("part", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all")
    )
    running = ordered.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts), "part")
    celled = running.select("value", F.expr(f"(earlier + here) * {1 << bits} div all").cast("int").alias("cell"))
    starts = celled.filter("value is not null").groupBy("cell").agg(F.min("value").alias("value")).orderBy("cell").collect()
    reached = [F.when(_field(name) >= F.lit(start.value), F.lit(start.cell)).otherwise(F.lit(0)) for start in starts]
    return F.greatest(F.lit(0), F.lit(0), *reached)


def place_on_curve(df: DataFrame, dims: list[str], bits: int = 5) -> DataFrame:
    """``row, curve``: each row, packed, and its place. The cuts are quantiles of all rows."""
    rows = packed(df)
    numeric = [name for name in dims if isinstance(df.schema[name].dataType, T.NumericType)]
    cells = dict(zip(numeric, number_cell(rows, numeric, bits)))
    cells |= {name: value_cell(rows, name, bits) for name in dims if name not in cells}
    return rows.withColumn("curve", hilbert_index([cells[name] for name in dims], bits))


def shard_rows(df: DataFrame, dims: list[str], ties: list[str], shards: int, bits: int = 5) -> DataFrame:
    """Add ``curve, shard, slot``: shards from 0 of equal row counts, slots from 0 without gaps. Rows with the
    same place are ordered by ``ties``."""
    placed = materialize(place_on_curve(df, dims, bits), "placed")
    position = F.monotonically_increasing_id()
    ordered = materialize(
        placed.withColumn("place", position)
        .orderBy("curve", *[_field(name) for name in ties], "place")
        .select(
            "row",
            "curve",
            F.shiftright(position, 33).cast("int").alias("part"),
            position.bitwiseAND(F.lit((1 << 33) - 1)).alias("here"),
        ),
        "ordered",
    )
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    # One row for each partition of the sort.
    offsets = sizes.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.sum("n").over(everything).alias("all")
    )
    ranked = ordered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("earlier") + F.col("here"))
    cut = ranked.withColumn("shard", F.expr(f"rank * {shards} div all"))
    first = F.expr(f"(({shards} - 1) + shard * all) div {shards}")
    return cut.select(
        *[_field(c).alias(c) for c in df.columns],
        F.col("curve").alias(fresh(df, "curve")),
        F.col("shard").cast("int").alias(fresh(df, "shard")),
        (F.col("rank") - first).alias(fresh(df, "slot")),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in curve order, so that file statistics prune on every dimension. ``sharded`` is what
    ``shard_rows`` returns: its last two columns are the shard and the slot."""
    shard, slot = (f"`{c}`" for c in sharded.columns[-2:])
    dealt = sharded.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(F.col(shard), F.col(slot))
    dealt.write.partitionBy(sharded.columns[-2]).parquet(path)
