"""Newest rows within intervals of one dimension, by dyadic intervals over positions.

The distinct (group, value) points of a table are numbered in order. Positions
2^l * n up to 2^l * (n + 1) make node n of level l; nodes of 64 positions are
blocks. Each point keeps the newest few rows from there to its block's end and
from its block's start. An interval of values is a stretch of positions: the end
of one block, whole blocks, the start of another. What whole blocks hold is
searched once for all probes with the same blocks, as a union of at most two
nodes a level. So a search joins three short lists of ranks a probe, however
many points its interval holds and however hot its group is; blocks and nodes
may reach over groups, as only what lies wholly within a stretch is asked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estate_spark.functions.ordering import number_rows, ordered_layout
from estate_spark.session import materialise, staged

BEFORE, POINT, AFTER = 0, 1, 2  # a bound sorts before or after points of its own value
SUFFIX, PREFIX, MIDDLE, NODE = 0, 1, 2, 3  # from a position to its block's end, from its block's start, whole blocks, a node in a block
BLOCK = 6  # level of the nodes that are blocks


def newest(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key with their ``rank``; cut down on the map side before any shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def count_before(points: DataFrame, bounds: DataFrame, group: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Points with their position ``_i``; bounds with ``_before``, the number of points ahead of them.

    ``bounds`` have the group's columns, ``_v``, ``_kind`` (``BEFORE`` or
    ``AFTER``) and others. Points and bounds are laid out in one order; what is
    ahead of a bound is its place among all rows less its place among bounds.
    """
    others = [c for c in bounds.columns if c not in (*group, "_v", "_kind")]
    rows = bounds.unionByName(points.select(*group, F.col(value).alias("_v"), F.lit(POINT).alias("_kind")), allowMissingColumns=True)
    placed = number_rows(ordered_layout(rows, [*group, "_v", "_kind"]), "_all")
    numbered = number_rows(placed.filter(F.col("_kind") == POINT), "_i").select(*group, F.col("_v").alias(value), "_i")
    bound = number_rows(placed.filter(F.col("_kind") != POINT), "_bound")
    return numbered, bound.select(*group, *others, (F.col("_all") - F.col("_bound")).alias("_before"))


def whole_nodes(low: Column, high: Column) -> Column:
    """``level, node`` of the dyadic intervals that together are positions ``low`` up to ``high``."""

    def at(level: Column) -> Column:
        left = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        right = F.call_function("shiftright", high, level)
        odd = lambda c: (c % 2 == 1) & (left < right)
        node = lambda c, used: F.when(used, F.struct(level.alias("level"), c.alias("node")))
        return F.array_compact(F.array(node(left, odd(left)), node(right - 1, odd(right))))

    levels = F.sequence(F.lit(0), F.ceil(F.log2((high - low).cast("double"))).cast("int"))
    return F.when(high > low, F.flatten(F.transform(levels, at))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))


def _tops(ranks: Column, k: int) -> Column:
    """The first ``k`` of an array of ranks."""
    return F.slice(F.array_sort(ranks), 1, k)


def _first_ranks(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``top``, the first ``k`` ranks ``_r`` of each key, cut down before and after the shuffle."""
    return newest(rows, keys, ["_r"], k).groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("top"))


def _answers(numbered: DataFrame, middles: DataFrame, longest: int, k: int) -> DataFrame:
    """``kind, x, y, top`` of all that a probe may ask for; ``numbered`` has positions ``_i`` and ranks ``_r``."""
    points = _first_ranks(numbered, ["_i"], k).withColumn("block", F.shiftright("_i", BLOCK))
    over = lambda order: Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = lambda order: _tops(F.flatten(F.collect_list("top").over(over(order))), k)
    none = F.lit(0).cast("long")
    points = materialise(points.select("_i", "block", "top", running(F.desc("_i")).alias("after"), running(F.col("_i")).alias("before")))
    ends = [points.select(F.lit(kind).alias("kind"), F.col("_i").alias("x"), none.alias("y"), F.col(c).alias("top")) for kind, c in ((SUFFIX, "after"), (PREFIX, "before"))]

    def nodes(of: DataFrame, at: str, levels: int) -> DataFrame:
        level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
        each = of.select(level, at, "top").select("level", F.expr(f"shiftright({at}, level)").alias("node"), F.explode("top").alias("_r"))
        return _first_ranks(each, ["level", "node"], k)

    within = nodes(points, "_i", BLOCK - 1).select(F.lit(NODE).alias("kind"), F.col("node").alias("x"), F.col("level").cast("long").alias("y"), "top")
    whole = points.filter(F.shiftright(F.col("_i") + 1, BLOCK) > F.col("block")).select("block", F.col("before").alias("top"))
    blocks = nodes(whole, "block", max(0, longest >> BLOCK).bit_length())
    asked = middles.select("x", "y", F.explode(whole_nodes(F.col("x"), F.col("y"))).alias("n")).select("x", "y", "n.*")
    found = asked.join(blocks, ["level", "node"]).select("x", "y", F.explode("top").alias("_r"))
    middle = _first_ranks(found, ["x", "y"], k).select(F.lit(MIDDLE).alias("kind"), "x", "y", "top")
    return ends[0].unionByName(ends[1]).unionByName(within).unionByName(middle)


def _asked(low: Column, high: Column) -> Column:
    """``kind, x, y`` of what together is positions ``low`` up to ``high``: ends of two blocks and what lies between, or nodes in one block."""
    start, stop, none = F.shiftright(low + (1 << BLOCK) - 1, BLOCK), F.shiftright(high, BLOCK), F.lit(0).cast("long")
    inside = (1 << BLOCK) - 1
    ask = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    ends = F.array(
        F.when(low.bitwiseAND(F.lit(inside)) != 0, ask(SUFFIX, low, none)),
        F.when(stop > start, ask(MIDDLE, start, stop)),
        F.when(high.bitwiseAND(F.lit(inside)) != 0, ask(PREFIX, high - 1, none)),
    )
    nodes = F.transform(whole_nodes(low, high), lambda n: ask(NODE, n["node"], n["level"].cast("long")))
    return F.when(high <= low, F.filter(nodes, lambda _: F.lit(False))).when(start <= stop, F.array_compact(ends)).otherwise(nodes)


def rows_between(
    probes: DataFrame, cells: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, value: str = "a"
) -> DataFrame:
    """Candidates for the ``k`` newest rows with a value between ``low`` and ``high`` of each probe.

    ``cells`` hold at most the newest ``k`` rows of each point, in the order
    given. The result has the probe's columns, ``sale``, the point's value, and
    ``sure``: false for the few points so near to an end that rounding may
    decide; for these the caller applies its own exact test. All rows that can
    be among the newest are there. While searched for, a row is its rank in the
    order given and a probe is a number; their columns are joined to the answers.
    """
    keys = [c for c in probes.columns if c not in ("low", "high")]
    numbers = probes.filter("low IS NOT NULL AND high IS NOT NULL").distinct().withColumn("_probe", F.monotonically_increasing_id())
    wanted, ranked = materialise(numbers), number_rows(ordered_layout(staged(cells), order), "_r")
    margin = (1 + F.abs("low") + F.abs("high")) * 1e-9
    ends = {
        "outer_low": (F.col("low") - margin, BEFORE),
        "inner_low": (F.col("low") + margin, BEFORE),
        "inner_high": (F.col("high") - margin, AFTER),
        "outer_high": (F.col("high") + margin, AFTER),
    }
    end = F.explode(F.array(*[F.struct(F.lit(i).alias("end"), v.alias("_v"), F.lit(kind).alias("_kind")) for i, (v, kind) in enumerate(ends.values())]))
    bounds = wanted.select(*group, "_probe", end.alias("b"))
    points, found = count_before(ranked.select(*group, value).distinct(), bounds.select(*group, "_probe", "b.*"), group, value)
    placed = found.groupBy("_probe").agg(*[F.max(F.when(F.col("end") == i, F.col("_before"))).alias(n) for i, n in enumerate(ends)])
    inner_high = F.greatest("inner_low", "inner_high")
    placed = materialise(placed.withColumn("inner_high", inner_high).filter("outer_low < outer_high"))
    longest = placed.agg(F.max(F.col("inner_high") - F.col("inner_low"))).first()[0] or 0

    numbered = materialise(ranked.join(points, [*group, value]).select("_i", "_r"))
    asked = placed.select("_probe", F.explode(_asked(F.col("inner_low"), F.col("inner_high"))).alias("q")).select("_probe", "q.*")
    middles = asked.filter(F.col("kind") == MIDDLE).select("x", "y").distinct()
    met = asked.join(_answers(numbered, middles, int(longest), k), ["kind", "x", "y"])
    best = met.groupBy("_probe").agg(_tops(F.flatten(F.collect_list("top")), k).alias("top"))
    sure = best.select("_probe", F.explode("top").alias("_r"), F.lit(True).alias("sure"))

    span = lambda low, high: F.when(F.col(low) < F.col(high), F.sequence(F.col(low), F.col(high) - 1)).otherwise(F.array().cast("array<bigint>"))
    edge = F.explode(F.concat(span("outer_low", "inner_low"), span("inner_high", "outer_high")))
    edges = placed.select("_probe", edge.alias("_i")).join(numbered, "_i").select("_probe", "_r", F.lit(False).alias("sure"))
    rows = ranked.select("_r", value, "sale")
    return sure.unionByName(edges).join(rows, "_r").join(wanted.select("_probe", *keys), "_probe").select(*keys, value, "sale", "sure")


def nearest_points(probes: DataFrame, cells: DataFrame, group: Sequence[str], at: str, k: int, value: str = "a") -> DataFrame:
    """Rows of the ``k`` points next to a probe's value on either side, in its group."""
    wanted, cells = materialise(probes.filter(F.col(at).isNotNull()).distinct()), materialise(cells)
    bounds = wanted.withColumns({"_v": F.col(at).cast("double"), "_kind": F.lit(BEFORE)})
    points, found = count_before(cells.select(*group, value).distinct(), bounds, group, value)
    near = found.withColumn("_i", F.explode(F.sequence(F.col("_before") - k, F.col("_before") + k - 1))).drop("_before")
    return near.join(cells.join(points, [*group, value]), [*group, "_i"]).drop("_i")
