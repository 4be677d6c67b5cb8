"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees with a chi-square stopping test.

Largest inner product becomes nearest distance by one more coordinate, which
brings all candidates to one norm. Vectors are projected on a few Gaussian
(2-stable) directions: the projected squared distance over the true one then
follows the chi-square distribution with as many degrees of freedom. Cells of a
kd-tree over the projections take the candidates to tasks, blocks of bounded
size within a cell have a kd-tree of their own. A query takes the leaves in
order of projected distance, verifies their vectors, and stops once a vector
nearer than its k-th best would, with the wanted probability, have been seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estate_spark.session import materialise

PROJECTIONS = 8  # even: the distribution then has a closed form
SURE = 0.9  # probability of the stopping test
CELL_ROWS = 8_192  # distinct candidates in a block, about
QUERY_ROWS = 4_096  # distinct queries against a block at once, about
ROUNDING = 1e-9  # relative error that products by matrix may have
MOST_CELLS = 4_096
SAMPLE_ROWS = 20_000  # vectors from which the cells are cut; every vector is indexed
LEAF_ROWS = 64
LEAVES_AT_ONCE = 8
SEED = 23


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function with PROJECTIONS degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(PROJECTIONS // 2))


def surely(p: float) -> float:
    """The value that the distribution reaches at ``p``."""
    low, high = 0.0, 200.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < p else (low, middle)
    return high


def vectors(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    return values.astype(np.float64).reshape(-1, size)


@dataclass(frozen=True)
class Projector:
    """The augmented, projected place of candidates and queries."""

    directions: np.ndarray  # [size + 1, PROJECTIONS]
    norm: float  # the largest of any candidate

    def candidates(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        return np.column_stack([x, rest]) @ self.directions

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.linalg.norm(q, axis=1))[:, None]) @ self.directions[:-1]

    def distance(self, q: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Squared distance of augmented vectors from inner products with ``q``."""
        return np.maximum(2 * self.norm**2 - 2 * self.norm * products / np.linalg.norm(q), 0)


def halve(points: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Leaves of a kd-tree: rows halved at the median of the widest coordinate until no more than ``size``."""
    if len(rows) <= size:
        yield rows
        return
    spread = points[rows].max(0) - points[rows].min(0)
    order = rows[np.argsort(points[rows, spread.argmax()], kind="stable")]
    yield from halve(points, order[: len(order) // 2], size)
    yield from halve(points, order[len(order) // 2 :], size)


@dataclass(frozen=True)
class Cells:
    """A kd-tree's cuts: inner node i has children 2i+1 and 2i+2."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int

    @staticmethod
    def build(sample: np.ndarray, cells: int) -> Cells:
        depth = max(0, math.ceil(math.log2(max(1, cells))))
        axis, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        held = {0: np.arange(len(sample))}
        for node in range((1 << depth) - 1):
            rows = held.pop(node)
            if len(rows):
                axis[node] = (sample[rows].max(0) - sample[rows].min(0)).argmax()
                cut[node] = np.median(sample[rows, axis[node]])
            left = sample[rows, axis[node]] <= cut[node]
            held[2 * node + 1], held[2 * node + 2] = rows[left], rows[~left]
        return Cells(axis, cut, depth)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared projected distance of each point to each cell's box."""
        side = np.zeros((len(points), 1, points.shape[1]))
        for level in range(self.depth):
            nodes = np.arange((1 << level) - 1, (1 << level + 1) - 1)
            off = points[:, self.axis[nodes]] - self.cut[nodes]
            both = np.repeat(side, 2, axis=1)
            at = np.arange(len(nodes))
            for child, beyond in ((0, np.maximum(off, 0)), (1, np.maximum(-off, 0))):
                place = both[:, 2 * at + child, self.axis[nodes]]
                both[:, 2 * at + child, self.axis[nodes]] = np.maximum(place, beyond)
            side = both
        return (side**2).sum(2)


def search(projector: Projector, x: np.ndarray, ids: np.ndarray, q: np.ndarray, worst: np.ndarray, k: int, factor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its up to ``k`` best rows of one block and their inner products, ties to the smaller of ``ids``.

    ``worst`` is the squared distance of each query's k-th best so far: nothing
    beyond it is wanted. All rows that may tie with the k-th are held until
    their exact products and ids decide.
    """
    points, targets = projector.candidates(x), projector.queries(q)
    leaves = list(halve(points, np.arange(len(x)), LEAF_ROWS))
    order = np.concatenate(leaves)
    bounds = np.cumsum([0, *map(len, leaves)])
    held = x[order]
    low = np.array([points[rows].min(0) for rows in leaves])
    high = np.array([points[rows].max(0) for rows in leaves])
    for number, target in enumerate(targets):
        gap = (np.maximum(np.maximum(low - target, target - high), 0) ** 2).sum(1)
        nearest = np.argsort(gap, kind="stable")
        limit = float(worst[number])
        rows, products = np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(nearest), LEAVES_AT_ONCE):
            taken = nearest[start : start + LEAVES_AT_ONCE]
            if gap[taken[0]] > factor * limit:
                break
            more = np.concatenate([np.arange(bounds[leaf], bounds[leaf + 1]) for leaf in taken])
            rows = np.concatenate([rows, more])
            products = np.concatenate([products, held[more] @ q[number]])
            if len(rows) >= k:
                last = -np.partition(-products, k - 1)[k - 1]
                tied = products >= last - ROUNDING * max(1.0, abs(last))
                rows, products = rows[tied], products[tied]
                limit = min(limit, float(projector.distance(q[number], last)))
        exact, rows = (held[rows] * q[number]).sum(1), order[rows]
        best = np.lexsort((ids[rows], -exact))[:k]
        yield number, rows[best], exact[best]


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", sure: float = SURE) -> DataFrame:
    """Each query's ``k`` largest inner products found: query_id, rank, ``key``, score; ties to the smaller key.

    Candidates are all rows of ``table`` but the query's own key. Vectors that
    are null, zero, of another length than most, or hold null or non-finite
    components take no part; nor do rows with a null key. Equal vectors are
    searched once: of each the k + 1 smallest keys can be results, and queries
    with equal vectors share an answer. Scores are in double precision.
    """
    spark = table.sparkSession
    clean = usable(table, key, vector)
    common = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    size = common.n
    clean = clean.where(F.size("v") == size)
    wanted = usable(queries, key, vector).where(F.size("v") == size)
    by_key = Window.partitionBy("v").orderBy("id")
    distinct = clean.withColumn("r", F.row_number().over(by_key)).where(F.col("r") <= k + 1)
    distinct = distinct.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = wanted.select("v").distinct().withColumn("asked", F.lit(True))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double")))
    base = materialise(distinct.join(asked, "v", "full_outer").select("v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"), norm.alias("norm")))
    stats = base.where("ids IS NOT NULL").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).first()
    if not stats.n:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")

    random = np.random.default_rng(SEED)
    projector = Projector(random.standard_normal((size + 1, PROJECTIONS)), float(stats.norm))
    sample = base.where("ids IS NOT NULL").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).select("v").collect()
    cells = Cells.build(projector.candidates(np.array([r.v for r in sample], np.float64)), min(MOST_CELLS, -(-stats.n // CELL_ROWS)))
    factor = surely(sure)
    shared = spark.sparkContext.broadcast((projector, cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree = shared.value
        for batch in batches:
            x = vectors(batch.column(0), size)
            home = tree.of(here.candidates(x)) if len(x) else np.zeros(0, np.int64)
            own = tree.of(here.queries(x)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(own)], [*batch.schema.names, "cell", "home"])

    placed = base.select("v", "ids", "asked").mapInArrow(place, f"v {table.schema[vector].dataType.simpleString()}, ids array<long>, asked boolean, cell long, home long")
    named = materialise(placed.withColumn("h", F.xxhash64("v")))
    counts = {r.cell: r["count"] for r in named.where("ids IS NOT NULL").groupBy("cell").count().collect()}
    parts = {cell: -(-n // CELL_ROWS) for cell, n in counts.items()}
    blocks_of = F.lit(np.array([parts.get(c, 1) for c in range(1 << cells.depth)], np.int64))
    candidates = named.where("ids IS NOT NULL").select("cell", "v", "h", F.get("ids", F.lit(0)).alias("id"), F.pmod("h", F.get(blocks_of, F.col("cell").cast("int"))).alias("part"))
    # queries of neighbouring home cells meet blocks together: they ask for much the same ones
    at_cell = {r.home: r["count"] for r in named.where("asked").groupBy("home").count().collect()}
    broad = max(0, (QUERY_ROWS * (1 << cells.depth) // max(1, sum(at_cell.values()))).bit_length() - 1)
    in_group = np.zeros((((1 << cells.depth) - 1) >> broad) + 1, np.int64)
    np.add.at(in_group, np.array(list(at_cell), np.int64) >> broad, np.array(list(at_cell.values()), np.int64))
    region = F.shiftright("home", broad)
    share = F.pmod(F.xxhash64("v", F.lit(1)), F.get(F.lit(np.maximum(1, -(-in_group // QUERY_ROWS))), region.cast("int")))
    asking = named.where("asked").select("v", "h", "home", (region * F.lit(1 << 32) + share).alias("queries"))
    kind = f"v {table.schema[vector].dataType.simpleString()}"

    def gather(routed: DataFrame) -> DataFrame:
        """Best rows of each (query, block) pair of ``routed``: cell, part, queries, v, h, worst."""
        pairs = routed.select("cell", "part", "queries").distinct()
        against = candidates.join(pairs, ["cell", "part"]).select("cell", "part", "queries", "v", "h", "id").toDF("in_cell", "in_part", "by", "v", "h", "id")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            here, _ = shared.value
            names, ids, out = right.column("h").to_numpy(), right.column("id").to_numpy(), ([], [], [], [])
            if left.num_rows and right.num_rows:
                x, q = vectors(right.column("v"), size), vectors(left.column("v"), size)
                asked_by = left.column("h").to_numpy()
                for number, rows, scores in search(here, x, ids, q, left.column("worst").to_numpy(), k + 1, factor):
                    out[0].append(np.full(len(rows), asked_by[number]))
                    out[1].append(names[rows])
                    out[2].append(ids[rows])
                    out[3].append(scores)
            joined = [np.concatenate(part) if part else np.zeros(0, t) for part, t in zip(out, ("i8", "i8", "i8", "f8"))]
            return pa.table([pa.array(a) for a in joined], names=["q", "c", "id", "score"])

        asked_for = routed.groupBy("cell", "part", "queries")
        return asked_for.cogroup(against.groupBy("in_cell", "in_part", "by")).applyInArrow(meet, "q long, c long, id long, score double")

    top = Window.partitionBy("q").orderBy(F.desc("score"), "id")  # each vector's smallest id
    at_home = asking.join(named.where("ids IS NOT NULL").select(F.col("cell")).distinct(), F.col("home") == F.col("cell"))
    at_home = at_home.select("cell", F.explode(F.sequence(F.lit(0), F.get(blocks_of, F.col("cell").cast("int")) - 1)).alias("part"), "queries", "v", "h", F.lit(math.inf).alias("worst"))
    first = materialise(gather(at_home).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1))
    reach = first.groupBy("q").agg(F.max(F.when(F.col("r") == k + 1, F.col("score"))).alias("least"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                x, least = vectors(part.column(0), size), part.column(4).to_numpy(zero_copy_only=False).astype(float)
                norms = np.linalg.norm(x, axis=1)
                worst = np.where(np.isnan(least), np.inf, np.maximum(2 * here.norm**2 - 2 * here.norm * least / norms, 0))
                near = tree.gaps(here.queries(x)) <= factor * worst[:, None]
                near[np.arange(len(x)), part.column(2).to_numpy()] = False
                rows, cell = np.nonzero(near)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), part.column(3).take(take), pa.array(cell), pa.array(worst[rows])],
                    ["v", "h", "queries", "cell", "worst"],
                )

    waiting = asking.join(reach, F.col("h") == F.col("q"), "left").select("v", "h", "home", "queries", "least")
    routed = waiting.mapInArrow(route, f"{kind}, h long, queries long, cell long, worst double")
    routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(blocks_of, F.col("cell").cast("int")) - 1)))
    routed = routed.select("cell", F.col("part").cast("long"), "queries", "v", "h", "worst")
    found = first.select("q", "c", "id", "score").unionByName(gather(routed))
    best = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("q", "c", "score")

    ids = named.where("ids IS NOT NULL").select(F.col("h").alias("c"), "ids")
    by_rank = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    listed = best.join(ids, "c").select("q", "score", F.explode("ids").alias("id"))
    listed = listed.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= k + 1)
    answers = listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.col("r"), F.col("id"), F.col("score")))).alias("found"))
    who = wanted.select(F.col("id").alias("query_id"), F.xxhash64("v").alias("q"))
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    out = who.join(answers, "q").select("query_id", F.posexplode(others).alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.id").alias(key), F.col("f.score").alias("score"))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of the rows that take part; -0.0 counts as 0.0."""
    plain = df.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda c: c + F.lit(0).cast("float")).alias("v"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf)
    return plain.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda c: c != 0))
