"""Comparable sales: same neighbourhood and rooms, similar area, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.functions.intervals import nearest_points, newest, rows_between
from estate_spark.session import materialise

GROUP = ("neighborhood", "number_of_rooms")
AREA = "living_area"
PAYLOAD = ("property_id", "final_price", "living_area", "sale_year")


def newest_first() -> tuple[Column | str, ...]:
    return F.desc("sale.sale_year"), "sale.property_id"


def _cells(sales: DataFrame, keys: dict[str, str], k: int) -> DataFrame:
    """The newest ``k`` sales of each exact area: no other can be in an answer."""
    sale = F.struct(*[F.col(c) for c in PAYLOAD]).alias("sale")
    measured = sales.filter(_is_number(AREA))
    cells = measured.select(*[F.col(c).alias(n) for n, c in keys.items()], F.col(AREA).cast("double").alias("a"), sale)
    return newest(cells, [*keys, "a"], newest_first(), k).drop("rank")


def _is_number(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def comparable_sales(probes: DataFrame, sales: DataFrame, k: int = 5, reach: float = 10.0) -> DataFrame:
    """The ``k`` newest sales within ``reach`` of each probe's area.

    Exact without forming pairs: each distinct (group, area) that is probed is
    one search for the newest sales within an interval, and a search joins a
    few rows a level of dyadic intervals, whatever the number of areas in reach.
    """
    cells = _cells(sales, {c: c for c in GROUP}, k)
    area = F.col("probe_area")
    wanted = probes.filter(_is_number(AREA)).select(*GROUP, F.col(AREA).cast("double").alias("probe_area")).distinct()
    found = rows_between(wanted.withColumns({"low": area - reach, "high": area + reach}), cells, GROUP, newest_first(), k)
    candidates = found.filter(F.col("sure") | (F.abs(F.col("a") - area) <= reach))
    best = newest(candidates, [*GROUP, "probe_area"], newest_first(), k)
    answers = best.groupBy(*GROUP, "probe_area").agg(
        F.array_sort(F.collect_list(F.struct("rank", "sale"))).alias("comps")
    )
    return (
        probes.withColumnRenamed("property_id", "probe_id")
        .withColumnRenamed(AREA, "probe_area")
        .join(answers, [*GROUP, "probe_area"])
        .select("probe_id", *GROUP, "probe_area", F.explode("comps").alias("c"))
        .select(
            "probe_id",
            *GROUP,
            "probe_area",
            F.col("c.rank").alias("comp_rank"),
            F.col("c.sale.property_id").alias("comp_id"),
            F.col("c.sale.final_price").alias("comp_price"),
            F.col("c.sale.living_area").alias("comp_area"),
            F.col("c.sale.sale_year").alias("comp_year"),
            (F.col("c.sale.final_price") / F.col("c.sale.living_area")).alias("comp_per_sqm"),
        )
    )


def similar_sales(
    probes: DataFrame, sales: DataFrame, k: int = 5, threshold: float = 0.7, reach: float = 10.0
) -> DataFrame:
    """Up to ``k`` most similar sales per probe with a score of at least ``threshold``.

    Score: one minus the area gap over ``reach``, weighed 0.7, plus 0.3 for the
    same ownership form, inside one neighbourhood and room count, rounded to
    six places. A probe is searched for in each ownership form: the sales of
    the ``k`` areas next to its own on either side hold the best scores. Only
    the score of the last of them may be shared by further areas, which make
    two narrow intervals, searched for their newest sales.
    """
    forms = (*GROUP, "form")
    cells = _cells(sales, {**{c: c for c in GROUP}, "form": "ownership_form"}, k)
    form = F.col("ownership_form").alias("probe_form")
    wanted = probes.filter(_is_number(AREA)).select(*GROUP, F.col(AREA).cast("double").alias("probe_area"), form).distinct()
    search = wanted.join(cells.select(*forms).distinct(), list(GROUP))
    probe_keys = [*GROUP, "probe_area", "probe_form"]
    area = F.col("probe_area")
    bonus = F.when(F.col("form") == F.col("probe_form"), 0.3).otherwise(0.0)
    distance = F.abs(F.col("a") - area)
    score = F.round((1 - distance / reach) * 0.7 + bonus, 6)

    near = nearest_points(search, cells, forms, "probe_area", k).withColumn("score", score)
    fit = near.filter((F.col("score") >= threshold) & (distance <= reach))
    ranked = materialise(newest(fit, [*probe_keys, "form"], [F.desc("score"), *newest_first()], k).drop("a"))
    # areas further off may share the score of the last of k sales: they lie between two distances on either side
    last = ranked.filter(F.col("rank") == k).select(*probe_keys, "form", F.col("score").alias("tied"))
    gap = lambda s: (1 - (s - bonus) / 0.7) * reach
    far, close = F.least(gap(F.col("tied") - 5e-7), F.lit(reach)), gap(F.col("tied") + 5e-7)
    side = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    both = F.array(side(area - far, area - close), side(area + close, area + far))
    sides = F.when(close < 1e-8 * (1 + F.abs(area) + reach), F.array(side(area - far, area + far))).otherwise(both)
    ties = last.select("*", F.posexplode(sides).alias("side", "s")).select(*last.columns, "side", "s.*")
    # one interval over both sides also holds the fewer than k sales of better scores: twice k are asked for
    tied = rows_between(ties, cells, forms, newest_first(), 2 * k).withColumn("score", score)
    tied = tied.filter((F.col("score") == F.col("tied")) & (distance <= reach))
    better = ranked.join(last, [*probe_keys, "form"], "left").filter("tied IS NULL OR score > tied")
    columns = [*probe_keys, "score", "sale"]
    best = newest(better.select(*columns).unionByName(tied.select(*columns)), probe_keys, [F.desc("score"), *newest_first()], k)
    answers = best.groupBy(*probe_keys).agg(F.collect_list(F.struct("rank", "score", "sale")).alias("comps"))
    return (
        probes.select(
            F.col("property_id").alias("probe_id"),
            *GROUP,
            F.col(AREA).alias("probe_area"),
            F.col("ownership_form").alias("probe_form"),
        )
        .join(answers, probe_keys)
        .select("probe_id", F.explode("comps").alias("c"))
        .select(
            "probe_id",
            F.col("c.rank").alias("comp_rank"),
            F.col("c.score").alias("score"),
            F.col("c.sale.property_id").alias("comp_id"),
        )
    )
