"""Market statistics: medians, trends, value ranges, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.functions.quantiles import (
    exact_quantiles,
    group_summary,
    quantiles_from_counts,
    value_counts,
)

MEDIAN = {"median_price": 0.5}


def neighborhood_medians(sales: DataFrame, min_count: int = 100) -> DataFrame:
    """Count and exact median per neighbourhood with enough sales; unknown names left out."""
    stats = exact_quantiles(sales, ["neighborhood"], "final_price", MEDIAN)
    return stats.withColumnRenamed("n_rows", "n_sales").filter(F.col("n_sales") >= min_count)


def extreme_neighborhoods(stats: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` dearest and ``n`` cheapest by median, names breaking ties."""
    top = stats.orderBy(F.desc("median_price"), "neighborhood").limit(n)
    bottom = stats.orderBy("median_price", "neighborhood").limit(n)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


def yearly_prices(sales: DataFrame) -> DataFrame:
    stats = group_summary(sales, ["sale_year"], "final_price", MEDIAN)
    return stats.withColumnsRenamed({"n_rows": "n_sales", "mean": "mean_price"})


def numeric_ranges(df: DataFrame, columns: Sequence[str], year: str = "year_of_construction") -> DataFrame:
    """Smallest and largest value per column in long form, from one aggregation.

    The smallest construction year looks at plausible years only.
    """
    aggs = []
    for c in columns:
        low = F.when(F.col(c) >= 1800, F.col(c)) if c == year else F.col(c)
        aggs += [F.min(low).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max")]
    pairs = ", ".join(f"'{c}', `{c}_min`, `{c}_max`" for c in columns)
    return df.agg(*aggs).selectExpr(f"stack({len(columns)}, {pairs}) as (feature, min_value, max_value)")


def category_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per categorical column, with their place in sorted order.

    Values are exploded before the distinct so all columns share one shuffle.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return df.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _fenced_counts(df: DataFrame, key: str, value: str, k: float) -> DataFrame:
    counts = value_counts(df, [key], value)
    box = quantiles_from_counts(counts, [key], QUARTILES)
    reach = F.lit(k) * (F.col("q3") - F.col("q1"))
    return counts.join(box, key).withColumn(
        "inside", F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    )


def box_plot(df: DataFrame, key: str = "ownership_form", value: str = "final_price", k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers and outlier count per group.

    Works on (group, value) counts throughout, so the source is read once.
    """
    fenced = _fenced_counts(df, key, value, k)
    return fenced.groupBy(key).agg(
        F.first("n_rows").alias("n_rows"),
        *[F.first(q).alias(q) for q in QUARTILES],
        F.min(F.when(F.col("inside"), F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("inside"), F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("_n"))).alias("n_outliers"),
    )


def box_plot_outliers(df: DataFrame, key: str = "ownership_form", value: str = "final_price", k: float = 1.5) -> DataFrame:
    """The outlying values per group and how often each occurs."""
    return _fenced_counts(df, key, value, k).filter(~F.col("inside")).select(key, F.col("_v").alias(value), F.col("_n").alias("n"))


def neighborhood_table(sales: DataFrame) -> DataFrame:
    """Warehouse row per neighbourhood: average price per area unit, median price, number of sales."""
    per_sqm = (
        sales.filter(F.col("final_price").isNotNull())
        .groupBy("neighborhood", "city")
        .agg(F.avg(F.col("final_price") / F.nullif(F.col("living_area"), F.lit(0))).alias("avg_price_m2"))
    )
    medians = exact_quantiles(sales, ["neighborhood", "city"], "final_price", MEDIAN)
    return per_sqm.join(medians, ["neighborhood", "city"]).withColumnsRenamed(
        {"neighborhood": "name", "n_rows": "properties_count"}
    )


def price_histogram(sales: DataFrame, low: int, high: int, bins: int, value: str = "final_price") -> DataFrame:
    """Equal-width bins 1..n over ``[low, high)``; 0 and n+1 take what lies outside."""
    binned = sales.filter(F.col(value).isNotNull()).select(
        F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")
    )
    step = (high - low) / bins
    return binned.groupBy("bin").agg(F.count("*").alias("n_sales")).withColumn(
        "bin_start", F.lit(float(low)) + (F.col("bin") - 1) * step
    )


def price_by_rooms(sales: DataFrame) -> DataFrame:
    stats = group_summary(sales, ["number_of_rooms"], "final_price", MEDIAN)
    return stats.withColumnsRenamed({"n_rows": "n_sales", "mean": "mean_price"})


def price_per_sqm_by_area(sales: DataFrame, width: int = 10) -> DataFrame:
    """Total price over total area per area band."""
    band = (F.floor(F.col("living_area") / width) * width).alias("area_from")
    return (
        sales.filter((F.col("living_area") > 0) & F.col("final_price").isNotNull())
        .groupBy(band)
        .agg(
            F.count("*").alias("n_sales"),
            (F.sum("final_price") / F.sum("living_area")).alias("price_per_sqm"),
        )
    )


def negotiation(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Asking against final price and time on market, per ``keys``.

    Rows whose sale precedes the listing carry no usable waiting time and are left out.
    """
    usable = matched.filter(
        (F.col("sold_date") >= F.col("listed_date")) & (F.col("asking_price") > 0)
    ).select(
        *keys,
        "asking_price",
        "final_price",
        F.datediff("sold_date", "listed_date").alias("days"),
    )
    sums = usable.groupBy(*keys).agg(
        F.avg("days").alias("mean_days"),
        ((F.sum("final_price") - F.sum("asking_price")) / F.sum("asking_price") * 100).alias("change_pct"),
        F.count_if(F.col("final_price") > F.col("asking_price")).alias("n_over_asking"),
    )
    medians = exact_quantiles(usable, keys, "days", {"median_days": 0.5})
    return sums.join(medians, list(keys)).withColumnRenamed("n_rows", "n_sales")
