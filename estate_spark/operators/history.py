"""Listing history: lifetimes, price changes, moving figures, matching and adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estate_spark.functions.ordering import asof_match, previous_value
from estate_spark.functions.quantiles import exact_quantiles
from estate_spark.functions.text import blank_to_null, strip
from estate_spark.session import staged


def day_bucket(t: Column) -> Column:
    return F.to_date(t)


def month_bucket(t: Column) -> Column:
    return F.trunc(t, "month")


def lifetimes(history: DataFrame, key: str = "property_id", time: str = "recorded_at") -> DataFrame:
    """First and last sighting per listing."""
    return history.groupBy(key).agg(
        F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n_seen")
    )


def price_changes(history: DataFrame, tie: str = "event_id") -> DataFrame:
    """Rows whose price differs from the listing's previous one."""
    with_previous = previous_value(history, "property_id", "recorded_at", "price", tie, day_bucket, "old_price")
    return (
        with_previous.filter(F.col("old_price").isNotNull() & (F.col("old_price") != F.col("price")))
        .withColumn("change", F.col("price") - F.col("old_price"))
        .withColumn("direction", F.when(F.col("change") < 0, "drop").otherwise("rise"))
    )


def moving_average(
    df: DataFrame, value: str, day: str, keys: Sequence[str] = (), days: int = 30
) -> DataFrame:
    """Mean over the last ``days`` calendar days, from one row per key and day."""
    group = [*keys] or [F.lit(0).alias("all")]
    daily = (
        df.filter(F.col(value).isNotNull() & F.col(day).isNotNull())
        .groupBy(*group, F.to_date(day).alias("day"))
        .agg(F.sum(value).alias("day_sum"), F.count("*").alias("n"))
        .withColumn("_d", F.unix_date("day"))
    )
    names = [*keys] or ["all"]
    reach = Window.partitionBy(*names).orderBy("_d").rangeBetween(-(days - 1), 0)
    return daily.select(
        *keys, "day", "n", (F.sum("day_sum").over(reach) / F.sum("n").over(reach)).alias("moving_avg")
    )


def monthly_trend(
    sales: DataFrame, keys: Sequence[str] = ("city",), months: int = 6, value: str = "final_price", day: str = "sold_date"
) -> DataFrame:
    """Monthly median and the slope of medians over the last ``months`` rows with sales."""
    monthly = exact_quantiles(
        sales.withColumn("month", F.trunc(day, "month")), [*keys, "month"], value, {"median_price": 0.5}
    )
    number = F.year("month") * 12 + F.month("month")
    recent = Window.partitionBy(*keys).orderBy("month").rowsBetween(-(months - 1), 0)
    slope = F.regr_slope(F.col("median_price"), F.col("_m").cast("double")).over(recent)
    return (
        monthly.withColumn("_m", number)
        .withColumn("slope", slope)
        .drop("_m")
        .withColumnRenamed("n_rows", "n_sales")
    )


def normal_address(c: Column) -> Column:
    """Lower case, single blanks, no punctuation; blank becomes null so it matches nothing."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    return blank_to_null(strip(kept))


def match_listings(listings: DataFrame, sales: DataFrame) -> DataFrame:
    """Active listings with the sale that ended them: by id, else by address.

    Either way the first sale on or after the listing date counts; a listing
    whose id was only sold before is tried by address, as it is new. Both
    lookups are time lookups per key, so a shared address forms no pairs. What
    the ids tell is staged, as both kinds of rows read it.
    Expects ``property_id, address, listed_date`` on listings and
    ``property_id, address, sold_date, final_price`` on sales.
    """
    own_sales = sales.select("property_id", "sold_date", "final_price")
    tried = staged(
        asof_match(
            listings, own_sales, ["property_id"], "listed_date", "sold_date", month_bucket, backward=False, tie_break=[F.col("final_price")], keep=True
        )
    )
    ended = F.col("sold_date").isNotNull()
    by_id = tried.filter(ended).withColumn("matched_by", F.lit("id")).withColumn("sale_id", F.col("property_id"))
    rest = tried.filter(~ended).select(*listings.columns, normal_address(F.col("address")).alias("addr")).filter(F.col("addr").isNotNull())
    sold = sales.select(
        F.col("property_id").alias("sale_id"),
        normal_address(F.col("address")).alias("addr"),
        "sold_date",
        "final_price",
    ).filter(F.col("addr").isNotNull())
    by_address = asof_match(
        rest,
        sold,
        ["addr"],
        "listed_date",
        "sold_date",
        month_bucket,
        backward=False,
        tie_break=[F.col("sale_id")],
    ).drop("addr").withColumn("matched_by", F.lit("address"))
    return by_id.unionByName(by_address)


def price_in_force(sold: DataFrame, history: DataFrame, sold_at: str = "sold_at") -> DataFrame:
    """Latest recorded price at or before each sale; ties within one instant by highest event id."""
    known = history.select("property_id", "recorded_at", "event_id", F.col("price").alias("asking_price"))
    return asof_match(
        sold, known, ["property_id"], sold_at, "recorded_at", day_bucket, True, [F.desc("event_id")]
    )


def to_base_year(sales: DataFrame, index: DataFrame, base_year: int = 2024, price: str = "final_price") -> DataFrame:
    """Prices scaled by the index of the base year over that of the sale year; null where either year is missing.

    ``index(year, level)`` holds one row per year; Spark broadcasts it by size.
    """
    whole_index = Window.partitionBy(F.lit(0))
    base = F.max(F.when(F.col("year") == base_year, F.col("level"))).over(whole_index)
    ratios = index.select("year", (base / F.col("level")).alias("ratio"))
    return (
        sales.join(ratios, F.col("sale_year") == F.col("year"), "left")
        .drop("year")
        .withColumn("adjusted_price", F.floor(F.col(price) * F.col("ratio") + 0.5))
    )


def flag_underpriced(scored: DataFrame, asking: str = "asking_price", fair: str = "predicted_price", gap_pct: float = 10.0) -> DataFrame:
    """Listings asked at least ``gap_pct`` percent under their predicted value."""
    gap = (F.col(fair) - F.col(asking)) / F.col(fair) * 100
    return scored.withColumn("gap_pct", F.when(F.col(fair) > 0, gap)).withColumn(
        "underpriced", F.coalesce(F.col("gap_pct") >= gap_pct, F.lit(False))
    )
