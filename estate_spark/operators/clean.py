"""Row-wise cleaning, derived metrics, selections and labels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.functions.text import listing_id, listing_type, strip

# Columns the price model never sees.
NON_FEATURE_COLUMNS = (
    "location",
    "operational_cost",
    "leasehold_fee",
    "housing_association",
    "sale_month",
    "sale_day",
    "balcony",
)

# Half-open value ranges for rooms, prices and areas.
ROOM_EDGES = (1, 2, 3, 4, 5)
PRICE_EDGES = (0, 1_000_000, 2_000_000, 3_000_000, 5_000_000, 10_000_000)
AREA_EDGES = (0, 40, 60, 80, 100, 150)


def price_between(df: DataFrame, low: int = 100_000, high: int = 15_000_000, price: str = "final_price") -> DataFrame:
    """Outlier filter, both bounds excluded."""
    return df.filter((F.col(price) > low) & (F.col(price) < high))


def with_neighborhood(df: DataFrame, source: str = "location", name: str = "neighborhood") -> DataFrame:
    """Trimmed text before the first comma."""
    return df.withColumn(name, strip(F.substring_index(source, ",", 1)))


def plausible_year(c: Column, first: int = 1800, last: int = 2024) -> Column:
    return F.when(c.between(first, last), c)


def features_and_label(df: DataFrame, label: str = "final_price") -> DataFrame:
    """Model input: the excluded columns dropped, the label renamed ``label``."""
    return df.drop(*NON_FEATURE_COLUMNS).withColumnRenamed(label, "label")


def with_listing_identity(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("property_type", listing_type(F.col(url))).withColumn(
        "property_id", listing_id(F.col(url))
    )


def _usable(*cols: Column) -> Column:
    present = F.lit(True)
    for c in cols:
        present = present & c.isNotNull() & (c != 0)
    return present


def with_sold_metrics(df: DataFrame) -> DataFrame:
    """Price change, its percentage and price per square metre; null unless computable."""
    final, asking, area = F.col("final_price"), F.col("asking_price"), F.col("living_area")
    change = final - asking
    return df.withColumns(
        {
            "price_change": F.when(_usable(final, asking), change),
            "price_change_pct": F.when(_usable(final, asking) & (asking > 0), change / asking * 100),
            "price_per_sqm_final": F.when(_usable(final, area) & (area > 0), final / area),
        }
    )


def with_asking_per_sqm(df: DataFrame) -> DataFrame:
    asking, area = F.col("asking_price"), F.col("living_area")
    return df.withColumn(
        "price_per_sqm", F.when(_usable(asking, area) & (area > 0), asking / area)
    )


def with_days_on_market(df: DataFrame, as_of: date, listed: str = "listed_date") -> DataFrame:
    return df.withColumn("days_on_market", F.datediff(F.lit(as_of), F.col(listed)))


def real_coordinate(c: Column) -> Column:
    """Values next to zero stand for a missing position."""
    return F.when(F.abs(c) >= 0.001, c)


def dates_as_iso(df: DataFrame) -> DataFrame:
    """Date and time columns as ISO text, for text sinks."""
    changed = {}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "date":
            changed[field.name] = F.date_format(field.name, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            changed[field.name] = F.date_format(field.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.withColumns(changed) if changed else df


def area_between(df: DataFrame, low: float, high: float, area: str = "living_area") -> DataFrame:
    return df.filter(F.col(area).between(low, high))


def month_start(text: str | None, as_of: datetime) -> Column:
    """``YYYY-MM`` as its first day; without text, the month thirty days before ``as_of``."""
    if text is None:
        return F.trunc(F.date_sub(F.lit(as_of).cast("date"), 30), "month")
    return F.to_date(F.lit(text), "yyyy-MM")


def sold_in_month(df: DataFrame, month: Column, sold: str = "sold_date") -> DataFrame:
    return df.filter((F.col(sold) >= month) & (F.col(sold) < F.add_months(month, 1)))


def parse_month(c: Column) -> Column:
    """``YYYY-MM`` text column to the first day of the month; anything else becomes null."""
    return F.when(F.rlike(c, F.lit(r"^\d{4}-\d{1,2}$")), F.concat(c, F.lit("-1"))).try_cast("date")


def tag_provenance(df: DataFrame, captured_at: datetime | str, area: tuple[int, int] | None = None, month: Column | None = None) -> DataFrame:
    """Label rows with the range or month they were collected for and the capture time."""
    out = df
    if area is not None:
        out = out.withColumn("area_range", F.format_string("%d-%dm²", F.lit(area[0]), F.lit(area[1])))
    if month is not None:
        out = out.withColumn("sold_month", F.date_format(month, "yyyy-MM"))
    return out.withColumn("scraped_at", F.lit(captured_at).cast("timestamp_ntz"))


def comparable_display(df: DataFrame) -> DataFrame:
    """Columns of the comparable-sales table under their display names."""
    shown = df.select("final_price", "living_area", "sale_year", "fee").withColumn(
        "price_per_sqm", F.col("final_price") / F.col("living_area")
    )
    return shown.withColumnsRenamed(
        {
            "final_price": "Price (SEK)",
            "living_area": "Area (sqm)",
            "sale_year": "Year Sold",
            "fee": "Fee (SEK)",
            "price_per_sqm": "SEK/sqm",
        }
    )


def rounded_prediction(df: DataFrame, prediction: str = "prediction", area: str = "living_area") -> DataFrame:
    """Prediction rounded half-even to thousands, and its price per square metre."""
    return df.withColumn("predicted_price", F.bround(prediction, -3)).withColumn(
        "predicted_per_sqm", F.col("predicted_price") / F.col(area)
    )


def range_label(c: Column, edges: Sequence[int], top: int | None = None) -> Column:
    """Half-open range label such as ``40-60``; values from the last edge on read ``150+``."""
    label = F.lit(None).cast("string")
    bounds = list(zip(edges, edges[1:])) + [(edges[-1], None)]
    for low, high in bounds:
        inside = (c >= low) if high is None else (c >= low) & (c < high)
        if high is None and top is not None:
            inside = inside & (c <= top)
        text = f"{low}+" if high is None else f"{low}-{high}"
        label = F.when(inside, F.lit(text)).otherwise(label)
    return label


def with_range_labels(df: DataFrame, rooms: str = "number_of_rooms", price: str = "final_price", area: str = "living_area") -> DataFrame:
    return df.withColumns(
        {
            "rooms_range": range_label(F.col(rooms), ROOM_EDGES),
            "price_range": range_label(F.col(price), PRICE_EDGES),
            "area_label": range_label(F.col(area), AREA_EDGES),
        }
    )


def listing_status(last_seen: Column, sold_at: Column, as_of: Column, unseen_days: int = 7) -> Column:
    """``sold`` once a sale is known, ``removed`` when unseen for a refresh cycle, else ``active``."""
    return (
        F.when(sold_at.isNotNull(), F.lit("sold"))
        .when(F.datediff(as_of, last_seen) > unseen_days, F.lit("removed"))
        .otherwise(F.lit("active"))
    )
