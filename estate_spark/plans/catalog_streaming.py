"""Registered queries: streaming jobs run over the event table as a stream (S3-S5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.plans.registry import query, scratch
from estate_spark.sources import views
from estate_spark.streaming import jobs


def price_stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    return jobs.read_stream(spark, sf, schema, glob="events.parquet").select(
        "event_id",
        F.col("user_id").alias("property_id"),
        F.col("value").alias("price"),
        F.col("ts").alias("recorded_at"),
        "event_type",
    )


@query(
    "s3_stream_dedup",
    "SELECT DISTINCT concat_ws('-', property_id, event_type) AS listing FROM price_history",
    "price_history",
)
def _(spark, sf):
    keyed = price_stream(spark, sf).withColumn("listing", F.concat_ws("-", "property_id", "event_type"))
    unique = jobs.deduplicate(keyed, "listing", "recorded_at", "60 days").select("listing")
    return jobs.run_available(unique, scratch(spark, "dedup"), scratch(spark, "checkpoint"))


@query(
    "s4_price_alerts",
    """SELECT property_id, event_id, CASE WHEN old_price IS NULL THEN 'new_listing' ELSE 'price_drop' END AS alert,
              old_price, price AS new_price
       FROM (SELECT *, lag(price) OVER (PARTITION BY property_id ORDER BY recorded_at, event_id) AS old_price FROM price_history)
       WHERE old_price IS NULL OR price < old_price""",
    "price_history",
)
def _(spark, sf):
    return jobs.price_alerts(price_stream(spark, sf), scratch(spark, "alerts"), scratch(spark, "checkpoint"))


_WEEKS = """SELECT strftime(time_bucket(INTERVAL 7 DAYS, recorded_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week_start, event_type,
       CAST(count(*) AS BIGINT) AS n_events FROM price_history GROUP BY 1, 2"""


@query("s5_weekly_activity", _WEEKS, "price_history")
def _(spark, sf):
    weekly = jobs.weekly_activity(views.price_history(spark, sf))
    return weekly.withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd"))


@query("s5_weekly_activity_stream", _WEEKS, "price_history")
def _(spark, sf):
    weekly = jobs.weekly_activity(price_stream(spark, sf))
    out = jobs.run_complete(weekly, scratch(spark, "weekly"), scratch(spark, "checkpoint"))
    return out.withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd"))
