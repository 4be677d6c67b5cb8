"""Registered queries: listing history, matching and trends (C5, C6, J2-J5, A14)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from estate_spark.operators import history, incremental
from estate_spark.plans.registry import query
from estate_spark.session import staged
from estate_spark.sources import views


@query(
    "j2_lifetimes",
    """SELECT property_id, strftime(min(recorded_at), '%Y-%m-%d %H:%M:%S') AS first_seen,
              strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') AS last_seen, CAST(count(*) AS BIGINT) AS n_seen
       FROM price_history GROUP BY 1""",
    "price_history",
)
def _(spark, sf):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return history.lifetimes(views.price_history(spark, sf)).select(
        "property_id", shown("first_seen"), shown("last_seen"), "n_seen"
    )


@query(
    "j3_price_changes",
    """SELECT event_id, property_id, old_price, price, CASE WHEN price < old_price THEN 'drop' ELSE 'rise' END AS direction
       FROM (SELECT *, lag(price) OVER (PARTITION BY property_id ORDER BY recorded_at, event_id) AS old_price FROM price_history)
       WHERE old_price IS NOT NULL AND old_price <> price""",
    "price_history",
)
def _(spark, sf):
    return history.price_changes(views.price_history(spark, sf)).select(
        "event_id", "property_id", "old_price", "price", "direction"
    )


_MOVING = """SELECT {key} strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n,
       CAST(sum(s) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS moving_avg
       FROM (SELECT {key} {day} AS day, sum({value}) AS s, count(*) AS n FROM {table} GROUP BY ALL)
       WINDOW w AS ({part} ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)"""


@query(
    "j4_moving_average",
    _MOVING.format(key="", day="sold_date", value="final_price", table="sales", part=""),
    "sales",
)
def _(spark, sf):
    out = history.moving_average(views.sales(spark, sf), "final_price", "sold_date")
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "j4_moving_average_by_city",
    _MOVING.format(key="city,", day="sold_date", value="final_price", table="sales", part="PARTITION BY city"),
    "sales",
)
def _(spark, sf):
    out = history.moving_average(views.sales(spark, sf), "final_price", "sold_date", ["city"])
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "j5_monthly_trend",
    """WITH m AS (SELECT city, date_trunc('month', sold_date) AS month, CAST(median(final_price) AS DOUBLE) AS median_price,
                         count(*) AS n, CAST(year(sold_date) * 12 + month(sold_date) AS DOUBLE) AS k FROM sales GROUP BY ALL)
       SELECT city, strftime(month, '%Y-%m') AS month, CAST(n AS BIGINT) AS n_sales, median_price,
              CASE WHEN count(*) OVER w > 1 THEN round(regr_slope(median_price, k) OVER w, 3) END AS slope
       FROM m WINDOW w AS (PARTITION BY city ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    "sales",
)
def _(spark, sf):
    return history.monthly_trend(views.sales(spark, sf)).select(
        "city", F.date_format("month", "yyyy-MM").alias("month"), "n_sales", "median_price", F.round("slope", 3).alias("slope")
    )


# listings of even room counts keep their id in the sale, the others are known by address only
# ids may repeat, so matches are counted per listing row
_LISTED = """l AS (SELECT row_number() OVER () AS listing_row, property_id, concat(neighborhood, ' ', number_of_rooms, CASE WHEN living_area > 50 THEN ', ' ELSE '  ' END,
                  CAST(living_area AS INTEGER)) AS address, listed_date FROM sales WHERE sale_year % 2 = 1),
       s AS (SELECT CASE WHEN number_of_rooms % 2 = 0 THEN property_id ELSE concat('s', property_id) END AS property_id,
                    lower(concat(neighborhood, ' ', number_of_rooms, ' ', CAST(living_area AS INTEGER))) AS address, sold_date, final_price FROM sales),
       n AS (SELECT l.*, trim(regexp_replace(lower(address), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS addr FROM l),
       t AS (SELECT property_id, trim(regexp_replace(address, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS addr, sold_date, final_price FROM s),
       byid AS (SELECT n.property_id, 'id' AS matched_by, t.property_id AS sale_id, t.sold_date,
                       row_number() OVER (PARTITION BY n.listing_row ORDER BY t.sold_date, t.final_price) AS rn
                FROM n JOIN t ON n.property_id = t.property_id AND t.sold_date >= n.listed_date),
       byad AS (SELECT n.property_id, 'address' AS matched_by, t.property_id AS sale_id, t.sold_date,
                       row_number() OVER (PARTITION BY n.listing_row ORDER BY t.sold_date, t.property_id) AS rn
                FROM n JOIN t ON n.addr = t.addr AND t.sold_date >= n.listed_date
                WHERE NOT EXISTS (SELECT 1 FROM t AS own WHERE own.property_id = n.property_id AND own.sold_date >= n.listed_date))"""


@query(
    "c5_listing_sale_match",
    f"""WITH {_LISTED} SELECT property_id, matched_by, sale_id, strftime(sold_date, '%Y-%m-%d') AS sold_on FROM byid WHERE rn = 1
        UNION ALL SELECT property_id, matched_by, sale_id, strftime(sold_date, '%Y-%m-%d') FROM byad WHERE rn = 1""",
    "sales",
)
def _(spark, sf):
    # staged first: listings and sales are read by several steps
    s = staged(
        views.sales(spark, sf).select(
            "property_id", "neighborhood", "number_of_rooms", "living_area", "sale_year", "listed_date", "sold_date", "final_price"
        )
    )
    size = F.col("living_area").cast("int")
    sep = F.when(F.col("living_area") > 50, ", ").otherwise("  ")
    listed = s.filter("sale_year % 2 = 1").select(
        "property_id",
        F.concat("neighborhood", F.lit(" "), "number_of_rooms", sep, size).alias("address"),
        "listed_date",
    )
    sold = s.select(
        F.when(F.col("number_of_rooms") % 2 == 0, F.col("property_id"))
        .otherwise(F.concat(F.lit("s"), "property_id"))
        .alias("property_id"),
        F.lower(F.concat("neighborhood", F.lit(" "), "number_of_rooms", F.lit(" "), size)).alias("address"),
        "sold_date",
        "final_price",
    )
    return history.match_listings(listed, sold).select(
        "property_id", "matched_by", "sale_id", F.col("sold_date").cast("string").alias("sold_on")
    )


@query(
    "c6_price_in_force",
    """WITH s AS (SELECT property_id, event_id AS sale_event, recorded_at AS sold_at, price AS paid FROM price_history WHERE event_type = 'purchase'),
       h AS (SELECT * FROM price_history WHERE event_type <> 'purchase'),
       r AS (SELECT s.property_id, sale_event, paid, h.price AS asking_price,
                    row_number() OVER (PARTITION BY sale_event ORDER BY h.recorded_at DESC, h.event_id DESC) AS rn
             FROM s JOIN h ON s.property_id = h.property_id AND h.recorded_at <= s.sold_at)
       SELECT property_id, sale_event, paid, asking_price FROM r WHERE rn = 1""",
    "price_history",
)
def _(spark, sf):
    h = views.price_history(spark, sf)
    sold = h.filter("event_type = 'purchase'").select(
        "property_id",
        F.col("event_id").alias("sale_event"),
        F.col("recorded_at").alias("sold_at"),
        F.col("price").alias("paid"),
    )
    known = h.filter("event_type <> 'purchase'")
    return history.price_in_force(sold, known).select("property_id", "sale_event", "paid", "asking_price")


@query(
    "a14_retention",
    """SELECT property_id FROM price_history GROUP BY 1 HAVING max(recorded_at) >= DATE '2024-01-29'""",
    "price_history",
)
def _(spark, sf):
    seen = history.lifetimes(views.price_history(spark, sf))
    return incremental.listed_within(seen, F.lit(date(2024, 2, 3)), 5).select("property_id")
