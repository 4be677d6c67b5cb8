"""Registered queries: row-wise cleaning and labels (B)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from estate_spark.functions.text import listing_id, listing_type
from estate_spark.operators import clean
from estate_spark.plans.registry import query
from estate_spark.sources import views

AS_OF = date(2002, 1, 1)
KEYS = ("property_id", "neighborhood")

# listing URLs made from sales: every seventh of neither kind, some with trailing slashes
URL_SQL = """concat('https://homes.example/',
    CASE WHEN number_of_rooms = 7 THEN 'projekt' WHEN sale_year % 2 = 0 THEN 'salda' ELSE 'bostad' END,
    '/lagenhet-', number_of_rooms, 'rum-', replace(property_id, '-', '_'),
    CASE WHEN number_of_rooms = 3 THEN '//' ELSE '' END)"""


def listing_urls(spark, sf):
    rooms, parity = F.col("number_of_rooms"), F.col("sale_year") % 2
    folder = F.when(rooms == 7, "projekt").when(parity == 0, "salda").otherwise("bostad")
    return views.sales(spark, sf).withColumn(
        "url",
        F.concat(
            F.lit("https://homes.example/"),
            folder,
            F.lit("/lagenhet-"),
            rooms,
            F.lit("rum-"),
            F.translate("property_id", "-", "_"),
            F.when(rooms == 3, "//").otherwise(""),
        ),
    )


@query(
    "b1_price_outliers",
    "SELECT property_id, final_price FROM sales WHERE final_price > 100000 AND final_price < 15000000",
    "sales",
)
def _(spark, sf):
    return clean.price_between(views.sales(spark, sf)).select("property_id", "final_price")


@query(
    "b2_neighborhood_from_location",
    "SELECT property_id, trim(split_part(location, ',', 1)) AS area_name FROM sales",
    "sales",
)
def _(spark, sf):
    return clean.with_neighborhood(views.sales(spark, sf), name="area_name").select("property_id", "area_name")


@query(
    "b3_plausible_year",
    """SELECT property_id, CASE WHEN year_of_construction BETWEEN 1800 AND 2024 THEN year_of_construction END AS built
       FROM sales""",
    "sales",
)
def _(spark, sf):
    return views.sales(spark, sf).select(
        "property_id", clean.plausible_year(F.col("year_of_construction")).alias("built")
    )


@query(
    "b4_features_and_label",
    """SELECT property_id, listing_key, neighborhood, city, ownership_form, number_of_rooms, living_area,
              year_of_construction, asking_price, final_price AS label, sale_year FROM sales""",
    "sales",
)
def _(spark, sf):
    return clean.features_and_label(views.sales(spark, sf)).drop("listed_date", "sold_date")


@query(
    "b5_listing_type",
    f"""SELECT url, CASE WHEN contains(url, '/salda/') THEN 'sold' WHEN contains(url, '/bostad/') THEN 'for_sale' END
        AS property_type FROM (SELECT {URL_SQL} AS url FROM sales)""",
    "sales",
)
def _(spark, sf):
    return listing_urls(spark, sf).select("url", listing_type(F.col("url")).alias("property_type"))


@query(
    "b6_listing_id",
    f"""SELECT url, replace(property_id, '-', '_') AS listing_id
        FROM (SELECT property_id, {URL_SQL} AS url FROM sales)""",
    "sales",
)
def _(spark, sf):
    return listing_urls(spark, sf).select("url", listing_id(F.col("url")).alias("listing_id"))


@query(
    "b7_sold_metrics",
    """SELECT property_id, final_price - asking_price AS price_change,
              (final_price - asking_price) / asking_price * 100 AS price_change_pct,
              final_price / living_area AS price_per_sqm_final FROM sales""",
    "sales",
)
def _(spark, sf):
    return clean.with_sold_metrics(views.sales(spark, sf)).select(
        "property_id", "price_change", "price_change_pct", "price_per_sqm_final"
    )


@query("b8_asking_per_sqm", "SELECT property_id, asking_price / living_area AS price_per_sqm FROM sales", "sales")
def _(spark, sf):
    return clean.with_asking_per_sqm(views.sales(spark, sf)).select("property_id", "price_per_sqm")


@query(
    "b9_days_on_market",
    "SELECT property_id, CAST(DATE '2002-01-01' - listed_date AS INTEGER) AS days_on_market FROM sales",
    "sales",
)
def _(spark, sf):
    return clean.with_days_on_market(views.sales(spark, sf), AS_OF).select("property_id", "days_on_market")


@query(
    "b10_coordinate_clean",
    """WITH p AS (SELECT property_id, (number_of_rooms - 4) * 0.0005 AS lat, (living_area - 50) / 10000 AS lon FROM sales)
       SELECT property_id, CASE WHEN abs(lat) >= 0.001 THEN CAST(lat AS DOUBLE) END AS latitude,
              CASE WHEN abs(lon) >= 0.001 THEN lon END AS longitude FROM p""",
    "sales",
)
def _(spark, sf):
    lat = ((F.col("number_of_rooms") - 4) * F.lit(0.0005)).cast("double")
    lon = (F.col("living_area") - 50) / 10000
    return views.sales(spark, sf).select(
        "property_id",
        clean.real_coordinate(lat).alias("latitude"),
        clean.real_coordinate(lon).alias("longitude"),
    )


@query(
    "b11_iso_dates",
    """SELECT property_id, strftime(listed_date, '%Y-%m-%d') AS listed_date, strftime(sold_date, '%Y-%m-%d') AS sold_date
       FROM sales""",
    "sales",
)
def _(spark, sf):
    return clean.dates_as_iso(views.sales(spark, sf).select("property_id", "listed_date", "sold_date"))


@query("b12_area_range", "SELECT property_id, living_area FROM sales WHERE living_area BETWEEN 40 AND 60", "sales")
def _(spark, sf):
    return clean.area_between(views.sales(spark, sf), 40, 60).select("property_id", "living_area")


@query(
    "b13_sold_in_month",
    """SELECT property_id, final_price FROM sales
       WHERE sold_date >= DATE '1997-03-01' AND sold_date < DATE '1997-04-01'""",
    "sales",
)
def _(spark, sf):
    month = clean.month_start("1997-03", datetime(2002, 1, 1))
    return clean.sold_in_month(views.sales(spark, sf), month).select("property_id", "final_price")


@query(
    "b14_comparable_display",
    """SELECT final_price AS "Price (SEK)", living_area AS "Area (sqm)", sale_year AS "Year Sold",
              number_of_rooms * 1000 AS "Fee (SEK)", final_price / living_area AS "SEK/sqm" FROM sales""",
    "sales",
)
def _(spark, sf):
    return clean.comparable_display(views.sales(spark, sf).withColumn("fee", F.col("number_of_rooms") * 1000))


@query(
    "b15_rounded_prediction",
    """WITH p AS (SELECT property_id, living_area, final_price, final_price // 1000 AS k, final_price % 1000 AS r FROM sales),
       q AS (SELECT *, 1000 * (k + CASE WHEN r > 500 THEN 1 WHEN r < 500 THEN 0 ELSE k % 2 END) AS rounded FROM p)
       SELECT property_id, CAST(rounded AS DOUBLE) AS predicted_price, rounded / living_area AS predicted_per_sqm FROM q""",
    "sales",
)
def _(spark, sf):
    guess = views.sales(spark, sf).withColumn("prediction", F.col("final_price").cast("double"))
    return clean.rounded_prediction(guess).select("property_id", "predicted_price", "predicted_per_sqm")


@query(
    "b16_range_labels",
    """SELECT property_id,
       CASE WHEN number_of_rooms >= 5 THEN '5+' ELSE concat(number_of_rooms, '-', number_of_rooms + 1) END AS rooms_range,
       CASE WHEN final_price >= 10000000 THEN '10000000+' WHEN final_price >= 5000000 THEN '5000000-10000000'
            WHEN final_price >= 3000000 THEN '3000000-5000000' WHEN final_price >= 2000000 THEN '2000000-3000000'
            WHEN final_price >= 1000000 THEN '1000000-2000000' ELSE '0-1000000' END AS price_range,
       CASE WHEN living_area >= 150 THEN '150+' WHEN living_area >= 100 THEN '100-150' WHEN living_area >= 80 THEN '80-100'
            WHEN living_area >= 60 THEN '60-80' WHEN living_area >= 40 THEN '40-60' ELSE '0-40' END AS area_label
       FROM sales""",
    "sales",
)
def _(spark, sf):
    return clean.with_range_labels(views.sales(spark, sf)).select(
        "property_id", "rooms_range", "price_range", "area_label"
    )


@query(
    "b17_listing_status",
    """WITH s AS (SELECT property_id, max(recorded_at) AS last_seen,
                  max(CASE WHEN event_type = 'purchase' AND price > 40 THEN recorded_at END) AS sold_at
                  FROM price_history GROUP BY 1)
       SELECT property_id, CASE WHEN sold_at IS NOT NULL THEN 'sold'
              WHEN DATE '2024-02-06' - CAST(last_seen AS DATE) > 7 THEN 'removed' ELSE 'active' END AS status FROM s""",
    "price_history",
)
def _(spark, sf):
    sold = (F.col("event_type") == "purchase") & (F.col("price") > 40)
    seen = views.price_history(spark, sf).groupBy("property_id").agg(
        F.max("recorded_at").alias("last_seen"), F.max(F.when(sold, F.col("recorded_at"))).alias("sold_at")
    )
    status = clean.listing_status(F.col("last_seen"), F.col("sold_at"), F.lit(date(2024, 2, 6)))
    return seen.select("property_id", status.alias("status"))


@query(
    "b18_provenance",
    """SELECT property_id, '40-60m²' AS area_range, strftime(sold_date, '%Y-%m') AS sold_month,
              '2025-11-15T20:05:25' AS captured FROM sales WHERE living_area BETWEEN 40 AND 60""",
    "sales",
)
def _(spark, sf):
    rows = clean.area_between(views.sales(spark, sf), 40, 60)
    tagged = clean.tag_provenance(rows, "2025-11-15 20:05:25", (40, 60), F.col("sold_date"))
    return tagged.select(
        "property_id",
        "area_range",
        "sold_month",
        F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss").alias("captured"),
    )


@query(
    "b19_parse_month",
    """SELECT property_id, CASE WHEN number_of_rooms = 2 THEN NULL
              ELSE strftime(date_trunc('month', sold_date), '%Y-%m-%d') END AS month_start, '2001-12-01' AS default_month
       FROM sales""",
    "sales",
)
def _(spark, sf):
    text = F.when(F.col("number_of_rooms") == 2, F.lit("someday")).otherwise(F.date_format("sold_date", "yyyy-M"))
    return views.sales(spark, sf).select(
        "property_id",
        clean.parse_month(text).cast("string").alias("month_start"),
        clean.month_start(None, datetime(2002, 1, 2)).cast("string").alias("default_month"),
    )
