"""Housing-shaped views over the generic star-schema tables.

``sales``          one row per sale (line item joined to its dimensions)
``price_history``  price observations per listing (from the event log)
``links``          one row per href in the captured pages
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nearest_whole(amount: Column) -> Column:
    """Half-up rounding of non-negative amounts; much cheaper than decimal-based ``round``."""
    return F.floor(amount + 0.5)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join order is left to Catalyst; dimension sides are broadcast only by measured size."""
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    asking = F.col("l_extendedprice") * 40
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("property_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("listing_key"),
        F.concat("n_name", F.lit(", "), "r_name").alias("location"),
        F.col("n_name").alias("neighborhood"),
        F.col("r_name").alias("city"),
        F.col("c_mktsegment").alias("ownership_form"),
        F.col("l_linenumber").alias("number_of_rooms"),
        (F.col("l_quantity") * 2).alias("living_area"),
        (1750 + 5 * F.col("p_size")).alias("year_of_construction"),
        _nearest_whole(asking).alias("asking_price"),
        _nearest_whole(asking * (1 + F.col("l_tax") - F.col("l_discount"))).alias("final_price"),
        F.to_date("o_orderdate").alias("listed_date"),
        F.to_date("l_shipdate").alias("sold_date"),
        F.year("l_shipdate").alias("sale_year"),
    )


SALES_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS property_id,
       concat_ws('-', l_orderkey, l_linenumber) AS listing_key,
       concat(n_name, ', ', r_name) AS location,
       n_name AS neighborhood, r_name AS city, c_mktsegment AS ownership_form,
       l_linenumber AS number_of_rooms, l_quantity * 2 AS living_area,
       1750 + 5 * p_size AS year_of_construction,
       CAST(round(l_extendedprice * 40) AS BIGINT) AS asking_price,
       CAST(round(l_extendedprice * 40 * (1 + l_tax - l_discount)) AS BIGINT) AS final_price,
       CAST(o_orderdate AS DATE) AS listed_date, CAST(l_shipdate AS DATE) AS sold_date,
       CAST(year(l_shipdate) AS INTEGER) AS sale_year
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
"""


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("property_id"),
        F.col("value").alias("price"),
        F.col("ts").alias("recorded_at"),
        "event_type",
    )


PRICE_HISTORY_SQL = """
SELECT event_id, user_id AS property_id, value AS price, ts AS recorded_at, event_type FROM events
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every href with its position; the page array is exploded row by row, no shuffle."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("page_url"), F.posexplode(hrefs).alias("pos", "href")
    )


LINKS_SQL = """
SELECT page_id, page_url, CAST(pos - 1 AS INTEGER) AS pos, href FROM (
  SELECT page_id, page_url, unnest(hs) AS href, unnest(range(1, len(hs) + 1)) AS pos FROM (
    SELECT page_id, url AS page_url, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hs FROM pages))
"""
