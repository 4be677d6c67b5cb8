"""Registered queries: links, pagination and page extraction (P)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from estate_spark.functions.text import flexible_date, inner_text
from estate_spark.functions.variants import at, follow, text_of, unwrap
from estate_spark.operators import links, pages
from estate_spark.operators.quality import valid
from estate_spark.plans import derived
from estate_spark.plans.detail_load import checked_records
from estate_spark.plans.registry import query
from estate_spark.session import staged
from estate_spark.sources import views

CAPTURED = datetime(2025, 11, 15, 20, 5, 25)
AS_OF = date(2025, 11, 20)
L = ("sales", "listing")

_FIRST_LINKS = """
WITH k AS (SELECT page_id, page_url, href, min(pos) AS p FROM links WHERE {keep} GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INTEGER) AS pos,
       concat(regexp_extract(page_url, '^([a-zA-Z]+://[^/?#]+)', 1), href) AS url, {id} AS property_id FROM k
"""


@query(
    "p1_active_links",
    _FIRST_LINKS.format(
        keep="contains(href, '/t') AND NOT contains(href, '/the') AND NOT contains(href, '/to')",
        id="CASE WHEN contains(concat(regexp_extract(page_url, '^([a-zA-Z]+://[^/?#]+)', 1), href), '-') "
        "THEN split_part(concat(regexp_extract(page_url, '^([a-zA-Z]+://[^/?#]+)', 1), href), '-', -1) END",
    ),
    "links",
)
def _(spark, sf):
    found = links.active_links(views.table(spark, sf, "pages"), path="/t", excluded=("/the", "/to"))
    return found.select("page_id", "pos", "url", "property_id")


@query(
    "p2_sold_links",
    _FIRST_LINKS.format(
        keep="contains(href, '/e') AND NOT contains(href, '#')",
        id="split_part(concat(regexp_extract(page_url, '^([a-zA-Z]+://[^/?#]+)', 1), href), '-', -1)",
    ),
    "links",
)
def _(spark, sf):
    return links.sold_links(views.table(spark, sf, "pages"), path="/e").select("page_id", "pos", "url", "property_id")


@query(
    "p3_pagination",
    """SELECT page_id, CAST(CASE WHEN page > 0 THEN page ELSE 1 END AS INTEGER) AS current_page,
              CAST(greatest(2, last) AS INTEGER) AS total_pages, total AS total_results FROM search""",
    "search",
)
def _(spark, sf):
    return links.pagination(derived.search_pages(spark, sf))


@query(
    "p3_pagination_captured",
    """SELECT page_id, CAST(CASE WHEN contains(url, 'page=2&') THEN 2 ELSE 1 END AS INTEGER) AS current_page,
              CAST(1 AS INTEGER) AS total_pages FROM pages""",
)
def _(spark, sf):
    return links.pagination(views.table(spark, sf, "pages")).drop("total_results")


@query("p4_stated_total", "SELECT page_id, total FROM search", "search")
def _(spark, sf):
    return derived.search_pages(spark, sf).select("page_id", links.stated_total(inner_text(F.col("html"))).alias("total"))


@query(
    "p5_page_plan",
    """WITH n AS (SELECT page_id, total, least((total + 49) // 50, 50) AS n_pages FROM search)
       SELECT page_id, CAST(n_pages AS INTEGER) AS n_pages, total >= 2500 AS over_limit,
              CAST(unnest(range(1, n_pages + 1)) AS INTEGER) AS page_no FROM n""",
    "search",
)
def _(spark, sf):
    totals = derived.search_pages(spark, sf).select("page_id", links.stated_total(inner_text(F.col("html"))).alias("total_results"))
    return links.page_plan(totals).select("page_id", "n_pages", "over_limit", "page_no")


def with_main(spark, sf, keys=pages.LISTING_KEYS):
    return pages.with_listing_fields(pages.with_main_object(derived.listing_pages(spark, sf)), keys)


@query("p6_embedded_json", "SELECT url, NOT broken AS readable, true AS has_script FROM listing", *L)
def _(spark, sf):
    text = pages.embedded_json(F.col("html"))
    return derived.listing_pages(spark, sf).select(
        "url", F.try_parse_json(text).isNotNull().alias("readable"), text.isNotNull().alias("has_script")
    )


@query(
    "p6_embedded_json_captured",
    "SELECT page_id, contains(html, '__NEXT_DATA__') AS has_script FROM pages",
)
def _(spark, sf):
    return views.table(spark, sf, "pages").select(
        "page_id", pages.embedded_json(F.col("html")).isNotNull().alias("has_script")
    )


@query(
    "p7_main_object",
    """SELECT url, CASE WHEN broken THEN NULL WHEN sold THEN 'SoldPropertyListing' ELSE 'ActivePropertyListing' END AS kind,
              NOT broken AND number_of_rooms <> 5 AS from_cache FROM listing""",
    *L,
)
def _(spark, sf):
    return with_main(spark, sf).select(
        "url", at(F.col("main"), "__typename", "string").alias("kind"), F.col("cache").isNotNull().alias("from_cache")
    )


@query(
    "p8_follow_reference",
    """SELECT url, CASE WHEN broken OR number_of_rooms = 5 THEN NULL ELSE concat(city, ' kommun') END AS municipality
       FROM listing""",
    *L,
)
def _(spark, sf):
    target = follow(at(F.col("main"), "municipality"), F.col("cache"))
    return with_main(spark, sf).select("url", at(target, "fullName", "string").alias("municipality"))


@query(
    "p9_unwrap_values",
    """SELECT url, CASE WHEN broken THEN NULL WHEN number_of_rooms % 2 = 0 THEN 'Radhus' ELSE 'Row_House' END AS housing,
              CASE WHEN broken THEN NULL WHEN number_of_rooms % 2 = 0 THEN 'Bostadsrätt' ELSE 'Tenant Ownership' END AS tenure,
              CASE WHEN NOT broken AND number_of_rooms <> 6 THEN CAST(number_of_rooms * 100 + 1000 AS VARCHAR) END AS fee,
              CASE WHEN NOT broken AND number_of_rooms <> 5 THEN concat(city, ' kommun') END AS place FROM listing""",
    *L,
)
def _(spark, sf):
    field = lambda name: unwrap(F.col("f")[name], F.col("cache"))
    place = F.when(F.col("cache").isNotNull(), field("municipality"))
    return with_main(spark, sf, ("housingForm", "tenure", "fee", "municipality")).select(
        "url",
        field("housingForm").alias("housing"),
        field("tenure").alias("tenure"),
        field("fee").alias("fee"),
        place.alias("place"),
    )


@query(
    "p10_request_position",
    """SELECT url, CASE WHEN number_of_rooms <> 4 THEN CAST(55.5 AS DOUBLE) END AS latitude,
              CASE WHEN number_of_rooms <> 4 THEN CAST(concat('13.0', number_of_rooms) AS DOUBLE) END AS longitude FROM listing""",
    *L,
)
def _(spark, sf):
    position = pages.request_position(F.col("requests"))
    return derived.listing_pages(spark, sf).withColumn("position", position).select(
        "url", "position.latitude", "position.longitude"
    )


@query(
    "p11_object_position",
    """SELECT url, CASE WHEN NOT broken THEN living_area / 100 + 55 END AS latitude,
              CASE WHEN NOT broken THEN number_of_rooms / 10 + 13 END AS longitude FROM listing""",
    *L,
)
def _(spark, sf):
    position = pages.object_position(F.col("f"))
    return with_main(spark, sf, pages.POSITION_KEYS).withColumn("position", position).select("url", "position.latitude", "position.longitude")


@query("p12_city_from_districts", "SELECT url, CASE WHEN NOT broken AND number_of_rooms <> 5 THEN city END AS city FROM listing", *L)
def _(spark, sf):
    main, cache = F.col("main"), F.col("cache")
    names = F.when(cache.isNotNull(), pages.district_names(F.col("f"), cache))
    return with_main(spark, sf, ("districts",)).select("url", pages.choose_city(names, at(main, "area", "string")).alias("city"))


@query("p13_city_from_location", "SELECT url, CASE WHEN NOT broken THEN city END AS city FROM listing", *L)
def _(spark, sf):
    return with_main(spark, sf).select(
        "url", pages.city_from_location(at(F.col("main"), "locationName", "string")).alias("city")
    )


def extracted(spark, sf):
    return pages.extract_records(derived.listing_pages(spark, sf), CAPTURED, AS_OF, requests="requests")


@query(
    "p14_common_fields",
    """SELECT url, CASE WHEN NOT broken THEN CAST(number_of_rooms AS DOUBLE) END AS rooms,
              CASE WHEN NOT broken THEN living_area END AS area,
              CASE WHEN NOT broken THEN CAST(year_of_construction AS BIGINT) END AS built,
              CASE WHEN NOT broken THEN CAST(number_of_rooms * 100 + 1000 AS BIGINT) END AS fee,
              CASE WHEN number_of_rooms = 4 THEN '0' END AS floor,
              CASE WHEN NOT broken THEN neighborhood END AS neighborhood,
              CASE WHEN NOT broken THEN concat('Street ', number_of_rooms) END AS address FROM listing""",
    *L,
)
def _(spark, sf):
    return extracted(spark, sf).select(
        "url",
        F.col("rooms").try_cast("double").alias("rooms"),
        F.col("living_area").try_cast("double").alias("area"),
        F.col("building_year").try_cast("long").alias("built"),
        F.col("association_fee").try_cast("long").alias("fee"),
        "floor",
        "neighborhood",
        "address",
    )


@query(
    "p15_flags",
    """SELECT url, CASE WHEN number_of_rooms IN (1, 2) THEN 'true' ELSE 'false' END AS has_elevator,
              'false' AS has_balcony FROM listing""",
    *L,
)
def _(spark, sf):
    return extracted(spark, sf).select("url", "has_elevator", "has_balcony")


@query(
    "p16_sold_fields",
    """SELECT url, asking_price, final_price, strftime(sold_date, '%Y-%m-%d') AS sold_on,
              CAST(CASE WHEN number_of_rooms = 4 THEN 77 WHEN number_of_rooms = 6 THEN 120 ELSE number_of_rooms * 10 END AS BIGINT) AS visits,
              CAST(sold_date - listed_date AS BIGINT) AS days FROM listing WHERE sold AND NOT broken""",
    *L,
)
def _(spark, sf):
    rows = extracted(spark, sf).filter("property_type = 'sold' and extract_error is null")
    return rows.select(
        "url",
        F.col("asking_price").try_cast("long").alias("asking_price"),
        F.col("final_price").try_cast("long").alias("final_price"),
        F.col("sold_date").cast("string").alias("sold_on"),
        F.col("visit_count").try_cast("long").alias("visits"),
        F.col("days_on_market").try_cast("long").alias("days"),
    )


@query(
    "p17_for_sale_fields",
    """SELECT url, asking_price, strftime(listed_date, '%Y-%m-%d') AS listed_on, 'Sun 12:00,17:00' AS viewings,
              CAST(CASE WHEN number_of_rooms = 6 THEN 120 ELSE number_of_rooms * 10 END AS BIGINT) AS visits,
              CAST(DATE '2025-11-20' - listed_date AS BIGINT) AS days FROM listing WHERE NOT sold AND NOT broken""",
    *L,
)
def _(spark, sf):
    rows = extracted(spark, sf).filter("property_type = 'for_sale' and extract_error is null")
    return rows.select(
        "url",
        F.col("asking_price").try_cast("long").alias("asking_price"),
        F.col("listed_date").cast("string").alias("listed_on"),
        F.array_join("viewing_times", ",").alias("viewings"),
        F.col("visit_count").try_cast("long").alias("visits"),
        F.col("days_on_market").try_cast("long").alias("days"),
    )


@query(
    "p18_flexible_date",
    """SELECT property_id, CASE WHEN number_of_rooms = 3 THEN NULL ELSE strftime(sold_date, '%Y-%m-%d') END AS sold_on,
              strftime(sold_date + 1, '%Y-%m-%d') AS next_day FROM sales""",
    "sales",
)
def _(spark, sf):
    noon = F.unix_date("sold_date").cast("long") * 86400 + 43200
    rooms = F.col("number_of_rooms")
    text = (
        F.when(rooms == 1, noon.cast("string"))
        .when(rooms == 2, F.concat(noon.cast("string"), F.lit(".25")))
        .when(rooms == 3, F.lit("soon"))
        .when(rooms == 4, F.date_format("sold_date", "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format("sold_date", "yyyy-MM-dd"), F.lit("T23:59:59+02:00")))
    )
    late = (noon + 42000).cast("string")
    return views.sales(spark, sf).select(
        "property_id",
        flexible_date(text).cast("string").alias("sold_on"),
        flexible_date(late, "Europe/Stockholm").cast("string").alias("next_day"),
    )


@query(
    "p19_location_detail",
    """SELECT url, CASE WHEN number_of_rooms = 5 THEN '' ELSE
                concat_ws('|', neighborhood, concat(city, ' kommun'), concat(neighborhood, '/', city), city) END AS districts,
              CASE WHEN number_of_rooms <> 5 THEN concat(city, ' kommun') END AS municipality,
              CASE WHEN number_of_rooms <> 5 THEN concat(city, ' län') END AS county,
              concat(neighborhood, ', ', city, ' kommun') AS location_name FROM listing WHERE NOT broken""",
    *L,
)
def _(spark, sf):
    return pages.location_detail(with_main(spark, sf, pages.LOCATION_KEYS)).select(
        "url", F.array_join("districts", "|").alias("districts"), "municipality", "county", "location_name"
    )


@query(
    "d12_district_counts",
    """SELECT CAST(min(n) AS INTEGER) AS min_districts, CAST(max(n) AS INTEGER) AS max_districts, avg(n) AS avg_districts
       FROM (SELECT CASE WHEN number_of_rooms = 5 THEN 0 ELSE 4 END AS n FROM listing WHERE NOT broken)""",
    *L,
)
def _(spark, sf):
    return pages.district_counts(pages.location_detail(with_main(spark, sf, pages.LOCATION_KEYS)))


@query(
    "p20_typed_records",
    """SELECT page_id AS property_id, property_type, url, city, CASE WHEN sold THEN final_price END AS final_price, asking_price,
              CASE WHEN sold THEN final_price / living_area END AS price_per_sqm_final,
              CASE WHEN NOT sold THEN asking_price / living_area END AS price_per_sqm
       FROM listing WHERE NOT broken AND living_area >= 10 AND year_of_construction >= 1800
         AND asking_price BETWEEN 100000 AND 50000000 AND (NOT sold OR final_price BETWEEN 100000 AND 50000000)
         AND (NOT sold OR sold_date >= listed_date)""",
    *L,
)
def _(spark, sf):
    # staged first, as in the load: both record types read it
    good = valid(staged(checked_records(derived.listing_pages(spark, sf), CAPTURED, AS_OF, derived.SITE)))
    sold, active = pages.as_type(good, "sold"), pages.as_type(good, "for_sale")
    return sold.unionByName(active, allowMissingColumns=True).select(
        "property_id", "property_type", "url", "city", "final_price", "asking_price", "price_per_sqm_final", "price_per_sqm"
    )
