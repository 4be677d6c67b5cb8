"""Captured-page tables made from the sales and orders tables.

The page table at hand carries no embedded data script and no result counts, so
pages of that shape are built here, one per sale or order, by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_spark.plans.registry import VIEW_SQL
from estate_spark.sources import views

SITE = "https://homes.example/"


def spread_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales rows hashed over all tasks before anything wide or costly is made from them.

    A captured-page table has many splits; the joined sales of one small file would be one.
    The number is given, as sizes in bytes say little about the work per row to come.
    """
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return views.sales(spark, sf_dir).repartition(parts, "property_id")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing page per sale: ``page_id, url, html, requests``.

    Shapes by room count: 1-4 object cache with references; 5 a plain object
    without cache; 6 cache with alias keys and plain numbers; 7 broken JSON
    when the asking price is even, else as 1-4 under a URL with a slash.
    """
    s = spread_sales(spark, sf_dir)
    rooms = F.col("number_of_rooms")
    sold = F.col("sale_year") % 2 == 0
    alias, direct = rooms == 6, rooms == 5
    record = F.translate("property_id", "-", "_")
    only = lambda cond, value: F.when(cond, value)
    money = lambda c: F.struct(F.lit("Money").alias("__typename"), c.alias("amount"))
    ref = lambda key: F.struct(F.lit(key).alias("__ref"))
    place = lambda name: F.struct(F.lit("Location").alias("__typename"), name.alias("fullName"))
    epoch = lambda d: (F.unix_date(d).cast("long") * 86400 + 43200)
    iso = lambda d: F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T23:30:00Z"))
    listed_for = ~sold

    main = F.struct(
        F.when(sold, "SoldPropertyListing").otherwise("ActivePropertyListing").alias("__typename"),
        F.concat(F.lit("Street "), rooms.cast("string")).alias("streetAddress"),
        F.col("neighborhood").alias("area"),
        F.concat("neighborhood", F.lit(", "), "city", F.lit(" kommun")).alias("locationName"),
        F.array(*[ref(f"Location:{i}") for i in (1, 2, 3, 4)]).alias("districts"),
        ref("Location:2").alias("municipality"),
        ref("Location:5").alias("county"),
        F.when(alias, 0).otherwise(rooms).alias("numberOfRooms"),
        only(alias, rooms.cast("string")).alias("rooms"),
        only(~alias, F.col("living_area")).alias("livingArea"),
        only(alias, F.col("living_area").cast("string")).alias("living_area"),
        only(~alias, F.col("year_of_construction")).alias("constructionYear"),
        only(alias, F.col("year_of_construction")).alias("yearBuilt"),
        F.struct(
            F.lit("HousingForm").alias("__typename"),
            F.lit("ROW_HOUSE").alias("code"),
            only(rooms % 2 == 0, F.lit("Radhus")).alias("name"),
        ).alias("housingForm"),
        F.struct(
            F.lit("Tenure").alias("__typename"),
            F.lit("TENANT_OWNERSHIP").alias("code"),
            only(rooms % 2 == 0, F.lit("Bostadsrätt")).alias("name"),
        ).alias("tenure"),
        only(~alias, money(rooms * 100 + 1000)).alias("fee"),
        only(alias, rooms * 100 + 1000).alias("monthlyFee"),
        only(~direct, money(F.col("asking_price"))).alias("askingPrice"),
        only(direct & listed_for, F.struct(F.col("asking_price").alias("asking"))).alias("price"),
        only(direct & sold, F.struct(F.col("asking_price").alias("price"))).alias("listing"),
        only(sold & ~alias, money(F.col("final_price"))).alias("soldPrice"),
        only(sold & alias, F.col("final_price")).alias("sellingPrice"),
        only(sold & ~direct & ~alias, epoch(F.col("sold_date"))).alias("soldAt"),
        only(sold & alias, epoch(F.col("sold_date")).cast("string")).alias("soldDate"),
        only(sold & direct, iso(F.col("sold_date"))).alias("saleDate"),
        only(listed_for & ~direct, epoch(F.col("listed_date"))).alias("publishedAt"),
        only(listed_for & direct, iso(F.col("listed_date"))).alias("listedAt"),
        F.struct(
            (F.col("living_area") / 100 + 55).alias("latitude"), (rooms / 10 + 13).alias("longitude")
        ).alias("coordinate"),
        F.struct(
            only(~alias, rooms * 10).alias("visitsTotal"), only(alias, rooms * 20).alias("visits")
        ).alias("statistics"),
        only(sold & (rooms == 4), F.lit(77)).alias("timesViewed"),
        only(sold, F.datediff("sold_date", "listed_date")).alias("daysOnMarket"),
        F.array(
            F.struct(F.lit("Sun 12:00").alias("formattedTime"), F.lit(None).cast("string").alias("time")),
            F.struct(F.lit("").alias("formattedTime"), F.lit(None).cast("string").alias("time")),
            F.struct(F.lit(None).cast("string").alias("formattedTime"), F.lit("17:00").alias("time")),
        ).alias("viewings"),
        only(rooms == 1, F.lit(True)).alias("elevator"),
        only(rooms == 2, F.lit(True)).alias("hasElevator"),
        only(rooms == 3, F.lit(False)).alias("balcony"),
        only(rooms == 4, F.lit("0")).alias("floor"),
    )
    cache = F.struct(
        F.struct(F.lit("Query").alias("__typename")).alias("ROOT_QUERY"),
        place(F.col("neighborhood")).alias("Location:1"),
        place(F.concat("city", F.lit(" kommun"))).alias("Location:2"),
        place(F.concat("neighborhood", F.lit("/"), "city")).alias("Location:3"),
        place(F.col("city")).alias("Location:4"),
        place(F.concat("city", F.lit(" län"))).alias("Location:5"),
        main.alias("Listing:main"),
    )
    props = F.struct(
        F.struct(only(~direct, cache).alias("__APOLLO_STATE__"), only(direct, main).alias("property")).alias("pageProps")
    )
    text = F.to_json(F.struct(props.alias("props")))
    broken = (rooms == 7) & (F.col("asking_price") % 2 == 0)
    script = F.when(broken, F.substring(text, 1, 200)).otherwise(text)
    url = F.concat(
        F.lit(SITE),
        F.when(sold, "salda").otherwise("bostad"),
        F.lit("/lagenhet-"),
        rooms,
        F.lit("rum-"),
        record,
        F.when(rooms == 7, "/").otherwise(""),
    )
    lat, lng = F.lit("55.5"), F.concat(F.lit("13.0"), rooms)
    requests = F.array(
        F.struct(F.lit("https://maps.example/js").alias("url"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("postData")),
        F.struct(
            F.when(rooms % 2 == 1, F.concat(F.lit("https://maps.example/s?lat="), lat, F.lit("&lng="), lng))
            .otherwise(F.lit("https://maps.example/SingleImageSearch"))
            .alias("url"),
            F.when(rooms % 2 == 1, "GET").otherwise("POST").alias("method"),
            F.when(rooms % 4 == 2, F.concat(F.lit("[[null,null,"), lat, F.lit(","), lng, F.lit("]]"))).alias("postData"),
        ),
    )
    return s.select(
        record.alias("page_id"),
        url.alias("url"),
        F.concat(
            F.lit('<html><body><h1>Listing</h1><script id="__NEXT_DATA__" type="application/json">'),
            script,
            F.lit("</script></body></html>"),
        ).alias("html"),
        requests.alias("requests"),
    )


# what the pages above say, straight from the sales columns
LISTING_PAGES_SQL = """
SELECT *, replace(property_id, '-', '_') AS page_id, sale_year % 2 = 0 AS sold,
       CASE WHEN sale_year % 2 = 0 THEN 'sold' ELSE 'for_sale' END AS property_type,
       number_of_rooms = 7 AND asking_price % 2 = 0 AS broken,
       concat('https://homes.example/', CASE WHEN sale_year % 2 = 0 THEN 'salda' ELSE 'bostad' END, '/lagenhet-',
              number_of_rooms, 'rum-', replace(property_id, '-', '_'), CASE WHEN number_of_rooms = 7 THEN '/' ELSE '' END) AS url
FROM sales
"""


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search page per order, with a stated total and numbered page links."""
    total = F.col("o_orderkey") * 7 % 4000
    spaced = F.replace(F.format_number(total, 0), F.lit(","), F.lit(" "))
    page = F.col("o_custkey") % 9
    last = page + F.col("o_orderkey") % 20
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit("https://homes.example/salda?item=1"), F.when(page > 0, F.concat(F.lit("&page="), page)).otherwise("")).alias("url"),
        F.concat(
            F.lit("<html><script>var n='9 objekt';</script><body><p>Visar 1 av "),
            spaced,
            F.lit("</p><b>"),
            F.replace(spaced, F.lit(" "), F.lit(" ")),
            F.lit(' träffar</b><a href="/salda?page=2&amp;s=1">2</a><a href="/salda?page='),
            last,
            F.lit('">last</a><a href="/om">x</a></body></html>'),
        ).alias("html"),
    )


SEARCH_PAGES_SQL = """
SELECT o_orderkey AS page_id, o_orderkey * 7 % 4000 AS total, o_custkey % 9 AS page, o_custkey % 9 + o_orderkey % 20 AS last FROM orders
"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text records, one per sale, some of them breaking a rule."""
    a = F.col("asking_price")
    hit = lambda n, bad, good: F.when(a % n == 0, F.lit(bad)).otherwise(good)
    sold = F.col("sale_year") % 2 == 0
    text = lambda c: F.col(c).cast("string")
    site = hit(97, "http://elsewhere.example/", F.lit(SITE))
    return spread_sales(spark, sf_dir).select(
        F.col("property_id").alias("source_id"),
        hit(101, "  ", F.concat(F.lit(" "), "property_id")).alias("property_id"),
        hit(89, "rented", F.when(sold, "sold").otherwise("for_sale")).alias("property_type"),
        F.concat(site, "property_id").alias("url"),
        hit(83, "95.5", F.concat(F.lit("55."), text("number_of_rooms"))).alias("latitude"),
        hit(79, "-190", F.concat(F.lit("13."), text("number_of_rooms"))).alias("longitude"),
        (F.col("number_of_rooms") * 3).cast("string").alias("rooms"),
        text("living_area").alias("living_area"),
        hit(73, "-5", F.lit(None).cast("string")).alias("lot_area"),
        hit(71, "-1", F.lit("2500")).alias("association_fee"),
        hit(67, "-7.0", F.lit("300.0")).alias("operating_cost"),
        text("year_of_construction").alias("building_year"),
        text("asking_price").alias("asking_price"),
        F.when(sold, text("final_price")).alias("final_price"),
        F.when(sold, text("sold_date")).alias("sold_date"),
        F.when(~sold, text("listed_date")).alias("listed_date"),
        F.when(sold, F.datediff("sold_date", "listed_date").cast("string")).alias("days_on_market"),
        hit(61, "many", hit(59, "3.5", hit(53, "-4", F.lit(None).cast("string")))).alias("visit_count"),
        hit(47, "maybe", F.lit("yes")).alias("has_elevator"),
    )


_RULES = {
    "v1": ("property_id_blank", "asking_price % 101 = 0"),
    "v2": ("url_prefix", "asking_price % 97 = 0"),
    "v3": ("property_type_unknown", "asking_price % 89 = 0"),
    "v4": ("latitude_range", "asking_price % 83 = 0"),
    "v4_longitude": ("longitude_range", "asking_price % 79 = 0"),
    "v5": ("rooms_range", "number_of_rooms = 7"),
    "v6": ("living_area_range", "living_area < 10"),
    "v8": ("building_year_range", "year_of_construction < 1800"),
    "v9": ("final_price_range", "kind = 'sold' AND final_price < 100000"),
    "v10": ("asking_price_range", "asking_price < 100000"),
    "v7": ("lot_area_negative", "asking_price % 73 = 0"),
    "v7_fee": ("association_fee_negative", "asking_price % 71 = 0"),
    "v7_cost": ("operating_cost_negative", "asking_price % 67 = 0"),
    "v11": ("days_on_market_negative", "sale_year % 2 = 0 AND sold_date < listed_date"),
    "v11_visits": ("visit_count_negative", "asking_price % 61 <> 0 AND asking_price % 59 <> 0 AND asking_price % 53 = 0"),
    "v12_flag": ("has_elevator_type", "asking_price % 47 = 0"),
    "v12": ("visit_count_type", "asking_price % 61 = 0 OR asking_price % 59 = 0"),
}
RULES = dict(_RULES)

RAW_RECORDS_SQL = """
SELECT *, CASE WHEN asking_price % 89 = 0 THEN 'rented' WHEN sale_year % 2 = 0 THEN 'sold' ELSE 'for_sale' END AS kind FROM sales
"""
ERRORS_SQL = "concat_ws(';', " + ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in _RULES.values()) + ")"

VIEW_SQL.update(
    listing=LISTING_PAGES_SQL,
    search=SEARCH_PAGES_SQL,
    raw=RAW_RECORDS_SQL,
    checked=f"SELECT *, {ERRORS_SQL} AS errors FROM raw",
)
