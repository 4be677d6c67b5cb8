"""Captured listing pages to raw records, as one chain of column expressions per page row.

Nothing here shuffles: each page row carries its own object cache, and every
step adds columns to that row.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark import schemas
from estate_spark.session import computed_once
from estate_spark.functions.text import blank_to_null, flexible_date, listing_id, listing_type, strip
from estate_spark.functions.variants import at, fields_of, first_usable, let, text_of, unwrap, usable

# The data script, the record kinds in the cache, position patterns.
# The script's text is read in whole stretches up to the next ``<``, never character by character.
DATA_SCRIPT = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.[^<]*+(?:<(?!/script>)[^<]*+)*+)</script>'
RECORD_KINDS = ("Property", "ActivePropertyListing", "SoldPropertyListing", "Listing")
POSITION_BODY = r"\[null,null,(\d+\.\d+),(\d+\.\d+)\]"
LATITUDE_PARAM = r"(?:lat|latitude)[=:](\d+\.\d+)"
LONGITUDE_PARAM = r"(?:lng|lon|longitude)[=:](\d+\.\d+)"
# Keys read from a listing object.
LISTING_KEYS = (
    "streetAddress street location coordinate area districts locationName municipality county "
    "housingForm housing_form propertyType tenureForm tenure ownershipType "
    "numberOfRooms rooms roomCount livingArea living_area landArea plotArea lot_area floor formattedFloor "
    "elevator hasElevator balcony hasBalcony constructionYear buildYear yearBuilt legacyConstructionYear "
    "energyClass energyRating housingAssociation association fee monthlyFee avgift operatingCost driftskostnad "
    "description askingPrice listing price soldPrice finalPrice sellingPrice soldAt soldDate saleDate "
    "timesViewed statistics daysOnMarket publishedAt listedAt viewings"
).split()
PAGE_DATA = (
    "struct<props:struct<pageProps:struct<`__APOLLO_STATE__`:map<string,variant>,property:variant>>>"
)


def embedded_json(html: Column, script: str = DATA_SCRIPT) -> Column:
    """Text of the data script; null when the page has none."""
    return blank_to_null(F.regexp_extract(html, script, 1))


def with_main_object(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``cache`` (key to object) and ``main`` (the listing object, null when none is found).

    Bad JSON leaves both null. The cache keeps its order, as the first object of a
    record kind is the one wanted.
    """
    props = F.from_json(embedded_json(F.col(html)), PAGE_DATA)["props"]["pageProps"]
    parsed = computed_once(pages, "_props", props)
    cache, direct = F.col("_props")["__APOLLO_STATE__"], usable(F.col("_props")["property"])
    records = F.filter(F.map_values(cache), lambda v: at(v, "__typename", "string").isin(*RECORD_KINDS))
    found = F.get(records, 0)
    return (
        parsed.withColumn("_found", found)
        .withColumn("main", F.coalesce("_found", direct))
        .withColumn("cache", F.when(F.col("_found").isNotNull(), cache))
        .drop("_props", "_found")
    )


def request_position(requests: Column) -> Column:
    """Position from the first captured request that shows one: POST body first, then URL parameters."""

    def position(r: Column) -> Column:
        def pair(text: Column, pattern_lat: str, lat: int, pattern_lng: str, lng: int) -> Column:
            a = F.regexp_extract(text, pattern_lat, lat).try_cast("double")
            b = F.regexp_extract(text, pattern_lng, lng).try_cast("double")
            return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("latitude"), b.alias("longitude")))

        body = pair(r["postData"], POSITION_BODY, 1, POSITION_BODY, 2)
        return F.coalesce(body, pair(r["url"], LATITUDE_PARAM, 1, LONGITUDE_PARAM, 1))

    return F.get(F.filter(F.transform(requests, position), lambda p: p.isNotNull()), 0)


def with_listing_fields(pages_with_main: DataFrame, keys: Sequence[str] = LISTING_KEYS) -> DataFrame:
    """Adds ``f``: all known keys of the listing object, or those given, opened once per page."""
    return pages_with_main.withColumn("f", fields_of(F.col("main"), keys))


LOCATION_KEYS = ("streetAddress", "area", "locationName", "districts", "municipality", "county")
POSITION_KEYS = ("location", "coordinate")


def object_position(f: Column) -> Column:
    """Position inside the listing object: under its location, else on the object itself."""
    c = first_usable(at(f["location"], "coordinate"), f["coordinate"])
    return F.try_variant_get(c, "$", "struct<latitude:double,longitude:double>")


def choose_city(names: Column, neighborhood: Column) -> Column:
    """Shortest district name without a slash that is neither region nor neighbourhood.

    Ties go to the earlier district: the place in the list is the last sort key.
    """
    ranked = F.transform(
        names,
        lambda n, i: F.struct(
            F.contains(n, F.lit("/")).alias("has_slash"), F.length(n).alias("len"), i.alias("i"), n.alias("name")
        ),
    )
    usable_names = F.filter(
        ranked,
        lambda s: s["name"].isNotNull()
        & ~F.contains(F.lower(s["name"]), F.lit("kommun"))
        & ~F.contains(F.lower(s["name"]), F.lit("län"))
        & ~F.equal_null(s["name"], neighborhood),
    )
    return F.get(F.array_sort(usable_names), 0)["name"]


def city_from_location(location_name: Column) -> Column:
    """Second comma-separated part without its municipality suffix."""
    second = F.get(F.split(location_name, ", "), 1)
    return strip(F.replace(second, F.lit(" kommun"), F.lit("")))


def district_names(f: Column, cache: Column) -> Column:
    """Names behind the districts list, in order."""
    refs = F.try_variant_get(f["districts"], "$", "array<variant>")
    return F.transform(refs, lambda d: unwrap(d, cache))


def full_name(v: Column, cache: Column) -> Column:
    return at(F.try_element_at(cache, at(v, "__ref", "string")), "fullName", "string")


def location_detail(pages_with_fields: DataFrame) -> DataFrame:
    """Districts, municipality and county by reference, next to the plain location fields."""
    f, cache = F.col("f"), F.col("cache")
    refs = F.try_variant_get(f["districts"], "$", "array<variant>")
    names = F.filter(
        F.transform(refs, lambda d: blank_to_null(full_name(d, cache))), lambda n: n.isNotNull()
    )
    return pages_with_fields.filter(F.col("main").isNotNull()).select(
        "url",
        text_of(f["streetAddress"]).alias("address"),
        text_of(f["area"]).alias("area"),
        text_of(f["locationName"]).alias("location_name"),
        F.coalesce(names, F.array().cast("array<string>")).alias("districts"),
        full_name(f["municipality"], cache).alias("municipality"),
        full_name(f["county"], cache).alias("county"),
    )


def district_counts(detail: DataFrame) -> DataFrame:
    size = F.size("districts")
    return detail.agg(
        F.min(size).alias("min_districts"), F.max(size).alias("max_districts"), F.avg(size).alias("avg_districts")
    )


def _flag(first: Column, second: Column) -> Column:
    """Either value usable; an absent second one means no, an explicit null there stays null."""
    tail = F.when(second.isNull(), F.lit("false")).otherwise(text_of(second))
    return F.coalesce(text_of(usable(first)), tail)


def common_fields(f: Column, cache: Column, position: Column) -> dict[str, Column]:
    plain = lambda *names: text_of(first_usable(*[f[n] for n in names]))
    wrapped = lambda *names: unwrap(first_usable(*[f[n] for n in names]), cache)
    # the key ``area`` names the neighbourhood; only a number there is a size
    size_in_area = F.when(text_of(f["area"]).try_cast("double").isNotNull(), f["area"])
    neighborhood = F.when(size_in_area.isNull(), text_of(f["area"]))
    from_districts = F.when(cache.isNotNull(), choose_city(district_names(f, cache), neighborhood))
    return {
        "address": plain("streetAddress", "street"),
        "latitude": position["latitude"].cast("string"),
        "longitude": position["longitude"].cast("string"),
        "neighborhood": neighborhood,
        "city": F.coalesce(blank_to_null(from_districts), city_from_location(text_of(f["locationName"]))),
        "housing_type": wrapped("housingForm", "housing_form", "propertyType"),
        "ownership_type": wrapped("tenureForm", "tenure", "ownershipType"),
        "rooms": plain("numberOfRooms", "rooms", "roomCount"),
        "living_area": text_of(first_usable(f["livingArea"], f["living_area"], size_in_area)),
        "lot_area": plain("landArea", "plotArea", "lot_area"),
        "floor": plain("floor", "formattedFloor"),
        "has_elevator": _flag(f["elevator"], f["hasElevator"]),
        "has_balcony": _flag(f["balcony"], f["hasBalcony"]),
        "building_year": plain("constructionYear", "buildYear", "yearBuilt", "legacyConstructionYear"),
        "energy_class": plain("energyClass", "energyRating"),
        "association_name": wrapped("housingAssociation", "association"),
        "association_fee": wrapped("fee", "monthlyFee", "avgift"),
        "operating_cost": wrapped("operatingCost", "driftskostnad"),
        "description": text_of(f["description"]),
    }


def _visits(f: Column) -> list[Column]:
    return [at(f["statistics"], "visitsTotal"), at(f["statistics"], "visits")]


def sold_fields(f: Column, cache: Column, zone: str) -> dict[str, Column]:
    sold_at = F.coalesce(*[usable(f[n]) for n in ("soldAt", "soldDate", "saleDate")])
    return {
        "asking_price": unwrap(first_usable(f["askingPrice"], at(f["listing"], "price")), cache),
        "final_price": unwrap(first_usable(f["soldPrice"], f["finalPrice"], f["sellingPrice"]), cache),
        "sold_date": let(text_of(sold_at), lambda t: flexible_date(t, zone)),
        "visit_count": text_of(first_usable(f["timesViewed"], *_visits(f))),
        "days_on_market": text_of(f["daysOnMarket"]),
    }


def listed_date(f: Column, zone: str) -> Column:
    published = F.coalesce(*[usable(f[n]) for n in ("publishedAt", "listedAt")])
    return let(text_of(published), lambda t: flexible_date(t, zone))


def for_sale_fields(f: Column, cache: Column, listed: Column, as_of: date) -> dict[str, Column]:
    shown = F.transform(
        F.try_variant_get(f["viewings"], "$", "array<variant>"),
        lambda v: blank_to_null(text_of(first_usable(at(v, "formattedTime"), at(v, "time")))),
    )
    return {
        "asking_price": unwrap(first_usable(f["askingPrice"], at(f["price"], "asking")), cache),
        "listed_date": listed,
        "days_on_market": F.datediff(F.lit(as_of), listed).cast("string"),
        "viewing_times": F.coalesce(
            F.filter(shown, lambda t: t.isNotNull()), F.array().cast("array<string>")
        ),
        "visit_count": text_of(first_usable(*_visits(f))),
    }


def extract_records(
    pages: DataFrame,
    captured_at,
    as_of: date,
    zone: str = "UTC",
    requests: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One raw record per page with every declared field, plus ``extract_error`` and the ``carry`` columns.

    Values are text (dates and viewing times excepted) so that validation can
    tell a misfit from a missing value. Pages without a listing type or object
    keep their URL and the reason.
    """
    based = (
        with_listing_fields(with_main_object(pages))
        .withColumn("property_type", listing_type(F.col("url")))
        .withColumn("property_id", listing_id(F.col("url")))
    )
    f, cache = F.col("f"), F.col("cache")
    inner = object_position(f)
    position = inner if requests is None else F.coalesce(request_position(F.col(requests)), inner)
    fields = common_fields(f, cache, F.col("_position"))
    sold, active = sold_fields(f, cache, zone), for_sale_fields(f, cache, F.col("_listed"), as_of)
    is_sold = F.col("property_type") == "sold"
    by_type = {}
    for name in [*sold, *active]:
        s, a = sold.get(name), active.get(name)
        by_type[name] = (
            F.when(is_sold, s) if a is None else F.when(~is_sold, a) if s is None else F.when(is_sold, s).otherwise(a)
        )
    error = F.when(F.col("property_type").isNull(), F.lit("unknown_listing_type")).when(
        F.col("main").isNull(), F.lit("no_listing_data")
    )
    known = ("property_id", "property_type", "url", "scraped_at")
    derived = ("price_change", "price_change_pct", "price_per_sqm_final", "price_per_sqm")
    data = [n for n in schemas.ANY_RECORD_FIELDS if n not in known and n not in derived]
    every = {**fields, **by_type}
    listed = F.when(F.col("property_type") == "for_sale", listed_date(f, zone))
    return based.withColumns({"_position": position, "_listed": listed}).select(
        "property_id",
        "property_type",
        "url",
        F.lit(captured_at).cast("timestamp_ntz").alias("scraped_at"),
        *[every[n].alias(n) for n in data],
        error.alias("extract_error"),
        *carry,
    )


def as_type(records: DataFrame, kind: str) -> DataFrame:
    """Records of one type in the declared shape of that type."""
    shape = schemas.SOLD if kind == "sold" else schemas.FOR_SALE
    return records.filter(F.col("property_type") == kind).select(
        *[F.col(f.name).cast(f.dataType) for f in shape.fields]
    )
