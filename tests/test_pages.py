"""Page extraction on small pages shaped like captured ones."""

import json
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from estate_spark.functions.text import flexible_date, listing_id, listing_type, title_case
from estate_spark.functions.variants import EMPTY_JSON, unwrap, usable
from estate_spark.operators import pages, quality

SITE = "https://homes.example/"
CAPTURED, AS_OF = datetime(2025, 11, 15), date(2025, 11, 20)


def html(cache=None, direct=None):
    props = {}
    if cache is not None:
        props["__APOLLO_STATE__"] = cache
    if direct is not None:
        props["property"] = direct
    data = json.dumps({"props": {"pageProps": props}}, ensure_ascii=False, indent=1)
    return f'<html><script id="__NEXT_DATA__" type="application/json">{data}</script></html>'


def listing(**fields):
    return {"Q": {"__typename": "Query"}, "S:1": {"__typename": "SoldPropertyListing", **fields}}


@pytest.fixture
def extract(spark):
    def run(page, url=SITE + "salda/a-1", requests=None):
        df = spark.createDataFrame(
            [(1, url, page, requests)],
            "page_id long, url string, html string, requests array<struct<url:string,method:string,postData:string>>",
        )
        return pages.extract_records(df, CAPTURED, AS_OF, requests="requests").first()

    return run


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


@pytest.mark.parametrize(
    "url, kind",
    [("salda/villa-8", "sold"), ("bostad/radhus-9", "for_sale"), ("other/x", None)],
)
def test_listing_type(spark, url, kind):
    assert one(spark, listing_type(F.col("x")), SITE + url) == kind


@pytest.mark.parametrize("url, found", [("bostad/radhus-40", "40"), ("salda/x-9000000000000000017/", "9000000000000000017")])
def test_listing_id(spark, url, found):
    assert one(spark, listing_id(F.col("x")), SITE + url) == found


@pytest.mark.parametrize(
    "value, expected",
    [
        ({"__typename": "Money", "amount": 41, "formatted": "forty-one"}, "41"),
        (17, "17"),
        ("", ""),
        (None, None),
        ({"__typename": "HousingForm", "code": "ROW_HOUSE", "name": "Radhus"}, "Radhus"),
        ({"__typename": "HousingForm", "code": "ROW_HOUSE"}, "Row_House"),
        ({"__typename": "Tenure", "code": "CO_OP", "name": "Andel"}, "Andel"),
        ({"__typename": "Tenure", "code": "CO_OP"}, "Co Op"),
        ({"__typename": "Location", "name": "Norra hamnen"}, "Norra hamnen"),
        ({"__typename": "Other", "code": "c", "name": "n"}, "n"),
        ({"amount": None, "name": "n"}, None),
    ],
)
def test_unwrap(spark, value, expected):
    assert one(spark, unwrap(F.try_parse_json("x")), json.dumps(value)) == expected


def test_unwrap_reads_the_kind_and_each_name_once(spark):
    df = spark.range(1).select(unwrap(F.try_parse_json(F.lit("{}"))).alias("x"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert [len(re.findall(rf"\.{name}, \$, StringType", plan)) for name in ("__typename", "fullName")] == [1, 1]


def test_title_case_starts_words_at_any_non_letter(spark):
    assert one(spark, title_case(F.col("x")), "ROW_HOUSE") == "Row_House"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1762646400", date(2025, 11, 9)),
        ("1762646400.5", date(2025, 11, 9)),
        ("2025-11-09T23:30:00Z", date(2025, 11, 9)),
        ("2025-11-09", date(2025, 11, 9)),
        ("2025-02-31", None),
        ("soon", None),
        (None, None),
    ],
)
def test_flexible_date(spark, text, expected):
    assert one(spark, flexible_date(F.col("x"), "Europe/Stockholm"), text) == expected


def test_zero_and_empty_are_skipped_but_not_text_zero(extract):
    record = extract(html(listing(numberOfRooms=0, rooms="2.5", livingArea=None, living_area=64, floor="0")))
    assert (record.rooms, record.living_area, record.floor) == ("2.5", "64", "0")


def test_text_area_is_a_neighbourhood_not_a_size(extract):
    record = extract(html(listing(area="Folkets Park")))
    assert (record.neighborhood, record.living_area) == ("Folkets Park", None)
    record = extract(html(listing(area=55.5)))
    assert (record.neighborhood, record.living_area) == (None, "55.5")


def test_references_are_followed(extract):
    cache = listing(fee={"__ref": "M:1"}, association={"__ref": "gone"})
    cache["M:1"] = {"__typename": "Money", "amount": 3377}
    assert extract(html(cache)).association_fee == "3377"


def test_references_inside_wrappers_and_null_wrappers(extract):
    cache = listing(fee={"__typename": "Money", "amount": None}, askingPrice={"__ref": "P:1"})
    cache["P:1"] = {"__typename": "Money", "amount": 910000}
    record = extract(html(cache))
    assert (record.association_fee, record.asking_price) == (None, "910000")


def test_flags_absent_and_explicit_null(extract):
    record = extract(html(listing(elevator=False, hasElevator=True, hasBalcony=None)))
    assert (record.has_elevator, record.has_balcony) == ("true", None)
    assert extract(html(listing())).has_balcony == "false"


def test_direct_object_and_for_sale_fields(extract):
    body = {
        "price": {"asking": 3000000},
        "publishedAt": 1762646400,
        "viewings": [{"time": "t1"}, {"formattedTime": ""}, {"formattedTime": "f", "time": "t"}],
        "statistics": {"visits": 12},
    }
    record = extract(html(direct=body), SITE + "bostad/b-2/")
    assert record.property_id == "2" and record.asking_price == "3000000"
    assert record.viewing_times == ["t1", "f"] and record.visit_count == "12"
    assert record.listed_date == date(2025, 11, 9) and record.days_on_market == "11"


@pytest.mark.parametrize(
    "page, url, reason",
    [
        ("<html></html>", SITE + "salda/a-1", "no_listing_data"),
        (html(listing()).replace("}", ""), SITE + "salda/a-1", "no_listing_data"),
        (html({"A": {"__typename": "Query"}}), SITE + "salda/a-1", "no_listing_data"),
        (html(listing()), SITE + "x/a-1", "unknown_listing_type"),
    ],
)
def test_failures_keep_their_reason(extract, page, url, reason):
    assert extract(page, url).extract_error == reason


def test_positions(extract):
    inner = listing(coordinate={"latitude": 1.5, "longitude": 2.5})
    got = lambda requests: (lambda r: (r.latitude, r.longitude))(extract(html(inner), requests=requests))
    assert got(None) == ("1.5", "2.5")
    assert got([("https://m/x", "POST", "[[null,null,55.5948,13.0011]]")]) == ("55.5948", "13.0011")
    assert got([("https://m/none", "GET", None), ("https://m/?lat=55.1&lng=13.2", "GET", None)]) == ("55.1", "13.2")


LOCATIONS = [
    (["Möllevången", "Malmö Centrum/Hamnen", "Malmö", "Folkets Park"], "Folkets Park", "Malmö"),
    (["Limhamn", "Västra Malmö", "Malmö", "Sibbarp"], "Limhamn", "Malmö"),
    (["Almvik", "Högaholm", "Södra Malmö", "Malmö"], "Högaholm", "Malmö"),
    (["Aa", "Bb", "Cc kommun", "D län"], None, "Aa"),
    (["A/b", "Long name"], None, "Long name"),
    (["X kommun"], None, None),
]


@pytest.mark.parametrize("names, area, city", LOCATIONS)
def test_city_choice(spark, names, area, city):
    df = spark.createDataFrame([(names, area)], "n array<string>, a string")
    assert df.select(pages.choose_city(F.col("n"), F.col("a"))).first()[0] == city


def test_city_falls_back_to_location_name(extract):
    assert extract(html(listing(locationName="Limhamn, Malmö kommun"))).city == "Malmö"
    assert extract(html(listing(locationName="Malmö kommun"))).city is None


def test_extracted_page_becomes_a_valid_record(spark):
    page = html(
        listing(
            streetAddress="Strandvägen 3",
            numberOfRooms=2.5,
            livingArea=64,
            askingPrice={"__typename": "Money", "amount": 1600000},
            soldPrice={"__typename": "Money", "amount": 1520000},
            soldAt="1762646400",
        )
    )
    df = spark.createDataFrame([(1, SITE + "salda/a-1", page)], "page_id long, url string, html string")
    record = quality.validate(pages.extract_records(df, CAPTURED, AS_OF), SITE).first()
    assert record.errors == [] and record.price_change == -80000
    assert record.price_per_sqm_final == 23750.0
    assert record.price_change_pct == pytest.approx(-5.0)


def test_script_text_is_the_shortest_after_the_first_opening(spark):
    opening, close = '<script id="__NEXT_DATA__" type="application/json">', "</script>"
    bodies = ["{}", "", "<", "a<b</scripty>c\nå", "x" * 50_000, "<" * 50_000, close + "x", opening + "y", " "]
    htmls = [f"<p>{opening}{b}{close}tail{close}" for b in bodies] + [opening + "never closed", "no script", opening + close, None]
    old = re.compile(r'<script id="__NEXT_DATA__" type="application/json">(.+?)</script>', re.S)
    wanted = [(m[1] if (m := old.search(h)) else None) if h else None for h in htmls]
    df = spark.createDataFrame(list(enumerate(htmls)), "i int, html string")
    got = df.select("i", pages.embedded_json(F.col("html")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == wanted


def test_usable_by_key_or_plain_text_agrees_with_the_written_json(spark):
    values = ['null', 'false', 'true', '""', '"0"', '"false"', '"{}"', '"null"', '" "', '"-"', '"."', '{}', '[]', '{ }', '[ ]', '0', '-0', '0.0',
              '0.000', '-0.0e0', '0e5', '1e-9', '10', '0.5', '-3', '"0.0"', '"+0"', '[0]', '{"a":0}', '{"__typename":null}', '{"__ref":""}',
              '{"__typename":"Money","amount":0}', '"x\\ny"', '"\\n"', '1e400', '"1e5"', None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").withColumn("v", F.try_parse_json("t"))
    written = F.when(~F.rlike(F.to_json("v"), F.lit(EMPTY_JSON)), F.to_json("v"))
    got = df.select("t", F.to_json(usable(F.col("v"))).alias("now"), written.alias("before")).collect()
    assert [(r.t, r.now) for r in got] == [(r.t, r.before) for r in got]


def test_page_queries_open_only_the_keys_they_read(spark):
    rows = pages.with_listing_fields(spark.sql("""SELECT try_parse_json('{"coordinate":{"latitude":1.5},"area":"x"}') AS main"""), pages.POSITION_KEYS)
    assert rows.schema["f"].dataType.names == list(pages.POSITION_KEYS)
    assert rows.select(pages.object_position(F.col("f"))["latitude"]).first()[0] == 1.5
