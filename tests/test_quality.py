"""Validation bounds, typing and reports."""

from datetime import datetime

import pytest

from estate_spark.operators import quality

SITE = "https://homes.example/"
GOOD = {
    "property_id": "p-77",
    "property_type": "sold",
    "url": SITE + "salda/villa-77",
    "latitude": "59.25",
    "longitude": "17.75",
    "rooms": "3.5",
    "living_area": "64.0",
    "building_year": "1987",
    "association_fee": "3210",
    "asking_price": "1600000",
    "final_price": "1680000",
    "sold_date": "2024-08-03",
    "days_on_market": "23",
    "visit_count": None,
    "lot_area": None,
    "has_balcony": "yes",
}


@pytest.fixture
def check(spark):
    def run(**changes):
        row = {**GOOD, **changes}
        schema = ", ".join(f"{n} string" for n in row)
        return quality.validate(spark.createDataFrame([tuple(row.values())], schema), SITE).first()

    return run


def test_good_record(check):
    r = check()
    assert r.errors == [] and r.has_balcony is True
    assert r.price_change == 80_000 and r.price_change_pct == pytest.approx(5.0)
    assert r.price_per_sqm_final == 26250.0 and r.price_per_sqm is None


@pytest.mark.parametrize(
    "changes, codes",
    [
        ({"property_id": " \t"}, ["property_id_blank"]),
        ({"property_id": None}, ["property_id_blank"]),
        ({"url": "http://other/"}, ["url_prefix"]),
        ({"property_type": "rented"}, ["property_type_unknown"]),
        ({"latitude": "90.5"}, ["latitude_range"]),
        ({"longitude": "-180.5"}, ["longitude_range"]),
        ({"rooms": "20.5"}, ["rooms_range"]),
        ({"rooms": "-0.5"}, ["rooms_range"]),
        ({"living_area": "0"}, ["living_area_range"]),
        ({"living_area": "9.99"}, ["living_area_range"]),
        ({"living_area": "1000.5"}, ["living_area_range"]),
        ({"lot_area": "-1"}, ["lot_area_negative"]),
        ({"association_fee": "-1"}, ["association_fee_negative"]),
        ({"building_year": "1799"}, ["building_year_range"]),
        ({"building_year": "2031"}, ["building_year_range"]),
        ({"final_price": "99999"}, ["final_price_range"]),
        ({"asking_price": "50000001"}, ["asking_price_range"]),
        ({"days_on_market": "-1"}, ["days_on_market_negative"]),
        ({"visit_count": "many"}, ["visit_count_type"]),
        ({"visit_count": "3.5"}, ["visit_count_type"]),
        ({"sold_date": "yesterday"}, ["sold_date_type"]),
        ({"has_balcony": "perhaps"}, ["has_balcony_type"]),
        ({"rooms": "x", "living_area": "5"}, ["living_area_range", "rooms_type"]),
    ],
)
def test_broken_rules(check, changes, codes):
    assert check(**changes).errors == codes


@pytest.mark.parametrize(
    "changes",
    [
        {"rooms": "20"},
        {"living_area": "10"},
        {"living_area": "1000"},
        {"building_year": "1800"},
        {"final_price": "100000"},
        {"asking_price": "50000000"},
        {"rooms": None, "living_area": None, "asking_price": None, "final_price": None},
        {"visit_count": "300.0"},
    ],
)
def test_bounds_are_inclusive_and_nulls_pass(check, changes):
    assert check(**changes).errors == []


def test_near_zero_position_is_cleared_after_the_rules(check):
    r = check(latitude="0.0005", longitude="-0.0")
    assert r.errors == [] and r.latitude is None and r.longitude is None


def test_for_sale_metrics(check):
    r = check(property_type="for_sale", final_price=None)
    assert r.price_per_sqm == 25000.0 and r.price_change is None


def test_missing_operands_give_no_metrics(check):
    r = check(living_area=None, asking_price=None)
    assert r.price_change is None and r.price_change_pct is None and r.price_per_sqm_final is None


def test_field_presence_and_classes(rows):
    df = rows([(1, 1, 1, None)] + [(2, 2, None, None)] * 1 + [(3, 3, None, None)] * 3, "a int, b int, c int, d int")
    got = {r.field: (r.n_present, r.presence) for r in quality.field_presence(df, ["a", "c", "d"]).collect()}
    assert got == {"a": (5, "always"), "c": (1, "rarely"), "d": (0, "rarely")}


@pytest.mark.parametrize("good, verdict", [(20, "passed"), (17, "partial"), (10, "failed")])
def test_run_summary(rows, good, verdict):
    data = [(i < good, "sold", "sold" if i else None, float(i), 50.0) for i in range(20)]
    df = rows(data, "success boolean, property_type string, expected_type string, elapsed_seconds double, completeness_pct double")
    r = quality.run_summary(df).first()
    assert (r.total, r.successful, r.failed, r.verdict) == (20, good, 20 - good, verdict)
    assert r.type_matches == good - 1 and r.max_time_seconds == good - 1
