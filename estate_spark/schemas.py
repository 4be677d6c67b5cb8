"""Record schemas. Only the four identifier fields are required."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _DBL, _INT, _BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

BASE_FIELDS = {
    "property_id": _STR,
    "property_type": _STR,
    "url": _STR,
    "scraped_at": T.TimestampNTZType(),
    "address": _STR,
    "city": _STR,
    "neighborhood": _STR,
    "latitude": _DBL,
    "longitude": _DBL,
    "housing_type": _STR,
    "ownership_type": _STR,
    "rooms": _DBL,
    "living_area": _DBL,
    "lot_area": _DBL,
    "floor": _STR,
    "has_elevator": _BOOL,
    "has_balcony": _BOOL,
    "building_year": _INT,
    "energy_class": _STR,
    "association_name": _STR,
    "association_fee": _INT,
    "operating_cost": _INT,
    "description": _STR,
}

SOLD_FIELDS = {
    "asking_price": _INT,
    "final_price": _INT,
    "price_change": _INT,
    "price_change_pct": _DBL,
    "price_per_sqm_final": _DBL,
    "sold_date": T.DateType(),
    "days_on_market": _INT,
    "visit_count": _INT,
}

FOR_SALE_FIELDS = {
    "asking_price": _INT,
    "price_per_sqm": _DBL,
    "listed_date": T.DateType(),
    "days_on_market": _INT,
    "viewing_times": T.ArrayType(_STR),
    "visit_count": _INT,
}

REQUIRED = ("property_id", "property_type", "url")


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in REQUIRED) for n, t in fields.items()])


BASE = _struct(BASE_FIELDS)
SOLD = _struct({**BASE_FIELDS, **SOLD_FIELDS})
FOR_SALE = _struct({**BASE_FIELDS, **FOR_SALE_FIELDS})
ANY_RECORD_FIELDS = {**BASE_FIELDS, **SOLD_FIELDS, **FOR_SALE_FIELDS}

SALES_HISTORY_FIELDS = {
    "final_price": _DBL,
    "location": _STR,
    "ownership_form": _STR,
    "number_of_rooms": _DBL,
    "living_area": _DBL,
    "balcony": _DBL,
    "year_of_construction": _DBL,
    "fee": _DBL,
    "operational_cost": _DBL,
    "leasehold_fee": _DBL,
    "housing_association": _STR,
    "sale_year": _INT,
    "sale_month": _INT,
    "sale_day": _INT,
    "floor_number": _DBL,
    "top_floor_number": _DBL,
    "elevator_presence": _DBL,
    "latitude": _DBL,
    "longitude": _DBL,
}


def all_text(names) -> T.StructType:
    return T.StructType([T.StructField(n, _STR, True) for n in names])


ACTIVE_LINKS = all_text(["url", "property_id", "found_at"])
MONTH_LINKS = all_text(["property_id", "url", "sold_month", "scraped_at"])
AREA_LINKS = all_text(["property_id", "url", "area_range", "scraped_at"])
REQUESTS = "array<struct<url:string,method:string,postData:string>>"
RUN_INDEX = (
    "run_id string, timestamp string, source_csv string, `offset` long, max_records long, "
    "batch_size long, processed long, successful long, failed long, output_path string, artifact_url string"
)
