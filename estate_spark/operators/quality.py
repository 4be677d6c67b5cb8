"""Typed records, validation rules with reject codes, and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estate_spark import schemas
from estate_spark.session import computed_once
from estate_spark.functions.text import strip
from estate_spark.operators.clean import real_coordinate, with_asking_per_sqm, with_sold_metrics

# Bounds of plausible records, both ends included.
LATITUDE = (-90, 90)
LONGITUDE = (-180, 180)
ROOMS = (0, 20)
LIVING_AREA = (10, 1000)
BUILDING_YEAR = (1800, 2030)
PRICE = (100_000, 50_000_000)
NOT_NEGATIVE = (
    "lot_area",
    "association_fee",
    "operating_cost",
    "days_on_market",
    "visit_count",
    "price_per_sqm",
    "price_per_sqm_final",
)
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


def typed(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Value in the declared type, or null when it cannot be one. Whole numbers refuse fractions."""
    if isinstance(target, T.StringType):
        return strip(c.cast("string"))
    if source == target or isinstance(target, T.ArrayType):
        return c
    # casts from text ignore surrounding blanks by themselves
    if isinstance(target, T.LongType):
        if not isinstance(source, T.StringType):
            number = c.try_cast("double")
            return F.when(number == F.floor(number), c).try_cast("long")
        # digits after the point count however small, so the text decides, not a rounded number
        fraction = F.regexp_extract(F.trim(c), r"^[+-]?\d*\.(\d*)$", 1)
        plain = F.when(F.rlike(fraction, F.lit(r"^0*$")), F.trim(c)).try_cast("decimal(38,6)").try_cast("long")
        number = F.when(F.contains(F.lower(c), F.lit("e")), c).try_cast("double")
        return F.coalesce(c.try_cast("long"), plain, F.when(number == F.floor(number), number).try_cast("long"))
    if isinstance(target, T.BooleanType):
        word = F.lower(F.trim(c.cast("string")))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    return c.try_cast(target.simpleString())


def type_records(raw: DataFrame, fields: dict[str, T.DataType] | None = None) -> DataFrame:
    """All declared columns in their types, plus ``bad_types``: codes of columns whose text did not fit.

    Columns missing from the input become null; extra input columns are kept.
    """
    fields = fields or schemas.ANY_RECORD_FIELDS
    present = {f.name: f.dataType for f in raw.schema.fields}
    out, misfits = [], []
    for name, target in fields.items():
        if name not in present:
            out.append(F.lit(None).cast(target).alias(name))
            continue
        value = typed(F.col(name), present[name], target)
        out.append(value.alias(name))
        if present[name] != target:
            misfits.append(F.when(F.col(name).isNotNull() & value.isNull(), F.lit(f"{name}_type")))
    extra = [F.col(n) for n in present if n not in fields]
    return raw.select(*out, *extra, F.concat_ws(";", *misfits, F.lit(None)).alias("bad_types"))


def rules(site_prefix: str) -> dict[str, Column]:
    """Rule code to the condition under which a record breaks it. Null values pass all but the first three."""
    sold = F.col("property_type") == "sold"
    c = F.col
    outside = lambda name, bounds: ~c(name).between(*bounds)
    out = {
        "property_id_blank": c("property_id").isNull() | (strip(c("property_id")) == ""),
        "url_prefix": c("url").isNull() | ~F.startswith(c("url"), F.lit(site_prefix)),
        "property_type_unknown": c("property_type").isNull() | ~c("property_type").isin("sold", "for_sale"),
        "latitude_range": outside("latitude", LATITUDE),
        "longitude_range": outside("longitude", LONGITUDE),
        "rooms_range": outside("rooms", ROOMS),
        "living_area_range": outside("living_area", LIVING_AREA),
        "building_year_range": outside("building_year", BUILDING_YEAR),
        "final_price_range": sold & outside("final_price", PRICE),
        "asking_price_range": outside("asking_price", PRICE),
    }
    for name in NOT_NEGATIVE:
        out[f"{name}_negative"] = c(name) < 0
    return out


def check_records(typed_records: DataFrame, site_prefix: str) -> DataFrame:
    """Adds ``errors``: codes of all broken rules, in rule order, type misfits last.

    Codes are joined as text first, which skips nulls inside generated code;
    an array of conditions would have to be filtered by an interpreted lambda.
    """
    broken = [F.when(cond, F.lit(code)) for code, cond in rules(site_prefix).items()]
    text = F.concat_ws(";", *broken, F.nullif("bad_types", F.lit("")))
    joined = typed_records.withColumn("_errors", text)
    codes = F.when(F.col("_errors") == "", F.array().cast("array<string>")).otherwise(F.split("_errors", ";"))
    return computed_once(joined, "errors", codes).drop("bad_types", "_errors")


def finish_records(checked: DataFrame) -> DataFrame:
    """Coordinate clean-up and derived metrics; runs after the rules, as the bounds see raw positions."""
    located = checked.withColumns(
        {"latitude": real_coordinate(F.col("latitude")), "longitude": real_coordinate(F.col("longitude"))}
    )
    is_sold = F.col("property_type") == "sold"
    derived = with_asking_per_sqm(with_sold_metrics(located))
    sold_only = ("price_change", "price_change_pct", "price_per_sqm_final")
    return derived.withColumns(
        {
            **{n: F.when(is_sold, F.col(n)) for n in sold_only},
            "price_per_sqm": F.when(~is_sold, F.col("price_per_sqm")),
        }
    )


def validate(raw: DataFrame, site_prefix: str) -> DataFrame:
    """Typed, checked and completed records; ``errors`` is empty for valid ones."""
    return finish_records(check_records(type_records(raw), site_prefix))


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def rejects(checked: DataFrame, *keep: str) -> DataFrame:
    return checked.filter(F.size("errors") > 0).select(*keep, F.array_join("errors", ";").alias("error"))


def rule_counts(checked: DataFrame) -> DataFrame:
    """Records per broken rule.

    Equal code lists are counted before they are opened: few rows are exploded,
    and no filter on the list reaches below the count to repeat the checks.
    """
    lists = checked.groupBy("errors").agg(F.count("*").alias("n"))
    return lists.select(F.explode("errors").alias("rule"), "n").groupBy("rule").agg(F.sum("n").alias("n_records"))


def field_presence(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Non-null count, rate and class per column; one aggregation, then long form."""
    counts = df.agg(F.count("*").alias("_total"), *[F.count(c).alias(c) for c in fields])
    pairs = ", ".join(f"'{c}', `{c}`" for c in fields)
    long = counts.selectExpr("_total", f"stack({len(fields)}, {pairs}) as (field, n_present)")
    rated = long.select("field", "n_present", (F.col("n_present") / F.nullif("_total", F.lit(0)) * 100).alias("rate"))
    return rated.withColumn("presence", presence_class(F.col("rate")))


def presence_class(rate: Column) -> Column:
    return (
        F.when(rate == 100, F.lit("always"))
        .when(rate >= 80, F.lit("usually"))
        .when(rate >= 30, F.lit("sometimes"))
        .otherwise(F.lit("rarely"))
    )


def distribution(df: DataFrame, column: str, missing: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def with_completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of filled fields per row, in percent."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    return df.withColumns(
        {"fields_present": filled, "completeness_pct": filled / F.lit(len(fields)) * 100}
    )


def verdict(success_rate: Column) -> Column:
    return (
        F.when(success_rate >= 95, F.lit("passed"))
        .when(success_rate >= 80, F.lit("partial"))
        .otherwise(F.lit("failed"))
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Rates, timings and verdict over result rows.

    Expects ``success, property_type, expected_type, elapsed_seconds,
    completeness_pct``; timings and completeness look at successes only.
    """
    ok = F.col("success")
    on_success = lambda name: F.when(ok, F.col(name))
    matched = ok & F.equal_null("property_type", "expected_type")
    totals = results.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(matched).alias("type_matches"),
        F.avg(on_success("elapsed_seconds")).alias("avg_time_seconds"),
        F.min(on_success("elapsed_seconds")).alias("min_time_seconds"),
        F.max(on_success("elapsed_seconds")).alias("max_time_seconds"),
        F.sum(on_success("elapsed_seconds")).alias("total_time_seconds"),
        F.avg(on_success("completeness_pct")).alias("avg_completeness_pct"),
    )
    share = lambda part, whole: F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)) * 100, F.lit(0.0))
    return (
        totals.withColumn("failed", F.col("total") - F.col("successful"))
        .withColumn("success_rate", share("successful", "total"))
        .withColumn("type_match_rate", share("type_matches", "successful"))
        .withColumn("verdict", verdict(F.col("success_rate")))
    )
