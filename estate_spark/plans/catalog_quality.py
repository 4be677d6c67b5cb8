"""Registered queries: validation rules and data-quality reports (V, D6-D10, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.operators import incremental, quality
from estate_spark.plans import derived
from estate_spark.plans.registry import query
from estate_spark.sources import views

R = ("sales", "raw", "checked")


def checked(spark, sf):
    return quality.check_records(quality.type_records(derived.raw_records(spark, sf)), derived.SITE)


@query("v_record_errors", "SELECT property_id AS source_id, errors FROM checked", *R)
def record_errors(spark, sf):
    return checked(spark, sf).select("source_id", F.array_join("errors", ";").alias("errors"))


@query(
    "v_rule_counts",
    """SELECT rule, CAST(count(*) AS BIGINT) AS n_records FROM (SELECT unnest(string_split(errors, ';')) AS rule FROM checked)
       WHERE rule <> '' GROUP BY 1""",
    *R,
)
def _(spark, sf):
    return quality.rule_counts(checked(spark, sf))


def _rule_query(name, code, condition):
    @query(f"{name}_{code}", f"SELECT property_id AS source_id FROM raw WHERE {condition}", "sales", "raw")
    def _(spark, sf):
        return checked(spark, sf).filter(F.array_contains("errors", code)).select("source_id")


for _name, (_code, _condition) in derived.RULES.items():
    _rule_query(_name, _code, _condition)


FIELDS = ("property_id", "latitude", "rooms", "lot_area", "visit_count", "final_price", "sold_date", "listed_date", "energy_class")
# what typing leaves of each field
PRESENT_SQL = {
    "property_id": "true",
    "latitude": "true",
    "rooms": "true",
    "lot_area": "asking_price % 73 = 0",
    "visit_count": "asking_price % 61 <> 0 AND asking_price % 59 <> 0 AND asking_price % 53 = 0",
    "final_price": "sale_year % 2 = 0",
    "sold_date": "sale_year % 2 = 0",
    "listed_date": "sale_year % 2 <> 0",
    "energy_class": "false",
}


def typed(spark, sf):
    return quality.type_records(derived.raw_records(spark, sf))


_PRESENCE = " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS n_present, count(*) AS total FROM raw"
    for f, c in PRESENT_SQL.items()
)


@query(
    "d6_field_presence",
    f"SELECT field, n_present, n_present / total * 100 AS rate FROM ({_PRESENCE})",
    "sales",
    "raw",
)
def _(spark, sf):
    return quality.field_presence(typed(spark, sf), FIELDS).drop("presence")


@query(
    "d7_presence_class",
    f"""SELECT field, CASE WHEN n_present = total THEN 'always' WHEN n_present / total >= 0.8 THEN 'usually'
        WHEN n_present / total >= 0.3 THEN 'sometimes' ELSE 'rarely' END AS presence FROM ({_PRESENCE})""",
    "sales",
    "raw",
)
def _(spark, sf):
    return quality.field_presence(typed(spark, sf), FIELDS).select("field", "presence")


@query("d8_type_distribution", "SELECT kind AS property_type, CAST(count(*) AS BIGINT) AS n FROM raw GROUP BY 1", "sales", "raw")
def _(spark, sf):
    return quality.distribution(derived.raw_records(spark, sf), "property_type", "unknown")


@query(
    "d8_error_distribution",
    "SELECT errors AS error, CAST(count(*) AS BIGINT) AS n FROM checked WHERE errors <> '' GROUP BY 1",
    *R,
)
def _(spark, sf):
    return quality.distribution(quality.rejects(checked(spark, sf)), "error", "Unknown error")


_FILLED = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in PRESENT_SQL.values())


@query(
    "d9_completeness",
    f"SELECT property_id AS source_id, CAST({_FILLED} AS INTEGER) AS fields_present, ({_FILLED}) / 9 * 100 AS completeness_pct FROM raw",
    "sales",
    "raw",
)
def _(spark, sf):
    return quality.with_completeness(typed(spark, sf), FIELDS).select("source_id", "fields_present", "completeness_pct")


def results(spark, sf):
    s = views.sales(spark, sf)
    return s.select(
        "neighborhood",
        (F.col("final_price") > 200000).alias("success"),
        F.when(F.col("sale_year") % 2 == 0, "sold").otherwise("for_sale").alias("property_type"),
        F.when(F.col("number_of_rooms") == 7, "sold").when(F.col("sale_year") % 2 == 0, "sold").otherwise("for_sale").alias("expected_type"),
        F.col("living_area").alias("elapsed_seconds"),
        (F.col("number_of_rooms") * 10).cast("double").alias("completeness_pct"),
    )


@query(
    "d10_run_summary",
    """WITH r AS (SELECT final_price > 200000 AS ok, sale_year % 2 = 0 OR number_of_rooms < 7 AS matched, living_area AS t,
                  number_of_rooms * 10 AS c FROM sales),
       a AS (SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE ok AND matched) AS m,
                    avg(t) FILTER (WHERE ok) AS av, min(t) FILTER (WHERE ok) AS mn, max(t) FILTER (WHERE ok) AS mx,
                    sum(t) FILTER (WHERE ok) AS sm, avg(c) FILTER (WHERE ok) AS cp FROM r)
       SELECT CAST(total AS BIGINT) AS total, CAST(good AS BIGINT) AS successful, CAST(m AS BIGINT) AS type_matches,
              av AS avg_time_seconds, mn AS min_time_seconds, mx AS max_time_seconds, sm AS total_time_seconds,
              cp AS avg_completeness_pct, CAST(total - good AS BIGINT) AS failed, good / total * 100 AS success_rate,
              m / good * 100 AS type_match_rate,
              CASE WHEN good / total >= 0.95 THEN 'passed' WHEN good / total >= 0.8 THEN 'partial' ELSE 'failed' END AS verdict FROM a""",
    "sales",
)
def _(spark, sf):
    return quality.run_summary(results(spark, sf))


@query(
    "a11_batch_metrics",
    """SELECT neighborhood, CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE final_price > 200000) AS BIGINT) AS successful,
              CAST(count(*) FILTER (WHERE final_price <= 200000) AS BIGINT) AS failed,
              count(*) FILTER (WHERE final_price > 200000) / count(*) * 100 AS success_rate FROM sales GROUP BY 1""",
    "sales",
)
def _(spark, sf):
    return incremental.batch_metrics(results(spark, sf), ["neighborhood"])


@query(
    "v_valid_records",
    """SELECT trim(property_id) AS property_id, kind AS property_type,
              CASE WHEN kind = 'sold' THEN final_price - asking_price END AS price_change,
              CASE WHEN kind = 'for_sale' THEN asking_price / living_area END AS price_per_sqm FROM checked WHERE errors = ''""",
    *R,
)
def _(spark, sf):
    return quality.valid(quality.finish_records(checked(spark, sf))).select(
        "property_id", "property_type", "price_change", "price_per_sqm"
    )
