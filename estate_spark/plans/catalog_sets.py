"""Registered queries: dedup, set work, incremental selection, samples (C1-C3, D11, D13, E4-E6, G, J1, S1)."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import functions as F

from estate_spark.operators import incremental, ledger, links, ranges
from estate_spark.plans.catalog_market import RANGE_CHAIN
from estate_spark.plans.registry import VIEW_SQL, query, scratch
from estate_spark.sources import files, views

# a sale seen under its listing key: several rows per key, one month label each
VIEW_SQL["monthly"] = "SELECT listing_key AS property_id, property_id AS url, strftime(sold_date, '%Y-%m') AS sold_month FROM sales"
M = ("sales", "monthly")


def monthly(spark, sf):
    return views.sales(spark, sf).select(
        F.col("listing_key").alias("property_id"),
        F.col("property_id").alias("url"),
        F.date_format("sold_date", "yyyy-MM").alias("sold_month"),
    )


@query(
    "j1_first_per_id",
    """SELECT property_id, url, sold_month FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY sold_month, url) AS rn
       FROM monthly) WHERE rn = 1""",
    *M,
)
def _(spark, sf):
    return links.first_per(monthly(spark, sf), "property_id", "sold_month", "url")


@query(
    "g1_merged_links",
    """WITH a AS (SELECT href AS url, page_id, 0 AS list FROM links WHERE page_id % 2 = 1
                  UNION ALL SELECT href, page_id, 1 FROM links WHERE page_id % 2 = 0)
       SELECT url, page_id AS property_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY list, page_id) AS rn FROM a) WHERE rn = 1""",
    "links",
)
def _(spark, sf):
    rows = views.links(spark, sf).select(F.col("href").alias("url"), F.col("page_id").alias("property_id"))
    odd, even = rows.filter("property_id % 2 = 1"), rows.filter("property_id % 2 = 0")
    return links.merge_links([odd, even], ["property_id"])


@query(
    "g2_consolidated",
    """SELECT property_id, url, file_name FROM (SELECT property_id, url, concat('properties_', sold_month, '.csv') AS file_name,
       row_number() OVER (PARTITION BY property_id ORDER BY sold_month, url) AS rn FROM monthly) WHERE rn = 1""",
    *M,
)
def _(spark, sf):
    named = monthly(spark, sf).withColumn("file_name", F.format_string("properties_%s.csv", "sold_month"))
    rows = named.withColumn("scraped_at", F.lit("2025-11-15"))
    return links.consolidate(rows).select("property_id", "url", "file_name")


@query(
    "g3_same_ids",
    """WITH l AS (SELECT DISTINCT property_id FROM monthly WHERE sold_month < '1998-01'),
            r AS (SELECT DISTINCT property_id FROM monthly WHERE sold_month >= '1998-01')
       SELECT CAST((SELECT count(*) FROM l WHERE property_id NOT IN (SELECT property_id FROM r)) AS BIGINT) AS only_left,
              CAST((SELECT count(*) FROM r WHERE property_id NOT IN (SELECT property_id FROM l)) AS BIGINT) AS only_right, false AS same""",
    *M,
)
def _(spark, sf):
    rows = monthly(spark, sf)
    return links.same_ids(rows.filter("sold_month < '1998-01'"), rows.filter("sold_month >= '1998-01'"))


@query("g4_distinct_links", "SELECT DISTINCT href AS url FROM links", "links")
def _(spark, sf):
    return links.distinct_links(views.links(spark, sf).withColumnRenamed("href", "url"))


@query(
    "g5_ids_in_many_months",
    """SELECT property_id, CAST(count(DISTINCT sold_month) AS BIGINT) AS n_parts, min(sold_month) AS first_part,
              max(sold_month) AS last_part FROM monthly GROUP BY 1 HAVING count(DISTINCT sold_month) > 1""",
    *M,
)
def _(spark, sf):
    return links.ids_in_many(monthly(spark, sf))


@query(
    "g5_month_overlap",
    """WITH d AS (SELECT DISTINCT property_id, sold_month FROM monthly)
       SELECT a.sold_month AS part_a, b.sold_month AS part_b, CAST(count(*) AS BIGINT) AS shared_ids
       FROM d a JOIN d b ON a.property_id = b.property_id AND a.sold_month < b.sold_month GROUP BY 1, 2""",
    *M,
)
def _(spark, sf):
    return links.partition_overlap(monthly(spark, sf))


@query("d13_unique_ids", "SELECT CAST(count(DISTINCT property_id) AS BIGINT) AS unique_ids FROM monthly", *M)
def _(spark, sf):
    return monthly(spark, sf).agg(F.countDistinct("property_id").alias("unique_ids"))


@query(
    "d11_links_per_month",
    """SELECT sold_month AS month, CAST(count(*) AS BIGINT) AS n_links, CAST((SELECT count(*) FROM monthly) AS BIGINT) AS total_links
       FROM monthly GROUP BY 1""",
    *M,
)
def _(spark, sf):
    named = monthly(spark, sf).withColumn("file_name", F.format_string("sold_links_%s.csv", "sold_month"))
    return files.links_per_file(files.month_of_file(named))


PROCESSED_SQL = "SELECT DISTINCT sha256(href) AS fingerprint FROM links WHERE page_id % 3 = 0"


def link_rows(spark, sf):
    """Every fifth row carries its identifier as URL only, every seventh none at all."""
    rows = views.links(spark, sf)
    return rows.select(
        "page_id",
        "pos",
        F.when(F.col("page_id") % 5 != 0, F.col("href")).alias("property_id"),
        F.when(F.col("page_id") % 7 != 0, F.col("href")).alias("url"),
    )


def processed(spark, sf):
    return views.links(spark, sf).filter("page_id % 3 = 0").select(F.sha2("href", 256).alias("fingerprint")).distinct()


# with a dash in the link and no id, the id part of the URL is the identifier
_IDENT = """CASE WHEN page_id % 5 <> 0 THEN href WHEN page_id % 7 = 0 THEN NULL
            WHEN contains(href, '-') THEN split_part(rtrim(href, '/'), '-', -1) ELSE href END"""


@query(
    "c1_not_processed",
    f"""WITH p AS ({PROCESSED_SQL}), r AS (SELECT page_id, pos, {_IDENT} AS ident FROM links)
        SELECT page_id, pos FROM r WHERE ident IS NULL OR sha256(ident) NOT IN (SELECT fingerprint FROM p)""",
    "links",
)
def _(spark, sf):
    rows = incremental.with_fingerprint(link_rows(spark, sf))
    return incremental.not_processed(rows, processed(spark, sf)).select("page_id", "pos")


@query(
    "s1_new_fingerprints",
    f"""WITH p AS ({PROCESSED_SQL}), r AS (SELECT {_IDENT} AS ident FROM links)
        SELECT DISTINCT sha256(ident) AS fingerprint FROM r WHERE ident IS NOT NULL
          AND sha256(ident) NOT IN (SELECT fingerprint FROM p)""",
    "links",
)
def _(spark, sf):
    rows = incremental.with_fingerprint(link_rows(spark, sf))
    return incremental.new_fingerprints(rows, processed(spark, sf))


@query(
    "c2_months_to_do",
    """SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2010-12-01', INTERVAL 1 MONTH)) AS m)
       WHERE strftime(m, '%Y-%m') NOT IN (SELECT strftime(sold_date, '%Y-%m') FROM sales WHERE number_of_rooms = 1)""",
    "sales",
)
def _(spark, sf):
    done = (
        views.sales(spark, sf)
        .filter("number_of_rooms = 1")
        .select(F.date_format("sold_date", "yyyy-MM").alias("month"))
        .distinct()
    )
    return incremental.months_to_do(spark, date(1990, 1, 1), date(2010, 12, 1), done).select("month")


@query(
    "c3_ranges_to_do",
    f"WITH {RANGE_CHAIN} SELECT CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM rng WHERE NOT lo < 40",
    "sales",
    recursive=True,
)
def _(spark, sf):
    planned = ranges.density_ranges(ranges.unit_histogram(views.sales(spark, sf)))
    return incremental.ranges_to_do(planned, planned.filter("lo < 40")).select("lo", "hi")


EARLY_CHAIN = re.sub(r"\b(h|cum|nxt|chain|rng)\b", r"early_\1", RANGE_CHAIN).replace("FROM sales", "FROM sales WHERE sale_year < 1996")


@query(
    "c3_ledger",
    f"""WITH {EARLY_CHAIN}, {RANGE_CHAIN},
             done AS (SELECT lo, hi FROM early_rng WHERE lo < 60 OR lo BETWEEN 120 AND 199),
             todo AS (SELECT r.lo AS plan_lo, r.hi AS plan_hi, u FROM rng r JOIN (SELECT range AS u FROM range(0, 500)) ON u >= r.lo AND u < r.hi
                      WHERE NOT EXISTS (SELECT 1 FROM done WHERE u >= done.lo AND u < done.hi)),
             island AS (SELECT *, u - row_number() OVER (PARTITION BY plan_lo ORDER BY u) AS g FROM todo)
        SELECT CAST(min(u) AS INTEGER) AS lo, CAST(max(u) + 1 AS INTEGER) AS hi, CAST(plan_lo AS INTEGER) AS plan_lo, CAST(plan_hi AS INTEGER) AS plan_hi
        FROM island GROUP BY plan_lo, plan_hi, g""",
    "sales",
    recursive=True,
)
def _(spark, sf):
    """Ranges completed on early data, by two runs, against a chain cut anew on all data."""
    sales, path = views.sales(spark, sf), scratch(spark, "ledger")
    early = ranges.density_ranges(ranges.unit_histogram(sales.filter("sale_year < 1996")))
    for run_id, done in (("run-1", early.filter("lo < 60")), ("run-2", early.filter("lo BETWEEN 120 AND 199")), ("run-2", early.filter("lo = 0"))):
        ledger.record_completed(done, path, "areas", run_id, datetime(2025, 11, 15))
    planned = ranges.density_ranges(ranges.unit_histogram(sales))
    return ledger.uncovered(planned, ledger.read_ledger(spark, path, "areas"))


@query(
    "c3_covered",
    f"""WITH {EARLY_CHAIN}, done AS (SELECT lo, hi FROM early_rng WHERE lo < 60 OR lo BETWEEN 120 AND 199),
             unit AS (SELECT u FROM (SELECT range AS u FROM range(0, 500)) WHERE EXISTS (SELECT 1 FROM done WHERE u >= lo AND u < hi)),
             island AS (SELECT u, u - row_number() OVER (ORDER BY u) AS g FROM unit)
        SELECT CAST(min(u) AS INTEGER) AS lo, CAST(max(u) + 1 AS INTEGER) AS hi FROM island GROUP BY g""",
    "sales",
    recursive=True,
)
def _(spark, sf):
    early = ranges.density_ranges(ranges.unit_histogram(views.sales(spark, sf).filter("sale_year < 1996")))
    return ledger.covered(early.filter("lo < 60").unionByName(early.filter("lo BETWEEN 120 AND 199")))


@query(
    "c2_month_ledger",
    """WITH m AS (SELECT DISTINCT date_trunc('month', sold_date)::DATE AS m, number_of_rooms = 1 AS whole FROM sales WHERE number_of_rooms <= 2),
            done AS (SELECT m AS lo, (CASE WHEN whole THEN m + INTERVAL 1 MONTH ELSE m + INTERVAL 12 DAY END)::DATE AS hi FROM m),
            day AS (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2010-12-31', INTERVAL 1 DAY))::DATE AS d),
            left_ AS (SELECT d FROM day WHERE NOT EXISTS (SELECT 1 FROM done WHERE d >= lo AND d < hi)),
            island AS (SELECT d, strftime(d, '%Y-%m') AS month, d - CAST(row_number() OVER (PARTITION BY strftime(d, '%Y-%m') ORDER BY d) AS INTEGER) AS g FROM left_)
       SELECT month, min(d) AS lo, (max(d) + INTERVAL 1 DAY)::DATE AS hi FROM island GROUP BY month, g""",
    "sales",
)
def _(spark, sf):
    """Whole months completed by one run, the first twelve days of others by the next."""
    sales, path = views.sales(spark, sf), scratch(spark, "ledger")
    first = F.trunc("sold_date", "month")
    for run_id, rooms, end in (("run-1", 1, F.add_months("lo", 1)), ("run-2", 2, F.date_add("lo", 12))):
        months = sales.filter(F.col("number_of_rooms") == rooms).groupBy(first.alias("lo")).agg(F.count("*").alias("n_rows"))
        ledger.record_completed(months.withColumn("hi", end), path, "sold", run_id, datetime(2025, 11, 15))
    return ledger.months_left(spark, date(1990, 1, 1), date(2010, 12, 1), ledger.read_ledger(spark, path, "sold", "date"))


_ORDERED = """o AS (SELECT page_id, pos, href, row_number() OVER (ORDER BY page_id, pos) - 1 AS row_index FROM links)"""


@query(
    "e4_slice",
    f"""WITH p AS ({PROCESSED_SQL}), {_ORDERED},
        r AS (SELECT * FROM o WHERE row_index >= 100 AND sha256(href) NOT IN (SELECT fingerprint FROM p) ORDER BY row_index LIMIT 150)
        SELECT page_id, pos, CAST(row_index AS BIGINT) AS row_index FROM r""",
    "links",
)
def _(spark, sf):
    rows = views.links(spark, sf).select("page_id", "pos", F.col("href").alias("property_id"))
    return incremental.slice_rows(rows, ["page_id", "pos"], processed(spark, sf), 100, 150).select(
        "page_id", "pos", "row_index"
    )


@query(
    "e4_slice_counts",
    f"""WITH p AS ({PROCESSED_SQL})
        SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE page_id % 2 = 0) AS BIGINT) AS written,
               CAST(count(*) FILTER (WHERE sha256(href) IN (SELECT fingerprint FROM p)) AS BIGINT) AS already_processed FROM links""",
    "links",
)
def _(spark, sf):
    rows = views.links(spark, sf).select("page_id", F.col("href").alias("property_id"))
    return incremental.slice_counts(rows, processed(spark, sf), rows.filter("page_id % 2 = 0"))


@query(
    "e5_batches",
    """SELECT property_id, CAST((row_number() OVER (ORDER BY sold_date, property_id) - 1) // 1000 AS BIGINT) AS batch_id FROM sales""",
    "sales",
)
def _(spark, sf):
    rows = views.sales(spark, sf).select("property_id", "sold_date")
    return incremental.with_batches(rows, ["sold_date", "property_id"], 1000).select("property_id", "batch_id")


@query(
    "e5_batches_between",
    """SELECT property_id, batch_id FROM (SELECT property_id, CAST((row_number() OVER (ORDER BY sold_date, property_id) - 1) // 1000 AS BIGINT)
       AS batch_id FROM sales) WHERE batch_id >= 2 AND batch_id < 5""",
    "sales",
)
def _(spark, sf):
    rows = views.sales(spark, sf).select("property_id", "sold_date")
    batched = incremental.with_batches(rows, ["sold_date", "property_id"], 1000)
    return incremental.batches_between(batched, 2, 5).select("property_id", "batch_id")


@query(
    "e6_exact_sample",
    "SELECT property_id, final_price FROM sales ORDER BY md5(concat('42|', property_id)), property_id LIMIT 5000",
    "sales",
)
def _(spark, sf):
    return incremental.exact_sample(views.sales(spark, sf), 5000, ["property_id"]).select("property_id", "final_price")
