"""Registered queries: readers and sinks, each written and read back (A), and the detail load (S2)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from estate_spark import schemas
from estate_spark.operators import quality
from estate_spark.plans import batch_load, derived, detail_load
from estate_spark.plans.catalog_quality import checked
from estate_spark.plans.registry import query, scratch
from estate_spark.session import materialise, staged
from estate_spark.sources import files, sinks, views
from estate_spark.sources.commits import CommitLog


def link_rows(spark, sf):
    """Links with every tenth page's first URL blank."""
    blank = (F.col("pos") == 0) & (F.col("page_id") % 10 == 0)
    return views.links(spark, sf).select(
        F.when(~blank, F.col("href")).alias("url"),
        F.concat_ws("-", "page_id", "pos").alias("property_id"),
        F.lit("2025-11-15T20:13:47").alias("found_at"),
    )


@query(
    "a1_link_csv",
    "SELECT href AS url, concat_ws('-', page_id, pos) AS property_id FROM links WHERE NOT (pos = 0 AND page_id % 10 = 0)",
    "links",
)
def _(spark, sf):
    path = scratch(spark, "links")
    link_rows(spark, sf).write.option("header", True).csv(path)
    return files.read_links(spark, path).select("url", "property_id")


@query(
    "a2_sales_history_csv",
    """SELECT CAST(final_price AS DOUBLE) AS final_price, location, CAST(number_of_rooms AS DOUBLE) AS number_of_rooms,
              CASE WHEN number_of_rooms <> 1 THEN living_area * 50 END AS fee, CAST(sale_year AS BIGINT) AS sale_year FROM sales""",
    "sales",
)
def _(spark, sf):
    path = scratch(spark, "history")
    s = views.sales(spark, sf).withColumn(
        "fee", F.when(F.col("number_of_rooms") == 1, "NA").otherwise((F.col("living_area") * 50).cast("string"))
    )
    present = set(s.columns)
    text = [
        (F.col(n) if n in present else F.lit("NA")).cast("string").alias(n) for n in schemas.SALES_HISTORY_FIELDS
    ]
    s.select(*text).write.option("header", True).csv(path)
    return files.read_sales_history(spark, path).select("final_price", "location", "number_of_rooms", "fee", "sale_year")


@query(
    "a3_range_files",
    """SELECT concat(CAST(floor(living_area / 50) * 50 AS INTEGER), '-', CAST(floor(living_area / 50) * 50 + 50 AS INTEGER)) AS area_range,
              CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT property_id) AS BIGINT) AS n_ids FROM sales GROUP BY 1""",
    "sales",
)
def _(spark, sf):
    path = scratch(spark, "ranges")
    low = (F.floor(F.col("living_area") / 50) * 50).cast("int")
    rows = views.sales(spark, sf).select(
        "property_id",
        F.col("property_id").alias("url"),
        F.concat_ws("-", low, low + 50).alias("area_range"),
        F.lit("2025-11-15").alias("scraped_at"),
    )
    parts = rows.withColumn("part", F.col("area_range"))
    parts.write.partitionBy("part").option("header", True).csv(path)
    read = files.read_range_files(spark, f"{path}/part=*/*.csv")
    return read.groupBy("area_range").agg(
        F.count("*").alias("n_rows"), F.countDistinct("property_id").alias("n_ids")
    )


@query(
    "a4_result_arrays",
    "SELECT href AS url, pos AS position FROM links WHERE pos < 3 AND page_id % 4 <> 0",
    "links",
)
def _(spark, sf):
    path = scratch(spark, "results")
    result = F.struct(F.col("href").alias("url"), (F.col("page_id") % 4 != 0).alias("success"), "pos")
    arrays = views.links(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(result), _by_pos).alias("r"))
    arrays.select(F.to_json("r")).write.text(path)
    return files.read_results(spark, path, "struct<url:string,success:boolean>", first=3, one_per_line=True).select(
        "url", "position"
    )


def _by_pos(a, b):
    return a["pos"] - b["pos"]


@query(
    "a5_run_index",
    """SELECT neighborhood AS run_id, CAST(count(*) AS BIGINT) AS processed,
              CAST(count(*) FILTER (WHERE final_price > 200000) AS BIGINT) AS successful FROM sales GROUP BY 1""",
    "sales",
)
def _(spark, sf):
    path = scratch(spark, "index")
    runs = views.sales(spark, sf).groupBy(F.col("neighborhood").alias("run_id")).agg(
        F.count("*").alias("processed"), F.count_if(F.col("final_price") > 200000).alias("successful")
    )
    sinks.write_json(runs, path)
    return files.read_run_index(spark, path).select("run_id", "processed", "successful")


@query(
    "a6_record_table",
    """SELECT kind AS property_type, 'run-1' AS run_id, CAST(count(*) AS BIGINT) AS n_records,
              CAST(sum(asking_price) AS BIGINT) AS total_asking FROM checked WHERE errors = '' GROUP BY 1""",
    "sales",
    "raw",
    "checked",
)
def _(spark, sf):
    path = scratch(spark, "records")
    sinks.write_records(materialise(quality.finish_records(checked(spark, sf))), path, "run-1")
    return files.read_records(spark, path).groupBy("property_type", "run_id").agg(
        F.count("*").alias("n_records"), F.sum("asking_price").alias("total_asking")
    )


@query(
    "a7_reject_table",
    """SELECT concat(CASE WHEN asking_price % 97 = 0 THEN 'http://elsewhere.example/' ELSE 'https://homes.example/' END, property_id) AS url,
              errors AS error FROM checked WHERE errors <> ''""",
    "sales",
    "raw",
    "checked",
)
def _(spark, sf):
    path = scratch(spark, "rejects")
    sinks.write_rejects(materialise(checked(spark, sf)), path, "run-1")
    return spark.read.parquet(path).select("url", "error")


@query("a8_unique_link_csv", "SELECT DISTINCT href AS url FROM links", "links")
def _(spark, sf):
    path = scratch(spark, "unique")
    rows = views.links(spark, sf).select(
        F.col("href").alias("url"), F.col("page_id").cast("string").alias("property_id"), F.col("pos").alias("found_at")
    )
    sinks.write_unique_links(rows, path)
    return spark.read.option("header", True).csv(path).select("url")


@query(
    "a9_csv_if_changed",
    """SELECT 'first' AS step, true AS wrote, CAST(count(DISTINCT page_id) AS BIGINT) AS n_ids FROM links
       UNION ALL SELECT 'same', false, CAST(count(DISTINCT page_id) AS BIGINT) FROM links
       UNION ALL SELECT 'fewer', true, CAST(count(DISTINCT page_id) FILTER (WHERE page_id % 2 = 0) AS BIGINT) FROM links""",
    "links",
)
def _(spark, sf):
    path = scratch(spark, "ids")
    ids = views.links(spark, sf).select(F.col("page_id").cast("string").alias("property_id")).distinct()
    steps = []
    for step, rows in (("first", ids), ("same", ids), ("fewer", ids.filter("property_id % 2 = 0"))):
        wrote = sinks.write_csv_if_changed(rows, path)
        seen = spark.read.option("header", True).csv(path).count()
        steps.append((step, wrote, seen))
    return spark.createDataFrame(steps, "step string, wrote boolean, n_ids long")


@query(
    "a10_statistics_json",
    "SELECT kind AS property_type, CAST(count(*) AS BIGINT) AS n FROM raw GROUP BY 1",
    "sales",
    "raw",
)
def _(spark, sf):
    path = scratch(spark, "statistics")
    sinks.write_json(quality.distribution(derived.raw_records(spark, sf), "property_type", "unknown"), path)
    return spark.read.schema("property_type string, n long").json(path)


@query("a12_captured_pages", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages")
def _(spark, sf):
    return files.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


@query(
    "a13_page_manifest",
    """SELECT page_id, CAST(strlen(html) AS INTEGER) AS n_bytes, sha256(html) AS digest, '2025-11-15' AS ingested_on FROM pages""",
)
def _(spark, sf):
    staged = files.stage_pages(files.read_pages(spark, f"{sf}/pages.parquet"), "2025-11-15 00:00:00")
    return staged.select("page_id", "n_bytes", "digest", F.date_format("ingested_at", "yyyy-MM-dd").alias("ingested_on"))


@query(
    "a14_export_formats",
    """SELECT 'parquet' AS kind, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(final_price) AS BIGINT) AS total FROM sales
       UNION ALL SELECT 'csv', CAST(count(*) AS BIGINT), CAST(sum(final_price) AS BIGINT) FROM sales""",
    "sales",
)
def _(spark, sf):
    s = views.sales(spark, sf).select("property_id", "final_price", "sold_date")
    path = scratch(spark, "export")
    sinks.export(s, f"{path}/parquet", "parquet")
    sinks.export(s, f"{path}/csv", "csv")
    sums = lambda df, kind: df.agg(F.count("*").alias("n_rows"), F.sum("final_price").alias("total")).select(
        F.lit(kind).alias("kind"), "n_rows", "total"
    )
    text = spark.read.schema("property_id string, final_price long, sold_date string").option("header", True)
    return sums(spark.read.parquet(f"{path}/parquet"), "parquet").unionByName(sums(text.csv(f"{path}/csv"), "csv"))


@query(
    "s2_incremental_load",
    """WITH p AS (SELECT *, NOT broken AND living_area >= 10 AND year_of_construction >= 1800
                    AND asking_price BETWEEN 100000 AND 50000000
                    AND (NOT sold OR (final_price BETWEEN 100000 AND 50000000 AND sold_date >= listed_date)) AS good FROM listing)
       SELECT CASE WHEN number_of_rooms <= 3 THEN 'run-1' ELSE 'run-2' END AS run_id, property_type, CAST(count(*) AS BIGINT) AS n_records
       FROM p WHERE good GROUP BY 1, 2""",
    "sales",
    "listing",
)
def _(spark, sf):
    root = scratch(spark, "load")
    pages = staged(derived.listing_pages(spark, sf).select("page_id", "url", "html"))
    links = pages.select("url")
    early = links.filter(F.rlike("url", F.lit("lagenhet-[123]rum")))
    settings = dict(
        captured_at=datetime(2025, 11, 15), as_of=date(2025, 11, 20), site_prefix=derived.SITE
    )
    # both runs are offered overlapping links: run-2 gets all, and takes up those not yet loaded
    detail_load.load(spark, early, pages, root, "run-1", **settings)
    detail_load.load(spark, links, pages, root, "run-2", **settings)
    return files.read_records(spark, f"{root}/records").groupBy("run_id", "property_type").agg(
        F.count("*").alias("n_records")
    )


SETTINGS = dict(captured_at=datetime(2025, 11, 15), as_of=date(2025, 11, 20))
GOOD = """NOT broken AND living_area >= 10 AND year_of_construction >= 1800 AND asking_price BETWEEN 100000 AND 50000000
          AND (NOT sold OR (final_price BETWEEN 100000 AND 50000000 AND sold_date >= listed_date))"""
METRICS_SQL = """CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE good) AS BIGINT) AS successful,
                 CAST(count(*) FILTER (WHERE NOT good) AS BIGINT) AS failed, count(*) FILTER (WHERE good) / count(*) * 100 AS success_rate"""


def captured(spark, sf, *columns):
    return staged(derived.listing_pages(spark, sf).select("page_id", "url", "html", *columns))


@query(
    "s2_batches",
    f"""WITH p AS (SELECT {GOOD} AS good, row_number() OVER (ORDER BY url) - 1 AS i FROM listing)
        SELECT 'run-1' AS run_id, CAST(i // 5000 AS BIGINT) AS batch_id, {METRICS_SQL} FROM p GROUP BY 2""",
    "sales",
    "listing",
)
def _(spark, sf):
    root, pages = scratch(spark, "batches"), captured(spark, sf)
    return batch_load.load_batches(spark, pages.select("url"), pages, root, "run-1", derived.SITE, size=5000, **SETTINGS)


@query(
    "s2_slice_of_batches",
    f"""WITH p AS (SELECT {GOOD} AS good, row_number() OVER (ORDER BY url) - 1 AS i FROM listing),
             s AS (SELECT good, (i - 700) // 300 AS batch_id FROM p WHERE i >= 700 AND i < 4000)
        SELECT 'run-1' AS run_id, CAST(batch_id AS BIGINT) AS batch_id, {METRICS_SQL} FROM s WHERE batch_id >= 2 AND batch_id < 9 GROUP BY 2""",
    "sales",
    "listing",
)
def _(spark, sf):
    root, pages = scratch(spark, "batches"), captured(spark, sf)
    cut = dict(size=300, offset=700, limit=3300, first=2, last=9, at_once=3)
    return batch_load.load_batches(spark, pages.select("url"), pages, root, "run-1", derived.SITE, **cut, **SETTINGS)


@query(
    "s2_resume",
    f"""WITH p AS (SELECT {GOOD} AS good, number_of_rooms <= 3 AS early, url FROM listing),
             n AS (SELECT *, row_number() OVER (PARTITION BY early ORDER BY url) - 1 AS i FROM p),
             m AS (SELECT CASE WHEN early THEN 'run-1' ELSE 'run-2' END AS run_id, i // 4000 AS batch_id, good FROM n)
        SELECT run_id, CAST(count(DISTINCT batch_id) AS BIGINT) AS batches, CAST(max(batch_id) AS BIGINT) AS last_batch,
               CAST(count(*) AS BIGINT) AS total_processed, CAST(count(*) FILTER (WHERE good) AS BIGINT) AS total_successful,
               CAST(count(*) FILTER (WHERE NOT good) AS BIGINT) AS total_failed, count(*) FILTER (WHERE good) / count(*) * 100 AS success_rate,
               CAST(count(*) FILTER (WHERE good) AS BIGINT) AS n_records, CAST(count(*) FILTER (WHERE good) AS BIGINT) AS n_urls
        FROM m GROUP BY 1""",
    "sales",
    "listing",
)
def _(spark, sf):
    """A run that stops within its second batch, is resumed with other links at hand, and a run after it."""
    root, pages = scratch(spark, "resume"), captured(spark, sf)
    log, links = CommitLog(spark, root), pages.select("url")
    early = links.filter(F.rlike("url", F.lit("lagenhet-[123]rum")))
    run = lambda some, name, **cut: batch_load.load_batches(spark, some, pages, root, name, derived.SITE, size=4000, **cut, **SETTINGS)
    run(early, "run-1", last=1)
    plan = batch_load.planned(log, early, "run-1", 4000)
    batch_load.write_attempt(log, plan, pages, 1, 2, derived.SITE, **SETTINGS)  # its driver is lost before the commit
    run(links, "run-1", at_once=2)
    # of the links offered to the next run, those that failed in the first are still to do
    failed = batch_load.rejected_links(spark, root).filter("run_id = 'run-1'").select("url")
    run(links.join(failed, "url", "left_anti"), "run-2")
    records = batch_load.loaded_records(spark, root).groupBy("run_id")
    counts = records.agg(F.count("*").alias("n_records"), F.countDistinct("url").alias("n_urls"))
    return batch_load.run_totals(spark, root).join(counts, "run_id")


@query(
    "s2_requests",
    f"""SELECT url, CASE WHEN number_of_rooms <> 4 THEN CAST(55.5 AS DOUBLE) ELSE living_area / 100 + 55 END AS latitude,
               CASE WHEN number_of_rooms <> 4 THEN CAST(concat('13.0', number_of_rooms) AS DOUBLE) ELSE number_of_rooms / 10 + 13 END AS longitude
        FROM listing WHERE {GOOD}""",
    "sales",
    "listing",
)
def _(spark, sf):
    root, pages = scratch(spark, "requests"), captured(spark, sf, "requests")
    settings = dict(SETTINGS, requests="requests", size=100_000)
    batch_load.load_batches(spark, pages.select("url"), pages, root, "run-1", derived.SITE, **settings)
    return batch_load.loaded_records(spark, root).select("url", "latitude", "longitude")


@query(
    "s2_twice_captured",
    f"""SELECT url, CASE WHEN sold THEN 'sold' ELSE 'for_sale' END AS property_type, scraped FROM
        (SELECT url, sold, number_of_rooms % 2 AS odd, 'latest' AS scraped FROM listing WHERE {GOOD})
        WHERE odd = 1""",
    "sales",
    "listing",
)
def _(spark, sf):
    """Every page captured twice; the later capture of those with an even room count is broken."""
    root, pages = scratch(spark, "twice"), captured(spark, sf)
    even = F.rlike("url", F.lit("lagenhet-[2468]rum"))
    older = pages.withColumns({"captured_at": F.lit(date(2025, 11, 1)), "html": F.when(even, F.col("html")).otherwise("<html></html>")})
    later = pages.withColumns({"captured_at": F.lit(date(2025, 11, 2)), "html": F.when(even, F.lit("<html></html>")).otherwise(F.col("html"))})
    both = older.unionByName(later)
    batch_load.load_batches(spark, both.select("url"), both, root, "run-1", derived.SITE, size=100_000, **SETTINGS)
    return batch_load.loaded_records(spark, root).select("url", "property_type", F.lit("latest").alias("scraped"))
