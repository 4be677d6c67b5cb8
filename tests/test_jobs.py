"""Files, the incremental load and streams over several batches."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from estate_spark import schemas
from estate_spark.operators import history
from estate_spark.plans import derived, detail_load
from estate_spark.sources import files, sinks, views
from estate_spark.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"
SETTINGS = dict(captured_at=datetime(2025, 11, 15), as_of=date(2025, 11, 20), site_prefix=derived.SITE)


def test_quoted_links_and_blank_urls(spark, tmp_path):
    (tmp_path / "l.csv").write_text('url,property_id,found_at\n"https://x/a-2,5rum-1",1,2025\n,2,2025\nhttps://x/b-3,3,2025\n')
    got = files.read_links(spark, str(tmp_path / "l.csv"))
    assert [r.url for r in got.collect()] == ["https://x/a-2,5rum-1", "https://x/b-3"]


def test_null_tokens_and_bad_numbers(spark, tmp_path):
    names = list(schemas.SALES_HISTORY_FIELDS)
    values = {**{n: "NA" for n in names}, "final_price": "2500000", "fee": "abc", "location": "A, B"}
    quoted = ",".join(f'"{values[n]}"' for n in names)
    (tmp_path / "s.csv").write_text(",".join(names) + "\n" + quoted + "\n")
    r = files.read_sales_history(spark, str(tmp_path / "s.csv")).first()
    assert (r.final_price, r.fee, r.living_area, r.location) == (2500000.0, None, None, "A, B")


def test_result_array_file_counts_failures_among_the_first(spark, tmp_path):
    (tmp_path / "r.json").write_text('[\n {"url": "a", "success": true},\n {"url": "b", "success": false},\n {"url": "c", "success": true}\n]')
    got = files.read_results(spark, str(tmp_path / "r.json"), "struct<url:string,success:boolean>", first=2)
    assert [r.url for r in got.collect()] == ["a"]


def test_range_files_keep_their_name(spark, tmp_path):
    for lo, hi in ((0, 31), (31, 37)):
        (tmp_path / f"properties_{lo}_{hi}.csv").write_text(f"property_id,url,area_range,scraped_at\n{lo},u,{lo}-{hi},t\n")
    got = files.read_range_files(spark, str(tmp_path / "properties_*.csv"))
    assert {r.file_name for r in got.collect()} == {"properties_0_31.csv", "properties_31_37.csv"}


def test_raw_file_manifest(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"abc")
    r = files.stage_files(spark, str(tmp_path), "2025-01-01 00:00:00", "*.html").first()
    assert (r.length, r.digest[:8]) == (3, "ba7816bf")


def test_unchanged_ids_are_not_rewritten(spark, tmp_path, rows):
    path = str(tmp_path / "out")
    df = rows([("1", "u"), ("2", "v")], "property_id string, url string")
    assert sinks.write_csv_if_changed(df, path) is True
    assert sinks.write_csv_if_changed(df.repartition(3), path) is False
    assert sinks.write_csv_if_changed(df.filter("property_id = '1'"), path) is True


@pytest.fixture(scope="module")
def pages(spark):
    from estate_spark.session import materialise

    some = derived.listing_pages(spark, SF_DIR).filter(F.xxhash64("page_id") % 20 == 0)
    return materialise(some.select("page_id", "url", "html"))


def test_load_skips_processed_and_repeats_safely(spark, pages, tmp_path):
    root = str(tmp_path / "load")
    links = pages.select("url").distinct()
    half = links.filter(F.xxhash64("url") % 2 == 0)
    run = lambda some, name: detail_load.load(spark, some, pages, root, name, **SETTINGS).first()
    first = run(half, "run-1")
    assert first.processed == half.count() and first.successful + first.failed == first.processed
    again = run(half, "run-1")
    assert (again.processed, again.successful) == (first.processed, first.successful)
    second = run(links, "run-2")
    records = files.read_records(spark, f"{root}/records")
    assert records.count() == first.successful + second.successful
    assert records.groupBy("property_id").count().filter("count > 1").isEmpty()
    third = run(links, "run-3")
    # only rejected pages are tried again
    assert third is None or third.successful == 0
    rejected = spark.read.parquet(f"{root}/rejects")
    assert rejected.filter("run_id = 'run-1'").count() == first.failed


@pytest.fixture
def batches(spark, tmp_path):
    """The price history in four files, in time order."""
    source = str(tmp_path / "in")
    h = views.price_history(spark, SF_DIR)
    for i in range(4):
        low, high = F.lit(f"2024-01-{1 + 8 * i:02d}"), F.lit(f"2024-01-{min(9 + 8 * i, 31):02d}")
        part = h.filter((F.col("recorded_at") >= low) & (F.col("recorded_at") < high))
        part.coalesce(1).write.mode("append").parquet(source)
    return source, h


def test_alerts_over_batches_equal_the_batch_twin(spark, batches, tmp_path):
    source, h = batches
    stream = jobs.read_stream(spark, source, h.schema, max_files=1)
    got = jobs.price_alerts(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    drops = {(r.event_id, r.old_price) for r in got.filter("alert = 'price_drop'").collect()}
    want = {(r.event_id, r.old_price) for r in history.price_changes(h).filter("direction = 'drop'").collect()}
    assert drops == want
    listings = h.select("property_id").distinct().count()
    assert got.filter("alert = 'new_listing'").count() == listings
    assert spark.read.parquet(str(tmp_path / "out" / "state")).groupBy("batch").count().count() == 2


def test_stream_dedup_keeps_one_row_per_key(spark, batches, tmp_path):
    source, h = batches
    stream = jobs.read_stream(spark, source, h.schema, max_files=1)
    out = jobs.run_available(
        jobs.deduplicate(stream, "property_id", "recorded_at", "60 days").select("property_id"), str(tmp_path / "o"), str(tmp_path / "c")
    )
    assert out.count() == h.select("property_id").distinct().count()


def test_sliding_weeks(spark):
    h = views.price_history(spark, SF_DIR)
    sliding = jobs.weekly_activity(h, slide="1 day")
    assert sliding.agg(F.sum("n_events")).first()[0] == 7 * h.count()


@pytest.fixture
def captured(spark):
    """Three pages of good listings, taken from the derived ones."""
    return derived.listing_pages(spark, SF_DIR).select("page_id", "url", "html").orderBy("page_id").limit(3).collect()


def counts(spark, root, run):
    of = lambda name: spark.read.parquet(f"{root}/{name}").filter(F.col("run_id") == run)
    try:
        rejected = {(r.url, r.error) for r in of("rejects").collect()}
    except Exception:
        rejected = set()
    return of("records").count(), rejected


def test_every_link_ends_as_record_or_reject(spark, captured, tmp_path):
    pages = spark.createDataFrame([tuple(r) for r in captured] + [("~later", captured[0].url, captured[0].html)], "page_id string, url string, html string")
    links = spark.createDataFrame([(r.url, None) for r in captured] + [("https://x/lagenhet-9", None), (None, "77")], "url string, property_id string")
    detail_load.load(spark, links, pages, str(tmp_path), "run-1", **SETTINGS)
    n, rejected = counts(spark, tmp_path, "run-1")
    plain = {(u, e) for u, e in rejected if e in ("no_page", "no_url")}
    assert plain == {("https://x/lagenhet-9", "no_page"), (None, "no_url")}
    assert n + len({u for u, _ in rejected}) == 5  # a page captured twice is one record


def test_repeated_run_leaves_no_old_rejects(spark, captured, tmp_path):
    good = spark.createDataFrame([tuple(r) for r in captured], "page_id string, url string, html string")
    links = good.select("url")
    detail_load.load(spark, links, good.limit(0), str(tmp_path), "run-1", **SETTINGS)
    detail_load.load(spark, links, good, str(tmp_path), "run-1", **SETTINGS)
    n, rejected = counts(spark, tmp_path, "run-1")
    assert not any(e == "no_page" for _, e in rejected) and n + len({u for u, _ in rejected}) == 3


def test_own_sale_before_the_listing_is_not_its_end(rows):
    listed = rows([("1", "A 1", date(2024, 5, 1))], "property_id string, address string, listed_date date")
    sold = rows([("1", "A 1", date(2020, 1, 1), 1), ("1", "A 1", date(2024, 6, 1), 2)], "property_id string, address string, sold_date date, final_price long")
    assert [r.sold_date for r in history.match_listings(listed, sold).collect()] == [date(2024, 6, 1)]


def test_sales_without_an_index_year_stay(rows):
    sales = rows([(2020, 100), (2021, 100), (None, 100)], "sale_year int, final_price long")
    index = rows([(2020, 1.0), (2024, 2.0)], "year int, level double")
    got = history.to_base_year(sales, index).collect()
    assert sorted((r.sale_year or 0, r.adjusted_price) for r in got if r.sale_year == 2020) == [(2020, 200)] and len(got) == 3


def test_csv_by_name_and_with_line_breaks(spark, tmp_path):
    (tmp_path / "l.csv").write_text('found_at,extra,url,property_id\n2025,x,"https://x/a\nb",1\n')
    got = files.read_csv_text(spark, str(tmp_path / "l.csv"), schemas.ACTIVE_LINKS, multi_line=True).first()
    assert (got.url, got.property_id, got.found_at) == ("https://x/a\nb", "1", "2025")
    (tmp_path / "m.csv").write_text("url,property_id\nu,1\n")
    with pytest.raises(ValueError, match="found_at"):
        files.read_csv_text(spark, str(tmp_path / "m.csv"), schemas.ACTIVE_LINKS)


def test_late_unpriced_and_text_id_rows(spark, tmp_path):
    from datetime import datetime as at

    schema = "property_id string, event_id long, price double, recorded_at timestamp_ntz"
    days = [
        [("a", 1, 100.0, at(2024, 1, 10)), ("b", 2, None, at(2024, 1, 10))],
        [("a", 3, 50.0, at(2024, 1, 5)), ("b", 4, 80.0, at(2024, 1, 11)), ("a", 5, None, at(2024, 1, 12))],
        [("a", 6, 90.0, at(2024, 1, 13)), ("b", 7, 80.0, at(2024, 1, 12)), ("b", 8, 70.0, at(2024, 1, 13))],
    ]
    for n, rows in enumerate(days):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={n}"))
    import os
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    for n in range(3):
        part = next((tmp_path / "in" / f"d={n}").glob("*.parquet"))
        shutil.copy(part, flat / f"{n}.parquet")
        os.utime(flat / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = jobs.read_stream(spark, str(flat), spark.read.parquet(str(flat)).schema, max_files=1)
    got = jobs.price_alerts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert {(r.event_id, r.alert, r.old_price) for r in got} == {
        (1, "new_listing", None), (4, "new_listing", None), (6, "price_drop", 100.0), (8, "price_drop", 80.0),
    }
