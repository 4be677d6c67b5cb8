"""Brute-force checks on small fixtures, with hot groups, ties and nulls."""

import decimal
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from estate_spark.functions.intervals import nearest_points, rows_between, whole_nodes
from estate_spark.functions.ordering import asof_match, number_rows, ordered_layout, previous_value
from estate_spark.functions.quantiles import approximate_quantiles, exact_quantiles, group_summary
from estate_spark.operators import clean, comps, history, incremental, links, market, ranges
from estate_spark.session import materialise


@pytest.mark.parametrize("values", [[1, 2, 3, 4], [7], [5, 5, 5], [-3, 0, 2, 1000000, 1000001], list(range(100))])
def test_exact_quantiles(rows, values):
    df = rows([("a", float(v)) for v in values] + [("b", None), (None, 1.0)], "k string, v double")
    got = exact_quantiles(df, ["k"], "v", {"q1": 0.25, "med": 0.5, "p90": 0.9}).collect()
    assert [(r.k, r.n_rows) for r in got] == [("a", len(values))]
    for name, p in (("q1", 25), ("med", 50), ("p90", 90)):
        assert got[0][name] == pytest.approx(np.percentile(values, p))


def test_quantiles_of_a_hot_group_and_fractions(rows):
    rng = random.Random(1)
    data = [("hot", rng.choice([0.1, 0.2, rng.random()])) for _ in range(3000)] + [(f"k{i}", rng.random()) for i in range(50)]
    got = {r.k: r.med for r in exact_quantiles(rows(data, "k string, v double"), ["k"], "v", {"med": 0.5}).collect()}
    assert got["hot"] == pytest.approx(np.median([v for k, v in data if k == "hot"]))
    assert len(got) == 51


def test_group_summary_and_approximation(rows):
    df = rows([("a", v) for v in (1, 2, 3, 10)], "k string, v long")
    r = group_summary(df, ["k"], "v", {"med": 0.5}).first()
    assert (r.n_rows, r.mean, r.med) == (4, 4.0, 2.5)
    assert approximate_quantiles(df, ["k"], "v", {"med": 0.5}).first().med == 2


@pytest.mark.parametrize("area", [lambda rng: float(rng.randrange(20, 60)), lambda rng: rng.uniform(20, 60)])
def test_comparables_match_brute_force(rows, area):
    rng = random.Random(7)
    data = [
        (f"p{i:04d}", "hot" if rng.random() < 0.7 else rng.choice("ab"), rng.choice([1, 2]), area(rng), 1000 + i, rng.choice([2000, 2001, 2002]))
        for i in range(400)
    ]
    df = rows(data, "property_id string, neighborhood string, number_of_rooms int, living_area double, final_price long, sale_year int")
    got = {(r.probe_id, r.comp_rank): r.comp_id for r in comps.comparable_sales(df, df).collect()}
    want = {}
    for p in data:
        near = [s for s in data if s[1:3] == p[1:3] and abs(s[3] - p[3]) <= 10]
        for rank, s in enumerate(sorted(near, key=lambda s: (-s[5], s[0]))[:5], 1):
            want[p[0], rank] = s[0]
    assert got == want


@pytest.mark.parametrize("area", [lambda rng: float(rng.randrange(20, 40)), lambda rng: rng.uniform(20, 60), lambda rng: 30 + rng.randrange(60) * 2e-6])
def test_similar_sales_match_brute_force(rows, area):
    rng = random.Random(11)
    data = [
        (f"p{i:04d}", "hot" if rng.random() < 0.7 else rng.choice(["a", None]), rng.choice([1, 2]), area(rng), 1000 + i, rng.choice([2000, 2001, 2002]), rng.choice("xyz"))
        for i in range(300)
    ]
    df = rows(data, "property_id string, neighborhood string, number_of_rooms int, living_area double, final_price long, sale_year int, ownership_form string")
    got = {(r.probe_id, r.comp_rank): (r.comp_id, r.score) for r in comps.similar_sales(df, df).collect()}
    want = {}
    for p in data:
        near = []
        for s in data:
            gap = abs(s[3] - p[3])
            score = float(decimal.Decimal(repr((1 - gap / 10.0) * 0.7 + (0.3 if s[6] == p[6] else 0.0))).quantize(decimal.Decimal("1e-6"), decimal.ROUND_HALF_UP))
            if p[1] is not None and s[1:3] == p[1:3] and gap <= 10 and score >= 0.7:
                near.append((-score, -s[5], s[0], score))
        for rank, s in enumerate(sorted(near)[:5], 1):
            want[p[0], rank] = (s[2], s[3])
    assert got == want


def test_intervals_are_cut_into_whole_nodes(rows):
    pairs = [(low, high) for low in range(0, 40) for high in range(0, 70, 3)]
    got = rows(pairs, "low long, high long").select("low", "high", whole_nodes(F.col("low"), F.col("high")).alias("nodes")).collect()
    for r in got:
        places = [i for n in r.nodes for i in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(places) == list(range(r.low, r.high))
        assert len(r.nodes) <= 2 * max(1, (r.high - r.low).bit_length())


def test_search_rows_grow_with_the_probes_not_with_the_pairs(spark):
    """Many distinct areas in one group: a few rows a level for each probe, though thousands of areas are in reach."""
    n, k = 20_000, 5
    areas = spark.range(n).select(F.lit("hot").alias("g"), (20 + F.col("id") * 40 / n).alias("a"))
    cells = areas.withColumn("sale", F.struct((F.xxhash64("a") % 50).alias("sale_year"), F.col("a").cast("string").alias("property_id")))
    probes = areas.select("g", F.col("a").alias("at"), (F.col("a") - 10).alias("low"), (F.col("a") + 10).alias("high"))
    assert rows_between(probes, cells, ["g"], comps.newest_first(), k).count() < n * 2 * k * 14
    assert nearest_points(probes.select("g", "at"), cells, ["g"], "at", k).count() <= n * 2 * k


def test_top_rows_are_cut_before_the_shuffle(rows):
    df = rows([("a", 1, 2)], "k string, o int, x int")
    plan = links.first_per(df, "k", "o")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def _times(rng, n, key_of):
    start = datetime(2024, 1, 1)
    return [(i, key_of(rng), start + timedelta(hours=rng.randrange(0, 24 * 40)), float(rng.randrange(100))) for i in range(n)]


@pytest.mark.parametrize("backward", [True, False])
def test_asof_match_against_brute_force(rows, backward):
    rng = random.Random(3)
    key_of = lambda r: "hot" if r.random() < 0.6 else r.choice("abc")
    left = _times(rng, 150, key_of)
    right = _times(rng, 60, key_of)
    l = rows(left, "id long, k string, t timestamp_ntz, v double").drop("v")
    r = rows(right, "rid long, k string, rt timestamp_ntz, p double")
    out = asof_match(l, r, ["k"], "t", "rt", history.day_bucket, backward, [F.col("rid")])
    got = {x.id: x.rid for x in out.collect()}
    want = {}
    for i, k, t, _ in left:
        fits = [x for x in right if x[1] == k and (x[2] <= t if backward else x[2] >= t)]
        if fits:
            near = (max if backward else min)(x[2] for x in fits)
            want[i] = min(x[0] for x in fits if x[2] == near)
    assert got == want


def test_previous_value_equals_lag(rows):
    rng = random.Random(5)
    data = _times(rng, 300, lambda r: "hot" if r.random() < 0.7 else r.choice("ab"))
    data = [(i, k, t, None if i % 11 == 0 else v) for i, k, t, v in data]
    df = rows(data, "id long, k string, t timestamp_ntz, v double")
    got = {r.id: r.previous for r in previous_value(df, "k", "t", "v", "id", history.day_bucket).collect()}
    want = {}
    for key in "abh":
        mine = sorted((x for x in data if x[1][0] == key), key=lambda x: (x[2], x[0]))
        want.update({x[0]: (mine[n - 1][3] if n else None) for n, x in enumerate(mine)})
    assert got == want


def test_row_numbers_with_equal_keys(rows):
    data = [(i % 3 == 0, "same" if i % 3 else f"k{i}", i) for i in range(500)]
    df = rows(data, "f boolean, k string, i int")
    laid_out = ordered_layout(df, ["k", "i"], 7)
    got = number_rows(laid_out).collect()
    want = {x[2]: n for n, x in enumerate(sorted(data, key=lambda x: (x[1], x[2])))}
    assert {r.i: r.row_index for r in got} == want
    kept = number_rows(laid_out.filter("i % 4 = 1")).collect()
    want = {x[2]: n for n, x in enumerate(sorted((x for x in data if x[2] % 4 == 1), key=lambda x: (x[1], x[2])))}
    assert {r.i: r.row_index for r in kept} == want
    assert number_rows(laid_out.filter("i < 0")).collect() == []


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    from estate_spark.functions import ordering

    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 100)
    assert ordered_layout(spark.range(1_000), ["id"]).rdd.getNumPartitions() == 10
    monkeypatch.setattr(ordering, "MOST_RANGES", 3)
    assert ordered_layout(spark.range(1_000), ["id"]).rdd.getNumPartitions() == 3
    assert ordered_layout(spark.range(0), ["id"]).count() == 0


@pytest.mark.parametrize("offset, limit", [(0, 0), (10, 0), (10, 25), (490, 50), (0, 1)])
def test_slice_skips_then_filters_then_limits(rows, offset, limit):
    data = [(f"u-{i:04d}", f"{i:04d}") for i in range(500)]
    df = rows(data, "url string, property_id string")
    done = incremental.with_fingerprint(df.filter("property_id % 4 = 0")).select("fingerprint")
    got = [r.property_id for r in incremental.slice_rows(df, ["property_id"], done, offset, limit).orderBy("property_id").collect()]
    left = [p for _, p in data[offset:] if int(p) % 4]
    assert got == (left[:limit] if limit else left)


def test_rows_without_an_identifier_stay_in_a_slice(rows):
    df = rows([(None, None, i) for i in range(5)] + [("u-1", "1", 9)], "url string, property_id string, i int")
    done = incremental.with_fingerprint(df).select("fingerprint")
    got = incremental.slice_rows(df, ["i"], done, 1, 3).collect()
    assert sorted((r.i, r.row_index) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_fingerprints_agree_between_id_and_url(rows):
    df = rows([("1", "x-1"), (None, "x-1"), ("", "x-1/"), (None, None), ("", "")], "property_id string, url string")
    got = [r.fingerprint for r in incremental.with_fingerprint(df).collect()]
    assert len(set(got[:3])) == 1 and got[3] is None and got[4] is None
    kept = incremental.not_processed(incremental.with_fingerprint(df), rows([(got[0],)], "fingerprint string"))
    assert kept.count() == 2


def test_sample_is_exact_and_repeatable(rows):
    df = rows([(i,) for i in range(100)], "i int")
    first = {r.i for r in incremental.exact_sample(df, 15, ["i"]).collect()}
    again = {r.i for r in incremental.exact_sample(df.repartition(9), 15, ["i"]).collect()}
    assert first == again and len(first) == 15
    assert incremental.exact_sample(df, 500, ["i"]).count() == 100


def brute_ranges(counts, low, high, cap, step):
    out, lo = [], low
    while lo < high:
        top = min(lo + step, high)
        total = lambda hi: sum(counts.get(u, 0) for u in range(lo, hi))
        if total(top) == 0:
            hi = lo + 1
        else:
            hi = max([h for h in range(lo + 1, top + 1) if total(h) < cap], default=lo + 1)
        out.append((lo, hi, total(hi), total(hi) >= cap))
        lo = hi
    return out


@pytest.mark.parametrize("seed", range(4))
def test_density_ranges_match_brute_force(rows, seed):
    rng = random.Random(seed)
    counts = {u: rng.choice([0, 0, 1, 5, 30]) for u in range(0, 120) if rng.random() < 0.6}
    df = rows([(float(u) + 0.5,) for u, n in counts.items() for _ in range(n)], "living_area double")
    got = ranges.density_ranges(ranges.unit_histogram(df, high=120), 0, 120, cap=25, step=15)
    assert sorted((r.lo, r.hi, r.n_rows, r.over_cap) for r in got.collect()) == brute_ranges(counts, 0, 120, 25, 15)


def test_box_plot_fences(rows):
    df = rows([("a", v) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "ownership_form string, final_price long")
    r = market.box_plot(df).first()
    assert (r.whisker_low, r.whisker_high, r.n_outliers) == (1, 9, 1)
    assert [x.final_price for x in market.box_plot_outliers(df).collect()] == [100]


def test_ids_sets_and_overlap(rows):
    df = rows([("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("2", "b"), ("3", "c"), ("3", "c")], "property_id string, sold_month string")
    pairs = {(r.part_a, r.part_b): r.shared_ids for r in links.partition_overlap(df).collect()}
    assert pairs == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert {r.property_id: r.n_parts for r in links.ids_in_many(df).collect()} == {"1": 3, "2": 2}
    assert links.same_ids(df, df.distinct()).first().same is True
    assert links.same_ids(df, df.filter("property_id = '1'")).first().only_left == 2


def test_same_ids_merges_in_parts_that_follow_the_rows(rows, monkeypatch):
    monkeypatch.setattr(links, "ROWS_PER_PART", 2)
    left = rows([("1",), ("1",), (None,), ("2",)], "property_id string")
    right = rows([("2",), ("3",), (None,)], "property_id string")
    found = links.same_ids(left, right)
    assert tuple(found.first()) == (1, 1, False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 4), REPARTITION_BY_NUM" in plan  # 7 rows, 2 a part
    assert tuple(links.same_ids(left.limit(0), right.limit(0)).first()) == (0, 0, True)


def test_rounding_is_half_even(rows):
    df = rows([(2500.0, 10.0), (3500.0, 10.0), (2501.0, 10.0)], "prediction double, living_area double")
    assert [r.predicted_price for r in clean.rounded_prediction(df).collect()] == [2000.0, 4000.0, 3000.0]


def test_address_match_prefers_id_and_ignores_blank(rows):
    listed = rows(
        [("1", "A street 1", date(2024, 1, 5)), ("2", "B-street, 2", date(2024, 1, 5)), ("3", " ", date(2024, 1, 5))],
        "property_id string, address string, listed_date date",
    )
    sold = rows(
        [("1", "x", date(2024, 2, 1), 10), ("9", "b street 2", date(2024, 1, 1), 20), ("8", "B STREET 2", date(2024, 3, 1), 30), ("7", "", date(2024, 3, 1), 40)],
        "property_id string, address string, sold_date date, final_price long",
    )
    got = {r.property_id: (r.matched_by, r.sale_id) for r in history.match_listings(listed, sold).collect()}
    assert got == {"1": ("id", "1"), "2": ("address", "8")}


def test_pagination_reads_entities_and_spaces(rows):
    html = "<script>3 objekt</script><p>Visar 50 av 1 234</p><p>1 234 objekt</p><a href=\"?page=4&amp;x=1\"></a><a href='?page=9'></a>"
    r = links.pagination(rows([(1, "https://s/x?page=3", html)], "page_id long, url string, html string")).first()
    assert (r.current_page, r.total_pages, r.total_results) == (3, 9, 1234)
    total = rows([("Visar 50 av 1 234",), ("nothing",)], "t string").select(links.stated_total(F.col("t"))).collect()
    assert [t[0] for t in total] == [1234, 0]


def test_checkpoint_uses_the_configured_folder(spark, rows):
    assert materialise(rows([(1,)], "i int")).count() == 1
    assert spark.sparkContext.getCheckpointDir() is not None


def test_every_row_gets_a_range_bucket(rows):
    df = rows([(1, 20.5), (2, 600.0), (3, None), (4, -3.0)], "id int, living_area double")
    found = ranges.density_ranges(ranges.unit_histogram(df), 0, 500)
    got = {r.id: (r.lo, r.hi) for r in ranges.assign_ranges(df, found).collect()}
    assert got[2] == (500, None) and got[3] == (None, None) and got[4] == (None, 0) and got[1][0] <= 20 < got[1][1]
    assert sum(r.n for r in ranges.unit_histogram(df).collect()) == 4


def test_long_runs_of_digits_are_read_once(spark):
    import time

    pages = spark.createDataFrame([(1, "u", "9" * 100_000), (2, "u", "1 234 objekt")], "page_id int, url string, html string")
    began = time.time()
    text = pages.select(F.regexp_extract("html", links.RESULT_COUNT, 1).alias("n")).collect()
    assert [r.n for r in text] == ["", "1 234"] and time.time() - began < 20


def test_links_of_any_quoting_told_by_absolute_url(rows):
    html = """<link href="/bostad/x-1"><a class=c href='/bostad/y-2?a=1&amp;b=2'>t</a><a href=/bostad/z-3>t</a>
        <A HREF="https://s.se/bostad/z-3">again</A><a href="//h.se/bostad/w-4"></a>"""
    got = links.active_links(rows([(1, "https://s.se/list", html)], "page_id long, url string, html string")).orderBy("pos")
    assert [r.url for r in got.collect()] == ["https://s.se/bostad/y-2?a=1&b=2", "https://s.se/bostad/z-3", "https://h.se/bostad/w-4"]


def test_a_search_brings_no_more_than_its_answer(spark):
    """Of the rows surely within reach only the newest k come back for each probe, whatever the levels its stretch spans."""
    n, k = 3_000, 3
    areas = spark.range(n).select(F.lit("hot").alias("g"), (F.col("id") / 100).alias("a"))
    cells = areas.withColumn("sale", F.struct((F.xxhash64("a") % 50).alias("sale_year"), F.col("a").cast("string").alias("property_id")))
    reaches = spark.createDataFrame([(0.0,), (0.015,), (0.2,), (0.64,), (3.0,), (25.0,)], "reach double")
    probes = areas.filter("id % 37 = 0").crossJoin(reaches).select("g", F.col("a").alias("at"), (F.col("a") - F.col("reach")).alias("low"), (F.col("a") + F.col("reach")).alias("high"), "reach")
    found = rows_between(probes, cells, ["g"], comps.newest_first(), k)
    sure = found.filter("sure").groupBy("at", "reach").count()
    assert sure.agg(F.max("count")).first()[0] == k
    have = sorted(((r.sale.sale_year, r.sale.property_id, r.a) for r in cells.collect()), key=lambda s: (-s[0], s[1]))
    got = {}
    for r in found.filter("abs(a - at) <= reach + 1e-9").collect():
        got.setdefault((r["at"], r.reach), []).append((r.sale.sale_year, r.sale.property_id))
    for p in probes.collect():
        want = [s[:2] for s in have if abs(s[2] - p["at"]) <= p.reach + 1e-9][:k]
        assert sorted(got[p["at"], p.reach], key=lambda s: (-s[0], s[1]))[:k] == want
