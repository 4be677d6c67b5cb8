"""As-of lookups: one exchange for keys of few rows, time buckets for keys of many, the same matches either way."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from estate_spark.functions import ordering
from estate_spark.operators import history


def _tables(rows):
    rng = random.Random(17)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "only", None])
    time = lambda: rng.choice([None] + [datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 40)) for _ in range(9)])
    left = [(i, key(), time()) for i in range(150)]
    right = [(i, k, time()) for i in range(80) if (k := key()) != "only"]
    right += [(i + 100, k, t) for i, k, t in right[:20]]  # several at one time
    return left, right, rows(left, "id long, k string, t timestamp_ntz"), rows(right, "rid long, k string, rt timestamp_ntz")


def _brute_force(left, right, backward):
    want = {}
    for i, k, t in left:
        fits = [] if k is None or t is None else [(u, r) for r, q, u in right if q == k and u is not None and (u <= t if backward else u >= t)]
        near = (max if backward else min)((u for u, _ in fits), default=None)
        want[i] = min((r for u, r in fits if u == near), default=None)
    return want


@pytest.mark.parametrize("backward", [True, False])
@pytest.mark.parametrize("hot_rows", [5, 100_000])
def test_lookups_keep_all_left_rows_and_find_the_nearest(rows, monkeypatch, backward, hot_rows):
    monkeypatch.setattr(ordering, "HOT_ROWS", hot_rows)
    left, right, l, r = _tables(rows)
    want = _brute_force(left, right, backward)
    found = ordering.asof_match(l, r, ["k"], "t", "rt", history.day_bucket, backward, [F.col("rid")], keep=True)
    assert found.columns == ["k", "t", "id", "rid", "rt"]
    assert {x.id: x.rid for x in found.collect()} == want and found.count() == len(left)
    only = ordering.asof_match(l, r, ["k"], "t", "rt", history.day_bucket, backward, [F.col("rid")])
    assert {x.id: x.rid for x in only.collect()} == {i: m for i, m in want.items() if m is not None}


def test_keys_of_few_rows_cross_one_exchange(rows):
    _, _, l, r = _tables(rows)
    found = ordering.asof_match(l, r, ["k"], "t", "rt", history.day_bucket, True, [F.col("rid")])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_matching_shuffles_listings_and_sales_once_a_lookup(rows):
    listed = rows([(str(i), f"Street {i % 3}", date(2024, 1, 1 + i)) for i in range(9)], "property_id string, address string, listed_date date")
    sold = rows([(str(i + 5), f"street {i % 3}", date(2024, 1, 12 + i), i) for i in range(9)], "property_id string, address string, sold_date date, final_price long")
    found = history.match_listings(listed, sold)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # by id it is staged
    by_id = {str(i): str(i) for i in range(5, 9)}
    got = {r.property_id: r.sale_id for r in found.collect()}
    assert got == {**by_id, "0": "5", "1": "6", "2": "7", "3": "5", "4": "6"}


def test_listings_without_id_or_date_are_tried_by_address(rows):
    listed = rows([(None, "A 1", date(2024, 5, 1)), ("2", "A 1", None)], "property_id string, address string, listed_date date")
    sold = rows([("9", "a 1", date(2024, 6, 1), 1)], "property_id string, address string, sold_date date, final_price long")
    assert [(r.property_id, r.sale_id) for r in history.match_listings(listed, sold).collect()] == [(None, "9")]
