"""Interval union and subtraction against counting units."""

import random
from datetime import date, datetime

import pytest

from estate_spark.operators import ledger


@pytest.mark.parametrize("seed", range(3))
def test_union_and_rest_unit_by_unit(rows, seed):
    rnd = random.Random(seed)
    done, planned = [], []
    for key in "abc":
        done += [(key, lo, lo + rnd.randrange(0, 9)) for lo in (rnd.randrange(60) for _ in range(12))]
        bounds = sorted(rnd.sample(range(70), 8))
        planned += [(key, lo, hi) for lo, hi in zip(bounds, bounds[1:]) if rnd.random() < 0.8]
    done += [("a", None, 5), ("a", 5, None)]
    schema = "k string, lo int, hi int"
    held = {(k, u) for k, lo, hi in done if lo is not None and hi is not None for u in range(lo, hi)}
    union = [(r.k, r.lo, r.hi) for r in ledger.covered(rows(done, schema), ["k"]).collect()]
    assert sorted((k, u) for k, lo, hi in union for u in range(lo, hi)) == sorted(held)
    assert not any(a != b and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2] for a in union for b in union)  # none touch
    rest = [(r.k, r.lo, r.hi, r.plan_lo, r.plan_hi) for r in ledger.uncovered(rows(planned, schema), rows(done, schema), ["k"]).collect()]
    want = sorted((k, u, lo, hi) for k, lo, hi in planned for u in range(lo, hi) if (k, u) not in held)
    assert sorted((k, u, a, b) for k, lo, hi, a, b in rest for u in range(lo, hi)) == want


def test_nothing_recorded_leaves_the_whole_plan(spark, rows, tmp_path):
    none = ledger.read_ledger(spark, str(tmp_path / "none"), "areas")
    planned = rows([(0, 10), (10, 12)], "lo int, hi int")
    assert sorted((r.lo, r.hi) for r in ledger.uncovered(planned, none).collect()) == [(0, 10), (10, 12)]
    assert ledger.covered(none).collect() == []
    assert tuple(ledger.total_collected(none).first()) == (0, 0)


def test_entries_repeat_safely_and_names_do_not_mix(spark, rows, tmp_path):
    path, at = str(tmp_path / "l"), datetime(2025, 1, 1)
    done = rows([(0, 5, 7), (5, 9, 3)], "lo int, hi int, n_rows long")
    for run_id, name in (("run-1", "a"), ("run-1", "a"), ("run-2", "b")):
        ledger.record_completed(done, path, name, run_id, at)
    ledger.record_completed(rows([(0, 5, 8)], "lo int, hi int, n_rows long"), path, "a", "run-3", datetime(2025, 2, 1))
    entries = ledger.read_ledger(spark, path, "a")
    assert tuple(ledger.total_collected(entries).first()) == (2, 11)
    assert [(r.lo, r.hi) for r in ledger.covered(entries).collect()] == [(0, 9)]
    assert ledger.read_ledger(spark, path, "c").count() == 0


def test_months_left_by_days(spark, rows):
    done = rows([(date(2024, 1, 1), date(2024, 2, 15)), (date(2024, 2, 15), date(2024, 2, 20))], "lo date, hi date")
    got = [tuple(r) for r in ledger.months_left(spark, date(2024, 1, 9), date(2024, 3, 1), done).orderBy("lo").collect()]
    assert got == [("2024-02", date(2024, 2, 20), date(2024, 3, 1)), ("2024-03", date(2024, 3, 1), date(2024, 4, 1))]
