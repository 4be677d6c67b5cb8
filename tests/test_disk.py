"""What loads and staged tables leave on disk, and how commits share a call."""

import threading
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from estate_spark.plans import batch_load, derived
from estate_spark.plans.detail_load import checked_offers
from estate_spark.session import RELEASE_CONF, materialise, shuffles_released, staged
from estate_spark.sources.commits import CommitLog

SETTINGS = dict(captured_at=datetime(2025, 11, 15), as_of=date(2025, 11, 20))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in files.mkString("\n").split("\n") if "shuffle_" in name}


@pytest.mark.parametrize("keep", [materialise, staged])
def test_a_kept_table_leaves_no_shuffle_files(spark, keep):
    before = shuffle_files(spark)
    kept = keep(spark.range(1000).repartition(7, "id"))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert kept.agg(F.sum("id")).first()[0] == 499500 and kept.count() == 1000


def test_the_setting_is_what_it_was_afterwards(spark):
    assert spark.conf.get(RELEASE_CONF, None) is None
    with pytest.raises(ValueError), shuffles_released(spark), shuffles_released(spark):
        assert spark.conf.get(RELEASE_CONF) == "true"
        raise ValueError
    assert spark.conf.get(RELEASE_CONF, None) is None


@pytest.fixture
def pages(spark):
    script = '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"property":{"numberOfRooms":%d}}}}</script>'
    data = [(i, f"{derived.SITE}bostad/lagenhet-2rum-{i}", script % i) for i in range(12)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_commits_of_a_call_are_worked_on_together(spark, pages, tmp_path, monkeypatch):
    both, real = threading.Barrier(2), batch_load.write_attempt

    def write_attempt(*args, **settings):
        both.wait(timeout=60)
        return real(*args, **settings)

    monkeypatch.setattr(batch_load, "write_attempt", write_attempt)
    links = pages.select("url").union(spark.createDataFrame([(None,), (f"{derived.SITE}bostad/x-99",)], "url string"))
    done = batch_load.load_batches(spark, links, pages, str(tmp_path), "run-1", derived.SITE, size=4, at_once=1, **SETTINGS)
    assert sorted((r.batch_id, r.processed) for r in done.collect()) == [(0, 4), (1, 4), (2, 4), (3, 2)]
    errors = [r.error for r in batch_load.rejected_links(spark, str(tmp_path)).collect()]
    assert "no_page" in errors and "no_url" in errors


def test_a_failed_commit_ends_the_call(spark, pages, tmp_path, monkeypatch):
    real = batch_load.write_attempt

    def write_attempt(log, plan, some, low, high, *rest, **settings):
        if low == 1:
            raise OSError("lost")
        return real(log, plan, some, low, high, *rest, **settings)

    load = lambda: batch_load.load_batches(spark, pages.select("url"), pages, str(tmp_path), "run-1", derived.SITE, size=4, at_once=1, **SETTINGS)
    with monkeypatch.context() as patch:
        patch.setattr(batch_load, "write_attempt", write_attempt)
        with pytest.raises(OSError, match="lost"):
            load()
    assert (1, 2) in CommitLog(spark, str(tmp_path)).left_to_do("run-1", 0, 3)
    assert sorted((r.batch_id, r.processed) for r in load().collect()) == [(0, 4), (1, 4), (2, 4)]


def test_a_commit_moves_no_page(spark, pages, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    plan = batch_load.planned(log, pages.select("url"), "run-1", 4)
    offered = batch_load.pages_by_batch(log, plan, pages, [(0, 3)], "a")
    assert offered.count() == 12
    checked = checked_offers(offered, derived.SITE, ("batch_id",), **SETTINGS)
    assert "Exchange" not in checked._jdf.queryExecution().executedPlan().toString()
