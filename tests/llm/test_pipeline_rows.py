"""The pipeline judges rows, not ids: rows without an id and rows that share one."""

import random

import pytest

import corpus_pipeline
from test_pipeline import ITEM, prose

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(12)
    stems = ["the", "ing", "er", "and", "th", "on"]
    fresh = lambda: prose(rnd, stems)
    clean = {f"clean{i}": fresh() for i in range(12)}
    toxic = fresh() + " you horridperson " + fresh()
    leak = f"{clean['clean0'][:150]} {ITEM} {clean['clean1'][:150]}"
    group = [clean["clean2"] + " more", clean["clean2"] + " again"]
    ids = {"clean3": 900, "clean4": 901, "clean5": 902, "clean6": 903, "clean7": 903, "clean8": 904, "clean9": None, "clean10": None}
    docs = [(ids[k], clean[k], "en") for k in ids]
    docs += [(None, toxic, "en"), (900, toxic + " x", "en"), (None, "123 456", "en"), (901, "789 123", "en"), (None, leak, "en"), (902, leak, "en")]
    docs += [(None, group[0], "en"), (None, group[1], "en"), (904, clean["clean8"], "en"), (None, clean["clean6"], "en")]
    train = [(i, fresh() + (" you horridperson " + fresh() if i % 3 == 0 else ""), "en") for i in range(90)]
    folder = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(train + docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return folder, docs, toxic, leak, group


def kept(spark, planted, stage):
    folder, docs = planted[:2]
    out = dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    mine = {t for _, t, _ in docs}
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return order((r.doc_id, r.text) for r in out.collect() if r.text in mine), order((i, t) for i, t, _ in docs)


def test_toxic_rows(spark, planted):
    got, all_rows = kept(spark, planted, "toxicity")
    assert got == [r for r in all_rows if "horridperson" not in r[1]]


def test_rows_without_letters(spark, planted):
    got, all_rows = kept(spark, planted, "language")
    assert got == [r for r in all_rows if r[1] not in ("123 456", "789 123")]


def test_leaking_rows(spark, planted):
    got, all_rows = kept(spark, planted, "decontamination")
    assert got == [r for r in all_rows if r[1] != planted[3]]


def test_copies_with_null_and_shared_ids(spark, planted):
    got, all_rows = kept(spark, planted, "near_duplicates")
    leak, group, toxic = planted[3], planted[4], planted[2]
    texts = [t for _, t in got]
    assert len(texts) == len(set(texts)) and sum(t in group for t in texts) == 1
    # each text but one of the group and of the two toxic copies is there once, and its row is that of the smallest id
    assert {t for _, t in all_rows} - set(texts) <= {*group, toxic, toxic + " x"} and sum("horridperson" in t for t in texts) == 1
    first = {}
    for i, t in all_rows:
        first.setdefault(t, i)
    assert all(first[t] == i for i, t in got) and (902, leak) in got
