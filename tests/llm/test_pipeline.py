"""The corpus pipeline on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline

ITEM = "the benchmark asks which of these rivers flows north through nine lands before it reaches the great inland sea at last"


def prose(rnd, stems):
    return " ".join(rnd.choice(stems) + rnd.choice(stems) for _ in range(60))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(8)
    stems = {"en": ["the", "ing", "er", "and", "th", "on"], "de": ["ung", "sch", "ein", "keit", "ge", "ver"]}
    docs, labels = [], []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        docs.append((i, prose(rnd, stems[lang]), lang, "s", 0))
        labels.append((i, 1, 0))
    for i in range(200, 240):
        docs.append((i, prose(rnd, stems["en"]) + " you horridperson " + prose(rnd, stems["en"]), "en", "s", 0))
        labels.append((i, 1, 1))
    copied = docs[5][1]
    docs += [(500, copied, "en", "s", 0), (501, copied + " one more", "en", "s", 0), (501, copied + " one more", "en", "s", 0)]
    docs += [(502, f"{docs[7][1][:200]} {ITEM} {docs[9][1][:200]}", "en", "s", 0), (503, "12345 67890 !!!", None, "s", 0)]
    docs += [(504, None, None, None, None), (None, prose(rnd, stems["en"]), "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_planted_cases(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    # toxic documents, copies, the leak, and texts without a letter are gone, all others are there
    assert kept == [(False, i) for i in range(120)] + [(True, 0)]
    assert all(r.n_tokens == len(r.ids) > 0 and r.valid_utf8 for r in got)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []
