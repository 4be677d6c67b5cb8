"""Language identification and toxicity: definitions, edges and held-out accuracy."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from estate_spark.llm import language_id, queries, toxicity
from estate_spark.llm.batches import packed

TEXTS = {"x": [b"abcabcabd abab", b"cab abba"], "y": [b"zyzzy zyx zy", b"xyzzy abc"]}


def test_each_context_is_a_distribution():
    trees = language_id.train(TEXTS, 3, 1)
    unseen = 256 - (trees.bits.shape[1] - 1)
    p = np.exp2(-trees.bits.astype(float))
    assert np.allclose(p[:, :-1].sum(1) + unseen * p[:, -1], 1, atol=1e-5)


def test_code_lengths_follow_the_definition():
    """Order 1: seen bytes n / (n + d); others d / (n + d) times the empty context's share of bytes not seen here."""
    trees = language_id.train({"x": [b"aab"]}, 1, 1)
    stream = bytes([language_id.START]) + b"aab"
    top = {b: stream.count(b) for b in set(stream)}
    n, d = len(stream), len(top)
    base = {b: c / (n + d) for b, c in top.items()}
    rest = d / (n + d) / (256 - d)
    # after "a" come "a" and "b", once each
    after = {97: 1 / 4, 98: 1 / 4}
    left = 1 - base[97] - base[98]
    want = -math.log2(after[97]) - math.log2(0.5 * base[language_id.START] / left) - math.log2(0.5 * rest / left)
    data, starts = packed(pa.array(["aa", "a\n", "aZ"]))
    first = language_id.code_lengths(trees, data, starts, 1)[:, 0]
    alone = language_id.code_lengths(trees, *packed(pa.array(["a"])), 1)[0, 0]
    assert math.isclose((first - alone).sum(), want, rel_tol=1e-5)


def test_texts_do_not_touch_each_other():
    trees = language_id.train(TEXTS)
    texts = ["abc", "", "zyzzy", "a" * 50]
    together = language_id.code_lengths(trees, *packed(pa.array(texts)))
    alone = [language_id.code_lengths(trees, *packed(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone)


def test_language_edges(edge_docs, edges):
    got = language_id.identify(edge_docs, edge_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in edges)
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 10)} == {"und"}
    assert all(r.score == 0 and r.bits_per_byte is None for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got if r.doc_id in (1, 4, 7, 8, 9, None)} == {"en"}


def test_nothing_to_learn_from(edge_docs, empty_docs):
    assert {r.lang_pred for r in language_id.identify(edge_docs, empty_docs).collect()} == {"und"}
    assert language_id.identify(empty_docs, edge_docs).collect() == []


def test_language_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op2_language_id(spark, sf_dir).where("held_out")
    judged = found.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right > 0.97 and n > 200


def test_words_and_windows():
    data, starts = packed(pa.array(["Ab cd,ef", "", "gh"]))
    stream, word, first = toxicity.words_of(data, starts)
    assert stream.tobytes() == b"\0ab\0cd\0ef\0gh\0" and first.tolist() == [0, 3, 3, 4]
    means, text, _ = toxicity.window_means(np.array([1.0, 2, 6, 5]), first)
    assert text.tolist() == [0, 2] and means.tolist() == [3.0, 5.0]


@pytest.fixture(scope="module")
def labelled(spark):
    clean = [(i, f"some plain words about garden number {i} and the weather", 0) for i in range(60)]
    bad = [(100 + i, f"some plain words you {w} about garden number {i}", 1) for i in range(20) for w in ("dreadfool", "nastyperson")]
    return spark.createDataFrame(clean + bad + [(1000, None, 1), (1001, "odd label", 7)], "doc_id long, text string, toxic int")


def test_misspellings_share_vectors(spark, labelled):
    rows = [(1, "about the dreadfol garden"), (2, "about the weather garden"), (3, "you nastypersons"), (4, ""), (5, None), (6, "...")]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labelled).collect()}
    assert got[1].score > 5 * got[2].score and got[2].score < 0.1 and got[3].score > 0.7
    assert got[4].score == got[5].score == got[6].score and 0 <= got[4].score < 0.7


def test_toxicity_edges(edge_docs, empty_docs, edges, labelled):
    got = toxicity.score_toxicity(edge_docs, labelled).collect()
    assert len(got) == len(edges) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.score_toxicity(empty_docs, labelled).collect() == []
    assert {r.score for r in toxicity.score_toxicity(edge_docs, labelled.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_held_out(spark):
    """With some 290 toxic texts to learn from, of which many are too long for the sample."""
    sf_dir = "/root/testdata/sf0.1"
    found = queries.op3_toxicity(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((1, 1), 0) / (counts.get((1, 1), 0) + counts.get((1, 0), 0)) > 0.7
    assert counts.get((0, 1), 0) / (counts.get((0, 1), 0) + counts.get((0, 0), 0)) < 0.03


def test_thinning_keeps_enough_of_each_label(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 100 = 0 THEN 'rare' ELSE 'often' END AS lang")
    kept = {r.lang: r["count"] for r in language_id.thinned(df, "lang", F.xxhash64("doc_id"), 50).groupBy("lang").count().collect()}
    assert kept["rare"] == 200 and 300 < kept["often"] < 520
