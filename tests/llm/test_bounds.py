"""Ties, repetitive pages, scores by plain loops, clashing names, and how readers are dealt out."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from estate_spark.llm import batches, caches, decontamination, nearest, toxicity


@pytest.mark.parametrize("cell_rows", [64, 8192])
def test_ties_of_different_vectors_go_to_the_smaller_id(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(nearest, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 16)
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randrange(2)) for _ in range(12)]) for i in range(400)]
    rows = [(i, v if any(v) else [1.0] + v[1:]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 20 = 0"), k=20, sure=1 - 1e-12).collect():
        got[r.query_id, r.rank] = (r.vec_id, r.score)
    want = {}
    for i, q in rows:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:20]
            want.update({(i, n): (j, -s) for n, (s, j) in enumerate(best, 1)})
    assert got == want


def test_a_page_of_one_repeated_word_is_worked_on_in_bounded_memory():
    index = decontamination.ItemIndex.build(["it"], ["ha " * 200])
    page = pa.array(["ha " * 30_000, "no laughter here"])
    tracemalloc.start()
    hits = decontamination.hits_of(index, page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000_000
    assert set(hits) == {(0, 0)}
    # every window of the item occurs
    assert len(hits[0, 0]) == len(index.windows(0)) and set(hits[0, 0].values()) == {0}


def test_halved_parts_find_what_one_part_finds(monkeypatch):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    items = [" ".join(rnd.choices(words, k=60)) for _ in range(5)] + ["na " * 60]
    texts = []
    for _ in range(30):
        parts = [" ".join(rnd.choices(words, k=rnd.randrange(200)))]
        for _ in range(rnd.randrange(3)):
            item = rnd.choice(items).split()
            at = rnd.randrange(len(item) // 2)
            parts += [" ".join(item[at : at + 50]), " ".join(rnd.choices(words, k=40))]
        texts.append(" ".join(parts))
    index = decontamination.ItemIndex.build(items, items)
    whole = decontamination.hits_of(index, pa.array(texts))
    monkeypatch.setattr(decontamination, "ENTRIES", 50)
    assert decontamination.hits_of(index, pa.array(texts)) == whole and whole


def test_equal_items_are_each_reported_once_a_row(rows):
    item = "which of the nine rivers of the plain runs north to the sea of reeds"
    docs = rows([(1, f"well {item} indeed"), (None, item), (2, "no"), (3, None), (1, f"well {item} indeed")], "doc_id long, text string")
    bench = rows([(7, item), (8, item), (None, item), (9, None), (7, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 1, None) for i in (7, 7, 8, None)], key=str)
    kept = decontamination.without_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2, "no"), (3, None)]


def plain_score(scorer, text):
    """Worst mean over windows of words, each the mean weight of its n-grams."""
    low = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in text.encode())
    values = []
    for word in low.split():
        marked = b"\0" + word + b"\0"
        weights = []
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                key = (int.from_bytes(marked[i : i + n], "big") + n) * 0x9E3779B97F4A7C15 % (1 << 64)
                weights.append(float(scorer.weight[key >> 64 - toxicity.BUCKETS.bit_length() + 1]))
        values.append(sum(weights) / max(len(weights), 1))
    windows = [values[i : i + toxicity.WINDOW] for i in range(max(1, len(values) - toxicity.WINDOW + 1))] if values else [[0.0]]
    return 1 / (1 + math.exp(-(max(sum(w) / len(w) for w in windows) + scorer.bias)))


def test_scores_by_plain_loops(edges):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices(["sun", "Horrid", "été", "x1", "a", "you're"], k=rnd.randrange(12))) for _ in range(80)]
    labels = [int("Horrid" in t) for t in texts]
    scorer = toxicity.fit([t.encode() for t in texts], labels, epochs=8)
    tried = texts + [t or "" for _, t in edges] + ["", " ", "a", "..."]
    data, starts = batches.packed(pa.array(tried))
    assert np.allclose(scorer.score(data, starts), [plain_score(scorer, t) for t in tried], atol=1e-9)


def test_a_class_of_long_texts_is_learned(rows):
    long = "horrid " * 1_000
    data = [(i, long, 1) for i in range(30)] + [(100 + i, "kind words", 0) for i in range(60)]
    labelled = rows(data, "doc_id long, text string, label int")
    texts, labels = toxicity.sample_labelled(labelled, "doc_id", "text", "label", 20, 2_500)
    assert sum(labels) == 20 * 2_500 // len(long) and labels.count(0) == 20
    one, _ = toxicity.sample_labelled(labelled.where("label = 1"), "doc_id", "text", "label", 2, 100)
    assert len(one) == 1  # longer than all there is room for


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    names = "doc_id long, text string, lang string, key string, pipeline_row string, place long, t string, `a b` string"
    docs = spark.createDataFrame([(i, f"plain words number {i} go on and on here", "en", "k", "p", 5, "u", "v") for i in range(8)], names)
    spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name != "near_duplicates":
            assert sorted(out.collect()) == want, name


def test_each_file_has_a_reading_task(spark):
    files = spark.range(300).select(F.concat(F.lit("f"), F.col("id")).alias("file"))
    dealt = batches.a_task_each(files)
    assert dealt.rdd.getNumPartitions() >= 290
    assert max(len(part) for part in dealt.rdd.glom().collect()) <= 4


def test_claiming_a_worker_drops_what_others_hold():
    dropped = []
    caches.held_by("test_one", lambda: dropped.append(1))
    caches.held_by("test_two", lambda: dropped.append(2))
    caches.claim("test_one")
    assert dropped == [2]


def test_labels_of_their_own_give_the_same_sample_without_moving_texts(spark, monkeypatch):
    rows = [(i % 700 if i % 50 else None, f"text {i} " * (1 + i % 9)) for i in range(900)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, i % 3) for i in range(0, 800, 2)] + [(4, 0), (4, 1), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, label int")
    joined = texts.join(labels, "doc_id")
    seen = []
    monkeypatch.setattr(toxicity, "thinning", lambda df, *rest: (seen.append(df.columns), batches.thinning(df, *rest))[1])
    for count, longest in ((5, 40), (1_000, 2_500)):
        want = toxicity.sample_labelled(joined, "doc_id", "text", "label", count, longest)
        assert toxicity.sample_labelled(texts, "doc_id", "text", "label", count, longest, labels) == want and want[0]
    assert seen and all("text" not in columns for columns in seen)


def test_members_of_one_list_meet_by_root(monkeypatch):
    from estate_spark.llm import jaccard

    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 7)
    rnd = np.random.default_rng(1)
    for n in range(30):
        rows = sorted(map(tuple, rnd.integers(0, 3, (n, 3)).tolist()))
        columns = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 4]) for c in columns], ["t", "a", "n"]) for i in range(0, n, 4)]
        kept = [[*zip(*(c.tolist() for c in part))] for part in jaccard.whole_lists(iter(batches))]
        assert sum(kept, []) == rows and all(not p or not q or p[-1][0] != q[0][0] for p, q in zip(kept, kept[1:]))
        found = [list(zip(x.tolist(), y.tolist())) for x, y in jaccard.across(*columns)]
        assert sorted(sum(found, [])) == [(i, j) for i in range(n) for j in range(i + 1, n) if rows[i][0] == rows[j][0] and rows[i][1:] != rows[j][1:]]
        assert all(len(part) <= max(7, n) for part in found)
