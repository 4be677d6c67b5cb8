"""Near duplicates, nearest neighbours, components and benchmark leaks against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from estate_spark.llm import decontamination, jaccard, nearest, queries
from estate_spark.llm.components import components


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            root[find(j)] = find(i)
    named = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            named[find(i)] = min(key, named.get(find(i), key))
    return sorted(((key is None, key or 0, len(sets[i]), (named.get(find(i)) if sets[i] else key)) for i, (key, _) in enumerate(rows)), key=str)


def found_components(df, k, percent):
    got = jaccard.near_duplicates(df, k, percent).collect()
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got), key=str)


def corpus(seed):
    """Sets of all sizes, chains of near copies, short texts, and a passage that many texts share."""
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randrange(400)
    passage = " ".join(word() for _ in range(30))
    rows = []
    for n in (1, 2, 3, 4, 5, 6, 8, 9, 11, 13, 15, 17, 21, 30, 60, 120):
        base = [word() for _ in range(n)]
        for _ in range(6):
            rows.append(" ".join(base))
            base = list(base)
            if rnd.random() < 0.8:
                at = rnd.randrange(len(base) + 1)
                base[at : at + rnd.randrange(2)] = [word()] * rnd.randrange(2)
    rows += [f"{' '.join(word() for _ in range(12))} {passage} {' '.join(word() for _ in range(12))}" for _ in range(40)]
    center = [word() for _ in range(90)]
    for i in range(60):
        near = list(center)
        near[i % 90] = word()
        near[(7 * i) % 90] = word()
        rows.append(" ".join(near).upper() if i % 7 == 0 else " ".join(near))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, k, percent):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 4)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_components(df, k, percent) == brute_components(rows, k, percent)


def test_near_duplicate_edges(edge_docs, edges, empty_docs):
    assert found_components(edge_docs, 4, 85) == brute_components(edges, 4, 85)
    assert jaccard.near_duplicates(empty_docs, 4, 85).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 85, 90])
def test_sizes_and_boundary(percent):
    for n in range(1, 40):
        assert jaccard.prefix_length(n, percent) == n - -(-percent * n // 100) + 1 + n // 25
        for low, high, size in jaccard.subset_sizes(n, percent, 39):
            assert 100 * size >= percent * (low + high - size) and 100 * (size - 1) < percent * (low + high - size + 1)
    few = jaccard.boundary_of({n: 1 for n in range(1, 60)}, percent)
    assert 0 <= few <= jaccard.LARGEST_SMALL


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def brute_nearest(rows, queries_of, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    return {i: sorted(((-(v @ q), j) for j, v in good if j != i))[:k] for i, q in good if queries_of(i)}


def test_nearest_edges_and_ties(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.standard_normal(6).astype("f4").tolist()) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # one vector many times, some of them queries
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (304, [1.0]), (305, [float("inf")] * 6), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, score string, cell int")
    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 20 = 0"), k=7, sure=1 - 1e-12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest([r for r in rows if r[0] != 304], lambda i: i % 20 == 0, 7)
    assert set(got) == set(want)
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 8)) and [f[1] for f in found] == [j for _, j in want[i]]
        assert np.allclose([f[2] for f in found], [-s for s, _ in want[i]])
    assert nearest.nearest(df.limit(0), df, k=7).collect() == []


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest.nearest(df, df.where("vec_id = 0"), k=20).collect()] == [(0, 1, 1, 0.5)]


def test_recall_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 250)
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in queries.op4_nearest(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[i] & {j for _, j in best}) / len(best) for i, best in want.items()])
    assert recall >= 0.9 and set(got) == set(want)


def test_chi_square_distribution():
    x = np.random.default_rng(1).standard_normal((20_000, nearest.PROJECTIONS))
    assert abs(((x**2).sum(1) <= nearest.surely(0.9)).mean() - 0.9) < 0.01


def edits_anywhere(window, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j - 1] + (a != b), above[j] + 1, row[-1] + 1))
    return min(row)


def test_leaks_are_those_of_plain_alignment(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((10, 14, 20, 25, 40, 3))]
    docs = []
    for i, text in items:
        for changed in (0, 2, 4, 8, 14, 30):
            letters = list(text)
            for at in rnd.sample(range(len(letters)), min(changed, len(letters))):
                letters[at] = rnd.choice(["", "z", letters[at] + "z", letters[at].upper()])
            docs.append((len(docs), " ".join([word() for _ in range(8)]) + " " + "".join(letters) + " " + " ".join([word() for _ in range(8)])))
    docs += [(500 + i, " ".join(word() for _ in range(60))) for i in range(5)]
    index = decontamination.ItemIndex.build([i for i, _ in items], [t for _, t in items])
    want = set()
    plain = lambda t: b" " + b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode())) + b" "
    for which, (item, text) in enumerate(items):
        body = index.stream[index.starts[which] : index.starts[which + 1]].tobytes()
        assert body == plain(text)
        for begin, end in index.windows(which) if len(body) >= decontamination.LEAST_BYTES else ():
            want |= {(d, item) for d, t in docs if edits_anywhere(body[begin:end], plain(t)) <= decontamination.edits_of(end - begin)}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_windows string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and {i for _, i in got} == {0, 1, 2, 3, 4}


def test_leaks_in_long_texts_and_edges(spark, edge_docs, empty_docs):
    item = "a passage of the benchmark that is long enough to be found wherever it stands in a text of any length"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    filler = "nothing to see here " * 60_000
    docs = spark.createDataFrame([(1, filler + item + " " + filler), (2, item.upper().replace(" ", ", ")), (3, filler), (4, item), (4, item)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontamination.find_leaks(docs, items).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (4, 1, 0), (4, 1, 0)]
    assert decontamination.find_leaks(edge_docs, items).collect() == []
    assert decontamination.find_leaks(empty_docs, items).collect() == []
    assert decontamination.find_leaks(docs, items.limit(0)).collect() == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    items = [(i, f"item {i} has words of its own such as {'abcdefgh'[i] * 9} and {'hgfedcba'[i] * 11} in it") for i in range(8)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    got = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect() if r.edits == 0} == {(i, i) for i in range(8)}
    assert got.where(F.col("edits") < 0).count() == 0
