"""Periodic runs against a definition applied word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from estate_spark.llm import queries
from estate_spark.llm.periodic_runs import find_runs, runs_of


def brute(words, least=6, exponent=4):
    """All (start, length, smallest period): every period is tried, longer ones only for stretches not seen."""
    n, runs = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, exponent * q):
                runs.setdefault((start, i + q - start), q)
    return sorted((s, size, q) for (s, size), q in runs.items())


def found(texts, **limits):
    starts = np.cumsum([0, *map(len, texts)])
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    owner, start, stop, period = runs_of(ids, starts, **limits)
    result = [[] for _ in texts]
    for o, a, b, p in zip(owner.tolist(), start.tolist(), stop.tolist(), period.tolist()):
        result[o].append((a - int(starts[o]), b - a, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in result]


def expected(words, **limits):
    return sorted(brute(words, **limits), key=lambda x: (x[0], x[2]))


def thue_morse(n):
    return [str(bin(i).count("1") % 2) for i in range(n)]


def fibonacci(n):
    a, b = "0", "01"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


CASES = [
    [],
    ["a"],
    ["a"] * 5,
    ["a"] * 6,
    ["a"] * 1000,
    ["a", "b"] * 4,
    (["a"] * 6 + ["b"]) * 9,
    ((["a"] * 6 + ["b"]) * 5 + ["c"]) * 4,
    ["x"] + ["a", "b", "c"] * 4 + ["a", "b"] + ["b", "c"] * 5 + ["y"],
    thue_morse(700),
    fibonacci(700),
    ["a"] * 7 + ["b"] * 7 + ["a"] * 7 + ["b"] * 7,
]


def test_shapes():
    assert found(CASES) == [expected(case) for case in CASES]


@pytest.mark.parametrize("seed", range(12))
def test_random_words_with_planted_runs(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(40):
        alphabet = [str(i) for i in range(rnd.choice([1, 2, 3, 8, 100]))]
        words = rnd.choices(alphabet, k=rnd.randrange(150))
        for _ in range(rnd.randrange(3)):
            at, block = rnd.randrange(len(words) + 1), rnd.choices(alphabet, k=rnd.randrange(1, 12))
            words[at:at] = (block * rnd.randrange(2, 9))[: rnd.randrange(1, 80)]
        texts.append(words)
    assert found(texts) == [expected(t) for t in texts]
    assert found(texts, least=4, exponent=3) == [expected(t, least=4, exponent=3) for t in texts]


def test_a_long_text_of_one_word_is_one_run():
    assert found([["a"] * 400_000 + ["b"], ["b"]]) == [[(0, 400_000, 1)], []]


def test_edges(edge_docs, edges):
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(edge_docs).collect()), key=repr)
    want = []
    for key, text in edges:
        words = (text or "").encode().split()
        runs = expected(words)
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        want.append((key, len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in drop).decode()))
    assert got == sorted(want, key=repr)


def test_an_empty_table(empty_docs):
    assert find_runs(empty_docs).collect() == []


def digest(text):
    return hashlib.sha256(text).hexdigest()


def test_query(spark, tmp_path):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choices(["a", "b", "c\t", "é\n"], k=rnd.randrange(60)))) for i in range(300)] + [(9, None), (None, "a " * 9), (10, "\r\x0b\x0c a\x1cb")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text in docs:
        words = (text or "").encode().split()
        if key is not None and words:
            h = zlib.crc32(str(key).encode())
            if h % 10 == 0:
                a = h // 10 % len(words)
                p = 1 + (len(words) - a) // (3 + h // 10 % 8)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = expected(words)
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        collapsed = b" ".join(w for i, w in enumerate(words) if i not in drop)
        milli = 1000 * best[1] // best[2] if runs else None
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        want.append((key, len(runs), *best, milli, digest(listed), digest(collapsed)))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
