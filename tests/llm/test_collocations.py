"""Phrase counts and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from estate_spark.llm import collocations, queries
from estate_spark.llm.hat_trie import HatTrie, packed_rest, unpacked_rest


def phrases(docs):
    """Words per language, and occurrences of (language, words) for one to four words."""
    totals, counts = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for n in range(1, 5):
                counts.update((lang, words[i : i + n]) for i in range(len(words) - n + 1))
    return totals, counts


def brute(docs, least=30, cover=80, top=2000):
    totals, counts = phrases(docs)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    rows = []
    for (lang, words), a in candidates.items():
        n = len(words)
        longer = [b for (other, w), b in candidates.items() if other == lang and len(w) > n and any(w[i : i + n] == words for i in range(len(w) - n + 1))]
        if any(100 * b >= cover * a for b in longer):
            continue
        cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, n)]
        score, k = min(cuts)
        rows.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, result = Counter(), []
    for lang, *rest in rows:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], *rest))
    return result


def corpus(seed, size=300):
    rnd = random.Random(seed)
    docs = []
    for i in range(size):
        lang = rnd.choice(["en", "de", "und", None])
        vocabulary = [*"abcdefg", "É", "ü\x00", "A\x1cB", "|", "x'y"] + [f"w{rnd.randrange(400)}" for _ in range(3)]
        words = []
        for _ in range(rnd.randrange(40)):
            words.append(rnd.choice([rnd.choice(vocabulary), "red fox runs", "Red Fox Runs Far"]))
        docs.append(("".join(w + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "! "]) for w in words), lang))
    return docs + [(None, "en"), ("", None), ("  \n ", "de"), docs[0], docs[0]]


def taken(spilled):
    first, keys, counts = spilled
    columns = zip(first.tolist(), *(c.tolist() for c in unpacked_rest(keys)), counts.tolist())
    return Counter({tuple(w for w in row[:4] if w): row[4] for row in columns})


@pytest.mark.parametrize("burst", [2, 2048])
def test_trie_counts_bursts_and_spills(burst):
    rnd = np.random.default_rng(1)
    trie, want, got = HatTrie(burst), Counter(), Counter()
    for _ in range(20):
        words = rnd.integers(1, 12, (500, 4))
        words[rnd.random(500) < 0.3, 3] = 0
        trie.add(words[:, 0], packed_rest(words[:, 1], words[:, 2], words[:, 3]))
        trie.add_words(words[:, 1])
        want.update(tuple(w for w in row if w) for row in words.tolist())
        want.update((w,) for w in words[:, 1].tolist())
        got.update(taken(trie.spill(keep=2_000)))
        assert trie.entries <= 2_000
        assert trie.entries == sum(trie.sizes.values())
    got.update(taken(trie.spill(0)))
    assert got == want and trie.entries == 0


def mined(rows, docs, **limits):
    frame = rows([(t, lang, "x", 1) for t, lang in docs], "text string, lang string, phrase string, n long")
    return sorted(tuple(r) for r in collocations.mine(frame, **limits).collect())


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_counts(rows, seed):
    docs = corpus(seed)
    want = brute(docs)
    assert len(want) > 20
    assert mined(rows, docs) == sorted(want)
    assert mined(rows, docs, least=3, cover=60, top=40) == sorted(brute(docs, 3, 60, 40))


def test_spills_windows_and_renewed_words_change_nothing(monkeypatch):
    docs = corpus(7, 120)
    for name, value in (("ENTRIES", 50), ("VOCABULARY", 20), ("WINDOW", 17), ("WAITING", 30)):
        monkeypatch.setattr(collocations, name, value)
    level, got = collocations.Level((2, 3, 4), None, None), Counter()

    def take(batches):
        for batch in batches:
            for lang, head, tail, n in zip(*(c.to_pylist() for c in batch.columns)):
                got[lang, tuple(" ".join(filter(None, (head, tail))).split(" "))] += n

    for text, lang in docs:
        take(level.add("und" if lang is None else lang, [(text or "").encode()]))
    take(level.rest())
    want = Counter({k: n for k, n in phrases(docs)[1].items() if len(k[1]) > 1})
    assert got == want


def test_nothing_frequent_and_nothing_at_all(rows):
    assert mined(rows, [("one two three", "en"), (None, None)]) == []
    assert mined(rows, []) == []


def test_one_phrase_in_a_long_text(rows):
    docs = [("go on " * 30_000, None), ("stop . " * 40, "en")]
    assert mined(rows, docs) == sorted(brute(docs))


def test_registered_with_sql():
    assert "op12_collocations" in queries.ORACLES
