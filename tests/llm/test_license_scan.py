"""License scans against all rules tried on all texts, without a gate and without an index of intervals."""

import random
import re
import re._parser as parser

import pytest

from estate_spark.llm import queries
from estate_spark.llm.license_rules import BASE, BASE_PHRASES, CLUE, RULES, WEIGHTS
from estate_spark.llm.license_scan import resolved, scan, scanner

TEXTS = {
    "mit": "Released under the MIT License.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "later": "it is released under the terms of the GNU General Public License version 2 or any later version",
    "nc": "Licensed under CC BY-NC 4.0.",
    "by": "Licensed under CC-BY.",
    "spdx": "// SPDX-License-Identifier: GPL-2.0-or-later",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "address": "see https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "clean": "Mit der Lizenz zum Lesen geht der Apache durch das Land; under the mitlicense, cc byncs 4.",
    "fragment": "the apache license version 20, cc by-n c, under the mit licenses",
}


def sample(pattern, rnd):
    """A string that the pattern matches, drawn by walking its syntax tree."""

    def walk(items):
        out = []
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                out.append(chr(value))
            elif name == "BRANCH":
                out.append(walk(rnd.choice(value[1])))
            elif name == "SUBPATTERN":
                out.append(walk(value[3]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = value
                out.extend(walk(inner) for _ in range(rnd.randint(low, min(int(high), low + 3))))
            elif name == "IN":
                choice = rnd.choice(value)
                out.append({"CATEGORY_DIGIT": "7", "CATEGORY_NOT_SPACE": "w"}[str(choice[1])] if str(choice[0]) == "CATEGORY" else chr(rnd.randint(*choice[1])) if str(choice[0]) == "RANGE" else chr(choice[1]))
            elif name != "ASSERT_NOT":
                raise AssertionError(name)
        return "".join(out)

    return walk(parser.parse(pattern))


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text):
    """Kept detections (label, kind, start, end) by the definition."""
    words = words_of(text)
    line, found = f" {' '.join(words)} ", []
    for number, rule in enumerate(RULES):
        for match in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", line) if words else ():
            start = len(line[: match.start()].split())
            found.append((rule.kind, -len(match[0].split()), start, number))
    kept = []
    for kind, size, start, number in sorted(found):
        inside = any(a <= start and start - size <= b for _, _, a, b in kept)
        if kind == BASE or not inside:
            kept.append((RULES[number].label, kind, start, start - size))
    return len(words), sorted(kept, key=lambda k: (k[2], k[3])), max((WEIGHTS[k[1]] for k in kept), default=0.0)


def test_every_rule_matches_its_own_samples_behind_its_keyword():
    rnd = random.Random(5)
    assert len(RULES) > 200
    for number, rule in enumerate(RULES):
        for _ in range(25):
            line = f" some {sample(rule.pattern, rnd)} words "
            assert rule.keyword in line, (rule, line)
            assert number in scanner().gated(line)
            assert any(d.rule == number for d in scanner().detect(line)), (rule, line)


def test_known_notices():
    labels = {name: sorted({RULES[d.rule].label for d in resolved(scanner().detect(f" {' '.join(words_of(text))} "))}) for name, text in TEXTS.items()}
    assert labels == {
        "mit": ["mit"],
        "apache": ["apache-2", "apache-2.0"],
        "gpl": ["gpl-3.0"],
        "later": ["gpl-2.0-or-later"],
        "nc": ["cc-by-nc", "cc-by-nc-4.0"],
        "by": ["cc-by"],
        "spdx": ["gpl-2.0-or-later"],
        "bsd": ["bsd"],
        "address": ["cc-by-nc-sa"],
        "clean": [],
        "fragment": ["apache"],
    }


@pytest.mark.parametrize("seed", range(4))
def test_mixed_texts_against_brute_force(rows, seed):
    rnd = random.Random(seed)
    data = []
    for i in range(60):
        pieces = []
        for _ in range(rnd.randrange(6)):
            pieces.append(rnd.choice([*TEXTS.values(), *(p for _, p in BASE_PHRASES), "Été MIT 漢字, die", "x" * 50, sample(rnd.choice(RULES).pattern, rnd).upper()]))
        data.append((i, rnd.choice([" ", "\n--- ", ", "]).join(pieces)))
    got = {r.doc_id: (r.n_words, [tuple(d) for d in r.detections], r.score) for r in scan(rows(data, "doc_id long, text string")).collect()}
    for key, text in data:
        n, kept, score = brute(text)
        assert got[key][0] == n and got[key][2] == score
        assert sorted(got[key][1], key=lambda d: (d[2], d[3], d[0])) == sorted(kept, key=lambda d: (d[2], d[3], d[0]))


def test_edges(edge_docs, edges):
    got = sorted(((r.doc_id, r.n_words, r.score) for r in scan(edge_docs).collect()), key=repr)
    assert got == sorted(((key, len(words_of(text)), 0.0) for key, text in edges), key=repr)


def test_an_empty_table(empty_docs):
    assert scan(empty_docs).collect() == []


def test_query(spark, tmp_path):
    texts = [None, "", *TEXTS.values(), "cc by nc cc-by-nc. Apache License Version 2 " + "word " * 40_000 + "under the MIT License", "all rights reserved"]
    docs = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "CC BY NC", "x"), (3, TEXTS["apache"], "x")]
    spark.createDataFrame(docs, "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text, _ in docs:
        n, kept, score = brute(text)
        words = words_of(text)
        places = {i: label for label, phrase in BASE_PHRASES for i in range(n) if words[i : i + len(phrase.split())] == phrase.split()}
        base = sorted(places)
        labels = sorted({label for label, *_ in kept})
        assert set(places.values()) <= set(labels)
        want.append((key, n, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(set(places.values()))), ",".join(labels), score))
    got = [tuple(r) for r in queries.op11_license_scan(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [r[-1] for r in want if r[0] == len(texts) - 1] == [WEIGHTS[CLUE]]
