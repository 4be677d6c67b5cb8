"""License scans: ordered signature rules behind a keyword prefilter.

A text's words are lower-cased and joined by single spaces. One pass of a
keyword automaton tells which rules can match at all, and only those regexes
are tried. Detections are intervals of words. They are taken in order of
priority (kind, then the longer, then the earlier, then the rule's place), and
one that lies within an interval already taken is suppressed. The base phrases
come first and are never suppressed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.llm.batches import packed, slices
from estate_spark.llm.license_rules import BASE, RULES, WEIGHTS

# All but digits, letters of ASCII and bytes of longer characters part words.
WORDS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


class Detection(NamedTuple):
    start: int  # first word, from 0
    end: int  # one past the last word
    rule: int


class Scanner:
    """The rules, compiled once in each worker."""

    def __init__(self):
        self.patterns = [re.compile(f"(?<= )(?:{rule.pattern})(?= )") for rule in RULES]
        by_keyword: dict[str, list[int]] = {}
        for number, rule in enumerate(RULES):
            by_keyword.setdefault(rule.keyword, []).append(number)
        self.automaton = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            self.automaton.add_word(keyword, tuple(numbers))
        self.automaton.make_automaton()

    def gated(self, line: str) -> list[int]:
        """Rules whose keyword occurs."""
        return sorted({number for _, numbers in self.automaton.iter(line) for number in numbers})

    def detect(self, line: str, rules: list[int] | None = None) -> list[Detection]:
        """All matches of the rules (by default those whose keyword occurs) in words between single spaces."""
        found = []
        for number in self.gated(line) if rules is None else rules:
            for match in self.patterns[number].finditer(line):
                found.append((match.start(), match.end(), number))
        found.sort()
        detections, words, at = [], 0, 0
        for start, end, number in found:
            words += line.count(" ", at, start)
            at = start
            detections.append(Detection(words - 1, words + line.count(" ", start, end), number))
        return detections


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def resolved(detections: list[Detection]) -> list[Detection]:
    """Detections that are kept, by start: those not within one of higher priority; base phrases all stay."""
    order = sorted(detections, key=lambda d: (RULES[d.rule].kind, d.start - d.end, d.start, d.rule))
    kept: list[Detection] = []
    starts: list[int] = []  # of kept intervals none of which lies within another: ends ascend with them
    ends: list[int] = []
    for found in order:
        i = bisect.bisect_right(starts, found.start)
        if i and ends[i - 1] >= found.end and RULES[found.rule].kind != BASE:
            continue
        kept.append(found)
        if i and ends[i - 1] >= found.end:
            continue
        low, high = bisect.bisect_left(starts, found.start), bisect.bisect_right(ends, found.end)
        starts[low:high], ends[low:high] = [found.start], [found.end]
    return sorted(kept)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's ``key``, ``n_words``, ``detections`` and ``score``.

    ``detections`` are the kept ones by place: label, kind (0 for base phrases),
    start and end in words. ``score`` is the weight of the strongest kind among
    them, 0 without any. Null and empty texts have no words and no detections;
    null keys and repeated rows are scanned row by row; an empty table gives an
    empty result; other columns are not read. Whole texts are scanned, nothing
    is shuffled.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            for low, high in slices(offsets):
                body, cuts = data[offsets[low] : offsets[high]].tobytes(), (offsets[low : high + 1] - offsets[low]).tolist()
                body = body.lower().translate(WORDS)
                yield scanned(batch.column(0).slice(low, high - low), [body[a:b].split(b" ") for a, b in zip(cuts, cuts[1:])])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {key_type}, n_words long, detections array<struct<label:string,kind:int,start:bigint,end:bigint>>, score double"
    return rows.mapInArrow(work, schema).withColumnRenamed("key", key)


def scanned(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    """One output row for each text's words (with empty ones between neighbouring spaces)."""
    sizes, found, scores = [], [], []
    for text in texts:
        words = [word for word in text if word]
        sizes.append(len(words))
        kept = resolved(scanner().detect(f" {b' '.join(words).decode('utf-8', 'replace')} ")) if words else []
        found.append([(RULES[d.rule].label, RULES[d.rule].kind, d.start, d.end) for d in kept])
        scores.append(max((WEIGHTS[RULES[d.rule].kind] for d in kept), default=0.0))
    struct = pa.struct([("label", pa.string()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    rows = [[dict(zip(("label", "kind", "start", "end"), d)) for d in text] for text in found]
    columns = [keys, pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(struct)), pa.array(scores, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["key", "n_words", "detections", "score"])
