"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, with marks at both ends, hashed
into a table of vectors; so a misspelling never seen shares most of its vectors
with the word that was. A window of a few words is the average of its words,
and a linear softmax turns that into two classes. A document is as toxic as its
most toxic window: an insult in a long text is not averaged away. Vectors and
softmax are fitted together by full-batch Adam on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estate_spark.llm.batches import keyed_schema, packed, slices, text_rows, texts_of, thinned, thinning
from estate_spark.llm.caches import claim

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIMENSIONS = 8
WINDOW = 3  # words; windows overlap by all but one
SAMPLE_ROWS = 1_000  # labelled rows of each class that are learned from
SAMPLE_BYTES = 2_500  # longest text among them
EPOCHS = 40
RATE = 0.03
DECAY = 5e-5
SEED = 17
SLICE_BYTES = 1 << 18  # of texts scored at once, beyond a single longer one: some 100 bytes of memory for each
THRESHOLD = 0.7

# Letters and digits in ASCII, lower-cased, and all bytes of longer characters make words; other bytes part them.
LOWER = np.zeros(256, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    LOWER[_b] = _b
LOWER[65:91] = np.arange(97, 123)


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stream of word bytes with one 0 before, between and after words; each position's word; each text's first word."""
    texts = len(starts) - 1
    body = np.zeros(len(data) + texts + 1, np.uint8)
    body[np.arange(len(data)) + np.repeat(np.arange(1, texts + 1), np.diff(starts))] = LOWER[data]
    inside = body > 0
    keep = inside | np.r_[True, inside[:-1]]  # one 0 of each gap
    heads = inside & ~np.r_[False, inside[:-1]]
    words = np.cumsum(heads)
    first = np.concatenate([words[starts[:-1] + np.arange(texts)], words[-1:]])
    return body[keep], words[keep] - 1, first


def grams_of(stream: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the word of each; a word shorter than the n-grams is its own gram."""
    buckets, owners = [], []
    for n in GRAMS:
        if len(stream) < n:
            continue
        size = len(stream) - n + 1
        key = stream[:size].astype(np.uint64)
        whole = stream[1 : size + 1] > 0
        for k in range(1, n):
            key = key << np.uint64(8) | stream[k : k + size]
            if k < n - 1:
                whole &= stream[k : k + size] > 0
        at = np.flatnonzero(whole)
        mixed = (key[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        owners.append(word[at + 1])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def window_means(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of each window of words, its text, and its first word; a text of fewer words is one window."""
    counts = np.diff(first)
    windows = np.where(counts > 0, np.maximum(counts - WINDOW + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), windows)
    begin = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + first[:-1][text]
    end = np.minimum(begin + WINDOW, first[1:][text])
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[end] - total[begin]) / np.maximum(end - begin, 1), text, begin


@dataclass(frozen=True)
class Scorer:
    """A fitted model folded into one number for each n-gram: what it adds to the log-odds of class 1."""

    weight: np.ndarray
    bias: float

    def word_values(self, stream: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        bucket, owner = grams_of(stream, word)
        total = np.bincount(owner, self.weight[bucket], words)
        return total / np.maximum(np.bincount(owner, minlength=words), 1)

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each text; a text without words has no window and only the bias."""
        stream, word, first = words_of(data, starts)
        means, text, _ = window_means(self.word_values(stream, word, int(first[-1])), first)
        top = np.full(len(starts) - 1, -np.inf)
        np.maximum.at(top, text, means)
        top[np.isinf(top)] = 0
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -40, 40)))


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Scorer:
    """Embeddings and softmax from labelled texts; classes weigh alike."""
    lengths = np.cumsum([0, *map(len, texts)])
    stream, word, first = words_of(np.frombuffer(b"".join(texts), np.uint8), lengths)
    spelled = np.flatnonzero((stream[1:] > 0) & (stream[:-1] == 0)) + 1
    ends = np.flatnonzero((stream[:-1] > 0) & (stream[1:] == 0)) + 1
    body = stream.tobytes()
    names: dict[bytes, int] = {}
    token = np.array([names.setdefault(body[a:b], len(names)) for a, b in zip(spelled.tolist(), ends.tolist())], np.int64)
    joined = b"\0" + b"\0".join(names) + b"\0"
    plain = np.frombuffer(joined, np.uint8)
    bucket, owner = grams_of(plain, np.cumsum((plain > 0) & np.r_[False, plain[:-1] == 0]) - 1)
    used, bucket = np.unique(bucket, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    bucket, owner = bucket[order], owner[order]
    size = np.maximum(np.bincount(owner, minlength=len(names)), 1)

    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (len(used), DIMENSIONS)).astype(np.float32)
    softmax = random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    target = np.array(labels, np.float64)
    weights = np.where(target > 0, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
    parameters = [vectors, softmax, offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    heads = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(names)))])[:-1]
    texts_with_words = np.diff(first) > 0

    for epoch in range(1, epochs + 1):
        mean = np.add.reduceat(vectors[bucket], np.minimum(heads, len(bucket) - 1), axis=0) / size[:, None]
        odds = (mean @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
        values, text, begin = window_means(odds[token], first)
        # soft choice of windows at first, the most toxic one in the end
        sharp = 2.0 if epoch <= epochs // 3 else 20.0
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, text, values)
        share = np.exp(sharp * (values - top[text]))
        share /= np.bincount(text, share, len(texts))[text]
        pooled = np.where(texts_with_words, np.bincount(text, share * values, len(texts)), 0) + float(offset[1] - offset[0])
        error = weights * (1 / (1 + np.exp(-np.clip(pooled, -40, 40))) - target)
        pull = error[text] * share
        spread = np.zeros(len(token) + 1)
        length = np.minimum(begin + WINDOW, first[1:][text]) - begin
        np.add.at(spread, begin, pull / length)
        np.add.at(spread, begin + length, -pull / length)
        by_word = np.bincount(token, np.cumsum(spread)[:-1], len(names))
        slope = softmax[:, 1] - softmax[:, 0]
        to_softmax = (mean * by_word[:, None]).sum(0)
        per_gram = (by_word / size)[owner]
        to_bucket = np.bincount(bucket, per_gram, len(used))
        gradients = [
            np.outer(to_bucket, slope) + DECAY * vectors,
            np.stack([-to_softmax, to_softmax], 1) + DECAY * softmax,
            np.array([-error.sum(), error.sum()]),
        ]
        for parameter, gradient, (m, v) in zip(parameters, gradients, moments):
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient**2 - v)
            parameter -= (RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-9)).astype(np.float32)

    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Scorer(weight, float(offset[1] - offset[0]))


def sample_labelled(labelled: DataFrame, key: str, text: str, label: str, rows: int, longest: int, labels: DataFrame | None = None) -> tuple[list[bytes], list[int]]:
    """At most ``rows`` whole texts of each class, spread by a hash of the key.

    All of them together have at most ``rows * longest`` bytes, or are one.
    Texts of at most ``longest`` bytes come first, longer ones while there is
    room, so that no class is lost for the length of its texts.

    Labels may lie in a table of their own, with the same ``key``. Then keys and
    sizes alone are joined, and only texts that can be in the sample meet a label.
    """
    size, spread = F.octet_length(text), F.xxhash64(key)
    usable = F.col(label).isin(0, 1) & (F.col("size") > 0)
    if labels is None:
        few = thinned(labelled.withColumns({"size": size, "long": size > longest}).where(usable), [label, "long"], spread, rows)
    else:
        sized = labelled.withColumns({"size": size, "long": size > longest})
        known = sized.select(key, "size", "long").join(labels, key).where(usable)
        keep = thinning(known, [label, "long"], spread, rows)
        wanted = labels.join(F.broadcast(known.where(keep).select(key).distinct()), key, "left_semi")
        few = sized.join(F.broadcast(wanted), key).where(usable & keep)
    by_class = Window.partitionBy(label).orderBy("long", spread, text)
    ranked = few.select(F.col(label).alias("y"), F.col(text).alias("t"), F.row_number().over(by_class).alias("r"), F.sum(size).over(by_class).alias("bytes"))
    kept = ranked.where((F.col("r") == 1) | ((F.col("r") <= rows) & (F.col("bytes") <= rows * longest)))
    found = sorted((r.y, r.t) for r in kept.select("y", "t").collect())
    return [t.encode("utf-8") for _, t in found], [y for y, _ in found]


def score_toxicity(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES, learn_key: str | None = None, learn_text: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Each row's ``key``, ``score`` (0 to 1, higher is more toxic) and ``predicted`` (1 from ``THRESHOLD`` on).

    ``labelled`` holds texts with 0/1 labels, in the same columns unless
    ``learn_key`` and ``learn_text`` name others; ``labels`` may hold the labels
    by that key instead. A bounded sample is fitted. Null and empty texts and texts without a word get the score of no
    evidence, which is that of the bias alone. Without labels of both classes
    every score is 0. Repeated rows and null keys are scored each; an empty
    table gives an empty result; other columns are not read. ``key`` may be a
    struct of all columns, to carry a whole row through. Only ``text`` is an
    input of a score.
    """
    texts, marks = sample_labelled(labelled, learn_key or key, learn_text or text, label, rows, longest, labels)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, marks) if len(set(marks)) == 2 else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        scorer = shared.value
        for batch in batches:
            data, starts = packed(texts_of(batch, text))
            score = np.zeros(len(starts) - 1)
            for low, high in slices(starts, SLICE_BYTES) if scorer is not None else ():
                score[low:high] = scorer.score(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["key", "score", "predicted"])

    return text_rows(docs, key, text).mapInArrow(run, keyed_schema(docs, key, "score double, predicted int")).withColumnRenamed("key", key)
