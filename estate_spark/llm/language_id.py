"""Language identification by prediction by partial matching (PPM) over bytes.

One context tree for each language, of contexts up to ``ORDER`` bytes, is
counted on a bounded sample and then frozen. A byte's probability in a context
is PPM's (method C): seen bytes share n / (n + d), where d is the number of
distinct bytes seen; the rest d / (n + d) escapes to the context one byte
shorter, with the bytes already seen excluded, and at last to all 256 bytes
alike. A text's exact code length under each language is the sum over its bytes
of -log2 of that; the shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estate_spark.llm.batches import keyed_schema, packed, slices, text_rows, texts_of, thinned
from estate_spark.llm.caches import claim

ORDER = 3
SAMPLE_ROWS = 300  # labelled rows of each language that are learned from
SAMPLE_BYTES = 12_000  # longest text among them
MIN_COUNT = 6  # contexts seen less often, over all languages, are left to shorter ones
EVIDENCE_BYTES = 48  # the score is the posterior of so many average bytes
START = 10  # the byte taken to come before a text: a line break
UNDETERMINED = "und"


@dataclass(frozen=True)
class ContextTrees:
    """All languages' trees over their joint contexts: where each byte leads, and what it costs."""

    languages: list[str]
    symbol: np.ndarray  # byte to symbol; bytes never seen share the last one
    child: np.ndarray  # [context, symbol] to the context one byte longer to the left, or 0
    bits: np.ndarray  # [context, symbol, language]


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Each run of ``order`` + 1 bytes as one number, oldest byte first."""
    key = data[: len(data) - order].astype(np.int64)
    for k in range(1, order + 1):
        key = key << 8 | data[k : len(data) - order + k]
    return key


def train(texts: dict[str, list[bytes]], order: int = ORDER, min_count: int = MIN_COUNT) -> ContextTrees:
    """Trees of the languages' sample texts."""
    languages = sorted(texts)
    lead = bytes([START]) * order
    streams = [np.frombuffer(b"".join(lead + t for t in texts[lang]), np.uint8) for lang in languages]
    seen = np.unique(np.concatenate(streams))
    symbol = np.full(256, len(seen), np.int32)
    symbol[seen] = np.arange(len(seen))
    width, unseen = len(seen) + 1, 256 - len(seen)
    above = np.full((1, width, len(languages)), 1 / 256)  # probabilities of the contexts one byte shorter
    above[0, -1] = unseen / 256
    shorter, bits, children, first = {0: 0}, [], [], 0
    for k in range(order + 1):
        counts = [np.unique(grams(s, k), return_counts=True) for s in streams]
        total: dict[int, int] = {}
        for key, n in counts:
            for context, many in zip(*(v.tolist() for v in sums(key >> 8, n))):
                total[context] = total.get(context, 0) + many
        kept = sorted(c for c, n in total.items() if k == 0 or (n >= min_count and (c & (1 << 8 * (k - 1)) - 1) in shorter))
        place = {context: i for i, context in enumerate(kept)}
        index = np.array(kept, np.int64)
        table = np.zeros((len(kept), width, len(languages)))
        for lang, (key, n) in enumerate(counts) if kept else ():
            at = np.searchsorted(index, key >> 8)
            known = (at < len(index)) & (index[np.minimum(at, len(index) - 1)] == key >> 8)
            table[at[known], symbol[key[known] & 255], lang] = n[known]
        suffix = np.array([shorter[c & (1 << 8 * (k - 1)) - 1] if k else 0 for c in kept], np.int64)
        parent = above[suffix] if len(kept) else above[:0]
        n, d = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        rest = np.where(table > 0, 0, parent)
        escape = np.where(rest.sum(1, keepdims=True) > 0, d / np.maximum(n + d, 1), 0)
        coded = table / np.maximum(n + d * (escape > 0), 1) + escape * rest / np.maximum(rest.sum(1, keepdims=True), 1e-300)
        probability = np.where(n > 0, coded, parent)
        per_byte = probability.copy()
        per_byte[:, -1] /= max(unseen, 1)
        bits.append(-np.log2(np.maximum(per_byte, 1e-300)).astype(np.float32))
        children.append(np.zeros((len(kept), width), np.int32))
        if k:
            oldest = index >> 8 * (k - 1)
            children[k - 1][suffix, symbol[oldest]] = first + np.arange(len(kept))
        shorter, above, first = place, probability, first + len(kept)
    return ContextTrees(languages, symbol, np.concatenate(children), np.concatenate(bits))


def sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``n`` over runs of equal, sorted keys."""
    if not len(keys):
        return keys, n
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[heads], np.add.reduceat(n, heads)


def code_lengths(trees: ContextTrees, data: np.ndarray, starts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Bits of each text under each language."""
    texts, width = len(starts) - 1, trees.child.shape[1]
    shift = order * np.repeat(np.arange(1, texts + 1), np.diff(starts))
    stream = np.full(len(data) + order * texts, START, np.uint8)
    stream[np.arange(len(data)) + shift] = data
    symbols = trees.symbol[stream]
    child, node = trees.child.ravel(), np.zeros(len(stream), np.int32)
    longer = np.ones(len(stream), bool)
    for k in range(1, order + 1):
        before = np.concatenate([np.zeros(k, np.int32), symbols[:-k]]) if len(symbols) > k else np.zeros(len(symbols), np.int32)
        found = child[node * width + before]
        longer &= found > 0
        node = np.where(longer, found, node)
    bits = trees.bits.reshape(-1, len(trees.languages))[node * width + symbols]
    heads = starts[:-1] + order * np.arange(1, texts + 1)
    total = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)])
    return total[heads + np.diff(starts)] - total[heads]


def sample_texts(labelled: DataFrame, text: str, lang: str, order: Column, rows: int, longest: int) -> dict[str, list[bytes]]:
    """At most ``rows`` whole texts of each language, none longer than ``longest`` bytes, first by ``order``."""
    usable = labelled.where(F.col(lang).isNotNull() & F.octet_length(text).between(1, longest))
    ranked = thinned(usable, [lang], order, rows).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.row_number().over(Window.partitionBy(lang).orderBy(order, text)).alias("r"))
    out: dict[str, list[bytes]] = {}
    for row in ranked.where(F.col("r") <= rows).select("l", "t").collect():
        out.setdefault(row.l, []).append(row.t.encode("utf-8"))
    return {language: sorted(texts) for language, texts in out.items()}


def identify(docs: DataFrame, learn_from: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES, learn_key: str | None = None, learn_text: str | None = None) -> DataFrame:
    """Each row's ``key``, ``lang_pred``, ``score`` (0 to 1) and ``bits_per_byte`` under the predicted language.

    ``learn_from`` gives the labelled rows, in the same columns unless
    ``learn_key`` and ``learn_text`` name others; a bounded sample of them is
    fitted (``rows`` of each language, texts of at most ``longest`` bytes).
    Texts that are null or have no letter give ``und`` with score 0 and null
    bits, as does every text when nothing could be learned. Equal code lengths
    go to the first language by name. Null keys and repeated rows are judged row
    by row; an empty table gives an empty result; other columns are not read.
    ``key`` may be a struct of all columns, to carry a whole row through. Only
    ``text`` is an input of a prediction.
    """
    samples = sample_texts(learn_from, learn_text or text, lang, F.xxhash64(learn_key or key), rows, longest)
    shared = docs.sparkSession.sparkContext.broadcast(train(samples) if samples else None)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        trees = shared.value
        for batch in batches:
            data, starts = packed(texts_of(batch, text))
            sized = np.diff(starts)
            best = np.zeros(len(sized), np.int64)
            score, rate = np.zeros(len(sized)), np.full(len(sized), np.nan)
            usable = np.array(batch.column("letters").to_pylist(), bool) & (trees is not None)
            for low, high in slices(starts) if trees is not None else ():
                bits = code_lengths(trees, data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
                length = np.maximum(sized[low:high], 1)
                best[low:high] = bits.argmin(1)
                gap = bits - bits.min(1, keepdims=True)
                score[low:high] = 1 / np.exp2(-gap * np.minimum(1, EVIDENCE_BYTES / length)[:, None]).sum(1)
                rate[low:high] = bits.min(1) / length
            names = [trees.languages[b] if ok else UNDETERMINED for b, ok in zip(best, usable)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(usable, score, 0.0)), pa.array(rate, mask=~usable)],
                ["key", "lang_pred", "score", "bits_per_byte"],
            )

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = text_rows(docs, key, text, letters.alias("letters")).mapInArrow(predict, keyed_schema(docs, key, "lang_pred string, score double, bits_per_byte double"))
    return out.withColumnRenamed("key", key)
