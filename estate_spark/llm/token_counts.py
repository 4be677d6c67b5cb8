"""Token counts by a two-tier lookup on the map side.

The tokenizer is a sentencepiece BPE model that turns spaces into a mark and
merges no piece across "character, then mark". Its count for a text is thus the
sum over pre-tokens, each a run of marks and what follows up to the next mark.
The first tier is a broadcast table of the lengths of frequent pre-tokens, the
second a bounded memo in each worker that encodes what the table lacks. No
pre-token is shuffled: tasks hand on summaries of a fixed number of rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.llm.caches import LONGEST_KEY, WordMemo, claim, held_by, rest

MARK = "▁"
RUNS = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_ROWS = 65_536  # of the broadcast table; with LONGEST_KEY this bounds it to 16 MB
SUMMARY_ROWS = 8_192  # each task hands on for the table
COUNTER_ROWS = 262_144  # a task counts at once
MEMO_ROWS = 400_000


@lru_cache(maxsize=2)
def load_model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, once in each worker; refused where its counts are not sums over pre-tokens."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
        raise ValueError("the model has pieces that cross a space")
    if model.encode("  a", out_type=str) != model.encode(f"{MARK} a", out_type=str) or len(model.encode("a ")) != 2:
        raise ValueError("the model folds white space")
    return model


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, each without its first mark (the model puts that before any input)."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return [run[1:] for run in RUNS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def length_of(model: sentencepiece.SentencePieceProcessor, word: str) -> int:
    return len(model.encode(word)) if word else 1


def frequent_pre_tokens(docs: DataFrame, text: str = "text", rows: int = TABLE_ROWS) -> list[str]:
    """The most frequent pre-tokens over all texts, by lossy counts in each task that are then added up.

    At most ``rows`` come to the driver, none longer than ``LONGEST_KEY``. A
    pre-token that the summaries miss is only slower to count.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(pre_tokens(value or ""))
                if len(seen) > COUNTER_ROWS:
                    seen = Counter(dict(seen.most_common(COUNTER_ROWS // 2)))
        best = [(w, n) for w, n in seen.most_common(SUMMARY_ROWS) if len(w) <= LONGEST_KEY]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["word", "n"])

    counted = docs.select(text).mapInArrow(summary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(rows).select("word").collect()]


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """Each row's ``key``, ``n_bytes`` (UTF-8) and ``n_tokens``, without begin or end tokens.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null keys
    are counted row by row; an empty table gives an empty result; other columns
    are not read. A text without any space is one pre-token and encoded whole.
    """
    model = load_model(model_path)
    lengths = {word: length_of(model, word) for word in frequent_pre_tokens(docs, text, table_rows)}
    table = docs.sparkSession.sparkContext.broadcast(lengths)
    key_type, name = docs.schema[key].dataType.simpleString(), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts")
        worker_model = load_model(model_path)
        memo = worker_memo(name, worker_model, table.value)
        for batch in batches:
            sizes = [sum(map(memo.__getitem__, pre_tokens(value or ""))) for value in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["key", "n_bytes", "n_tokens"])
        rest()

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"key {key_type}, n_bytes long, n_tokens long").withColumnRenamed("key", key)


_memos: dict[str, WordMemo] = {}
held_by("token_counts", _memos.clear)


def worker_memo(name: str, model: sentencepiece.SentencePieceProcessor, table: dict[str, int]) -> WordMemo:
    """One memo for each worker and count, kept over its tasks."""
    if name not in _memos:
        _memos.clear()
        _memos[name] = WordMemo(lambda word: length_of(model, word), MEMO_ROWS, table)
    return _memos[name]
