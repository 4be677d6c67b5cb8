"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A text window that matches a benchmark window of n characters with at most e
edits shares at least n - q + 1 - q e of its q-grams, all on diagonals (text
position minus item position) no further apart than e. So shared q-grams are
counted in overlapping bands of diagonals; bands that reach the bound are kept,
and an alignment within the band decides. Texts and items are compared in lower
case, as words parted by single marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.llm.batches import SLICE_BYTES, keyed_schema, packed, parts, slices
from estate_spark.llm.caches import claim

Q = 8  # characters (UTF-8 bytes) of a gram: one 64-bit number
WINDOW = 120  # bytes of an item that must be found; shorter items as a whole
EDIT_RATE = 0.08
ALIGNED_AT_ONCE = 256  # windows in one alignment: bounds its memory to some MB
BAND = 16  # a band covers BAND diagonals and as many more as edits allow
LEAST_BYTES = 40  # shorter items are no evidence and never reported
BLOCK_BYTES = 2 << 20  # of items in one pass over the documents: the bound on what is broadcast
ENTRIES = 1 << 20  # pairs of a text's and an item's place of one gram that are held at once
OVERLAP = 4 * (WINDOW + BAND)  # of neighbouring parts of one stream
FILTER_BITS = 22
MARK = 32

# Letters and digits, and all bytes of longer characters, are kept; runs of other bytes become one mark.
KEPT = np.zeros(256, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    KEPT[_b] = _b
KEPT[65:91] = np.arange(97, 123)


def plain(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text as words, a mark before the first and after each, and where texts start in that."""
    texts = len(starts) - 1
    body = np.zeros(len(data) + 2 * texts, np.uint8)
    shift = 2 * np.repeat(np.arange(texts), np.diff(starts)) + 1
    body[np.arange(len(data)) + shift] = KEPT[data]
    begins = np.zeros(len(body), bool)
    begins[starts[:-1] + 2 * np.arange(texts)] = True
    keep = (body > 0) | np.r_[False, body[:-1] > 0] | begins
    out = body[keep]
    out[out == 0] = MARK
    return out, np.concatenate([np.cumsum(keep)[begins] - 1, [len(out)]])


def grams(text: np.ndarray) -> np.ndarray:
    """Each run of Q bytes as a number."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(text) - Q + 1,), "<u8", np.ascontiguousarray(text), 0, (1,)).astype(np.uint64)


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def edits_of(length: int) -> int:
    return int(length * EDIT_RATE)


def bound(length: int) -> int:
    """Least number of shared q-grams of a window with the edits it may have."""
    return max(1, length - Q + 1 - Q * edits_of(length))


@dataclass(frozen=True)
class ItemIndex:
    """The q-grams of a block of items."""

    keys: list  # of items
    stream: np.ndarray
    starts: np.ndarray
    gram: np.ndarray  # sorted
    item: np.ndarray
    place: np.ndarray  # in the item
    present: np.ndarray
    least: int

    @staticmethod
    def build(keys: list, texts: list[str]) -> ItemIndex:
        data, starts = packed(pa.array([text.lower() for text in texts], pa.string()))
        stream, begins = plain(data, starts)
        lengths = np.diff(begins)
        gram, item, place = [], [], []
        for i in np.flatnonzero(lengths >= LEAST_BYTES):
            found = grams(stream[begins[i] : begins[i + 1]])
            gram.append(found)
            item.append(np.full(len(found), i))
            place.append(np.arange(len(found)))
        if not gram:
            empty = np.zeros(0, np.int64)
            return ItemIndex(keys, stream, begins, np.zeros(0, np.uint64), empty, empty, np.zeros(1 << FILTER_BITS, bool), 1)
        joined = np.concatenate(gram)
        order = np.argsort(joined, kind="stable")
        present = np.zeros(1 << FILTER_BITS, bool)
        present[slots(joined)] = True
        least = min(bound(min(int(n), WINDOW)) for n in lengths[lengths >= LEAST_BYTES])
        return ItemIndex(keys, stream, begins, joined[order], np.concatenate(item)[order], np.concatenate(place)[order], present, least)

    def window(self, item: int) -> int:
        """Bytes of the item's windows."""
        return min(int(self.starts[item + 1] - self.starts[item]), WINDOW)

    def windows(self, item: int) -> list[tuple[int, int]]:
        """All windows of the item: one for each place at which one can begin."""
        size, length = int(self.starts[item + 1] - self.starts[item]), self.window(item)
        return [(at, at + length) for at in range(size - length + 1)]


def aligned(windows: np.ndarray, regions: np.ndarray, most: int) -> np.ndarray:
    """Fewest edits that turn each row of ``windows`` into some part of its row of ``regions``; over ``most`` if there are more.

    One step for each byte of the windows over the band of places that stay
    within the edits: a region is no longer than the window and its band.
    """
    out = np.full(len(windows), most + 1, np.int64)
    live = np.arange(len(windows))
    steps = np.arange(regions.shape[1] + 1, dtype=np.int16)
    row = np.zeros((len(windows), regions.shape[1] + 1), np.int16)
    for number in range(windows.shape[1]):
        following = np.empty_like(row)
        following[:, 0] = number + 1
        np.minimum(row[:, :-1] + (regions != windows[:, number, None]), row[:, 1:] + 1, out=following[:, 1:])
        row = np.minimum.accumulate(following - steps, axis=1) + steps
        if number % 8 == 7:
            near = row.min(1) <= most
            if not near.all():
                live, row, regions, windows = live[near], row[near], regions[near], windows[near]
                if not len(live):
                    return out
    out[live] = np.minimum(row.min(1), most + 1)
    return out


def judged(index: ItemIndex, stream: np.ndarray, which: np.ndarray, begin: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Edits of windows of one length against their regions of ``stream`` from ``start`` on, within ``low`` to ``high``."""
    most = edits_of(length)
    edits = np.empty(len(which), np.int64)
    for at in range(0, len(which), ALIGNED_AT_ONCE):
        part = slice(at, at + ALIGNED_AT_ONCE)
        windows = index.stream[(index.starts[which[part]] + begin[part])[:, None] + np.arange(length)]
        places = start[part, None] + np.arange(BAND + length + 3 * most)
        inside = (places >= low[part, None]) & (places < high[part, None])
        near = np.where(inside, stream[np.clip(places, 0, len(stream) - 1)], 0)  # no byte of a window is 0
        exact = np.array([r.tobytes().find(w.tobytes()) >= 0 for w, r in zip(windows, near)], bool)
        found = np.zeros(len(windows), np.int64)
        if not exact.all():
            found[~exact] = aligned(windows[~exact], near[~exact], most)
        edits[part] = found
    return edits


def regions(index: ItemIndex, stream: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, item position and edits of each window found in ``stream``, whose texts start at ``begins``.

    A text that repeats a gram which an item repeats too has an entry for each
    pair of places. While these are too many the stream is halved, with an
    overlap, so that what is held at once stays bounded and no find is lost.
    """
    found = grams(stream)
    hit = index.present[slots(found)]
    # only stretches with enough hits for some window go on; a stretch is a window and its band
    reach = WINDOW + BAND + edits_of(WINDOW)
    total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)]).astype(np.int32)
    ends = np.minimum(np.arange(len(hit)) + reach, len(hit))
    dense = np.concatenate([[0], np.cumsum(total[ends] - total[:-1] >= index.least, dtype=np.int32)])
    at = np.flatnonzero(hit)
    at = at[dense[at + 1] > dense[np.maximum(at + 1 - reach, 0)]]
    low = np.searchsorted(index.gram, found[at], "left")
    many = np.searchsorted(index.gram, found[at], "right") - low
    if many.sum() > ENTRIES and len(stream) > 4 * OVERLAP:
        half = len(stream) // 2
        for start, part in ((0, stream[: half + OVERLAP]), (half, stream[half:])):
            first, last = int(np.searchsorted(begins, start, "right")) - 1, int(np.searchsorted(begins, start + len(part), "left"))
            for text, which, begin, edits in regions(index, part, np.maximum(begins[first:last] - start, 0)):
                yield first + text, which, begin, edits
        return
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    text_at = np.repeat(at, many)
    item, place = index.item[entry], index.place[entry]
    if not len(item):
        return
    # texts are parted by two marks and no item has two together: a gram lies within one text
    text = np.searchsorted(begins, text_at, "right") - 1
    longest = -(-(int(np.diff(index.starts).max()) + BAND) // BAND) * BAND
    diagonal = text_at - place + longest  # from BAND on
    band = diagonal // BAND
    slack = edits_of(WINDOW)
    # a diagonal lies in its own band, and in those before whose edits reach it
    owners, rows = [band], [np.arange(len(band))]
    for back in range(1, (slack + BAND - 1) // BAND + 1):
        also = np.flatnonzero(diagonal - (band - back) * BAND < BAND + slack)
        owners.append(band[also] - back)
        rows.append(also)
    row, owner = np.concatenate(rows), np.concatenate(owners)
    bands, texts = int(owner.max()) + 1, len(begins)
    key = (item[row] * texts + text[row]) * bands + owner
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[heads, len(key)])
    wanted: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for head, size in zip(heads[sizes >= index.least].tolist(), sizes[sizes >= index.least].tolist()):
        pair, number = divmod(int(key[head]), bands)
        which, inside = divmod(pair, texts)
        places = np.unique(place[row[head : head + size]])
        length = index.window(which)
        begin = np.arange(int(index.starts[which + 1] - index.starts[which]) - length + 1)
        shared = np.searchsorted(places, begin + length - Q, "right") - np.searchsorted(places, begin, "left")
        begin = begin[shared >= bound(length)]
        if len(begin):
            start = number * BAND - longest + begin - edits_of(length)
            wanted.setdefault(length, []).append((np.full(len(begin), which), np.full(len(begin), inside), begin, start))
    for length, candidates in wanted.items():
        which, inside, begin, start = (np.concatenate(column) for column in zip(*candidates))
        edits = judged(index, stream, which, begin, start, begins[inside], np.r_[begins[1:], len(stream)][inside], length)
        good = edits <= edits_of(length)
        yield from zip(inside[good].tolist(), which[good].tolist(), begin[good].tolist(), edits[good].tolist())


def item_blocks(items: DataFrame) -> Iterator[Broadcast]:
    """Indexes of the distinct item texts ``t`` in blocks of bounded size, keyed by the text itself.

    Blocks are dealt by a hash of distinct texts, so copies of one item cannot
    fill a block. Each is collected and indexed when its pass is built.
    """
    texts = items.select("t").distinct()
    size = texts.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    blocks = int(size // BLOCK_BYTES) + 1
    for block in range(blocks):
        part = [r.t for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).orderBy("t").collect()]
        yield items.sparkSession.sparkContext.broadcast(ItemIndex.build(part, part))


def hits_of(index: ItemIndex, texts: pa.Array) -> dict[tuple[int, int], dict[int, int]]:
    """For each row and item found in its text: the best edits of each window, by where it begins."""
    data, starts = packed(texts)
    hits: dict[tuple[int, int], dict[int, int]] = {}
    for low, high in slices(starts):
        for doc, which, begin, edits in scan(index, data[starts[low] : starts[high]], starts[low : high + 1] - starts[low]):
            best = hits.setdefault((low + doc, which), {})
            best[begin] = min(edits, best.get(begin, edits))
    return hits


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document row and item found in it: ``key``, ``item_key``, n_windows, edits (of the best window).

    An item is found when any WINDOW bytes of it, wherever they begin (the whole
    item, if shorter), occur within one text with at most EDIT_RATE edits;
    n_windows counts the beginnings. Null and empty texts and items
    and items under LEAST_BYTES match nothing; repeated document rows are
    reported each; null keys are carried; equal items are indexed once and
    reported each; other columns are not read. Items are taken in blocks of
    bounded size, each a pass over the documents.
    """
    items = benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    rows = docs.select(F.col(key).alias("key"), F.lower(text).alias("text")).where("text IS NOT NULL")
    out = None
    for shared in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            claim("decontamination")
            index = shared.value
            for batch in batches:
                hits = hits_of(index, batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([doc for doc, _ in hits], pa.int64())),
                        pa.array([index.keys[which] for _, which in hits], pa.string()),
                        pa.array([len(best) for best in hits.values()], pa.int32()),
                        pa.array([min(best.values()) for best in hits.values()], pa.int32()),
                    ],
                    ["key", "t", "n_windows", "edits"],
                )

        found = rows.mapInArrow(run, keyed_schema(docs, key, "t string, n_windows int, edits int"))
        out = found if out is None else out.unionByName(found)
    return out.join(items, "t").select("key", "i", "n_windows", "edits").toDF(key, item_key, "n_windows", "edits")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item is found, in the sense of :func:`find_leaks`.

    Rows are judged one by one where they lie and pass one block of items after
    the other, so nothing is shuffled and rows need no key.
    """
    items = benchmark.select(F.col(item_text).alias("t")).where("t IS NOT NULL")
    rows = docs.select(F.struct(*docs.columns).alias("key"), F.lower(text).alias("text"))
    for shared in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            claim("decontamination")
            for batch in parts(batches):
                leaks = {doc for doc, _ in hits_of(shared.value, batch.column(1))}
                yield batch.filter(pa.array([doc not in leaks for doc in range(batch.num_rows)], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("key.*")


def scan(index: ItemIndex, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text number, item, item position and edits of each window found; long texts in overlapping parts."""
    stream, begins = plain(data, starts)
    for low in range(0, len(stream), SLICE_BYTES):
        part = stream[low : low + SLICE_BYTES + OVERLAP]
        first, last = int(np.searchsorted(begins, low, "right")) - 1, int(np.searchsorted(begins[:-1], low + len(part), "left"))
        for text, which, begin, edits in regions(index, part, np.maximum(begins[first:last] - low, 0)):
            yield first + text, which, begin, edits
