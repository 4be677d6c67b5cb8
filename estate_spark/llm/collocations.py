"""Phrase collocations: frequent phrases of two to four words and how firmly their parts hold together.

Phrases are counted level by level: words, then pairs of frequent words, then
longer phrases all of whose pairs are frequent. As a phrase is never more
frequent than a part of it, nothing frequent is missed. Each task counts in a
burst trie of word ids; when the trie is full its largest subtrees are spilled,
each as a run sorted by phrase, and runs are merged in the partition of their
prefix. What is frequent reaches the next level as a bit table of fixed most
size: an error of it lets a rare phrase through to be counted, never the reverse.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estate_spark.llm.batches import packed, slices
from estate_spark.llm.hat_trie import ID_BITS, HatTrie, packed_rest, unpacked_rest
from estate_spark.session import shared_dir

LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a candidate
COVER = 80  # percent of a phrase's occurrences within one longer candidate that make it a fragment
SCALE = 2_000_000
TOP = 2_000
SHARES = 16  # of a language, ranked apart before they are ranked together
ENTRIES = 800_000  # phrases that a task holds before it spills
WAITING = 1_000_000  # places gathered before they are counted
VOCABULARY = 300_000  # words that a task knows before it spills all and starts anew
WINDOW = 200_000  # words counted between two looks at the bounds
RUN_ROWS = 20_000  # spilled rows handed on at once
BITS_PER_ENTRY, MOST_BITS = 16, 1 << 27  # of a bit table: 16 MB at most
UNKNOWN = "und"

GOLDEN = 0x9E3779B97F4A7C15  # spreads hashes over the bits
EDGE = b"\xff"  # between pieces; in no UTF-8 text
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", EDGE * 10)
RUN_SCHEMA = "lang string, head string, tail string, n long"


class BitTable:
    """Bits of a fixed number of hashes; frequent keys are all in it, others by chance."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 64).bit_length() + 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = places(hashes, self.shift)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def holds_one(self, value: int) -> bool:
        at = (value * GOLDEN & (1 << 64) - 1) >> int(self.shift)
        return bool(int(self.bits[at >> 6]) >> (at & 63) & 1)


def places(hashes: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (hashes * np.uint64(GOLDEN)) >> shift


def lang_seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def word_hash(seed: int, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=seed)


def pair_hashes(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one * np.uint64(0xD6E8FEB86659FD93)) ^ (two >> np.uint64(29)) ^ two


def bit_table(frequent: DataFrame) -> BitTable | None:
    """The bit table of all ``head``s (one word or two) of a table of frequent phrases; its size is bounded."""
    rows = frequent.count()
    if not rows:
        return None
    size = min(MOST_BITS, max(64, 1 << (BITS_PER_ENTRY * rows - 1).bit_length()))
    shift = np.uint64(64 - size.bit_length() + 1)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for lang, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = [word_hash(lang_seed(lang), word) for word in head.encode().split(b" ")]
                keys.append([hashes[0], hashes[-1]])
            keys = np.array(keys, np.uint64).reshape(-1, 2)
            single = np.array([" " not in head for head in batch.column(1).to_pylist()], bool)
            at = places(np.where(single, keys[:, 0], pair_hashes(keys[:, 0], keys[:, 1])), shift)
            mask = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(mask.view(np.int64))], ["block", "mask"])

    blocks = frequent.select("lang", "head").mapInArrow(bits, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask"))
    found = blocks.toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[found["block"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return BitTable(table)


class Vocabulary(dict):
    """Ids of one language's words in a task, from 1 on; 0 for edges and for words that ``admits`` refuses."""

    def __init__(self, lang: str, admits: BitTable | None):
        super().__init__({EDGE: 0})
        self.seed, self.admits = lang_seed(lang), admits
        self.words, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        value = word_hash(self.seed, word)
        if self.admits is not None and not self.admits.holds_one(value):
            self[word] = 0
            return 0
        self.words.append(word)
        self.hashes.append(value)
        self[word] = number = len(self.words) - 1
        return number


class Level:
    """A task's counts of phrases of some lengths."""

    def __init__(self, lengths: tuple[int, ...], words: BitTable | None, pairs: BitTable | None):
        self.lengths, self.words, self.pairs = lengths, words, pairs
        self.tries: dict[str, tuple[Vocabulary, HatTrie]] = {}
        self.waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}  # phrases not yet in a trie
        self.waits = 0

    def add(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Count the texts' phrases; yields what must be spilled meanwhile."""
        stream = EDGE.join(texts).lower().translate(PIECES).replace(EDGE, b" \xff ").split()
        for low in range(0, len(stream), WINDOW):  # a window counts the phrases that begin in it
            if lang not in self.tries:
                self.tries[lang] = Vocabulary(lang, self.words), HatTrie()
            self._take(lang, stream[low : low + WINDOW + max(self.lengths) - 1])
            yield from self.relieved()

    def _take(self, lang: str, stream: list[bytes]) -> None:
        vocabulary, trie = self.tries[lang]
        ids = np.fromiter(map(vocabulary.__getitem__, stream), np.int64, len(stream))
        known = ids > 0
        if self.lengths == (1,):
            trie.add_words(ids[known])
            return
        together = known[:-1] & known[1:]
        if self.pairs is not None:
            at = np.flatnonzero(together)
            hashes = np.array(vocabulary.hashes, np.uint64)
            together[at] = self.pairs.holds(pair_hashes(hashes[ids[at]], hashes[ids[at + 1]]))
        for n in self.lengths:
            places = min(len(ids) - n + 1, WINDOW)
            if places > 0:
                at = np.flatnonzero(np.logical_and.reduce([together[k : k + places] for k in range(n - 1)]))
                self.waiting.setdefault(lang, []).append((ids[at], packed_rest(*(ids[at + k] for k in range(1, n)))))
                self.waits += len(at)

    def settle(self) -> None:
        """Count the waiting phrases."""
        for lang, found in self.waiting.items():
            self.tries[lang][1].add(np.concatenate([first for first, _ in found]), np.concatenate([rest for _, rest in found]))
        self.waiting.clear()
        self.waits = 0

    def relieved(self) -> Iterator[pa.RecordBatch]:
        """Subtrees where the tries are full; all phrases where too many words are known, whose ids start anew."""
        if self.waits > WAITING:
            self.settle()
            if sum(trie.entries for _, trie in self.tries.values()) > ENTRIES:
                yield from self.spilled(ENTRIES // (2 * len(self.tries)))
        if sum(len(vocabulary) for vocabulary, _ in self.tries.values()) > VOCABULARY:
            yield from self.rest()
            self.tries.clear()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """All phrases that are left."""
        self.settle()
        yield from self.spilled(0)

    def spilled(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Runs of whole subtrees, sorted by phrase, until at most ``keep`` phrases a language are left."""
        for lang, (vocabulary, trie) in self.tries.items():
            first, key, counts = trie.spill(keep)
            if not len(first):
                continue
            words = pa.array(vocabulary.words, pa.binary())
            rank = np.empty(len(words), np.int64)
            rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
            columns = [first, *unpacked_rest(key)]
            ranked = [rank[one] << ID_BITS | rank[two] for one, two in (columns[:2], columns[2:])]
            order = np.lexsort(ranked[::-1]) if columns[2].any() else np.argsort(ranked[0])
            for low in range(0, len(order), RUN_ROWS):
                rows = order[low : low + RUN_ROWS]
                one, two, three, four = (words.take(pa.array(c[rows])) for c in columns)
                head, tail = joined(one, two), joined(three, four)
                language = pa.DictionaryArray.from_arrays(np.zeros(len(rows), np.int32), [lang]).dictionary_decode()
                yield pa.RecordBatch.from_arrays([language.cast(pa.string()), head.view(pa.string()), tail.view(pa.string()), pa.array(counts[rows])], ["lang", "head", "tail", "n"])


def joined(one: pa.Array, two: pa.Array) -> pa.Array:
    """Two words with a space between, or one where the second is empty."""
    if not pc.any(pc.greater(pc.binary_length(two), 0)).as_py():
        return one
    space = pc.if_else(pc.equal(pc.binary_length(two), 0), pa.scalar(b""), pa.scalar(b" "))
    return pc.binary_join_element_wise(one, two, space)


def counter(lengths: tuple[int, ...], words: Callable[[], BitTable | None], pairs: Callable[[], BitTable | None]):
    """The function that counts one partition's phrases and hands on spilled runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Level(lengths, words(), pairs())
        for batch in batches:
            data, starts = packed(batch.column(1))
            for low, high in slices(starts):
                body, cuts = data[starts[low] : starts[high]].tobytes(), (starts[low : high + 1] - starts[low]).tolist()
                by_lang: dict[str, list[bytes]] = {}
                for lang, begin, end in zip(batch.column(0).slice(low, high - low).to_pylist(), cuts, cuts[1:]):
                    by_lang.setdefault(lang, []).append(body[begin:end])
                for lang, texts in by_lang.items():
                    yield from level.add(lang, texts)
        yield from level.rest()

    return count


def counted(texts: DataFrame, lengths: tuple[int, ...], words: BitTable | None = None, pairs: BitTable | None = None) -> DataFrame:
    """lang, head (the first two words), tail and n of all phrases: runs are merged in the partition of their prefix."""
    context = texts.sparkSession.sparkContext
    shared_words, shared_pairs = context.broadcast(words), context.broadcast(pairs)
    runs = texts.mapInArrow(counter(lengths, lambda: shared_words.value, lambda: shared_pairs.value), RUN_SCHEMA)
    return runs.repartition("lang", "head").groupBy("lang", "head", "tail").agg(F.sum("n").alias("n"))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def phrase_of(words: Column) -> Column:
    return F.array_join(words, " ")


def fragments(candidates: DataFrame, cover: int) -> DataFrame:
    """lang and phrase of candidates that one longer candidate holds in ``cover`` percent of their occurrences."""
    longer = candidates.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    within = F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), i -> slice(words, i, s))))"))
    parts_of = longer.select("lang", F.col("a").alias("holder"), within.alias("part"))
    most = parts_of.select("lang", phrase_of(F.col("part")).alias("phrase"), "holder").groupBy("lang", "phrase").agg(F.max("holder").alias("holder"))
    exact = F.lit(100).cast("decimal(20,0)") * F.col("holder") >= F.lit(cover).cast("decimal(20,0)") * F.col("a")
    return candidates.join(most, ["lang", "phrase"]).where(exact).select("lang", "phrase")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A to Z are lower-cased; ``. , ; : ! ?`` and line ends part a text into
    pieces, spaces and tabs a piece into words. Candidates are phrases of two to
    four words that occur ``least`` times or more within pieces of a language
    (a null language is ``und``, together with a language of that name). ``a``,
    ``l`` and ``r`` count the phrase, and its first and last part at the cut of
    the lowest score; ``n`` counts the language's words. Null and empty texts
    hold nothing; repeated rows count each; an empty table gives an empty
    result; other columns are not read, and no row needs a key.
    """
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    texts = docs.select(F.coalesce(lang, F.lit(UNKNOWN)).cast("string").alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    words = written(counted(texts, (1,)), f"{folder}/words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= least)
    word_table = bit_table(frequent)
    none = spark.createDataFrame([], RUN_SCHEMA)
    pairs = written(counted(texts, (2,), word_table).where(F.col("n") >= least) if word_table else none, f"{folder}/pairs")
    pair_table = bit_table(pairs)
    longer = written(counted(texts, tuple(range(3, LONGEST + 1)), word_table, pair_table).where(F.col("n") >= least) if pair_table else none, f"{folder}/longer")
    named = F.concat("head", F.when(F.col("tail") != "", F.concat(F.lit(" "), F.col("tail"))).otherwise(""))
    candidates = pairs.unionByName(longer).select("lang", named.alias("phrase"), F.col("n").alias("a"))
    known = frequent.select("lang", F.col("head").alias("part"), F.col("n").alias("f")).unionByName(candidates.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))

    listed = candidates.join(fragments(candidates, cover), ["lang", "phrase"], "left_anti").withColumn("words", F.split("phrase", " "))
    cuts = listed.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
    sides = cuts.select("lang", "phrase", "a", "k", phrase_of(F.expr("slice(words, 1, k)")).alias("one"), phrase_of(F.expr("slice(words, k + 1, size(words) - k)")).alias("two"))
    first = known.select("lang", F.col("part").alias("one"), F.col("f").alias("l"))
    rest = known.select("lang", F.col("part").alias("two"), F.col("f").alias("r"))
    scored = sides.join(first, ["lang", "one"]).join(rest, ["lang", "two"]).withColumn("score", F.expr(f"cast(cast({SCALE} as decimal(10,0)) * a div (l + r) as bigint)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    share = Window.partitionBy("lang", "share").orderBy(*order)  # a language's best are among the best of its shares
    best = lowest.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
