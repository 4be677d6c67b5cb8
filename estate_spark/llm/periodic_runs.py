"""Periodic runs by grammar compression: the words of texts are Re-Paired, and runs are sought in the grammar.

A run is a stretch of words that repeats with a smallest period and cannot be
extended. Word ids are compressed by rounds of Re-Pair: in each round the pairs
that are locally the most frequent become rules. What is left of a text becomes
a balanced tree of rules, so that each text has one derivation tree. A run lies
within the expansion of some rule and crosses the boundary of that rule's two
halves; so runs are sought once for each rule, around its boundary, however
often the rule occurs. They are then translated to all places where the rule is
derived, and pieces of one run are merged.

Extensions along a period are found by bisection on Karp-Rabin sums. All runs
found are compared word by word in the end and sought again under another base
if any should differ, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.llm.batches import packed, parts, slices

LEAST = 6  # words of a run
EXPONENT = 4  # periods of a run
SLICE_BYTES = 1 << 19  # of texts that share one grammar, beyond a single longer text
TRIALS = 1 << 19  # (rule, period) pairs tried at once
FADED = 4096  # a round that replaces fewer than one in so many symbols is the last
PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Grammar:
    """Rules by number: symbol ``terminals + i`` is ``left[i]`` then ``right[i]``, made in rounds of rules."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    rounds: list[tuple[int, int]]  # first and one past the last rule of each round
    roots: np.ndarray  # one symbol for each text that has words
    root_at: np.ndarray  # the word at which its expansion begins


def locally_best(sym: np.ndarray, owner: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs to replace, none overlapping, and the pairs: those that repeat and are as frequent as any neighbour."""
    pair = sym[:-1] * base + sym[1:]
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    _, which, counts = np.unique(pair[inside], return_inverse=True, return_counts=True)
    order = np.empty(len(counts), np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    rank = np.full(len(sym) + 1, -1, np.int64)  # of the pair at place i, in entry i + 1; both ends are lowest
    rank[inside + 1] = np.where(counts > 1, order, -1)[which]
    at = np.flatnonzero((rank[1:-1] >= 0) & (rank[1:-1] >= rank[:-2]) & (rank[1:-1] >= rank[2:]))
    heads = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if len(at) else at
    offset = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))
    at = at[offset % 2 == 0]  # neighbours of equal rank are one word repeated
    return at, pair[at]


def compress(ids: np.ndarray, starts: np.ndarray) -> Grammar:
    """Rules for all texts; text ``i`` holds ``ids[starts[i]:starts[i + 1]]``. Pairs never cross texts."""
    terminals = int(ids.max()) + 1 if len(ids) else 0
    sym, owner = ids, np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    lefts, rights, rounds = [], [], []
    total = terminals

    def replace(at: np.ndarray, names: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        nonlocal sym, owner, total
        sym = sym.copy()
        sym[at] = total + names
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, owner = sym[keep], owner[keep]
        lefts.append(left)
        rights.append(right)
        rounds.append((total - terminals, total - terminals + len(left)))
        total += len(left)

    while len(sym) > 1:
        base = total
        at, pairs = locally_best(sym, owner, base)
        if len(at) * FADED < len(sym):
            break
        rules, names = np.unique(pairs, return_inverse=True)
        replace(at, names, rules // base, rules % base)
    while True:
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(sym) else np.zeros(0, np.int64)
        within = np.arange(len(sym)) - np.repeat(firsts, np.diff(np.r_[firsts, len(sym)]))
        at = np.flatnonzero((within[:-1] % 2 == 0) & (owner[:-1] == owner[1:])) if len(sym) > 1 else np.zeros(0, np.int64)
        if not len(at):
            break
        replace(at, np.arange(len(at)), sym[at], sym[at + 1])
    empty = np.zeros(0, np.int64)
    return Grammar(terminals, np.concatenate([empty, *lefts]), np.concatenate([empty, *rights]), rounds, sym, starts[:-1][owner])


def lengths_of(g: Grammar) -> np.ndarray:
    """Words in each symbol's expansion."""
    size = np.ones(g.terminals + len(g.left), np.int64)
    for low, high in g.rounds:
        size[g.terminals + low : g.terminals + high] = size[g.left[low:high]] + size[g.right[low:high]]
    return size


def first_places(g: Grammar, size: np.ndarray) -> np.ndarray:
    """The word at which each rule is first derived."""
    first = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(first, g.roots, g.root_at)
    for low, high in reversed(g.rounds):
        at = first[g.terminals + low : g.terminals + high]
        np.minimum.at(first, g.left[low:high], at)
        np.minimum.at(first, g.right[low:high], at + size[g.left[low:high]])
    return first[g.terminals :]


class Sums:
    """Karp-Rabin sums over word ids, to compare stretches of equal length."""

    def __init__(self, ids: np.ndarray, seed: int):
        random = np.random.default_rng(seed)
        base, value = int(random.integers(1 << 20, PRIME)), random.integers(1, PRIME, int(ids.max(initial=0)) + 1)
        power = np.ones(1, np.int64)
        while len(power) <= len(ids):
            power = np.concatenate([power, power * pow(base, len(power), PRIME) % PRIME])
        self.power = power[: len(ids) + 1]
        self.sums = np.concatenate([[0], np.cumsum(value[ids] * self.power[:-1] % PRIME)])

    def same(self, at: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``at`` and from ``at + shift`` are equal."""
        one = (self.sums[at + size] - self.sums[at]) % PRIME * self.power[shift] % PRIME
        return one == (self.sums[at + shift + size] - self.sums[at + shift]) % PRIME

    def extent(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Greatest size up to ``most`` for which the stretches after (or before) both places are equal."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.same(at - middle if back else at, shift, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low


def crossing_runs(ids: np.ndarray, sums: Sums, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, ...]:
    """Runs within ``begin`` to ``end`` that cross ``middle``: rule, start, end, smallest period.

    One side of the boundary holds half of the run, so more than a whole
    period: the words around the boundary equal those a period further on that side.
    """
    half = exponent // 2
    periods = np.minimum(np.maximum(middle - begin, end - middle) // half, (end - begin) // exponent)
    periods[end - begin < least] = 0
    before = np.concatenate([[0], np.cumsum(periods)])
    found = [np.zeros((4, 0), np.int64)]
    for low in range(0, int(before[-1]), TRIALS):
        trial = np.arange(low, min(low + TRIALS, int(before[-1])))
        rule = np.searchsorted(before, trial, "right") - 1
        q, m = trial - before[rule] + 1, middle[rule]
        side = np.maximum(half * q, q + 1)
        to_left, to_right = m - side >= begin[rule], m + side <= end[rule]
        for fits, shift in ((to_left, -q), (to_right, q)):
            k = np.flatnonzero(fits)
            k = k[ids[m[k] - 1] == ids[m[k] - 1 + shift[k]]]
            k = k[ids[m[k]] == ids[m[k] + shift[k]]]
            at = m[k] + np.minimum(shift[k], 0)
            p, r = q[k], rule[k]
            start = at - sums.extent(at, p, at - begin[r], back=True)
            stop = at + sums.extent(at, p, end[r] - at - p, back=False) + p
            long = stop - start >= np.maximum(least, exponent * p)
            found.append(np.stack([r, start, stop, p])[:, long])
    rule, start, stop, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, stop, start, rule))
    rule, start, stop, p = rule[order], start[order], stop[order], p[order]
    new = np.ones(len(rule), bool)
    new[1:] = (rule[1:] != rule[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return rule[new], start[new], stop[new], p[new]


def derived(g: Grammar, size: np.ndarray, rule: np.ndarray, low: np.ndarray, high: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rules' runs (from word ``low`` to ``high`` of the expansion) at all places where the rules are derived.

    A rule whose expansion is one run, with nothing but pieces of it below, is not descended into.
    """
    rules = len(g.left)
    own = np.bincount(rule, minlength=rules)
    pointer = np.concatenate([[0], np.cumsum(own)])
    kind = np.zeros(g.terminals + rules, np.int64)  # 0: no run; a period: one run and its pieces; -1: others
    whole = (low == 0) & (high == size[g.terminals + rule]) & (own[rule] == 1)
    alone = np.where(own > 0, -1, 0)
    alone[rule[whole]] = period[whole]
    for first, last in g.rounds:
        left, right, mine = kind[g.left[first:last]], kind[g.right[first:last]], alone[first:last]
        pure = (mine > 0) & ((left == 0) | (left == mine)) & ((right == 0) | (right == mine))
        none = (mine == 0) & (left == 0) & (right == 0)
        kind[g.terminals + first : g.terminals + last] = np.where(pure, mine, np.where(none, 0, -1))
    starts, stops, periods = [], [], []
    sym, at = g.roots, g.root_at
    while len(sym):
        alive = kind[sym] != 0
        sym, at = sym[alive], at[alive]
        number = sym - g.terminals
        many = own[number]
        each = np.repeat(pointer[number], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        base = np.repeat(at, many)
        starts.append(base + low[each])
        stops.append(base + high[each])
        periods.append(period[each])
        mixed = kind[sym] < 0
        number, at = number[mixed], at[mixed]
        sym = np.concatenate([g.left[number], g.right[number]])
        at = np.concatenate([at, at + size[g.left[number]]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *starts]), np.concatenate([empty, *stops]), np.concatenate([empty, *periods])


def merged(text: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of one text and period that share a whole period are one run; sorted by text, start, period."""
    order = np.lexsort((start, period, text))
    text, start, stop, period = text[order], start[order], stop[order], period[order]
    if len(text):
        group = np.cumsum(np.r_[True, (np.diff(text) != 0) | (np.diff(period) != 0)])
        lift = group * (int(stop.max()) + int(period.max()) + 1)  # groups follow each other on one line
        reach = np.maximum.accumulate(stop + lift) - lift
        new = np.r_[True, (np.diff(group) != 0) | (start[1:] + period[1:] > reach[:-1])]
        heads = np.flatnonzero(new)
        text, start, stop, period = text[heads], start[heads], np.maximum.reduceat(stop, heads), period[heads]
    order = np.lexsort((period, start, text))
    return text[order], start[order], stop[order], period[order]


def repeat_throughout(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> bool:
    """Whether all words of all runs do equal those a period before."""
    size = stop - start - period
    before = np.concatenate([[0], np.cumsum(size)])
    for low in range(0, int(before[-1]), TRIALS):
        word = np.arange(low, min(low + TRIALS, int(before[-1])))
        run = np.searchsorted(before, word, "right") - 1
        at = start[run] + word - before[run]
        if (ids[at] != ids[at + period[run]]).any():
            return False
    return True


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """All runs: text, start and end among all ids, smallest period; sorted by text, start, period."""
    g = compress(ids, starts)
    size = lengths_of(g)
    first = first_places(g, size)
    middle, end = first + size[g.left], first + size[g.terminals :]
    seed = 0
    while True:
        seed += 1
        rule, start, stop, period = crossing_runs(ids, Sums(ids, seed), first, middle, end, least, exponent)
        start, stop, period = derived(g, size, rule, start - first[rule], stop - first[rule], period)
        text = np.searchsorted(starts, start, "right") - 1
        result = merged(text, start, stop, period)
        if repeat_throughout(ids, *result[1:]):
            return result


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Each row's ``key``, ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``.

    Words are what white space of ASCII parts. A run has at least ``least``
    words and ``exponent`` whole periods (three or more). ``collapsed`` is the
    text without the words that some run holds after its first period, joined
    by single spaces. Null, empty and blank texts have no words, no runs and an
    empty ``collapsed``; null keys and repeated rows are worked on row by row;
    an empty table gives an empty result; other columns are not read. Nothing
    is shuffled. A very long text takes memory in proportion, some 100 bytes a
    word for each of a few arrays.
    """
    if exponent < 3:
        raise ValueError("a run takes three periods or more")
    key_type = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            data, offsets = packed(batch.column(1))
            for low, high in slices(offsets, SLICE_BYTES):
                body = data[offsets[low] : offsets[high]].tobytes()
                cuts = (offsets[low : high + 1] - offsets[low]).tolist()
                yield judged(batch.column(0).slice(low, high - low), [body[a:b].split() for a, b in zip(cuts, cuts[1:])], least, exponent)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {key_type}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(work, schema).withColumnRenamed("key", key)


def judged(keys: pa.Array, texts: list[list[bytes]], least: int, exponent: int) -> pa.RecordBatch:
    """One output row for each text's words."""
    starts = np.cumsum([0, *map(len, texts)])
    words = [word for text in texts for word in text]
    number = {word: i for i, word in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    owner, start, stop, period = runs_of(ids, starts, least, exponent)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, stop, -1)
    kept = np.cumsum(change)[:-1] == 0
    counts = np.bincount(owner, minlength=len(texts))
    collapsed = []
    for i, text in enumerate(texts):
        if counts[i]:
            text = [word for word, keep in zip(text, kept[starts[i] : starts[i + 1]].tolist()) if keep]
        collapsed.append(b" ".join(text))
    struct = pa.StructArray.from_arrays([pa.array(start - starts[owner]), pa.array(stop - start), pa.array(period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), struct)
    columns = [keys, pa.array(np.diff(starts)), runs, pa.array(collapsed, pa.binary()).view(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])
