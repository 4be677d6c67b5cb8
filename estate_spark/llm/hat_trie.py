"""Phrase counts in a burst trie: hash containers under a shallow trie of word ids, spilled by whole subtrees."""

from __future__ import annotations

import numpy as np

ID_BITS = 21  # of a word id within a packed key; id 0 stands for no word
WORDS = 1 << ID_BITS
BURST = 2_048  # entries of a container that is cut by its next word


class HatTrie:
    """Counts of phrases of one to four word ids.

    A phrase is its first word and a packed key of the up to three words after
    it. A word alone is counted at its node. Longer phrases are kept in hash
    containers: one for each first word, and once such a container holds more
    than ``burst`` entries it bursts into one for each second word. ``entries``
    is the number of phrases in containers.
    """

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.alone = np.zeros(0, np.int64)  # by word
        self.trie: dict[int, dict] = {}  # first word: container, or containers by second word
        self.cut: set[int] = set()  # first words whose container has burst
        self.sizes: dict[int, int] = {}  # entries under each first word
        self.hits: dict[int, int] = {}  # phrases counted there
        self.entries = 0

    def add_words(self, words: np.ndarray) -> None:
        counts = np.bincount(words, minlength=len(self.alone))
        counts[: len(self.alone)] += self.alone
        self.alone = counts

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """Count phrases of two words or more, each once for every time it is given."""
        if not len(first):
            return
        if (rest & (1 << 2 * ID_BITS) - 1).any():
            order = np.lexsort((rest, first))
            first, rest = first[order], rest[order]
        else:  # pairs: both words in one number
            pairs = np.sort(first << ID_BITS | rest >> 2 * ID_BITS)
            first, rest = pairs >> ID_BITS, (pairs & WORDS - 1) << 2 * ID_BITS
        heads = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])
        counts = np.diff(np.r_[heads, len(first)]).tolist()
        first, keys = first[heads], rest[heads].tolist()
        bounds = np.flatnonzero(np.r_[True, first[1:] != first[:-1], True])
        hits = np.diff(np.r_[heads, len(rest)][bounds]).tolist()
        bounds = bounds.tolist()
        for word, hit, low, high in zip(first[bounds[:-1]].tolist(), hits, bounds, bounds[1:]):
            new = self._fill(word, keys[low:high], counts[low:high])
            self.sizes[word] = self.sizes.get(word, 0) + new
            self.hits[word] = self.hits.get(word, 0) + hit
            self.entries += new

    def _fill(self, word: int, keys: list[int], counts: list[int]) -> int:
        """Add to the subtree of one first word; the number of new entries."""
        node = self.trie.get(word)
        if node is None:
            self.trie[word] = dict(zip(keys, counts))
            return len(keys)
        if word in self.cut:
            new = 0
            for key, count in zip(keys, counts):
                inner = node.setdefault(key >> 2 * ID_BITS, {})
                new -= len(inner)
                inner[key] = inner.get(key, 0) + count
                new += len(inner)
            return new
        before = len(node)
        for key, count in zip(keys, counts):
            node[key] = node.get(key, 0) + count
        if len(node) > self.burst:
            children: dict[int, dict] = {}
            for key, count in node.items():
                children.setdefault(key >> 2 * ID_BITS, {})[key] = count
            self.trie[word] = children
            self.cut.add(word)
        return len(node) - before

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out whole subtrees until at most ``keep`` entries are left: first words, keys, counts.

        Those go first whose phrases have recurred the least. Words alone are taken out with ``keep`` 0.
        """
        words, keys, counts, sizes = [], [], [], []
        for word in sorted(self.sizes, key=lambda w: self.hits[w] / self.sizes[w]):
            if self.entries <= keep:
                break
            node = self.trie.pop(word)
            containers = node.values() if word in self.cut else (node,)
            for container in containers:
                keys.extend(container)
                counts.extend(container.values())
            words.append(word)
            sizes.append(self.sizes.pop(word))
            self.entries -= sizes[-1]
            self.cut.discard(word)
            del self.hits[word]
        first = np.repeat(np.array(words, np.int64), sizes)
        keys, counts = np.array(keys, np.int64), np.array(counts, np.int64)
        if keep == 0 and len(self.alone):
            single = np.flatnonzero(self.alone)
            first, keys, counts = np.r_[first, single], np.r_[keys, single * 0], np.r_[counts, self.alone[single]]
            self.alone = self.alone[:0]
        return first, keys, counts


def packed_rest(*words: np.ndarray) -> np.ndarray:
    """The key of the words after the first: three fields of ``ID_BITS``, absent words 0."""
    key = np.zeros(len(words[0]), np.int64)
    for word in words:
        key = key << ID_BITS | word
    return key << ID_BITS * (3 - len(words))


def unpacked_rest(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words after the first."""
    return key >> 2 * ID_BITS, key >> ID_BITS & WORDS - 1, key & WORDS - 1
