"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly when each adjacent
pair of tokens is the encoding of its own bytes. The encodings of all prefixes
of a text can so be built from left to right: the prefix up to a position ends
with the one token that fits the encoding of the prefix before it. A state
holds what the future needs: for each start from which some longer token may
still come, the place in the trie of tokens and the token before that start.
When only the present position is left as a start, all before it is settled and
emitted: the lookahead is bounded by the chain of tokens that overlap. States
and moves are made when first reached and kept in the worker.
"""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.llm.batches import lists_of, parts
from estate_spark.llm.caches import claim, held_by, rest
from estate_spark.llm.pretokens import TextEncoder

STATES = 100_000  # kept in a worker before it starts anew
PAIRS = 300_000
DECODE_IDS = 65_536  # ids decoded at once
AT_ONCE = 1024  # bytes of a match up to which its tokens are traced back in one go, settled or not


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, one base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Moves(dict):
    """256 * state + byte to what ``determinise`` finds, filled on demand."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, key):
        self[key] = move = self.machine.determinise(key >> 8, key & 255)
        return move


class Transducer:
    """Encodes one pre-token's bytes by ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        if not {bytes([b]) for b in range(256)} <= set(ranks):
            raise ValueError("the vocabulary lacks a byte")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # trie of all tokens: node | byte to node; nodes are multiples of 256
        self.ends: dict[int, int] = {}  # the token that ends at a node
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.child.setdefault(node | byte, len(self.child) + 1 << 8)
            self.ends[node] = rank
        self.inner = {key & ~255 for key in self.child}
        self.pairs: dict[int, bool] = {}
        self.restart()

    def restart(self) -> None:
        self.states: list[tuple] = [((0, -1),)]
        self.numbers = {self.states[0]: 0}
        self.moves = Moves(self)

    def merges(self, data: bytes) -> list[int]:
        """The definition: join the adjacent pair of lowest rank, leftmost first, while there is one."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        scores = [get(a + b, 1 << 62) for a, b in zip(parts, parts[1:])]
        while scores and (best := min(scores)) < 1 << 62:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], 1 << 62)
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], 1 << 62)
        return [self.ranks[part] for part in parts]

    def stay_apart(self, first: bytes, second: bytes) -> bool:
        """Whether merges of both together give just these two; ends with the first merge across their border."""
        data, get, border = first + second, self.ranks.get, len(first)
        parts = [data[i : i + 1] for i in range(len(data))]
        scores = [get(data[i : i + 2], 1 << 62) for i in range(len(data) - 1)]
        while (best := min(scores)) < 1 << 62:
            at = scores.index(best)
            if at == border - 1:
                return False
            if at < border:
                border -= 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], 1 << 62)
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], 1 << 62)
        return len(parts) == 2

    def fits(self, left: int, right: int) -> bool:
        """Whether these neighbours stay as they are; with no left one (-1), whether merges reach the token."""
        pair = left << 32 | right
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.merges(self.token[right]) == [right] if left < 0 else self.stay_apart(self.token[left], self.token[right])
            self.pairs[pair] = found
        return found

    def determinise(self, state: int, byte: int) -> tuple[int, int, bool]:
        """Next state times 256, the token that the bytes so far end with, and whether all up to here is settled."""
        last, live, child, ends, inner, pair = None, [], self.child.get, self.ends.get, self.inner, self.pairs.get
        for node, before in self.states[state]:
            following = child(node | byte)
            if following is None:
                continue
            if last is None and (rank := ends(following)) is not None:
                known = pair(before << 32 | rank)
                if known or (known is None and self.fits(before, rank)):
                    last = rank
            if following in inner:
                live.append((following, before))
        live.append((0, last))
        target = tuple(live)
        number = self.numbers.setdefault(target, len(self.states))
        if number == len(self.states):
            self.states.append(target)
        return number << 8, last, len(live) == 1

    def encode(self, data: bytes) -> list[int]:
        if data in self.ranks:  # a match that is a token is that token, whatever merges give
            return [self.ranks[data]]
        if len(self.states) > STATES:
            self.restart()
        state, out, pending, moves = 0, [], [], self.moves
        keep = pending.append
        if len(data) <= AT_ONCE:
            for byte in data:
                state, last, _ = moves[state | byte]
                keep(last)
            return self.trace(pending)
        for byte in data:
            state, last, settled = moves[state | byte]
            keep(last)
            if settled:
                out += self.trace(pending)
                pending.clear()
        return out + self.trace(pending)

    def trace(self, pending: list[int]) -> list[int]:
        """Tokens of the bytes not yet emitted, from the token each of them ends with."""
        out, at, length = [], len(pending), self.length
        while at > 0:
            token = pending[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out


class Utf8Machine:
    """Incremental UTF-8: ``feed`` bytes, get the text of all characters completed so far.

    The state is the unfinished character at the end: how many bytes it still
    needs, told by its first byte. Broken bytes become U+FFFD and make
    ``valid`` false.
    """

    def __init__(self):
        self.pending, self.valid = b"", True

    def unfinished(self, data: bytes) -> int:
        """Length of the unfinished character at the end of ``data``."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return back if back < need else 0
            if lead < 0x80:
                return 0
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.pending + data
        cut = len(data) if last else len(data) - self.unfinished(data)
        self.pending = data[cut:]
        try:
            return data[:cut].decode("utf-8")
        except UnicodeDecodeError:
            self.valid = False
            return data[:cut].decode("utf-8", "replace")


def decode_stream(chunks: Iterable[bytes]) -> Iterator[str]:
    """Text pieces of a stream of token bytes; no character is ever torn."""
    machine = Utf8Machine()
    for chunk in chunks:
        if piece := machine.feed(chunk):
            yield piece
    if piece := machine.feed(b"", last=True):
        yield piece


@lru_cache(maxsize=2)
def worker_encoder(path: str, pattern: str) -> TextEncoder:
    """One transducer and its memos for each worker."""
    machine = Transducer(read_ranks(path))

    def piece(match: str) -> bytes:
        ids = machine.encode(match.encode("utf-8"))
        return struct.pack(f"<{len(ids)}i", *ids)

    return TextEncoder(pattern, piece)


held_by("byte_bpe", worker_encoder.cache_clear)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes | None]:
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """Each row's ``key`` and token ids of its whole text, as an array of int.

    Null and empty texts give an empty array; rows with null or repeated keys
    are encoded each; an empty table gives an empty result; other columns are
    not read.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("byte_bpe")
        encoder = worker_encoder(ranks_path, pattern)
        gc.disable()  # memos hold many tuples and no cycles; looking through them again and again takes a third of the time
        try:
            for batch in parts(batches):
                chunks = [encoder.encode(value or "") for value in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(chunks, "<i4", pa.int32())], ["key", "ids"])
        finally:
            gc.enable()
            rest()

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {key_type}, ids array<int>")
    return out.toDF(key, ids)


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded", valid: str = "valid_utf8") -> DataFrame:
    """``tokens`` with the bytes of its ids, and whether they are whole UTF-8 characters.

    Null ids decode to no bytes. An id outside the vocabulary, or a null inside
    the list, raises: it has no bytes.
    """
    if {decoded, valid} & set(tokens.columns):
        raise ValueError(f"{decoded} and {valid} must not be columns already")
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    place = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("byte_bpe")
        table = token_bytes(ranks_path)
        for batch in parts(batches):
            bodies, whole = [], []
            for row in batch.column(place):
                numbers = np.zeros(0, np.int32) if row.values is None else row.values.to_numpy(zero_copy_only=False)
                machine, pieces = Utf8Machine(), []
                for at in range(0, len(numbers), DECODE_IDS):
                    piece = b"".join(map(table.__getitem__, numbers[at : at + DECODE_IDS].tolist()))
                    machine.feed(piece)
                    pieces.append(piece)
                machine.feed(b"", last=True)
                bodies.append(b"".join(pieces))
                whole.append(machine.valid)
            columns = [*batch.columns, pa.array(bodies, pa.binary()), pa.array(whole, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, decoded, valid])

    return tokens.mapInArrow(run, f"{given}, `{decoded}` binary, `{valid}` boolean")
