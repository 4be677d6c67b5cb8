"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file is: frames, each holding the ids of whole documents (little-endian
unsigned 16 or 32 bit) with zstandard's own content checksum; a skippable frame
with the documents' keys and id counts; a skippable frame with the seek table
of the public seekable format (each frame's two sizes and the low 32 bits of
XXH64 of its content). A reader fetches the end of the file, then only the
frames of the documents it wants.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estate_spark.llm.batches import a_task_each, read_file, write_file
from estate_spark.llm.pretokens import TextEncoder

# Fixed values of the public seekable zstandard format, and the same kind of skippable frame for the documents.
SKIPPABLE_DOCS, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FRAME_BYTES = 1 << 20  # of ids in a frame, beyond a single longer document
LEVEL = 3
NULL_KEY = -(1 << 63)


class FrameWriter:
    """Writes documents' ids to one file."""

    def __init__(self, uri: str, dtype: str):
        self.sink, self.dtype = write_file(uri), np.dtype(dtype)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []  # key, ids, frame
        self.held: list[bytes] = []
        self.size = self.ids = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        data = ids.astype(self.dtype).tobytes()
        if self.held and self.size + len(data) > FRAME_BYTES:
            self.flush()
        self.held.append(data)
        self.size += len(data)
        self.ids += len(ids)
        self.docs.append((NULL_KEY if key is None else key, len(ids), len(self.table)))

    def flush(self) -> None:
        content = b"".join(self.held)
        frame = self.compressor.compress(content)
        self.sink.write(frame)
        self.table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        docs = np.array(self.docs, "<i8").tobytes()
        docs += struct.pack("<IB", len(self.docs), self.dtype.itemsize)
        self.sink.write(struct.pack("<II", SKIPPABLE_DOCS, len(docs)) + docs)
        seek = b"".join(struct.pack("<III", *entry) for entry in self.table)
        seek += struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.sink.close()


class FrameReader:
    """Reads documents' ids from one file, decompressing only the frames asked for."""

    def __init__(self, uri: str):
        self.source = read_file(uri)
        end = self.source.size()
        frames, flags, magic = struct.unpack("<IBI", self.source.read_at(9, end - 9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table with checksums")
        at = end - 9 - 12 * frames
        self.table = np.frombuffer(self.source.read_at(12 * frames, at), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        count, width = struct.unpack("<IB", self.source.read_at(5, at - 8 - 5))
        self.docs = np.frombuffer(self.source.read_at(24 * count, at - 8 - 5 - 24 * count), "<i8").reshape(-1, 3)
        self.dtype = np.dtype(f"<u{width}")
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> np.ndarray:
        packed, size, checksum = (int(v) for v in self.table[number])
        content = self.decompressor.decompress(self.source.read_at(packed, int(self.starts[number])), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} does not match its checksum")
        return np.frombuffer(content, self.dtype)

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """Keys and ids in file order, all or those of ``wanted`` keys."""
        keep = np.ones(len(self.docs), bool) if wanted is None else np.isin(self.docs[:, 0], list(wanted))
        for number in np.unique(self.docs[keep, 2]):
            inside = self.docs[:, 2] == number
            ends = np.cumsum(self.docs[inside, 1])
            ids = self.frame(int(number))
            for (key, count, _), end, take in zip(self.docs[inside].tolist(), ends.tolist(), keep[inside]):
                if take:
                    yield (None if key == NULL_KEY else key), ids[end - count : end]


@lru_cache(maxsize=2)
def library_encoder(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of a whole text as the tokenizers library gives them, without added tokens, one encoder a worker.

    The library's BPE model encodes each distinct pre-token once; texts that
    hold the string of a special token go through the library as a whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    specials = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    # The format writes printable Latin-1 bytes as themselves, all others from code point 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {byte: chr(byte) for byte in printable}
    letters |= {byte: chr(256 + n) for n, byte in enumerate(b for b in range(256) if b not in letters)}

    def piece(match: str) -> bytes:
        tokens = model.tokenize(match.encode("utf-8").decode("latin-1").translate(letters))
        return struct.pack(f"<{len(tokens)}I", *[token.id for token in tokens])

    words = TextEncoder(pattern, piece)

    def encode(text: str) -> np.ndarray:
        if any(special in text for special in specials):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(words.encode(text), "<u4")

    return encode


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, pattern: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids in ascending order of ``key`` and return the manifest: part, file, n_docs, n_ids.

    One file for each key range; ``part`` numbers them in key order. Files of
    attempts that failed stay out of the manifest. ``end_id`` is put after each
    document. Null texts are empty; null keys come first; rows with equal keys
    follow one another, ordered by text. ``key`` is an integer. The manifest is
    a table in ``folder``: it is computed once.
    """
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(vocabulary, (end_id or 0) + 1) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = library_encoder(tokenizer_path, pattern), None
        task = TaskContext.get()
        name = f"{folder}/ids-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}.zst"
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer = writer or FrameWriter(name, dtype)
                writer.add(doc, np.concatenate([encode(value or ""), tail]))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()]), pa.array([name]), pa.array([len(writer.docs)]), pa.array([writer.ids])],
                ["part", "file", "n_docs", "n_ids"],
            )

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    manifest = ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, digest_only: bool = False) -> DataFrame:
    """All documents of the files: doc_id, start (ids before it in the whole order), n_tokens, ids_crc32 and, unless ``digest_only``, ids.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers.
    Each file is read by one task, frame by frame.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = a_task_each(placed.select("file", "before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                held = 0
                for key, ids in FrameReader(file).documents():
                    wide = ids.astype("<u4")
                    rows.append((key, start, len(ids), zlib.crc32(wide.tobytes()), *([] if digest_only else [wide.astype(np.int64)])))
                    start += len(ids)
                    held += 1 if digest_only else len(ids)
                    if held > FRAME_BYTES:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names[: len(rows[0])])

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>"))
