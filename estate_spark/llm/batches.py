"""Arrow batches as Python values and packed bytes; files on shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20  # text worked on at once by the numpy operators, beyond a single longer text


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut into shorter ones, so that what is made from one of them stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values' bytes in one array, and where each value starts (one more entry than values); null is empty."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = filled.buffers()
    starts = np.frombuffer(offsets, np.int64, len(filled) + 1, filled.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole values of about ``size`` bytes; a longer value stands alone."""
    low, last = 0, len(starts) - 1
    while low < last:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + size, "right")) - 1)
        yield low, high
        low = high


def lists_of(chunks: list[bytes], dtype: str, arrow: pa.DataType) -> pa.Array:
    """A list column from each row's packed little-endian numbers."""
    width = np.dtype(dtype).itemsize
    ends = np.cumsum([0, *map(len, chunks)]) // width
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(chunks), dtype), arrow))


def write_file(uri: str) -> pa.NativeFile:
    """Open a file for writing by any scheme Arrow knows, its folder made if need be."""
    store, path = pa.fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def read_file(uri: str) -> pa.NativeFile:
    store, path = pa.fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def a_task_each(files: DataFrame) -> DataFrame:
    """Rows of a manifest dealt out so that about each ``file`` has a task; a given number is not merged by size, as names are tiny."""
    return files.repartitionByRange(max(1, files.count()), "file")


def keyed_schema(docs: DataFrame, key: str, others: str) -> T.StructType:
    """The key's own type, whatever it is, as ``key``, and the columns of a schema string."""
    return T.StructType([T.StructField("key", docs.schema[key].dataType), *T.StructType.fromDDL(others).fields])


def thinned(labelled: DataFrame, by: str | list[str], spread: Column, rows: int) -> DataFrame:
    """About eight times ``rows`` rows of each group, or all it has, by a hash: what goes on does not grow with the table.

    The groups are few: classes, or languages.
    """
    return labelled.where(thinning(labelled, by, spread, rows))


def thinning(labelled: DataFrame, by: str | list[str], spread: Column, rows: int) -> Column:
    """The condition by which :func:`thinned` keeps rows, from the sizes of the groups."""
    by = [by] if isinstance(by, str) else by
    counts = labelled.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > 8 * rows).collect()
    keep = F.lit(True)
    for found in counts:
        share = int((1 << 30) * 8 * rows / found["n"]) + 1
        mine = F.lit(True)
        for name in by:
            mine = mine & F.col(name).eqNullSafe(F.lit(found[name]))
        keep = F.when(mine, F.pmod(spread, F.lit(1 << 30)) < share).otherwise(keep)
    return keep


def text_rows(docs: DataFrame, key: str, text: str, *others: Column) -> DataFrame:
    """``key``, ``text`` and others as operators take them; a text that is a field of the key is not sent a second time."""
    sent = [] if text.startswith(f"{key}.") else [F.col(text).alias("text")]
    return docs.select(F.col(key).alias("key"), *sent, *others)


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The texts of a batch of :func:`text_rows`."""
    if "text" in batch.schema.names:
        return batch.column("text")
    return pc.struct_field(batch.column("key"), text.rpartition(".")[2])
