"""Helpers of this subpackage: shared folders, written tables, whole-text byte work on numpy arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and the controls 9 to 13.
SPACES = "\\x20\\x09-\\x0D"
#: Bytes worked on at once, so that memory does not follow the length of a text.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor reaches, under the one that ``spark.checkpoint.dir`` names.

    A folder of this machine is used only by a local session that names none.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = "file://" + tempfile.mkdtemp(prefix="daygrid-llm-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read back: lineage is cut and lost executors cost one stage at most."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory of a worker to the system, so that idle workers of an executor hold little."""
    import contextlib
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def bucket_of(column: str, n: int):
    """crc32 of the decimal text of an id, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow text column and the n + 1 offsets of its rows; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = PIECE):
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end
        row = end


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A full-avalanche mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, of bytes and length alone.

    Eight bytes are packed to a word, each word is mixed with its place in the span, and the sum is mixed again.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lengths = ends - starts
    live, place = np.arange(len(starts)), 0
    while len(live) and place < 2:
        left = lengths[live] - 8 * place
        at = starts[live] + 8 * place
        word = np.zeros(len(live), np.uint64)
        for k in range(8):
            word |= np.where(left > k, padded[np.minimum(at + k, len(data))], 0).astype(np.uint64) << np.uint64(8 * k)
        out[live] += mixed(word + np.uint64((place + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        live = live[left > 8]
        place += 1
    # what is longer: all its words at once, some of them at a time
    blocks = -(-(lengths[live] - 8 * place) // 8)
    ends_at = np.cumsum(blocks)
    step, eight = 1 << 17, np.arange(8)
    for a in range(0, int(ends_at[-1]) if len(live) else 0, step):
        number = np.arange(a, min(a + step, int(ends_at[-1])))
        span = np.searchsorted(ends_at, number, side="right")
        nth = number - (ends_at - blocks)[span] + place
        left = lengths[live[span]] - 8 * nth
        at = (starts[live[span]] + 8 * nth)[:, None] + eight
        word = np.where(eight < left[:, None], padded[np.minimum(at, len(data))], 0).astype(np.uint8).view("<u8").reshape(-1)
        first = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])
        out[live[span[first]]] += np.add.reduceat(mixed(word + (nth + 1).astype(np.uint64) * _ODD), first)
    return mixed(out ^ (lengths.astype(np.uint64) * _ODD))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one span after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
