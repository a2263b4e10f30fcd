"""Length-delimited binary records of token ids, with an offset index beside them.

A record is: payload length (8 bytes), masked CRC-32C of those bytes (4), payload, masked CRC-32C of the payload (4), all
little-endian. A payload is one byte, the width of an id (2 where the vocabulary fits, else 4), then the ids. Files hold
ascending ``doc_id``; file numbers ascend too. The index is a table of its own: one row per record with file, record
number, offset, payload length, ids and ids before it in the file; it serves reads in any order.

Null ``doc_id``s come first; equal ones are ordered by text. A null text is empty and has the end id alone. Extra columns
are not written. An empty table gives no file and an empty index.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.llm import shared, word_ids

POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
MASK_DELTA = 0xA282EAD8
CHUNK = 256
INDEX = "doc_id long, file int, record int, offset long, length long, n_tokens long, start_in_file long"


def _operators(out: list[np.ndarray] = []) -> list[np.ndarray]:  # noqa: B006  (made once in a process)
    """Tables (4, 256) that carry a remainder over 1, 2, 4, ... zero bytes."""
    if out:
        return out
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(POLYNOMIAL), row >> 1).astype(np.uint32)
    states = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out.append(row[states & 0xFF] ^ (states >> np.uint32(8)))
    for _ in range(47):
        out.append(_over(out[-1], out[-1]))
    return out


def _over(op: np.ndarray, state: np.ndarray) -> np.ndarray:
    return op[0][state & 0xFF] ^ op[1][(state >> np.uint32(8)) & 0xFF] ^ op[2][(state >> np.uint32(16)) & 0xFF] ^ op[3][state >> np.uint32(24)]


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of many byte spans at once: remainders of equal chunks, then folded span by span."""
    ops = _operators()
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    chunks = -(-lengths // CHUNK)
    firsts = np.cumsum(chunks) - chunks
    lined = np.zeros(int(chunks.sum()) * CHUNK, np.uint8)
    # right-aligned: leading zeros do not change a remainder that starts at zero
    lined[shared.ragged((firsts + chunks) * CHUNK - lengths, lengths)] = data[shared.ragged(starts, lengths)]
    words = lined.view("<u4").reshape(-1, CHUNK // 4)
    state = np.zeros(len(words), np.uint32)
    for k in range(CHUNK // 4):
        state = _over(ops[2], state ^ words[:, k])
    total, live, step = np.zeros(len(starts), np.uint32), np.flatnonzero(chunks), 0
    while len(live):
        total[live] = _over(ops[8], total[live]) ^ state[firsts[live] + step]
        step += 1
        live = live[chunks[live] > step]
    begin = np.full(len(starts), 0xFFFFFFFF, np.uint32)  # the starting value, carried over the whole span
    for k in range(48):
        at = np.flatnonzero((lengths >> k) & 1)
        if len(at):
            begin[at] = _over(ops[k], begin[at])
    return total ^ begin ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def framed(payloads: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of the payload spans, one after the other, and the offset of each."""
    sizes = lengths + 16
    offsets = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    heads = np.ascontiguousarray(lengths.astype("<u8")).view(np.uint8)
    eight = np.full(len(lengths), 8, np.int64)
    head_at = np.arange(len(lengths)) * 8

    def put(at, values):
        out[at[:, None] + np.arange(values.itemsize)] = np.ascontiguousarray(values).view(np.uint8).reshape(len(at), -1)

    put(offsets, lengths.astype("<u8"))
    put(offsets + 8, masked(crc32c(heads, head_at, eight)).astype("<u4"))
    out[shared.ragged(offsets + 12, lengths)] = payloads[shared.ragged(starts, lengths)]
    put(offsets + 12 + lengths, masked(crc32c(payloads, starts, lengths)).astype("<u4"))
    return out, offsets


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, path: str, end_id: int, most_words: int = 3_000_000) -> DataFrame:
    """Write the ids of ``docs.text`` in ascending ``doc_id`` under ``folder``; the index, read back from its table.

    Rows are range-partitioned on ``doc_id`` and sorted in each task, which streams one file. A file is written under a
    name of its attempt and then renamed, so a task that runs twice leaves one whole file.
    """
    spark, vocab = docs.sparkSession, word_ids.vocabulary(path)
    wide = 2 if max(vocab["size"], end_id + 1) <= 1 << 16 else 4
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, task = word_ids.Encoder(vocab, most_words), TaskContext.get()
        disk, root = _open(folder)
        number, out = task.partitionId(), None
        name = f"{root}/data/part-{number:06d}.rec"
        offset = record = before = 0
        for batch in batches:
            for row, ids, counts in encoder.encode(batch.column("text")):
                if out is None:
                    disk.create_dir(f"{root}/data", recursive=True)
                    out = disk.open_output_stream(f"{name}.{task.taskAttemptId()}")
                more = counts + 1
                ends = np.cumsum(more)
                whole = np.full(int(ends[-1]), end_id, f"<u{wide}")
                whole[shared.ragged(ends - more, counts)] = ids
                lengths = 1 + wide * more
                firsts = np.cumsum(lengths) - lengths
                payload = np.full(int(lengths.sum()), wide, np.uint8)
                payload[shared.ragged(firsts + 1, lengths - 1)] = whole.view(np.uint8)
                framed_bytes, offsets = framed(payload, firsts, lengths)
                out.write(framed_bytes.tobytes())
                n = len(counts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(row, n).cast(pa.int64()), pa.array(np.full(n, number, np.int32)),
                    pa.array(np.arange(record, record + n, dtype=np.int32)), pa.array(offsets + offset),
                    pa.array(lengths), pa.array(more), pa.array(before + ends - more)],
                    ["doc_id", "file", "record", "offset", "length", "n_tokens", "start_in_file"])
                offset, record, before = offset + len(framed_bytes), record + n, before + int(ends[-1])
        if out is not None:
            out.close()
            disk.move(f"{name}.{task.taskAttemptId()}", name)

    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """``start``: ids of all records before, over all files. The window runs over one row per file."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("of"), F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("before"))
    return index.join(files, F.col("file") == F.col("of")).withColumn("start", F.col("before") + F.col("start_in_file")).drop("of", "before")


def read_records(index: DataFrame, folder: str, held: int = 4 << 20) -> DataFrame:
    """Rows of the index in any order, with ``ids`` (little-endian unsigned 32-bit integers) read from the files.

    Lengths and both checksums of every record are verified; a mismatch fails the task.
    """
    from pyspark.sql.types import BinaryType, StructType

    schema = StructType([*index.schema.fields]).add("ids", BinaryType())

    def read(batches):
        import pyarrow as pa

        disk, root = _open(folder)
        now = file = None
        for batch in batches:
            numbers, offsets, lengths = (batch.column(n).to_pylist() for n in ("file", "offset", "length"))
            row = 0
            while row < len(numbers):
                first, size, records = row, 0, []
                while row < len(numbers) and (size < held or row == first):
                    if numbers[row] != now:
                        if file is not None:
                            file.close()
                        now = numbers[row]
                        file = disk.open_input_file(f"{root}/data/part-{now:06d}.rec")
                    file.seek(offsets[row])
                    records.append(file.read(lengths[row] + 16))
                    size += lengths[row] + 16
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, row - first) for c in batch.columns), pa.array(_ids(records), pa.binary())], schema.names)
        if file is not None:
            file.close()

    return index.mapInArrow(read, schema)


def _ids(records: list[bytes]) -> list[bytes]:
    sizes = np.array([len(r) for r in records], np.int64)
    data, starts = np.frombuffer(b"".join(records), np.uint8), np.cumsum(sizes) - sizes
    heads = crc32c(data, starts, np.full(len(sizes), 8))
    bodies = crc32c(data, starts + 12, sizes - 16)
    out = []
    for record, head, body in zip(records, masked(heads).tolist(), masked(bodies).tolist(), strict=True):
        length, first = struct.unpack_from("<QI", record)
        if length != len(record) - 16 or first != head or struct.unpack_from("<I", record, 12 + length)[0] != body:
            raise ValueError("damaged record")
        out.append(np.frombuffer(record, f"<u{record[12]}", offset=13, count=(length - 1) // record[12]).astype("<u4").tobytes())
    return out
