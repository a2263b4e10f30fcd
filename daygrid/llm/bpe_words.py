"""BPE by a distinct-word table: texts are split to words, each distinct word is encoded once, ids go back by position.

Rows are packed to blocks of bounded size. A block sends its distinct words, packed, to buckets of their hash; a bucket
encodes each distinct word of all blocks once and answers every block in the order of the hashes; a block then puts the
ids in the places of its words. Words travel once per block, never once per position, and texts are moved once,
compressed. Decoding takes pieces by id from a table of the vocabulary and joins their bytes.

A null text is empty: no ids, empty decoded text. Repeated rows stay. Columns of the input stay too, but for ``ids`` and
``decoded``, which are replaced. Added tokens of the vocabulary found in a text become their ids, as the tokenizer does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from daygrid.llm import shared, word_ids

#: Bytes of text in a block and in one packed row of it, about; a longer text is a row of its own.
BLOCK_BYTES, ROW_BYTES = 6 << 20, 2 << 20
PACKED = "bucket int, block long, packed binary"


def _hashed(splitter, column):
    """Slices of a text column as (first row, bytes, row offsets, word starts, word ends, word hashes)."""
    data, offsets = shared.text_bytes(column)
    for a, b in shared.slices(offsets):
        piece, rows = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends = splitter.spans(piece, rows)
        yield a, piece, rows, starts, ends, shared.spans_hashed(piece, starts, ends)


def _packed(lengths: np.ndarray, content: np.ndarray) -> bytes:
    """Lengths in as few bytes as they need, then the content."""
    import zstandard

    wide = 1 if not len(lengths) or lengths.max() < 256 else 4
    body = np.array([len(lengths), wide], "<u4").tobytes() + lengths.astype(f"<u{wide}").tobytes() + content.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n, wide = raw[:8].view("<u4").tolist()
    return raw[8:8 + wide * n].view(f"<u{wide}").astype(np.int64), raw[8 + wide * n:]


def _tables(packs):
    """The rows of a block, one packed row of it at a time."""
    import pyarrow as pa

    for pack in packs:
        yield pa.ipc.open_stream(pack.as_buffer()).read_all()


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids``: the ids of each whole text as little-endian unsigned 32-bit integers.

    With ``decoded``, the ids are decoded to a column of that name in the same tasks, as ``decode`` does.
    ``docs`` should be read from files or a written table, so that a task that runs again packs the same rows.
    """
    vocab = word_ids.vocabulary(path)
    wide = 2 if vocab["size"] <= 1 << 16 else 4
    n = max(1, docs.rdd.getNumPartitions())
    bits = (2 * n - 1).bit_length()  # 2 ** bits buckets: about as many words in a bucket as in a block
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", decoded)]
    sent = list(dict.fromkeys([*kept, text]))
    out = StructType([docs.schema[c] for c in kept]).add("ids", BinaryType())
    out = out.add(decoded, StringType()) if decoded else out
    pieces = _Pieces(path) if decoded else None

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = shared.text_bytes(batch.column(text))
            for a, b in shared.slices(offsets, ROW_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as to:
                    to.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "packed"])
                held += int(offsets[b] - offsets[a])
                if held >= BLOCK_BYTES:
                    block, held = block + 1, 0
            shared.give_back()

    dealt = docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(pack, "block long, packed binary").repartition(n, "block")

    def ask(key, rows):
        import pyarrow as pa

        splitter, keys, words = word_ids.Splitter(vocab), np.zeros(0, np.uint64), np.zeros(0, object)
        for part in _tables(rows.column("packed")):
            for _, piece, _, starts, ends, hashes in _hashed(splitter, part.column(text)):
                fresh, at = np.unique(hashes, return_index=True)
                if len(keys):
                    new = keys[np.minimum(np.searchsorted(keys, fresh), len(keys) - 1)] != fresh
                    fresh, at = fresh[new], at[new]
                raw = piece.tobytes()
                more = np.empty(len(at), object)
                more[:] = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                order = np.argsort(both := np.r_[keys, fresh], kind="stable")
                keys, words = both[order], np.r_[words, more][order]
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        held, firsts = np.unique(bucket, return_index=True)
        packs = []
        for a, b in zip(firsts, np.r_[firsts[1:], len(keys)], strict=True):
            some = sorted(words[a:b].tolist())  # words in order compress well
            packs.append(_packed(np.array([len(w) for w in some]), np.frombuffer(b"".join(some), np.uint8)))
        del keys, words
        shared.give_back()
        return pa.table([pa.array(held.astype(np.int32)), pa.array(np.full(len(held), key[0].as_py())), pa.array(packs, pa.binary())],
                        ["bucket", "block", "packed"])

    def answer(key, rows):
        import pyarrow as pa

        asked = [_unpacked(p) for p in rows.column("packed").to_pylist()]
        lengths, data = (np.concatenate(x) for x in zip(*asked, strict=True))
        ends = np.cumsum(lengths)
        hashes = shared.spans_hashed(data, ends - lengths, ends)
        keys, at = np.unique(hashes, return_index=True)
        raw = data.tobytes()
        words = [raw[e - n:e].decode("utf-8", "replace") for e, n in zip(ends[at].tolist(), lengths[at].tolist(), strict=True)]
        known = word_ids.WordTable(keys, *word_ids.encoded_words(vocab, words))
        packs = []
        for one in np.split(hashes, np.cumsum([len(n) for n, _ in asked])[:-1]):
            at = np.searchsorted(known.keys, np.sort(one))
            packs.append(_packed(known.counts[at], known.ids[shared.ragged(known.firsts[at], known.counts[at])].astype(f"<u{wide}")))
        del known, hashes, keys, words, raw, data
        shared.give_back()
        return pa.table([rows.column("bucket"), rows.column("block"), pa.array(packs, pa.binary())], ["bucket", "block", "packed"])

    def place(key, rows, answers):
        import pyarrow as pa

        packs, splitter = answers.column("packed").to_pylist(), word_ids.Splitter(vocab)
        parts = [_unpacked(packs[k]) for k in np.argsort(answers.column("bucket").to_numpy())]
        seen = [[(rows_at, starts, hashes) for _, _, rows_at, starts, _, hashes in _hashed(splitter, part.column(text))]
                for part in _tables(rows.column("packed"))]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(one[2] for part in seen for one in part)]))
        known = word_ids.WordTable(keys, *((np.concatenate([c for _, c in parts]).view(f"<u{wide}"), np.concatenate([n for n, _ in parts])) if parts else ()))
        done = []
        for part, slices in zip(_tables(rows.column("packed")), seen, strict=True):
            ids, texts = [], []
            for rows_at, starts, hashes in slices:
                flat, counts = known.read(hashes, starts, rows_at)
                texts += pieces.texts(flat, counts) if pieces else ()
                raw, ends = flat.astype("<u4").tobytes(), 4 * np.cumsum(counts)
                ids += [raw[e - 4 * c:e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            made = [pa.array(ids, pa.binary()), *([pa.array(texts, pa.string())] if pieces else [])]
            done.append(pa.table([*(part.column(c) for c in kept), *made], out.names))
        del seen, known, keys, ids, texts, parts, made
        shared.give_back()
        return pa.concat_tables(done)

    answers = dealt.groupBy("block").applyInArrow(ask, PACKED).groupBy("bucket").applyInArrow(answer, PACKED)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, out)


def _pieces(path: str) -> list[bytes]:
    """Bytes of every id. Byte-level vocabularies write each byte as one printable sign: printable Latin-1 as itself, the
    others, in order, as the signs from 256 on."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    tokenizer = Tokenizer.from_file(path)
    pieces = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, number in tokenizer.get_vocab(with_added_tokens=True).items():
        pieces[number] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return pieces


class _Pieces:
    """The id-to-piece table: bytes of all pieces, one after the other, and where each begins."""

    def __init__(self, path: str):
        pieces = _pieces(path)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.content, self.firsts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(self.lengths) - self.lengths

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids that lie one text after the other."""
        sizes = self.lengths[ids]
        raw = self.content[shared.ragged(self.firsts[ids], sizes)].tobytes()
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
        return [raw[s:e].decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:], strict=True)]


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids. The piece table has the size of the vocabulary and goes with the task."""
    pieces = _Pieces(path)
    kept = [c for c in df.columns if c != decoded]
    out = StructType([df.schema[c] for c in kept]).add(decoded, StringType())

    def joined(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(kept.index(ids)).fill_null(b"").cast(pa.large_binary())
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
            texts = []
            for a, b in shared.slices(offsets):
                flat = np.frombuffer(data, np.uint8)[offsets[a]:offsets[b]].view("<u4") if offsets[b] > offsets[a] else np.zeros(0, np.uint32)
                texts += pieces.texts(flat, np.diff(offsets[a:b + 1]) // 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(texts, pa.string())], [*kept, decoded])
            del batch, column, offsets, data, texts
            shared.give_back()

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(joined, out)
