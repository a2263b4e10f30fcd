"""Token records and BPE against the tokenizer itself, the published check value, and a plain reader."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from daygrid.llm import bpe_words, pretokens, q_tokens, record_files, shared, word_ids


@pytest.fixture(scope="module")
def path():
    return q_tokens.vocabulary_file()


@pytest.fixture(scope="module")
def tokenizer(path):
    return Tokenizer.from_file(path)


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def texts_at_random(n, seed=1):
    draw = random.Random(seed)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", " ", "  ", "\n", "\t", "\r\n", "a", "é", "1", "²", "!", "..", " ", "　", "漢",
             "\U0001f600", "́", "<|endoftext|>", "<|end", "\x1c", "\x85", "​", "՘", "꟏"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_words_begin_where_the_tokenizer_says(path, tokenizer):
    texts = [t.replace("<|endoftext|>", "") for t in texts_at_random(8000)]
    data, rows = shared.text_bytes(pa.array(texts))
    starts = pretokens.word_starts(data, rows, pretokens.class_table(pretokens.class_runs(path)))
    want = []
    for t, at in zip(texts, rows, strict=False):
        want += [int(at) + len(t[:a].encode()) for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(t)]
    assert starts.tolist() == want


def test_ids_of_texts(path, tokenizer):
    texts = texts_at_random(3000, 2)
    encoder, got = word_ids.Encoder(word_ids.vocabulary(path), most=50), []
    for _, ids, counts in encoder.encode(pa.array([*texts, None, ""])):
        ends = np.cumsum(counts)
        got += [ids[e - c:e].tolist() for e, c in zip(ends, counts, strict=True)]
    assert got == [plain(tokenizer, t) for t in [*texts, None, ""]]


def test_check_value_of_the_checksum():
    data = np.frombuffer(b"123456789" + bytes(1000), np.uint8)
    whole, none, zeros = record_files.crc32c(data, [0, 0, 9], [9, 0, 32])
    assert (whole, none, zeros) == (0xE3069283, 0, 0x8A9136AA)


def test_records_are_read_by_a_plain_reader(spark, messy, path, tokenizer):
    folder = shared.shared_folder(spark, "records")
    index = record_files.write_records(messy, folder, path, 2)
    rows = sorted(record_files.with_starts(index).collect(), key=lambda r: (r.file, r.record))
    raw = {f: open(f"{folder.removeprefix('file://')}/data/part-{f:06d}.rec", "rb").read() for f in {r.file for r in rows}}
    texts = sorted(messy.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (doc_id, text) in zip(rows, texts, strict=True):
        (length,) = struct.unpack_from("<Q", raw[row.file], row.offset)
        body = raw[row.file][row.offset + 12:row.offset + 12 + length]
        ids = np.frombuffer(body, "<u2", offset=1).tolist()
        assert (row.doc_id, row.start, row.n_tokens, ids) == (doc_id, start, len(ids), [*plain(tokenizer, text), 2])
        start += len(ids)
    back = record_files.read_records(index.orderBy("length"), folder).collect()  # any order
    assert sorted(len(r.ids) // 4 for r in back) == sorted(r.n_tokens for r in rows)


def test_a_damaged_record_is_refused():
    payload = np.frombuffer(b"\x02\x05\x00\x02\x00", np.uint8)
    out, _ = record_files.framed(payload, np.array([0]), np.array([5]))
    assert record_files._ids([out.tobytes()]) == [np.array([5, 2], "<u4").tobytes()]
    for k in range(len(out)):
        bad = out.copy()
        bad[k] ^= 1
        with pytest.raises((ValueError, struct.error)):
            record_files._ids([bad.tobytes()])


def test_encoding_and_decoding(messy, path, tokenizer):
    out = bpe_words.decode(bpe_words.encode(messy, path), path)
    assert sorted(out.columns) == sorted(messy.columns)
    want = sorted((str(r.doc_id), r.text or "", str(r.source)) for r in messy.collect())
    rows = out.collect()
    assert sorted((str(r.doc_id), r.text or "", str(r.source)) for r in rows) == want
    for r in rows:
        ids = plain(tokenizer, r.text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_digests_of_queries(spark, path, tokenizer):
    from conftest import SMALL

    texts = {r[0]: plain(tokenizer, r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for r in q_tokens.bpe_digests(spark, SMALL).collect():
        ids = texts[r.doc_id]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    start = 0
    for r in sorted(q_tokens.record_file_digests(spark, SMALL).collect()):
        ids = [*texts[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_tables(spark, messy, path):
    none = messy.limit(0)
    assert bpe_words.decode(bpe_words.encode(none, path), path).collect() == []
    folder = shared.shared_folder(spark, "records")
    index = record_files.write_records(none, folder, path, 2)
    assert record_files.read_records(record_files.with_starts(index), folder).collect() == []
