"""Ids of distinct words, kept in sorted arrays, and texts put together from them."""

from __future__ import annotations

import functools
import os
import re
import sys
import types

import numpy as np

from daygrid.llm import pretokens, shared


@functools.lru_cache(4)
def vocabulary(path: str) -> dict:
    """What tasks need of a tokenizer file besides the file itself; small and of fixed size."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return {"path": path, "runs": pretokens.class_runs(path), "size": tokenizer.get_vocab_size(with_added_tokens=True),
            "whole": tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())}


def tokenizer_of(path: str):
    """The tokenizer, opened once in a worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("_daygrid_worker", types.ModuleType("_daygrid_worker"))
    opened = kept.__dict__.setdefault("tokenizers", {})
    if path not in opened:
        opened[path] = Tokenizer.from_file(path)
        opened[path].no_padding()
        opened[path].no_truncation()
    return opened[path]


class Splitter:
    """Word spans of texts; added tokens of the vocabulary are words of their own."""

    def __init__(self, vocab: dict):
        self.classes = pretokens.class_table(vocab["runs"])
        whole = sorted((w.encode() for w in vocab["whole"]), key=len, reverse=True)
        self.whole = re.compile(b"|".join(map(re.escape, whole))) if whole else None

    def spans(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        if self.whole is not None and self.whole.search(raw := data.tobytes()):
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                found += [(a + m.start(), a + m.end()) for m in self.whole.finditer(raw[a:b])]
        if found:
            first, last = np.array(found).T
            starts = pretokens.word_starts(data, np.unique(np.r_[rows, first, last]), self.classes)
            at = np.searchsorted(first, starts, side="right") - 1
            starts = starts[(at < 0) | (starts == first[at]) | (starts >= last[at])]
        else:
            starts = pretokens.word_starts(data, rows, self.classes)
        return starts, np.r_[starts[1:], len(data)]


def encoded_words(vocab: dict, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of single words, one after the other, and how many each has."""
    ids, counts, tokenizer = [], np.zeros(len(words), np.int64), tokenizer_of(vocab["path"])
    for at in range(0, len(words), 1024):
        for k, one in enumerate(tokenizer.encode_batch_fast(words[at:at + 1024], add_special_tokens=False), at):
            counts[k] = len(one.ids)
            ids += one.ids
    return np.array(ids, np.uint32), counts


class WordTable:
    """Sorted word hashes with their ids."""

    def __init__(self, keys=None, ids=None, counts=None):
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.ids = np.zeros(0, np.uint32) if ids is None else ids
        self.counts = np.zeros(0, np.int64) if counts is None else counts
        self.firsts = np.cumsum(self.counts) - self.counts

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def extended(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> WordTable:
        """With more words, none of them in the table yet."""
        order = np.argsort(both := np.r_[self.keys, keys], kind="stable")
        firsts = np.r_[self.firsts, np.cumsum(counts) - counts + len(self.ids)]
        more = WordTable()
        more.keys, more.ids, more.counts, more.firsts = both[order], np.r_[self.ids, ids], np.r_[self.counts, counts][order], firsts[order]
        return more

    def joined(self, other: WordTable) -> WordTable:
        return self.extended(other.keys, other.ids[shared.ragged(other.firsts, other.counts)], other.counts)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the words begin, and how many there are; every word must be in the table."""
        at = np.searchsorted(self.keys, hashes)
        return self.firsts[at], self.counts[at]

    def read(self, hashes: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in their order, and how many each text has."""
        return _per_row(self.ids, *self.places(hashes), starts, rows)


def _per_row(ids, firsts, counts, starts, rows):
    ends = np.r_[0, np.cumsum(counts)]
    return ids[shared.ragged(firsts, counts)], np.diff(ends[np.searchsorted(starts, rows)])


class Encoder:
    """Ids of whole texts; each distinct word is encoded once while the worker keeps it.

    The kept tables have ``most`` words at most and are begun anew beyond that, so memory is bounded. New words go to a
    small table first, which is joined to the large one from time to time.
    """

    def __init__(self, vocab: dict, most: int = 3_000_000, small: int = 100_000):
        self.vocab, self.most, self.small, self.splitter = vocab, most, small, Splitter(vocab)
        self.kept = sys.modules.setdefault("_daygrid_worker", types.ModuleType("_daygrid_worker")).__dict__.setdefault("words", {})

    def encode(self, column):
        """Yields (first row, ids, ids per row) for slices of an Arrow text column."""
        data, offsets = shared.text_bytes(column)
        for a, b in shared.slices(offsets):
            piece, rows = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            starts, ends = self.splitter.spans(piece, rows)
            hashes = shared.spans_hashed(piece, starts, ends)
            large, new = self.kept.get(self.vocab["path"]) or (WordTable(), WordTable())
            if len(large.keys) + len(new.keys) > self.most:
                large, new = WordTable(), WordTable()
            elif len(new.keys) > self.small:
                large, new = large.joined(new), WordTable()
            rest = large.missing(hashes)
            fresh = np.flatnonzero(rest)
            fresh = fresh[new.missing(hashes[fresh])]
            if len(fresh):
                keys, at = np.unique(hashes[fresh], return_index=True)
                raw = piece.tobytes()
                words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[fresh[at]].tolist(), ends[fresh[at]].tolist(), strict=True)]
                new = new.extended(keys, *encoded_words(self.vocab, words))
            self.kept[self.vocab["path"]] = large, new
            firsts, counts = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
            firsts[~rest], counts[~rest] = large.places(hashes[~rest])
            firsts[rest], counts[rest] = new.places(hashes[rest])
            firsts[rest] += len(large.ids)
            ids, counts = _per_row(np.r_[large.ids, new.ids], firsts, counts, starts, rows)
            yield a, ids, counts
