"""Whole texts to token ids with the tokenizers library, encoding each distinct word once.

The byte-level pre-tokenizer always starts a token at a space that follows a character other than
white space, so a text without two adjacent white-space characters is the concatenation of its pieces
split before spaces, and pieces can be encoded apart. Texts with adjacent white space, or with the string of an added token (which
the library turns into that token's id), are encoded whole.
Encoded pieces are kept for the life of the worker process, `KEEP` at most.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP = 600_000
AT_ONCE = 1 << 19
_state: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # the library finds these strings in a text before it splits words: such texts are encoded whole
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # a piece's first token is the only one of its tokens that starts with a space
        self.lead = np.zeros(self.tok.get_vocab_size(), bool)
        self.lead[[i for t, i in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 65536 else np.uint32
        self.clear()

    def clear(self):
        self.words = pa.array([], pa.string())
        self.flat, self.ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; the library holds about `AT_ONCE` characters
        at a time, as it takes some hundred bytes a token."""
        run = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        flat, counts, i = [np.zeros(0, self.dtype)], np.zeros(len(texts), np.int64), 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= AT_ONCE):
                size += len(texts[j])
                j += 1
            for k, e in enumerate(run(texts[i:j], add_special_tokens=False), i):
                ids = np.array(e.ids, self.dtype)
                counts[k] = len(ids)
                flat.append(ids)
            if len(flat) > 256:
                flat = [np.concatenate(flat)]
            i = j
        return np.concatenate(flat), counts

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ' ' + word for each word one after another, and how many each has: long strings of many words."""
        flat, counts = [], []
        for i in range(0, len(words), 1000):
            chunk = words[i : i + 1000]
            ids, _ = self._batch([" " + " ".join(chunk)])
            at = np.flatnonzero(self.lead[ids])
            if len(at) != len(chunk):  # a tokenizer of another kind: word by word
                ids, each = self._batch([" " + w for w in chunk])
                at = np.cumsum(each) - each
            flat.append(ids)
            counts.append(np.diff(at, append=len(ids)))
        return np.concatenate(flat), np.concatenate(counts)

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Row in the table of kept pieces of ' ' + word, for each of the distinct words."""
        if len(self.words) + len(words) > KEEP:
            self.clear()
        found = pc.index_in(words, value_set=self.words)
        rows = np.asarray(found.fill_null(-1), np.int64)
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            new = words.take(pa.array(fresh))
            ids, counts = self._pieces(new.to_pylist())
            rows[fresh] = len(self.words) + np.arange(len(fresh))
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.concatenate([self.flat, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        return rows

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, `end` after each, and the n + 1 offsets. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        odd = np.asarray(pc.match_substring_regex(texts, r"[\s\x0B\x{85}\pZ\x{1C}-\x{1F}][\s\x0B\x{85}\pZ\x{1C}-\x{1F}]"))
        for t in self.added:
            odd = odd | np.asarray(pc.match_substring(texts, t))
        if any(" " in t for t in self.added):
            odd = np.ones(n, bool)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        starts = np.asarray(split.offsets, np.int64)
        coded = split.flatten().dictionary_encode()
        pieces = self._rows(coded.dictionary)[np.asarray(coded.indices, np.int64)]
        # no space before a text's first word; those are encoded apart, and follow the kept ids for this call
        head, head_n = self._batch([t if o else t.split(" ", 1)[0] for t, o in zip(texts.to_pylist(), odd.tolist())])
        flat = np.concatenate([self.flat, head, np.array([end], self.dtype)])
        begin, size = self.ends[pieces], self.ends[pieces + 1] - self.ends[pieces]
        begin[starts[:-1]], size[starts[:-1]] = len(self.flat) + np.cumsum(head_n) - head_n, head_n
        begin, size = np.insert(begin, starts[1:], len(flat) - 1), np.insert(size, starts[1:], 1)
        upto = np.concatenate([[0], np.cumsum(size)])
        kind = np.int32 if max(len(flat), upto[-1]) < 2**31 else np.int64
        at = np.repeat((begin - upto[:-1]).astype(kind), size)
        at += np.arange(upto[-1], dtype=kind)
        return flat[at], upto[np.concatenate([[0], starts[1:] + np.arange(1, n + 1)])]


def encoder(path: str) -> Encoder:
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def release() -> None:
    """Give freed memory back to the system: workers stay alive between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def gathered(batches, column: int, most: int = 4 << 20):
    """Batches joined, or cut, to about `most` bytes of text each."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= most:
            for t in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield from slices(t, column, most)
            held, size = [], 0
    if held:
        for t in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield from slices(t, column, most)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20):
    """Zero-copy slices of a batch with about `most` bytes of text each (one row at least)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = max(at + 1, to)
        yield batch.slice(at, to - at)
        at = to
    release()
