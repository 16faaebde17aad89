"""Alignment of two tokenizers' tokens over the same bytes, and how many documents link each pair of ids.

A text is encoded by A (byte-level BPE, of a space and the text) and by B (pieces, which put that space
themselves). Token occurrences of A and B whose byte ranges overlap are linked: a bipartite graph, whose
connected components, found by union-find, are exactly the minimal groups of tokens that cover the same bytes
(bytes where both end cut them). An id pair counts once a document that links it.

Both tokenizers start a token at a space that stands between two characters other than white space (no
piece of B holds a space after another character, which is checked), so such spaces cut a text into segments
that are encoded and aligned apart; a worker keeps the segments that it met, and texts with other white
space are cut only at such spaces.

Scale: texts are read once. About 4 MB of documents make a block: its table row holds each document's counts
and digest, its distinct segments, and its distinct id pairs with the number of documents that link each.
Pairs are summed over blocks (an id pair has one row a block, so none is hot), and each block gets its own
pairs' sums back; what moves follows blocks' distinct pairs, not links. Blocks are bounded, but for a single
longer text.

Edge cases: texts that are null, empty, or not what both tokenizers' bytes spell have no tokens: zeros and an
empty digest; strings of special tokens are plain text; null, repeated ids and equal rows: each row is a
document of its own; an empty table gives no rows; ties for an id's highest count all count as best; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, gathered, release, tokenizer_path
from .common import discard, materialize

KEEP = 600_000
BLOCK_BYTES = 4 << 20
_WS = r"[\s\x0B\x{85}\pZ\x{1C}-\x{1F}]"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_state: dict = {}


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the others for characters from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Spelled:
    """Bytes and decimal text of each id of a vocabulary."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.text = pa.array([str(i) for i in range(len(spelled))])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def united(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Union-find over n nodes: the smallest node that edges (u, v) connect each to, all edges at a time."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[at[1:]] - total[at[:-1]]


def _joined(values: pa.Array, at: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), values), pa.scalar(by, values.type))


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path)
        self.a.tok.encode_special_tokens = True
        letters, vocab = byte_alphabet(), self.a.tok.get_vocab(True)
        names = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            names[i] = t
        self.spell_a = _Spelled([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spell_b = _Spelled([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.lead_b = np.array([p.startswith("▁") for p in pieces])
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    def clear(self):
        self.words, self.groups = pa.array([], pa.large_string()), pa.array([], pa.large_string())
        self.n = np.zeros((4, 0), np.int64)  # tokens of A and B, groups, links
        self.good = np.zeros(0, bool)
        self.links, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of all words one after another, and how many each has."""
        flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 1000):
            chunk = words[i : i + 1000]
            ids = np.array(self.b.encode(" ".join(chunk)), np.int64)
            at = np.flatnonzero(self.lead_b[ids])
            if len(at) == len(chunk):
                flat.append(ids), counts.append(np.diff(at, append=len(ids)))
            else:
                f, c = self._whole(chunk)
                flat.append(f), counts.append(c)
        return np.concatenate(flat), np.concatenate(counts)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.b.encode(w) for w in words]
        return np.fromiter(itertools.chain.from_iterable(got), np.int64), np.array([len(x) for x in got], np.int64)

    def _both(self, words: pa.Array):
        """(ids, counts) of A and of B for each segment."""
        odd = np.asarray(pc.match_substring_regex(words, f"^$|^{_WS}|{_WS}$|{_WS}{_WS}|▁"))
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        plain, rest = words.filter(pa.array(~odd)).to_pylist(), words.filter(pa.array(odd)).to_pylist()
        out = []
        for simple, whole in (((lambda: self.a._pieces(plain)), (lambda: self.a._batch([" " + w for w in rest]))), ((lambda: self._pieces(plain)), (lambda: self._whole(rest)))):
            ids, counts = np.zeros(0, np.int64), np.zeros(len(words), np.int64)
            if plain:
                ids, counts[order[: len(plain)]] = simple()
            if rest:
                more, counts[order[len(plain) :]] = whole()
                ids = np.concatenate([ids, more])
            size = counts[order]
            begin = np.zeros(len(words), np.int64)
            begin[order] = np.cumsum(size) - size
            out.append((ids.astype(np.int64)[ranges(begin, counts)], counts))
        return out

    def _learn(self, words: pa.Array):
        """Encode and align new segments."""
        (a, na), (b, nb) = self._both(words)
        # a segment is good where both spell a space and its bytes
        raw = [b" " + w.encode() for w in words.to_pylist()]
        size = np.array([len(x) for x in raw], np.int64)
        at_a, at_b = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])
        good = (_sums(self.spell_a.size[a], at_a) == size) & (_sums(self.spell_b.size[b], at_b) == size)
        text = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(size) - size
        bytes_at = np.concatenate([[0], np.cumsum(size[good])])
        want = text[ranges(start[good], size[good])]
        for ids, n, spell in ((a, na, self.spell_a), (b, nb, self.spell_b)):
            own = ids[np.repeat(good, n)]
            differ = spell.bytes[ranges(spell.at[own], spell.size[own])] != want
            bad = _sums(differ, bytes_at) > 0
            rows = np.flatnonzero(good)
            good[rows[bad]] = False
            keep = np.repeat(~bad, np.diff(bytes_at))
            want, bytes_at = want[keep], np.concatenate([[0], np.cumsum(np.diff(bytes_at)[~bad])])
        a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        na, nb = np.where(good, na, 0), np.where(good, nb, 0)
        at_a, at_b = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])
        # both spell the same bytes, so ends compare over all segments at a time
        end_a, end_b = np.cumsum(self.spell_a.size[a]), np.cumsum(self.spell_b.size[b])
        first = np.searchsorted(end_b, end_a - self.spell_a.size[a], "right")
        many = np.searchsorted(end_b - self.spell_b.size[b], end_a, "left") - first
        u, v = np.repeat(np.arange(len(a)), many), ranges(first, many)
        root = united(u, len(a) + v, len(a) + len(b))
        heads = np.flatnonzero(root[: len(a)] == np.arange(len(a)))  # a group is named by its first token of A
        size_a = np.bincount(np.searchsorted(heads, root[: len(a)]), minlength=len(heads))
        size_b = np.bincount(np.searchsorted(heads, root[len(a) :]), minlength=len(heads))
        side = [_joined(s.text.take(pa.array(ids)), np.concatenate([[0], np.cumsum(n)]), ",") for s, ids, n in ((self.spell_a, a, size_a), (self.spell_b, b, size_b))]
        groups = pc.binary_join_element_wise(*side, "|")
        per = np.searchsorted(heads, at_a)  # groups before each segment
        links = np.concatenate([[0], np.cumsum(many)])[at_a]
        self.n = np.concatenate([self.n, np.stack([na, nb, np.diff(per), np.diff(links)])], axis=1)
        self.good = np.concatenate([self.good, good])
        self.links = np.concatenate([self.links, a[u] << 32 | b[v]])
        self.at = np.concatenate([self.at, self.at[-1] + links[1:]])
        self.words = pa.concat_arrays([self.words, words.cast(pa.large_string())])
        self.groups = pa.concat_arrays([self.groups, _joined(groups, per, ";").cast(pa.large_string())])

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the kept segments of all texts (no nulls), and n + 1 offsets."""
        if self.cuts:
            odd = pc.match_substring_regex(texts, f"^{_WS}|{_WS}{_WS}| $")
        else:
            odd = pa.array(np.ones(len(texts), bool))
        flags = np.asarray(odd)
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        lists = [_SAFE.split(t) if self.cuts else [t] for t in texts.filter(odd).to_pylist()]
        order = np.concatenate([np.flatnonzero(~flags), np.flatnonzero(flags)])
        flat = pa.concat_arrays([split.flatten().cast(pa.large_string()), pa.array(list(itertools.chain.from_iterable(lists)), pa.large_string())])
        count = np.concatenate([np.diff(np.asarray(split.offsets, np.int64)), np.array([len(x) for x in lists], np.int64)])
        coded = flat.dictionary_encode()
        if len(self.words) + len(coded.dictionary) > KEEP:
            self.clear()
        rows = np.array(pc.index_in(coded.dictionary, value_set=self.words).fill_null(-1), np.int64)
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            rows[fresh] = len(self.words) + np.arange(len(fresh))
            self._learn(coded.dictionary.take(pa.array(fresh)))
        begin, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        begin[order], size[order] = np.cumsum(count) - count, count
        return rows[np.asarray(coded.indices, np.int64)[ranges(begin, size)]], np.concatenate([[0], np.cumsum(size)])

    def block(self, texts: pa.Array) -> dict:
        """Counts, groups and segments of each text, and the block's distinct pairs."""
        t = pc.fill_null(texts.cast(pa.string()), "")
        rows, at = self.segments(t)
        n = np.diff(at)
        whole = (_sums(~self.good[rows], at) == 0) & np.asarray(pc.greater(pc.binary_length(t), 0))
        rows, n = rows[np.repeat(whole, n)], np.where(whole, n, 0)
        at = np.concatenate([[0], np.cumsum(n)])
        used, local = np.unique(rows, return_inverse=True)
        # distinct segments of each text, with their number
        held, times = np.unique(np.repeat(np.arange(len(t)), n) * max(1, len(used)) + local, return_counts=True)
        doc, word = np.divmod(held, max(1, len(used)))
        many = np.diff(self.at)[used]
        pairs, pair_of = np.unique(self.links[ranges(self.at[used], many)], return_inverse=True)
        upto = np.concatenate([[0], np.cumsum(many)])
        linked = np.unique(np.repeat(doc, many[word]) * max(1, len(pairs)) + pair_of[ranges(upto[word], many[word])])
        docs = np.bincount(linked % max(1, len(pairs)), minlength=len(pairs)) if len(pairs) else np.zeros(0, np.int64)
        return {
            "n": np.stack([_sums(x[rows], at) for x in self.n]), "text": _joined(self.groups.take(pa.array(rows)), at, ";"), "whole": whole,
            "doc": np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(t)))]), "word": word, "times": times, "upto": upto, "pair_of": pair_of, "pairs": pairs, "docs": docs,
        }


def aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _state:
        _state[paths] = Aligner(*paths)
    return _state[paths]


def packed(x: np.ndarray, kind=np.uint32) -> bytes:
    """The array with its high bytes next to each other, compressed."""
    x = np.ascontiguousarray(x, kind)
    return zstandard.ZstdCompressor(1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpacked(data: bytes, kind=np.uint32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


_PARTS = ("doc", "word", "times", "upto", "pair_of")
_BLOCK = "block long, pairs binary, docs binary, doc_ids array<long>, shas binary, n binary, " + ", ".join(f"p_{x} binary" for x in _PARTS)


def _blocks(paths):
    def run(batches):
        made, seq = aligner(paths), TaskContext.get().partitionId() << 32
        for b in gathered(batches, 1, BLOCK_BYTES):
            got = made.block(b.column(1))
            shas = b"".join(hashlib.sha256(t.as_buffer()).digest() for t in got["text"])
            got["word"] = np.diff(got["word"], prepend=0)  # mostly small steps
            one = lambda x: pa.array([x], pa.binary())
            cols = [pa.array([seq]), one(packed(np.diff(got["pairs"], prepend=0), np.int64)), one(packed(got["docs"])), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), one(shas), one(packed(got["n"].ravel(), np.int64))]
            yield pa.RecordBatch.from_arrays(cols + [one(packed(got[x])) for x in _PARTS], ["block", "pairs", "docs", "doc_ids", "shas", "n", *[f"p_{x}" for x in _PARTS]])
            seq += 1
        release()

    return run


def _pair_rows(batches):
    for b in batches:
        for i in range(len(b)):
            pairs, docs = np.cumsum(unpacked(b.column(1)[i].as_py(), np.int64)), unpacked(b.column(2)[i].as_py())
            for at in range(0, len(pairs), 1 << 16):
                p = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), b.column(0)[i].as_py())), pa.array(p), pa.array(docs[at : at + (1 << 16)].astype(np.int64))], ["block", "pair", "docs"])


_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents, once its pairs' sums are there."""
    order = np.argsort(np.asarray(counts.column("pair")), kind="stable")  # as the block's own pairs
    n, best = np.asarray(counts.column("n"), np.int64)[order], np.asarray(counts.column("best"), np.int64)[order]
    part = {x: unpacked(blocks.column(f"p_{x}")[0].as_py()).astype(np.int64) for x in _PARTS}
    part["word"] = np.cumsum(part["word"].astype(np.uint32).view(np.int32)).astype(np.int64)
    totals = unpacked(blocks.column("n")[0].as_py(), np.int64).reshape(4, -1)
    own = [_sums(_sums(x[part["pair_of"]], part["upto"])[part["word"]] * part["times"], part["doc"]) for x in (best, n)]
    raw = blocks.column("shas")[0].as_py()
    shas = [raw[32 * i : 32 * i + 32].hex() if n else "" for i, n in enumerate(totals[0].tolist())]
    cols = [blocks.column("doc_ids")[0].values, *map(pa.array, totals), *map(pa.array, own), pa.array(shas, pa.string())]
    return pa.Table.from_arrays(cols, [c.split()[0] for c in _DOCUMENT.split(", ")])


def _paths(a_path, b_path) -> tuple[str, str]:
    return a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _counted(blocks: DataFrame) -> DataFrame:
    """pair, n (documents that link it), best (n is the highest of its A id)."""
    n = blocks.select("block", "pairs", "docs").mapInArrow(_pair_rows, "block long, pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("n"))
    n = materialize(n, "pair-sums")
    top = n.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    out = materialize(n.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best")), "pairs")
    discard(n)
    return out


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a_id, b_id, n_docs, best: how many documents link each pair of ids, and whether no other B id of a_id has more."""
    blocks = materialize(_source(docs).mapInArrow(_blocks(_paths(a_path, b_path)), _BLOCK), "aligned")
    got = _counted(blocks)
    discard(blocks)
    return got.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.expr("cast(pair & 4294967295 as int)").alias("b_id"), F.col("n").alias("n_docs"), (F.col("best") == 1).alias("best"))


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, groups: the minimal groups in order, as text `a1,a2|b1;a3|b2,b3`; null without tokens."""
    paths = _paths(a_path, b_path)

    def run(batches):
        made = aligner(paths)
        for b in gathered(batches, 1, BLOCK_BYTES):
            got = made.block(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(pa.array(got["whole"]), got["text"], None).cast(pa.string())], ["doc_id", "groups"])
        release()

    return _source(docs).mapInArrow(run, "doc_id long, groups string")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row a document."""
    blocks = materialize(_source(docs).mapInArrow(_blocks(_paths(a_path, b_path)), _BLOCK), "aligned")
    pairs = _counted(blocks)
    asked = blocks.select("block", "pairs", "docs").mapInArrow(_pair_rows, "block long, pair long, docs long").select("block", "pair")
    back = asked.join(pairs, "pair").select("block", "pair", "n", "best")
    out = materialize(blocks.drop("pairs", "docs").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scored, _DOCUMENT), "alignments")
    discard(blocks), discard(pairs)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
