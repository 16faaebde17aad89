"""Hierarchical Pitman-Yor language model, learned from all training texts and scored on all texts.

Tokens are words and one end per text. A token's context is the class of the word before it (its hash
in `CLASSES` classes: the model's size parameter, which bounds how many restaurants serve a word). The
restaurants of all contexts share one parent, whose base is uniform over the vocabulary and one unknown
word. Seating is held as counts: c customers at t tables for each (context, word).

Gibbs sweeps draw t given c and the weight a = (strength + discount * tables of the context) * parent
probability, from p(t) proportional to S(c, t) a**t with generalized Stirling numbers S (a in steps of
a quarter in its logarithm; beyond 64 customers, further tables are drawn in Poisson steps). Tables are
the parent's customers, whose own tables are drawn likewise. The first sweeps are burnt; predictive
probabilities are averaged over the rest, which is exact in t, as they are linear in it.

Scale: texts are read once, in blocks of about `block_tokens` tokens; a block holds each distinct
(context, word) once. Blocks exchange sorted arrays with hash ranges of words: counts go to the range,
which merges all blocks' counts and samples the seating of its words, and seating comes back in the
block's order. A word has at most CLASSES entries in a range and a block at most one entry of each kind,
so no key is hot. What is gathered grows with the corpus; nothing of it reaches the driver but sums (one
number a class). A sweep is one Spark step over all ranges: vocabulary, the parent's customers and
tables, and the tables of each class are summed over all ranges and broadcast to the next sweep, so the
law of the seating does not depend on the number of ranges (its random draws do). Ranges' seating and
blocks' token lists wait in the shared folder; a repeated task writes the same file.

Edge cases: null text is empty and has one token, its end; null doc_id is in the fold of empty text;
repeated rows count each; with nothing to learn from, every token is unknown in a vocabulary of none;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from typing import Iterator
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import discard, filesystem, materialize, new_path
from .words import mix, word_hashes

CLASSES = 1 << 16
END, START = (mix(np.array([x], np.uint64))[0] for x in (0x5EED0E0D, 0x5EED57A7))
D1, S1, D0, S0 = 0.8, 1.0, 0.6, 10.0  # discounts and strengths of the contexts and of the parent
MOST = 64
SWEEPS, BURNT = 8, 3

_IN = "block long, part int, words binary, n binary, kinds binary, classes binary, counts binary, totals binary"
_BACK = "block long, part int, g binary, r binary, c binary"


def _tokens(texts: pa.Array):
    """Word hashes with an end after each text, contexts' classes, and offsets."""
    h, at = word_hashes(texts)
    n = np.diff(at) + 1
    offsets = np.concatenate([[0], np.cumsum(n)])
    w = np.full(offsets[-1], END, np.uint64)
    keep = np.ones(len(w), bool)
    keep[offsets[1:] - 1] = False
    w[keep] = h
    before = np.concatenate([[START], w[:-1]])
    before[offsets[:-1]] = START
    return w, (mix(before) >> np.uint64(48)).astype(np.uint16), n


def held(ids) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in ids], bool)


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


class _Block:
    def __init__(self):
        self.w, self.c, self.n, self.ids, self.size = [], [], [], [], 0

    def add(self, ids, texts):
        w, c, n = _tokens(texts)
        self.w.append(w), self.c.append(c), self.n.append(n)
        self.ids += ids
        self.size += len(w)

    def close(self, block, parts, folder):
        """Write the token list; return the rows of the ranges."""
        w, cls, n = np.concatenate(self.w), np.concatenate(self.c), np.concatenate(self.n)
        out = held(self.ids)
        learn = np.repeat(~out, n)
        words, at = np.unique(w, return_inverse=True)
        kind, token = np.unique(at.astype(np.uint64) * np.uint64(CLASSES) + cls, return_inverse=True)
        of = (kind >> np.uint64(16)).astype(np.int64)
        classes = (kind & np.uint64(CLASSES - 1)).astype(np.uint16)
        counts = np.bincount(token[learn], minlength=len(kind)).astype(np.uint32)
        n_words = np.bincount(at[learn], minlength=len(words)).astype(np.uint32)
        kinds = np.bincount(of, minlength=len(words)).astype(np.int64)
        totals = np.bincount(cls[learn], minlength=CLASSES)
        store, top = filesystem(folder)
        store.create_dir(top, recursive=True)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        null = np.array([i is None for i in self.ids], bool)
        own = f"{top}/{block}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(own) as f:
            parts_of = [ids, null, out, n.astype(np.int64), kinds.astype(np.uint32), classes, token.astype(np.uint32)]
            blobs = [_pack(a) for a in parts_of]
            f.write(np.array([x for a, b in zip(parts_of, blobs) for x in (len(b), a.nbytes)], np.int64).tobytes())
            for b in blobs:
                f.write(b)
        store.move(own, f"{top}/{block}")
        cut = np.searchsorted(words, np.array([(i << 64) // parts for i in range(parts)], np.uint64)).tolist() + [len(words)]
        edge = np.concatenate([[0], np.cumsum(kinds)])
        rows = [(p, words[a:b], n_words[a:b], kinds[a:b].astype(np.uint32), classes[edge[a] : edge[b]], counts[edge[a] : edge[b]]) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        cols = [pa.array([r[0] for r in rows], pa.int32())] + [pa.array([_pack(r[i]) for r in rows], pa.binary()) for i in range(1, 6)]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), *cols, pa.nulls(len(rows), pa.binary())], schema=_IN_SCHEMA), totals


_IN_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("n", pa.binary()), ("kinds", pa.binary()), ("classes", pa.binary()), ("counts", pa.binary()), ("totals", pa.binary())])


def _unpack(b: bytes, dtype, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, size, codec="zstd", asbytes=True), dtype)


def _open(b, dtype):
    """Unpack a blob that knows no size (zstd frames carry it)."""
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31), dtype)


def read_block(folder: str, block: int):
    store, top = filesystem(folder)
    with store.open_input_stream(f"{top}/{block}") as f:
        sizes = np.frombuffer(f.read(7 * 16), np.int64).tolist()
        kinds = [np.int64, bool, bool, np.int64, np.uint32, np.uint16, np.uint32]
        return [_unpack(f.read(sizes[2 * i]), k, sizes[2 * i + 1]) for i, k in enumerate(kinds)]


def _count(parts: int, folder: str, block_tokens: int):
    def run(batches):
        part, i, block, totals = TaskContext.get().partitionId(), 0, _Block(), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for b in slices(batch, 1, 1 << 20):
                block.add(b.column(0).to_pylist(), b.column(1))
                if block.size >= block_tokens:
                    rows, more = block.close(part << 20 | i, parts, folder)
                    i, block, totals = i + 1, _Block(), totals + more
                    yield rows
        if block.ids:
            rows, more = block.close(part << 20 | i, parts, folder)
            totals = totals + more
            yield rows
        none = [pa.nulls(1, pa.binary())] * 5
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *none, pa.array([totals.astype(float).tobytes()], pa.binary())], schema=_IN_SCHEMA)

    return run


@functools.cache
def _stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c, t up to MOST."""
    s = np.full((MOST + 1, MOST + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, MOST):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = s[c, 1 : c + 2] + np.log(np.maximum(c - discount * t, 1e-300))
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], stay)
    return s


LOW, STEP, BINS = -60.0, 0.25, 400


@functools.cache
def _cdfs(discount: float) -> np.ndarray:
    """Row c * BINS + bin of log a: cumulative p(t), t = 1...MOST."""
    z = _stirling(discount)[:, None, 1:] + np.arange(1, MOST + 1) * (LOW + STEP * np.arange(BINS))[None, :, None]
    with np.errstate(invalid="ignore"):
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p = np.cumsum(p / p.sum(axis=2, keepdims=True), axis=2)
    return np.nan_to_num(p, nan=1.0).astype(np.float32).reshape(-1, MOST)


def draw_tables(c: np.ndarray, a: np.ndarray, discount: float, g: np.random.Generator) -> np.ndarray:
    """A draw of the tables of each dish with c customers, new-table weight a."""
    t = np.minimum(c, 1).astype(np.int64)
    some = np.flatnonzero(c > 1)
    bins = np.clip(np.round((np.log(a[some]) - LOW) / STEP), 0, BINS - 1).astype(np.int64)
    row, table = np.minimum(c[some], MOST) * BINS + bins, _cdfs(discount)
    for i in range(0, len(some), 65536):
        u = g.random(min(65536, len(some) - i), np.float32)
        t[some[i : i + 65536]] += (table[row[i : i + 65536]] < u[:, None]).sum(axis=1)
    t = np.minimum(t, np.minimum(c, MOST)) if len(t) else t
    at, big = float(MOST), np.flatnonzero(c > MOST)
    while len(big):
        to = np.minimum(c[big], at * 1.1)
        new = g.poisson((to - at) * a[big] / (a[big] + at - discount * t[big]))
        t[big] = np.minimum(t[big] + new, c[big])
        at *= 1.1
        big = big[c[big] > at]
    return t


def sweep(c: np.ndarray, of: np.ndarray, classes: np.ndarray, t: np.ndarray, t0: np.ndarray, tables: np.ndarray, sums, g: np.random.Generator):
    """One Gibbs sweep over the (context, word) kinds of a range: their tables, and the parent's tables of the words.

    sums (vocabulary, customers and tables of the parent) and tables (by class) are those of all ranges
    after the sweep before."""
    v, customers, parent_tables = sums
    base = (S0 + D0 * parent_tables) / (v + 1)
    p = (np.bincount(of, t, len(t0)) - D0 * t0 + base) / (S0 + customers)
    t = draw_tables(c, (S1 + D1 * tables[classes]) * p[of], D1, g)
    c0 = np.bincount(of, t, len(t0)).astype(np.int64)
    return t, draw_tables(c0, np.full(len(t0), base), D0, g)


def _start(c: np.ndarray, of: np.ndarray, words: int):
    """The seating before the first sweep: one table a kind, and one a word at the parent."""
    t = np.minimum(c, 1).astype(np.int64)
    return t, (np.bincount(of, t, words) > 0).astype(np.int64)


def _sums(of: np.ndarray, classes: np.ndarray, t: np.ndarray, t0: np.ndarray):
    """(vocabulary, customers and tables of the parent) and tables by class, of one range."""
    return np.array([(t0 > 0).sum(), t.sum(), t0.sum()], float), np.bincount(classes, t, CLASSES)


def seat(c: np.ndarray, of: np.ndarray, classes: np.ndarray, words: int, totals: np.ndarray, parts: int, g: np.random.Generator):
    """All sweeps in one place, with the words dealt to `parts` ranges. Returns mean tables of the kinds, and
    the parent's mean customers and tables of the words."""
    ranges = [(np.flatnonzero(of % parts == i), np.arange(i, words, parts)) for i in range(parts)]
    t, t0 = _start(c, of, words)
    kept = [np.zeros(len(c)), np.zeros(words), np.zeros(words)]
    for i in range(SWEEPS):
        sums, tables = _sums(of, classes, t, t0)
        for k, w in ranges:
            t[k], t0[w] = sweep(c[k], of[k] // parts, classes[k], t[k], t0[w], tables, sums, g)
        if i >= BURNT:
            for k, x in zip(kept, (t, np.bincount(of, t, words), t0)):
                k += x
    return [k / (SWEEPS - BURNT) for k in kept]


def _save(folder: str, name: str, arrays) -> None:
    store, top = filesystem(folder)
    store.create_dir(top, recursive=True)
    own = f"{top}/{name}.{TaskContext.get().taskAttemptId()}"
    blobs = [_pack(a) for a in arrays]
    with store.open_output_stream(own) as f:
        f.write(np.array([len(arrays)] + [x for a, b in zip(arrays, blobs) for x in (len(b), a.nbytes)], np.int64).tobytes())
        for b in blobs:
            f.write(b)
    store.move(own, f"{top}/{name}")


def _load(folder: str, name: str, kinds) -> list[np.ndarray]:
    store, top = filesystem(folder)
    with store.open_input_stream(f"{top}/{name}") as f:
        n = int(np.frombuffer(f.read(8), np.int64)[0])
        sizes = np.frombuffer(f.read(16 * n), np.int64).tolist()
        return [_unpack(f.read(sizes[2 * i]), k, sizes[2 * i + 1]) for i, k in enumerate(kinds)]


_KINDS = (np.uint64, np.uint32, np.uint32, np.int64, np.int64, np.int64, np.int32, np.int32)
_SEATS = (np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)


def _kinds(folder: str, part: int):
    """A range's words of kinds, classes, counts; blocks, their words and kinds, and where these are in the range."""
    kind, c, c_words, blocks, n_words, n_kinds, at, back = _load(f"{folder}/kinds", str(part), _KINDS)
    return (kind >> np.uint64(16)).astype(np.int64), (kind & np.uint64(CLASSES - 1)).astype(np.int64), c.astype(np.int64), c_words, blocks, n_words, n_kinds, np.cumsum(at, dtype=np.int64), np.cumsum(back, dtype=np.int64)


def _sum_rows(sums: np.ndarray, tables: np.ndarray):
    """A range's sums as rows: the vector by class in pieces, and the others as one piece more."""
    pieces = [x.tobytes() for x in tables.astype(float).reshape(_PIECES, -1)] + [sums.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array(range(_PIECES + 1), pa.int32()), pa.array(pieces, pa.binary())], ["i", "x"])


def _merge(folder: str):
    """Merge all blocks' counts of a range, and store them with the first seating."""

    def run(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        rows = sorted((r for b in groups for r in b.to_pylist()), key=lambda r: r["block"])
        words = [_open(r["words"], np.uint64) for r in rows]
        _, at = np.unique(np.concatenate(words), return_inverse=True)
        n_words = int(at.max()) + 1
        c_words = np.bincount(at, np.concatenate([_open(r["n"], np.uint32) for r in rows]), n_words)
        kinds = np.concatenate([_open(r["kinds"], np.uint32) for r in rows])
        per = [_open(r["classes"], np.uint16) for r in rows]
        kind, back = np.unique(np.repeat(at.astype(np.uint64), kinds) * np.uint64(CLASSES) + np.concatenate(per), return_inverse=True)
        c = np.bincount(back, np.concatenate([_open(r["counts"], np.uint32) for r in rows]), len(kind)).astype(np.int64)
        sizes = [np.array(x, np.int64) for x in ([r["block"] for r in rows], [len(w) for w in words], [len(k) for k in per])]
        _save(f"{folder}/kinds", str(part), [kind.astype(np.uint64), c.astype(np.uint32), c_words.astype(np.uint32), *sizes, np.diff(at, prepend=0).astype(np.int32), np.diff(back, prepend=0).astype(np.int32)])
        of, classes = (kind >> np.uint64(16)).astype(np.int64), (kind & np.uint64(CLASSES - 1)).astype(np.int64)
        t, t0 = _start(c, of, n_words)
        none = [np.zeros(n, np.uint32) for n in (len(t), n_words, n_words)]
        _save(f"{folder}/0", str(part), [t.astype(np.uint32), t0.astype(np.uint32), *none])
        sums, tables = _sums(of, classes, t, t0)
        out = _sum_rows(np.concatenate([sums, [c_words.sum()]]), tables)
        yield out.append_column("part", pa.array([part] * len(out), pa.int32()))

    return run


def _sweep(folder: str, i: int, tables, sums):
    """Sweep i (from 1) of the ranges whose numbers come in."""

    def run(batches):
        for part in (p for b in batches for p in b.column(0).to_pylist()):
            of, classes, c, *_ = _kinds(folder, part)
            t, t0, *kept = _load(f"{folder}/{i - 1}", str(part), _SEATS)
            t, t0 = sweep(c, of, classes, t.astype(np.int64), t0.astype(np.int64), tables.value, sums, np.random.Generator(np.random.PCG64([19, i, part])))
            if i > BURNT:
                kept = [k + x.astype(np.uint32) for k, x in zip(kept, (t, np.bincount(of, t, len(t0)), t0))]
            _save(f"{folder}/{i}", str(part), [t.astype(np.uint32), t0.astype(np.uint32), *kept])
            own, by_class = _sums(of, classes, t, t0)
            yield _sum_rows(np.concatenate([own, [0.0]]), by_class)

    return run


def _seated(folder: str):
    """The mean seating, in the order of each block."""

    def run(batches):
        for part in (p for b in batches for p in b.column(0).to_pylist()):
            of, classes, c, c_words, blocks, n_words, n_kinds, at, back = _kinds(folder, part)
            t, c0, t0 = (x / (SWEEPS - BURNT) for x in _load(f"{folder}/{SWEEPS}", str(part), _SEATS)[2:])
            g, r0 = (c - D1 * t).astype(np.float32), (c0 - D0 * t0).astype(np.float32)
            i = j = 0
            for block, w, k in zip(blocks.tolist(), n_words.tolist(), n_kinds.tolist()):
                a, b = at[i : i + w], back[j : j + k]
                i, j = i + w, j + k
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([_pack(g[b])]), pa.array([_pack(r0[a])]), pa.array([_pack(c_words[a])])], ["block", "part", "g", "r", "c"])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(folder: str, totals, tables, sums):
    v, n, c0, t0 = sums

    def run(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in groups for r in b.to_pylist()), key=lambda r: r["part"])
        g, r, c = (np.concatenate([_open(x[k], d) for x in rows]) for k, d in (("g", np.float32), ("r", np.float32), ("c", np.uint32)))
        ids, null, out, size, kinds, classes, token = read_block(folder, key[0].as_py())
        of = np.repeat(np.arange(len(kinds)), kinds)
        parent = (r.astype(np.float64) + (S0 + D0 * t0) / (v + 1)) / (S0 + c0)
        context = totals.value[classes].astype(np.float64)
        p = (g + (S1 + D1 * tables.value[classes]) * parent[of]) / (S1 + context)
        base = np.log10((c.astype(np.float64) + 0.5) / (n + 0.5 * (v + 1)))[of]
        starts = np.cumsum(size) - size
        add = lambda x: np.add.reduceat(x[token], starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null), pa.array(out), pa.array(size), pa.array(add((c > 0)[of].astype(np.int64))), pa.array(np.full(len(ids), int(n))), pa.array(add(base)), pa.array(add(np.log10(p)))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


_PIECES = 16


def _pieces(batches):
    """A partition's vectors, summed, in pieces."""
    total = np.zeros(CLASSES)
    for b in batches:
        for x in b.column(0).to_pylist():
            total += np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array([x.tobytes() for x in total.reshape(_PIECES, -1)], pa.binary())], ["i", "x"])


def _piece_sums(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0.0
    for b in groups:
        for x in b.column("x").to_pylist():
            total = total + np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "x"])


def _by_class(df: DataFrame, name: str):
    """Broadcast of the sum of all rows' vectors: one number a class."""
    got = df.where(f"{name} IS NOT NULL").select(name).mapInArrow(_pieces, "i int, x binary").groupBy("i").applyInArrow(_piece_sums, "i int, x binary").collect()
    out = np.zeros((_PIECES, CLASSES // _PIECES))
    for r in got:
        out[r.i] = np.frombuffer(bytes(r.x))
    return df.sparkSession.sparkContext.broadcast(out.ravel())


def score_texts(docs: DataFrame, block_tokens: int = 2_500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / 8192))
    folder = new_path(spark, "lm-blocks")
    sent = materialize(texts.mapInArrow(_count(parts, folder, block_tokens), _IN), "lm-counts")

    seats, totals = f"{folder}-seats", _by_class(sent, "totals")
    first = materialize(sent.where("part IS NOT NULL").drop("totals").groupBy("part").applyInArrow(_merge(seats), "i int, x binary, part int"), "lm-merged")
    discard(sent)
    present = materialize(first.select("part").distinct(), "lm-ranges").repartition(parts, "part")
    store, top = filesystem(seats)

    def collected(df):
        got = {r.i: np.frombuffer(bytes(r.x)) for r in df.select("i", "x").groupBy("i").applyInArrow(_piece_sums, "i int, x binary").collect()}
        tables = np.concatenate([got[i] for i in range(_PIECES)]) if got else np.zeros(CLASSES)
        return got.get(_PIECES, np.zeros(4)), tables

    sums, tables = collected(first)
    discard(first)
    n, mean_sums, mean_tables = sums[3], np.zeros(3), np.zeros(CLASSES)
    for i in range(1, SWEEPS + 1):
        sent_tables = spark.sparkContext.broadcast(tables)
        sums, tables = collected(present.mapInArrow(_sweep(seats, i, sent_tables, tuple(sums[:3].tolist())), "i int, x binary"))
        sent_tables.destroy()
        if store.get_file_info(f"{top}/{i - 1}").type.name == "Directory":
            store.delete_dir(f"{top}/{i - 1}")
        if i > BURNT:
            mean_sums, mean_tables = mean_sums + sums[:3] / (SWEEPS - BURNT), mean_tables + tables / (SWEEPS - BURNT)
    back = materialize(present.mapInArrow(_seated(seats), _BACK), "lm-seating")
    for name in ("kinds", str(SWEEPS)):
        if store.get_file_info(f"{top}/{name}").type.name == "Directory":
            store.delete_dir(f"{top}/{name}")
    v, c0, t0 = mean_sums.tolist()
    return back.groupBy("block").applyInArrow(_score(folder, totals, spark.sparkContext.broadcast(mean_tables), (v, float(n), c0, t0)), _SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
