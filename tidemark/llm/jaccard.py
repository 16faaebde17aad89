"""N-gram Jaccard join by universe-partition pigeonhole, exact.

A text's set holds its distinct k-word shingles (fewer words: the whole sequence as one; none: empty,
linked with nothing). Sets are joined where den * |intersection| >= num * |union|.

Sizes fall in bands [l, u] whose ratio is den / num, so a set can only link within its band or the one
below; each set enters both. In a band, linked sets differ in at most H = (den - num) * (s + r) //
(den + num) elements, s = u and r = the largest partner. The hash universe is cut into m segments by
value. By cost, each band takes one of two allocations:
- m = H + 1 + x whole segments: linked sets agree on at least x + 1 of them. A set with at most x
  empty segments leaves those out (two sets that agree on a segment agree that it is empty, so an
  agreeing one remains); a set with more indexes them too. x grows with the band, so that more are rare.
- m = ceil((H + 1) / 2) segments with their one-deletion neighbourhoods: linked sets differ by at most
  one element in at least one segment, so they share its signature or one less an element.
The cost counts index entries and, weighted, the expected entries of sparse segments, which many sets share.

Candidates are sets that share an entry. Equal sets are one node from the start. Links are looked for
where they can still join components: first, each node against one leader (of the nodes drawn for its
entries the one that stands for most of them). Then in turns, while an entry has nodes in different
components: all pairs of them are compared by their bitmaps inside map tasks, in blocks of about 1024
nodes, and of the pairs not tried yet each node's nearest 1, 1, 2, 4, 8... are verified and united, until a
turn finds none that the bitmaps allow. A pair is thus left unverified only within a component, and what is
emitted follows the nodes, not their pairs. Bitmaps (parities of the set's elements) never rule out a link
and rule out nearly all pairs somewhat below the limit; verification is exact on the sets themselves.

Scale: an entry is 8 bytes in a block sorted by numpy; within a map task, copies and repeats of an
entry are collapsed before the shuffle, so no task receives more than one row a map task for a hot
entry. Hash ranges grow in number with the texts. The index is shuffled once and never stored; shared
entries go on as a table. Only texts of nodes with a pair that passes the bitmaps move: packed, once to
their node, and once to each leader they are verified against; a hot leader's members are split. Tables
go as soon as nothing reads them. Shingles and nodes are 64-bit hashes.

Edge cases: null or wordless text: size 0, its own component; null doc_id: its text links like any other,
component_id is null where no id is reachable; repeated ids and rows: equal sets are linked, different
ones are told apart by a hash of id and text; ties: none, links do not depend on order; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import release, slices
from .common import bit_filter, components, discard, keep_rows, materialize, row_keys
from .words import mix, word_hashes

_K = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
_ONE = np.uint64(1)
BLOCK = 1024
#: Members of a leader that one task verifies, and bytes of text a hash range of the index stands for.
MEMBERS, RANGE_BYTES = 512, 16 << 20


def shingle_sets(texts: pa.Array, k: int):
    """Yield each text's sorted distinct shingle hashes."""
    words, at = word_hashes(texts)
    n = len(words) - k + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h += (words[i : i + n] ^ (words[i : i + n] >> np.uint64(29))) * _K[i % 8] + _K[(i + 3) % 8] * np.uint64(i // 8)
            h = (h << np.uint64(7)) | (h >> np.uint64(57))
        h = mix(h)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            x = np.sort(h[a : b - k + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x
        elif b > a:
            x = np.zeros(1, np.uint64)
            for w in words[a:b].tolist():
                x = mix(x * _K[0] + np.uint64(w) + np.uint64(b - a))
            yield x
        else:
            yield np.zeros(0, np.uint64)


def node_of(x: np.ndarray) -> int:
    """64-bit identifier of a set."""
    if not len(x):
        return 0
    with np.errstate(over="ignore"):
        s = mix(x ^ _K[1]).sum(dtype=np.uint64) * _K[2] + mix(x + _K[4]).sum(dtype=np.uint64) + np.uint64(len(x))
    return int(mix(np.array([s], np.uint64)).view(np.int64)[0])


@functools.cache
def bands(num: int, den: int, upto: int) -> tuple[tuple[int, int], ...]:
    out, low = [], 1
    while low <= upto:
        high = max(low, low * den // num - (low * den % num == 0))
        out.append((low, high))
        low = high + 1
    return tuple(out)


@functools.cache
def allocation(num: int, den: int, low: int, high: int) -> tuple[str, int, int]:
    """(kind, segments, x) of a band: 'whole' or 'less' (with one-deletion neighbourhoods)."""
    h = (den - num) * (high + high * den // num) // (den + num)

    def crowd(m, upto):  # expected sparse segments of a set of the band's middle size
        mean = (low + high) / 2 / m
        return m * math.exp(-mean) * sum(mean**j / math.factorial(j) for j in range(upto + 1))

    best, x = None, 0
    while x <= max(4, h):
        m = h + 1 + x
        mean = crowd(m, 0)
        j = np.arange(x + 1)
        with np.errstate(divide="ignore"):
            law = np.exp(j * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(j[1:]))])) if mean > 0 else (j == 0) * 1.0
        kept = mean - float((j * law).sum())
        best = min(best or (math.inf,), (m + 200 * max(0.0, kept), "whole", m, x))
        x += 1 + x // 8
    m = -(-(h + 1) // 2)
    return min(best, (m + (low + high) / 2 + 200 * crowd(m, 1), "less", m, 0))[1:]


@functools.lru_cache(4096)
def _fences(m: int) -> np.ndarray:
    return np.array([(i << 64) // m + (1 if (i << 64) % m else 0) for i in range(1, m)], np.uint64)


def entries(x: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index entries of a set, in its band and the one below."""
    n = len(x)
    if not n:
        return np.zeros(0, np.uint64)
    own = bands(num, den, 1 << (n - 1).bit_length())
    b = next(i for i, (low, high) in enumerate(own) if low <= n <= high) if n < 64 else _band_at(num, den, n)
    y = mix(x + _K[5])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(y, out=sums[1:])
    out = []
    for g in {b, max(0, b - 1)}:
        low, high = own[g]
        if n > high * den // num:
            continue
        kind, m, slack = allocation(num, den, low, high)
        at = np.concatenate([[0], np.searchsorted(x, _fences(m)), [n]])
        sig = sums[at[1:]] - sums[at[:-1]]
        place = (np.arange(m, dtype=np.uint64) + np.uint64(g << 32)) * _K[6]
        if kind == "whole":
            full = at[1:] > at[:-1]
            if m - np.count_nonzero(full) <= slack:
                sig, place = sig[full], place[full]
            out.append(mix(sig ^ mix(place + _ONE)))
        else:
            seg = np.repeat(np.arange(m), np.diff(at))
            out.append(mix(np.concatenate([sig, sig[seg] - y]) ^ mix(np.concatenate([place, place[seg]]) + _ONE)))
    return np.unique(np.concatenate(out))


def _band_at(num: int, den: int, n: int) -> int:
    own = bands(num, den, 1 << (n - 1).bit_length())
    lo, hi = 0, len(own) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if own[mid][1] < n:
            lo = mid + 1
        else:
            hi = mid
    return lo


_INDEX = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("packed", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
_INDEX_SQL = "part int, n int, packed binary, nodes binary, sizes binary"
_ROWS = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "k1", "k2", "size", "node")], ("sketch", pa.binary())])
_ROWS_SQL = "doc_id long, k1 long, k2 long, size long, node long, sketch binary"


def _pack(sigs: np.ndarray, local: np.ndarray) -> bytes:
    """Sorted entries, as the 48 upper bits in steps, with their nodes' places in the block's list."""
    high = (sigs >> np.uint64(32)).astype(np.uint32)
    parts = np.diff(high, prepend=np.uint32(0)), ((sigs >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16), local.astype(np.uint16)
    return pa.compress(b"".join(x.tobytes() for x in parts), codec="zstd", asbytes=True)


def _open(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    b = pa.decompress(packed, 8 * n, codec="zstd", asbytes=True)
    high = np.cumsum(np.frombuffer(b, np.uint32, n), dtype=np.uint32).astype(np.int64)
    return high << 16 | np.frombuffer(b, np.uint16, n, 4 * n), np.frombuffer(b, np.uint16, n, 6 * n)


def _rows(k: int):
    """Rows of documents; the sketch with the first of a run's equal sets."""

    def run(batches):
        seen = set()
        for batch in batches:
            for b in slices(batch, 1, 1 << 20):
                size, ids, sketch = [], [], []
                for x in shingle_sets(b.column(1), k):
                    node = node_of(x)
                    new = len(x) > 0 and node not in seen
                    size.append(len(x)), ids.append(node if len(x) else None), sketch.append(parity(x).tobytes() if new else None)
                    if new:
                        seen.add(node)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(size, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketch, pa.binary())], schema=_ROWS)
                if len(seen) >= 65_000:
                    seen = set()
        release()

    return run


def _index(k: int, num: int, den: int, parts: int, most: int = 700_000):
    """Blocks of entries by hash range: part >= 0 for one node of each entry of the block, part < 0 (dealt by
    block) for all nodes of entries that several nodes of the block share."""

    def blocks(sigs, nodes, sizes):
        s, local = np.concatenate(sigs), np.repeat(np.arange(len(nodes)), [len(x) for x in sigs])
        order = np.argsort(s, kind="stable")
        s, local = s[order], local[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        many = ~(new & np.concatenate([new[1:], [True]]))
        rows = [(-1 - nodes[0] % parts, s[many], local[many])] if many.any() else []
        s, local = s[new], local[new]  # the first of a shared entry also stands for it outside the block
        cut = np.searchsorted(s, np.array([(i << 64) // parts for i in range(parts)], np.uint64)).tolist() + [len(s)]
        rows += [(p, s[a:b], local[a:b]) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        ids, lens = np.array(nodes, np.int64), np.array(sizes, np.int32)
        packed, of, size = [], [], []
        for _, x, at in rows:
            own, at = np.unique(at, return_inverse=True)
            packed.append(_pack(x, at)), of.append(ids[own].tobytes()), size.append(lens[own].tobytes())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([len(r[1]) for r in rows], pa.int32()), *[pa.array(x, pa.binary()) for x in (packed, of, size)]], schema=_INDEX)

    def run(batches):
        seen, sigs, nodes, sizes, held = set(), [], [], [], 0
        for batch in batches:
            for b in slices(batch, 0, 1 << 20):
                for x in shingle_sets(b.column(0), k):
                    node = node_of(x)
                    if len(x) and node not in seen:
                        seen.add(node)
                        e = entries(x, num, den)
                        sigs.append(e), nodes.append(node), sizes.append(len(x))
                        held += len(e)
                        if held >= most or len(nodes) >= 65_000:
                            yield blocks(sigs, nodes, sizes)
                            seen, sigs, nodes, sizes, held = set(), [], [], [], 0
        if sigs:
            yield blocks(sigs, nodes, sizes)
        del seen, sigs, nodes, sizes
        release()

    return run


def _entries_of(batch: pa.RecordBatch):
    for n, packed, nodes, sizes in zip(*[batch.column(c).to_pylist() for c in ("n", "packed", "nodes", "sizes")]):
        s, at = _open(packed, n)
        yield s, np.frombuffer(nodes, np.int64)[at], np.frombuffer(sizes, np.int32)[at].astype(np.int64)


def _shared(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a hash range that several blocks have, with different nodes (part < 0: all that blocks list)."""
    if key[0].as_py() < 0:
        for b in groups:
            for s, n, z in _entries_of(b):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n), pa.array(z)], ["sig", "node", "size"])
        return
    s, n, z = (np.concatenate(x) for x in zip(*[e for b in groups for e in _entries_of(b)]))
    order = np.lexsort((n, s))
    s, n, z = s[order], n[order], z[order]
    keep = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])])
    s, n, z = s[keep], n[keep], z[keep]
    same = s[1:] == s[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    out = pa.RecordBatch.from_arrays([pa.array(s[many]), pa.array(n[many]), pa.array(z[many])], ["sig", "node", "size"])
    del s, n, z, order, keep, same, many
    release()
    yield out


def parity(x: np.ndarray) -> np.ndarray:
    """How often the set's elements fall on each of B bits, odd or even (B: the power of two at or above four
    times its size, 1024 at least). Two sets' parities differ in at most as many bits as the sets in elements, so a
    large difference rules a pair out without its sets."""
    bits = max(1024, 1 << (4 * len(x) - 1).bit_length())
    odd = np.bincount((x >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(p: np.ndarray, longs: int) -> np.ndarray:
    """Parities (rows of a matrix) on fewer bits."""
    while p.shape[1] > longs:
        p = p[:, : p.shape[1] // 2] ^ p[:, p.shape[1] // 2 :]
    return p


def _sketches(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width in longs: the rows of a column of sketches that have it, and their matrix."""
    raw = column.to_pylist()
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
    out = {}
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size == w)
        out[w] = at, np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint64).reshape(-1, w)
    return out


def _near(num: int, den: int):
    """Of (a, b, sizes, sketches), the pairs that their parities do not rule out."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 4096):
                b = batch.slice(i, 4096)
                limit = (den - num) * (np.asarray(b.column(2)) + np.asarray(b.column(3)))
                rows = np.arange(len(b))
                keep = _apart(_sketches(b.column(4)), _sketches(b.column(5)), rows, rows) * (den + num) <= limit
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _texts_of(k: int):
    """(node, packed text) of rows."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, 0, 1 << 20):
                nodes = [node_of(x) if len(x) else None for x in shingle_sets(b.column(0), k)]
                raw = b.column(0).cast(pa.binary()).to_pylist()
                x = [len(r).to_bytes(8, "little") + pa.compress(r, codec="zstd", asbytes=True) for r in raw]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(x, pa.binary())], ["node", "x"])

    return run


def _apart(left, right, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bits in which the parities of rows u and v differ. left, right: by width, as of _sketches."""
    out = np.zeros(len(u), np.int64)
    for w, (i0, p) in left.items():
        at0 = np.searchsorted(i0, u)
        mine = (at0 < len(i0)) & (i0[np.minimum(at0, len(i0) - 1)] == u)
        for z, (i1, q) in right.items():
            at1 = np.searchsorted(i1, v)
            both = np.flatnonzero(mine & (at1 < len(i1)) & (i1[np.minimum(at1, len(i1) - 1)] == v))
            step = max(64, (1 << 20) // max(w, z))
            for k in range(0, len(both), step):
                x = both[k : k + step]
                out[x] = np.bitwise_count(fold(p[at0[x]], min(w, z)) ^ fold(q[at1[x]], min(w, z))).sum(axis=1, dtype=np.int64)
    return out


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.view(np.uint64), b.view(np.uint64)
    return mix(np.minimum(a, b) ^ _K[2]) * _K[3] + mix(np.maximum(a, b) ^ _K[4])


def _close(num: int, den: int, most: int):
    """Of pairs of neighbours in one entry (and pair of blocks) that are in different components, not tried
    before, and whose sizes and parities allow a link: the `most` nearest of each node.
    Rows come sorted; a group is at most two blocks."""

    def nearest(node, ratio, other):
        order = np.lexsort((other, ratio, node))
        node, ratio, other = node[order], ratio[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        rank = np.arange(len(node)) - np.repeat(first, np.diff(first, append=len(node)))
        return node[rank < most], ratio[rank < most], other[rank < most]

    def compare(t: pa.Table):
        sig, lo, hi, blk, node, size, c = (np.asarray(t.column(i)) for i in range(7))
        sketches = _sketches(t.column(7))
        p = np.zeros((len(sig), 16), np.uint64)
        for at, x in sketches.values():
            p[at] = fold(x, 16)
        bad, tried = t.column(8).combine_chunks(), np.zeros(0, np.uint64)
        if len(bad.flatten()):
            tried = _pair_key(np.repeat(node, np.asarray(bad.value_lengths().fill_null(0))), np.asarray(bad.flatten()))
        i, d, held = np.arange(len(sig)), 1, [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        fresh, n = [[], [], []], 0
        while len(i):
            i = i[i + d < len(sig)]
            j = i + d
            same = (sig[i] == sig[j]) & (lo[i] == lo[j]) & (hi[i] == hi[j])
            i, j = i[same], j[same]
            ok = (c[i] != c[j]) & ((lo[i] == hi[i]) | (blk[i] != blk[j])) & (size[i] * num <= size[j] * den) & (size[j] * num <= size[i] * den)
            x, y = i[ok], j[ok]
            for k in range(0, len(x), 1 << 16):
                u, v = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                limit = (den - num) * (size[u] + size[v]) / (den + num)
                hit = np.bitwise_count(p[u] ^ p[v]).sum(axis=1, dtype=np.int64) <= limit
                u, v, limit = u[hit], v[hit], limit[hit]
                if len(u) and len(tried):
                    new = ~np.isin(_pair_key(node[u], node[v]), tried)
                    u, v, limit = u[new], v[new], limit[new]
                if len(u):
                    apart = _apart(sketches, sketches, u, v)
                    hit = apart <= limit
                    u, v, ratio = u[hit], v[hit], (apart / limit)[hit]
                    for z, w in zip(fresh, (np.concatenate([u, v]), np.concatenate([ratio, ratio]), np.concatenate([v, u]))):
                        z.append(w)
                    n += 2 * len(u)
                if n > 1 << 18:
                    held, fresh, n = nearest(*[np.concatenate([h, *f]) for h, f in zip(held, fresh)]), [[], [], []], 0
            d += 1
        u, _, v = nearest(*[np.concatenate([h, *f]) for h, f in zip(held, fresh)])
        got = np.unique(np.stack([sig[u], np.minimum(node[u], node[v]), np.maximum(node[u], node[v])], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(3)], ["sig", "a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < 10_000:
                continue
            # whole groups go, the last one waits for its end
            key = [np.asarray(held.column(i)) for i in range(3)]
            change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            if len(change):
                yield compare(held.slice(0, int(change[-1])).combine_chunks())
                held = held.slice(int(change[-1]))
        if held is not None:
            yield compare(held.combine_chunks())
        release()

    return run


def _sets_of(packed: list[bytes], k: int) -> list[np.ndarray]:
    raw = [pa.decompress(p[8:], int.from_bytes(p[:8], "little"), codec="zstd", asbytes=True) for p in packed]
    return list(shingle_sets(pa.array(raw, pa.large_binary()), k))


def _verify(k: int, num: int, den: int):
    """Of the texts of each leader a, its own (null b) first, those linked with it."""

    def linked(p, q):
        if len(p) > len(q):
            p, q = q, p
        spot = np.searchsorted(q, p)
        common = int(np.count_nonzero(q[np.minimum(spot, len(q) - 1)] == p))
        return den * common >= num * (len(p) + len(q) - common)

    def run(batches):
        lead, own = None, None
        for batch in batches:
            for b in slices(batch, 2, 1 << 20):
                keep = []
                for a, other, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _sets_of(b.column(2).to_pylist(), k)):
                    if other is None:
                        lead, own = a, x
                    elif lead != a:
                        raise ValueError(f"the text of node {a} is missing")
                    keep.append(other is not None and linked(own, x))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, k1 and k2 (hashes of id and text), n_shingles, node, component_id for every row; null root: no words."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row_keys(docs))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 14, volume // RANGE_BYTES))
    # the index is shuffled as it is made and never a table; rows of documents come from a pass of their own
    index = texts.select("text").mapInArrow(_index(k, num, den, parts), _INDEX_SQL)
    every = materialize(index.groupBy("part").applyInArrow(_shared, "sig long, node long, size long").distinct(), "jaccard-shared")
    rows = materialize(texts.select("doc_id", "text", "k1", "k2").mapInArrow(_rows(k), _ROWS_SQL), "jaccard-documents")
    # near copies share many entries: of the entries that have the same nodes (by count and two hashes), one is enough
    same = every.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("k"))
    shared = materialize(every.join(same.groupBy("n", "h", "k").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi"), "jaccard-groups")
    discard(every)
    # of each node with a candidate: one row that has its text, and its sketch
    asked = rows.where("sketch IS NOT NULL").join(shared.select("node").distinct(), "node", "left_semi")
    asked = materialize(asked.groupBy("node").agg(F.min(F.struct("k1", "k2", "size", "sketch")).alias("r")).select("node", "r.*"), "jaccard-asked")

    def verified(close, name):
        """The linked ones of pairs (a leads b) that passed the bitmaps, by the sets."""
        heads = close.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
        members = close.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
        leaders = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
        both = materialize(members.union(leaders).withColumn("node", F.coalesce("b", "a")), f"jaccard-asked-{name}")
        wanted = asked.join(both.select("node").distinct(), "node", "left_semi")
        found = bit_filter(texts.select("text", "k1", "k2"), wanted, "k1").join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi").select("text")
        found = found.mapInArrow(_texts_of(k), "node long, x binary").groupBy("node").agg(F.first("x").alias("x"))
        dealt = both.join(found, "node").select("a", "salt", "b", "x").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        links = materialize(dealt.select("a", "b", "x").mapInArrow(_verify(k, num, den), "a long, b long"), f"jaccard-links-{name}")
        discard(both)
        return links

    def near(size, other):
        return (F.col(size) * num <= F.col(other) * den) & (F.col(other) * num <= F.col(size) * den)

    # first, every node against one of the nodes drawn for its entries (by hash, alike in all entries)
    lead = shared.groupBy("sig").agg(F.min(F.struct(F.xxhash64("node", F.lit(0)), "node", "size")).alias("o")).select("sig", F.col("o.node").alias("a"), F.col("o.size").alias("so"))
    drawn = shared.join(lead, "sig").where((F.col("a") != F.col("node")) & near("size", "so"))
    drawn = drawn.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n"))
    best = drawn.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
    left = asked.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("sketch").alias("pa"))
    right = asked.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("sketch").alias("pb"))
    close = best.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", "pa", "pb").mapInArrow(_near(num, den), "a long, b long")
    tried = materialize(close, "jaccard-tried-one")
    links = verified(tried, "one")
    # then, while an entry has nodes in different components: each node against its nearest ones there
    left, turn = materialize(shared.groupBy("sig").agg(F.count("*").alias("n")), "jaccard-sizes"), 0
    while True:
        found = components(links, name="jaccard-found")
        bad = tried.select(F.col("b").alias("node"), "a").groupBy("node").agg(F.collect_set("a").alias("bad"))
        s = shared.join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
        many = s.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").join(left, "sig").select("sig", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        s = s.join(many, "sig").join(asked.select("node", "sketch"), "node").join(bad, "node", "left")
        # blocks by themselves in the first turn, when a large family is not united yet; then all pairs of blocks
        blk = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        s = s.withColumn("blk", blk).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if turn else F.col("blk"))
        s = s.select("sig", F.least("blk", "y").alias("lo"), F.greatest("blk", "y").alias("hi"), "blk", "node", "size", "c", "sketch", "bad")
        s = s.repartition(F.col("sig"), F.col("lo"), F.col("hi")).sortWithinPartitions("sig", "lo", "hi", "blk")
        got = materialize(s.mapInArrow(_close(num, den, 1 << max(0, turn - 1)), "sig long, a long, b long"), "jaccard-close")
        if got.isEmpty() and (turn or left.where(F.col("n") > BLOCK).isEmpty()):
            discard(got)
            break
        first = F.struct(F.xxhash64("a", F.lit(0)), "a") < F.struct(F.xxhash64("b", F.lit(0)), "b")
        pairs = got.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
        more = verified(pairs, "more")
        old = [found, got, more, links, tried, left]
        # of the entries whose pairs were all compared, only those that had one can have one again
        again = left.join(got.select("sig").distinct().withColumn("had", F.lit(True)), "sig", "left").where(F.col("had") if turn else F.col("had") | (F.col("n") > BLOCK))
        left = materialize(again.select("sig", "n"), "jaccard-sizes")
        links, tried = materialize(links.union(more), "jaccard-links"), materialize(tried.union(pairs), "jaccard-tried")
        for table in old:
            discard(table)
        turn += 1
    one = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "doc_id")
    one = materialize(one, "jaccard-nodes")
    low = one.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = materialize(one.join(low, "root").select("node", "root", "component_id"), "jaccard-components")
    for table in (shared, asked, links, tried, left, found, one):
        discard(table)
    return rows.join(of, "node", "left").select("doc_id", "k1", "k2", F.col("size").alias("n_shingles"), "node", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs with one document of each component (the smallest doc_id, null last), all columns."""
    found = materialize(jaccard_components(docs, k, num, den).where("root IS NOT NULL").select("root", "doc_id", "k1", "k2"), "jaccard-roots")
    best = found.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("o")).where("n > 1")
    return keep_rows(docs, found, best.select("root", F.col("o.k1").alias("k1"), F.col("o.k2").alias("k2")), "root")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
