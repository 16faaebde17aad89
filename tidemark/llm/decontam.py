"""Benchmark decontamination by a prefix-filtered set join.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased. A window is `window` consecutive
words of a benchmark item (a shorter item is one window), and its set holds its shingles of `shingle` words
(all its words, if it has fewer). A window occurs where an item-sized run of document words contains at least
`share` of its shingles; at a share of 1 that run must be the window, word for word. Then:

1. Documents are read once. Places that may hold an item's shingle (by a bitmap of bounded size) are kept as
   stretches of word hashes with `window` words around them; all later steps read these stretches alone.
2. Shingles are ordered by rarity: how often each occurs in all documents, counted exactly.
3. A window that must share o of its m shingles shares one of its m - o + 1 rarest: only this prefix is
   joined with places in documents.
4. Candidates in which the window would start before the document or end after it (positions), or in a
   document shorter than what must be shared (lengths), are dropped; the rest are verified word for word.

Scale: one shuffle of documents' keys, none of texts; every other shuffle follows places that share a
shingle with the benchmark. A passage that a third of all documents hold is one place a document, split by
adaptive skew joins, and nothing pairs documents with each other. The benchmark is never broadcast but by
Spark's own size check; the bitmap is bounded.

Edge cases: null or wordless text: no words, never contaminated; null, repeated or equal rows: each document
row has a result row (rows alike in id and text have equal ones); null item ids count as the item with the
empty id; items of one id are one item; items without words have no windows; empty tables give no rows, or no
hits; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bitmaps import bitmap, probe
from .bpe import release, slices
from .common import discard, materialize, row_keys
from .words import mix, word_hashes

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32
_MULTIPLY = np.uint64(0xD1342543DE82EF95)
TEXT_BYTES = 4 << 20


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and n + 1 offsets of the texts. Null counts as empty."""
    t = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offs = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = t.buffers()[2]
    data = _BLANK[np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]] if data is not None else np.zeros(0, np.uint8)
    return word_hashes(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer(offs - offs[0]), pa.py_buffer(data)]))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k entries of h."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _MULTIPLY + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(31)))
    return mix(out)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _blobs(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The ranges of h as binary values."""
    data = h[_ranges(starts, sizes)]
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * 8
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(data)]).cast(pa.binary())


def _unblob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values one after another, and n + 1 offsets."""
    c = column.cast(pa.large_binary())
    offs = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint64) if len(c) and offs[-1] > offs[0] else np.zeros(0, np.uint64), (offs - offs[0]) // 8


def _windows(window: int):
    """Map: item texts to their windows as blobs of word hashes."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1, TEXT_BYTES):
                h, at = plain_words(b.column(1))
                n = np.diff(at)
                size = np.minimum(n, window)
                count = np.where(n > 0, n - size + 1, 0)
                row = np.repeat(np.arange(len(n)), count)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), _blobs(h, _ranges(at[:-1], count), size[row])], ["item_id", "words"])
        release()

    return run


def _tokens(shingle: int):
    """Map: windows to their distinct shingles, each with the first offset where it stands."""

    def run(batches):
        for b in batches:
            flat, at = _unblob(b.column(0))
            row, off, tok = [], [], []
            for length in np.unique(np.diff(at)):
                rows = np.flatnonzero(np.diff(at) == length)
                k = int(min(shingle, length))
                each = int(length) - k + 1
                g = grams(flat, k)[_ranges(at[rows], np.full(len(rows), each))]
                row.append(np.repeat(rows, each)), off.append(np.tile(np.arange(each), len(rows))), tok.append(g)
            if row:
                r, o, g = map(np.concatenate, (row, off, tok))
                order = np.lexsort((o, g, r))
                r, o, g = r[order], o[order], g[order]
                first = np.concatenate([[True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])])
                r, o, g = r[first], o[first], g[first]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(np.diff(at)[r].astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(g.view(np.int64))], ["words", "size", "offset", "token"])

    return run


def _places(h: np.ndarray, at: np.ndarray, lengths: list[int], wanted: np.ndarray):
    """(position, token) wherever a run of one of the lengths that stays in its text may be wanted."""
    end = np.repeat(at[1:], np.diff(at))
    for k in lengths:
        g = grams(h, k)
        hit = probe(wanted, g) & (np.arange(len(g)) + k <= end[: len(g)])
        p = np.flatnonzero(hit)
        yield k, p, g[p]


def _stretches(lengths: list[int], wanted: np.ndarray, window: int):
    """Map: documents to one row each, and one for each stretch around places that may hold a wanted shingle."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, 3, TEXT_BYTES):
                h, at = plain_words(b.column(3))
                total = len(h)
                lo, hi = np.repeat(at[:-1], np.diff(at)), np.repeat(at[1:], np.diff(at))
                edge = np.zeros(total + 1, np.int64)
                for k, p, _ in _places(h, at, lengths, wanted):
                    np.add.at(edge, np.maximum(p - (window - min(k, window)), lo[p]), 1)
                    np.add.at(edge, np.minimum(p + window, hi[p]), -1)
                inside = np.cumsum(edge[:-1]) > 0
                new = inside & ~np.concatenate([[False], inside[:-1]])[:total]
                firsts = at[:-1][at[:-1] < total]
                new[firsts] = inside[firsts]
                starts = np.flatnonzero(new)
                stop = ~inside
                stop[firsts] = True
                stops = np.append(np.flatnonzero(stop), total)
                sizes = stops[np.searchsorted(stops, starts + 1)] - starts
                doc = np.searchsorted(at, starts, "right") - 1
                n = pa.array(np.diff(at).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.binary())], ["k1", "k2", "doc_id", "n_words", "at", "words"])
                if len(starts):
                    d = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(d), b.column(1).take(d), b.column(2).take(d), n.take(d), pa.array(starts - at[doc]), _blobs(h, starts, sizes)], ["k1", "k2", "doc_id", "n_words", "at", "words"])
        release()

    return run


def _count(lengths: list[int], wanted: np.ndarray):
    """Map: stretches to how often each token stands in them."""

    def run(batches):
        for b in batches:
            h, at = _unblob(b.column(0))
            got = [g for _, _, g in _places(h, at, lengths, wanted)]
            tokens, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], ["token", "n"])

    return run


def _candidates(lengths: list[int], wanted: np.ndarray, window: int):
    """Map: stretches to places of prefix tokens, with 2 * window - 1 words around each (the place in the middle)."""

    def run(batches):
        for b in batches:
            h, at = _unblob(b.column(4))
            if not len(h):
                continue
            wide = np.zeros(len(h) + 2 * window, np.uint64)
            for k, p, g in _places(h, at, lengths, wanted):
                row = np.searchsorted(at, p, "right") - 1
                for i in range(0, len(p), 1 << 16):
                    q, r = p[i : i + (1 << 16)], row[i : i + (1 << 16)]
                    near = q[:, None] + np.arange(1 - window, window)
                    wide[window : window + len(h)] = h
                    ctx = np.where((near >= at[r][:, None]) & (near < at[r + 1][:, None]), wide[near + window], np.uint64(0))
                    size = np.full(len(q), 2 * window - 1)
                    d = pa.array(r)
                    place = np.asarray(b.column(3))[r] + (q - at[r])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(d), b.column(1).take(d), b.column(2).take(d), pa.array(place), pa.array(g[i : i + (1 << 16)].view(np.int64)), _blobs(ctx.ravel(), np.arange(len(q)) * (2 * window - 1), size)], ["k1", "k2", "n_words", "place", "token", "near"])

    return run


def _verify(window: int, shingle: int, share: float):
    """Map: candidates to the starts of item-sized runs that hold at least the share of the window's shingles."""

    def run(batches):
        for b in batches:
            near, _ = _unblob(b.column(3))
            flat, at = _unblob(b.column(4))
            near, sizes = near.reshape(-1, 2 * window - 1), np.diff(at)
            rows, starts = [], []
            for length in np.unique(sizes):
                r, length = np.flatnonzero(sizes == length), int(length)
                k = min(shingle, length)
                each = length - k + 1
                own = np.stack([grams(flat[at[i] : at[i + 1]], k) for i in r])
                distinct = np.array([len(np.unique(x)) for x in own])
                there = np.stack([grams(x, k) for x in near[r]])
                have = (there[:, :, None] == own[:, None, :])
                for back in range(length - k + 1):  # the run starts `back` words before the place
                    s = window - 1 - back
                    found = have[:, s : s + each, :].any(axis=1)
                    hits = np.array([len(np.unique(x[f])) for x, f in zip(own, found)])
                    start = np.asarray(b.column(2))[r] - back
                    ok = (hits >= np.ceil(share * distinct - 1e-9)) & (start >= 0) & (start + length <= np.asarray(b.column(5))[r])
                    rows.append(r[ok]), starts.append(start[ok])
            if rows:
                d = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(d), b.column(1).take(d), pa.array(np.concatenate(starts)), pa.array(sizes[np.asarray(d)].astype(np.int32)), b.column(4).take(d)], ["k1", "k2", "start", "size", "words"])

    return run


def _tables(docs: DataFrame, items: DataFrame, window: int, shingle: int, share: float):
    """(documents with keys and word counts, occurrences of windows, windows of items, tables to drop)."""
    if not 1 <= shingle <= window or not 0 < share <= 1:
        raise ValueError("needs 1 <= shingle <= window and 0 < share <= 1")
    source = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text IS NOT NULL")
    held = materialize(source.mapInArrow(_windows(window), "item_id string, words binary").distinct(), "item-windows")
    tokens = materialize(held.select("words").distinct().mapInArrow(_tokens(shingle), "words binary, size int, offset int, token long"), "item-tokens")
    lengths = sorted({min(shingle, r[0]) for r in tokens.select("size").distinct().collect()})  # at most `window` sizes
    wanted = bitmap(tokens, "token")
    texts = docs.select(*row_keys(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    kept = materialize(texts.mapInArrow(_stretches(lengths, wanted, window), "k1 long, k2 long, doc_id long, n_words long, at long, words binary"), "stretches")
    stretches = kept.where("words IS NOT NULL")
    # rarest shingles first; a window's prefix is what it can't do without
    counts = stretches.select("words").mapInArrow(_count(lengths, wanted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    ranked = tokens.join(counts, "token", "left").withColumns({
        "rank": F.row_number().over(Window.partitionBy("words").orderBy(F.coalesce("n", F.lit(0)), "token")),
        "tokens": F.count("*").over(Window.partitionBy("words")),
    })
    need = F.ceil(F.col("tokens") * share - 1e-9)
    prefix = materialize(ranked.where(F.col("rank") <= F.col("tokens") - need + 1).where("n IS NOT NULL").select("words", "size", "offset", "token"), "prefixes")
    places = stretches.select("k1", "k2", "n_words", "at", "words").mapInArrow(_candidates(lengths, bitmap(prefix, "token"), window), "k1 long, k2 long, n_words long, place long, token long, near binary")
    both = places.join(prefix, "token")
    if share == 1:
        start = F.col("place") - F.col("offset")
        bounds = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
        same = F.expr(f"substring(near, 8 * ({window - 1} - offset) + 1, 8 * size) = words")
        found = both.where(bounds & same).select("k1", "k2", start.alias("start"), "size", "words")
    else:
        k = F.least("size", F.lit(shingle))
        near_enough = both.where(F.col("n_words") >= F.col("size")).where((F.col("place") + k <= F.col("n_words")))
        found = near_enough.select("k1", "k2", "place", "near", "words", "n_words").mapInArrow(_verify(window, shingle, share), "k1 long, k2 long, start long, size int, words binary")
    found = materialize(found.distinct(), "occurrences")
    return kept.where("words IS NULL").select("k1", "k2", "doc_id", "n_words"), found, held, [tokens, prefix, kept, found, held]


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, share: float = 1.0) -> DataFrame:
    """doc_id, item_id, start, size: each run of document words (from 0) in which a window of an item occurs."""
    heads, found, held, drop = _tables(docs, items, window, shingle, share)
    out = materialize(found.join(held, "words").select("k1", "k2", "item_id", "start", "size").distinct().join(heads.select("k1", "k2", "doc_id").distinct(), ["k1", "k2"]).select("doc_id", "item_id", "start", "size"), "found")
    for t in drop:
        discard(t)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, share: float = 1.0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row a document."""
    heads, found, held, drop = _tables(docs, items, window, shingle, share)
    # words in the union of a document's runs: each run adds what lies beyond all before it
    runs = found.select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("end")).groupBy("k1", "k2", "start").agg(F.max("end").alias("end"))
    upto = F.max("end").over(Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    hit = runs.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(upto, F.lit(0))))).groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    named = found.select("k1", "k2", "words").distinct().join(held, "words").select("k1", "k2", "item_id").distinct()
    listed = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    got = hit.join(listed, ["k1", "k2"])
    out = heads.join(got, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
    out = materialize(out, "decontaminated")
    for t in drop:
        discard(t)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
h AS (SELECT p.doc_id, p.i, v.size, v.item_id FROM (SELECT doc_id, i, s.size, array_to_string(w[i : i + s.size - 1], ' ') AS words FROM p, (SELECT DISTINCT size FROM v) s WHERE i + s.size - 1 <= len(w)) p JOIN v USING (words, size)),
n AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS x FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
