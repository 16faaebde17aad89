"""Phrase collocations by growth of contiguous patterns: occurrence pointers projected by frequent prefixes.

Texts with A-Z lower-cased are cut at [.,;:!?\\x0A-\\x0D] into pieces, and these into words [^\\x20\\x09]+;
everything is counted per language (null: und). A candidate is a phrase of 2 to `longest` words with at least
`least` occurrences in pieces, overlaps included. It is grown to the right, word by word:

1. Words are counted; a bitmap of bounded size tells the frequent ones to later passes.
2. Pairs of neighbouring frequent words are counted, and the frequent pairs make a second bitmap: the prefixes
   of two words. Both bitmaps only spare work; counts below are exact.
3. Each occurrence of a frequent prefix is a pointer, with the words that follow it while each next pair is
   frequent. Pointers are sorted by range, so that a task holds whole prefixes, with all their extensions
   next to each other; it projects a prefix's pointers, extends it by each next word, and goes on, depth
   first, with what is still frequent. A prefix of any size may lie over several ranges: prefixes at the ends
   of a range are never dropped there, and their parts are summed after.

A phrase's score is that of its weakest cut into two parts, in exact whole numbers. A candidate inside a longer
candidate that has at least `absorb` percent of its occurrences goes. The first `top` of each language stay.

Scale: within a map task equal pairs and pointers are summed before they move; sorting splits hot prefixes by
what follows them; a task streams its range. Words are 64-bit hashes, salted by language, until the last join.
The first `top` are found in salted parts of a language before they meet.

Edge cases: null and empty texts have no words; null languages count as und; ids are not read, and repeated
rows count each; ties in score and count are ordered by the phrase's bytes; an empty table, or one without
candidates, gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import ranges
from .bitmaps import bitmap, probe
from .bpe import release, slices
from .common import discard, materialize
from .words import mix, word_hashes

TEXT_BYTES = 4 << 20
#: Words whose pairs and pointers a map task sums before it sends them, and rows that a sorted range is read in.
AT_ONCE, ROWS = 3_000_000, 1 << 16
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_MULTIPLY = np.uint64(0x9FB21C651E98DF25)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _words(batch: pa.RecordBatch):
    """(lang, text) rows to (hashes of words, whether the next word follows in the same piece, starts, ends, bytes, row of each word)."""
    t = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
    offs = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], np.uint8)[offs[0] : offs[-1]] if t.buffers()[2] is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    kind = _KIND[data]
    spaced = np.where(kind == 0, data, np.uint8(32))
    h, at = word_hashes(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer(offs), pa.py_buffer(spaced)]))
    if not len(h):
        return h, np.zeros(0, bool), *[np.zeros(0, np.int64)] * 2, data, np.zeros(0, np.int64)
    inside = kind == 0
    first = np.concatenate([[True], ~inside[:-1]])
    first[offs[:-1][offs[:-1] < len(data)]] = True
    last = np.concatenate([~inside[1:], [True]])
    last[offs[1:][offs[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    row = np.repeat(np.arange(len(t)), np.diff(at))
    piece = np.cumsum(kind == 2)[starts]
    follows = np.concatenate([(row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), [False]])
    coded = batch.column(0).dictionary_encode()
    salts = np.array([_salt(x) for x in coded.dictionary.to_pylist()], np.uint64)
    h = mix(h ^ salts[np.asarray(coded.indices)][row])
    h[h == 0] = 1
    return h, follows, starts, ends, data, row


def _count_words(batches):
    """Map: (lang, text) to (h, lang, word, n) of each few megabytes."""
    for batch in batches:
        for b in slices(batch, 1, TEXT_BYTES):
            h, _, starts, ends, data, row = _words(b)
            one, at, n = np.unique(h, return_index=True, return_counts=True)
            size = ends[at] - starts[at]
            text = _LOWER[data[ranges(starts[at], size)]]
            offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), b.column(0).take(pa.array(row[at])), words.cast(pa.large_string()).cast(pa.string()), pa.array(n)], ["h", "lang", "word", "n"])
    release()


def _runs(batches):
    """Words of many texts together, about AT_ONCE at a time."""
    held, n = [], 0
    for batch in batches:
        for b in slices(batch, 1, TEXT_BYTES):
            h, follows = _words(b)[:2]
            held.append((h, follows))
            n += len(h)
            if n >= AT_ONCE:
                yield [np.concatenate(x) for x in zip(*held)]
                held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held)]
    release()


def _pairs(h: np.ndarray, follows: np.ndarray, frequent: np.ndarray):
    """(places whose word and next word may both be frequent, keys of these pairs)."""
    ok = probe(frequent, h)
    at = np.flatnonzero(follows & ok & np.concatenate([ok[1:], [False]]))
    return at, mix(h[at] * _MULTIPLY + (h[at + 1] ^ (h[at + 1] >> np.uint64(32))))


def _count_pairs(frequent):
    def run(batches):
        for h, follows in _runs(batches):
            keys, n = np.unique(_pairs(h, follows, frequent)[1], return_counts=True)
            for i in range(0, len(keys), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + ROWS].view(np.int64)), pa.array(n[i : i + ROWS])], ["key", "n"])

    return run


def _columns(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


def _pointers(frequent, prefixes, longest: int):
    """Map: occurrences of frequent prefixes and what follows, 0 from where it ends, with the number of equal ones."""

    def run(batches):
        for h, follows in _runs(batches):
            at, keys = _pairs(h, follows, frequent)
            at = at[probe(prefixes, keys)]
            if not len(at):
                continue
            goes = np.zeros(len(h) + longest, bool)
            goes[at] = True
            words, code = np.unique(h, return_inverse=True)
            code = np.concatenate([code + 1, np.zeros(longest, np.int64)])
            w, alive = [code[at], code[at + 1]], np.ones(len(at), bool)
            for i in range(2, longest):
                alive = alive & goes[at + i - 1]
                w.append(np.where(alive, code[at + i], 0))
            order = np.lexsort(w[::-1])
            w = np.stack([x[order] for x in w])
            new = np.flatnonzero(np.concatenate([[True], (w[:, 1:] != w[:, :-1]).any(axis=0)]))
            n, w = np.diff(new, append=len(order)), w[:, new]
            words = np.concatenate([np.zeros(1, np.uint64), words]).view(np.int64)
            for i in range(0, len(n), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(words[x[i : i + ROWS]]) for x in w] + [pa.array(n[i : i + ROWS])], [*_columns(longest), "n"])

    return run


def _grow(longest: int, least: int):
    """Map: pointers of a range, in order, to the phrases that are frequent or lie at an end of the range."""

    def run(batches):
        open_: dict = {}  # length: (phrase, count, whether it began the range) still growing

        def extend(w, n, length, out):
            """Phrases of this length among the pointers of frequent prefixes, then their extensions."""
            here = w[:, length - 1] != 0
            w, n = w[here], n[here]
            if not len(n):
                return
            new = np.flatnonzero(np.concatenate([[True], (w[1:, :length] != w[:-1, :length]).any(axis=1)]))
            total = np.add.reduceat(n, new)
            edge = np.zeros(len(new), bool)
            edge[0] = edge[-1] = True
            # the first may go on from the batch before, the last into the next
            if length in open_:
                phrase, count, began = open_.pop(length)
                if (w[0, :length] == phrase).all():
                    total[0] += count
                    edge_first = began
                else:
                    edge_first = False
                    if count >= least or began:
                        out.append((length, phrase[None, :], np.array([count])))
            else:
                edge_first = True
            open_[length] = (w[-1, :length].copy(), total[-1], edge_first if len(new) == 1 else False)
            done = (total >= least) | (edge & (np.arange(len(new)) == 0) & edge_first)
            done[-1] = False
            if done.any():
                out.append((length, w[new[done], :length], total[done]))
            if length < longest:
                alive = np.repeat((total >= least) | edge, np.diff(new, append=len(n)))
                extend(w[alive], n[alive], length + 1, out)

        def emit(out):
            for length, phrases, counts in out:
                full = np.zeros((len(counts), longest), np.int64)
                full[:, :length] = phrases
                yield pa.RecordBatch.from_arrays([pa.array(full[:, i]) for i in range(longest)] + [pa.array(counts)], [*_columns(longest), "n"])

        def gathered():
            held, rows = [], 0
            for b in batches:
                held.append(b)
                rows += len(b)
                if rows >= ROWS:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
            if rows:
                yield pa.Table.from_batches(held)

        for t in gathered():
            w = np.stack([np.asarray(t.column(c)) for c in _columns(longest)], axis=1)
            out: list = []
            extend(w, np.asarray(t.column("n")).copy(), 2, out)
            yield from emit(out)
        yield from emit([(length, p[None, :], np.array([c])) for length, (p, c, _) in open_.items()])

    return run


def _counts(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: words (h, lang, word, n), and phrases (w1... with 0 at the end, f) of at least `least` occurrences."""
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    words = source.mapInArrow(_count_words, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    frequent = bitmap(words.where(F.col("n") >= least), "h")
    pairs = source.mapInArrow(_count_pairs(frequent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    pairs = materialize(pairs, "pairs")
    prefixes = bitmap(pairs, "key")
    discard(pairs)
    w = _columns(longest)
    shape = ", ".join(f"{x} long" for x in w) + ", n long"
    pointers = source.mapInArrow(_pointers(frequent, prefixes, longest), shape).sort(*w)
    grown = pointers.mapInArrow(_grow(longest, least), shape).groupBy(*w).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return words, materialize(grown, "phrases")


def _length(w: list[str]):
    return sum((F.when(F.col(x) != 0, 1).otherwise(0) for x in w), F.lit(0))


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, absorb: int = 80, salts: int = 32) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    if longest < 2 or least < 1:
        raise ValueError("needs longest >= 2 and least >= 1")
    words, stored = _counts(docs, longest, least)
    w, inner = _columns(longest), _columns(longest - 1)
    phrases = stored.withColumn("size", _length(w))
    common = words.where(F.col("n") >= least)
    line = F.array(*w, *[F.lit(0).cast("long")] * longest)
    part = lambda begin, size: [F.when(F.lit(i) < size, F.element_at(line, begin + i + 1)).otherwise(F.lit(0).cast("long")).alias(x) for i, x in enumerate(inner)]
    parts = phrases.where(F.col("size") < longest).select(*inner, "f").union(common.select("h", *[F.lit(0).cast("long")] * (longest - 2), F.col("n")))
    # every cut, with the counts of its two parts
    cuts = phrases.select(*w, "f", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(*w, "f", "k", F.struct(*part(F.lit(0), F.col("k"))).alias("left"), F.struct(*part(F.col("k"), F.col("size") - F.col("k"))).alias("right"))
    for side in ("left", "right"):
        own = parts.select(F.struct(*inner).alias(side), F.col("f").alias(side + "_n"))
        cuts = cuts.join(own, side).drop(side)
    score = F.expr("cast((cast(f as decimal(20, 0)) * 2000000) div (cast(left_n as decimal(20, 0)) + right_n) as long)")
    scored = cuts.groupBy(*w, "f").agg(F.min(F.struct(score.alias("score"), "k", F.col("left_n").alias("l"), F.col("right_n").alias("r"))).alias("cut")).select(*w, "f", "cut.*").drop("k")
    if longest > 2:
        spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), i -> struct(i as i, m as m))))")
        within = phrases.where("size > 2").select(*w, "f", F.explode(spans).alias("s")).select(*part(F.col("s.i"), F.col("s.m")), "f").groupBy(*inner).agg(F.max("f").alias("longer"))
        last = w[-1]
        scored = scored.join(within.withColumn(last, F.lit(0).cast("long")), w, "left")
        taken = F.lit(100).cast("decimal(20, 0)") * F.col("longer") >= F.lit(absorb) * F.col("f").cast("decimal(20, 0)")
        scored = scored.where(~F.coalesce(taken, F.lit(False))).drop("longer")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    scored = scored.join(common.select(F.col("h").alias("w1"), "lang"), "w1").join(totals.withColumnRenamed("total", "n_words"), "lang")
    # the first of each salted part of a language, all ties kept, before strings are fetched
    order = [F.col("score").desc(), F.col("f").desc()]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64(*w), F.lit(salts)))
    some = salted.withColumn("at", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top).drop("at", "salt")
    key = [*w, "lang", "f", "l", "r", "n_words", "score"]
    spelled = some.select(*key, F.posexplode(F.array(*w)).alias("pos", "h")).where("h <> 0").join(common.select("h", "word"), "h")
    spelled = spelled.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("spelled"))
    spelled = spelled.withColumn("phrase", F.array_join(F.transform("spelled", lambda x: x["word"]), " "))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    out = ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", F.col("n_words").alias("n"), "score")
    out = materialize(out, "collocations")
    discard(words), discard(stored)
    return out


def phrase_counts(docs: DataFrame, longest: int = 4, least: int = 30) -> DataFrame:
    """lang, phrase, f: all phrases of 2 to `longest` words with at least `least` occurrences."""
    words, phrases = _counts(docs, longest, least)
    w = _columns(longest)
    spelled = phrases.select(*w, "f", F.posexplode(F.array(*w)).alias("pos", "h")).where("h <> 0").join(words.select("h", "lang", "word"), "h")
    got = spelled.groupBy(*w, "f", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("spelled"))
    out = materialize(got.select("lang", F.array_join(F.transform("spelled", lambda x: x["word"]), " ").alias("phrase"), "f"), "phrase-counts")
    discard(words), discard(phrases)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, w[i : i + m - 1] AS g, count(*) AS f FROM i, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w) GROUP BY 1, 2 HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY 1), c AS (SELECT * FROM g WHERE len(g) > 1),
k AS (SELECT c.lang, c.g, c.f, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score FROM (SELECT *, unnest(generate_series(1, len(g) - 1)) AS k FROM c) c JOIN g x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1 :]),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
s AS (SELECT lang, g[i : i + m - 1] AS g, max(f) AS longer FROM (SELECT *, unnest(generate_series(1, len(g) - m + 1)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < len(g)) GROUP BY 1, 2),
o AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN s USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000"""
