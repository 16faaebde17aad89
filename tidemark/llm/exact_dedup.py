"""Exact dedup over content-defined chunk recipes.

Each text, without the white space [\\x20\\x09-\\x0D], is cut where a rolling hash of its last 16 bytes
hits a mask (512 to 8192 bytes a chunk, 2048 on average). A chunk's identifier is its 128-bit hash,
and a separate pass compares the bytes of all chunks with one hash; should two differ, the identifiers
of that hash get the rank of the bytes appended. A document's recipe is the list of its identifiers in
order, and documents are equal when their recipes are.

Scale: long documents never move: a chunk's bytes move once at most and only once for all copies that
a task holds (the verification's partial distinct), and everything else works on recipes of 16 bytes
per 2 KB of text. Groups are a grouped aggregate with map-side combining, joined back on the recipe's
identifier; the winners' table has one row a group with two rows or more, and adaptive execution splits
the rows of a hot group.

Edge cases: null text counts as empty, and all texts without other characters than white space are one
group; null doc_id loses ties against any other; rows that repeat a doc_id and text are one document
(each carries the same decision; deduplicate() keeps one of them), rows that repeat a doc_id, null
included, over different texts are not; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import release
from .common import SPACE, discard, keep_rows, materialize, row_keys

LEAST, MOST, MASK = 512, 8192, np.uint64((2048 - 1) << 40)
_SPACE_BYTES = SPACE.encode()
_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, dtype=np.uint64)


def cuts(data: bytes) -> list[int]:
    """End offsets of the chunks of data; they depend on data alone."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # window of 16 bytes by doubling
        h[k:] += h[:-k] << np.uint64(k)
    ends, last = [], 0
    for at in (np.flatnonzero((h & MASK) == 0) + 1).tolist() + [n]:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST and at < n:
            ends.append(at)
            last = at
    if not ends or ends[-1] < n:
        ends.append(n)
    return ends


def _hash(chunk: bytes, bits: int) -> bytes:
    h = xxhash.xxh3_128_digest(chunk)
    return h if bits == 128 else (int.from_bytes(h, "big") & ((1 << bits) - 1)).to_bytes(16, "big")


def _chunks(text: str | None):
    data = (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACE_BYTES)
    last, out = 0, []
    for end in cuts(data):
        out.append(data[last:end])
        last = end
    return data, out


def _recipes(bits: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(0, len(b), 512):
                rows = [(len(t or ""), *_chunks(t)) for t in texts[i : i + 512].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids[i : i + 512], pa.array([r[0] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[1]).digest() for r in rows], pa.binary()), pa.array([b"".join(_hash(c, bits) for c in r[2]) for r in rows], pa.binary()), b.column(2)[i : i + 512], b.column(3)[i : i + 512]],
                    ["doc_id", "points", "sha", "recipe", "k1", "k2"],
                )
            release()

    return run


def _bodies(bits: int):
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 512):
                rows = {c for t in b.column(1)[i : i + 512].to_pylist() for c in _chunks(t)[1]}
                rows = [(_hash(c, bits), c) for c in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["h", "body"])
            release()

    return run


def _ranked(bits: int, clashing: dict[bytes, list[bytes]]):
    """Recipes whose clashing identifiers carry the rank of the chunk's bytes."""

    def run(batches):
        rank = {h: {x: i for i, x in enumerate(sorted(v))} for h, v in clashing.items()}
        for b in batches:
            for i in range(0, len(b), 512):
                out = [b"".join((h := _hash(c, bits)) + (rank[h][hashlib.sha256(c).digest()].to_bytes(8, "big") if h in rank else b"") for c in _chunks(t)[1]) for t in b.column(1)[i : i + 512].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 512], pa.array(out, pa.binary())], ["doc_id", "recipe"])

    return run


_ROWS = "doc_id long, points long, sha binary, recipe binary, k1 long, k2 long"


def recipes(docs: DataFrame, bits: int = 128) -> DataFrame:
    """doc_id, points (code points of the original text), sha, recipe of verified identifiers, and k1, k2, which
    tell ids and texts apart.

    bits narrows the chunk hash, for tests of the clash path. Clashes are listed by digests of the
    differing chunks; with 128 bits the list is empty, and its size is checked before it is sent.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_keys(docs))
    out = texts.mapInArrow(_recipes(bits), _ROWS)
    bodies = texts.mapInArrow(_bodies(bits), "h binary, body binary").distinct()
    clash = materialize(bodies.groupBy("h").agg(F.count("*").alias("n"), F.collect_set(F.unhex(F.sha2("body", 256))).alias("bodies")).where("n > 1"), "clashes")
    listed = clash.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if listed > 1_000_000:
        raise ValueError("too many chunk hash clashes: widen the hash")
    full = {bytes(r.h): [bytes(x) for x in r.bodies] for r in clash.collect()} if listed else {}
    discard(clash)
    if not full:
        return out

    def both(batches):
        for b in batches:
            plain = pa.Table.from_batches(list(_recipes(bits)([b]))).combine_chunks()
            ranked = pa.Table.from_batches(list(_ranked(bits, full)([b])))
            yield from plain.set_column(3, "recipe", ranked["recipe"]).to_batches()

    return texts.mapInArrow(both, _ROWS)


def _first():
    """The least of a group stays: most code points, then the smallest id, null last."""
    return [(-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"]


def exact_groups(docs: DataFrame, bits: int = 128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; see the module text."""
    rows = materialize(recipes(docs, bits), "recipes")
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(F.struct(*_first())).alias("best")).where("group_size > 1")
    groups = groups.select(F.col("recipe").alias("_r"), "group_size", F.col("best.doc_id").alias("best_id"))
    groups = materialize(groups, "recipe-groups")  # both sides of the join are then plain exchanges, whose hot partitions are split
    got = rows.join(groups, F.col("recipe") == F.col("_r"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return got.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each group, the one that exact_groups keeps.

    Ids may be null or repeated: rows go by a hash of id and text, and of rows alike in both one stays.
    Texts move only where a bitmap of the rows that go can't tell that they stay.
    """
    rows = materialize(recipes(docs).select("points", "doc_id", "recipe", "k1", "k2"), "recipes")
    best = rows.groupBy("recipe").agg(F.count("*").alias("n"), F.min(F.struct(*_first(), "k1", "k2")).alias("o")).where("n > 1")
    out = keep_rows(docs, rows, best.select("recipe", F.col("o.k1").alias("k1"), F.col("o.k2").alias("k2")), "recipe")
    discard(rows)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
