"""Packing documents into token windows by minimum bin slack.

A document's ids, with an end id, are cut into full windows and one remainder. Remainders are packed
by their lengths only: the counts of each length form a multiset; the longest length left opens a
window, and a bitset subset-sum program over the other lengths (each in binary multiples of its count)
finds the multiset that fills the window closest to its capacity; backtracking gives the counts. A
filling is repeated as often as the counts last.

Scale: the histogram has at most `window` rows, and the plan at most a few thousand fillings, at any
corpus size; both are bounded by the window. Pieces are then numbered within their length in two
levels (one length may hold any share of the pieces) and find their window by a join with the plan's
rank ranges. Texts are tokenised once, into a table of one narrow row a piece.

Edge cases: null text counts as empty and is the end id alone; null doc_id and rows that repeat one
are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, gathered, tokenizer_path
from .common import materialize, number_rows


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (within counts) with the largest sum <= room, as {length: times}."""
    reach, layers = 1, []  # bit s: sum s can be reached
    full = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            layers.append((reach, length, times))
            reach |= (reach << (length * times)) & full
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for before, length, times in reversed(layers):
        if not before >> total & 1:
            total -= length * times
            out[length] = out.get(length, 0) + times
    return out


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(filling, how many windows of it), until every length is used up."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        got = fill({k: v for k, v in rest.items() if v and k <= window - first}, window - first)
        got[first] = got.get(first, 0) + 1
        times = min(left[k] // n for k, n in got.items())
        out.append((got, times))
        for k, n in got.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _pieces(path: str, end: int, window: int):
    def run(batches):
        enc = encoder(path)
        for b in gathered(batches, 1):
            ids, offsets = enc.encode(b.column(1), end)
            tokens = np.diff(offsets)
            n = -(-tokens // window)
            doc = np.repeat(np.arange(len(b)), n)
            start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, tokens[doc] - start)
            at = offsets[doc] + start
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[x : x + k]) for x, k in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack_documents(docs: DataFrame, window: int = 1024, end: int = 0, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = texts.mapInArrow(_pieces(path or tokenizer_path(), end, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(pieces, "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    rows, base, used = [], 0, dict.fromkeys(counts, 0)
    for filling, times in plan_windows(counts, window):
        offset = 0
        for length, n in sorted(filling.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times, n, base, offset))
            used[length] += n * times
            offset += n * length
        base += times
    plan = spark.createDataFrame(rows or [(-1, 0, 0, 1, 0, 0)], "l long, lo long, hi long, n long, base long, off long")
    ranked = number_rows(pieces, ["length"], ["doc_id", "start", "ids_crc32"], sum(counts.values()), "rank")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(k / F.col("n"))).cast("long").alias("sequence_id"),
        (F.col("off") + (k % F.col("n")) * F.col("length")).cast("long").alias("offset"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
