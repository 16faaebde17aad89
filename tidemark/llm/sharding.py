"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts form one indivisible group. Groups, largest first, enter the bin with the
tightest remaining capacity that still holds them, found in a balanced tree, and the smallest capacity
for which the bins suffice is searched. Groups of one size are alike, so they enter in runs: the tightest
bin stays the tightest until it can't hold one more, which gives the bins that one by one would give.

Scale: group sizes are summed with map-side combining. What is collected is a count by size, whose top 12
bits count: sizes under 4096 are told apart, larger ones to 1 in 2048 (a class is packed by its mean size),
so there are at most 2048 rows a doubling of the size, some 70,000 at any corpus size; groups larger than
total / (shards * 64), of which there are at most shards * 64, are listed one by one. Groups are then
numbered within their class in two levels, find their bin by the plan's rank ranges, and are joined to
their rows; adaptive execution splits the rows of a hot group. A group that exceeds an even share gets a
bin by itself and the others are balanced over the rest.

Edge cases: null text has no bytes (size 16) and is a group with no other row but those of its doc_id (null
ids: one group); empty text is a text like others; repeated rows count each; ties in size go by the text's
hash; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, number_rows


class _Node:
    __slots__ = ("key", "left", "right", "level")

    def __init__(self, key):
        self.key, self.left, self.right, self.level = key, None, None, 1


class BinTree:
    """AA tree of (remaining capacity, bin); finds the smallest remaining capacity >= a size."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            top = n.left
            n.left, top.right = top.right, n
            return top
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.level == n.right.right.level:
            top = n.right
            n.right, top.left = top.left, n
            top.level += 1
            return top
        return n

    def insert(self, key):
        def go(n):
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = go(n.left)
            else:
                n.right = go(n.right)
            return self._split(self._skew(n))

        self.root = go(self.root)

    def remove(self, key):
        def go(n, key):
            if n is None:
                return None
            if key < n.key:
                n.left = go(n.left, key)
            elif key > n.key:
                n.right = go(n.right, key)
            elif n.left is None and n.right is None:
                return None
            elif n.left is None:
                s = n.right
                while s.left:
                    s = s.left
                n.key, n.right = s.key, go(n.right, s.key)
            else:
                s = n.left
                while s.right:
                    s = s.right
                n.key, n.left = s.key, go(n.left, s.key)
            low = min(n.left.level if n.left else 0, n.right.level if n.right else 0) + 1
            if low < n.level:
                n.level = low
                if n.right and low < n.right.level:
                    n.right.level = low
            n = self._skew(n)
            n.right = self._skew(n.right)
            if n.right:
                n.right.right = self._skew(n.right.right)
            n = self._split(n)
            n.right = self._split(n.right)
            return n

        self.root = go(self.root, key)

    def tightest(self, size):
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(sizes: list[tuple[float, int]], capacity: float) -> list[list[tuple[int, int]]]:
    """For each (size, count): runs of (bin, how many), bins opened as needed. Sizes above capacity raise."""
    tree, out, bins = BinTree(), [[] for _ in sizes], 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], i)):
        size, left = sizes[i]
        if size > capacity:
            raise ValueError("a group exceeds the capacity")
        while left:
            best = tree.tightest(size)
            if best is None:
                best = (capacity, bins)
                bins += 1
            else:
                tree.remove(best)
            n = min(left, int(best[0] // size))
            out[i].append((best[1], n))
            left -= n
            tree.insert((best[0] - size * n, best[1]))
    return out


def pack_units(sizes: list[tuple[float, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Runs of (shard, how many) of each (size, count): oversized ones alone, the rest by best-fit-decreasing at
    about the least capacity that fits (to 1 in 100,000)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], i))
    out, first, at, total = [[] for _ in sizes], 0, 0, sum(s * n for s, n in sizes)
    rest = {i: n for i, (_, n) in enumerate(sizes)}
    while at < len(order) and shards - first > 1:
        i = order[at]
        if not rest[i]:
            at += 1
        elif sizes[i][0] * (shards - first) > total and sum(rest[j] for j in order[at : at + 2]) > 1:
            out[i].append((first, 1))
            rest[i] -= 1
            total -= sizes[i][0]
            first += 1
        else:
            break
    kept = [i for i in order if rest[i]]
    if not kept:
        return out
    got, bins = [(sizes[i][0], rest[i]) for i in kept], shards - first
    even = total / bins
    low, high, best = max(got[0][0], even), got[0][0] + 2 * even, None
    while best is None or high - low > even / 100_000:
        plan = best_fit_decreasing(got, mid := high if best is None else (low + high) / 2)
        if max(b for runs in plan for b, _ in runs) < bins:
            best, high = plan, mid
        elif best is None:
            low, high = high, 2 * high
        else:
            low = mid
    for i, runs in zip(kept, best):
        out[i] += [(first + b, n) for b, n in runs]
    return out


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; see the module text."""
    spark = docs.sparkSession
    raw = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNull(), F.sha2(F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"), 256)).otherwise(F.sha2(raw, 256)).alias("_hex"),
    ).select("doc_id", "size", "text_crc32", F.unhex("_hex").alias("digest"))
    rows = materialize(rows, "shard-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # a class: 0 for the groups that are listed, else the size without the bits after its top 12
    drop = F.greatest(F.lit(0), F.floor(F.log2(F.col("bytes").cast("double"))).cast("int") - 11)
    kind = F.when(F.col("bytes") * (shards * 64) > total, F.lit(0)).otherwise(F.expr("shiftleft(shiftright(bytes, _drop), _drop)")).cast("long")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("_drop", drop).withColumn("kind", kind).select("digest", "bytes", "kind")
    groups = materialize(groups, "shard-groups")
    big = [(bytes(r.digest), r.bytes) for r in groups.where("kind = 0").orderBy("digest").collect()]  # at most shards * 64
    few = groups.where("kind > 0").groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy("kind").collect()
    plan = pack_units([(float(b), 1) for _, b in big] + [(r["bytes"] / r["n"], r["n"]) for r in few], shards) if n else []
    of_big = spark.createDataFrame([(d, runs[0][0]) for (d, _), runs in zip(big, plan)] or [(b"", 0)], "digest binary, s_big int")
    ranges = []
    for r, runs in zip(few, plan[len(big) :]):
        at = 0
        for shard, k in runs:
            ranges.append((r["kind"], at, at + k, shard))
            at += k
    of_few = spark.createDataFrame(ranges or [(-1, 0, 0, 0)], "_kind long, lo long, hi long, shard int")
    if len(ranges) <= 500_000:  # some 20 MB
        of_few = F.broadcast(of_few)
    ranked = number_rows(groups.where("kind > 0"), ["kind"], ["digest"], sum(r["n"] for r in few), "rank")
    small = ranked.join(of_few, (F.col("kind") == F.col("_kind")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("digest", "shard")
    large = groups.where("kind = 0").select("digest").join(F.broadcast(of_big), "digest").select("digest", F.col("s_big").alias("shard"))
    placed = materialize(small.union(large), "shard-places")
    discard(groups)
    return number_rows(rows.join(placed, "digest"), ["shard"], ["doc_id", "digest"], n, "slot").drop("digest")


def query(spark, sf_dir: str) -> DataFrame:
    got = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
