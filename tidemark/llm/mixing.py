"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target is its share of all words by weight, stopped at `most` times its size, the excess
reshared by weight. Within a source, a document's expected copies are c * m, stopped at `most`, where
m = min(1, (1 + log2 class of its size) / 8), so that scraps of a few words are included less often,
and c meets the target. Whole copies (the integer part) are certain. The rest is a Pareto order
sample: with inclusion probability p (the fraction left) and a uniform number u from a seeded hash of
doc_id, documents are ranked by (u / (1 - u)) / (p / (1 - p)), and taken in that order while the
next whole document brings the source's words closer to its target: a sample of fixed size in words.

Scale: documents are read once, into a narrow table. Ranks are never sorted per source: a rank is a
number of 60 bits, and level by level its next 3 bits deal a source's documents into 8 buckets, whose
running sums find the one in which the sample ends, until that one holds at most `bucket_rows`; only it
is walked in order. So neither a hot source nor crowded ranks reach one task. Tables by source or class
are small (a row a source, eight a source) and joined with hints left to the planner.

Edge cases: null or wordless text has size 0 and takes 0; null source is a source, last in order; rows
alike in doc_id, source and size share one fate (null doc_id: as one id); ties in rank go by doc_id and
size; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize

WEIGHTS = (1.0, 2.0, 3.0)


def _targets(sizes: DataFrame, weights, share: float, most: float) -> DataFrame:
    """sizes: source, source_size, n. Adds target, by water-filling: sources stop in order of most * size / weight."""
    w = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_k") - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("_cap") / F.col("weight"), "_k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("_left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(up), F.lit(0.0)))
    w = w.withColumn("_w", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    w = w.withColumn("_level", F.when(F.col("_left") * F.col("weight") <= F.col("_cap") * F.col("_w"), F.col("_left") / F.col("_w")))
    w = w.withColumn("_level", F.max("_level").over(every))
    return w.select("source", "source_size", "n", F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))).alias("target"))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 7, bucket_rows: int = 1024):
    """(the narrow rows of docs, sources with their targets, and what adds `copies` to rows of doc_id, source, size)."""
    base = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size")), "mix-sizes")
    kind = F.when(F.col("size") < 1, 0).otherwise(F.least(F.lit(8), F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))) + 1)).cast("int")
    narrow, base = base, base.withColumn("kind", kind)
    kinds = base.groupBy("source", "kind").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = _targets(kinds.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), weights, share, most)
    # expected copies by class: c * m stopped at most; classes stop from the largest m down
    own = Window.partitionBy("_s")
    down = own.orderBy(F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    k = kinds.where("kind > 0").drop("n").withColumnRenamed("source", "_s").withColumn("m", F.col("kind") / 8.0)
    k = k.join(sources, F.col("_s").eqNullSafe(F.col("source")))
    stopped = F.coalesce(F.sum(F.col("words") * F.lit(float(most))).over(down), F.lit(0.0))
    free = F.sum(F.col("words") * F.col("m")).over(own) - F.coalesce(F.sum(F.col("words") * F.col("m")).over(down), F.lit(0.0))
    k = k.withColumn("_c", F.when(free > 0, (F.col("target") - stopped) / free))
    k = k.withColumn("_c", F.max(F.when(F.col("_c") * F.col("m") <= most, F.col("_c"))).over(own))
    k = k.withColumn("want", F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(F.col("_c") * F.col("m"), F.lit(float(most))))))
    k = k.withColumn("want", F.when(F.abs(F.col("want") - F.round("want")) < 1e-9, F.round("want")).otherwise(F.col("want")))
    k = k.withColumn("whole", F.floor("want").cast("int")).withColumn("p", F.col("want") - F.col("whole"))
    k = k.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own)))
    k = k.withColumn("odds", F.col("p") / (1 - F.col("p"))).withColumn("odds_max", F.max("odds").over(own))
    k = materialize(k.select("_s", F.col("kind").alias("_kind"), "source_size", "target", "whole", "odds", "odds_max", "rest"), "mix-classes")
    # rank key: odds of u over odds of p, scaled by the source's largest odds, mapped to (0, 1)
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    d = base.join(k, F.col("source").eqNullSafe(F.col("_s")) & (F.col("kind") == F.col("_kind")), "left")
    q = (u / (1 - u)) / (F.col("odds") / F.col("odds_max"))
    rank, k_rows = F.floor(q / (1 + q) * float(1 << 60)).cast("long"), k.count()
    d = d.withColumn("q", F.when(F.col("odds") > 0, rank))
    d = materialize(d.select("doc_id", "source", "size", "_s", "whole", "rest", "q"), "mix-ranks")
    open_ = d.where("q IS NOT NULL")
    at = F.expr("shiftright(q, below)")
    cut = open_.groupBy("_s").agg(F.sum("size").alias("words"), F.max("rest").alias("room"), F.count("*").alias("n")).where("words > room")
    cut = materialize(cut.select(F.col("_s").alias("_cs"), F.lit(0).cast("long").alias("cut"), F.lit(60).alias("below"), "room", "n"), "mix-cuts")
    while not cut.where((F.col("n") > bucket_rows) & (F.col("below") > 0)).isEmpty():
        wide = (F.col("n") > bucket_rows) & (F.col("below") > 0)
        here = open_.join(cut.where(wide), F.col("_s").eqNullSafe(F.col("_cs")) & (at == F.col("cut")))
        sums = here.groupBy("_s", (F.col("below") - 3).alias("below"), F.expr("shiftright(q, below - 3)").alias("b")).agg(F.sum("size").alias("words"), F.max("room").alias("room"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("_s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", before).where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("words") > F.col("room")))
        finer = sums.select(F.col("_s").alias("_cs"), F.col("b").alias("cut"), "below", (F.col("room") - F.col("before")).alias("room"), "n")
        old, cut = cut, materialize(cut.where(~wide).union(finer), "mix-cuts")
        discard(old)
    ends = cut.select("_cs", "cut", "below", "room")
    # walk the cut bucket in rank order: take a document when that brings the words closer to the target
    units = open_.join(ends, F.col("_s").eqNullSafe(F.col("_cs")) & (at == F.col("cut")))
    units = units.groupBy("_s", "room", "q", "doc_id", "size").agg((F.count("*") * F.col("size")).alias("words"))
    walk = units.groupBy("_s", "room").agg(F.sort_array(F.collect_list(F.struct("q", "doc_id", "size", "words"))).alias("x"))
    start = F.struct(F.col("room").cast("double").alias("room"), F.expr("cast(array() as array<struct<doc_id:bigint,size:bigint>>)").alias("got"))

    def step(acc, x):
        fits = x["words"] < 2 * acc["room"]
        return F.struct(F.when(fits, acc["room"] - x["words"]).otherwise(acc["room"]).alias("room"), F.when(fits, F.concat(acc["got"], F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"))))).otherwise(acc["got"]).alias("got"))

    taken = walk.select(F.col("_s").alias("_ts"), F.explode(F.aggregate("x", start, step)["got"]).alias("g")).select("_ts", F.col("g.doc_id").alias("_td"), F.col("g.size").alias("_tz"), F.lit(True).alias("hit"))
    taken = materialize(taken, "mix-taken")  # a cut bucket a source at most
    few = F.broadcast if taken.count() <= 200_000 and k_rows <= 200_000 else (lambda t: t)  # some 10 MB

    def placed(rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, size and others) with copies: whatever else they hold doesn't move while tables are few."""
        x = rows.withColumn("kind", kind).join(few(k), F.col("source").eqNullSafe(F.col("_s")) & (F.col("kind") == F.col("_kind")), "left")
        x = x.withColumn("q", F.when(F.col("odds") > 0, rank)).join(few(ends), F.col("_s").eqNullSafe(F.col("_cs")), "left")
        x = x.join(few(taken), F.col("_s").eqNullSafe(F.col("_ts")) & F.col("doc_id").eqNullSafe(F.col("_td")) & (F.col("size") == F.col("_tz")) & (at == F.col("cut")), "left")
        extra = F.when(F.col("q").isNull(), F.lit(0)).when(F.col("cut").isNull() | (at < F.col("cut")) | F.col("hit"), F.lit(1)).otherwise(F.lit(0))
        return x.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0)).cast("int"))

    return narrow, sources, placed


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row."""
    narrow, sources, placed = _plan(docs, **how)
    s = sources.select(F.col("source").alias("_ss"), F.col("source_size").alias("_sz"), F.col("target").alias("_tg"))
    d = placed(narrow).join(s, F.col("source").eqNullSafe(F.col("_ss")))
    return d.select("doc_id", "source", "size", F.col("_sz").cast("long").alias("source_size"), F.col("_tg").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns. Rows alike in doc_id, source
    and size (null ids too) have one number of copies; others that share an id have their own."""
    _, _, placed = _plan(docs, **how)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), _size().alias("size"))
    got = placed(rows).where("copies > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
