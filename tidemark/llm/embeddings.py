"""Embedding near-dedup by sorted projection passes.

Each pass draws 64 random hyperplanes; a vector's key is its 64 signs, read as one number. Vectors are
ordered by key over all partitions, every vector is compared with its next `window` neighbours, pairs
that reach the cosine in double precision are kept, and links of all passes are united into components.

An exact count follows. In each component, vectors within half the linking angle of the component's
centre are all linked with each other (by the triangle inequality), so their links are a sum; each
vector outside that ball is compared with all vectors of its component, in blocks of about 1024.

Recall of connection: a pair at angle t shares a key prefix of length k with probability (1 - t/pi)**k,
and meets in a pass if that prefix narrows the order to about the window, k = log2(vectors / window). The
number of passes is the least for which a pair exactly at the limit, without any other link, is met with
probability `recall` (so it grows as a power of about 0.22 of the vectors: 12 passes for 10,000, 16 for
50,000, 27 for a million, 120 for a billion); closer pairs are met more surely. Within a component no link is lost.

Scale: equal vectors are one node, with a count. The order is a range partition by (pass, key, hash of
the node), so a run of equal keys can be split; the vectors around each partition boundary (2 * window)
are compared in a step of their own. Pairs per node are bounded by passes * window.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths do not link; null vec_id: the row takes part, its component is the least
known id of its component (its own null if there is none); repeated vec_ids are vectors of their own;
extra columns are not read.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

_BLOCK = 1024


def _unit(blobs) -> np.ndarray:
    x = np.stack([np.frombuffer(b, "<f8") for b in blobs])
    return x


def _valid(batches):
    """(vec_id, v): v the unit vector as bytes, null for those that link with nothing."""
    for b in batches:
        out = []
        for x in b.column(1):
            x = x.as_py()
            v = None
            if x and None not in x:
                a = np.array(x, np.float64)
                top = np.abs(a).max()
                if np.isfinite(a).all() and top > 0:
                    a = a / top
                    v = (a / np.sqrt(a @ a)).astype("<f8").tobytes()
            out.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def _planes(passes: int, dims: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, passes * 64))


def _keys(passes: int, seed: int):
    def run(batches):
        planes = {}
        for b in batches:
            for at in range(0, len(b), 2048):
                rows = b.slice(at, 2048)
                blobs = rows.column(1).to_pylist()
                sizes = np.array([len(x) // 8 for x in blobs])
                for dims in np.unique(sizes).tolist():
                    pick = np.flatnonzero(sizes == dims)
                    if dims not in planes:
                        planes[dims] = _planes(passes, dims, seed)
                    signs = (_unit([blobs[i] for i in pick]) @ planes[dims] > 0).reshape(len(pick), passes, 64)
                    key = np.packbits(signs, axis=2).reshape(len(pick), passes, 8)
                    some = rows.take(pa.array(pick))
                    for p in range(passes):
                        # the length leads the key: only vectors of one length are neighbours
                        k = [dims.to_bytes(4, "big") + x.tobytes() for x in np.ascontiguousarray(key[:, p])]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), p), pa.int32()), pa.array(k, pa.binary()), some.column(0), some.column(1)], ["pass", "key", "node", "v"])

    return run


def _pairs(passes, nodes, x, window, least, first=0):
    """Pairs (i, j), i < j <= i + window, j >= first, of one pass and length, with cosine >= least."""
    a, b = [], []
    for k in range(1, min(window, len(nodes) - 1) + 1):
        i = np.arange(max(0, first - k), len(nodes) - k)
        hit = (np.einsum("ij,ij->i", x[i], x[i + k]) >= least) & (passes[i] == passes[i + k]) & (nodes[i] != nodes[i + k])
        a.append(nodes[i[hit]]), b.append(nodes[i[hit] + k])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int32()), ("seq", pa.int32()), ("pass", pa.int32()), ("v", pa.binary())])


def _row(pairs):
    n = len(pairs[0])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(*pairs)), pa.array(np.maximum(*pairs)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_OUT)


def _edge(edge, seq, passes, nodes, blobs):
    n = len(nodes)
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(n, pa.int64()), pa.array(np.full(n, edge), pa.int32()), pa.array(seq, pa.int32()), pa.array(passes, pa.int32()), pa.array(blobs, pa.binary())], schema=_OUT)


def _by_length(passes, nodes, blobs, window, least, first=0):
    sizes = np.array([len(b) for b in blobs])
    got = [_pairs(passes[s:e], nodes[s:e], _unit(blobs[s:e]), window, least, max(0, first - s)) for s, e in _runs(sizes)]
    return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.zeros(0, np.int64),) * 2


def _runs(sizes):
    cut = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    return [(s, e) for s, e in zip(cut[:-1], cut[1:]) if e > s]


def _windows(window: int, least: float):
    def run(batches):
        part = TaskContext.get().partitionId()
        passes, nodes, blobs, head = np.zeros(0, np.int32), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for at in range(0, len(batch), 4096):
                b = batch.slice(at, 4096)
                p, n, v = np.asarray(b.column(0)), np.asarray(b.column(2)), b.column(3).to_pylist()
                if head < window:
                    k = min(window - head, len(n))
                    yield _edge(part, np.arange(k) + window + head, p[:k], n[:k], v[:k])  # the first of this partition end the boundary before it
                    head += k
                first = len(nodes)
                passes, nodes, blobs = np.concatenate([passes, p]), np.concatenate([nodes, n]), blobs + v
                yield _row(_by_length(passes, nodes, blobs, window, least, first))
                passes, nodes, blobs = passes[-window:], nodes[-window:], blobs[-window:]
        if len(nodes):
            yield _edge(part + 1, np.arange(len(nodes)), passes, nodes, blobs)

    return run


def _boundaries(window: int, least: float):
    def run(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups)).sort_by("seq")
        seq = np.asarray(t["seq"])
        pairs = _by_length(np.asarray(t["pass"]), np.asarray(t["a"]), t["v"].to_pylist(), window, least, int(np.searchsorted(seq, window)))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*pairs)), pa.array(np.maximum(*pairs))], ["a", "b"])

    return run


def _centre_parts(batches):
    for b in batches:
        c, sizes = np.asarray(b.column(0)), np.asarray(b.column(2))
        v = b.column(1).to_pylist()
        order = np.argsort(c, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(c[order]) != 0])).tolist() + [len(c)] if len(c) else [0]
        rows = [(int(c[order[s]]), (sizes[order[s:e]].astype(float) @ _unit([v[i] for i in order[s:e]])).tobytes()) for s, e in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["root", "part"])


def _centre(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(_unit(b.column("part").to_pylist()).sum(axis=0) for b in groups)
    n = np.sqrt(total @ total)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([(total / (n or 1)).tobytes()], pa.binary())], ["croot", "centre"])


def _in_ball(least: float):
    reach = math.cos(math.acos(least) / 2) + 1e-9

    def run(batches):
        for b in batches:
            cos = np.einsum("ij,ij->i", _unit(b.column(2).to_pylist()), _unit(b.column(4).to_pylist())) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(cos >= reach)], ["root", "node", "v", "n", "ball"])

    return run


def _blob(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(groups))
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()]), pa.array([np.asarray(t["node"]).tobytes()]), pa.array([b"".join(t["v"].to_pylist())]), pa.array([np.asarray(t["n"]).tobytes()]), pa.array([np.asarray(t["ball"]).astype(np.uint8).tobytes()])],
        ["root", "nodes", "vs", "ns", "balls"],
    )


def _blocks(least: float):
    """(node, add) of each pair of an outside block and a block of all: links of the outside vectors, and of ball vectors with them."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                o, m = np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["m_nodes"], np.int64)
                x, y = np.frombuffer(r["vs"]).reshape(len(o), -1), np.frombuffer(r["m_vs"]).reshape(len(m), -1)
                hit = (x @ y.T >= least) | (o[:, None] == m[None, :])
                out = hit @ np.frombuffer(r["m_ns"], np.int64)
                ball = np.frombuffer(r["m_balls"], np.uint8) == 1
                back = np.frombuffer(r["ns"], np.int64) @ hit[:, ball]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o, m[ball]])), pa.array(np.concatenate([out, back]).astype(np.int64))], ["node", "add"])

    return run


def passes_for(count: int, least: float, window: int, recall: float) -> int:
    """Passes after which a pair at the limit has met with probability recall; see the module text."""
    k = max(0.0, math.log2(max(1, count) / window))
    once = (1 - math.acos(least) / math.pi) ** k
    return 4 if once > 0.999 else max(4, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 0.96, window: int = 24, seed: int = 4, passes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. passes: a number of one's own."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = materialize(rows.mapInArrow(_valid, "vec_id long, v binary"), "vectors")
    for salt in range(8):  # a node's number is a hash of its vector; should two vectors share one, another hash is taken
        rows = units.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(salt), "v")))
        nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("v").alias("v"), F.max("v").alias("w"), F.count("*").alias("n"), F.min("vec_id").alias("vec_id"))
        nodes = materialize(nodes, "vector-nodes")
        count, apart = nodes.agg(F.count("*"), F.coalesce(F.max((F.col("v") != F.col("w")).cast("int")), F.lit(0))).first()
        if not apart:
            break
    else:
        raise ValueError("no hash of 64 bits tells these vectors apart")
    nodes = nodes.drop("w")
    passes = passes or passes_for(count, least, window, recall)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count * passes / 50_000))
    keyed = nodes.select("node", "v").mapInArrow(_keys(passes, seed), "pass int, key binary, node long, v binary")
    keyed = keyed.repartitionByRange(parts, "pass", "key", F.hash("node")).sortWithinPartitions("pass", "key", F.hash("node"))
    found = materialize(keyed.mapInArrow(_windows(window, least), "a long, b long, edge int, seq int, pass int, v binary"), "windows")
    across = found.where("edge IS NOT NULL").groupBy("edge").applyInArrow(_boundaries(window, least), "a long, b long")
    links = materialize(found.where("edge IS NULL").select("a", "b").union(across).distinct(), "vector-links")
    # links counted exactly within components
    of = components(links, name="vector-components").withColumnRenamed("component", "root")
    members = materialize(nodes.join(of, "node").select("root", "node", "v", "n"), "vector-members")
    centre = members.select("root", "v", "n").mapInArrow(_centre_parts, "root long, part binary").groupBy("root").applyInArrow(_centre, "croot long, centre binary")
    centre = materialize(centre, "centres")
    members = members.join(centre, F.col("root") == F.col("croot")).select("root", "node", "v", "n", "centre")
    members = materialize(members.select("root", "node", "v", "n", "centre").mapInArrow(_in_ball(least), "root long, node long, v binary, n long, ball boolean"), "balls")
    per = materialize(members.groupBy("root").agg(F.sum(F.when(F.col("ball"), F.col("n"))).alias("in_ball"), F.sum(F.when(~F.col("ball"), 1)).alias("outside"), F.count("*").alias("size")), "ball-sums")
    open_ = members.join(per.where("outside > 0").select("root", "outside", "size"), "root")
    shape = "root long, nodes binary, vs binary, ns binary, balls binary"
    cols = ["node", "v", "n", "ball"]
    block = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / _BLOCK)).cast("int").alias("block")
    outside = open_.where("NOT ball").select("root", block("outside"), *cols).groupBy("root", "block").applyInArrow(_blob, shape)
    every = open_.select("root", block("size"), *cols).groupBy("root", "block").applyInArrow(_blob, shape)
    every = every.select("root", *[F.col(c).alias(f"m_{c}") for c in ("nodes", "vs", "ns", "balls")])
    # a pair of blocks is a task's unit of work: dealt out anew, so that one component spreads over tasks
    paired = materialize(outside, "outside-blocks").join(materialize(every, "member-blocks"), "root").repartition(parts, F.xxhash64("nodes", "m_nodes"))
    more = paired.mapInArrow(_blocks(least), "node long, add long").groupBy("node").agg(F.sum("add").alias("add"))
    counts = members.select("root", "node", "ball").join(per.select("root", "in_ball"), "root").join(more, "node", "left")
    counts = counts.select("node", "root", (F.coalesce(F.when(F.col("ball"), F.col("in_ball")), F.lit(0)) + F.coalesce("add", F.lit(0)) - 1).alias("links"))
    low = nodes.join(of, "node").groupBy("root").agg(F.min("vec_id").alias("low"))
    result = nodes.select("node", "n", "vec_id").join(counts, "node", "left").join(low, "root", "left")
    result = materialize(result.select("node", F.coalesce("links", F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component")), "vector-counts")
    got = rows.select("vec_id", "node").join(result, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
