"""What the training-data operators share: shared-folder tables, row numbering, graph components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract here, as characters and as a word pattern.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one is set on a local master only."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(got)
    return got


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def number_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], rows: int, out: str, per_bucket: int = 50_000) -> DataFrame:
    """Number rows 0, 1, 2... without gaps within each key, in any fixed order.

    Two levels, so that one key may hold any share of the rows: rows are split into hash buckets of
    about per_bucket rows, each bucket is numbered by itself, and the running sum of bucket counts is
    added. `order` must tell rows apart (rows equal in it may swap numbers).
    """
    buckets = max(1, math.ceil(rows / per_bucket))
    d = df.withColumn("_b", F.pmod(F.xxhash64(F.lit(17), *order), F.lit(buckets)).cast("int"))
    key = list(key)
    sums = d.groupBy(*key, "_b").count().withColumn("_base", F.sum("count").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_b").alias("_kb"), F.coalesce("_base", F.lit(0)).alias("_base"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_b").orderBy(*order)))
    on = F.col("_b") == F.col("_kb")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(sums, on).withColumn(out, (F.col("_base") + F.col("_r") - 1).cast("long")).drop("_b", "_kb", "_base", "_r", *[f"_k{i}" for i in range(len(key))])


#: Up to so many edges (some 100 MB in a Python worker) one task finds the components; beyond, rounds over tables do.
ONE_TASK = 400_000


def _union_find(batches):
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            root.setdefault(u, u), root.setdefault(v, v)
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): smallest node reachable over undirected edges, for nodes that have an edge.

    A graph of at most one_task edges goes to one task. Larger ones take large-star and small-star rounds
    until a round changes nothing: a node's star is never gathered in one row, as each star is a grouped
    minimum joined back to its edges, so map-side combining holds for hubs, and every round ends in a
    table in the shared folder.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    cur = materialize(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    if cur.count() <= one_task:
        out = materialize(cur.coalesce(1).mapInArrow(_union_find, "node long, component long"), name)
        discard(cur)
        return out
    seen = None
    while True:
        sym = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = sym.join(low, sym.u == low.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(down, large.u == down.n).select(F.col("u"), "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, cur = cur, materialize(small, name)
        discard(last)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            ends = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")))
            out = materialize(ends.distinct(), name)
            discard(cur)
            return out
        seen = now


def doc_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def in_fold(doc_id: Column, fold: int) -> Column:
    """crc32 of doc_id as text, mod 5, equals fold (null doc_id: empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == fold


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder that all executors share, by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch: rows here are whole texts or blocks of numbers, of which 10,000 fill a worker's memory.
BATCH_ROWS = 512


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package when only the driver's sys.path has it, and have
    Spark send texts in small batches unless the session asks for a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    from pathlib import Path

    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def _marked(df: DataFrame, wanted: DataFrame, key: str, most_bits: int) -> tuple[DataFrame, Column]:
    """df with a bitmap's words, and whether a row's bit is set."""
    bits = min(most_bits, max(1 << 16, 1 << (32 * wanted.count()).bit_length()))
    h, (at, word, own) = F.pmod(F.xxhash64(key), F.lit(bits)), (f"_{uuid.uuid4().hex}" for _ in range(3))
    words = wanted.select(h.alias("h")).groupBy((F.col("h") / 64).cast("long").alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias(own))
    got = df.withColumn(at, h).withColumn(word, (F.col(at) / 64).cast("long")).join(F.broadcast(words), word, "left")
    return got, F.coalesce(F.expr(f"shiftright({own}, cast({at} % 64 as int)) & 1L = 1L"), F.lit(False))


def bit_filter(df: DataFrame, wanted: DataFrame, key: str, most_bits: int = 1 << 24) -> DataFrame:
    """The rows of df whose key may be in wanted, by a bitmap of hashed keys, to spare rows a shuffle.

    The bitmap has at most most_bits / 64 rows whatever the data, so it can be broadcast; the fuller it
    is, the less it spares. Rows that pass by chance must be dropped by the join that follows."""
    got, hit = _marked(df, wanted, key, most_bits)
    return got.where(hit).select(*df.columns)


def row_keys(docs: DataFrame) -> list[Column]:
    """k1 and k2: 128 bits that tell (doc_id, text) apart, computed where the row is read."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"]
    return [F.xxhash64(F.lit(1), doc_id, text).alias("k1"), F.xxhash64(F.lit(2), text, doc_id).alias("k2")]


def keep_rows(docs: DataFrame, rows: DataFrame, best: DataFrame, group: str) -> DataFrame:
    """docs, all columns, without the rows of a group in `best` that aren't its best.

    rows: group, k1, k2 of all rows; best: group (one row each), k1, k2 of the row that stays. Rows alike in
    id and text share a key; of these the one whose columns come first as JSON stays. Whole rows move only
    where a bitmap of bounded size can't tell that they stay; no key is null, so null ids are as any other.
    """
    b = best.select(F.col(group).alias("_g"), F.col("k1").alias("_b1"), F.col("k2").alias("_b2"))
    b = materialize(b, "best")
    hit = rows.join(b, F.col(group) == F.col("_g"))
    own = (F.col("k1") == F.col("_b1")) & (F.col("k2") == F.col("_b2"))
    keys = hit.groupBy("k1", "k2", own.alias("own")).agg(F.count("*").alias("n")).where("not own or n > 1")
    keys = materialize(keys, "listed")
    discard(b)
    twice = keys.where("own").select("k1", "k2")
    one, two = (f"_{uuid.uuid4().hex}" for _ in range(2))
    keyed = docs.withColumns(dict(zip((one, two), row_keys(docs))))
    named = lambda t: t.withColumnsRenamed({"k1": one, "k2": two})
    got, listed = _marked(keyed, named(keys), one, 1 << 24)
    may = bit_filter(keyed, named(keys), one)
    out = got.where(~listed).select(*docs.columns).union(may.join(named(keys), [one, two], "left_anti").select(*docs.columns))
    if twice.isEmpty():
        return out
    again = bit_filter(keyed, named(twice), one).join(named(twice), [one, two], "left_semi")
    whole = F.struct(*[docs[c] for c in docs.columns])
    again = again.groupBy(one, two).agg(F.min_by(whole, F.to_json(whole, {"ignoreNullFields": "false"})).alias(one + "r"))
    return out.union(again.select(f"{one}r.*"))
