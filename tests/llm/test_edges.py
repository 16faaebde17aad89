"""Each registered operator on tables with nulls in every column, repeated rows and ids, ties, a very long text and
extra columns under names that operators use themselves, and on empty tables."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog
from tidemark.llm.common import reachable

CLASH = ("k1", "k2", "h", "n", "at", "size", "words", "token", "node", "component", "rank", "copies", "shard", "slot", "start", "length", "q", "kind", "recipe", "points", "component_id", "group_size", "block", "pair", "f", "w1", "key", "row", "copy", "n_words", "place", "score", "ids", "count", "_b", "_r", "_k", "_s")
G = random.Random(17)
WORDS = ["the", "and", "mail", "a@b.de", "4111 1111 1111 1111", "Zug", "naïve", "日本語", "1.2.3.4", "x"] + [f"w{i}" for i in range(60)]
LONG = " ".join(G.choice(WORDS) for _ in range(30_000))
ROWS = [(i, " ".join(G.choice(WORDS) for _ in range(G.randrange(1, 50))), G.choice(["en", "de", None]), G.choice(["s0", "s1", None])) for i in range(60)]
ROWS += [(3, "repeated id", "en", "s0"), ROWS[5], ROWS[5], (None, "a null id", "en", "s0"), (None, "a null id", "en", "s0"), (None, None, None, None), (100, None, "de", None), (101, "", None, "s1"), (102, "", "en", "s1"), (103, " \t\n", "en", "s0"), (104, LONG, "en", "s0"), (105, LONG + " ", "en", "s1"), (-(2**63), "low", "en", "s0"), (2**63 - 1, "high", "de", "s0")]
BY_ROW = ("op1", "op2", "op3", "op5", "op7", "op8", "op9", "op10", "op11", "op13")


def name_of(op):
    return next(k for k in catalog.queries() if k.startswith(op + "_"))


@pytest.fixture(scope="module")
def tables(spark):
    reachable(spark)
    out = {}
    for kind, rows in (("full", ROWS), ("empty", [])):
        d = out[kind] = tempfile.mkdtemp(prefix="tidemark-")
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
        docs.withColumns({c: F.lit(7) for c in CLASH}).repartition(3).write.parquet(f"{d}/documents.parquet")
        items = [(1, " ".join(ROWS[0][1].split()[:20])), (1, "Zug"), (None, None), (2, ""), (3, LONG[:400])] if rows else []
        spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in CLASH}).write.parquet(f"{d}/benchmark.parquet")
        vectors = [(i, [float(i % 5 == k) + 0.01 * (i % 3) for k in range(8)]) for i in range(40)] + [(3, [1.0] + [0.0] * 7), (3, [1.0] + [0.0] * 7), (None, [1.0] + [0.0] * 7), (50, None), (51, [0.0] * 8), (52, [float("nan")] * 8), (53, [None] + [1.0] * 7)]
        spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumns({c: F.lit(1.5) for c in CLASH}).write.parquet(f"{d}/embeddings.parquet")
    return out


@pytest.mark.parametrize("op", [f"op{i}" for i in range(1, 14)])
def test_hard_rows_and_names(spark, tables, op):
    got = catalog.queries()[name_of(op)](spark, tables["full"]).collect()
    if op in BY_ROW:
        assert len(got) == len(ROWS)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    elif op == "op4":
        assert len(got) == 47
        alone = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id in (50, 51, 52, 53)}
        assert alone == {i: (0, i) for i in (50, 51, 52, 53)}
    elif op == "op6":
        assert {(r.doc_id, r.doc_tokens) for r in got if r.doc_id == 101} == {(101, 1)}
        assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    if op in ("op3", "op10"):  # rows that are alike have one result
        same = [tuple(r) for r in got if r.doc_id == ROWS[5][0]]
        assert len(same) == 3 and len(set(same)) == 1


@pytest.mark.parametrize("op", [f"op{i}" for i in range(1, 14)])
def test_empty_tables(spark, tables, op):
    assert catalog.queries()[name_of(op)](spark, tables["empty"]).collect() == []
