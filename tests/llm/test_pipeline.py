import random
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tidemark.llm.common import reachable

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, tmp_path):
    reachable(spark)
    words = [f"{a}{b}" for a in ("the", "and", "ing", "ou") for b in ("re", "st", "ly", "ed", "th")]
    text = lambda i, n=40: " ".join(random.Random(i).choice(words) for _ in range(1)) + " " + " ".join(random.Random(1000 * i + j).choice(words) for j in range(n))
    rows = [(i, text(i), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, text(1) + " ", "en", "s0", 0), (101, text(2).upper(), "en", "s1", 0), (102, "12 34", None, "s1", 0), (103, None, "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert 102 not in seen[0] and 103 not in seen[0] and {*range(40), 100, 101} <= set(seen[0])
    assert set(seen[0]) - set(seen[1]) == {1}  # the longer of two equal texts stays
    assert 101 not in seen[2] and set(seen[2]) <= set(seen[1]) and set(seen[3]) <= set(seen[2])
    pieces = docs.collect()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in again)
    assert {r.doc_id for r in pieces} == set(seen[3])


def test_filters_keep_every_row_they_should(spark, tmp_path):
    """Null and repeated ids, empty tables and clashing names, stage by stage (up to packing)."""
    reachable(spark)
    text = lambda i: f"start{i} " + " ".join(random.Random(i * 977 + j).choice(["there", "sting", "andly", "outh", "reed"]) for j in range(30))
    rows = [(None if i % 3 == 0 else i % 7, text(i), "en", "s0", 0) for i in range(24)] + [(None, text(3), "en", "s0", 0), (2, text(4) + " ", "en", "s0", 0)]
    more = {c: "x" for c in ("_keep", "_one", "node", "size", "_row", "k1", "_d", "_s", "recipe", "root", "_h", "_w")}
    docs = spark.createDataFrame([(*r, *more.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more))
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[-len(more):] == list(more)
        assert docs.count() == (26, 24, 24)[k]
    assert {r.text.strip() for r in docs.collect()} == {text(i) for i in range(24)}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


@pytest.mark.parametrize("gone", [("tidemark.llm",), ("corpus_pipeline",), ("tidemark.llm", "corpus_pipeline")])
def test_entry_without_the_subpackage(gone):
    code = f"""
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if any(name == g or name.startswith(g + '.') for g in {gone!r}):
            raise ModuleNotFoundError('No module named ' + repr(name), name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'] and len(e.queries()) > 50
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
