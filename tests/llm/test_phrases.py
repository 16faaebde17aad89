"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import phrases


def brute(rows, longest=4, least=30, top=2000, absorb=80):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    cand = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    longer = {}
    for (lang, g), v in cand.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                k = (lang, g[i : i + m])
                longer[k] = max(longer.get(k, 0), v)
    out = {}
    for (lang, g), a in cand.items():
        if 100 * longer.get((lang, g), 0) >= absorb * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:top]))


def corpus(seed, n=120):
    g = random.Random(seed)
    vocab = ["The", "of", "Ab", "cd", "é", "straße", "Ünder", "x's", "\x00z", "(q)", "日本", "a"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(g.randrange(60)):
            words += ["new", "York", "stock"] if g.random() < 0.1 else [g.choice(vocab[: g.choice((3, 12))])]
        text = "".join(w + g.choice([" "] * 8 + ["\t", "  ", ", ", ".\n", "\r", " ; "]) for w in words)
        rows.append((g.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), (None, None), ("fr", " ,,. \n"), ("en", rows[0][1])]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"least": 3}), (3, {"least": 4, "top": 7}), (4, {"least": 2, "longest": 3, "absorb": 50}), (5, {"least": 5, "longest": 2})])
def test_equals_plain_counting(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "lang string, text string, w1 int, h string").repartition(5)
    want = brute(rows, **options)
    got = phrases.collocations(df, salts=3, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want and want


def test_many_ranges_give_the_same(spark):
    rows = corpus(9)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(7), least=3)
        assert sorted(map(tuple, got.collect())) == brute(rows, least=3)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_growth_over_cut_ranges(monkeypatch, rows):
    """Sorted pointers cut anywhere into ranges and batches, with one hot prefix, give whole counts."""
    monkeypatch.setattr(phrases, "ROWS", rows)
    g = random.Random(rows)
    pointers = Counter()
    for _ in range(3000):
        size = g.choice((2, 3, 4, 4))
        w = [5 if g.random() < 0.7 else g.randrange(-4, 9) or 1 for _ in range(size)]
        pointers[tuple(w) + (0,) * (4 - size)] += g.randrange(1, 4)
    table = sorted(pointers.items())
    want = Counter()
    for w, n in table:
        for m in (2, 3, 4):
            if w[m - 1] != 0:
                want[w[:m] + (0,) * (4 - m)] += n
    cuts = sorted(g.sample(range(1, len(table)), 12))
    got = Counter()
    for low, high in zip([0, *cuts], [*cuts, len(table)]):
        part = table[low:high]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0][i] for x in part[j : j + 5]], pa.int64()) for i in range(4)] + [pa.array([x[1] for x in part[j : j + 5]], pa.int64())], ["w1", "w2", "w3", "w4", "n"]) for j in range(0, len(part), 5)]
        for b in phrases._grow(4, 10)(iter(batches)):
            for r in np.stack([np.asarray(c) for c in b.columns], axis=1).tolist():
                got[tuple(r[:4])] += r[4]
    assert {k: v for k, v in got.items() if v >= 10} == {k: v for k, v in want.items() if v >= 10}



def test_score_expression(spark):
    a, left, right = 5_000_000_000_000_001, 7_000_000_000_000_003, 9_000_000_000_000_000
    got = spark.sql(f"SELECT cast((cast({a}L as decimal(20, 0)) * 2000000) div (cast({left}L as decimal(20, 0)) + {right}L) as long)").first()[0]
    assert got == 2_000_000 * a // (left + right)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", "one two")], "lang string, text string")).collect() == []
    assert [tuple(r) for r in phrases.phrase_counts(spark.createDataFrame([("en", "A b. a B")] * 2, "lang string, text string"), least=4).collect()] == [("en", "a b", 4)]
