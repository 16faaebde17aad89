"""Decontamination against a plain scan of all runs of words."""

import hashlib
import random
import re

import pytest

from tidemark.llm import decontam

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i : i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus(seed):
    g = random.Random(seed)
    vocab = ["the", "of", "Zug", "naïve", "x1", "日本", "a", "b", "c", "d", "e"]
    text = lambda n: "".join(g.choice(vocab) + g.choice([" ", " ", ", ", "\n", "--", "_"]) for _ in range(n))
    items = [(i, text(g.choice((0, 1, 2, 3, 9, 10, 11, 30)))) for i in range(25)] + [(3, text(14)), (None, text(12)), (None, None), (99, ""), (50, "the the the the the the the the the the the the"), (51, "the " * 12)]
    # single words of the vocabulary would hit everywhere: replace the shortest items
    items = [(i, t if len(words(t)) > 2 or not t else "rare " + t) for i, t in items]
    docs = []
    for i in range(60):
        t = text(g.randrange(80))
        if g.random() < 0.6:
            own = words(g.choice(items)[1])
            low = g.randrange(len(own)) if own else 0
            t += " ".join(own[low:] if g.random() < 0.5 else own).upper() + " " + text(g.randrange(5))
        docs.append((i, t))
    docs += [(None, docs[0][1]), (7, "other"), (7, "other"), (8, None), (9, ""), (10, "... --"), (11, "the " * 500)]
    return docs, items


@pytest.mark.parametrize("seed,window,shingle", [(1, 10, 5), (2, 10, 3), (3, 4, 4), (4, 10, 1), (5, 3, 2)])
def test_equals_plain_scan(spark, seed, window, shingle):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, words string, k1 int").repartition(4)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, token int").repartition(3)
    got = decontam.decontaminate(d, b, window, shingle)
    assert got.columns == COLUMNS
    want = brute(docs, items, window)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_occurrences(spark):
    d = spark.createDataFrame([(1, "x y " + "a b c d e f g h i j k"), (2, "a b c d e f g h i")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "A b, c d e f g h i j")], "item_id long, text string")
    assert [tuple(r) for r in decontam.occurrences(d, b).collect()] == [(1, "5", 2, 10)]


def test_share_of_shingles(spark):
    """Below a share of 1, a run of the item's length that holds enough of its shingles counts, whatever stands between."""
    item = "a b c d e f g h i j"
    docs = [(1, "z " + item), (2, "a b c d e f g h i ZZ"), (3, "a b c d e XX g h i j"), (4, "a b c d e"), (5, "q r s t u v w x y z")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")

    def most(text, k=3):
        w, own = words(text), {tuple(words(item)[i : i + k]) for i in range(8)}
        return max((len({tuple(w[s : s + 10][i : i + k]) for i in range(8)} & own) for s in range(len(w) - 9)), default=0) / 8

    for share in (1.0, 0.85, 0.6):
        got = {r.doc_id for r in decontam.decontaminate(d, b, 10, 3, share).where("contaminated").collect()}
        assert got == {i for i, t in docs if most(t) >= share}, share


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.decontaminate(d, b).collect() == []
    assert [tuple(r)[:4] for r in decontam.decontaminate(some, b).collect()] == [(1, 2, 0, 0)]
    assert decontam.decontaminate(d, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        decontam.decontaminate(some, b, 3, 4)
