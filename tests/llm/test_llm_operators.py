import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, embeddings, exact_dedup, hpylm, jaccard, langid, mixing, packing, pii, records, sharding
from tidemark.llm.common import SPACE, reachable

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    reachable(spark)


def frame(spark, texts, **more):
    """documents with doc_id = position; None is allowed anywhere. Extra columns clash with names used inside."""
    n = len(texts)
    langs, sources = more.get("lang", ["en"] * n), more.get("source", ["s"] * n)
    ids = more.get("ids", range(n))
    rows = [(i, t, l, s, None if t is None else len(t), "x", 7) for i, t, l, s in zip(ids, texts, langs, sources)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, node int")


ODD = [None, "", " \t\n", "one", "one two three", "One  TWO\u000bthree", "a" * 5000, "é ß 漢字 😀", "one", None]


@pytest.fixture(scope="module")
def corpus():
    g = random.Random(5)
    syl = ["an", "the", "ion", "er", "oo", "st", "zu", "qui"]
    word = lambda: "".join(g.choice(syl) for _ in range(g.randint(1, 3)))
    texts = [" ".join(word() for _ in range(g.choice([3, 20, 60, 200]))) for _ in range(120)]
    for i in range(60):  # near and exact copies
        w = texts[g.randrange(40)].split(" ")
        for _ in range(g.choice([0, 1, 2, 6, 12])):
            w[g.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts + ODD + ["spam ham eggs toast"] * 30 + [" ".join(word() for _ in range(9000))]


# --- mixing ----------------------------------------------------------------------------------------
def test_mix_meets_targets(spark, corpus):
    src = [["a", "b", "c", None][i % 4] if i % 3 else "a" for i in range(len(corpus))]
    df = frame(spark, corpus, source=src)
    got = mixing.mix_documents(df).collect()
    assert len(got) == len(corpus)
    size = Counter()
    for t, s in zip(corpus, src):
        size[s] += len(WORDS.findall(t or ""))
    total, free = sum(size.values()), dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (1, 2, 3, 1)))
    target, left = {}, total
    while free:  # reshare what stopped sources leave
        w = sum(free.values())
        stop = [s for s in free if left * free[s] / w > 3 * size[s] + 1e-9]
        if not stop:
            target |= {s: left * free[s] / w for s in free}
            break
        for s in stop:
            target[s] = 3 * size[s]
            left -= target[s]
            del free[s]
    for r in got:
        assert r.size == len(WORDS.findall(corpus[r.doc_id] or "")) and r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for s in size:
        biggest = max(r.size for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= min(biggest, 0.15 * target[s] + 30)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_documents(df.repartition(7)).collect()), key=repr)
    taken = sum(r.taken for r in got)
    assert sum(len(WORDS.findall(r.text or "")) for r in mixing.repeat_documents(df).collect()) == taken


def test_mix_in_buckets(spark):
    """Many buckets a source: the sum still ends within a document of its target."""
    g = random.Random(12)
    texts = ["w " * g.randint(1, 60) for _ in range(600)]
    df = frame(spark, texts, source=["abc"[i % 3] if i % 2 else "a" for i in range(600)])
    for r in mixing.mix_documents(df, bucket_rows=16).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 60


def test_inclusion_follows_odds(spark):
    """Over seeds, a document's mean copies come near its expected copies (equal within a size class)."""
    texts = ["w " * n for n in [100] * 30 + [3] * 30] + ["v " * 2000]
    df = frame(spark, texts, source=["a"] * 60 + ["b"])
    runs = [mixing.mix_documents(df, weights=(1.0, 3.0), seed=s).where("source = 'a'").collect() for s in range(6)]
    long = np.mean([r.copies for run in runs for r in run if r.size == 100])
    short = np.mean([r.copies for run in runs for r in run if r.size == 3])
    assert short < long


def test_mix_sample_against_plain_sampling(spark):
    """The drawn sample equals Pareto order sampling done plainly: ranks by odds, taken while that comes closer."""
    g = random.Random(21)
    texts = ["w " * g.choice([5, 40, 150, 200, 300]) for _ in range(400)]
    df = frame(spark, texts, source=["abc"[i % 3] if i % 2 else "a" for i in range(400)])
    got = {r.doc_id: r for r in mixing.mix_documents(df, bucket_rows=8).collect()}
    rows = df.select("doc_id", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 52)).alias("h")).collect()
    u = {r.doc_id: (r.h + 0.5) / (1 << 52) for r in rows}
    for source in "abc":
        own = [r for r in got.values() if r.source == source]
        weight = {r.doc_id: min(8, r.size.bit_length()) / 8 for r in own}
        stopped, c = set(), 0.0
        while True:  # expected copies c * weight, stopped at 3
            free = sum(r.size * weight[r.doc_id] for r in own if r.doc_id not in stopped)
            c = (own[0].target - 3 * sum(r.size for r in own if r.doc_id in stopped)) / free if free else 0.0
            more = {r.doc_id for r in own if r.doc_id not in stopped and c * weight[r.doc_id] > 3}
            if not more:
                break
            stopped |= more
        want = {r.doc_id: 3.0 if r.doc_id in stopped else c * weight[r.doc_id] for r in own}
        whole = {i: math.floor(w + 1e-9) for i, w in want.items()}
        p = {i: want[i] - whole[i] for i in want}
        room = own[0].target - sum(whole[r.doc_id] * r.size for r in own)
        copies = dict(whole)
        for i in sorted((i for i in p if p[i] > 1e-9), key=lambda i: u[i] / (1 - u[i]) / (p[i] / (1 - p[i]))):
            if got[i].size < 2 * room:
                copies[i] += 1
                room -= got[i].size
            elif room <= 0:
                break
        off = [i for i in copies if copies[i] != got[i].copies]
        assert len(off) <= 6, (source, len(off))  # the plain walk goes on past the bucket in which the sample ends


def test_mix_null_and_repeated_ids(spark):
    texts = ["w " * n for n in (9, 9, 50, 70, 70, 300, 0, 4)] + [None, "v " * 40]
    ids = [None, None, None, 5, 5, 5, 6, 7, 8, None]
    df = frame(spark, texts, ids=ids, source=["a", "a", "b", "a", "b", "a", "a", None, "b", None]).withColumns({c: F.lit("z") for c in ("_d", "_s", "_k", "_copies", "copies", "k", "taken")})
    rows = mixing.mix_documents(df).collect()
    assert len(rows) == 10
    repeated = mixing.repeat_documents(df)
    assert repeated.columns == df.columns
    assert sum(len(WORDS.findall(r.text or "")) for r in repeated.collect()) == sum(r.taken for r in rows)
    assert Counter((r.doc_id, r.source, len(WORDS.findall(r.text))) for r in repeated.collect()) == Counter({k: n for k, n in sum((Counter({(r.doc_id, r.source, r.size): r.copies}) for r in rows), Counter()).items() if n})


def test_mix_empty(spark):
    assert mixing.mix_documents(frame(spark, ["a"]).where("false")).count() == 0
    assert [r.taken for r in mixing.mix_documents(frame(spark, [None, ""])).collect()] == [0, 0]


# --- personal data ---------------------------------------------------------------------------------
def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def spans(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d(s)) <= 19 and luhn(d(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(d(s)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m.group())]


def test_pii_against_plain_expressions(spark, tmp_path):
    g = random.Random(2)
    bits = ["a@b.co", "x@y@z.com", "a@b.c_d@e.f.g", "@", ".", "1.2.3.4", "001.2.3.4.5", "256.1.1.1", "9999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (555) 123-4567", "+49", "+", "12", "5", " ", "-", "é😀", "word", "0", "\n", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "123-45-6789"]
    texts = ["".join(g.choice(bits) for _ in range(g.randint(1, 14))) for _ in range(400)] + ODD
    texts += ["a" * 30000 + " b@c.de", "1" * 20000, "1 " * 9000, "+1(" * 3000 + "5", "q@r.st " * 700]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in pii.BASE] == want
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s.startswith(k + ":") for s in want) for k in pii.BASE)


def test_pii_checks_and_context(spark):
    rows = pii.find_pii(frame(spark, ["iban GB82 WEST 1234 5698 7654 32.", "iban GB82 WEST 1234 5698 7654 33.", "my ssn is 123-45-6789", "part 123-45-6789", "card 4111111111111111", "z 4111111111111111"])).orderBy("doc_id").collect()
    assert [len(r.iban) for r in rows] == [1, 0, 0, 0, 0, 0] and [len(r.ssn) for r in rows] == [0, 0, 1, 0, 0, 0]
    assert rows[4].card[0].score > rows[5].card[0].score


# --- exact dedup -----------------------------------------------------------------------------------
def bare(t):
    return "".join(c for c in (t or "") if c not in SPACE)


@pytest.mark.parametrize("bits", [128, 4])
def test_exact_groups(spark, corpus, bits):
    texts = corpus + [" " + corpus[0] + "\n", corpus[-1].replace(" ", "\n")]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(bare(t), []).append((-len(t or ""), i))
    got = exact_dedup.exact_groups(frame(spark, texts), bits).collect()
    assert len(got) == len(texts)
    for r in got:
        members = groups[bare(texts[r.doc_id])]
        assert (r.keep_id, r.group_size) == (min(members)[1], len(members)) and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(bare(texts[r.doc_id]).encode()).hexdigest()


def test_exact_nulls_and_repeats(spark):
    df = frame(spark, ["a b", "ab", "a  b", "c", "c"], ids=[None, 1, 2, 3, 3])
    assert {r.keep_id for r in exact_dedup.exact_groups(df).where("group_size = 3").collect()} == {2}
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(df).collect()) == [2, 3]
    assert exact_dedup.deduplicate(df).columns == df.columns
    assert exact_dedup.exact_groups(df.where("false")).count() == 0
    low = spark.createDataFrame([(-(2**63), "a b"), (-(2**63), "a b"), (None, "ab"), (2**63 - 1, " "), (None, ""), (-(2**63), " ")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(low).collect()) == [(-(2**63), -(2**63), 3)] * 3 + [(0, -(2**63), 3)] * 2 + [(2**63 - 1, -(2**63), 3)]
    assert sorted(r.text for r in exact_dedup.deduplicate(low).collect()) == [" ", "a b"]


def test_exact_keeps_every_text_whatever_its_id(spark):
    rows = [(None, "x"), (None, "y"), (None, "y"), (5, "x x"), (5, "yy"), (6, "long text"), (6, "s"), (1, "s"), (7, None), (7, "q"), (None, " ")]
    kept = exact_dedup.deduplicate(frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=repr) == sorted([(None, "x"), (None, "y"), (5, "x x"), (5, "yy"), (6, "long text"), (1, "s"), (None, " "), (7, "q")], key=repr)


def test_chunks_depend_on_content():
    g = np.random.default_rng(1)
    data = g.integers(97, 123, 60000, dtype=np.uint8).tobytes()
    pieces = lambda d: {d[a:b] for a, b in zip([0, *exact_dedup.cuts(d)], exact_dedup.cuts(d))}
    assert b"".join(data[a:b] for a, b in zip([0, *exact_dedup.cuts(data)], exact_dedup.cuts(data))) == data
    assert len(pieces(data) & pieces(b"new start" + data)) > 0.7 * len(pieces(data))
    sizes = np.diff([0, *exact_dedup.cuts(data)])
    assert sizes.max() <= exact_dedup.MOST and (sizes[:-1] >= exact_dedup.LEAST).all()


# --- embeddings ------------------------------------------------------------------------------------
def test_embeddings_against_all_pairs(spark):
    g = np.random.default_rng(3)
    base = g.standard_normal((260, 24))
    near = base[:40].repeat(3, axis=0) + g.standard_normal((120, 24)) * 0.12
    dense = base[50] + g.standard_normal((150, 24)) * 0.25
    x = np.concatenate([base, near, dense, base[:5] * 3.0, base[:4]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [None] * 24), (n + 5, base[0].tolist()[:12]), (None, base[70].tolist())]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=16).collect()}
    u = np.concatenate([x, base[70:71]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    label = np.arange(n + 1)
    while (new := np.array([min(label[i], label[hit[i]].min(initial=n + 1)) for i in range(n + 1)])).tolist() != label.tolist():
        label = new
    links = sum(got[i].n_links for i in range(n))
    assert links >= 0.99 * hit[:n].sum() and all(got[i].n_links <= hit[i].sum() for i in range(n))
    assert np.mean([got[i].component_id == label[i] for i in range(n)]) > 0.99
    for i in range(n, n + 5):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[n + 5].n_links == 0 and got[None].component_id == 70
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_of_single_pairs(spark):
    """Pairs exactly at the limit with no other link, among vectors that link with nothing: at least 0.9 are found."""
    g = np.random.default_rng(8)
    x = g.standard_normal((400, 32))
    y = g.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    both = np.concatenate([x, 0.9001 * x + math.sqrt(1 - 0.9001**2) * y, g.standard_normal((3200, 32))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(rows).where("n_links > 0").collect()}
    assert sum(got.get(i, 0) > 0 for i in range(400)) >= 0.9 * 400
    assert embeddings.passes_for(10_000, 0.9, 24, 0.96) < embeddings.passes_for(10**6, 0.9, 24, 0.96) < embeddings.passes_for(10**9, 0.9, 24, 0.96) < 200


# --- language model --------------------------------------------------------------------------------
def test_scores(spark, corpus):
    df = frame(spark, corpus)
    got = {r.doc_id: r for r in hpylm.score_texts(df, block_tokens=2000).collect()}
    tokens = [WORDS.findall((t or "").translate(LOWER)) + [None] for t in corpus]
    out = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(corpus))]
    c = Counter(w for t, o in zip(tokens, out) if not o for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-6)
        assert r.score < 0
    held = [got[i] for i in range(len(corpus)) if out[i]]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    one = {r.doc_id: r.score for r in hpylm.score_texts(df).collect()}
    assert all(one[i] == pytest.approx(got[i].score, rel=0.05, abs=0.5) for i in one)
    assert hpylm.score_texts(df.where("false")).count() == 0


def test_predictions_sum_to_one():
    """The averaged predictive distribution of a context, with one unknown word, is a distribution."""
    g = np.random.Generator(np.random.PCG64(1))
    words, classes = 50, 3
    of, cls = np.repeat(np.arange(words), classes), np.tile(np.arange(classes), words)
    c = g.poisson(2.0, len(of)) * g.integers(0, 60, len(of))
    totals = np.zeros(hpylm.CLASSES)
    totals[:classes] = np.bincount(cls, c)
    t, c0, t0 = hpylm.seat(c, of, cls, words, totals, 1, g)
    assert ((t >= (c > 0)) & (t <= c)).all() and (t0 <= c0 + 1e-9).all()
    v = (np.bincount(of, c) > 0).sum()
    base = (hpylm.S0 + hpylm.D0 * t0.sum()) / (v + 1) / (hpylm.S0 + c0.sum())
    parent = (c0 - hpylm.D0 * t0) / (hpylm.S0 + c0.sum()) + base
    known = np.bincount(of, c) > 0
    assert parent[known].sum() + base == pytest.approx(1.0)
    tables = np.bincount(cls, t)
    for k in range(classes):
        here = cls == k
        p = (c[here] - hpylm.D1 * t[here] + (hpylm.S1 + hpylm.D1 * tables[k]) * parent) / (hpylm.S1 + totals[k])
        unknown = (hpylm.S1 + hpylm.D1 * tables[k]) * base / (hpylm.S1 + totals[k])
        assert p[known].sum() + unknown == pytest.approx(1.0)


def test_seating_law_does_not_depend_on_ranges():
    """One word with nearly all tables of the parent (an end token): the other ranges must know of them."""
    g = np.random.Generator(np.random.PCG64(4))
    classes, words = 3000, 200
    of = np.concatenate([np.zeros(classes, np.int64), np.repeat(np.arange(1, words), 4)])
    cls = np.concatenate([np.arange(classes), g.integers(0, classes, 4 * (words - 1))])
    c = g.integers(1, 30, len(of))
    totals = np.bincount(cls, c, hpylm.CLASSES)
    runs = [hpylm.seat(c, of, cls, words, totals, parts, np.random.Generator(np.random.PCG64(5))) for parts in (1, 8)]
    for a, b in zip(*runs):
        assert b[1:].sum() == pytest.approx(a[1:].sum(), rel=0.03)
    whole = hpylm._start(c, of, words)
    sums, tables = hpylm._sums(of, cls, *whole)
    own = np.flatnonzero(of == 7)
    t = np.mean([hpylm.sweep(c[own], of[own] * 0, cls[own], whole[0][own], whole[1][7:8], tables, sums, g)[0].sum() for _ in range(300)])
    alone = np.mean([hpylm.sweep(c, of, cls, *whole, tables, sums, g)[0][own].sum() for _ in range(300)])
    assert t == pytest.approx(alone, rel=0.05)


def plain_restaurant(counts, totals, words, sweeps, burnt, g):
    """Predictive probabilities of a two-level Pitman-Yor process by seating customers one by one: the plain Gibbs sampler."""
    tables = {k: [] for k in counts}  # (class, word): customers at each table
    top, per_class = {w: [] for w in range(words)}, Counter()
    mean = Counter()

    def pick(weights):
        return int(np.searchsorted(np.cumsum(weights), g.random() * sum(weights)))

    def upper(w):
        n, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (sum(top[w]) - hpylm.D0 * len(top[w]) + (hpylm.S0 + hpylm.D0 * t) / (words + 1)) / (hpylm.S0 + n)

    def add(k):
        room = tables[k]
        at = pick([n - hpylm.D1 for n in room] + [(hpylm.S1 + hpylm.D1 * per_class[k[0]]) * upper(k[1])])
        if at < len(room):
            room[at] += 1
            return
        room.append(1)
        per_class[k[0]] += 1
        own, t = top[k[1]], sum(map(len, top.values()))
        at = pick([n - hpylm.D0 for n in own] + [(hpylm.S0 + hpylm.D0 * t) / (words + 1)])
        if at < len(own):
            own[at] += 1
        else:
            own.append(1)

    def drop(k):
        room = tables[k]
        at = pick(room)
        room[at] -= 1
        if not room[at]:
            room.pop(at)
            per_class[k[0]] -= 1
            own = top[k[1]]
            at = pick(own)
            own[at] -= 1
            if not own[at]:
                own.pop(at)

    for k, n in counts.items():
        for _ in range(n):
            add(k)
    for i in range(sweeps):
        for k, n in counts.items():
            for _ in range(n):
                drop(k)
                add(k)
        if i >= burnt:
            for c in range(len(totals)):
                for w in range(words):
                    k = (c, w)
                    mean[k] += ((counts.get(k, 0) - hpylm.D1 * len(tables.get(k, ()))) + (hpylm.S1 + hpylm.D1 * per_class[c]) * upper(w)) / (hpylm.S1 + totals[c]) / (sweeps - burnt)
    return mean


def test_probabilities_against_one_by_one_seating():
    g = np.random.Generator(np.random.PCG64(11))
    words, classes = 40, 6
    law = g.dirichlet(np.full(words, 0.3), classes)
    counts = {(c, w): int(n) for c in range(classes) for w, n in enumerate(g.multinomial(90, law[c])) if n}
    totals = [90] * classes
    want = plain_restaurant(counts, totals, words, 120, 30, g)
    of, cls, c = (np.array(x) for x in zip(*sorted((w, k, n) for (k, w), n in counts.items())))
    seen = {w: i for i, w in enumerate(np.unique(of).tolist())}
    of = np.array([seen[w] for w in of.tolist()])
    sums = np.zeros(hpylm.CLASSES)
    sums[:classes] = 90
    runs = [hpylm.seat(c, of, cls, len(seen), sums, 1, np.random.Generator(np.random.PCG64(i))) for i in range(12)]
    t, c0, t0 = (np.mean(x, axis=0) for x in zip(*runs))
    parent = (c0 - hpylm.D0 * t0 + (hpylm.S0 + hpylm.D0 * t0.sum()) / (len(seen) + 1)) / (hpylm.S0 + c0.sum())
    got = (c - hpylm.D1 * t + (hpylm.S1 + hpylm.D1 * np.bincount(cls, t)[cls]) * parent[of]) / (hpylm.S1 + 90)
    back = {i: w for w, i in seen.items()}
    expected = np.array([want[int(k), back[int(w)]] for w, k in zip(of, cls)])
    off = np.log10(got / expected)
    assert abs(np.average(off, weights=c)) < 0.01 and np.abs(off)[c > 2].max() < 0.06 and np.abs(off).max() < 0.25


def test_scores_for_any_number_of_ranges(spark, corpus):
    df, was = frame(spark, corpus), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for parts in ("8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r.doc_id: (r.score, r.n_tokens) for r in hpylm.score_texts(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    off = [(got[1][i][0] - got[0][i][0]) / got[0][i][1] for i in got[0]]
    assert abs(np.mean(off)) < 0.01 and np.max(np.abs(off)) < 0.1


def test_seating_draws_follow_exact_law():
    g, c, a, d = np.random.Generator(np.random.PCG64(2)), 6, math.exp(0.5), 0.8
    s = np.exp(hpylm._stirling(d)[c, 1 : c + 1]) * a ** np.arange(1, c + 1)
    got = np.bincount(hpylm.draw_tables(np.full(60000, c), np.full(60000, a), d, g), minlength=c + 1)[1:] / 60000
    assert np.abs(got - s / s.sum()).max() < 0.01
    big = hpylm.draw_tables(np.array([1000, 100000]), np.array([0.5, 0.5]), d, g)
    assert (big >= 1).all() and (big <= [1000, 100000]).all()


# --- packing ---------------------------------------------------------------------------------------
def test_fill_is_best():
    g = random.Random(4)
    for _ in range(60):
        counts = {g.randint(1, 40): g.randint(1, 4) for _ in range(6)}
        room = g.randint(10, 120)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        got = packing.fill(counts, room)
        assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())
    plan = packing.plan_windows({700: 3, 300: 4, 24: 9, 1024: 2}, 1024)
    used = Counter()
    for f, times in plan:
        assert sum(k * n for k, n in f.items()) <= 1024
        used.update({k: n * times for k, n in f.items()})
    assert used == Counter({700: 3, 300: 4, 24: 9, 1024: 2})


def check_windows(rows, ids):
    by, seen = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for i, parts in seen.items():
        at = 0
        for s, k in sorted(parts):
            assert s == at
            at += k
        assert at == len(ids[i])
    assert sorted(by) == list(range(len(by)))
    return len(by)


def test_pack(spark, corpus):
    tok = bpe.encoder(bpe.tokenizer_path()).tok
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in corpus]
    rows = packing.pack_documents(frame(spark, corpus)).collect()
    windows = check_windows(rows, ids)
    assert {r.doc_id for r in rows} == set(range(len(corpus))) and windows <= 1.05 * sum(map(len, ids)) / 1024 + 2
    assert packing.pack_documents(frame(spark, ["a"]).where("false")).count() == 0
    twice = packing.pack_documents(frame(spark, ["a b", "a b"], ids=[7, 7])).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    e, fresh = bpe.Encoder(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    special = next(iter(fresh.get_added_tokens_decoder().values())).content
    texts = ["", "  a  b", "x   y", " lead", "trail ", "x\n\n y", "a\nb c's \t d", "é à ñ", " ", "　 x", "a b  ", "\n ", None, "12 345,6 7", "a b " * 3]
    texts += [special, special + " hi", "hello " + special + " world", "glued" + special + "words", "end " + special, special * 3, special[:-1] + " cut", "a b\n" + special]
    for _ in range(2):
        ids, at = e.encode(pa.array(texts), 5)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [fresh.encode(t or "", add_special_tokens=False).ids + [5] for t in texts]


# --- language ID -----------------------------------------------------------------------------------
def test_language(spark):
    g = random.Random(6)
    syl = {"aa": ["the", "ing", "wh", "and"], "bb": ["der", "sch", "ung", "ich"], "cc": ["que", "ção", "lho", "nha"]}
    make = lambda k, n: " ".join("".join(g.choice(syl[k]) for _ in range(g.randint(1, 3))) for _ in range(n))
    langs = [g.choice(list(syl)) for _ in range(300)]
    texts = [make(k, g.choice([3, 10, 80])) for k in langs]
    known = [k if i % 7 else None for i, k in enumerate(langs)] + [None] * 5
    df = frame(spark, texts + [None, "", "12 !? 7", "  ", "_"], lang=known)
    got = {r.doc_id: r for r in langid.identify(df, sample=150).collect()}
    assert np.mean([got[i].lang_pred == langs[i] for i in range(300)]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in range(300, 305))
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(got[i].rejected for i in range(300)) <= 9
    kept = langid.keep_identified(df, sample=150)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    same = {r.doc_id: r.lang_pred for r in langid.identify(df.withColumn("source", F.lit(None).cast("string")), sample=150).collect()}
    assert same == {i: r.lang_pred for i, r in got.items()}
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]


# --- sharding --------------------------------------------------------------------------------------
def test_tree():
    g, tree, held = random.Random(8), sharding.BinTree(), set()
    for step in range(3000):
        if held and g.random() < 0.45:
            k = g.choice(sorted(held))
            held.remove(k)
            tree.remove(k)
        else:
            k = (g.randrange(50), step)
            held.add(k)
            tree.insert(k)
        s = g.randrange(55)
        assert tree.tightest(s) == min((k for k in held if k[0] >= s), default=None)


def one_by_one(sizes, capacity):
    """Best-fit-decreasing without a tree or runs."""
    room, where = [], []
    for size in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        if fits:
            i = min(fits)[1]
        else:
            i = len(room)
            room.append(capacity)
        room[i] -= size
        where.append(i)
    return where


def test_best_fit():
    g = random.Random(3)
    for _ in range(200):
        counts = sorted(((g.randint(1, 60), g.randint(1, 9)) for _ in range(g.randint(1, 9))), reverse=True)
        counts = [c for i, c in enumerate(counts) if not i or c[0] != counts[i - 1][0]]
        got = sharding.best_fit_decreasing(counts, 70)
        assert [b for runs in got for b, n in runs for _ in range(n)] == one_by_one([s for s, n in counts for _ in range(n)], 70)
    load = Counter()
    sizes = [(100, 1), (10, 1), (9, 1), (8, 1), (7, 1), (6, 1), (5, 2)]
    for (s, n), runs in zip(sizes, sharding.pack_units(sizes, 4)):
        assert sum(k for _, k in runs) == n
        for w, k in runs:
            load[w] += s * k
    assert sorted(load.values())[-1] == 100 and max(sorted(load.values())[:-1]) <= 18 and max(load) < 4
    with pytest.raises(ValueError):
        sharding.best_fit_decreasing([(11, 1)], 10)


def test_shards(spark, corpus):
    texts = corpus + [f"filler text {i} " * (i % 9 + 1) for i in range(900)] + ["x" * 5000 + str(i) for i in range(60)]
    ids = [i if i % 50 else None for i in range(len(texts))]
    df = frame(spark, texts, ids=ids).withColumn("at", F.monotonically_increasing_id()).withColumns({c: F.lit(1) for c in ("digest", "kind", "rank", "shard", "bytes")})
    rows = sharding.shard_documents(df, 8).collect()
    known = {i: t for i, t in zip(ids, texts) if i is not None}
    assert len(rows) == len(texts)
    shard_of, load, slots = {}, Counter(), {}
    for r in rows:
        if r.doc_id is not None:
            t = known[r.doc_id]
            assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode())
            if t is not None:
                assert shard_of.setdefault(t, r.shard) == r.shard
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(load) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.05 * max(load.values())
    assert sharding.shard_documents(frame(spark, ["a"]).where("false"), 8).count() == 0


# --- records ---------------------------------------------------------------------------------------
def slow_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    g = random.Random(9)
    rows = [b"123456789", b"", b"a", bytes(600)] + [g.randbytes(g.randint(0, 1500)) for _ in range(20)]
    got = records.crc32c(rows)
    assert got[0] == 0xE3069283 and got.tolist() == [slow_crc32c(r) for r in rows]
    framed = records.frame(rows)
    at = np.cumsum([0] + [len(f) for f in framed]).tolist()
    assert [bytes(p) for p in records.unframe(b"".join(framed), at)] == rows
    bad = bytearray(b"".join(framed))
    bad[at[4] - 10] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(bad), at)


def test_records_round_trip(spark, corpus):
    tok = bpe.encoder(bpe.tokenizer_path()).tok
    df = frame(spark, corpus).union(frame(spark, ["null id", "again", "again"], ids=[None, 3, 3]))
    folder, manifest = records.write_records(df, docs_a_file=40)
    got = records.read_records(folder, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] + sorted([*range(len(corpus)), 3, 3])
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None and r.doc_id != 3:
            ids = tok.encode(corpus[r.doc_id] or "", add_special_tokens=False).ids + [2]
            assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert records.read_records(*records.write_records(df.where("false"))).count() == 0


# --- Jaccard ---------------------------------------------------------------------------------------
def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("k,num,den,block", [(4, 85, 100, 1024), (5, 80, 100, 1024), (1, 60, 100, 4)])
def test_jaccard(spark, corpus, monkeypatch, k, num, den, block):
    g = random.Random(k)
    texts = list(corpus)
    base = [f"w{i}" for i in range(90)]
    for _ in range(60):  # a family around the limit
        w = list(base)
        for _ in range(g.randint(0, 3)):
            w[g.randrange(90)] = f"v{g.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"t{g.randrange(4)}" for _ in range(g.randint(1, 12))) for _ in range(80)]  # small sets
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sizes, want = brute(texts, k, num, den)
    got = {r.doc_id: r for r in jaccard.jaccard_components(frame(spark, texts), k, num, den).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes and [got[i].component_id for i in range(len(texts))] == want
    if k == 5:
        kept = jaccard.keep_one(frame(spark, texts), k, num, den)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_entries_never_miss():
    """Any two sets that reach the limit share an entry, for both allocations and all bands."""
    g = np.random.default_rng(7)
    for _ in range(400):
        n = int(g.integers(1, 400))
        x = np.unique(g.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(g.integers(0, max(1, int(0.15 * n)) + 1))
        y = np.unique(np.concatenate([np.delete(x, g.choice(len(x), min(drop, len(x) - 1), replace=False)), g.integers(0, 2**63, int(g.integers(0, 3)), dtype=np.uint64)]))
        inter = len(np.intersect1d(x, y))
        if 100 * inter >= 85 * (len(x) + len(y) - inter):
            assert len(np.intersect1d(jaccard.entries(x, 85, 100), jaccard.entries(y, 85, 100)))
            p, q = jaccard.parity(x), jaccard.parity(y)
            w = min(len(p), len(q))
            assert np.bitwise_count(jaccard.fold(p[None], w) ^ jaccard.fold(q[None], w)).sum() * 185 <= 15 * (len(x) + len(y))


@pytest.mark.parametrize("num,den", [(80, 100), (85, 100)])
def test_entries_of_large_sets_never_miss(num, den):
    """Pairs just at the limit, in sets of up to 10,000; the index stays well under one entry a shingle."""
    g = np.random.default_rng(num)
    for n in [500, 568, 709, 1000, 2500, 4237, 8300, 10000] * 3:
        x = np.unique(g.integers(0, 2**64, n, dtype=np.uint64))
        d = int((den - num) * n / den)  # dropping d of n leaves exactly the limit
        y = np.delete(x, g.choice(n, d, replace=False))
        assert len(np.intersect1d(jaccard.entries(x, num, den), jaccard.entries(y, num, den)))
        assert len(jaccard.entries(x, num, den)) < 0.85 * n
        p, q = jaccard.parity(x)[None], jaccard.parity(y)[None]
        w = min(p.shape[1], q.shape[1])
        assert np.bitwise_count(jaccard.fold(p, w) ^ jaccard.fold(q, w)).sum() * (den + num) <= (den - num) * (len(x) + len(y))


def test_jaccard_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(200)]
    other = [f"u{i}" for i in range(200)]
    edit = lambda w, *at: " ".join("x" if i in at else v for i, v in enumerate(w))
    rows = [
        (1, edit(base)), (None, edit(base, 50)), (None, edit(base, 50, 120)),  # near copies with null ids
        (7, edit(other, *range(0, 3))), (None, edit(other, 1, 2)), (9, edit(other, 2)),  # a null id that may bridge
        (None, "alone and null"), (None, "another null one"), (None, "another null one"), (None, None), (None, ""), (4, "same id"), (4, "another text of that id"),
    ]
    ids, texts = [i for i, _ in rows], [t for _, t in rows]
    df = frame(spark, texts, ids=ids).withColumns({c: F.lit(3) for c in ("k1", "k2", "root", "sketch", "_keep")})
    _, want = brute(texts, 4, 85, 100)
    least = {}
    for i, c in zip(ids, want):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    got = jaccard.jaccard_components(df).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(((i, i if not WORDS.search(t or "") else least[c]) for i, t, c in zip(ids, texts, want)), key=repr)
    kept = jaccard.keep_one(df, 4, 85, 100)
    assert kept.columns == df.columns
    groups = {}
    for (i, t), c in zip(rows, want):
        groups.setdefault(c if WORDS.search(t or "") else repr((i, t)), []).append((i is None, i or 0))
    assert sorted([(r.doc_id is None, r.doc_id or 0) for r in kept.collect()]) == sorted(min(g) for g in groups.values())


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(frame(spark, ["a"]).where("false")).count() == 0
    got = jaccard.jaccard_components(frame(spark, [None, "", "a", "A"], ids=[None, 1, 2, 3])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {None: (0, None), 1: (0, 1), 2: (1, 2), 3: (1, 2)}


# --- shared parts ----------------------------------------------------------------------------------
def test_components(spark):
    g = random.Random(10)
    edges = [(g.randrange(300), g.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)]
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    for most in (10**6, 0):
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), one_task=most).collect()}
        assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_number_rows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    rows = common.number_rows(df, ["k"], ["id"], 500, "n", per_bucket=20).collect()
    for k in range(3):
        own = sorted(r.n for r in rows if r.k == k)
        assert own == list(range(len(own)))


def test_language_id_with_repeated_and_null_ids(spark):
    """A doc_id of very many rows brings a bounded number of them to the driver; null ids and empty tables do too."""
    from tidemark.llm import langid

    rows = [(7 if i % 2 else None, f"der hund und die katze {i % 50}" if i % 3 else f"the dog and the cat {i % 50}", "de" if i % 3 else "en", "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnRenamed("source", "at")
    got = langid.train(df, sample=50)
    assert got["langs"] == ["de", "en"]
    assert langid.train(df.where("false"))["langs"] == []
