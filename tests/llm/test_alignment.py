"""The alignment of two tokenizers against a plain one, text by text and whole."""

import hashlib
from collections import Counter

import pytest

pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402

from tidemark.llm import alignment  # noqa: E402

TEXTS = [
    "Hello world, the quick brown fox", "a  b   c\n\n\td ", " leading and trailing ", "", None, "naïve café ﬁne 日本語テキスト é́ ▁x", "<|endoftext|> and <s> are text </s><0x41>",
    "nul \x00 and \x1c sep　wide nbsp  line", "\n", " ", "x", "tab\tand\r\nbreaks 1234567 don't we're", "a" * 3000, "word " * 500 + "end.", "Hello world, the quick brown fox", "emoji 👩‍👩‍👧 mixed कि नी", "the the the cat sat on the mat",
]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_alphabet()
    per, count = [], Counter()
    for doc_id, text in rows:
        got = None
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            sa = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
            sb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(sa) == b"".join(sb) == (" " + text).encode():
                ea, eb, at = [], [], 0
                for x in sa:
                    ea.append((at, at := at + len(x)))
                at = 0
                for x in sb:
                    eb.append((at, at := at + len(x)))
                cuts = sorted({e for _, e in ea} & {e for _, e in eb})
                groups, low = [], 0
                for c in cuts:
                    groups.append(",".join(str(i) for i, (s, e) in zip(ia, ea) if low <= s < c) + "|" + ",".join(str(i) for i, (s, e) in zip(ib, eb) if low <= s < c))
                    low = c
                links, j = [], 0
                for i, (s, e) in zip(ia, ea):
                    while eb[j][1] <= s:
                        j += 1
                    k = j
                    while k < len(eb) and eb[k][0] < e:
                        links.append((i, ib[k]))
                        k += 1
                got = (len(ia), len(ib), groups, links)
                count.update(set(links))
        per.append((doc_id, got))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, got in per:
        if got is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, links = got
            out.append((doc_id, na, nb, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, count


def key(r):
    return repr(r)


def test_align_equals_plain_alignment(spark):
    rows = list(enumerate(TEXTS)) + [(None, "the cat"), (3, "again"), (3, "again"), (3, "again  ")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, pair string").repartition(3)
    want, count = brute(rows)
    got = [tuple(r) for r in alignment.align(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(1 for r in want if r[1] == 0) >= 3 and sum(1 for r in want if r[1]) >= 15
    pairs = {(r.a_id, r.b_id): r.n_docs for r in alignment.pair_counts(df).collect()}
    assert pairs == dict(count)
    shown = {r.doc_id: r.groups for r in alignment.groups(df).collect() if r.doc_id == 0}
    assert hashlib.sha256(shown[0].encode()).hexdigest() == want[0][-1]


def test_small_blocks_and_a_cleared_cache_change_nothing(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    made = alignment.Aligner(*alignment._paths(None, None))
    monkeypatch.setattr(alignment, "KEEP", 5)
    import pyarrow as pa

    whole = made.block(pa.array([t for _, t in rows]))
    one = [made.block(pa.array([t])) for _, t in rows]
    assert whole["text"].to_pylist() == [x["text"][0].as_py() for x in one]
    assert alignment.align(df).count() == len(rows)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2
