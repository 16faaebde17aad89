"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the 2-, 3- and 4-byte sequences of the lower-cased text, runs of white space as one space,
hashed into `BUCKETS` rows of an embedding table. A text's vector is the mean of its subwords' rows;
a linear softmax over it gives the language. Table and softmax are trained by stochastic gradient
descent in numpy. As both are linear, a prediction is the text's subword histogram times their product.

Rejection is calibrated: on sampled documents held out of the descent, a temperature is chosen by
likelihood, and the rejection level lies below the confidence of all those, and snippets of a few words
of them, that were predicted rightly (half at most). und (null text, or no letter) is always rejected.

Scale: the classifier is fitted on `sample` labelled documents (a documented bound; chosen by smallest
hash of doc_id, so at random and the same each time); only their ids and hashed histograms reach the
driver. Prediction is one map over all whole texts, with no shuffle, and a broadcast of the table's
fixed size.

Edge cases: null or empty text or text without letters: und, score 0; null lang is not learned from;
null doc_id is in the fold of empty text; with nothing to learn from, all are und; other columns are
not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import release, slices
from .common import in_fold

BUCKETS, DIMS = 8192, 16
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"\s+")


def histogram(text: str) -> np.ndarray:
    """How often each bucket's subwords occur in the whole text (a block of 8 MB at a time)."""
    data = np.frombuffer((" " + _RUN.sub(" ", text.lower()) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), 8 << 20):
        b = data[at : at + (8 << 20) + 3].astype(np.uint32)
        h = b[:-1] * np.uint32(0x9E3779B1) + b[1:]
        for k in (2, 3, 4):
            if k > 2:
                if len(b) < k:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + b[k - 1 :] + np.uint32(k)
            out += np.bincount((h * np.uint32(0xC2B2AE35)) >> np.uint32(19), minlength=BUCKETS)
    return out


def _snippet(text: str) -> str:
    """One to three words from the middle of a text: short texts are learned and calibrated on too."""
    words = text.split()
    at = len(words) // 2
    return " ".join(words[at : at + 1 + len(words) % 3])


def _histograms(batches):
    """(lang, short, at, n): for each text, and for a snippet of it, the buckets that occur and how often."""
    for b in batches:
        rows = [(lang, short, histogram(t)) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for short, t in ((False, text), (True, _snippet(text)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([np.flatnonzero(r[2]).astype("<u2").tobytes() for r in rows], pa.binary()), pa.array([r[2][r[2] > 0].astype("<u4").tobytes() for r in rows], pa.binary())],
            ["lang", "short", "at", "n"],
        )


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 30, rate: float = 20.0, batch: int = 32, seed: int = 3):
    """Embedding table times softmax weights (BUCKETS, classes), and the bias. Rows of x sum to 1."""
    g = np.random.Generator(np.random.PCG64(seed))
    table = (g.standard_normal((BUCKETS, DIMS)) * 0.1).astype(np.float32)
    top, bias = (g.standard_normal((DIMS, classes)) * 0.1).astype(np.float32), np.zeros(classes, np.float32)
    weight = len(y) / (classes * np.maximum(1, np.bincount(y, minlength=classes)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = g.permutation(len(y))
        for i in range(0, len(y), batch):
            k = order[i : i + batch]
            mean = x[k] @ table
            d = softmax(mean @ top + bias)
            d[np.arange(len(k)), y[k]] -= 1
            d *= (weight[y[k]] / len(k))[:, None].astype(np.float32)
            back = d @ top.T
            top -= step * 0.05 * (mean.T @ d)
            bias -= step * 0.01 * d.sum(axis=0)
            table -= step * (x[k].T @ back)
    return table @ top, bias


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature of the largest likelihood, and that likelihood."""
    if not len(y):
        return 1.0, 0.0
    fit_of = lambda t: float(np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).sum())
    heat = float(max(np.geomspace(0.2, 10, 30), key=fit_of))
    return heat, fit_of(heat)


def _level(p: np.ndarray, y: np.ndarray) -> float:
    """Below it a prediction is rejected: under the confidence of every right one of the calibration, short texts too."""
    right = p.max(axis=1)[p.argmax(axis=1) == y] if len(y) else np.zeros(0)
    return float(min(0.5, 0.9 * right.min())) if len(right) else 0.0


def train(docs: DataFrame, sample: int = 1500, seed: int = 5) -> dict:
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("doc_id"), 0)).select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    chosen = ids.orderBy("h", "doc_id").limit(sample).select("doc_id")  # at most `sample` ids
    rows = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text")
    # two rows an id at most, but for repeated ids
    got = rows.mapInArrow(_histograms, "lang string, short boolean, at binary, n binary").orderBy("at", "n", "lang", "short").limit(4 * sample).collect()
    got = sorted(got, key=lambda r: (r.lang, r.short, bytes(r.at), bytes(r.n)))
    langs = sorted({r.lang for r in got})
    if not langs:
        return {"langs": []}
    x, y = np.zeros((len(got), BUCKETS), np.float32), np.array([langs.index(r.lang) for r in got])
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.n, "<u4")
        x[i] /= x[i].sum()
    aside = np.arange(len(y)) % 5 == 4
    w, bias = fit(x[~aside], y[~aside], len(langs))
    z, whole = x @ w + bias, aside & ~np.array([r.short for r in got])
    heat, _ = calibrate(z[whole], y[whole])
    level = _level(softmax(z[aside] / heat), y[aside])
    return {"langs": langs, "w": w, "bias": bias, "heat": heat, "level": level}


def _labels(m: dict, texts: pa.Array):
    """Language, score and rejection of each text."""
    names, scores, out = [], [], []
    for t in texts.to_pylist():
        if not m["langs"] or t is None or not _LETTER.search(t):
            names.append("und"), scores.append(0.0), out.append(True)
            continue
        h = histogram(t)
        p = softmax(((h @ m["w"]) / h.sum() + m["bias"])[None] / m["heat"])[0]
        k = int(p.argmax())
        names.append(m["langs"][k]), scores.append(float(min(1.0, p[k]))), out.append(bool(p[k] < m["level"]))
    return names, scores, out


def _predict(model):
    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                names, scores, out = _labels(model.value, b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, sample: int = 1500) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, sample: int = 1500) -> DataFrame:
    """The rows of docs whose language is told with enough confidence: one pass, in which texts go to Python
    and only a flag comes back."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(texts), 1000):
            out += [not x for x in _labels(model.value, texts[i : i + 1000])[2]]
        release()
        return pa.array(out, pa.bool_())

    return docs.where(kept("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify(docs)
    return got.select("doc_id", in_fold(F.col("doc_id"), 0).alias("held_out"), "lang_pred", "score", "rejected")
