"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of the character n-grams (3 to 6, with word boundaries) of its words, hashed
into a fixed number of buckets. Its vector is the average of their embeddings; a softmax over
that average gives the score. Embeddings and softmax are trained jointly in numpy, so a
misspelling never seen shares most of its n-grams' vectors with the words it was made from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import labelled_sample, sampled_texts
from landwatch.llm.ngrams import blocks, codes

BITS = 16
BUCKETS = 1 << BITS
DIM = 4
SIZES = (3, 4, 5, 6)
#: Entries of the embedding table that a step is sized for. All entries share one second moment:
#: with one each, n-grams seen once would move as far as those that mark a class.
ACTIVE = 5000


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, block by block; an n-gram crosses no word boundary."""
    for c in blocks(codes(text), max(SIZES)):
        h, ok = c.copy(), np.ones(len(c), bool)
        for n in range(2, max(SIZES) + 1):
            if len(c) < n:
                return
            h = h[:-1] * np.uint32(0x01000193)  # of the n - 1 codes before the one that is added
            h += c[n - 1 :]
            ok = ok[:-1]
            if n > 2:
                ok &= c[n - 2 : -1] != 0  # the code before the last stands inside
            if n in SIZES:
                yield (h[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse bag of a text: buckets and weights that sum to one (empty for a text without words)."""
    total = np.zeros(BUCKETS, np.int64)
    for at in ngrams(text):
        total += np.bincount(at.astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total).astype(np.int32)
    return at, (total[at] / max(1, total.sum())).astype(np.float32)


def _bags(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for pdf in batches:
        pairs = [bag(t) for t in pdf["text"]]
        yield pd.DataFrame({
            "label": pdf["label"].astype("int32"),
            "at": [a.tobytes() for a, _ in pairs],
            "weight": [w.tobytes() for _, w in pairs],
        })


class Model:
    """What scoring needs: one number per bucket and a bias. ``BUCKETS`` floats, whatever the corpus."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias

    def score_text(self, text: str | None) -> float:
        total, n = 0.0, 0
        for at in ngrams(text):
            total += float(self.value.take(at).sum(dtype=np.float64))
            n += len(at)
        logit = self.bias + (total / n if n else 0.0)
        return float(1.0 / (1.0 + np.exp(-min(max(logit, -500.0), 500.0))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, epochs: int = 12, least_steps: int = 400, seed: int = 7) -> Model:
    """Fit embeddings and softmax jointly with Adam; ``prior`` is the share of label 1 among all labelled rows.

    With one label only (or no row) every text scores the prior.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    shift = float(np.log(prior / (1 - prior)))
    n, n1 = len(labels), int(labels.sum())
    if n1 in (0, n):
        return Model(np.zeros(BUCKETS, np.float32), shift)
    sampled = float(np.log(n1 / (n - n1)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    scale = 20.0  # averages are short vectors; scaling them keeps the steps well sized
    m = {k: np.zeros_like(v) for k, v in (("e", emb), ("s", soft), ("b", bias))}
    v = {k: np.zeros_like(x) for k, x in m.items()}
    soft[:] = rng.normal(0, 0.3, soft.shape)
    step = 0
    epochs = max(epochs, -(-least_steps * 128 // n))  # a small sample is passed over more often
    for epoch in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 128):
            rows = order[lo : lo + 128]
            used = [bags[r] for r in rows]
            sizes = np.array([len(a) for a, _ in used])
            row = np.repeat(np.arange(len(rows)), sizes)
            at = np.concatenate([a for a, _ in used]) if sizes.sum() else np.zeros(0, np.int32)
            w = (np.concatenate([x for _, x in used]) if sizes.sum() else np.zeros(0, np.float32)) * scale
            vec = np.stack([np.bincount(row, w * emb[at, d], len(rows)) for d in range(DIM)], 1).astype(np.float32)
            logits = vec @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            grads = {"s": vec.T @ p + 1e-5 * soft, "b": p.sum(0)}
            back = p @ soft.T
            grads["e"] = np.stack([np.bincount(at, w * back[row, d], BUCKETS) for d in range(DIM)], 1).astype(np.float32)
            step += 1
            for k, x, rate in (("e", emb, 0.05), ("s", soft, 0.05), ("b", bias, 0.05)):
                g = grads[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * ((g * g if k != "e" else (g * g).sum() / ACTIVE) - v[k])
                x -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    direction = (soft[:, 1] - soft[:, 0]) * scale
    return Model((emb @ direction).astype(np.float32), float(bias[1] - bias[0]) - sampled + shift)


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "label", per_label: int = 2000, max_chars: int = 20_000,
        text_col: str = "text", key_col: str = "doc_id") -> Model:
    """Fit on about ``per_label`` texts of each label (0 and 1), those of at most ``max_chars`` characters.

    ``labels``: ``key_col`` and ``label_col``. The sample's sparse bags are made on the executors;
    the driver receives about 2 * ``per_label`` of them, each with no more than ``max_chars`` * 4
    entries. Rows repeated under one id all enter the fit; NULL ids and labels do not, nor do NULL
    texts. Empty tables, and labels of one kind, give a model that scores every text the share of label 1.
    """
    known = labels.where(F.col(label_col).isin(0, 1))
    share = known.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    sample = sampled_texts(documents, labelled_sample(known, label_col, per_label, key_col), max_chars, text_col, key_col)
    rows = sample.mapInPandas(_bags, "label int, at binary, weight binary").collect()
    rows = sorted(rows, key=lambda r: (r["label"], bytes(r["at"])))
    bags = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["weight"], np.float32)) for r in rows]
    return train(bags, np.array([r["label"] for r in rows], np.int64), float(share or 0.0))


def score(model: Model) -> Callable[[Column], Column]:
    """Column function ``text -> score`` (0 to 1). NULL, empty and wordless texts score the bias alone."""

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score_text(t) for t in texts], dtype="float64")

    return toxicity


def scored(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Columns doc_id, score, predicted for every row; repeated rows and ties are scored alike.

    Whole texts are scored, block by block, whatever their length; a score equal to ``threshold``
    is predicted 1. NULL and empty texts score the bias alone; an empty table gives no rows.
    """
    s: Column = score(model)(F.col(text_col))
    return documents.select("doc_id", s.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
