"""Language ID: cosine to the nearest of several clustered TF-IDF centroids per language.

A text is a normalised TF-IDF vector of hashed letter n-grams (1 to 3). The training vectors of
each language are clustered by spherical k-means; a text takes the language of the centroid with
the largest cosine. A text whose distance to it is larger than that of nearly all training texts
of the language is rejected.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import labelled_sample, sampled_texts
from landwatch.llm.ngrams import blocks, codes

BITS = 12
BUCKETS = 1 << BITS
UNKNOWN = "und"


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None for a text without a letter."""
    if not text or not any(ch.isalpha() for ch in text):
        return None
    total = np.zeros(BUCKETS, np.int64)
    for c in blocks(codes(text), 3):
        h = c
        for n in (1, 2, 3):
            if n > 1:
                if len(c) < n:
                    break
                h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            at = ((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            total += np.bincount(at, minlength=BUCKETS)
    return total


def weighted(total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vector, with logarithmic term counts."""
    v = np.log1p(total) * idf
    return (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


def _count_rows(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for pdf in batches:
        found = [(label, counts(text)) for label, text in zip(pdf["label"], pdf["text"])]
        found = [(label, c.astype(np.float32).tobytes()) for label, c in found if c is not None]
        yield pd.DataFrame({"label": [x[0] for x in found], "counts": [x[1] for x in found]})


class Model:
    """Centroids (a few per language), the language of each, and the least cosine accepted for each."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], least: np.ndarray):
        self.idf, self.centroids, self.langs, self.least = idf, centroids, langs, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language of the nearest centroid, its cosine, and whether it is too far away to be accepted."""
        c = counts(text)
        if c is None or not self.langs:
            return UNKNOWN, 0.0, True
        cos = self.centroids @ weighted(c, self.idf)
        k = int(cos.argmax())
        return self.langs[k], float(min(max(cos[k], 0.0), 1.0)), bool(cos[k] < self.least[k])


def cluster(vectors: np.ndarray, k: int, rounds: int = 15, seed: int = 11) -> np.ndarray:
    """Spherical k-means; the first centroids are spread by distance. Fewer rows than ``k``: one each."""
    rng = np.random.default_rng(seed)
    chosen = [vectors[rng.integers(len(vectors))]]
    near = vectors @ chosen[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(vectors[int(near.argmin())])
        near = np.maximum(near, vectors @ chosen[-1])
    cent = np.stack(chosen)
    for _ in range(rounds):
        owner = (vectors @ cent.T).argmax(1)
        for i in range(len(cent)):
            own = vectors[owner == i]
            if len(own):
                mean = own.mean(0)
                cent[i] = mean / max(np.linalg.norm(mean), 1e-12)
    return cent


def fit(labelled: DataFrame, lang_col: str = "lang", max_rows: int = 2000, clusters: int = 4, accept: float = 0.995,
        max_chars: int = 20_000, text_col: str = "text", key_col: str = "doc_id") -> Model:
    """Fit on about ``max_rows`` texts over all languages, as many of each, of at most ``max_chars`` characters.

    Counts are made on the executors; the driver receives ``max_rows`` rows of ``BUCKETS`` floats.
    Per centroid, the nearest ``accept`` share of its training texts sets the accepted distance.
    Rows with a NULL text, language or id teach nothing, rows repeated under one id as often as
    they occur. From an empty table a model is learned that knows no language.
    """
    known = labelled.where(F.col(lang_col).isNotNull())
    n_langs = known.select(lang_col).distinct().count()
    sample = labelled_sample(known, lang_col, max(1, max_rows // max(1, n_langs)), key_col)
    sample = sampled_texts(known, sample, max_chars, text_col, key_col)
    rows = sorted(sample.mapInPandas(_count_rows, "label string, counts binary").collect(), key=lambda r: (r["label"], bytes(r["counts"])))
    if not rows:
        return Model(np.ones(BUCKETS), np.zeros((0, BUCKETS), np.float32), [], np.zeros(0))
    raw = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows])
    labels = np.array([r["label"] for r in rows])
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 0.05
    vectors = np.stack([weighted(r, idf) for r in raw])
    cents, langs, least = [], [], []
    for lang in sorted(set(labels)):
        own = vectors[labels == lang]
        cent = cluster(own, clusters)
        cos = own @ cent.T
        owner = cos.argmax(1)
        for i in range(len(cent)):
            near = cos[owner == i, i]
            cents.append(cent[i])
            langs.append(str(lang))
            least.append(float(np.quantile(near, 1 - accept)) if len(near) else 1.0)
    return Model(idf, np.stack(cents).astype(np.float32), langs, np.array(least))


def identify(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns doc_id, lang_pred, score, rejected for every row, from its whole text only.

    ``und`` with score 0 where the text is NULL or has no letter. ``rejected``: the text is farther
    from the nearest centroid than accepted; lang_pred still names the nearest language. Of
    centroids at the same cosine the first counts, in order of language. Long texts are counted
    whole, block by block; repeated rows get equal rows, an empty table none; other columns are not read.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return documents.select("doc_id", nearest(F.col(text_col)).alias("_lang")).select("doc_id", "_lang.*")
