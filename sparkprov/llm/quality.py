"""Quality classifier: hashed word n-gram logistic regression by FTRL, scored as sparse dot products.

Words and word shapes (runs of letters, capitals, digits and each mark) give n-grams of one and two words and up to
three shapes, hashed to 2**18 coordinates.  Learnt from at most ``SAMPLE`` labelled rows.  Null and empty texts score by
bias alone; with no labels every score is 0.5; repeated rows score alike; a null doc_id isn't held out; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, documents, mix
from .ftrl import Ftrl, fold, labelled_sample, scored, sigmoid, split_by_doc, trained, verdicts

BITS = 18
SAMPLE = 8000
EPOCHS = 3


class Features:
    """Texts to sparse vectors: square roots of the n-grams' shares among those of their kind, and the length's logarithm."""

    def __init__(self) -> None:
        self.words = WordHasher()
        self.shapes = WordHasher(fold=False)
        kind = np.arange(256, dtype=np.uint8)
        kind[97:123], kind[65:91], kind[48:58], kind[128:] = ord("a"), ord("A"), ord("0"), ord("a")
        self.kind = kind

    def __call__(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        shape = self.kind[raw]
        keep = np.append(True, shape[1:] != shape[:-1]) | self.shapes.space[shape]
        ends = np.append(0, np.cumsum(keep))[first]
        shape = shape[keep].tobytes()
        shapes = [shape[a : b - 1] for a, b in zip(ends, ends[1:])]
        found, owner = [], []
        for salt, (h, doc) in enumerate((self.words.hashes(texts), self.shapes.hashes(shapes))):
            for n in (1, 2, 3)[: 2 + salt]:
                if len(h) < n:
                    continue
                g = mix(h[: len(h) - n + 1], 20 + 3 * salt + n)
                for i in range(1, n):
                    g = mix(g + h[i : len(h) - n + 1 + i], 30)
                same = doc[: len(h) - n + 1] == doc[n - 1 :]
                found.append((g[same] >> np.uint64(64 - BITS + 2)).astype(np.int64) * 4 + (2 * salt + (n > 1)))
                owner.append(doc[: len(h) - n + 1][same])
        empty = np.zeros(0, np.int64)
        each = split_by_doc(np.concatenate([empty, *found]), np.concatenate([empty, *owner]), len(texts))
        out = []
        for at, t in zip(each, texts):
            at, n = np.unique(at, return_counts=True)
            part = np.bincount(at & 3, n, minlength=4)
            x = np.sqrt(n / np.maximum(part, 1)[at & 3])
            out.append((np.append(at[at > 3], [0, 1]), np.append(x[at > 3], [1.0, np.log1p(len(t)) / 10])))
        return out


def fit(texts: list[bytes], y: np.ndarray) -> np.ndarray:
    model = Ftrl(1 << BITS, alpha=0.3, l1=0.05, l2=1.0)
    extract = Features()
    rows = [v for i in range(0, len(texts), 64) for v in extract(texts[i : i + 64])]
    for _ in range(EPOCHS):
        for (at, x), label in zip(rows, y):
            p = sigmoid(float(model.weights(at) @ x))
            model.step(at, (p - label) * x)
    return model.weights()


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, score) of every document; labels of rows in the held-out fold are never read."""
    sample = labelled_sample(docs, labels, "quality", fold("doc_id", folds) != held, SAMPLE)
    return scored(docs, trained(sample, fit), Features)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return verdicts(quality_scores(documents(spark, sf_dir), labels), 4, 2, 0.7)


QUERIES, SQL = {"op7_quality": op7_quality}, {}
