"""Toxicity: a counterfactual-regularised linear classifier.

A text's features are its words and the beginnings of its words, each present or absent.  While training, a labelled
sentence that names a group is scored a second time with its identity terms swapped, and the squared change of the score
is penalised; so a neutral mention of a group by itself moves no score.  Learnt from at most ``SAMPLE`` labelled rows.

Null and empty texts score by bias alone; with no labels every score is 0.5; repeated rows score alike; a null doc_id
isn't held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, WordHasher, documents
from .ftrl import Ftrl, fold, labelled_sample, scored, sigmoid, split_by_doc, trained, verdicts

BITS = 20
SAMPLE = 16000
EPOCHS = 4
PREFIXES = (3, 4, 5, 6, 7, 8)
PENALTY = 0.5
LETTERS_ONLY = bytes(i for i in range(128) if not chr(i).isalpha())
#: Identity terms, in classes whose members are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "locals"),
    ("deaf", "blind", "disabled", "elderly", "young"),
)


class Features:
    def __init__(self) -> None:
        self.words = WordHasher(space=LETTERS_ONLY)

    def __call__(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(texts) == 1 and len(texts[0]) > 2 * BLOCK:  # in windows; of a word longer than one its beginning counts
            parts = [self([t[:BLOCK] if word else t])[0][0] for t, word in self.words.windows(texts[0])]
            at = np.unique(np.concatenate(parts))
            return [(at, np.ones(len(at)))]
        words = self.words(texts)
        found = [(words.h, words.doc), *(words.prefixes(k) for k in PREFIXES)]
        at = np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for h, _ in found])
        each = split_by_doc(at, np.concatenate([d for _, d in found]), len(texts))
        out = []
        for x in each:
            x = np.unique(x)
            x = np.append(0, x[x > 0])
            out.append((x, np.ones(len(x))))
        return out


def swapper(classes: tuple[tuple[str, ...], ...] = IDENTITY):
    """text -> the text with each identity term replaced by the next of its class."""
    after = {a.encode(): b.encode() for terms in classes for a, b in zip(terms, terms[1:] + terms[:1])}
    found = re.compile(rb"\b(" + b"|".join(sorted(after, key=len, reverse=True)) + rb")\b", re.I)
    return lambda text: found.sub(lambda m: after[m[0].lower()], text)


def fit(texts: list[bytes], y: np.ndarray, penalty: float = PENALTY, classes: tuple[tuple[str, ...], ...] = IDENTITY) -> np.ndarray:
    model, extract, swap = Ftrl(1 << BITS, alpha=1.0, l1=2.5, l2=0.1), Features(), swapper(classes)

    def vectors(block: list[bytes]) -> list[np.ndarray]:
        return [at for at, _ in extract(block)]

    rows = [v for i in range(0, len(texts), 64) for v in vectors(texts[i : i + 64])]
    swapped = {i: vectors([s])[0] for i, t in enumerate(texts) if (s := swap(t)) != t}
    for _ in range(EPOCHS):
        for i, (at, label) in enumerate(zip(rows, y)):
            s = float(model.weights(at).sum())
            gradient = np.full(len(at), float(sigmoid(s)) - label)
            if i in swapped and penalty:
                other = swapped[i]
                both = np.union1d(at, other)
                change = np.isin(both, at).astype(float) - np.isin(both, other)
                pull = 2 * penalty * (s - float(model.weights(other).sum())) * change
                gradient = np.where(np.isin(both, at), float(sigmoid(s)) - label, 0.0) + pull
                at = both
            model.step(at, gradient)
    return model.weights()


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, score) of every document; labels of rows in the held-out fold are never read."""
    sample = labelled_sample(docs, labels, "toxic", fold("doc_id", folds) != held, SAMPLE)
    return scored(docs, trained(sample, fit), Features)


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose score stays below ``least``; learnt from all labelled rows' folds but the held-out one."""
    sample = labelled_sample(docs, labels, "toxic", fold("doc_id", 5) != 0, SAMPLE)
    weights = docs.sparkSession.sparkContext.broadcast(trained(sample, fit))

    def run(batches):
        import pyarrow as pa

        from .common import blocks, byte_texts

        extract, w = Features(), weights.value
        for b in batches:
            texts, keep = byte_texts(b.column("text")), []
            for _, block in blocks(enumerate(texts)):
                keep += [float(sigmoid(float(w[at] @ x))) < least for at, x in extract(block)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return verdicts(toxicity_scores(documents(spark, sf_dir), labels), 5, 0, 0.5)


QUERIES, SQL = {"op8_toxicity": op8_toxicity}, {}
