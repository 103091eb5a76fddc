"""Sparse logistic regression with follow-the-regularised-leader updates, and bounded labelled samples to train it on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_texts, rows_of


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string")) % n


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; coordinate 0 is the bias."""

    def __init__(self, size: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * self.weights(at)
        self.n[at] = n + gradient**2


def sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, text, y): up to ``most`` labelled rows that ``learn`` allows, those with the smallest hash of doc_id.

    Ids are chosen before any text is read; as ``most`` bounds them they are broadcast.  Null labels are left out.
    """
    rows = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def trained(sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights that ``fit(texts, labels)`` finds; it runs in one task, over a sample of bounded size in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += byte_texts(b.column("text"))
            y += b.column("y").to_pylist()
        yield pa.RecordBatch.from_pydict({"w": pa.array([fit(texts, np.array(y, float)).astype(np.float32).tobytes()], pa.binary())})

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    row = ordered.mapInArrow(run, "w binary").first()
    return np.frombuffer(row["w"], np.float32) if row else fit([], np.zeros(0)).astype(np.float32)  # no labelled row: no task


def scored(docs: DataFrame, weights: np.ndarray, features: Callable[[], Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]]]) -> DataFrame:
    """(doc_id, score): sparse dot products of every whole text with the weights."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, w = features(), shared.value
        for ids, block in blocks(rows_of(batches)):
            s = [float(w[at] @ x) for at, x in extract(block)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(sigmoid(np.array(s, float)))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def verdicts(scores: DataFrame, n: int, held: int, least: float) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", n) == held, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def split_by_doc(at: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(doc, kind="stable")
    return np.split(at[order], np.searchsorted(doc[order], np.arange(1, n)))
