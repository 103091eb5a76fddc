"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a trigram binds its three letters' vectors, permuted by place; a text
bundles its trigrams by count; a language bundles its documents' vectors, each of length 1.  A text gets the language
whose prototype is nearest by cosine; the score is that cosine (0 at least).

Learnt from every document with a lang in the training folds.  Null texts and texts without a letter are ``und`` with
score 0, as is every text where nothing could be learnt; repeated rows agree; ties go to the first lang by code point; a
null doc_id isn't held out; more than ``LANGS`` languages are an error; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .ftrl import fold

SIZE = 512
TABLE = 1 << 14
#: Languages at most: what a task holds and the broadcast are bounded by it, more are an error.
LANGS = 4096
#: Characters of a text that are held as arrays at once.
WINDOW = 1 << 18


class Bundler:
    """Texts to bundled trigram vectors; trigram vectors are kept in a table of fixed size."""

    def __init__(self) -> None:
        every = [chr(i) for i in range(sys.maxunicode + 1)]
        self.lower = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in every], np.int64)
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.rows = np.zeros((TABLE, SIZE), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) > TABLE:
                self.letters.clear()
            self.letters[c] = np.random.default_rng(c).integers(0, 2, SIZE).astype(np.int8) * 2 - 1
        return self.letters[c]

    def _places(self, grams: np.ndarray) -> list[int]:
        out = []
        for g in grams.tolist():
            k = self.at.get(g)
            if k is None:
                k = self.at[g] = len(self.at)
                self.rows[k] = np.roll(self.letter(g >> 42), 2) * np.roll(self.letter((g >> 21) & 0x1FFFFF), 1) * self.letter(g & 0x1FFFFF)
            out.append(k)
        return out

    def _grams(self, text: str) -> Iterator[np.ndarray]:
        """Trigrams window by window: letters, runs of anything else as one gap, a gap at either end."""
        last = np.zeros(1, np.int64)
        for at in range(0, len(text), WINDOW):
            codes = self.lower[np.frombuffer(text[at : at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)]
            codes = codes[(codes != 0) | (np.append(last[-1:], codes[:-1]) != 0)]
            codes = np.append(last, codes)
            yield self._bound(codes)
            last = codes[-2:]
        if last[-1]:
            yield self._bound(np.append(last, 0))

    @staticmethod
    def _bound(codes: np.ndarray) -> np.ndarray:
        return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]

    def __call__(self, text: str | None) -> np.ndarray | None:
        """None without a letter."""
        total, any_ = np.zeros(SIZE, np.float32), False
        for found in self._grams(text or ""):
            grams, counts = np.unique(found, return_counts=True)
            any_ = any_ or len(grams) > 0
            for i in range(0, len(grams), TABLE):
                part = grams[i : i + TABLE]
                if len(self.at) + len(part) > TABLE:
                    self._clear()
                total += counts[i : i + TABLE].astype(np.float32) @ self.rows[self._places(part)].astype(np.float32)
        return total if any_ else None


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of the rows (text, lang) and their bundled vectors; each task sends one vector a language."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, total = Bundler(), {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (v := bundler(text)) is not None and (length := float(np.linalg.norm(v))):
                    total[lang] = total.get(lang, 0) + v / length
            if len(total) > LANGS:
                raise ValueError(f"more than {LANGS} languages")
        vectors = pa.array([v.astype(float).tolist() for v in total.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "v": vectors})

    sent = docs.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v"))
    sums = sent.groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).limit(LANGS + 1).collect()
    if len(rows) > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    vectors = np.array([[x["x"] for x in r["v"]] for r in rows], np.float32).reshape(len(rows), SIZE)
    return [r["lang"] for r in rows], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def predicted(docs: DataFrame, langs: list[str], vectors: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, vectors))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, (names, known) = Bundler(), shared.value
        for b in batches:
            langs, scores = [], []
            for text in b.column(1).to_pylist():
                v = bundler(text) if names else None
                near = known @ v / max(float(np.linalg.norm(v)), 1e-9) if v is not None else np.zeros(1)
                best = int(near.round(6).argmax())
                langs.append(names[best] if v is not None else "und")
                scores.append(min(1.0, max(0.0, float(near[best]))))
            columns = [b.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(compare, "doc_id long, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learn = docs.where((fold("doc_id", 5) != 0) & F.col("lang").isNotNull()).select("text", "lang")
    out = predicted(docs, *prototypes(learn))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES, SQL = {"op9_language": op9_language}, {}
