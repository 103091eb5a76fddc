"""Shared pieces: the cluster's shared folder, vectorised word hashing, fixed-size sketches, links to components."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import cut, drop, shared_dir  # noqa: F401  for the operators

BLOCK = 1 << 20
U64 = np.uint64


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(rows: Iterable[tuple[object, bytes]], size: int = BLOCK) -> Iterator[tuple[list, list[bytes]]]:
    """Rows (key, text) in lists of about ``size`` bytes, so that temporary arrays stay small."""
    keys, texts, n = [], [], 0
    for k, t in rows:
        if texts and n + len(t) > size:
            yield keys, texts
            keys, texts, n = [], [], 0
        keys.append(k)
        texts.append(t)
        n += len(t) + 1
    if texts:
        yield keys, texts


def rows_of(batches: Iterable[pa.RecordBatch], key: str = "doc_id", text: str = "text") -> Iterator[tuple[object, bytes]]:
    for whole in batches:
        for b in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
            yield from zip(b.column(key).to_pylist(), byte_texts(b.column(text)))


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser, a different one for each salt."""
    h = h + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % 2**64)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class WordHasher:
    """64-bit hashes of all words of a block of texts at once.

    A word is a longest run of bytes that ``space`` doesn't mark; each byte has a random value (``fold`` gives A-Z those
    of a-z), a word's hash is a polynomial in an odd base, read off a running sum over the block.  Polynomials modulo
    2**64 of long words can be made to collide, so words of more than ``LONG`` bytes take a cryptographic digest instead.
    A text of any length is read in windows that end at gaps, a word longer than a window by its digest alone.
    """

    BASE = 0xD1342543DE82EF95
    LONG = 64

    def __init__(self, fold: bool = True, space: bytes = b" \t\n\x0b\x0c\r"):
        values = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)
        if fold:
            values[65:91] = values[97:123]
        self.values, self.space, self.fold = values, np.zeros(256, bool), fold
        self.space[list(space)] = True
        self.gap = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in space) + b"]")
        self._powers(BLOCK)

    def _powers(self, n: int) -> None:
        def run(x: int) -> np.ndarray:
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        self.up, self.down = run(self.BASE), run(pow(self.BASE, -1, 2**64))

    def scan(self, data: np.ndarray, first: np.ndarray) -> "Words":
        """Words of joined texts that begin at ``first``; a gap must end each text."""
        if len(data) > len(self.up):
            self._powers(2 * len(data))
        flips = np.flatnonzero(np.diff(self.space[data], prepend=True))
        starts, ends = flips[0::2], flips[1::2]
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=run[1:])
        words = Words(self, run, starts, ends, np.searchsorted(first, starts, side="right") - 1)
        for i in np.flatnonzero(ends - starts > self.LONG):
            words.h[i] = self.digest(data[starts[i] : ends[i]].tobytes())
        return words

    def digest(self, word: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(word.lower() if self.fold else word, digest_size=8).digest(), "little")

    def windows(self, text: bytes, size: int = BLOCK) -> Iterator[tuple[bytes, bool]]:
        """The text in pieces that end at gaps; True marks a piece that is one word longer than ``size``."""
        at = 0
        while at < len(text):
            found = self.gap.search(text, at + size)
            end = found.start() if found else len(text)
            if end - at > 2 * size:  # a long word stands at the end of the piece
                word = max((m.end() for m in self.gap.finditer(text, at, at + size)), default=at)
                if word > at:
                    yield text[at:word], False
                yield text[word:end], True
            else:
                yield text[at:end], False
            at = end

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and the number of each one's text; a long text alone is read in windows."""
        if len(texts) != 1 or len(texts[0]) <= 2 * BLOCK:
            words = self(texts)
            return words.h, words.doc
        pieces = self.windows(texts[0])
        h = np.concatenate([np.array([self.digest(t)], np.uint64) if word else self([t]).h for t, word in pieces])
        return h, np.zeros(len(h), np.int64)

    def __call__(self, texts: list[bytes]) -> "Words":
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return self.scan(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), first)


class Words:
    """Hashes of the words of a block (``h``), the number of each one's text (``doc``)."""

    def __init__(self, hasher: WordHasher, run: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray):
        self.hasher, self.run, self.starts, self.ends, self.doc = hasher, run, starts, ends, doc
        self.h = self._between(starts, ends)

    def _between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.run[ends] - self.run[starts]) * self.hasher.down[starts] + (ends - starts).astype(np.uint64))

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, doc) of the first ``k`` bytes of the words that are longer."""
        long = self.ends - self.starts > k
        starts = self.starts[long]
        return mix(self._between(starts, starts + k), 7), self.doc[long]


class Shingler:
    """Sets of hashed word shingles: ``k`` words each; the whole sequence as one where there are fewer; none without words."""

    def __init__(self, k: int = 5):
        self.k, self.words = k, WordHasher()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        h, doc = self.words.hashes(texts)
        n, k = len(texts), self.k
        count = np.bincount(doc, minlength=n)
        first = np.concatenate([[0], np.cumsum(count)])

        def chain(starts: np.ndarray, length: int) -> np.ndarray:
            out = np.full(len(starts), length, np.uint64)
            for i in range(length):
                out = mix(out * U64(0x2545F4914F6CDD1D) + h[starts + i])
            return out

        full = chain(np.arange(max(0, len(h) - k + 1)), k) if count.max(initial=0) >= k else np.zeros(0, np.uint64)
        out = [full[first[i] : first[i + 1] - k + 1] if count[i] >= k else np.zeros(0, np.uint64) for i in range(n)]
        out = [np.unique(x) if len(x) else x for x in out]
        for length in range(1, k):
            which = np.flatnonzero(count == length)
            for i, x in zip(which, chain(first[which], length)):
                out[i] = np.array([x], np.uint64)
        return out


def _parts(pieces: dict[int, np.ndarray], name: str) -> pa.RecordBatch:
    """Pieces of a vector as rows (part, bytes)."""
    packed = pa.array([x.tobytes() for x in pieces.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), packed], names=["part", name])


def summed(counts: DataFrame, cells: int, chunk: int) -> np.ndarray:
    """Add up rows (part int, counts binary) of int64 pieces of a fixed-size vector; ``cells`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, x in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
                x = np.frombuffer(x, np.int64)
                total[part] = total[part] + x if part in total else x
        yield _parts(total, "counts")

    out = np.zeros(cells, np.int64)
    parts = min(partitions(counts.sparkSession), -(-cells // chunk))
    for row in counts.select("part", "counts").repartition(parts, "part").mapInArrow(add, "part int, counts binary").collect():
        x = np.frombuffer(row["counts"], np.int64)
        out[row["part"] * chunk : row["part"] * chunk + len(x)] += x
    return out


def bitmap(ids: DataFrame, column: str, bits: int = 22) -> np.ndarray:
    """A one-hash Bloom filter of 2**bits bits over a long column; its size doesn't depend on the data.

    It may let others pass, never holds one back: an exact join has to follow.
    """
    words = 1 << (bits - 6)
    part = min(words, 1 << 12)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            x = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            seen[(mix(x) >> U64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(seen)
        step = part * 8
        pieces = {i: packed[i * step : (i + 1) * step] for i in range(len(packed) // step)}
        yield _parts({i: x for i, x in pieces.items() if x.any()}, "m")

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("part").to_pylist(), b.column("m").to_pylist()):
                x = np.frombuffer(x, np.uint8)
                total[i] = total[i] | x if i in total else x
        yield _parts(total, "m")

    out = np.zeros((1 << bits) // 8, np.uint8)
    marks = ids.select(column).mapInArrow(mark, "part int, m binary").repartition(min(16, words // part), "part")
    for row in marks.mapInArrow(union, "part int, m binary").collect():
        x = np.frombuffer(row["m"], np.uint8)
        out[row["part"] * part * 8 : row["part"] * part * 8 + len(x)] |= x
    return out


def in_bitmap(found: np.ndarray, x: np.ndarray) -> np.ndarray:
    bits = int(len(found) * 8).bit_length() - 1
    slot = (mix(x.astype(np.int64).view(np.uint64)) >> U64(64 - bits)).astype(np.int64)
    return (found[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """(node long, component long) for every node of ``links`` (a, b): the smallest node it reaches.

    Large-star and small-star rounds over written tables until each node hangs on one root that hangs on none; minima and
    roles are grouped partially before any shuffle, so a hub costs no more than its links.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(edges.distinct(), name)
    while not _stars(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = cut(after.where("a <> b").distinct(), name)
        drop(edges)
        edges = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether no node of ``edges`` (a, b), each pair once, hangs on two others or on one that hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()
