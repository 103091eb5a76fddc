"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks boundaries; before the usual chunk length a boundary needs more zero bits than
after it (normalised chunking), so lengths stay near the usual and an edit moves only the boundaries beside it.  The
fingerprint is the set of chunk digests, each with its length; likeness is containment: the shared chunks' length over
the length of all chunks of the first (two empty ones: 1, an empty and another: 0).

Null text counts as empty.  Rows are ordered by doc_id (null first), then by text; each one's next is the row after it,
the last one's the first.  One row alone is its own next.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, documents, partitions

LEAST, USUAL, MOST = 16, 64, 384
#: Zero bits asked for before and after the usual length.
STRICT, LOOSE = 7, 5
GEAR = np.random.default_rng(20240602).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' gear values, each shifted by its distance; by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k].copy() << np.uint32(k)
    return h


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after bytes whose hash has STRICT zero bits, and LOOSE ones; a long text is read in windows."""
    strict, loose = [], []
    for at in range(0, len(data), BLOCK):
        before = min(at, 31)
        h = gear(data[at - before : at + BLOCK])[before:]
        for out, bits in ((strict, STRICT), (loose, LOOSE)):
            out.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + at + 1)
    return np.concatenate(strict), np.concatenate(loose)


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    strict, loose = marks(data)
    ends, at = [], 0
    while n - at > LEAST:
        early = np.searchsorted(strict, at + LEAST)
        late = np.searchsorted(loose, at + USUAL)
        end = min(n, at + MOST)
        if late < len(loose):
            end = min(end, int(loose[late]))
        if early < len(strict):
            end = min(end, int(strict[early]))
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def fingerprint(text: bytes) -> dict[str, int]:
    """Chunk digests with their lengths."""
    ends = boundaries(np.frombuffer(text, np.uint8))
    out: dict[str, int] = {}
    for a, b in zip([0, *ends], ends):
        out[hashlib.blake2b(text[a:b], digest_size=8).hexdigest()] = b - a
    return out


def written(print_: dict[str, int]) -> str:
    return " ".join(f"{d}:{n}" for d, n in sorted(print_.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    whole = sum(a.values())
    if not whole:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / whole


def range_of(edges: list[int], value: Column) -> Column:
    """How many of the ascending edges are at most ``value``: found in two steps, each over about the root of their number."""
    wide = max(1, round(len(edges) ** 0.5))
    parts = [edges[i : i + wide] for i in range(0, len(edges), wide)]

    def longs(text: str) -> Column:
        return F.split(F.lit(text), ",").cast("array<long>")

    if not parts:
        return F.lit(0)
    coarse = F.size(F.filter(longs(",".join(str(p[0]) for p in parts)), lambda c: c <= value))
    fine = F.split(F.lit(";".join(",".join(map(str, p)) for p in parts)), ";")
    inside = F.size(F.filter(F.split(F.element_at(fine, F.greatest(coarse, F.lit(1))), ",").cast("array<long>"), lambda c: c <= value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * wide + inside)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, edited, edited_fingerprint, near_edited, near_next).

    Rows are dealt by range of doc_id and sorted within ranges; a range also gets the first document of the next range
    with rows (the last one the very first), so texts are shuffled once and no task holds more than one document and its
    next.  Rows with one doc_id go through one task, one after another.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    shares = [i / parts for i in range(1, parts)]
    cuts = ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", shares, 0.2 / parts) if shares else []
    edges = sorted({int(c) for c in cuts})
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(range_of(edges, F.col("doc_id")))
    found = (F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null"))
    firsts = ids.select("doc_id", part.alias("part")).groupBy("part").agg(*found).orderBy("part").collect()
    # one row a range: its first doc_id goes to the range before as well
    heads = [(None if r["null"] else r["first"], r["part"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    known = spark.createDataFrame(heads, "head long, own int, before int")
    dealt = rows.withColumn("part", part).withColumn("extra", F.lit(0))
    # heads by id: at most one a range, so the broadcast has as many rows as there are partitions
    lent = rows.join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("head")))
    lent = lent.groupBy("before").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
    lent = lent.select("doc_id", "text", F.col("before").alias("part"), F.lit(1).alias("extra"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = None, 0
        out: list[tuple] = []

        def emit(nxt: tuple) -> None:
            nonlocal size
            doc, text, mine = held[0], held[1], held[2]
            k = len(text) // 4
            edited = text[: len(text) - k] + nxt[1][:k]
            theirs = fingerprint(edited.encode())
            size += len(text)
            out.append((doc, text, written(mine), edited, written(theirs), containment(mine, theirs), containment(mine, nxt[2])))

        def batch() -> pa.RecordBatch:
            nonlocal size
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ("doc_id", "text", "fingerprint", "edited", "edited_fingerprint", "near_edited", "near_next")
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
            size = 0
            return made

        for b in batches:
            for doc, text, extra, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "extra", "part"))):
                row = (doc, text, fingerprint(text.encode()), at)
                if held is not None:
                    if held[3] != at:
                        raise RuntimeError("a range without the first row of the next")
                    emit(row)
                held = None if extra else row
                if len(out) >= 200 or size > BLOCK:
                    yield batch()
        if out:
            yield batch()

    sent = dealt.unionByName(lent).repartition(parts, "part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "text")
    texts = "doc_id long, text string, fingerprint string, edited string, edited_fingerprint string"
    return sent.mapInArrow(scan, f"{texts}, near_edited double, near_next double")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = fingerprints(documents(spark, sf_dir))
    n_chars, edited = F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    return out.select("doc_id", n_chars, edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES, SQL = {"op10_fingerprints": op10_fingerprints}, {}
