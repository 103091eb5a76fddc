"""Exact dedup: a 128-bit content hash groups equal texts, bytes are compared within groups.

Texts are equal when identical after deleting every byte of [\\x20\\x09-\\x0D].  Null text counts as empty, and all empty
texts are equal.  Of a group the row with the most code points, then the smallest doc_id stays (a null doc_id last);
rows with one doc_id are told apart by content, and rows with one doc_id, equal texts and as many code points all carry
the same keep_id and kept flag; ``keep_one`` keeps one of them.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, byte_texts, cut, documents, in_bitmap

GAPS = b" \t\n\x0b\x0c\r"


def content_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def normal(text: bytes) -> bytes:
    return text.translate(None, GAPS)


def _groups(docs: DataFrame, digest: Callable[[bytes], bytes] = content_hash) -> DataFrame:
    """(doc_id, n code points, keep_id, group_size, kept, text_sha256), a row per document.

    First pass: hash and length of each text.  Second pass, only over texts whose hash others share (found by a bitmap
    of fixed size, then exactly): distinct bytes of each hash, grouped partially before the shuffle, so thousands of
    copies travel as one.  Hashes with several different contents are split by content.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = byte_texts(b.column(1))
            texts = [normal(t) for t in raw]
            keys = [digest(t) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0).cast(pa.int64()),
                    "h": pa.array(keys, pa.binary()),
                    "slot": pa.array([int.from_bytes(k[:8].ljust(8, b"\0"), "little", signed=True) for k in keys], pa.int64()),
                    "n": pa.array([len(t.decode("utf-8", "replace")) for t in raw], pa.int64()),
                    "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                }
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(texts.mapInArrow(hashed, "doc_id long, h binary, slot long, n long, sha string"), "dedup-hashes")
    shared = cut(rows.groupBy("h", "slot").count().where("count > 1").select("h", "slot"), "dedup-shared")
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(shared, "slot"))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            found = [normal(t) for t in byte_texts(b.column(1))]
            keys = [digest(t) for t in found]
            slots = np.array([int.from_bytes(k[:8].ljust(8, b"\0"), "little", signed=True) for k in keys], np.int64)
            keep = np.flatnonzero(in_bitmap(marks.value, slots)) if len(slots) else []
            ids = b.column(0).cast(pa.int64()).take(pa.array(keep, pa.int64()))
            columns = [ids, *(pa.array([x[i] for i in keep], pa.binary()) for x in (keys, found))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "content"])

    near = texts.mapInArrow(suspects, "doc_id long, h binary, content binary")
    contents = near.groupBy("h", "content").agg(F.count(F.lit(1)).alias("n"))
    clash = cut(contents.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("h"), "dedup-clashes")
    if clash.isEmpty():
        keyed = rows.withColumn("variant", F.lit(0))
    else:
        several = near.join(clash, "h").select("doc_id", "h", "content")
        order = several.select("h", "content").distinct().withColumn("variant", F.dense_rank().over(Window.partitionBy("h").orderBy("content")))
        apart = several.join(order, ["h", "content"]).select("doc_id", "h", F.sha2("content", 256).alias("sha"), "variant").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (rows.h == apart.h) & (rows.sha == apart.sha)
        keyed = rows.join(apart.withColumnRenamed("doc_id", "d"), same, "left")
        keyed = keyed.select(rows.doc_id, rows.h, "n", rows.sha, F.coalesce("variant", F.lit(0)).alias("variant"))
    best = F.max(F.struct("n", (-F.col("doc_id")).alias("id")))
    groups = keyed.groupBy("h", "variant").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    out = keyed.join(groups, ["h", "variant"])
    keep = -F.col("best.id")
    kept = F.col("doc_id").eqNullSafe(keep) & (F.col("n") == F.col("best.n"))
    return out.select("doc_id", "n", keep.alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_groups(docs: DataFrame, digest: Callable[[bytes], bytes] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per document."""
    return _groups(docs, digest).drop("n")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without the copies: one row of each group, whole.

    Where several rows of one doc_id may stay, the least of them as JSON does.
    """
    rows = _groups(docs).where("kept").groupBy("doc_id", "text_sha256", "n").agg(F.count(F.lit(1)).alias("many"))
    rows = cut(rows.toDF("_doc_id", "_sha", "_n", "many"), "dedup-kept")
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(F.translate(text, GAPS.decode(), ""), 256)
    docs = docs.select("doc_id", sha.alias("sha"), F.char_length(text).cast("long").alias("n"), F.struct("*").alias("row"))
    same = docs["doc_id"].eqNullSafe(rows["_doc_id"]) & (docs["sha"] == rows["_sha"]) & (docs["n"] == rows["_n"])
    out = docs.join(rows, same, "left_semi")
    if not rows.where("many > 1").isEmpty():
        out = out.groupBy("doc_id", "sha", "n").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.select("row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""
QUERIES, SQL = {"op4_exact_dedup": op4_exact_dedup}, {"op4_exact_dedup": OP4_SQL}
