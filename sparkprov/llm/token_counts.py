"""Token counts from flat token files without an index: a separator scan.

A flat file holds token ids of fixed width, each document ended by an end-of-document id.  Blocks of every file are read
on their own and searched at once for that id; each block reports its separators, the tokens before the first and after
the last.  A prefix scan over the blocks' summaries stitches documents that span blocks and numbers documents in a file.

Tokens after the last separator count as a last document if there are any.  Two separators in a row enclose an empty
document.  Null and empty texts are written as empty documents; rows with a null or repeated doc_id stay rows of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, cut, documents, partitions, rows_of, shared_dir

EOD = 50256
BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, ranks: bytes, pattern: str, eod: int = EOD) -> tuple[str, DataFrame]:
    """Write flat files of two-byte ids to the shared folder: (folder, rows (file, ordinal, doc_id)).

    Each attempt of a task writes a file of its own name and reports that name, so a repeated task harms nothing.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    FileSystem.from_uri(shared_dir(spark))[0].create_dir(FileSystem.from_uri(folder)[1], recursive=True)
    shared = spark.sparkContext.broadcast(ranks)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        fs, path = FileSystem.from_uri(folder)
        end, ordinal = np.array([eod], "<u2").tobytes(), 0
        with fs.open_output_stream(f"{path}/{name}") as out:
            for ids, block in blocks(rows_of(batches)):
                for tokens in encoding.encode_ordinary_batch([t.decode() for t in block], num_threads=1):
                    out.write(np.array(tokens, "<u2").tobytes() + end)
                places = pa.array(range(ordinal, ordinal + len(ids)), pa.int64())
                rows = {"file": pa.array([name] * len(ids), pa.string()), "ordinal": places, "doc_id": pa.array(ids, pa.int64())}
                yield pa.RecordBatch.from_pydict(rows)
                ordinal += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "file string, ordinal long, doc_id long")
    return folder, cut(rows, "tokens-manifest")


def count_tokens(spark: SparkSession, folder: str, eod: int = EOD, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens): each document of each flat file in the folder."""
    if block_bytes % width:
        raise ValueError("a block holds whole tokens")
    listed = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))
    spans = listed.where("length > 0").select("file", "length", F.explode(numbers).alias("block"))
    longs = ("block", "k", "head", "tail")
    schema = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in longs), ("inner", pa.list_(pa.int64()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = FileSystem.from_uri(folder)
        for b in batches:
            for file, length, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                with fs.open_input_file(f"{path}/{file}") as f:
                    tokens = np.frombuffer(f.read_at(min(block_bytes, length - block * block_bytes), block * block_bytes), f"<u{width}")
                at = np.flatnonzero(tokens == eod)
                k = len(at)
                head, tail = (int(at[0]), len(tokens) - int(at[-1]) - 1) if k else (len(tokens), len(tokens))
                row = {"file": file, "block": block, "k": k, "head": head, "tail": tail, "inner": (np.diff(at) - 1).tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    kinds = f"file string, {', '.join(f'{c} long' for c in longs)}, inner array<long>"
    found = cut(spans.repartition(partitions(spark), "file", "block").mapInArrow(search, kinds), "tokens-blocks")
    order = Window.partitionBy("file").orderBy("block")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = found.select("file", "block", "k", "head", "tail").withColumn("seg", F.sum((F.col("k") > 0).cast("int")).over(up_to))
    rows = rows.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "seg").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0))).withColumn("before", F.sum("k").over(up_to) - F.col("k"))
    ends = rows.where("k > 0").join(found.select("file", "block", "inner"), ["file", "block"])
    closed = ends.select("file", "before", F.posexplode(F.concat(F.array(F.col("head") + F.col("carry")), "inner")).alias("pos", "n_tokens"))
    closed = closed.select("file", (F.col("before") + F.col("pos")).alias("ordinal"), "n_tokens")
    rest = rows.groupBy("file").agg(F.sum("k").alias("ordinal"), F.max_by("open", "block").alias("n_tokens")).where("n_tokens > 0")
    return closed.union(rest)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    folder, manifest = write_flat(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return manifest.join(count_tokens(spark, folder), ["file", "ordinal"]).select("doc_id", "n_tokens")


QUERIES, SQL = {"op2_token_counts": op2_token_counts}, {}
