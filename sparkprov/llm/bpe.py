"""BPE encoding and decoding with a distinct-word table.

Texts are split into words (the pieces that byte-pair merges never cross) in chunks of whole documents.  A chunk numbers
its distinct words and keeps each document as the numbers of its words.  The words go to buckets by hash; a bucket
encodes each distinct word once and sends the ids back to the chunk, which joins them to its documents by position.
Decoding joins ids with the vocabulary's pieces.

A chunk's name is a digest of its content.  Should a lost task be run again and be dealt other rows (a scan of files
isn't), the names differ and the join fails for want of words; it can't mix two dealings.

Null text counts as empty: no ids, an empty text.  Rows with a null or repeated doc_id stay rows of their own.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blocks, documents, partitions, rows_of

#: Fixed value: the published pattern of byte-level BPE words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII and Latin-1 letters alone, which the standard library's matcher splits faster.
PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+", re.ASCII)
CHUNK_BYTES = 16 << 20
#: Words and ids that a task keeps at most; beyond, it forgets them and encodes words again when they come.
KNOWN_BYTES = 64 << 20
DOC_WORDS = 1 << 18


class Splitter:
    """Text to words; added tokens are words of their own."""

    def __init__(self, model: str):
        self.tokens = [x["content"] for x in json.loads(model)["added_tokens"]]
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.tokens, key=len, reverse=True))) + ")")
        self.any, self.plain = regex.compile(PATTERN).findall, PLAIN_PATTERN.findall

    def words(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or PLAIN.fullmatch(text) else self.any(text)

    def __call__(self, text: str) -> list[str]:
        if not any(t in text for t in self.tokens):
            return self.words(text)
        return [w for i, p in enumerate(self.added.split(text)) for w in ([p] if i % 2 else self.words(p))]


def pieces(model: str) -> list[bytes]:
    """The vocabulary's byte strings by id."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    place = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    read = json.loads(model)
    found = {i: bytes(place[c] for c in t) for t, i in read["model"]["vocab"].items() if all(c in place for c in t)}
    found |= {x["id"]: x["content"].encode() for x in read["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays of int32 (their bytes by place, as high ones repeat) and byte strings as one compressed value."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for p in parts]
    return zstandard.compress(np.array([len(raw), *map(len, raw)], "<i8").tobytes() + b"".join(raw), 1)


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = 8 * (n + 1) + np.cumsum([0, *np.frombuffer(raw, "<i8", n, 8)])
    return [raw[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist())]


def ints(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def pack_docs(ids: list, sizes: np.ndarray, numbers: np.ndarray) -> bytes:
    """Documents as their words' numbers: doc_ids, which of them are null, counts of words, numbers."""
    known = np.array([0 if i is None else i for i in ids], "<i8").tobytes()
    return pack(known, bytes(i is None for i in ids), sizes, numbers)


def chunk_name(ids: list, texts: list[bytes], *place: int) -> int:
    found = hashlib.blake2b(repr((place, ids, [len(t) for t in texts])).encode(), digest_size=8)
    for t in texts:
        found.update(t)
    return int.from_bytes(found.digest(), "little", signed=True)


def _packed(chunk: int, doc: bool, packed: bytes) -> pa.RecordBatch:
    columns = [pa.array([chunk], pa.int64()), pa.array([doc]), pa.array([packed], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc", "packed"])


def _send(model: Callable[[], str], parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks as rows of words by bucket (gaps of their ascending numbers, lengths, bytes) and rows of documents, dealt evenly."""

    def row(bucket: int, chunk: int, doc: bool, packed: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *_packed(chunk, doc, packed).columns], names=["bucket", "chunk", "doc", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part = Splitter(model()), TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(blocks(rows_of(batches), CHUNK_BYTES)):
            chunk = chunk_name(ids, texts, part, k)
            place: dict[str, int] = defaultdict()
            place.default_factory = place.__len__
            held = [np.array([place[w] for w in split(t.decode())], np.int32) for t in texts]
            every = np.concatenate(held)
            # frequent words get small numbers, equally frequent ones by their bytes: documents and words pack tighter
            words = [w.encode() for w in place]
            count = np.bincount(every, minlength=len(words)).tolist()
            order = sorted(range(len(words)), key=lambda i: (-count[i], words[i]))
            rank = np.zeros(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            every = rank[every]
            ends = np.cumsum([0, *map(len, held)])
            first = sent = 0
            for i in range(1, len(texts) + 1):
                if i == len(texts) or ends[i] - ends[first] > DOC_WORDS:
                    docs = pack_docs(ids[first:i], np.diff(ends[first : i + 1]), every[ends[first] : ends[i]])
                    yield row((chunk + sent) % parts, chunk, True, docs)
                    first, sent = i, sent + 1
            dealt: dict[int, tuple[list[int], list[bytes]]] = {}
            for number, i in enumerate(order):
                numbers, some = dealt.setdefault(zlib.crc32(words[i]) % parts, ([], []))
                numbers.append(number)
                some.append(words[i])
            for bucket, (numbers, some) in dealt.items():
                yield row(bucket, chunk, False, pack(np.diff(numbers, prepend=0), np.array([len(w) for w in some]), b"".join(some)))

    return run


def _encode_words(model: Callable[[], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words by bucket to their ids (gaps, counts of ids, ids), each distinct word encoded once; documents pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = Tokenizer.from_str(model())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, bytes] = {}
        size = 0
        for b in batches:
            for chunk, doc, packed in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if doc:
                    yield _packed(chunk, True, packed)
                    continue
                gaps, lengths, raw = unpack(packed)
                ends = np.cumsum([0, *ints(lengths)]).tolist()
                words = [raw[x:y] for x, y in zip(ends, ends[1:])]
                if size > KNOWN_BYTES:
                    known, size = {}, 0
                new = [w for w in words if w not in known]
                for i in range(0, len(new), 1024):
                    some = new[i : i + 1024]
                    for w, e in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                        known[w] = struct.pack(f"<{len(e)}i", *e.ids)
                        size += 200 + len(w) + len(known[w])
                found = [known[w] for w in words]
                out = pack(ints(gaps), np.array([len(x) // 4 for x in found]), np.frombuffer(b"".join(found), "<i4"))
                yield _packed(chunk, False, out)

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, words before documents, to (doc_id, ids); one chunk's words are held at a time."""
    current, whole, tables = None, None, []
    start = count = flat = np.zeros(0, np.int64)
    for b in batches:
        for chunk, doc, packed in zip(*(b.column(i).to_pylist() for i in range(3))):
            if chunk != current:
                current, tables = chunk, []
            if not doc:
                gaps, counts, found = (ints(x) for x in unpack(packed))
                tables.append((np.cumsum(gaps), counts, found))
                continue
            if tables:
                numbers, counts, flat = (np.concatenate([t[i] for t in tables]).astype(np.int64) for i in range(3))
                start, count = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
                start[numbers], count[numbers] = np.cumsum(counts) - counts, counts
                tables, whole = [], chunk
            ids, null, sizes, words = unpack(packed)
            ids, null, words = np.frombuffer(ids, "<i8"), np.frombuffer(null, bool), ints(words)
            if len(words) and (whole != chunk or words.max() >= len(count) or not count[words].all()):
                raise RuntimeError("a chunk's words and documents come from different dealings of rows")
            ends = np.concatenate([[0], np.cumsum(ints(sizes), dtype=np.int64)])
            for lo in range(0, len(ids), 64):
                hi = min(lo + 64, len(ids))
                w = words[ends[lo] : ends[hi]]
                n = count[w]
                at = np.concatenate([[0], np.cumsum(n)])
                values = flat[np.repeat(start[w] - at[:-1], n) + np.arange(at[-1])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at[ends[lo : hi + 1] - ends[lo]], pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64(), mask=null[lo:hi]), lists], names=["doc_id", "ids"])


def _by_chunk(docs: DataFrame, model: str) -> DataFrame:
    """Encoded words and documents of each chunk together, words first."""
    spark = docs.sparkSession
    parts, shared = partitions(spark), spark.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = texts.mapInArrow(_send(lambda: shared.value, parts), "bucket int, chunk long, doc boolean, packed binary")
    rows = sent.repartition(parts, "bucket").mapInArrow(_encode_words(lambda: shared.value), "chunk long, doc boolean, packed binary")
    return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "doc")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document; ``model`` is the tokenizer's JSON text."""
    return _by_chunk(docs, model).mapInArrow(_assemble, "doc_id long, ids array<int>")


def _lists(column: pa.Array) -> Iterator[list[int]]:
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum([0, *(x or 0 for x in pc.list_value_length(column).to_pylist())]).tolist()
    return (flat[x:y] for x, y in zip(ends, ends[1:]))


def _join_pieces(table: Callable[[], list[bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = table().__getitem__
        for whole in batches:
            for b in (whole.slice(i, 64) for i in range(0, len(whole), 64)):
                texts = [b"".join(map(piece, ids)).decode("utf-8", "replace") for ids in _lists(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text): each id joined with its piece; the vocabulary, of fixed size, is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces(model))
    return rows.select("doc_id", "ids").mapInArrow(_join_pieces(lambda: shared.value), "doc_id long, ids array<int>, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    for b in batches:
        ids = list(_lists(b.column(1)))
        hashes = [sha(",".join(map(str, x))) for x in ids], [sha(x) for x in b.column(2).to_pylist()]
        columns = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), *(pa.array(h, pa.string()) for h in hashes)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(pieces(model))
    join = _join_pieces(lambda: shared.value)
    # encode, decode and digests in one Python process a task
    return _by_chunk(docs, model).mapInArrow(lambda b: _digest(join(_assemble(b))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES, SQL = {"op6_bpe": op6_bpe}, {}
