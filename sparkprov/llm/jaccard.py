"""N-gram Jaccard join over a count-vector R-tree.

A document's set holds its distinct shingles of five words.  Two documents link when their sets' Jaccard similarity is
0.75 or more; each gets the smallest doc_id that links reach.

* Shingles are hashed to 64 bits; the hash's low bits give one of ``GROUPS`` groups, and the counts by group make the
  document a point.  Two points' summed coordinate minima bound the overlap of their sets from above.
* Points meet in cells: the cell of a shingle that is among the rarest quarter of both sets (any pair at 0.75 shares
  one).  Rarity is a fixed-size count over all shingles of the corpus; it orders, it never drops.  The rarest shingle a
  pair shares is among the rarest seventh of the set that isn't larger: only these postings look for partners, of their
  set's size to a third more.  Postings without such a partner go, and of cells with the same documents one stays.
* A large cell's points are packed into an R-tree (slabs by size, leaves by the slab's leading groups, boxes of
  coordinate maxima and size ranges); box bounds, then point bounds discard pairs, and the whole texts of the pairs left
  are compared.  One tree over all points would bound nothing: in so many dimensions every box overlaps every query.
* Families of near copies are first gathered by verified links to a leader, then by each cluster's tightest pair; pairs
  within a cluster are never listed.  The last search is exhaustive between the clusters left.
* A pair is listed where it meets first, not in each cell that it shares: points carry their node's EARLY least cells,
  and a meeting after a common one of these is passed over.  Where these hold no common cell, it is listed again.

A text's set is its 64-bit hashes and equal sets are those with equal size and equal 128-bit sums: results are exact but
for collisions of these hashes.  Words of up to 64 bytes have polynomial hashes, longer ones cryptographic digests.

Null or wordless text has an empty set, size 0, and stays alone.  Rows with one doc_id but different texts are nodes of
their own; a row's component is the smallest doc_id that its set reaches.  A null doc_id gives a null component and
links nothing.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Shingler, bitmap, blocks, components, cut, documents, drop, in_bitmap, mix, partitions, rows_of, summed

GROUPS = 256
MOST = (1 << 8) - 1
CELLS = 1 << 19
CHUNK = 1 << 13
LEAF, FAN, LEADING = 8, 64, 4
DIRECT = 32
PIECE = 4096
ROWS = 1 << 14
ROUNDS = 4
SUB = 8
EARLY = 8
NUM, DEN = 3, 4
#: Bytes of a posting: token, node, set size, whether it looks for partners.
POSTING = (("token", np.int64), ("node", np.int64), ("n", np.int32), ("small", bool))


def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of sets of n and m at NUM/DEN."""
    return -(-NUM * (n + m) // (NUM + DEN))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of two sorted sets of hashes at NUM/DEN or more."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or DEN * len(small) < NUM * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def point(s: np.ndarray) -> np.ndarray:
    """Counts by group; ``MOST`` stands for itself or more."""
    return np.minimum(np.bincount((s & U64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), MOST).astype(np.uint8)


def overlap_bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed coordinate minima, row by row; without bound where both counts of a group are ``MOST``."""
    least = np.minimum(p, q)
    total = least.sum(-1, dtype=np.int64)
    return np.where(least.max(-1) == MOST, np.iinfo(np.int64).max, total)


class CountTree:
    """R-tree over count vectors: slabs of FAN leaves by size, in a slab leaves of LEAF points by cluster and leading groups.

    Leading are the LEADING groups whose counts vary most; like points agree there, and near copies share a cluster, so
    they come into one leaf.  Leaves are small, as the maxima of many unlike points bound nothing.  Points of the asking
    cluster aren't wanted: leaves of nothing else are passed over.  ``discarded`` counts points by what left them out.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, clusters: np.ndarray | None = None):
        clusters = np.arange(len(sizes)) if clusters is None else clusters
        order, wide = np.argsort(sizes, kind="stable"), LEAF * FAN
        for i in range(0, len(order), wide):
            slab = order[i : i + wide]
            lead = np.argsort(points[slab].astype(np.float32).var(0), kind="stable")[-LEADING:]
            several = clusters[slab] if len(np.unique(clusters[slab])) < len(slab) else np.zeros(len(slab))
            order[i : i + wide] = slab[np.lexsort([*points[slab][:, lead].T, several])]
        self.order, self.points, self.sizes, self.clusters = order, points[order], sizes[order], clusters[order]
        self.slabs, self.leaves = (self._boxes(np.arange(0, len(order), step)) for step in (wide, LEAF))
        self.discarded: Counter = Counter()

    def _boxes(self, starts: np.ndarray) -> list[np.ndarray]:
        """Coordinate maxima, least and largest size, and the cluster where it is one, else -1."""
        low, high = (f.reduceat(self.clusters, starts) for f in (np.minimum, np.maximum))
        ends = [f.reduceat(self.sizes, starts) for f in (np.minimum, np.maximum)]
        return [np.maximum.reduceat(self.points, starts), *ends, np.where(low == high, low, -1), low == high]

    def _open(self, boxes: list[np.ndarray], at: np.ndarray, p: np.ndarray, n: int, cluster: int | None) -> np.ndarray:
        top, low, high, of, one = (x[at] for x in boxes)
        fits = (DEN * n >= NUM * low) & (DEN * high >= NUM * n)
        if cluster is not None:
            fits &= ~one | (of != cluster)
        at, top, low = at[fits], top[fits], low[fits]
        return at[overlap_bound(top, p) >= need(n, np.maximum(low, -(-NUM * n // DEN)))]

    def near(self, p: np.ndarray, n: int, cluster: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the given order) of the points that may be within reach of point p of size n, and their bounds;
        with a cluster, only of points in others."""
        slabs = self._open(self.slabs, np.arange(len(self.slabs[1])), p, n, cluster)
        at = (slabs[:, None] * FAN + np.arange(FAN)).ravel()
        leaves = self._open(self.leaves, at[at < len(self.leaves[1])], p, n, cluster)
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        if cluster is not None:
            wanted = int((self.clusters != cluster).sum())
            at = at[self.clusters[at] != cluster]
        else:
            wanted = len(self.sizes)
        self.discarded["box"] += wanted - len(at)
        m = self.sizes[at]
        fits = DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)
        self.discarded["size"] += int((~fits).sum())
        at, m = at[fits], m[fits]
        bound = overlap_bound(self.points[at], p)
        left = bound >= need(n, m)
        self.discarded["point"] += len(m) - int(left.sum())
        return self.order[at[left]], bound[left]


def _keyed(docs: DataFrame, salt: int) -> DataFrame:
    """(node, doc_id, text): the node is the doc_id, or with a salt a hash of doc_id and text."""
    doc = F.col("doc_id").cast("long")
    node = F.when(doc.isNotNull(), F.xxhash64(F.lit(salt), doc, "text")) if salt else doc
    return docs.select(node.alias("node"), doc.alias("doc_id"), "text")


def _profile(texts: DataFrame) -> DataFrame:
    """Rows (node, doc_id, n, fa, fb, m0.., point): set size, 128-bit set fingerprint, min-hashes, point; and each
    task's shingle counts (part, counts)."""
    names = ["node", "doc_id", "n", "fa", "fb", *(f"m{j}" for j in range(ROUNDS))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(), np.zeros(CELLS, np.int64)
        rows = ((key, text) for b in batches for key, text in _keys_and_texts(b))
        for keys, block in blocks(rows):
            sets = shingles(block)
            counts += np.bincount((np.concatenate(sets) >> U64(45)).astype(np.int64), minlength=CELLS)
            prints = np.array([[mix(s, salt).sum(dtype=np.uint64) for salt in (1, 2)] for s in sets], np.uint64).view(np.int64)
            least = np.array([[mix(s, 4 + j).min() if len(s) else 0 for j in range(ROUNDS)] for s in sets], np.uint64).view(np.int64)
            longs = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            longs += [pa.array(x) for x in (*prints.T, *least.T)]
            points = pa.array([point(s).tobytes() if len(s) else None for s in sets], pa.binary())
            none = pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())
            yield pa.RecordBatch.from_arrays([*longs, points, *none], names=[*names, "point", "part", "counts"])
        parts = [i for i in range(CELLS // CHUNK) if counts[i * CHUNK : (i + 1) * CHUNK].any()]
        packed = [counts[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in parts]
        none = [*(pa.nulls(len(parts), pa.int64()) for _ in names), pa.nulls(len(parts), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=[*names, "point", "part", "counts"])

    kinds = ", ".join(f"{c} long" for c in names)
    return texts.mapInArrow(scan, f"{kinds}, point binary, part int, counts binary")


def _keys_and_texts(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bytes]]:
    docs = batch.column("doc_id").to_pylist()
    for doc, (node, text) in zip(docs, rows_of([batch], "node")):
        yield (node, doc), text


def first(s: np.ndarray, counts: np.ndarray, keep: int) -> np.ndarray:
    """Marks the ``keep`` rarest members of a sorted set: by count, then by hash."""
    if keep >= len(s):
        return np.ones(len(s), bool)
    c = counts[(s >> U64(45)).astype(np.int64)]
    edge = np.partition(c, keep - 1)[keep - 1]
    sure = c < edge
    ties = np.flatnonzero(c == edge)[: keep - int(sure.sum())]  # s is sorted: ties go by hash
    sure[ties] = True
    return sure


def rarest(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a set that holds the rarest member shared with any set at NUM/DEN or more, and marks of the part
    that holds it when the other set isn't smaller: of n members at most n - need(n, n) are rarer, as the other lacks
    no more."""
    n = len(s)
    kept = s[first(s, counts, n - -(-NUM * n // DEN) + 1)]
    return kept, first(kept, counts, n - int(need(n, n)) + 1)


def partnered(token: np.ndarray, n: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Marks postings, sorted by token and size, that look for a partner of fitting size or are one."""
    cell = np.cumsum(np.append(True, token[1:] != token[:-1])[: len(token)]) << 36
    key = cell + n
    low = np.searchsorted(key, key, "left")
    high = np.searchsorted(key, cell + DEN * n.astype(np.int64) // NUM, "right")
    ask = small & (high - low > 1)
    step = np.bincount(low[ask], minlength=len(key) + 1) - np.bincount(high[ask], minlength=len(key) + 1)
    return np.cumsum(step)[: len(key)] > 0


def _postings(texts: DataFrame, counts: np.ndarray, parts: int) -> DataFrame:
    """(token, node, n, small) of the rarest quarters, in cells where sizes let two sets meet; ``small`` as by rarest.

    Tokens whose count stands out travel as rows of their own, dealt at random and left whole; the others packed by
    bucket, of which a task holds one at a time.
    """
    heavy, many = counts.mean() + 6 * np.sqrt(counts.mean()) + 500, parts * SUB
    shared = texts.sparkSession.sparkContext.broadcast((counts, heavy))
    names = ["bucket", *(c for c, _ in POSTING), "pack"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        cells, most = shared.value
        tokens, marks, owners, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not tokens:
                return
            each, m = [len(x) for x in tokens], np.concatenate(marks)
            t = np.concatenate(tokens)
            d, n = (np.repeat(np.array(x, np.int64), each) for x in zip(*owners))
            hot = cells[(t >> U64(45)).astype(np.int64)] > most
            if hot.any():
                salt = (mix(t[hot] ^ mix(d[hot].view(np.uint64))) % U64(many)).astype(np.int32)
                rows = [t[hot].view(np.int64), d[hot], n[hot].astype(np.int32), m[hot]]
                columns = [pa.array(salt), *map(pa.array, rows), pa.nulls(len(salt), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            bucket = (mix(t, 3) % U64(many)).astype(np.int32)[~hot]
            order = np.argsort(bucket, kind="stable")
            light = [x[~hot][order] for x in (t.view(np.int64), d, n, m)]
            columns = [x.astype(kind, copy=False) for x, (_, kind) in zip(light, POSTING)]
            full, start = np.unique(bucket[order], return_index=True)
            packs = [b"".join(x[i:j].tobytes() for x in columns) for i, j in zip(start, [*start[1:], len(order)])]
            none = [pa.nulls(len(full), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *none, pa.array(packs, pa.binary())], names=names)

        for ids, block in blocks(rows_of(batches, "node")):
            for doc, s in zip(ids, shingles(block)):
                if len(s) and doc is not None:
                    for to, x in zip((tokens, marks), rarest(s, cells)):
                        to.append(x)
                    owners.append((doc, len(s)))
                    size += len(tokens[-1])
            if size > 1 << 19:
                yield from flush()
                tokens, marks, owners, size = [], [], [], 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None

        def cells() -> pa.RecordBatch:
            width = sum(np.dtype(k).itemsize for _, k in POSTING)
            columns, at = [], 0
            for _, kind in POSTING:
                columns.append(np.concatenate([np.frombuffer(x, kind, len(x) // width, at * (len(x) // width)) for x in held]))
                at += np.dtype(kind).itemsize
            held.clear()
            order = np.lexsort((columns[2], columns[0]))
            t, d, n, m = (x[order] for x in columns)
            kept = partnered(t, n, m)
            return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (t, d, n, m)], names=[c for c, _ in POSTING])

        for b in batches:
            packs = b.column("pack")
            light = packs.is_null()
            yield b.select([c for c, _ in POSTING]).filter(light)
            for bucket, pack in zip(b.column("bucket").to_pylist(), packs.to_pylist()):
                if pack is None:
                    continue
                if bucket != last and held:
                    yield cells()
                held.append(pack)
                last = bucket
        if held:
            yield cells()

    kinds = "token long, node long, n int, small boolean"
    sent = texts.select("node", "text").mapInArrow(send, f"bucket int, {kinds}, pack binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, kinds)


def _cells(postings: DataFrame, firsts: DataFrame) -> DataFrame:
    """(token, node, n, small): postings of one node a set; of cells with the same postings one stays.

    Cells are told apart by the exclusive or of their postings' hashes, 128 bits.
    """
    held = cut(postings.join(firsts, "node", "left_semi").distinct(), "jaccard-held")
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "node", "small")).alias(c) for salt, c in enumerate("xy")]
    met = held.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max("small").alias("any"), *marks).where("k > 1 AND any")
    met = met.groupBy("k", "x", "y").agg(F.min("token").alias("token")).select("token")
    out = cut(held.join(met, "token", "left_semi"), "jaccard-cells")
    drop(held)
    return out


def _marks(nodes: DataFrame) -> Broadcast:
    return nodes.sparkSession.sparkContext.broadcast(bitmap(nodes, "node"))


def _picked(table: DataFrame, marks: Broadcast, column: str | None = None) -> DataFrame:
    """Rows of ``table`` whose nodes may be among the marked: a bitmap of fixed size; an exact join has to follow.

    With a ``column`` of texts the rows are (node, z): that column's whole texts compressed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3).compress
        for b in batches:
            b = b.filter(b.column("node").is_valid())
            ids = b.column("node").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            b = b.filter(pa.array(in_bitmap(marks.value, ids)))
            if column:
                z = pa.array([press(t) for _, t in rows_of([b], "node", column)], pa.binary())
                b = pa.RecordBatch.from_arrays([b.column("node"), z], names=["node", "z"])
            yield b

    return table.mapInArrow(read, "node long, z binary" if column else table.schema)


def _packed(texts: DataFrame, nodes: DataFrame, marks: Broadcast) -> DataFrame:
    """(node, z): the whole texts of the nodes, compressed."""
    found = _picked(texts.select("node", "text"), marks, "text")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("z").alias("z"))


def _stars(points: DataFrame) -> DataFrame:
    """(a, b): each node with the least node of the same min-hash, if their points and sizes let them link.

    This saves work later and decides nothing: sets that no min-hash brings together stay clusters of their own.
    """
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"m{j}").alias("m")) for j in range(ROUNDS))))
    keys = points.select("node", "n", each.alias("key")).select("node", "n", "key.j", "key.m")
    leads = keys.groupBy("j", "m").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pairs = keys.join(leads, ["j", "m"]).where("node <> lead.node").where(DEN * F.least("n", "lead.n") >= NUM * F.greatest("n", "lead.n"))
    pairs = pairs.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    sides = [points.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("point").alias(f"p{c}")) for c in "ab"]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in (b.slice(i, ROWS) for i in range(0, len(b), ROWS)):
                p, q = (_points(t.column(c)) for c in ("pa", "pb"))
                n, m = (t.column(c).to_numpy() for c in ("na", "nb"))
                yield t.select(["a", "b"]).filter(pa.array(overlap_bound(p, q) >= need(n, m)))

    return pairs.join(sides[1], "b").join(sides[0], "a").mapInArrow(bound, "a long, b long")


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _early(cells: DataFrame) -> DataFrame:
    """(node, early, asked): the EARLY least tokens of the cells that a node stands in, and those where it looks for partners."""
    place = F.row_number().over(Window.partitionBy("node").orderBy("token"))
    least = cells.select("node", "token", "small", place.alias("place")).where(F.col("place") <= EARLY)
    return least.groupBy("node").agg(F.collect_list("token").alias("early"), F.collect_list(F.when(F.col("small"), F.col("token"))).alias("asked"))


def _meetings(cells: DataFrame, clusters: DataFrame, points: DataFrame) -> DataFrame:
    """Postings of the cells with several clusters, with what ``points`` holds of their nodes, by meeting (token, p, q).

    A cell of more than PIECE postings is dealt to pieces, its main cluster's apart from the others'; pieces of the main
    cluster meet those of the others, and the others' meet each other.  ``own`` is a posting's piece.
    """
    held = cells.join(clusters, "node")
    each = held.groupBy("token", "cluster").agg(F.count(F.lit(1)).alias("c"))
    mixed = each.groupBy("token").agg(F.sum("c").alias("k"), F.max(F.struct("c", "cluster")).alias("main"), F.count(F.lit(1)).alias("of")).where("of > 1")
    whole = F.col("k") <= PIECE

    def pieces(c: Column) -> Column:
        return F.when(whole, 1).otherwise(F.ceil(c / PIECE)).cast("int")

    mine, others = pieces(F.col("main.c")), pieces(F.col("k") - F.col("main.c"))
    mixed = mixed.select("token", F.col("main.cluster").alias("main"), whole.alias("whole"), mine.alias("mine"), others.alias("others"))
    rows = held.join(mixed, "token").withColumn("main", ~F.col("whole") & (F.col("cluster") == F.col("main")))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mine")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("own", F.when(F.col("whole"), 0).when(F.col("main"), at).otherwise(F.col("mine") + at))
    before, after = F.sequence(F.lit(0), F.col("mine") - 1), F.sequence(F.col("mine"), F.col("mine") + F.col("others") - 1)
    others = F.when(F.col("whole"), F.array(F.lit(0))).when(F.col("main"), after).otherwise(F.concat(before, after))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "n", "small", "cluster")
    return rows.join(points, "node")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A stream sorted by ``keys`` as tables of whole groups, of about ROWS rows; and where the groups begin."""

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t), bool)
        change[:1] = True
        for k in keys:
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for b in (whole.slice(i, ROWS) for i in range(0, len(whole), ROWS)):
            held.append(b)
            size += len(b)
            if size >= ROWS:
                t = pa.Table.from_batches(held)
                at = starts(t)
                if len(at) > 1:
                    yield t.slice(0, int(at[-1])), at[:-1]
                    t = t.slice(int(at[-1])).combine_chunks()
                held, size = t.to_batches(), len(t)
    if size:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def _fitting(n: np.ndarray, small: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, k) of rows of one group, sorted by group and size: i looks for partners, k is as large to a third more."""
    key = (group.astype(np.int64) << 36) + n
    low = np.searchsorted(key, key, "left")
    high = np.searchsorted(key, (group.astype(np.int64) << 36) + DEN * n.astype(np.int64) // NUM, "right")
    ask = np.flatnonzero(small)
    many = (high - low)[ask]
    i = np.repeat(ask, many)
    k = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[ask], many)
    return i, k


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of up to EARLY tokens as rows, filled up with the largest long: no token is after it."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), EARLY), np.iinfo(np.int64).max)
    out[np.arange(EARLY) < size[:, None]] = lists.flatten().to_numpy()
    return out


def _met(asked: np.ndarray, early: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Marks pairs, row by row, that meet in a cell before ``token``: the one asked there and the other stands in it."""
    common = (asked[:, :, None] == early[:, None, :]).any(2)
    return (common & (asked < token[:, None])).any(1)


def _search(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes in different clusters that the bounds leave: (a, b, cluster of the one that asks, tightness).

    All of them if ``every``, else the tightest of each meeting and asking cluster, in both cases of the pairs that met
    in no earlier cell.  Cells of up to DIRECT points compare points directly, several cells at once and each pair once.
    """
    for t, starts in _runs(batches, ["token", "p", "q"]):
        group = np.zeros(len(t), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        n = t.column("n").to_numpy().astype(np.int64)
        order = np.lexsort((n, group))
        t, n, group = t.take(pa.array(order)), n[order], group[order]
        token, node, cluster, small, own, p, q = (t.column(c).to_numpy() for c in ("token", "node", "cluster", "small", "own", "p", "q"))
        early, asked = (_lists(t.column(c)) for c in ("early", "asked"))
        points = np.frombuffer(b"".join(t.column("point").to_pylist()), np.uint8).reshape(-1, GROUPS)
        apart = p != q
        sizes = np.bincount(group)
        direct = sizes[group] <= DIRECT
        found = []
        i, k = _fitting(n, small & direct, group)
        ok = (cluster[i] != cluster[k]) & (~apart[i] | (own[i] != own[k]))
        i, k = i[ok], k[ok]
        if every:  # a pair that meets in several cells is bounded once
            low, high = np.minimum(node[i], node[k]), np.maximum(node[i], node[k])
            once = np.lexsort((high, low))
            fresh = np.append(True, (low[once][1:] != low[once][:-1]) | (high[once][1:] != high[once][:-1]))[: len(once)]
            i, k = i[once[fresh]], k[once[fresh]]
        for x in range(0, len(i), ROWS):
            a, b = i[x : x + ROWS], k[x : x + ROWS]
            bound = overlap_bound(points[a], points[b])
            left = bound >= need(n[a], n[b])
            left[left] = ~_met(asked[a[left]], early[b[left]], token[a[left]])
            found.append((a[left], b[left], bound[left]))
        for g in np.flatnonzero(sizes > DIRECT):
            at = np.flatnonzero(group == g)
            tree = CountTree(points[at], n[at], cluster[at])
            for a in at[small[at]]:
                near, bound = tree.near(points[a], int(n[a]), int(cluster[a]))
                b = at[near]
                ok = n[b] >= n[a]
                if apart[a]:
                    ok &= own[b] != own[a]
                ok[ok] = ~_met(asked[[a]], early[b[ok]], token[[a]])
                if not every and ok.any():  # the tightest of these is enough
                    ok &= np.arange(len(b)) == np.flatnonzero(ok)[bound[ok].argmax()]
                found.append((np.full(int(ok.sum()), a), b[ok], bound[ok]))
        i, k, bound = (np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in range(3))
        tight = np.minimum(bound / np.maximum(n[i] + n[k], 1), 1.0)
        if not every:
            order = np.lexsort((node[k], node[i], -tight, cluster[i], group[i]))
            i, k, tight = i[order], k[order], tight[order]
            best = np.append(True, (cluster[i][1:] != cluster[i][:-1]) | (group[i][1:] != group[i][:-1]))[: len(i)]
            i, k, tight = i[best], k[best], tight[best]
        if len(i):
            columns = [np.minimum(node[i], node[k]), np.maximum(node[i], node[k]), cluster[i], tight]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "asks", "tight"])


def _verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose whole texts' sets link."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    texts = _picked(packed, _marks(wanted))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, open_ = Shingler(), zstandard.ZstdDecompressor().decompress

        def verdicts(rows: list[tuple]) -> pa.RecordBatch:
            some = {a: x for a, _, x, _ in rows} | {b: x for _, b, _, x in rows}
            sets = {}
            for keys, block in blocks((k, open_(x)) for k, x in some.items()):
                sets.update(zip(keys, shingles(block)))
            ok = [(a, b) for a, b, _, _ in rows if linked(sets[a], sets[b])]
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in ok], pa.int64()) for c in range(2)], names=["a", "b"])

        held, size = [], 0
        for b in batches:
            for i in range(0, len(b), 64):
                for row in zip(*(c.to_pylist() for c in b.slice(i, 64).columns)):
                    held.append(row)
                    size += len(row[2]) + len(row[3])
                    if size > 1 << 19:
                        yield verdicts(held)
                        held, size = [], 0
        if held:
            yield verdicts(held)

    both = pairs.join(texts.toDF("b", "zb"), "b").join(texts.toDF("a", "za"), "a").select("a", "b", "za", "zb")
    return both.mapInArrow(test, "a long, b long").distinct()


def _merge(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """Clusters joined by links between nodes."""
    ends = links.join(clusters.toDF("a", "ca"), "a").join(clusters.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    joined = components(ends, "jaccard-cc").toDF("cluster", "into")
    return cut(clusters.join(joined, "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster")), "jaccard-clusters")


def _clusters(cells: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, cluster) of every node that stands in a cell: the least node that links reach."""
    parts = partitions(cells.sparkSession)
    nodes = cut(cells.select("node").distinct(), "jaccard-nodes")
    marks = _marks(nodes)
    points = _picked(rows.select("node", "n", *(f"m{j}" for j in range(ROUNDS)), "point"), marks)
    points = points.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    points = cut(points.join(_early(cells), "node"), "jaccard-points")
    packed = cut(_packed(texts, nodes, marks), "jaccard-texts")
    clusters = cut(nodes.select("node", F.col("node").alias("cluster")), "jaccard-clusters")

    def gathered(pairs: DataFrame) -> DataFrame | None:
        links = cut(_verified(pairs, packed), "jaccard-links")
        out = None if links.isEmpty() else _merge(clusters, links)
        drop(links, *([] if out is None else [clusters]))
        return out

    stars = cut(_stars(points), "jaccard-pairs")
    if not stars.isEmpty():
        clusters = gathered(stars) or clusters
    drop(stars)
    for every in (False, True):
        met = _meetings(cells, clusters, points.select("node", "point", "early", "asked")).repartition(parts, "token", "p", "q").sortWithinPartitions("token", "p", "q")
        pairs = met.mapInArrow(lambda b, all_=every: _search(b, all_), "a long, b long, asks long, tight double")
        if not every:  # one a cluster; the last search lists what is left
            pairs = pairs.groupBy("asks").agg(F.max(F.struct("tight", "a", "b")).alias("best")).select("best.a", "best.b")
        pairs = cut(pairs.select("a", "b").distinct(), "jaccard-pairs")
        if pairs.isEmpty():
            drop(pairs)
            break
        clusters = gathered(pairs) or clusters
        drop(pairs)
    drop(nodes, points, packed)
    return clusters


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per document."""
    spark = docs.sparkSession
    for salt in count():
        texts = _keyed(docs, salt)
        profile = cut(_profile(texts), "jaccard-profile")
        rows = profile.where("n IS NOT NULL").drop("part", "counts")
        sets = rows.where("n > 0 AND node IS NOT NULL")
        copies = cut(sets.groupBy("fa", "fb", "n", "node").agg(F.min("doc_id").alias("low")), "jaccard-copies")
        if copies.groupBy("node").count().where("count > 1").isEmpty():
            break
        drop(profile, copies)  # one node with two sets: other nodes
    firsts = cut(copies.groupBy("fa", "fb", "n").agg(F.min("node").alias("node"), F.min("low").alias("low")), "jaccard-firsts")
    counts = summed(profile.where("part IS NOT NULL").select("part", "counts"), CELLS, CHUNK)
    postings = cut(_postings(texts, counts, partitions(spark)), "jaccard-postings")
    cells = _cells(postings, firsts.select("node"))
    drop(postings, copies)
    clusters = _clusters(cells, sets, texts)
    drop(cells)

    # every distinct set's component, then every row's
    nodes = firsts.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    lowest = nodes.groupBy("cluster").agg(F.min("low").alias("component"))
    found = nodes.join(lowest, "cluster").select("fa", "fb", "n", "component")
    inside = F.col("n") > 0
    out = rows.where(inside).join(found, ["fa", "fb", "n"], "left").select("doc_id", "n", "component")
    out = out.union(rows.where(~inside).select("doc_id", "n", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents of which one of each component stays: that with the smallest doc_id."""
    stays = jaccard_components(docs).where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("_k")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("_k")), "left_semi").select(*docs.columns)


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
members AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM members a JOIN members b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes o ON o.doc_id = b WHERE 100 * c >= 75 * (m.n + o.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, low AS component_id
FROM sizes JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) ON a = doc_id
"""
QUERIES, SQL = {"op3_jaccard": op3_jaccard}, {"op3_jaccard": OP3_SQL}
