"""Mixing sources to target weights by a time-varying curriculum.

DataFrame functions only.  Each source has a weight schedule over training time 0..1: its weight times a piecewise linear
shape.  The schedule is integrated, the integral scaled to the source's target, and the inverse of that cumulative demand
gives every copy of a document its training position; documents are range-sorted by position.

Null text counts as empty (size 0, nothing taken); a null source is a source of its own, after all others.  Rows with
equal doc_id, source and text are copies: they stand one after another in their source, and the whole result doesn't
depend on which row is which.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents

WORD = r"[^\x20\x09-\x0D]+"
#: Knots (time, factor) of the shape that each rank's weight has over time; every mean is 1, so shares don't change.
SHAPES = {5.0: [(0.0, 1.5), (1.0, 0.5)], 2.0: [(0.0, 1.0), (1.0, 1.0)], 1.0: [(0.0, 0.5), (1.0, 1.5)]}
CAP = 3.0


def segments(shape: list[tuple[float, float]]) -> Column:
    """The shape's pieces with its integral up to each: structs (t, v, slope, done), scaled to an integral of 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(shape, shape[1:]))
    out, done = [], 0.0
    for (t, v), (t1, v1) in zip(shape, shape[1:]):
        fields = (("t", t), ("v", v / area), ("slope", (v1 - v) / area / (t1 - t)), ("done", done))
        out.append(F.struct(*(F.lit(float(x)).alias(n) for n, x in fields)))
        done += (t1 - t) * (v + v1) / 2 / area
    return F.array(*out)


def when_reached(segs: Column, share: Column) -> Column:
    """Time at which the integral of the shape reaches ``share`` of its whole."""
    s = F.element_at(F.filter(segs, lambda x: x["done"] <= share), -1)
    y = share - s["done"]
    root = F.sqrt(F.greatest(F.lit(0.0), s["v"] * s["v"] + 2.0 * s["slope"] * y))
    return F.when(y <= 0, s["t"]).otherwise(s["t"] + 2.0 * y / (s["v"] + root))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    All sizes are shared by weight; a source stops at ``cap`` times its size and the excess goes to the others by weight.
    Sources sorted by cap over weight fill up in that order, so the level at which the rest stand follows from running
    sums over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    words = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), none)
    level = words / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none))
    per = per.withColumn("level", level).withColumn("open", F.col("level") <= F.col("full_at"))
    first = F.min(F.when(F.col("open"), F.struct("full_at", F.col("source").isNull(), "source", "level"))).over(every)
    per = per.withColumn("level", first["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("doc_id", "source", "h")) -> Column:
    """Rows of the same document: null matches null."""
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[f"_{k}"])
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h, size): h tells texts apart."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("h"), size.alias("size"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = CAP,
    shapes: dict[float, list[tuple[float, float]]] | None = None,
    digits: int = 3,
) -> DataFrame:
    """One row per document: doc_id, source, h (of the text), size, source_size, target, taken, positions (array of
    double, one a copy in the mix), whole (array of boolean: at least half of that copy was taken, or it is all its
    source gives).

    A source's documents lie in the order of a hash of doc_id and text; its stream, repeated, is taken up to the target.
    The place of a document in the stream is its place within one of 16**digits buckets of its source plus the sum of the
    buckets before, so no task gets a whole source.  Copies of one row are counted before any row is placed, so neither
    a source nor a document that is repeated often meets in one task.
    """
    shapes = shapes or SHAPES
    rows = cut(_keyed(docs).groupBy("doc_id", "source", "h", "size").agg(F.count(F.lit(1)).alias("times")), "mix-sizes")
    at = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "h"))
    rows = rows.withColumn("at", at).withColumn("bucket", F.substring("at", 1, digits)).withColumn("words", F.col("size") * F.col("times"))
    flat = [(0.0, 1.0), (1.0, 1.0)]
    shape = F.coalesce(*(F.when(F.col("weight") == w, segments(shapes.get(w, flat))) for w in dict.fromkeys(weights)))
    goal = targets(rows.select("source", F.col("words").alias("size")), weights, cap).withColumn("segs", shape)
    per = rows.groupBy("source", "bucket").agg(F.sum("words").alias("in_bucket"))
    per = per.withColumn("offset", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket"))
    per = per.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")))
    per = per.select(F.col("p.source").alias("_source"), F.col("p.bucket").alias("_bucket"), "offset", "source_size", "target", "segs")
    inside = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size")
    rows = rows.withColumn("end", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(per, _same(rows, per, ("source", "bucket")))
    rows = rows.withColumn("first", F.col("offset") + F.col("end") - F.col("words")).withColumn("limit", F.floor("target"))
    # a row for each copy again, in two steps so that no array grows with the copies of one document
    step = 1 << 16
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(step).cast("long"))))
    rows = rows.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("times"), F.col("_from") + step) - 1)))
    rows = rows.withColumn("begin", F.col("first") + F.col("_i") * F.col("size"))

    def copy(e: Column) -> Column:
        start = F.col("begin") + e * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("limit") - start))
        return F.struct(start.alias("from"), words.alias("words"))

    copies = F.transform(F.sequence(F.lit(0), F.lit(max(0, int(-(-cap // 1)) - 1))), copy)
    rows = rows.withColumn("placed", F.filter(copies, lambda c: c["words"] > 0))
    taken = F.aggregate("placed", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    positions = F.transform("placed", lambda c: when_reached(F.col("segs"), F.least(F.lit(1.0), (c["from"] + c["words"] / 2.0) / F.col("target"))))
    whole = F.transform("placed", lambda c: (2 * c["words"] >= F.col("size")) | (c["from"] == 0))
    fixed = ("doc_id", "source", "h", "size", "source_size", "target")
    return rows.select(*fixed, taken.alias("taken"), positions.alias("positions"), whole.alias("whole"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each whole copy, range-sorted by training position.

    A copy that the target cuts is in the mix if half of it was taken or if it is its source's first; so a source's words
    differ from its target by at most half of one document, or by less than one where the target is less than half
    of it, and no source with a target is absent.  Of rows with equal doc_id, source and text that differ in other
    columns the least (as JSON) stands for all; null texts count as empty ones.
    """
    mix = mix_sources(docs, **options)
    keys = ["doc_id", "source", "h"]
    own = [F.col(k).alias(f"_{k}") for k in keys]
    copies = mix.select(*own, F.explode(F.arrays_zip("positions", "whole")).alias("c")).where("c.whole")
    copies = cut(copies.select(*(f"_{k}" for k in keys), F.col("c.positions").alias("position")), "mix-copies")
    rows = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.struct("*").alias("row"))
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        rows = rows.groupBy(*keys).agg(F.min_by("row", F.to_json("row")).alias("row"))
    out = rows.join(copies, _same(rows, copies)).select("row", "position", "doc_id")
    return out.orderBy("position", "doc_id").select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix_sources(documents(spark, sf_dir))
    first = F.get("positions", F.lit(0)).alias("position")
    return rows.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("position", "doc_id")


OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS at,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)] AS weight FROM per),
caps AS (SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS full_at FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0::DOUBLE)) AS lv
  FROM caps WINDOW w AS (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT *, (SELECT lv FROM levels WHERE lv <= full_at ORDER BY full_at, source IS NULL, source LIMIT 1) AS lvl FROM levels),
goal AS (SELECT source, source_size, weight, CASE WHEN lvl IS NULL THEN most ELSE least(most, lvl * weight) END AS target FROM chosen),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.weight, floor(g.target) AS whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.at, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS b
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
taken AS (
  SELECT *, greatest(0, least(size, whole - b)) AS t0, greatest(0, least(size, whole - b - source_size)) AS t1,
         greatest(0, least(size, whole - b - 2 * source_size)) AS t2 FROM placed),
shares AS (SELECT *, CASE WHEN t0 > 0 THEN least(1.0::DOUBLE, (b + t0 / 2.0::DOUBLE) / target) END AS x FROM taken)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 + t2 AS BIGINT) AS taken,
  CASE WHEN x IS NULL THEN NULL WHEN x <= 0 THEN 0.0::DOUBLE
       WHEN weight = 5 THEN 2.0::DOUBLE * x / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * x)))
       WHEN weight = 2 THEN 2.0::DOUBLE * x / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
       ELSE 2.0::DOUBLE * x / (0.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2.0::DOUBLE * x))) END AS position
FROM shares
"""
QUERIES, SQL = {"op1_mixing": op1_mixing}, {"op1_mixing": OP1_SQL}
