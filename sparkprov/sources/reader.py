"""Triples as DataFrames: s, p, o, o_kind, o_datatype, o_lang, source."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rdf
from .files import prov_format

SCHEMA = "s string, p string, o string, o_kind string, o_datatype string, o_lang string, source string"
NODE = r"""<[^<>"\s]*>|_:[^\s<>"]*[^\s<>".]"""
LINE = (
    rf"""^[ \t]*({NODE})[ \t]*<([^<>"\s]*)>[ \t]*({NODE}|"(?:[^"\\]|\\.)*")"""
    r"""(?:\^\^<([^<>"\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?[ \t]*\.[ \t]*(?:#.*)?$"""
)


def unescaped(text: Column) -> Column:
    """A literal's or IRI's text without its escapes: \\uXXXX, \\UXXXXXXXX and \\ before a single character."""
    pieces = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))

    def plain(x: Column) -> Column:
        digits = F.lpad(F.substring(x, 3, 8), 8, "0")
        out = F.when(x.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), F.decode(F.unhex(digits), "UTF-32"))
        for code, c in rdf.ESCAPES.items():
            out = out.when(x == "\\" + code, F.lit(c))
        return out.otherwise(x)

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def _named(path: str, form: str | None) -> str:
    form = form or prov_format(path)
    if form is None:
        raise ValueError(f"no format can be told from {path!r}")
    if form in ("ttl", "rdf", "json"):
        form = prov_format(f"x.{form}")
    if form not in rdf.READERS:
        raise ValueError(f"can't read the format {form!r}")
    return form


def read_triples(spark: SparkSession, *paths: str, form: str | None = None) -> DataFrame:
    """All files' triples; equal ones merge, blank nodes stay apart by file.

    N-Triples are read by line with JVM expressions; other formats file by file where the file lies.
    """
    parts = []
    for path in paths:
        kind = _named(path, form)
        if kind == "nt":
            parts.append(_lines(spark, path))
        else:
            parts.append(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parser(kind), SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return distinct_triples(out)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples by line; blank lines and comments are left out, any other line that is no triple is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"))
    lines = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    bad = F.raise_error(F.concat(F.lit("no triple: "), F.substring("value", 1, 200)))
    lines = lines.withColumn("value", F.when(F.col("value").rlike(LINE), F.col("value")).otherwise(bad))
    s, p, o, datatype, lang = (F.regexp_extract("value", LINE, i) for i in range(1, 6))
    rows = lines.select("source", s.alias("s"), p.alias("p"), o.alias("o"), F.nullif(datatype, F.lit("")).alias("dt"), F.nullif(lang, F.lit("")).alias("lang"))

    def node(c: str) -> Column:
        blank = F.concat(F.lit("_:"), F.sha1("source"), F.lit("."), F.expr(f"substring({c}, 3)"))
        return F.when(F.col(c).startswith("_:"), blank).otherwise(unescaped(F.expr(f"substring({c}, 2, length({c}) - 2)")))

    kind = F.when(F.col("o").startswith("<"), "uri").when(F.col("o").startswith("_:"), "bnode").otherwise("literal")
    typed = F.when((kind == "literal") & F.col("lang").isNull(), F.coalesce(unescaped(F.col("dt")), F.lit(rdf.XSD + "string")))
    return rows.select(
        node("s").alias("s"),
        unescaped(F.col("p")).alias("p"),
        node("o").alias("o"),
        kind.alias("o_kind"),
        typed.alias("o_datatype"),
        F.col("lang").alias("o_lang"),
        "source",
    )


def _parser(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ("s", "p", "o", "o_kind", "o_datatype", "o_lang", "source")
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mark = "_:" + hashlib.sha1(path.encode()).hexdigest() + "."
                own = lambda x: mark + x[2:] if x[:2] == "_:" else x  # noqa: B023, E731
                rows = [(own(t.s), t.p, own(t.o) if t.kind == "bnode" else t.o, t.kind, t.datatype, t.lang, path) for t in rdf.parse(content.decode(), kind)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(7)], names=names)

    return run


def distinct_triples(triples: DataFrame) -> DataFrame:
    """A set of triples; of equal ones from several sources the first source stays."""
    keys = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]
    return triples.groupBy(*keys).agg(F.min("source").alias("source"))


def collected(triples: DataFrame) -> Iterator[rdf.Triple]:
    for r in triples.select("s", "p", "o", "o_kind", "o_datatype", "o_lang").toLocalIterator():
        yield rdf.Triple(*r)


def write_nt(triples: DataFrame, path: str, compression: str = "none") -> None:
    """N-Triples from the executors, one part a partition; ``compression`` is a codec of Spark's text files."""
    text = F.col("o")
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    typed = F.when(F.col("o_datatype") != rdf.XSD + "string", F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise(typed)
    bracketed = F.concat(F.lit("<"), "o", F.lit(">"))
    literal = F.concat(F.lit('"'), text, F.lit('"'), tail)
    o = F.when(F.col("o_kind") == "uri", bracketed).when(F.col("o_kind") == "bnode", F.col("o")).otherwise(literal)
    s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    triples.select(F.concat(s, F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value")).write.mode("overwrite").text(path, compression=compression)
