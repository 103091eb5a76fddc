"""The provenance graph: read, transform, condense, summarize, export."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import file_format
from ..sources.reader import read_triples
from . import build, membership, summarize


def graph_xml(nodes: Iterable, edges: Iterable, kind: str, keys: dict[str, list[str]]) -> Iterator[str]:
    """GEXF or GraphML, piece by piece, of (id, attributes) and (src, dst, attributes); ``keys`` names the attributes of
    nodes and of edges, which the head of a file lists.  No more than one node or edge is held."""
    graphml = kind == "graphml"
    yield '<?xml version="1.0" encoding="utf-8"?>\n'
    if graphml:
        yield '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
        for what, names in keys.items():
            for k in names:
                yield f'  <key id={quoteattr(f"{what}:{k}")} for="{what}" attr.name={quoteattr(k)} attr.type="string"/>\n'
        yield '  <graph edgedefault="directed">\n'
    else:
        yield '<gexf xmlns="http://gexf.net/1.2draft" version="1.2">\n  <graph defaultedgetype="directed" mode="static">\n'
        for what, names in keys.items():
            yield f'    <attributes class="{what}" mode="static">\n'
            for k in names:
                yield f'      <attribute id={quoteattr(f"{what}:{k}")} title={quoteattr(k)} type="string"/>\n'
            yield "    </attributes>\n"
    for what, rows in (("node", nodes), ("edge", edges)):
        if not graphml:
            yield f"    <{what}s>\n"
        for n, (*ends, attributes) in enumerate(rows):
            names = {"id": ends[0]} if what == "node" else {"source": ends[0], "target": ends[1]}
            if not graphml:
                names = names | {"label": str(attributes.get("label", ends[0]))} if what == "node" else {"id": str(n)} | names
            head = " ".join(f"{k}={quoteattr(v)}" for k, v in names.items())
            if graphml:
                values = "".join(f"<data key={quoteattr(f'{what}:{k}')}>{escape(str(v))}</data>" for k, v in attributes.items())
            else:
                values = "".join(f"<attvalue for={quoteattr(f'{what}:{k}')} value={quoteattr(str(v))}/>" for k, v in attributes.items())
                values = f"<attvalues>{values}</attvalues>"
            yield f"      <{what} {head}>{values}</{what}>\n"
        if not graphml:
            yield f"    </{what}s>\n"
    yield "  </graph>\n</graphml>\n" if graphml else "  </graph>\n</gexf>\n"


class Summary:
    """Nodes and edges of a summary; files are written partition by partition, as the driver fetches them."""

    fixed: tuple[str, ...] = ("member_count", "members")

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def _keys(self) -> dict[str, list[str]]:
        names = self.nodes.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().collect()
        return {"node": sorted({*(r["k"] for r in names), *(c for c in self.fixed if c in self.nodes.columns)}), "edge": []}

    def _rows(self) -> Iterator[tuple]:
        for r in self.nodes.toLocalIterator():
            yield r["id"], dict(r["attrs"] or {}) | {k: r[k] for k in self.fixed if k in r}

    def _ends(self) -> Iterator[tuple]:
        for r in self.edges.toLocalIterator():
            yield r["src"], r["dst"], {}

    def save(self, file_name, kind: str | None = None) -> None:
        kind = kind or file_format(file_name)
        if kind not in ("gexf", "graphml"):
            raise ValueError(f"can't write a graph as {kind!r}")
        with open(file_name, "w", encoding="utf-8") as f:
            f.writelines(graph_xml(self._rows(), self._ends(), kind, self._keys()))


class ProvGraph(Summary):
    """A graph from one or several provenance files (or a triples DataFrame)."""

    fixed = ("type", "label", "python_name", "data_hash", "hash_type", "execution_id", "execution_order")

    def __init__(
        self,
        *files,
        spark: SparkSession | None = None,
        triples: DataFrame | None = None,
        time_intervals: bool = False,
        file_format: str | None = None,
        **options,
    ):
        spark = spark or SparkSession.getActiveSession()
        self.triples = triples if triples is not None else read_triples(spark, *map(str, files), form=file_format)
        nodes, edges, touches = build.build(self.triples, **options)
        if time_intervals:
            value = F.struct(membership.interval_text(F.col("orders")).alias("value"), F.lit(None).cast("double").alias("num"))
            text = membership.intervals(touches, edges).select("id", value.alias("t"))
            more = F.map_concat("attrs", F.create_map(F.lit("Time Interval"), F.col("t")))
            nodes = nodes.join(text, "id", "left").withColumn("attrs", F.when(F.col("t").isNotNull(), more).otherwise(F.col("attrs"))).drop("t")
        super().__init__(nodes, edges)

    def condense_memberships(self, preserve=None) -> None:
        self.nodes, self.edges = membership.condense(self.nodes, self.edges, preserve or ())

    def remove_attributes(self, *names: str) -> None:
        if not names:
            raise ValueError("name at least one attribute")
        for n in names:
            if n in self.nodes.columns and n != "id":
                self.nodes = self.nodes.withColumn(n, F.lit(None).cast(self.nodes.schema[n].dataType))
        self.nodes = self.nodes.withColumn("attrs", F.map_filter("attrs", lambda k, _: ~k.isin(list(names))))

    def aggregate(
        self,
        group_node_attributes: dict,
        use_function_parameters: bool = True,
        output_file=None,
        remove_attributes=None,
        record_members: bool = True,
    ):
        """The summary graph, or its file when ``output_file`` is given; this graph stays as it is."""
        if output_file is not None and file_format(output_file) not in ("gexf", "graphml"):
            raise ValueError(f"can't write a graph as {file_format(output_file)!r}")
        options = (group_node_attributes, use_function_parameters, remove_attributes, record_members)
        out = Summary(*summarize.aggregate(self.nodes, self.edges, *options))
        return out.save(output_file) if output_file is not None else out

    def _keys(self) -> dict[str, list[str]]:
        return super()._keys() | {"edge": ["label", "membership"]}

    def _rows(self) -> Iterator[tuple]:
        for r in self.nodes.toLocalIterator():
            yield r["id"], {k: r[k] for k in self.fixed if r[k] is not None} | {k: v["value"] for k, v in (r["attrs"] or {}).items()}

    def _ends(self) -> Iterator[tuple]:
        for r in self.edges.toLocalIterator():
            yield r["src"], r["dst"], {"membership": str(r["membership"]).lower()} | ({"label": r["label"]} if r["label"] else {})

    def save_gexf(self, file_name) -> None:
        self.save(file_name, "gexf")

    def save_graphml(self, file_name) -> None:
        self.save(file_name, "graphml")
