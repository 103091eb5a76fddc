import random
from itertools import count

import pytest
from pyspark.sql import functions as F

from sparkprov import ProvDocument, ProvGraph, get_file_name, setting
from sparkprov.capture.code import SourceCode, access_chain
from sparkprov.capture.objects import ObjectInformation
from sparkprov.functions.urns import expand
from sparkprov.ontology import NAMESPACES, OntologyInformation
from sparkprov.operators import build, membership, summarize
from sparkprov.operators.asof import last_before
from sparkprov.sources import rdf
from sparkprov.sources.files import FileInformation, prov_format

HEAD = "@prefix x: <http://x.org/o#> .\n@prefix prov: <http://www.w3.org/ns/prov#> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
OBJ, RUN = "urn:a:t:object:Python:test.{}:{}", "urn:a:t:function_execution:Python:1:9:test.{}#{}"


def entity(kind, key, extra=""):
    return f"<{OBJ.format(kind, key)}> a x:DataObjectEntity {extra} .\n"


def run(name, key, order, ins, outs, params=()):
    pairs = "".join(f' ; x:hasParameter [ a x:NameValuePair ; x:pairName "{k}" ; x:pairValue {v} ]' for k, v in params)
    used = "".join(f" ; prov:used <{i}>" for i in ins)
    made = "".join(f"<{o}> prov:wasGeneratedBy <{RUN.format(name, key)}> .\n" for o in outs)
    return f'<{RUN.format(name, key)}> a x:FunctionExecution ; x:executionOrder {order} ; x:usedFunction <urn:f:{name}>{used}{pairs} .\n<urn:f:{name}> x:functionName "{name}" .\n{made}'


def pair(name, value, relation="hasAttribute"):
    return f'; x:{relation} [ a x:NameValuePair ; x:pairName "{name}" ; x:pairValue {value} ]'


@pytest.fixture(scope="session")
def parallel(tmp_path_factory):
    """A list of four objects, each processed; outputs alternate their metadata."""
    text, members = HEAD, []
    for i in range(4):
        extra = pair("shape", f'"({i + 2},)"') + pair("metadata", 5) + (pair("id", 1) if i == 0 else "") + f"; x:containerIndex {i}"
        members.append(OBJ.format("InputObject", i))
        text += entity("InputObject", i, extra) + entity("OutputObject", i, pair("shape", f'"({i + 2},)"') + pair("metadata", i % 2))
        text += run("process", i, i + 1, [members[i]], [OBJ.format("OutputObject", i)], [("value", i)])
    text += f"<{OBJ.format('list', 9)}> a x:DataObjectEntity " + "".join(f"; prov:hadMember <{m}> " for m in members) + ".\n"
    path = tmp_path_factory.mktemp("rdf") / "parallel.ttl"
    path.write_text(text)
    return str(path)


def test_parallel_summaries(spark, parallel):
    g = ProvGraph(parallel, spark=spark, attributes="all", time_intervals=True)
    assert (g.nodes.count(), g.edges.count()) == (13, 12)
    assert [r.attrs["Time Interval"]["value"] for r in g.nodes.where("label = 'list'").collect()] == ["<[1.0,1.0];[2.0,2.0];[3.0,3.0];[4.0,4.0]>"]
    for keys, params, n in (({}, False, 4), ({"InputObject": ("id",)}, False, 5), ({"InputObject": ("shape",)}, False, 7), ({"InputObject": ("shape",)}, True, 10)):
        assert g.aggregate(keys, use_function_parameters=params).nodes.count() == n
    found = {r.attrs["label"]: r.attrs for r in g.aggregate({}, use_function_parameters=False).nodes.collect()}
    assert found["process"]["process:value"] == "0;1;2;3" and found["OutputObject"]["metadata"] == "0;1"
    assert "Time Interval" not in {k for r in g.aggregate({}, remove_attributes="Time Interval").nodes.collect() for k in r.attrs}


def test_memberships_condense(spark, tmp_path):
    """A shelf of two boxes; one box's second tray and the other box itself are used."""
    chain = [("Shelf", 1, ""), ("Box", 2, '; x:containerIndex "left"'), ("Tray", 3, "; x:containerSlice \"0:2\""), ("Cup", 4, '; x:fromAttribute "first"'), ("Box", 5, "; x:containerIndex 7")]
    held = [(0, 1), (1, 2), (2, 3), (0, 4)]
    text = HEAD + "".join(entity(*c) for c in chain)
    text += "".join(f"<{OBJ.format(*chain[a][:2])}> prov:hadMember <{OBJ.format(*chain[b][:2])}> .\n" for a, b in held)
    text += entity("Drink", 6) + run("pour", 1, 1, [OBJ.format("Cup", 4), OBJ.format("Box", 5)], [OBJ.format("Drink", 6)])
    (path := tmp_path / "m.ttl").write_text(text)
    for preserve, n, labels in ((None, 5, {"[left][0:2].first", "[7]"}), (["Tray"], 6, {"[left][0:2]", ".first", "[7]"})):
        g = ProvGraph(path, spark=spark)
        assert g.nodes.count() == 7
        inside = membership.subgraph(g.nodes, g.edges)
        assert {r.label for r in inside[0].collect()} == {"Shelf", "Box", "Tray", "Cup"} and inside[1].count() == 4
        g.condense_memberships(preserve=preserve)
        assert g.nodes.count() == n
        assert {r.label for r in g.edges.where("membership").collect()} == labels
    with pytest.raises(ValueError):
        g.aggregate({}, output_file=tmp_path / "a.txt")


def test_condense_ends_on_cycles(spark):
    nodes = spark.createDataFrame([(i, "object", "L") for i in "abc"], "id string, type string, label string")
    edges = spark.createDataFrame([("a", "b", True, "[0]"), ("b", "c", True, "[0]"), ("c", "b", True, "[1]")], "src string, dst string, membership boolean, label string")
    with pytest.raises(ValueError, match="cycle"):
        membership.condense(nodes, edges)


def test_graph_files(spark, tmp_path, parallel):
    from xml.etree import ElementTree as ET

    g = ProvGraph(parallel, spark=spark, attributes=["shape"])
    g.save_gexf(tmp_path / "a.gexf")
    g.save_graphml(tmp_path / "a.graphml")
    rows = {r.id: (r.label, {k: v["value"] for k, v in r.attrs.items()}) for r in g.nodes.collect()}
    ends = sorted((r.src, r.dst) for r in g.edges.collect())
    ns = "{http://www.gexf.net/1.2draft}" if "www.gexf" in (tmp_path / "a.gexf").read_text() else "{http://gexf.net/1.2draft}"
    root = ET.parse(tmp_path / "a.gexf").getroot()
    titles = {a.get("id"): a.get("title") for a in root.iter(f"{ns}attribute")}
    for node in root.iter(f"{ns}node"):
        values = {titles[v.get("for")]: v.get("value") for v in node.iter(f"{ns}attvalue")}
        label, attrs = rows[node.get("id")]
        assert node.get("label") == values["label"] == label and attrs.items() <= values.items()
    assert sorted((e.get("source"), e.get("target")) for e in root.iter(f"{ns}edge")) == ends
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.parse(tmp_path / "a.graphml").getroot()
    names = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
    found = {n.get("id"): {names[d.get("key")]: d.text for d in n.iter(f"{ns}data")} for n in root.iter(f"{ns}node")}
    assert set(found) == set(rows) and all(rows[i][1].items() <= a.items() and a["label"] == rows[i][0] for i, a in found.items())
    assert sorted((e.get("source"), e.get("target")) for e in root.iter(f"{ns}edge")) == ends
    assert g.aggregate({}, output_file=tmp_path / "s.graphml") is None
    root = ET.parse(tmp_path / "s.graphml").getroot()
    assert sorted(n.get("id") for n in root.iter(f"{ns}node")) == sorted(r.id for r in g.aggregate({}).nodes.collect())


def test_none_results_and_conflicts(spark, tmp_path):
    none = "urn:a:t:object:Python:builtins.NoneType:u1"
    text = HEAD + entity("In", 1, pair("k", 1) + pair("k", 2, "hasAnnotation")) + f"<{none}> a x:DataObjectEntity .\n" + run("f", 1, 1, [OBJ.format("In", 1)], [none])
    (path := tmp_path / "n.ttl").write_text(text)
    assert ProvGraph(path, spark=spark).nodes.count() == 2
    assert ProvGraph(path, spark=spark, remove_none=False).nodes.count() == 3
    with pytest.raises(Exception, match="Several values"):
        ProvGraph(path, spark=spark, attributes="all", annotations="all").nodes.collect()
    kept = ProvGraph(path, spark=spark, attributes="all", annotations="all", strip_namespace=False).nodes.where("label = 'In'").first().attrs
    assert set(kept) == {"attribute:k", "annotation:k"}


def test_refinement_equals_plain_python(spark):
    rng = random.Random(3)
    for _ in range(2):
        n = 14
        start = {i: rng.choice("ab") for i in range(n)}
        edges = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.2]
        mine, _ = summarize.refine(spark.createDataFrame([(str(i), g) for i, g in start.items()], "id string, g string"), spark.createDataFrame([(str(a), str(b)) for a, b in edges] or [("x", "y")], "src string, dst string"))
        g = dict(start)
        while True:
            after = {i: (g[i], frozenset(g[b] for a, b in edges if a == i)) for i in g}
            ids = count()
            names = {}
            after = {i: names.setdefault(v, next(ids)) for i, v in after.items()}
            if len(set(after.values())) == len(set(g.values())):
                break
            g = after
        found = {r.id: r.g for r in mine.collect()}
        assert all((g[i] == g[j]) == (found[str(i)] == found[str(j)]) for i in range(n) for j in range(n))


@pytest.mark.parametrize("form", ["turtle", "nt", "xml", "json-ld", "n3", "trig", "longturtle"])
def test_rdf_round_trip(form):
    text = HEAD + entity("In", 1, pair("a", '"q\\"\\n\\\\ é"') + pair("b", "-5") + pair("c", "1.5e+00") + pair("d", "true") + '; x:note "hallo"@de, ""')
    t = rdf.parse(text, "turtle")
    back = rdf.parse(rdf.serialize(t, form, {"prov": rdf.PROV, "xsd": rdf.XSD}), "turtle" if form == "longturtle" else form)
    key = lambda ts: sorted((x.p, "" if x.kind == "bnode" else x.o, x.kind, x.datatype or "", x.lang or "") for x in ts)
    assert key(back) == key(t)


def test_documents_and_formats(spark, tmp_path, parallel):
    d = ProvDocument(spark)
    d.read_records(parallel)
    n = d.triples.count()
    d.read_records(parallel, None)
    assert d.triples.count() == n
    d.serialize(tmp_path / "x.nt", "nt")
    e = ProvDocument(spark)
    e.read_records(tmp_path / "x.nt", None)
    assert e.triples.count() == n
    with pytest.raises(ValueError):
        e.read_records("x", None)
    assert prov_format("a.ttl") == "turtle" and prov_format("a") is None
    assert get_file_name("/a/b.py", output_dir="/c", extension="ttl", suffix="_1") == "/c/b_1.ttl"
    assert FileInformation(tmp_path / "x.nt") == FileInformation(tmp_path / "x.nt")
    with pytest.raises(TypeError):
        FileInformation(tmp_path / "x.nt") == 3


def test_nt_lines(spark, tmp_path):
    lines = [
        r'<urn:a> <urn:p> "caf\u00E9 \U0001F600 \f\'\"\\n\n \\u00E9" .',
        "<urn:c><urn:p><urn:d>.",
        '_:x <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> . # why',
        "<urn:a> <urn:q> _:x.y .",
        '<urn:a>\t<urn:p>\t"hallo"@de-AT .',
        "# nothing",
        "",
        r"<urn:\u00E9> <urn:p> <urn:d> .",
    ]
    (path := tmp_path / "a.nt").write_text("\n".join(lines) + "\n")
    d = ProvDocument(spark)
    d.read_records(path, None)
    mine = {(r.s, r.p, r.o, r.o_kind, r.o_datatype, r.o_lang) for r in d.triples.collect()}
    own = lambda x: __import__("re").sub("^_:[0-9a-f]{40}[.]", "_:", x)
    mine = {(own(r[0]), r[1], own(r[2]), *r[3:]) for r in mine}
    other = {tuple(t) for t in rdf.parse("\n".join(lines), "turtle")}
    name = lambda rows: {(r[1], r[2] if r[3] != "bnode" else "", r[3], r[4], r[5]) for r in rows}
    assert name(mine) == name(other) and len(mine) == 6
    assert ("urn:a", "urn:p", "café 😀 \f'\"\\n\n \\u00E9", "literal", rdf.XSD + "string", None) in mine
    assert ("urn:c", "urn:p", "urn:d", "uri", None, None) in mine and "urn:é" in {r[0] for r in mine}
    (tmp_path / "b.nt").write_text("<urn:a> <urn:p> .\n")
    with pytest.raises(Exception, match="no triple"):
        e = ProvDocument(spark)
        e.read_records(tmp_path / "b.nt", None)
        e.triples.collect()


def test_last_before(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([None, *range(20)]), i) for i in range(60)]
    known = [(rng.choice("abc"), rng.choice([None, *range(20)]), i) for i in range(15)]
    got = last_before(spark.createDataFrame(rows, "g string, t int, i int"), spark.createDataFrame(known, "g string, t int, v int"), ["g"], "t").collect()
    for r in got:
        fits = [(t, v) for g, t, v in known if g == r.g and t is not None and r.t is not None and t <= r.t]
        assert r.v == (max(fits)[1] if fits else None)
    assert len(got) == 60


def test_numbered_in_order(spark):
    rows = spark.createDataFrame([(f"k{i:04}",) for i in random.Random(2).sample(range(3000), 500)], "k string")
    got = sorted((r.place, r.k) for r in summarize.numbered(rows, "k").collect())
    assert [g[0] for g in got] == list(range(500)) and [g[1] for g in got] == sorted(g[1] for g in got)


def test_group_key_callables(spark):
    nodes = spark.createDataFrame([("a", "object", "L", {}, {}), ("b", "object", "L", {}, {}), ("c", "object", "L", {}, {})], f"id string, type string, label string, attrs {build.ATTRS}, params {build.ATTRS}")
    edges = spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string")

    def out(nodes, edges):
        return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("value"))

    found = {r.id: r.g for r in summarize.group_key(nodes, {"L": out}, edges=edges).collect()}
    assert found["a"] == found["c"] != found["b"]
    by_id = {r.id: r.g for r in summarize.group_key(nodes, {"L": (lambda n: F.col("id") > "a",)}).collect()}
    assert by_id["b"] == by_id["c"] != by_id["a"]


def test_last_parameter_wins(spark, tmp_path):
    text = HEAD + entity("Out", 1) + run("f", 1, 1, [], [OBJ.format("Out", 1)])
    text += "".join(f'_:e.hasParameter.{n}.x a x:NameValuePair ; x:pairName "p" ; x:pairValue "{v}" .\n<{RUN.format("f", 1)}> x:hasParameter _:e.hasParameter.{n}.x .\n' for n, v in enumerate(["z", "b", "m"]))
    (path := tmp_path / "p.ttl").write_text(text)
    assert [r.params["p"]["value"] for r in ProvGraph(path, spark=spark).nodes.where("type = 'function'").collect()] == ["m"]


def test_plugins_and_converters():
    from sparkprov.capture import plugins
    from sparkprov.capture.objects import literal

    class Signal:
        shape, name, annotations = (2, 3), "s", {"rate": 5}

        def __init__(self):
            self.segments, self.block, self.annotations, self.size = [Inner(), Inner()], Inner(), {"rate": 5, "site": "x"}, 4

    class Inner:
        name, t_start = "i", 0.5

    Signal.__module__ = Inner.__module__ = "neo.core"
    found = ObjectInformation().info(Signal())
    text = "neo.core.Inner(t_start=0.5, name=i)"
    assert found["details"] == {"segments": (f"[{text}, {text}]", "string"), "block": (text, "string"), "size": ("4", "integer"), "shape": ("(2, 3)", "string")} | {k: v for k, v in found["details"].items() if k not in ("segments", "block", "size", "shape")}
    assert found["annotations"] == {"rate": ("5", "integer"), "site": ("x", "string")}
    assert plugins.described(Inner(), ("name", "missing")) == "neo.core.Inner(name=i)"

    class Odd:
        pass

    plugins.add_converter(Odd, lambda x: 7)
    assert literal(Odd()) == ("7", "integer") and literal([1]) == ("[1]", "string")
    Odd.__module__ = "oddpack.m"
    plugins.add_metadata_plugin("oddpack", lambda kind, metadata: {"attributes": {"kind": kind}, "annotations": metadata})
    o = Odd()
    o.z = 1
    found = ObjectInformation().info(o)
    assert "kind" in found["details"] and found["annotations"] == {"z": ("1", "integer")}
    del plugins.BY_TYPE[Odd], plugins.METADATA["oddpack"]
    assert ObjectInformation().info({"b", "a", "c"})["hash"] == ObjectInformation().info({"c", "a", "b"})["hash"]


def test_kinds_of_functions():
    from sparkprov.capture import tracker

    class Local:
        def __init__(self):
            pass

        @staticmethod
        def s():
            pass

    assert tracker.is_constructor(Local.__init__) and not tracker.is_constructor(Local.s)
    assert tracker.module_of(str.upper) == "builtins" and not tracker.is_static(str.upper) and tracker.is_static(str.maketrans) is False
    import sparkprov.sources.rdf as module

    module.Held = type("Held", (), {"s": staticmethod(lambda: 1), "m": lambda self: 1})
    for name in ("s", "m"):
        f = getattr(module.Held, name)
        f.__qualname__, f.__module__ = f"Held.{name}", module.__name__
        assert tracker.is_static(f) is (name == "s")
    del module.Held
    shown = __import__("io").StringIO()
    assert list(tracker.progress([1, 2], True, shown)) == [1, 2] and shown.getvalue().endswith("2/2 records\n")
    assert list(tracker.progress([1], False, shown)) == [1]


def test_statements_from_the_activation_on():
    text = "import x\ndef main(a):\n    b = 1\n    x.activate()\n    if a:\n        c = f(\n            b)\n    else:\n        d = 2\n    return c\ny = 3\n"
    s = SourceCode(text, scope="main", at=2)
    assert s.activate_line == 4 and s.line_map() == [(4, 4), (6, 7), (9, 9), (10, 10)]
    assert s.statement(7) == "c = f(\n            b)" and s.statement(3) is None and s.statement(11) is None
    assert SourceCode(text).activate_line == 4 and SourceCode("a = 1\n").line_map() == [(1, 1)]


def test_settings_and_annotations():
    with pytest.raises(ValueError):
        setting("nothing")
    with pytest.raises(ValueError):
        setting("authority", 3)
    assert setting("authority") == "my-authority"

    def f():
        pass

    f.__ontology__ = {"function": "ex:F", "namespaces": {"ex": "http://ex.org/"}, "arguments": {"a": "<http://y/a>"}, "returns": {"**": "ex:R"}}
    o = OntologyInformation(f)
    assert o.get_uri("function") == "http://ex.org/F" and o.get_uri("arguments", "a") == "http://y/a" and o.get_container_returns() == ["**"]
    f.__ontology__ = {"function": "ex:F", "namespaces": {"ex": "http://other.org/"}}
    with pytest.raises(ValueError):
        OntologyInformation(f)
    NAMESPACES.clear()
    assert expand(["<u:1>"], {}) == "u:1"


def test_code_and_objects():
    s = SourceCode("a, b = f(x,\n      y)\nfor i in z:\n    c.d = g(q.r[0], k=q.r[1:2])\n")
    assert s.statement(2) == "a, b = f(x,\n      y)" and s.targets(1) == ["a", "b"] and s.targets(4) == ["c.d"]

    class Q:
        r = [[1], [2]]

    args = s.call_arguments(4, "g")
    assert [[x[2:] for x in access_chain(e, {"q": Q})] for e in args] == [[("attribute", "r"), ("subscript", "0")], [("attribute", "r"), ("subscript", "1:2")]]
    info = ObjectInformation()
    assert info.info(None)["hash_method"] == "UUID" and info.info([1])["hash"] == ObjectInformation().info([1])["hash"]


TRACKED = """
from sparkprov import track, activate, deactivate
from sparkprov.capture.tracker import SESSION
@track(inputs=["x"])
def twice(x, by=2): return [v * by for v in x]
@track(inputs=["x"], container_output=True)
def parts(x): return [x, x + x]
class Box:
    def __init__(self, items): self.items = items
box = Box([[1, 2], [3]])
activate(clear=True)
a = twice(box.items[0], by=3)
p = parts(a)
q = [twice(y) for y in p]
deactivate()
twice(a)
history = list(SESSION.history)
"""


def test_capture(spark, tmp_path):
    (path := tmp_path / "s.py").write_text(TRACKED)
    names = {"__name__": "s"}
    exec(compile(TRACKED, str(path), "exec"), names)
    h = names["history"]
    assert [r["function"]["name"] for r in h] == ["attribute", "subscript", "twice", "parts", "twice", "twice"]
    assert h[2]["params"] == [("by", ("3", "integer"))] and h[2]["code"] == "a = twice(box.items[0], by=3)" and len(h[3]["outputs"]) == 2
    from sparkprov import save_provenance

    save_provenance(tmp_path / "s.ttl")
    from sparkprov import get_prov_info

    document = get_prov_info(spark)
    saved = ProvDocument(spark)
    saved.read_records(tmp_path / "s.ttl")
    key = lambda d: sorted((r.p, r.o if r.o_kind != "bnode" else "", r.o_datatype or "") for r in d.triples.collect())
    assert key(document) == key(saved)
    g = ProvGraph(tmp_path / "s.ttl", spark=spark)
    assert g.nodes.where("type = 'function'").count() == 4 and g.edges.where("membership").count() == 2


ENTITIES = [
    {"kind": "object", "type": "m.In", "hash": "1", "hash_method": "h", "details": {"a": ("1", "integer"), "b": ("x", "string")}, "annotations": {"c": ("1.5", "double")}, "types": ["urn:t:1"], "detail_types": {"a": ["urn:t:2"]}, "value": None},
    {"kind": "object", "type": "builtins.int", "hash": "2", "hash_method": "h", "details": {}, "value": ("3", "integer"), "types": []},
    {"kind": "file", "path": "/a/ b.txt", "hash": "f", "hash_type": "sha256"},
]


def record(name, module, inputs, outputs, params=(), **more):
    base = {"authority": "me", "script": {"path": "/a/s.py", "hash": "abc"}, "session": "9", "execution_id": f"e{len(inputs)}{name}", "order": 3, "code": None, "started": "2024-01-01T00:00:00", "ended": "2024-01-01T00:00:01"}
    return base | {"function": {"name": name, "module": module, "version": None}, "inputs": inputs, "outputs": outputs, "params": list(params)} | more


def test_log_triples_equal_record_triples(spark):
    import json

    from sparkprov.plans.history import log_triples, record_triples

    a, b, c = ENTITIES
    records = [
        record("f", "m.n", [a, c], [b], [("k", ("5", "integer")), ("q", ('say "hi"\\ é', "string"))], param_types={"k": ["urn:t:3"]}, types=["urn:t:4"], code="x = f(\n1)"),
        record("g", "", [], [a, b, c]),
        record("attribute", "", [a], [b], [("name", ("data", "string"))]),
        record("subscript", "", [a], [b], [("index", ("4", "integer"))]),
        record("subscript", "", [b], [a], [("slice", ("1:2", "string"))]),
    ]
    log = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    mine = {(r.s, r.p, r.o, r.o_kind, r.o_datatype) for r in log_triples(log).collect()}
    assert mine == {t[:5] for r in records for t in record_triples(json.loads(json.dumps(r)))} and len(mine) > 60
    with pytest.raises(Exception, match="no entity"):
        log_triples(spark.createDataFrame([(json.dumps(record("f", "", [{"kind": "odd"}], [])),)], "value string")).collect()


def test_annotated_levels_of_containers(tmp_path):
    source = """
from sparkprov import track, activate, deactivate
from sparkprov.capture.tracker import SESSION
def nested(x): return [[x], [x + 1]]
nested.__ontology__ = {"function": "<urn:F>", "returns": {"*": "<urn:row>", "**": "<urn:cell>"}}
nested = track(inputs=["x"], container_output=(0, 1))(nested)
activate(clear=True)
r = nested(5)
deactivate()
history = list(SESSION.history)
"""
    (path := tmp_path / "n.py").write_text(source)
    names = {"__name__": "n"}
    exec(compile(source, str(path), "exec"), names)
    members = [r for r in names["history"] if r["function"]["name"] == "subscript"]
    types = {(r["outputs"][0]["type"], t) for r in members for t in r["outputs"][0]["types"]}
    assert types == {("builtins.list", "urn:row"), ("builtins.int", "urn:cell")} and len(members) == 4
    assert next(r for r in names["history"] if r["function"]["name"] == "nested")["types"] == ["urn:F"]


def test_log_stream(spark, tmp_path):
    import json

    from sparkprov.streaming.log import stream_triples

    names = {"__name__": "s"}
    (path := tmp_path / "s.py").write_text(TRACKED)
    exec(compile(TRACKED, str(path), "exec"), names)
    (log := tmp_path / "log").mkdir()
    lines = [json.dumps(r) for r in names["history"]]
    (log / "a.jsonl").write_text("\n".join(lines + lines[:2]) + "\n")
    q = stream_triples(spark, str(log)).writeStream.format("memory").queryName("triples").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("triples").where(F.col("p").endswith("executionOrder")).count() == 4


def test_queries_match_sql(spark):
    from sparkprov.queries import QUERIES, SQL

    from .conftest import against_duckdb

    assert set(QUERIES) == set(SQL)
    for name in SQL:
        d = "/root/testdata/sf0.01" if name == "file_identity" else "/root/testdata/sf0.001"
        mine, other = against_duckdb(QUERIES[name](spark, d), SQL[name], d)
        assert mine == other and mine, name


def test_summarized_intervals_are_whole(spark):
    from sparkprov.queries import QUERIES

    counts = {r.user_id: r["count"] for r in spark.read.parquet("/root/testdata/sf0.01/events.parquet").groupBy("user_id").count().collect()}
    assert max(counts.values()) > 12
    got = {r.user_id: r.intervals for r in QUERIES["summarize_intervals"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {u: "<" + ";".join(sorted(f"[{n}.0,{n}.0]" for n in range(1, k + 1))) + ">" for u, k in counts.items()}


def test_file_identity_of_every_table(spark):
    import hashlib
    from pathlib import Path

    from sparkprov.queries import QUERIES

    d = "/root/testdata/sf0.001"
    got = {r.name: (r.hash_type, r.hash) for r in QUERIES["file_identity"](spark, d).collect()}
    assert got == {p.name: ("sha256", hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(d).glob("*.parquet")}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_log_triples_of_some_relations(spark):
    import json

    from sparkprov.plans.history import log_triples

    a, b, c = ENTITIES
    records = [record("f", "m.n", [a, c], [b], [("k", ("5", "integer"))], param_types={"k": ["urn:t:3"]}), record("subscript", "", [b], [a], [("index", ("4", "integer"))])]
    log = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    local = lambda rows: {(r.s, r.p, r.o) for r in rows if build_local(r.p) in ("used", "hadMember", "containerIndex")}
    build_local = lambda p: p.rsplit("#", 1)[-1].rsplit("/", 1)[-1]
    some = log_triples(log, relations=("used", "hadMember", "containerIndex")).collect()
    assert local(some) == local(log_triples(log).collect()) and len(some) == 4
    pairs = {build_local(r.p) for r in log_triples(log, relations=("hasParameter", "pairName", "pairValue")).collect()}
    assert pairs == {"hasParameter", "pairName", "pairValue"}
    assert log_triples(log, relations=("hasParameter", "pairValue")).count() == 2  # not the entities' own values


def test_parts_of_a_graph_read_their_relations_alone(spark):
    from sparkprov.operators import build
    from sparkprov.plans import tables
    from sparkprov.queries import trace, trace_graph

    d = "/root/testdata/sf0.001"
    whole, before = build.build(trace(spark, d)), set(tables.WRITTEN)
    some = trace_graph(spark, d, "edges")
    assert sorted(map(tuple, some[1].collect())) == sorted(map(tuple, whole[1].collect())) and some[0].count() == some[2].count() == 0
    (path,) = set(tables.WRITTEN) - before
    assert {r.l for r in spark.read.parquet(path).select("l").distinct().collect()} == {"used", "wasGeneratedBy"}


def test_merged_logs_are_made_distinct_once(spark):
    from sparkprov.queries import QUERIES

    plan = QUERIES["merge_sources"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


def test_round_trip_is_written_compressed(spark, tmp_path):
    from sparkprov.sources.reader import read_triples, write_nt

    t = spark.createDataFrame([("urn:a", "urn:p", "b c", "literal", "http://www.w3.org/2001/XMLSchema#string", None, "s")] * 2, "s string, p string, o string, o_kind string, o_datatype string, o_lang string, source string")
    write_nt(t, str(tmp_path / "x"), compression="gzip")
    assert list((tmp_path / "x").glob("*.gz")) and not list((tmp_path / "x").glob("*.txt"))
    assert [r[:5] for r in map(tuple, read_triples(spark, str(tmp_path / "x"), form="nt").collect())] == [("urn:a", "urn:p", "b c", "literal", "http://www.w3.org/2001/XMLSchema#string")]
