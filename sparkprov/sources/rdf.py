"""RDF text to triples and back, without a library.

A triple is (s, p, o, kind, datatype, lang) with kind 'uri', 'bnode' or 'literal'; blank nodes are written _:name.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple
from xml.etree import ElementTree as ET

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
PROV = "http://www.w3.org/ns/prov#"


class Triple(NamedTuple):
    s: str
    p: str
    o: str
    kind: str = "uri"
    datatype: str | None = None
    lang: str | None = None


ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), text)


def escape(text: str) -> str:
    for c, e in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(c, e)
    return text


TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<uri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<long>\"{3}(?:[^"\\]|\\.|"{1,2}(?!"))*\"{3}|'{3}(?:[^'\\]|\\.|'{1,2}(?!'))*'{3})
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[\w.-]*\w)
    |(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<mark>\^\^|[\[\]();,.{}])
    |(?P<name>(?:[\w.-]*\w)?:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*|[A-Za-z]\w*)""",
    re.X | re.S,
)


class Turtle:
    """Turtle, N3's and TriG's triples in the default graph: prefixes, base, lists of predicates and objects, anonymous
    and labelled blank nodes, collections, strings, numbers, booleans, comments."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unreadable at {text[at : at + 30]!r}")
            if m.lastgroup:
                if m.lastgroup == "number" and m[0].endswith(".") and not re.match(r"\d", text[m.end() : m.end() + 1]):
                    self.tokens += [("number", m[0][:-1]), ("mark", ".")]
                else:
                    self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.fresh, self.found = 0, {}, "", 0, []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> tuple[str, str]:
        kind, value = self.peek()
        if values and value not in values:
            raise ValueError(f"expected {' or '.join(values)}, found {value!r}")
        self.at += 1
        return kind, value

    def blank(self) -> str:
        self.fresh += 1
        return f"_:anon{self.fresh}"

    def parse(self) -> list[Triple]:
        while self.peek()[0] != "end":
            value = self.peek()[1]
            if value.lower() in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1][:-1]
                self.prefixes[name] = self.base + self.take()[1][1:-1]
                if value[0] == "@":
                    self.take(".")
            elif value.lower() in ("@base", "base"):
                self.take()
                self.base = self.take()[1][1:-1]
                if value[0] == "@":
                    self.take(".")
            elif value in "{}":
                self.take()
            else:
                anonymous = value == "["
                subject = self.term()[0]
                if not (anonymous and self.peek()[1] == "."):
                    self.predicates(subject, (".", "}"))
                if self.peek()[1] == ".":
                    self.take(".")
        return self.found

    def predicates(self, subject: str, ends: tuple[str, ...]) -> None:
        while self.peek()[1] not in ends:
            kind, value = self.peek()
            if (kind, value) == ("name", "a"):
                self.take()
                predicate = RDF + "type"
            else:
                predicate = self.term()[0]
            while True:
                o, kind, datatype, lang = self.term()
                self.found.append(Triple(subject, predicate, o, kind, datatype, lang))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[0] == "end":
                raise ValueError("the text ends within a statement")

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, value = self.take()
        if kind == "uri":
            uri = unescape(value[1:-1])
            return (uri if re.match(r"[A-Za-z][\w+.-]*:", uri) else self.base + uri), "uri", None, None
        if kind == "bnode":
            return value, "bnode", None, None
        if kind in ("string", "long"):
            text = unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[1] == "^^":
                self.take()
                return text, "literal", self.term()[0], None
            if self.peek()[0] == "at":
                return text, "literal", None, self.take()[1][1:]
            return text, "literal", XSD + "string", None
        if kind == "number":
            return value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if kind == "name" and value in ("true", "false"):
            return value, "literal", XSD + "boolean", None
        if kind == "name" and ":" in value:
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "uri", None, None
        if value == "[":
            node = self.blank()
            self.predicates(node, ("]",))
            self.take("]")
            return node, "bnode", None, None
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            head = RDF + "nil"
            for o, k, d, lang in reversed(items):
                node = self.blank()
                self.found += [Triple(node, RDF + "first", o, k, d, lang), Triple(node, RDF + "rest", head, "bnode" if head[:2] == "_:" else "uri")]
                head = node
            return head, "bnode" if head[:2] == "_:" else "uri", None, None
        raise ValueError(f"unexpected {value!r}")


def read_xml(text: str) -> list[Triple]:
    """RDF/XML: typed and untyped nodes, nested nodes, resource and nodeID references, literals."""
    out: list[Triple] = []
    fresh = iter(range(1, 1 << 62))

    def uri(tag: str) -> str:
        return tag[1:].replace("}", "", 1)

    def node(e: ET.Element) -> tuple[str, str]:
        about, label = e.get(f"{{{RDF}}}about"), e.get(f"{{{RDF}}}nodeID")
        me = (about, "uri") if about is not None else (f"_:{label}" if label else f"_:x{next(fresh)}", "bnode")
        if uri(e.tag) != RDF + "Description":
            out.append(Triple(me[0], RDF + "type", uri(e.tag)))
        for k, v in e.attrib.items():
            if not k.startswith(f"{{{RDF}}}") and k[:1] == "{" and "XML/1998" not in k:
                out.append(Triple(me[0], uri(k), v, "literal", XSD + "string"))
        for p in e:
            resource, label = p.get(f"{{{RDF}}}resource"), p.get(f"{{{RDF}}}nodeID")
            if resource is not None:
                out.append(Triple(me[0], uri(p.tag), resource))
            elif label is not None:
                out.append(Triple(me[0], uri(p.tag), f"_:{label}", "bnode"))
            elif p.get(f"{{{RDF}}}parseType") == "Resource":
                inner = ET.Element(f"{{{RDF}}}Description")
                inner.extend(list(p))
                out.append(Triple(me[0], uri(p.tag), *node(inner)))
            elif len(p):
                out.append(Triple(me[0], uri(p.tag), *node(p[0])))
            else:
                lang = p.get("{http://www.w3.org/XML/1998/namespace}lang")
                out.append(Triple(me[0], uri(p.tag), p.text or "", "literal", None if lang else p.get(f"{{{RDF}}}datatype") or XSD + "string", lang))
        return me

    root = ET.fromstring(text)
    for e in root if uri(root.tag) == RDF + "RDF" else [root]:
        node(e)
    return out


def read_jsonld(text: str) -> list[Triple]:
    """JSON-LD: expanded or with a context of prefixes and terms; nested nodes, @graph, @list-free values."""
    out: list[Triple] = []
    fresh = iter(range(1, 1 << 62))
    data = json.loads(text)

    def node(x: dict, context: dict) -> tuple[str, str]:
        if "@context" in x:
            more = x["@context"] if isinstance(x["@context"], list) else [x["@context"]]
            context = {k: v for c in [context, *more] if isinstance(c, dict) for k, v in c.items()}

        def full(term: str) -> str:
            found = context.get(term)
            found = found.get("@id") if isinstance(found, dict) else found
            if found:
                return full(found) if found != term else found
            prefix, colon, local = term.partition(":")
            base = context.get(prefix) if colon and not local.startswith("//") else None
            return (base["@id"] if isinstance(base, dict) else base) + local if base else context.get("@vocab", "") + term if not colon else term

        for g in x.get("@graph", []):
            node(g, context)
        if set(x) <= {"@context", "@graph"}:
            return "", "uri"
        me = full(x["@id"]) if "@id" in x and not x["@id"].startswith("_:") else x.get("@id") or f"_:j{next(fresh)}"
        types = x.get("@type", [])
        for t in types if isinstance(types, list) else [types]:
            out.append(Triple(me, RDF + "type", full(t)))
        for k, values in x.items():
            if k[0] == "@":
                continue
            how = context.get(k)
            how = how.get("@type") if isinstance(how, dict) else None
            for v in values if isinstance(values, list) else [values]:
                if isinstance(v, dict) and "@value" in v:
                    raw = v["@value"]
                    plain = str(raw).lower() if isinstance(raw, bool) else str(raw)
                    kind = full(v["@type"]) if "@type" in v else None if "@language" in v else native(raw)
                    out.append(Triple(me, full(k), plain, "literal", kind, v.get("@language")))
                elif isinstance(v, dict):
                    if set(v) == {"@id"}:
                        i = v["@id"]
                        out.append(Triple(me, full(k), i if i[:2] == "_:" else full(i), "bnode" if i[:2] == "_:" else "uri"))
                    else:
                        out.append(Triple(me, full(k), *node(v, context)))
                elif how == "@id":
                    out.append(Triple(me, full(k), full(v)))
                else:
                    out.append(Triple(me, full(k), str(v).lower() if isinstance(v, bool) else str(v), "literal", full(how) if how else native(v)))
        return me, "bnode" if me[:2] == "_:" else "uri"

    def native(v) -> str:
        return XSD + ("boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double" if isinstance(v, float) else "string")

    for x in data if isinstance(data, list) else [data]:
        node(x, {})
    return out


READERS = {form: lambda t: Turtle(t).parse() for form in ("turtle", "n3", "nt", "trig")}
READERS |= {"xml": read_xml, "json-ld": read_jsonld}


def parse(text: str, form: str) -> list[Triple]:
    if form not in READERS:
        raise ValueError(f"can't read the format {form!r}")
    return READERS[form](text)


def nt_term(o: str, kind: str, datatype: str | None = None, lang: str | None = None) -> str:
    if kind == "bnode":
        return o
    if kind == "uri":
        return f"<{o}>"
    tail = f"@{lang}" if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else ""
    return f'"{escape(o)}"{tail}'


def _subject(s: str) -> str:
    return s if s[:2] == "_:" else f"<{s}>"


def to_nt(triples: Iterable[Triple]) -> str:
    return "".join(f"{_subject(t.s)} <{t.p}> {nt_term(*t[2:])} .\n" for t in triples)


def to_turtle(triples: Iterable[Triple], prefixes: dict[str, str], gap: str = "") -> str:
    """Blank nodes that are used once stand in brackets."""
    by, uses = defaultdict(list), defaultdict(int)
    for t in dict.fromkeys(triples):
        by[t.s].append(t)
        uses[t.o] += t.kind == "bnode"
    inline = {s for s in by if s[:2] == "_:" and uses[s] == 1}

    def short(u: str) -> str:
        for p, base in prefixes.items():
            if u.startswith(base) and re.fullmatch(r"[A-Za-z_][\w-]*", u[len(base) :]):
                return f"{p}:{u[len(base) :]}"
        return f"<{u}>"

    def value(t: Triple) -> str:
        if t.kind == "bnode":
            return f"[ {body(t.o)} ]" if t.o in inline else t.o
        if t.kind == "uri":
            return short(t.o)
        if t.datatype == XSD + "integer" and re.fullmatch(r"[+-]?\d+", t.o) or t.datatype == XSD + "boolean" and t.o in ("true", "false"):
            return t.o
        return nt_term(t.o, "literal", None, t.lang) + (f"^^{short(t.datatype)}" if t.datatype and t.datatype != XSD + "string" else "")

    def body(s: str) -> str:
        lines = defaultdict(list)
        for t in sorted(by[s], key=lambda t: (t.p != RDF + "type", t.p, t.o)):
            lines["a" if t.p == RDF + "type" else short(t.p)].append(value(t))
        return f" ;\n    {gap}".join(f"{p} {', '.join(o)}" for p, o in lines.items())

    head = "".join(f"@prefix {p}: <{u}> .\n" for p, u in prefixes.items())
    return head + "\n" + "\n\n".join(f"{_subject(s)} {body(s)} ." for s in sorted(by) if s not in inline) + "\n"


def to_xml(triples: Iterable[Triple], prefixes: dict[str, str]) -> str:
    prefixes = {"rdf": RDF} | prefixes
    for p, u in prefixes.items():
        ET.register_namespace(p, u)
    root, nodes = ET.Element(f"{{{RDF}}}RDF"), {}
    for t in triples:
        if t.s not in nodes:
            nodes[t.s] = ET.SubElement(root, f"{{{RDF}}}Description", {f"{{{RDF}}}nodeID": t.s[2:]} if t.s[:2] == "_:" else {f"{{{RDF}}}about": t.s})
        base, local = re.fullmatch(r"(.*[#/:])([^#/:]+)", t.p).groups()
        e = ET.SubElement(nodes[t.s], f"{{{base}}}{local}")
        if t.kind == "literal":
            e.text = t.o
            if t.lang:
                e.set("{http://www.w3.org/XML/1998/namespace}lang", t.lang)
            elif t.datatype and t.datatype != XSD + "string":
                e.set(f"{{{RDF}}}datatype", t.datatype)
        else:
            e.set(f"{{{RDF}}}{'nodeID' if t.kind == 'bnode' else 'resource'}", t.o[2:] if t.kind == "bnode" else t.o)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def to_jsonld(triples: Iterable[Triple]) -> str:
    nodes: dict[str, dict] = {}
    for t in triples:
        n = nodes.setdefault(t.s, {"@id": t.s})
        if t.p == RDF + "type":
            n.setdefault("@type", []).append(t.o)
        elif t.kind == "literal":
            n.setdefault(t.p, []).append({"@value": t.o} | ({"@language": t.lang} if t.lang else {"@type": t.datatype} if t.datatype else {}))
        else:
            n.setdefault(t.p, []).append({"@id": t.o})
    return json.dumps(list(nodes.values()), indent=2)


def to_hext(triples: Iterable[Triple]) -> str:
    kinds = {"uri": "globalId", "bnode": "localId"}
    return "".join(json.dumps([t.s, t.p, t.o, t.datatype or "" if t.kind == "literal" else kinds[t.kind], t.lang or "", ""]) + "\n" for t in triples)


def serialize(triples: Iterable[Triple], form: str, prefixes: dict[str, str]) -> str:
    triples = sorted(set(triples), key=lambda t: tuple(x or "" for x in t))
    if form in ("turtle", "n3", "trig", "longturtle"):
        return to_turtle(triples, prefixes, "    " if form == "longturtle" else "")
    if form in ("xml", "pretty-xml"):
        return to_xml(triples, prefixes)
    writers = {"nt": to_nt, "json-ld": to_jsonld, "hext": to_hext}
    if form not in writers:
        raise ValueError(f"can't write the format {form!r}")
    return writers[form](triples)
