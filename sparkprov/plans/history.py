"""Execution records to triples; the same function serves a session's history, a log on disk and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import NAMESPACE, TAG
from ..sources.rdf import PROV, RDF, XSD, Triple
from ..sources.reader import distinct_triples

PREFIXES = {"prov": PROV, "xsd": XSD, "rdf": RDF, "sp": NAMESPACE}
MEMBERSHIPS = ("attribute", "subscript")


def entity_uri(x: dict, authority: str) -> str:
    if x["kind"] == "object":
        return f"urn:{authority}:{TAG}:object:Python:{x['type']}:{x['hash']}"
    if x["kind"] == "file":
        return f"urn:{authority}:{TAG}:file:{x['hash_type']}:{x['hash']}"
    raise ValueError(f"no entity: {x['kind']!r}")


def record_triples(r: dict) -> list[Triple]:
    """Triples of one record: script, session, authority, function, inputs, outputs, params, code, times, order, types."""
    out: list[Triple] = []
    base = f"urn:{r['authority']}:{TAG}"
    script = f"{base}:script:Python:{r['script']['path'].rsplit('/', 1)[-1]}:{r['script']['hash']}#{r['session']}"
    name = ".".join(x for x in (r["function"]["module"], r["function"]["name"]) if x)

    def add(s: str, p: str, o, datatype: str | None = None) -> None:
        p = p if ":" in p else NAMESPACE + p
        out.append(Triple(s, p, str(o), "literal" if datatype else "bnode" if str(o)[:2] == "_:" else "uri", XSD + datatype if datatype else None))

    def typed(s: str, kind: str, more=()) -> None:
        for t in (NAMESPACE + kind, *more):
            add(s, RDF + "type", t)

    def pair(s: str, relation: str, n: int, key: str, value: tuple[str, str], more=()) -> None:
        b = f"_:{r['execution_id']}.{relation}.{n}.{s.rsplit(':', 1)[-1][-40:].replace('#', '.')}"
        add(s, relation, b)
        typed(b, "NameValuePair", more)
        add(b, "pairName", key, "string")
        add(b, "pairValue", value[0], value[1])

    def entity(x: dict) -> str:
        uri = entity_uri(x, r["authority"])
        typed(uri, "DataObjectEntity" if x["kind"] == "object" else "FileEntity", x.get("types", ()))
        add(uri, PROV + "wasAttributedTo", script)
        if x["kind"] == "file":
            add(uri, "filePath", x["path"], "string")
            return uri
        add(uri, "hashSource", x["hash_method"], "string")
        if x.get("value") is not None:
            add(uri, PROV + "value", *x["value"])
        for relation, found in (("hasAttribute", x.get("details") or {}), ("hasAnnotation", x.get("annotations") or {})):
            for n, (k, v) in enumerate(found.items()):
                pair(uri, relation, n, k, v, (x.get("detail_types") or {}).get(k, ()))
        return uri

    typed(script, "ScriptAgent")
    add(script, "scriptPath", r["script"]["path"], "string")
    ins = [entity(x) for x in r["inputs"]]
    outs = [entity(x) for x in r["outputs"]]
    if r["function"]["name"] in MEMBERSHIPS and not r["function"]["module"]:
        key, value = r["params"][0][0], r["params"][0][1]
        relation = "fromAttribute" if key == "name" else "containerSlice" if key == "slice" else "containerIndex"
        add(ins[0], PROV + "hadMember", outs[0])
        add(outs[0], relation, value[0], "string" if relation != "containerIndex" else value[1])
        return out
    run = f"{base}:function_execution:Python:{r['script']['hash']}:{r['session']}:{name}#{r['execution_id']}"
    function = f"{base}:function:Python:{name}"
    typed(function, "Function")
    add(function, "functionName", r["function"]["name"], "string")
    add(function, "implementedIn", r["function"]["module"], "string")
    add(function, "functionVersion", r["function"]["version"] or "", "string")
    typed(run, "FunctionExecution", r.get("types", ()))
    add(run, PROV + "startedAtTime", r["started"], "dateTime")
    add(run, PROV + "endedAtTime", r["ended"], "dateTime")
    add(run, PROV + "wasAssociatedWith", script)
    add(run, "usedFunction", function)
    add(run, "codeStatement", r["code"] or "", "string")
    add(run, "executionOrder", r["order"], "integer")
    for n, (key, value) in enumerate(r["params"]):
        pair(run, "hasParameter", n, key, value, (r.get("param_types") or {}).get(key, ()))
    for i in ins:
        add(run, PROV + "used", i)
    for o in outs:
        add(o, PROV + "wasGeneratedBy", run)
        for i in ins:
            add(o, PROV + "wasDerivedFrom", i)
    return out


ENTITY = (
    "struct<kind: string, type: string, hash: string, hash_type: string, hash_method: string, path: string, value: array<string>, "
    "types: array<string>, details: map<string, array<string>>, annotations: map<string, array<string>>, detail_types: map<string, array<string>>>"
)
#: A parameter is [name, [value, type]]; it and its pair are read as text first, as an array holds one type.
RECORD = (
    "authority string, session string, execution_id string, order long, code string, started string, ended string, types array<string>, "
    "script struct<path: string, hash: string>, function struct<name: string, module: string, version: string>, "
    f"inputs array<{ENTITY}>, outputs array<{ENTITY}>, params array<string>, param_types map<string, array<string>>"
)
#: What an item of a record is: the record or an entity itself, a membership, a name/value pair, an added type, a source;
#: the n-th of a kind has the number PLACES * kind + n.
HEAD, MEMBER, PARAM, DETAIL, ANNOTATION, TYPE, SOURCE = range(7)
PLACES = 1 << 28
PAIRS = {PARAM: "hasParameter", DETAIL: "hasAttribute", ANNOTATION: "hasAnnotation"}
RDF_TYPE, MORE = RDF + "type", 1000
#: A record's kinds of triples: name, subject, predicate, object, datatype; MORE + i is the i-th added type of a pair.
TRIPLES = (
    ("script", "_script", RDF_TYPE, NAMESPACE + "ScriptAgent", None),
    ("path", "_script", NAMESPACE + "scriptPath", "$_path", "string"),
    ("function", "_function", RDF_TYPE, NAMESPACE + "Function", None),
    ("name", "_function", NAMESPACE + "functionName", "$_name", "string"),
    ("module", "_function", NAMESPACE + "implementedIn", "$_module", "string"),
    ("version", "_function", NAMESPACE + "functionVersion", "$_version", "string"),
    ("run", "_run", RDF_TYPE, NAMESPACE + "FunctionExecution", None),
    ("started", "_run", PROV + "startedAtTime", "$started", "dateTime"),
    ("ended", "_run", PROV + "endedAtTime", "$ended", "dateTime"),
    ("agent", "_run", PROV + "wasAssociatedWith", "$_script", None),
    ("of", "_run", NAMESPACE + "usedFunction", "$_function", None),
    ("code", "_run", NAMESPACE + "codeStatement", "$_text", "string"),
    ("order", "_run", NAMESPACE + "executionOrder", "$order", "integer"),
    ("used", "_run", PROV + "used", "$_uri", None),
    ("held", "_holder", PROV + "hadMember", "$_held", None),
    ("attribute", "_held", NAMESPACE + "fromAttribute", "$_value", "string"),
    ("slice", "_held", NAMESPACE + "containerSlice", "$_value", "string"),
    ("index", "_held", NAMESPACE + "containerIndex", "$_value", "$_datatype"),
    ("data", "_uri", RDF_TYPE, NAMESPACE + "DataObjectEntity", None),
    ("file", "_uri", RDF_TYPE, NAMESPACE + "FileEntity", None),
    ("attributed", "_uri", PROV + "wasAttributedTo", "$_script", None),
    ("at", "_uri", NAMESPACE + "filePath", "$_file", "string"),
    ("hash", "_uri", NAMESPACE + "hashSource", "$_hash", "string"),
    ("value", "_uri", PROV + "value", "$_stored", "$_stored_type"),
    ("made", "_uri", PROV + "wasGeneratedBy", "$_run", None),
    ("source", "_uri", PROV + "wasDerivedFrom", "$_key", None),
    ("type", "_owner", RDF_TYPE, "$_key", None),
    *((relation, "_owner", NAMESPACE + relation, "$_pair", None) for relation in PAIRS.values()),
    ("pair", "_pair", RDF_TYPE, NAMESPACE + "NameValuePair", None),
    ("key", "_pair", NAMESPACE + "pairName", "$_key", "string"),
    ("literal", "_pair", NAMESPACE + "pairValue", "$_value", "$_datatype"),
)


NAMES = [t[0] for t in TRIPLES]


def _looked_up(values) -> str:
    """The text that ``values`` has at the place ``_code``."""
    return f"element_at(array({', '.join('NULL' if v is None else repr(v) for v in values)}, CAST(NULL AS STRING)), _code + 1)"


def _by_code(names) -> str:
    """The column, or NULL for None, that ``names`` has at the place ``_code``; a run of one name is one comparison."""
    names = list(names)
    ends = [n for n, c in enumerate(names) if names[n + 1 : n + 2] != [c]]
    return f"CASE {' '.join(f'WHEN _code <= {n} THEN CAST({names[n] or "NULL"} AS STRING)' for n in ends)} END"


def _uri(x: str) -> str:
    return f"""CASE {x}.kind WHEN 'object' THEN concat(_base, ':object:Python:', {x}.type, ':', {x}.hash)
      WHEN 'file' THEN concat(_base, ':file:', {x}.hash_type, ':', {x}.hash) ELSE raise_error(concat('no entity: ', {x}.kind)) END"""


def log_triples(log: DataFrame, distinct: bool = True, relations=None) -> DataFrame:
    """Triples of a DataFrame of records as JSON text (column ``value``), by expressions alone; with ``relations`` only those
    whose predicate has one of these local names, and of name/value pairs only those that such a relation owns.

    They are those of ``record_triples``; a record with an entity of unknown kind is an error, one that isn't JSON gives
    nothing.  A record is taken apart in three steps, to its entities, their items and the numbers of an item's triples, so
    that all is compiled: functions of arrays that take a function are interpreted, and so is whatever is within them.
    """
    at = {t[0]: n for n, t in enumerate(TRIPLES) if relations is None or t[2].rsplit("#", 1)[-1].rsplit("/", 1)[-1] in relations}
    none = "CAST(array() AS array<int>)"

    def codes(*names: str) -> str:
        found = [str(at[n]) for n in names if n in at]
        return f"array({', '.join(found)})" if found else none

    def numbers(first: int, found: str, *names: str) -> str:
        """first, first + 1, ...: one for each element, none of a null array or where no triple of them is wanted."""
        return f"IF(size({found}) > 0, sequence({first}, {first} + size({found}) - 1), {none})" if any(n in at for n in names) else none

    def items(kind: int, found: str, *names: str) -> str:
        return numbers(PLACES * kind, found, *names)

    pair_names = {kind: (name, "pair", "key", "literal") if name in at else () for kind, name in PAIRS.items()}
    rows = log.select(F.from_json("value", RECORD).alias("r")).select("r.*").selectExpr(
        "*",
        f"concat('urn:', authority, ':{TAG}') AS _base",
        "concat_ws('.', nullif(function.module, ''), function.name) AS _qualified",
        f"coalesce(function.name IN {MEMBERSHIPS} AND function.module = '', false) AS _member",
    )
    rows = rows.selectExpr(
        "*",
        "concat(_base, ':script:Python:', substring_index(script.path, '/', -1), ':', script.hash, '#', session) AS _script",
        "concat(_base, ':function_execution:Python:', concat_ws(':', script.hash, session, _qualified), '#', execution_id) AS _run",
        "concat(_base, ':function:Python:', _qualified) AS _function",
        f"""posexplode(IF(script IS NOT NULL AND (_member OR params IS NOT NULL), concat(array(CAST(NULL AS {ENTITY})), inputs, outputs), NULL))
        AS (_at, x)""",
    )
    rows = rows.selectExpr("*", "_at = 0 AS _is_record", "_at <= size(inputs) AS _is_input", "_at > 0 AND x.kind = 'file' AS _is_file")
    described = [items(k, f"x.{c}", *pair_names[k]) for k, c in ((DETAIL, "details"), (ANNOTATION, "annotations"))]
    rows = rows.selectExpr(
        "*",
        f"IF(_is_record, NULL, {_uri('x')}) AS _uri",
        f"""explode(CASE WHEN _is_record AND _member THEN array({PLACES * MEMBER})
          WHEN _is_record THEN concat(array({PLACES * HEAD}), {items(TYPE, "types", "type")}, {items(PARAM, "params", *pair_names[PARAM])})
          ELSE concat(array({PLACES * HEAD}), {items(TYPE, "x.types", "type")}, IF(_is_file, {none}, concat({described[0]}, {described[1]})),
            IF(_is_input OR _member, {none}, {items(SOURCE, "inputs", "source")})) END) AS _item""",
    )
    rows = rows.selectExpr("*", f"_item DIV {PLACES} AS _kind", f"_item % {PLACES} AS _n", "IF(_is_record, _run, _uri) AS _owner")
    rows = rows.selectExpr("*", f"CASE WHEN _kind = {PARAM} THEN from_json(params[_n], 'array<string>') WHEN _kind = {MEMBER} THEN from_json(params[0], 'array<string>') END AS _param")
    rows = rows.selectExpr(
        "*",
        f"""CASE WHEN _kind IN ({PARAM}, {MEMBER}) THEN _param[0] WHEN _kind = {DETAIL} THEN map_keys(x.details)[_n]
          WHEN _kind = {ANNOTATION} THEN map_keys(x.annotations)[_n] WHEN _kind = {TYPE} THEN IF(_is_record, types, x.types)[_n]
          WHEN _kind = {SOURCE} THEN {_uri("inputs[_n]")} END AS _key""",
        f"""CASE WHEN _kind IN ({PARAM}, {MEMBER}) THEN from_json(_param[1], 'array<string>') WHEN _kind = {DETAIL} THEN map_values(x.details)[_n]
          WHEN _kind = {ANNOTATION} THEN map_values(x.annotations)[_n] END AS _typed""",
        f"""CASE WHEN _kind IN {tuple(PAIRS)} THEN concat('_:', concat_ws('.', execution_id, element_at(array({", ".join(map(repr, PAIRS.values()))}),
          CAST(_kind AS INT) - {PARAM - 1}), _n, replace(right(substring_index(_owner, ':', -1), 40), '#', '.'))) END AS _pair""",
        f"CASE WHEN _kind = {MEMBER} THEN {_uri('inputs[0]')} END AS _holder",
        f"CASE WHEN _kind = {MEMBER} THEN {_uri('outputs[0]')} END AS _held",
    )
    rows = rows.selectExpr(
        "*",
        f"CASE WHEN _kind = {PARAM} THEN param_types[_key] WHEN _kind IN ({DETAIL}, {ANNOTATION}) THEN x.detail_types[_key] END AS _more",
        "get(_typed, 0) AS _value",
        f"concat('{XSD}', get(_typed, 1)) AS _datatype",
    )
    of_pair = " ".join(f"WHEN _kind = {k} THEN concat({codes(*names)}, {numbers(MORE, '_more', 'type')})" for k, names in pair_names.items())
    record_codes = codes(*(t[0] for t in TRIPLES if t[1] in ("_script", "_function", "_run") and t[0] != "used"))
    wanted = f"""CASE WHEN _kind = {TYPE} THEN {codes("type")} WHEN _kind = {SOURCE} THEN {codes("source")} {of_pair}
      WHEN _kind = {MEMBER} THEN concat({codes("script", "path", "held")},
        CASE _key WHEN 'name' THEN {codes("attribute")} WHEN 'slice' THEN {codes("slice")} ELSE {codes("index")} END)
      WHEN _is_record THEN {record_codes}
      ELSE concat(IF(_is_file, {codes("file", "attributed", "at")}, {codes("data", "attributed", "hash")}),
        IF(x.value IS NOT NULL AND NOT _is_file, {codes("value")}, {none}),
        CASE WHEN _member THEN {none} WHEN _is_input THEN {codes("used")} ELSE {codes("made")} END) END"""
    rows = rows.selectExpr(
        *("session", "started", "ended", "order", "_script", "_function", "_run", "_uri", "_holder", "_held", "_owner", "_pair", "_key", "_value", "_datatype", "_more"),
        *("script.path AS _path", "function.name AS _name", "function.module AS _module", "coalesce(function.version, '') AS _version"),
        *("coalesce(code, '') AS _text", "x.path AS _file", "x.hash_method AS _hash", "x.value[0] AS _stored", f"concat('{XSD}', x.value[1]) AS _stored_type"),
        f"explode({wanted}) AS _code",
    )
    kinds = ["literal" if t[4] else "bnode" if t[3] == "$_pair" else "uri" for t in TRIPLES]
    o, datatype = ([t[n] or "" for t in TRIPLES] for n in (3, 4))
    fixed = [None if x[:1] == "$" else x for x in o], [None if x[:1] in ("$", "") else XSD + x for x in datatype]
    own = [x[1:] if x[:1] == "$" else None for x in o], [x[1:] if x[:1] == "$" else None for x in datatype]
    out = rows.selectExpr(
        f"IF(_code >= {MORE}, _pair, {_by_code(t[1] for t in TRIPLES)}) AS s",
        f"IF(_code >= {MORE}, '{RDF_TYPE}', {_looked_up(t[2] for t in TRIPLES)}) AS p",
        f"IF(_code >= {MORE}, _more[_code - {MORE}], coalesce({_looked_up(fixed[0])}, {_by_code(own[0])})) AS o",
        f"IF(_code >= {MORE}, 'uri', {_looked_up(kinds)}) AS o_kind",
        f"IF(_code >= {MORE}, NULL, coalesce({_looked_up(fixed[1])}, {_by_code(own[1])})) AS o_datatype",
        "CAST(NULL AS STRING) AS o_lang",
        "session AS source",
        "_code",
    )
    kind = f"IF(_code IN ({NAMES.index('type')}) OR _code >= {MORE}, IF(startswith(o, '_:'), 'bnode', 'uri'), o_kind) AS o_kind"
    out = out.selectExpr("s", "p", "o", kind, "o_datatype", "o_lang", "source")
    return distinct_triples(out) if distinct else out
