"""Identifiers of objects, files, functions, scripts and executions, as Column expressions and for plain strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import TAG


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_urn(authority: str) -> str:
    return f"urn:{authority}:{TAG}"


def object_urn(authority: str, kind: Column | str, digest: Column | str) -> Column:
    return F.concat_ws(":", F.lit(f"{base_urn(authority)}:object:Python"), _c(kind), _c(digest).cast("string"))


def file_urn(authority: str, hash_type: Column | str, digest: Column | str) -> Column:
    return F.concat_ws(":", F.lit(f"{base_urn(authority)}:file"), _c(hash_type), _c(digest))


def qualified(module: Column | str, name: Column | str) -> Column:
    """module.name, or the name alone where the module is null or empty."""
    return F.concat_ws(".", F.nullif(_c(module), F.lit("")), _c(name))


def function_urn(authority: str, module: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit(f"{base_urn(authority)}:function:Python:"), qualified(module, name))


def script_urn(authority: str, path: Column | str, digest: Column | str, session: Column | str) -> Column:
    file = F.element_at(F.split(_c(path), "/"), -1)
    return F.concat(F.lit(f"{base_urn(authority)}:script:Python:"), file, F.lit(":"), _c(digest), F.lit("#"), _c(session).cast("string"))


def execution_urn(authority: str, script: Column | str, session: Column | str, function: Column | str, execution: Column | str) -> Column:
    parts = (F.lit(f"{base_urn(authority)}:function_execution:Python"), _c(script), _c(session).cast("string"), _c(function))
    return F.concat(F.concat_ws(":", *parts), F.lit("#"), _c(execution).cast("string"))


def local_part(urn: Column | str) -> Column:
    """What follows authority and tag."""
    return F.regexp_extract(_c(urn), r"^urn:[^:]+:[^:]+:(.+)$", 1)


def entity_info(urn: Column | str) -> dict[str, Column]:
    """type, data_hash, label, python_name, hash_type of an entity's identifier."""
    parts = F.split(local_part(urn), ":")
    kind, before = F.element_at(parts, 1), F.try_element_at(parts, F.lit(-2))
    is_file = kind == "file"
    return {
        "type": kind,
        "data_hash": F.element_at(parts, -1),
        "label": F.when(is_file, F.lit("File")).otherwise(F.element_at(F.split(before, r"\."), -1)),
        "python_name": F.when(~is_file, before),
        "hash_type": F.when(is_file, before),
    }


def activity_info(urn: Column | str) -> dict[str, Column]:
    tail = F.split(F.element_at(F.split(_c(urn), ":"), -1), "#")
    return {"type": F.lit("function"), "python_name": F.element_at(tail, 1), "execution_id": F.try_element_at(tail, F.lit(2))}


def membership_label(kind: Column | str, value: Column | str) -> Column:
    """[index] or [slice], .attribute."""
    return F.when(_c(kind) == "attribute", F.concat(F.lit("."), _c(value))).otherwise(F.concat(F.lit("["), _c(value), F.lit("]")))


def expand_curie(uri: Column | str, prefixes: dict[str, str]) -> Column:
    """<full> to full, prefix:name by the table of prefixes; an unknown prefix gives null."""
    u = _c(uri)
    table = F.create_map(*(F.lit(x) for pair in prefixes.items() for x in pair)) if prefixes else F.create_map().cast("map<string,string>")
    known = F.concat(table[F.substring_index(u, ":", 1)], F.regexp_extract(u, r"^[^:]*:(.*)$", 1))
    return F.when(u.rlike("^<.*>$"), F.regexp_extract(u, "^<(.*)>$", 1)).otherwise(known)


def expand(uri: str | list[str], prefixes: dict[str, str]) -> str | list[str]:
    """The same for plain strings; a list of one gives its element."""
    if isinstance(uri, (list, tuple)):
        found = [expand(u, prefixes) for u in uri]
        return found[0] if len(found) == 1 else found
    if m := re.fullmatch(r"<(.*)>", uri):
        return m[1]
    prefix, _, name = uri.partition(":")
    if prefix not in prefixes:
        raise ValueError(f"unknown prefix in {uri!r}")
    return prefixes[prefix] + name
