"""Identity and metadata of Python objects."""

from __future__ import annotations

import hashlib
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..settings import setting
from .plugins import converted, routed

#: Attributes that are taken besides an object's own dictionary.
METADATA = ("units", "shape", "dtype", "t_start", "t_stop", "id", "nix_name", "dimensionality", "pid", "create_time")
NUMBERS = ("int", "float", "complex", "bool", "str")


def type_name(obj) -> str:
    return f"{type(obj).__module__}.{type(obj).__qualname__}"


def ordered(obj):
    """The object, sets as sorted lists with a mark: their order differs between sessions."""
    if isinstance(obj, (set, frozenset)):
        return (type(obj).__name__, sorted((ordered(x) for x in obj), key=repr))
    if type(obj) in (list, tuple):
        return type(obj)(map(ordered, obj))
    if type(obj) is dict:
        return {k: ordered(v) for k, v in obj.items()}
    return obj


class ObjectInformation:
    """Describes objects; hashes are remembered by id as long as this lives (one call's inputs, another's outputs)."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[str, str]] = {}
        self.held: list = []

    def hash(self, obj) -> tuple[str, str]:
        if id(obj) in self.known:
            return self.known[id(obj)]
        builtin = set(setting("use_builtin_hash_for_module"))
        package = type(obj).__module__.split(".")[0]
        members = list(obj) if isinstance(obj, (list, tuple, set, frozenset)) else None
        if package in builtin:
            found = (str(hash(obj)), "Python_hash")
        elif members and all(type(m).__module__.split(".")[0] in builtin for m in members):
            found = (str(hash(tuple(members))), "Python_hash")
        elif isinstance(obj, DataFrame):
            plan = obj._jdf.queryExecution().analyzed().canonicalized().toString()
            found = (hashlib.sha1(f"{obj.schema.simpleString()}\n{plan}".encode()).hexdigest(), "plan_sha1")
        else:
            try:
                data = cloudpickle.dumps(ordered(obj))
            except Exception:  # open handles, sessions: what can't be pickled is told apart by its repr
                data = repr(obj).encode()
            found = (hashlib.sha1(data).hexdigest(), "content_sha1")
        self.known[id(obj)] = found
        self.held.append(obj)
        return found

    def info(self, obj) -> dict:
        """hash, hash_method, type, details, value."""
        kind = type_name(obj)
        if obj is None:
            return {"kind": "object", "hash": uuid.uuid4().hex, "hash_method": "UUID", "type": kind, "details": {}, "value": None}
        digest, method = self.hash(obj)
        if isinstance(obj, DataFrame):
            details = {"columns": ", ".join(obj.columns), "schema": obj.schema.simpleString()}
        else:
            details = {k: v for k, v in getattr(obj, "__dict__", {}).items() if not k.startswith("__")} if not isinstance(obj, type) else {}
            for name in METADATA:
                try:
                    details[name] = getattr(obj, name)
                except Exception:
                    continue
        scalar = isinstance(obj, (str, bool, int, float, complex)) or type(obj).__module__ == "numpy" and getattr(obj, "shape", None) == ()
        value = obj if scalar else str(obj) if kind in setting("store_values") else None
        found = routed(kind, details)
        return {
            "kind": "object",
            "hash": digest,
            "hash_method": method,
            "type": kind,
            "details": {k: literal(v) for k, v in found["attributes"].items()},
            "annotations": {k: literal(v) for k, v in found["annotations"].items()},
            "value": None if value is None else literal(value),
        }


def literal(v) -> tuple[str, str]:
    """(text, xsd type) of a value, converted first."""
    v = converted(v)
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v)).lower(), "boolean"
    if isinstance(v, int) or type(v).__name__.startswith(("int", "uint")) and type(v).__module__ == "numpy":
        return str(int(v)), "integer"
    if isinstance(v, float) or type(v).__name__.startswith("float") and type(v).__module__ == "numpy":
        return repr(float(v)), "double"
    return str(v), "string"
