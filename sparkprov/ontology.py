"""Semantic annotations: ``__ontology__`` dictionaries of functions and classes."""

from __future__ import annotations

import re

from .functions.urns import expand

KEYS = {"data_object": {"data_object", "namespaces", "attributes", "annotations"}, "function": {"function", "namespaces", "arguments", "returns"}}
NAMESPACES: dict[str, str] = {}


def add_namespaces(found: dict[str, str]) -> None:
    """Register prefixes; one prefix can't stand for two namespaces."""
    for prefix, uri in found.items():
        if NAMESPACES.setdefault(prefix, uri) != uri:
            raise ValueError(f"the prefix {prefix!r} already stands for {NAMESPACES[prefix]!r}")


class OntologyInformation:
    """What an object's, class's or function's annotation says."""

    @staticmethod
    def of(obj) -> dict | None:
        for x in (obj, getattr(obj, "__wrapped__", None), type(obj)):
            if isinstance(found := getattr(x, "__ontology__", None), dict):
                return found
        return None

    def __init__(self, obj):
        self.data = self.of(obj) or {}
        self.kind = "function" if "function" in self.data or {"arguments", "returns"} & set(self.data) else "data_object"
        if bad := set(self.data) - KEYS[self.kind]:
            raise ValueError(f"unknown keys {sorted(bad)}")
        add_namespaces(self.data.get("namespaces", {}))

    def get_uri(self, information_type: str, element=None):
        """The URI (or list) of an information type, or of one of its elements; None without one."""
        found = self.data.get(information_type)
        if element is not None:
            found = found.get(element) if isinstance(found, dict) else None
        return None if found is None or isinstance(found, dict) else expand(found, NAMESPACES)

    def get_container_returns(self) -> list[str]:
        """Keys of returns made of stars: one star a level."""
        return [k for k in self.data.get("returns", {}) if isinstance(k, str) and re.fullmatch(r"\*+", k)]

    def __repr__(self) -> str:
        return f"OntologyInformation({self.kind}: {', '.join(f'{k}={v!r}' for k, v in self.data.items())})"


def uris(found) -> list[str]:
    return [] if found is None else list(found) if isinstance(found, (list, tuple)) else [found]
