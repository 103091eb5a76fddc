"""Registries for packages whose objects need special care: converters of values and routes of metadata.

A converter turns a value into text or a plain value; it is found by the value's package, then by its type.  A metadata
plugin takes an object's type name and its metadata and gives ``{"attributes": {...}, "annotations": {...}}``.
"""

from __future__ import annotations

from collections.abc import Callable

#: Names that hold other objects of the electrophysiology package, and the attributes shown of those.
COLLECTIONS = (
    "segments", "events", "analogsignals", "spiketrains", "channel_indexes", "block",
    "segment", "epochs", "parent", "_items", "waveforms",
)
DISPLAYED = ("t_start", "t_stop", "shape", "dtype", "name", "description", "nix_name")
ANNOTATIONS = ("annotations", "array_annotations")

BY_PACKAGE: dict[str, Callable] = {}
BY_TYPE: dict[type, Callable] = {}
METADATA: dict[str, Callable[[str, dict], dict[str, dict]]] = {}


def add_converter(of: str | type, convert: Callable) -> None:
    """Register a converter for a package (by name) or a type."""
    if isinstance(of, str):
        BY_PACKAGE[of] = convert
    else:
        BY_TYPE[of] = convert


def add_metadata_plugin(package: str, route: Callable[[str, dict], dict[str, dict]]) -> None:
    METADATA[package] = route


def converted(value):
    """The value as its converter gives it; plain values as they are, others as text."""
    found = BY_PACKAGE.get(type(value).__module__.split(".")[0]) or BY_TYPE.get(type(value))
    return found(value) if found else value


def described(value, displayed: tuple[str, ...] = DISPLAYED) -> str:
    """A short text of an object: its class and those of the displayed attributes that it has."""
    kind = type(value)
    shown = [f"{name}={converted(getattr(value, name))}" for name in displayed if hasattr(value, name)]
    return f"{kind.__module__}.{kind.__name__}({', '.join(shown)})"


def route_neo(kind: str, metadata: dict) -> dict[str, dict]:
    """Collections and containers as short texts, dictionaries of annotations as annotations, the rest as attributes."""
    attributes, annotations = {}, {}
    for name, value in metadata.items():
        if name in ANNOTATIONS and isinstance(value, dict):
            annotations |= value
        elif name not in COLLECTIONS:
            attributes[name] = value
        elif isinstance(value, list):
            attributes[name] = f"[{', '.join(map(described, value))}]"
        else:
            attributes[name] = described(value)
    return {"attributes": attributes, "annotations": annotations}


def routed(kind: str, metadata: dict) -> dict[str, dict]:
    """Metadata of an object of type ``kind`` by its package's plugin; without one all are attributes."""
    plugin = METADATA.get(kind.split(".")[0])
    return plugin(kind, metadata) if plugin else {"attributes": metadata, "annotations": {}}


add_converter("neo", described)
add_converter("quantities", str)
add_converter(list, str)
add_metadata_plugin("neo", route_neo)
