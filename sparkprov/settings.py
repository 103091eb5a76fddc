"""Global settings with checked names and types."""

from __future__ import annotations

DEFAULTS = {"use_builtin_hash_for_module": [], "authority": "my-authority", "store_values": []}
_values = {k: list(v) if isinstance(v, list) else v for k, v in DEFAULTS.items()}

#: The tag in this engine's own identifiers, and its namespace; readers accept any.
TAG = "sparkprov"
NAMESPACE = "urn:sparkprov:ontology#"


def setting(name: str, value=None):
    """The setting ``name``; with a value of the same type, change it first."""
    if name not in _values:
        raise ValueError(f"no setting is called {name!r}")
    if value is not None:
        if type(value) is not type(DEFAULTS[name]):
            raise ValueError(f"{name} takes a {type(DEFAULTS[name]).__name__}")
        _values[name] = value
    return _values[name]
