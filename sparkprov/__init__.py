"""Data provenance on Spark: capture, RDF, graphs and their summaries."""

from .capture.plugins import add_converter, add_metadata_plugin
from .capture.tracker import activate, clear, deactivate, get_prov_info, print_history, save_provenance, track
from .operators.graph import ProvGraph
from .settings import setting
from .sources.document import ProvDocument
from .sources.files import get_file_name

__all__ = [
    "ProvDocument",
    "ProvGraph",
    "activate",
    "add_converter",
    "add_metadata_plugin",
    "clear",
    "deactivate",
    "get_file_name",
    "get_prov_info",
    "print_history",
    "save_provenance",
    "setting",
    "track",
]
