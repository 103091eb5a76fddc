"""A set of triples that reads and writes RDF files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..plans.history import PREFIXES, log_triples
from . import rdf
from .files import prov_format
from .reader import collected, distinct_triples, read_triples


class ProvDocument:
    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession()
        self.parts: list[DataFrame] = []
        self.is_set = True

    def add(self, more: DataFrame, distinct: bool = True) -> None:
        """Add triples, which may repeat unless ``distinct``; equal ones merge, once for all that was added."""
        self.is_set = distinct and not self.parts
        self.parts.append(more)

    @property
    def triples(self) -> DataFrame | None:
        """The set of all triples, None without any."""
        if self.parts and not self.is_set:
            whole = self.parts[0]
            for more in self.parts[1:]:
                whole = whole.unionByName(more)
            self.parts, self.is_set = [distinct_triples(whole)], True
        return self.parts[0] if self.parts else None

    def read_records(self, file_name, file_format: str | None = "turtle") -> None:
        """Add a file's triples; without a format its extension tells."""
        self.add(read_triples(self.spark, str(file_name), form=file_format))

    def add_history(self, history: list[dict], show_progress: bool = False) -> None:
        """Add a session's records; empty histories add nothing."""
        from ..capture.tracker import progress

        rows = [(json.dumps(r),) for r in progress(history, show_progress)]
        if rows:
            self.add(log_triples(self.spark.createDataFrame(rows, "value string"), distinct=False), distinct=False)

    def serialize(self, file_name=None, file_format: str | None = "turtle"):
        """Write one file, or give the text; ``reader.write_nt`` writes large sets from the executors."""
        form = file_format or prov_format(file_name or "")
        if form is None:
            raise ValueError("no format can be told from the name")
        text = rdf.serialize(list(collected(self.triples)) if self.triples is not None else [], form, PREFIXES)
        if file_name is None:
            return text
        with open(file_name, "w", encoding="utf-8") as f:
            f.write(text)
        return None
