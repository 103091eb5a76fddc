"""Paths, formats and file identity."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT = {"ttl": "turtle", "rdf": "xml", "json": "json-ld"}


def file_format(path) -> str | None:
    """The extension without its dot, None without one."""
    return Path(path).suffix[1:] or None


def prov_format(path) -> str | None:
    found = file_format(path)
    return SHORT.get(found, found)


def get_file_name(source, output_dir=None, extension=None, suffix=None) -> str:
    """The source's name with another folder, extension or suffix."""
    source = Path(source)
    ending = source.suffix if extension is None else "." + str(extension).lstrip(".")
    folder = source.parent if output_dir is None else Path(output_dir)
    return str((folder / f"{source.stem}{suffix or ''}{ending}").absolute())


class FileInformation:
    """A local file's path and SHA-256, read in blocks of 4 MiB; equal when hash type and hash are."""

    hash_type = "sha256"

    def __init__(self, path):
        self.path = Path(path).expanduser().resolve()
        digest = hashlib.sha256()
        with open(self.path, "rb") as f:
            while block := f.read(4 << 20):
                digest.update(block)
        self.hash = digest.hexdigest()

    def info(self) -> dict[str, str]:
        return {"hash": self.hash, "hash_type": self.hash_type, "path": str(self.path)}

    def __eq__(self, other) -> bool:
        if not isinstance(other, FileInformation):
            raise TypeError("only files compare with files")
        return (self.hash_type, self.hash) == (other.hash_type, other.hash)

    __hash__ = None

    def __repr__(self) -> str:
        return f"{self.path.name}({self.hash_type}:{self.hash})"


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash, hash_type) of each file below a path, hashed where it is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.sha2("content", 256).alias("hash"), F.lit("sha256").alias("hash_type"))
