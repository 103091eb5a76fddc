"""Written tables that end a lineage, and access to the sample tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths of tables that aren't deleted yet.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and Spark is this one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkprov-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    ``by`` is a column of few values by which the files are laid out, so that readers of some values open only theirs.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if name in WRITTEN:
        WRITTEN.remove(name)


def drop(*written: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing will read again."""
    for df in written:
        _delete(df.sparkSession, df.written)


def drop_all(spark: SparkSession) -> None:
    """Delete all that operators have written in this process: results not yet written elsewhere are lost."""
    for name in list(WRITTEN):
        _delete(spark, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
