"""Extension: an append-only log of execution records as a stream of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.history import log_triples


def read_log(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Records (value, execution_id, ended) of a folder of JSON lines; a repeated execution counts once within ``late``."""
    lines = spark.readStream.format("text").load(folder)
    execution, ended = F.get_json_object("value", "$.execution_id"), F.get_json_object("value", "$.ended").cast("timestamp")
    rows = lines.select("value", execution.alias("execution_id"), ended.alias("ended"))
    return rows.withWatermark("ended", late).dropDuplicatesWithinWatermark(["execution_id"])


def stream_triples(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    return log_triples(read_log(spark, folder, late), distinct=False)
