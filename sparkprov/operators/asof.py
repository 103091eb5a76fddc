"""As-of join: the last row at or before a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, known: DataFrame, by: list[str], at: str) -> DataFrame:
    """``rows`` with the other columns of the last row of ``known`` that has equal ``by`` and no larger ``at``.

    One shuffle by ``by`` serves both sides: they are united, sorted and the last known row carried on.  Of known rows at
    one place the greatest stays; without one the columns are null, as where ``by`` or ``at`` is null.
    """
    more = [c for c in known.columns if c not in (*by, at)]
    best = known.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(F.struct(*more)).alias("_known"))
    left = rows.withColumn("_known", F.lit(None).cast(best.schema["_known"].dataType)).withColumn("_row", F.lit(1))
    right = best.withColumn("_row", F.lit(0))
    order = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), "_row").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_known", F.last("_known", ignorenulls=True).over(order))
    fits = F.col(at).isNotNull()
    for c in by:
        fits &= F.col(c).isNotNull()
    found = both.where("_row = 1")
    return found.select(*rows.columns, *(F.when(fits, F.col("_known")[c]).alias(c) for c in more))
