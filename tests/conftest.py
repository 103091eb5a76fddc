import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def against_duckdb(frame, sql, sf_dir):
    """Rows of a Spark result and of the SQL over the same tables, as sorted text."""
    import duckdb

    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    other, mine = c.sql(sql).df(), frame.toPandas()
    assert sorted(mine.columns) == sorted(other.columns)

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))

    return rows(mine), rows(other)
