import math
import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value that compares alike from Spark and from DuckDB: floats to nine digits, arrays as tuples."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(folder, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.execute(sql)
    cols = [d[0] for d in found.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="session")
def against_sql():
    """Asserts that a query's rows are those of its SQL over the tables of a folder."""

    def compare(df, folder, sql):
        names, rows = spark_rows(df)
        other, expected = duck_rows(folder, sql)
        assert names == other
        assert len(rows) == len(expected)
        wrong = [(a, b) for a, b in zip(rows, expected, strict=True) if a != b]
        assert not wrong, (len(wrong), str(wrong[0])[:1500])

    return compare
