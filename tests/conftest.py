import glob
import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    local = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", local).config("spark.sql.warehouse.dir", f"{local}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def _rows(records, columns):
    """Rows as sortable tuples; floats by 9 significant decimals."""
    def plain(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float) or hasattr(v, "dtype"):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(plain(r[c]) for c in columns) for r in records)


@pytest.fixture(scope="session")
def same_as_sql():
    """Asserts that a DataFrame has the rows of a DuckDB query on the test tables, or on given ones."""

    def check(df, sql, tables=None):
        con = duckdb.connect()
        if tables is None:
            for p in glob.glob(f"{DATA}/*.parquet"):
                con.execute(f"create view {Path(p).stem} as select * from '{p}'")
        else:
            for name, frame in tables.items():
                arrow = frame.toArrow()
                con.register(name, arrow)
        found = con.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        expected = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        got = [r.asDict() for r in df.collect()]
        assert _rows(got, sorted(names)) == _rows(expected, sorted(names))

    return check
