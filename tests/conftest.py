import os
import tempfile

import pytest

from bandweave.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(
        "local[4]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bandweave-tests-"),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows_of(pdf):
    """Rows as comparable tuples, columns by name, in any order."""

    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        return repr(float(v) + 0.0) if isinstance(v, float) else str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(v) for v in row) for row in pdf.astype(object).itertuples(index=False)), key=repr)
