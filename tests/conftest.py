import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 6)
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Asserts that a query and its SQL return the same rows under the same names."""

    def check(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        mine = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
        cursor = duck.execute(sql)
        found = [x[0] for x in cursor.description]
        assert sorted(found) == names
        at = [found.index(n) for n in names]
        assert canonical(mine) == canonical([tuple(r[i] for i in at) for r in cursor.fetchall()])

    return check
