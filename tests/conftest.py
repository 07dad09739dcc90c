import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("NEARFIELD_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from nearfield.session import local_session

    s = local_session(cores=4, shuffle_partitions=4)
    s.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", "64")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    d = os.environ.get("NEARFIELD_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    """Asserts that a query and its SQL give the same rows, in any order."""

    def check(query, sql):
        df = query(spark, sf_dir)
        cols = sorted(df.columns)
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        want = sorted((tuple(canonical(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=str)
        got = sorted((tuple(canonical(row[c]) for c in cols) for row in df.collect()), key=str)
        assert len(got) == len(want)
        assert got == want

    return check
