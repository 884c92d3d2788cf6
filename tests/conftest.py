import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from symbolarium.session import local_session

    s = local_session(4, "3g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def compare(spark, sf):
    """Run a query and its SQL and return both results as sorted lists of texts."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def text(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def run(query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        ours = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        theirs = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
        return ours, theirs

    return run
