import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from opinara.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


SF = "/root/testdata/sf0.001"


def oracle_rows(sql: str, columns: list[str], sf: str = SF):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return sorted((tuple(r[k] for k in at) for r in cur.fetchall()), key=str)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df.select(columns).collect()), key=str)
