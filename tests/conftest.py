import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loamline.session import build_session

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = build_session("tests", "local[4]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not (DATA / "sf0.001").exists():
        pytest.skip("the test tables aren't here")
    return str(DATA / "sf0.001")


def compare(frame, sql, sf_dir):
    """Rows of a Spark frame and of SQL over the same tables, as sorted lists."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    names = sorted(frame.columns)
    want = con.execute(sql).to_arrow_table()
    assert sorted(want.column_names) == names
    plain = lambda v: None if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v)
    rows = lambda t: sorted([tuple(plain(r[n]) for n in names) for r in t], key=str)
    got = rows([r.asDict() for r in frame.collect()])
    assert got == rows(want.to_pylist())
    return got
