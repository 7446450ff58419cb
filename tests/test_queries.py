"""Every registered query runs over the smallest tables, and gives what its SQL gives."""

import glob
import math
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

FOLDER = os.environ.get("WEFTLINE_TESTDATA", "/root/testdata/sf0.001")
SLOW = {"w_forecast"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name in entry.oracle_sql():
        got = sql.execute(entry.oracle_sql()[name])
        cols = [c[0] for c in got.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted(repr(tuple(norm(r[cols.index(c)]) for c in sorted(cols))) for r in got.fetchall())
        assert sorted(repr(tuple(norm(r[c]) for c in sorted(cols))) for r in rows) == want


def test_too_many_hints_are_an_error(spark, tmp_path):
    spark.range(51).selectExpr("id AS event_id", "concat('kind ', id) AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    with pytest.raises(ValueError, match="50"):
        entry.queries()["l_hinted"](spark, str(tmp_path))
