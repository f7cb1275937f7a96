"""Every registered query with SQL agrees with it, whole and (a sample) split."""

import sys
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="sample tables are not here")

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from compare import TABLES, compare  # noqa: E402

SQL = entry.oracle_sql()
SPLIT = ("spike_screen", "w3_robust_sigma", "q5_rate_of_change", "q6_flat_line", "q9_density_inversion", "b21_edge_trim",
         "j1_interpolate_bracket", "j3_nearest", "q24_combine", "q19_transits", "q11_fouling_baseline", "s5_casts", "g16_ts_bounds", "p1_site_parameters")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_whole(spark, con, name):
    verdict = compare(entry.queries()[name](spark, str(DATA)).toPandas(), con.execute(SQL[name]).df())
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", SPLIT)
def test_split(spark, con, name):
    spark.conf.set("spark.tidelint.pieceRows", "40")
    try:
        got = entry.queries()[name](spark, str(DATA)).toPandas()
    finally:
        spark.conf.unset("spark.tidelint.pieceRows")
    verdict = compare(got, con.execute(SQL[name]).df())
    assert verdict.startswith("ok"), verdict


def test_every_query_is_registered_once():
    assert set(SQL) <= set(entry.queries())
    assert entry.entry.__doc__
