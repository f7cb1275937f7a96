"""Latitude by site, light counts, the diagram's modes."""

import numpy as np
import pandas as pd
import pytest
from helpers import frame
from pyspark.sql import functions as F

from tidelint.functions import seawater, solar
from tidelint.operators import light as li
from tidelint.operators import reports
from tidelint.plans import panels as pn
from tidelint.plans import qualify as q

SOUTH, NORTH = "South (PR-RS)", "Amazonian Reefs / North (AP-MA)"


def test_depth_takes_the_latitude_of_its_site(spark):
    regions = spark.createDataFrame([("a", SOUTH), ("b", NORTH), ("x", "nowhere")], "Site string, region string")
    places = q.places_of(regions)
    assert {r.Site: (r.latitude, r.longitude) for r in places.collect()} == {"a": (-30.0, -49.0), "b": (-1.0, -46.0)}
    pdf = pd.DataFrame({"series_id": ["s", "t", "u"], "Site": ["a", "b", "c"], "Datetime": pd.Timestamp("2026-01-01"), "line_no": 0, "Pressure (dbar)": 3000.0})
    rows = q.prepare_scalar(frame(spark, pdf), q.Criteria(), False, False, "line_no", places=places).collect()
    one = spark.range(1).select(*[seawater.depth_from_pressure(F.lit(3000.0), x).alias(n) for n, x in (("a", -30.0), ("b", -1.0), ("c", q.Criteria().latitude))]).first()
    assert {r.Site: r["Depth (m)"] for r in rows} == one.asDict() and len(set(one)) == 3


@pytest.mark.parametrize("latitude", [-30.0, 0.0, 68.0])
def test_sky_of_a_column(spark, latitude):
    days = frame(spark, pd.DataFrame({"day": pd.date_range("2026-01-01", periods=365)}))
    got = days.withColumn("lat", F.lit(latitude)).select(
        solar.clear_sky_factor(F.col("day"), latitude).alias("one"), solar.clear_sky_factor(F.col("day"), F.col("lat")).alias("other")).toPandas()
    np.testing.assert_allclose(got.one, got.other, rtol=1e-12)
    assert got.one.max() == pytest.approx(1.0)


def test_fouling_under_each_sky(spark):
    day = pd.date_range("2026-01-01", periods=120)
    pdf = pd.concat([pd.DataFrame({"series_id": k, "ts": day + pd.Timedelta(hours=12), "lux": 100.0 + np.arange(120) % 3}) for k in ("n", "s", "none")])
    places = spark.createDataFrame([("n", 60.0), ("s", -60.0)], "series_id string, latitude double")
    got = {r.series_id: r for r in li.fouling_baseline(frame(spark, pdf), "series_id", latitude=-17.0, places=places).collect()}
    for k, latitude in (("n", 60.0), ("s", -60.0), ("none", -17.0)):
        alone = li.fouling_baseline(frame(spark, pdf[pdf.series_id == k]), "series_id", latitude=latitude).first()
        assert got[k].cutoff == alone.cutoff and got[k].baseline == pytest.approx(alone.baseline)
    assert got["n"].baseline > got["s"].baseline


def test_light_counts_do_not_spoil_rows(spark):
    rows = spark.createDataFrame([("a", 1, 4), ("a", 4, 1), ("a", 3, 9), ("a", 9, 3)], "k string, Flag_T int, Flag_lux int")
    got = reports.overall_report(rows, ["k"], ["Flag_T"], ["Flag_T"]).first().asDict()
    assert got == {"k": "a", "total": 4, "valid": 3, "T_bad": 1, "T_suspect": 1, "T_missing": 1, "lux_bad": 1, "lux_suspect": 1, "lux_missing": 1}
    assert "lux_bad" not in reports.overall_report(rows.drop("Flag_lux"), ["k"], ["Flag_T"], ["Flag_T"]).columns


def test_modes_of_the_diagram(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": "a", "ts": pd.Timestamp("2026-01-01"), "S": r.uniform(34, 37, 60), "T": r.uniform(10, 25, 60), "P": r.uniform(0, 40, 60), "f": 1})
    points = pn.ts_points(frame(spark, pdf), "S", "T", "P")
    for mode, (x, y) in (("conservative", ("sa", "ct")), ("potential", ("S", "pt"))):
        got = pn.ts_diagram(points, ["k"], "S", ["f"], mode).toPandas()
        want = points.select(x, y).toPandas()
        drawn = got[got.kind == "point"]
        np.testing.assert_allclose(np.sort(drawn.x), np.sort(want[x]))
        np.testing.assert_allclose(np.sort(drawn.y), np.sort(want[y]))
        nodes = got[got.kind == "node"]
        assert len(nodes) >= 9 and nodes.sigma.between(10, 40).all()
