"""Settings of earlier versions."""

from dataclasses import replace

import pandas as pd
from helpers import frame

from tidelint.plans.criteria import Criteria, Factor, migrate
from tidelint.plans.test_plan import light_logger_plan, run_plan


def test_nothing_given_is_the_default():
    assert migrate({}) == Criteria() == migrate({"unknown": 3, "T": "no row"})


def test_shared_settings_count_for_both_instruments():
    got = migrate({"rep_cnt_fail": 9, "rep_cnt_susp": 6, "sensor_max_temp": 38, "temperature spikes": "OFF", "T": {"susp": 2, "fail": 4, "window": "1H"}, "O2": {"fail": 5}})
    assert (got.flat_fail, got.flat_suspect, got.logger_flat_fail, got.logger_flat_suspect) == (9, 6, 9, 6)
    assert got.sensor["T"] == (-5.0, 38.0) == got.logger_sensor_temp
    assert {"temperature spikes", "logger temperature spikes", "pressure flat line"} == got.off
    assert got.spike["T"] == got.rate["T"] == got.gradient["T"] == got.logger_spike == got.logger_rate == Factor(2.0, 4.0, "1H")
    assert got.spike["O2"] == Factor(2.5, 5.0, "30M") and got.spike["S"] == Factor()


def test_own_settings_win():
    got = migrate({"rep_cnt_fail": 9, "hobo_flat_fail": 12, "sensor_max_temp": 38, "hobo_sensor_max_temp": 45, "temperature spikes": "OFF", "hobo temperature spikes": "ON",
                   "pressure flat line": "ON", "T": {"susp": 2}, "hobo_rate_T": {"susp": 1}, "sg_rate_T": {"susp": 3}})
    assert (got.flat_fail, got.logger_flat_fail, got.logger_sensor_temp[1], got.off) == (9, 12, 45.0, {"temperature spikes"})
    assert (got.spike["T"].suspect, got.rate["T"].suspect, got.logger_rate.suspect, got.logger_spike.suspect) == (2.0, 3.0, 1.0, 2.0)


def test_a_logger_counts_its_own_flat_lines(spark):
    rows = frame(spark, pd.DataFrame({"k": "a", "ts": pd.date_range("2026-01-01", periods=12, freq="h"), "T": 20.0}))
    plan = light_logger_plan()

    def flags(criteria):
        out = run_plan(rows, plan, {"T": "T"}, "k", "ts", "ts", criteria, logger=True).toPandas()
        return out.filter(regex="(?i)flat").iloc[:, 0].tolist()

    loose = Criteria(flat_fail=4, flat_suspect=3)
    assert 4 not in flags(loose) and 4 in flags(replace(loose, logger_flat_fail=4, logger_flat_suspect=3))
