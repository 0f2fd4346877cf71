"""Metrics from late and corrected actuals equal metrics over all rows, in any order of arrival."""

from __future__ import annotations

import datetime as dt
import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import monitoring
from shelfcast.operators.monitoring import ActualsLog, merged_states, newest_actuals, state_change, state_metrics

ACTUAL = "item_code string, date date, quantity double, revision long, run_id string"
FORECAST = "run_id string, item_code string, date date, horizon int, yhat double, revision long"
DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def forecasts(spark):
    rng = random.Random(1)
    rows = [(run, f"i{i}", day(h), h, rng.choice([0.0, 1.5, 4.0, 7.25]), 9) for run in ("a", "b") for i in range(6) for h in range(1, 5)]
    return spark.createDataFrame([*rows, ("a", "i0", day(2), 2, None, 9), ("a", None, day(2), 2, 1.0, 9)], FORECAST)


def deliveries():
    rng = random.Random(2)
    out = []
    for _ in range(3):
        rows = [(f"i{rng.randrange(7)}", day(rng.randint(1, 5)), float(rng.randrange(6)), rng.randrange(4), "clash") for _ in range(15)]
        out.append([*rows, rows[0], (None, day(1), 1.0, 1, None), ("i1", None, 1.0, 1, None), ("i1", day(1), None, 9, None)])
    out[0].append(("i2", day(3), 3.0, None, None))
    return out


def expected(spark):
    best: dict = {}
    for item, date, quantity, revision, _ in (r for d in deliveries() for r in d):
        if item is not None and date is not None and quantity is not None:
            key = (-math.inf if revision is None else revision, quantity)
            best[item, date] = max(best.get((item, date), key), key)
    rows: dict = {}
    for r in forecasts(spark).collect():
        if r["yhat"] is not None and (r["item_code"], r["date"]) in best:
            rows.setdefault((r["run_id"], r["horizon"]), []).append((best[r["item_code"], r["date"]][1], r["yhat"]))
    return {
        k: (
            len(v),
            sum(abs(a - p) for a, p in v) / len(v),
            math.sqrt(sum((a - p) ** 2 for a, p in v) / len(v)),
            sum(abs(a - p) for a, p in v) / max(sum(abs(a) for a, _ in v), 1e-9),
            sum(2 * abs(a - p) / (a + p) if a + p else 0 for a, p in v) / len(v),
        )
        for k, v in rows.items()
    }


def by_run_and_horizon(state):
    return {(r["run_id"], r["horizon"]): tuple(r)[2:] for r in state_metrics(state, "run_id", "horizon").collect()}


@pytest.mark.parametrize("order", [*permutations(range(3))][::2])
def test_any_order_of_arrival_gives_the_metrics_of_all_rows(spark, order):
    parts = [spark.createDataFrame(d, ACTUAL) for d in deliveries()]
    earlier, state = parts[0].limit(0), None
    for k in order:
        change = state_change(forecasts(spark), earlier, parts[k])
        state = change if state is None else state.unionByName(change)
        earlier = earlier.unionByName(parts[k])
    got, want = by_run_and_horizon(merged_states(state)), expected(spark)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_log_adds_up_and_a_repeated_delivery_changes_nothing(spark, tmp_path):
    log = ActualsLog(spark, str(tmp_path / "log"))
    assert log.state().collect() == [] and log.actuals().collect() == []
    for k, rows in enumerate(deliveries()):
        assert log.record(f"d{k}", spark.createDataFrame(rows, ACTUAL), forecasts(spark))
    before = by_run_and_horizon(log.state())
    assert before.keys() == expected(spark).keys()
    assert all(before[k] == pytest.approx(v, abs=1e-9) for k, v in expected(spark).items())
    assert not log.record("d1", spark.createDataFrame(deliveries()[1], ACTUAL), forecasts(spark))
    assert log.record("empty", spark.createDataFrame([], ACTUAL), forecasts(spark))
    assert by_run_and_horizon(log.state()) == before


def test_recording_that_fails_leaves_the_state_and_can_be_repeated(spark, tmp_path, monkeypatch):
    log = ActualsLog(spark, str(tmp_path / "log"))
    first, second = (spark.createDataFrame(d, ACTUAL) for d in deliveries()[:2])
    log.record("one", first, forecasts(spark))
    before = by_run_and_horizon(log.state())
    with pytest.raises(Exception, match="lost"):
        log.record("two", second.withColumn("quantity", F.raise_error(F.lit("lost")).cast("double")), forecasts(spark))
    monkeypatch.setattr(monitoring, "state_change", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        log.record("two", second, forecasts(spark))
    monkeypatch.undo()
    assert by_run_and_horizon(log.state()) == before
    assert log.record("two", second, forecasts(spark))
    assert log.actuals().count() == newest_actuals(first).count() + newest_actuals(second).count()


def test_an_empty_delivery_changes_nothing(spark):
    change = state_change(forecasts(spark), spark.createDataFrame(deliveries()[0], ACTUAL), spark.createDataFrame([], ACTUAL))
    assert change.collect() == []
