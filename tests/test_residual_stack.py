import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import residual_stack as rs


@pytest.fixture(scope="module")
def reg(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, n, size in (("a", 260, 10.0), ("b", 200, 300.0), ("c", 30, 5.0), ("d", 1, 5.0)):
        y = size * (3 + np.sin(2 * np.pi * np.arange(n) / 7) + 0.4 * np.sign(np.sin(2 * np.pi * np.arange(n) / 28)) + 0.05 * rng.normal(size=n))
        rows += [(name, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, f"{rs.KEY} string, ds date, y double")


def test_more_blocks_lower_the_training_error(reg):
    series = rs.series_arrays(reg).checkpoint()
    stack, errors = rs.fit(series, 7, 35, blocks=9)
    assert len(stack.heads) == 9 and len(errors) == 10
    assert all(b < a for a, b in zip(errors, errors[1:])) and errors[-1] < 0.3 * errors[0]


def test_fit_equals_one_over_all_windows_at_hand(reg):
    series = rs.series_arrays(reg).checkpoint()
    stack, errors = rs.fit(series, 7, 35, blocks=2, features=16)
    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.array(r["y"]), 42) for r in series.collect() if len(r["y"]) >= 42])
    x, mean, spread = rs.normalised(windows[:, :35])
    target = (windows[:, 35:] - mean) / spread
    plain, rest, left = rs.Stack(35, 7, 16), x, target
    for k in range(2):
        assert errors[k] == pytest.approx((left**2).mean())
        z = plain.layer(k, rest)
        head = np.linalg.solve(z.T @ z + rs.RIDGE * np.eye(17), z.T @ np.column_stack([rest, left]))
        assert np.allclose(head, stack.heads[k], atol=1e-6)
        rest, left = rest - z @ head[:, :35], left - z @ head[:, 35:]


def test_backcasts_and_rest_add_up_to_the_input(reg):
    stack, _ = rs.fit(rs.series_arrays(reg).checkpoint(), 5, 25, blocks=4)
    x = np.random.default_rng(1).normal(size=(40, 25))
    rest, forecast, backcasts = stack.run(x)
    assert len(backcasts) == 4 and np.allclose(sum(backcasts) + rest, x) and forecast.shape == (40, 5)
    assert (rest**2).sum() < (x**2).sum()


def test_forecast_follows_the_pattern(reg):
    series, stack = rs.train(reg, 14)
    assert stack.lookback == 70 and len(stack.heads) == rs.BLOCKS
    got = {}
    for r in rs.predict(series, stack).collect():
        got.setdefault(r[rs.KEY], {})[r["ds"]] = r["yhat"]
    assert set(got) == {"a", "b"} and all(len(v) == 14 for v in got.values())
    for name, n, size in (("a", 260, 10.0), ("b", 200, 300.0)):
        t = n + np.arange(14)
        want = size * (3 + np.sin(2 * np.pi * t / 7) + 0.4 * np.sign(np.sin(2 * np.pi * t / 28)))
        assert np.abs(np.array([got[name][d] for d in sorted(got[name])]) - want).mean() < 0.3 * size


def test_no_window_and_no_series(reg, spark):
    short = reg.filter(F.col(rs.KEY).isin("c", "d"))
    series, stack = rs.train(short, 14)
    assert stack.heads == [] and rs.predict(series, stack).count() == 0
    series, stack = rs.train(reg.limit(0), 14)
    assert rs.predict(series, stack).count() == 0
