"""Indicators, votes, scores and diagnostics against pandas and closed values."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curves.operators import diagnostics as D
from curves.operators import indicators as I
from curves.operators import votes as G


def frame(spark, **series):
    rows = [(name, 2020, date(2000, 1, 1) + timedelta(days=i), float(x)) for name, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "structure string, vintage int, date date, close double")


def values(df, col, name):
    got = df.filter(f"structure = '{name}'").orderBy("date").toPandas()[col]
    return got.astype(float).to_numpy()


@pytest.fixture(scope="module")
def walk():
    return np.cumsum(np.random.default_rng(3).normal(0, 1, 1500))


@pytest.mark.parametrize("span", [2, 9, 12, 50])
def test_ema_over_many_blocks(spark, walk, span):
    want = pd.Series(walk).ewm(span=span, adjust=False).mean().to_numpy()
    assert np.abs(values(I.ema(frame(spark, a=walk), span, out="e"), "e", "a") - want).max() < 1e-9


def test_wilder_starts_at_the_first_value(spark, walk):
    tr = pd.Series(walk).diff().abs()
    want = tr.ewm(alpha=1 / 14, adjust=False).mean().to_numpy()
    got = values(I.atr(frame(spark, a=walk)), "atr", "a")
    assert np.isnan(got[0])
    assert np.abs(got[1:] - want[1:]).max() < 1e-9


def test_rsi_and_adx_against_pandas(spark, walk):
    d = pd.Series(walk).diff()
    up, down = (x.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean() for x in (d, -d))
    assert np.nanmax(np.abs(values(I.rsi(frame(spark, a=walk)), "rsi", "a") - (100 - 100 / (1 + up / down)).to_numpy())) < 1e-8
    plus, minus = 100 * up / (up + down), 100 * down / (up + down)
    adx = (100 * (plus - minus).abs() / (plus + minus)).ewm(alpha=1 / 14, adjust=False).mean()
    assert np.nanmax(np.abs(values(I.dmi_adx(frame(spark, a=walk)), "adx", "a") - adx.to_numpy())) < 1e-8


def test_closed_values(spark):
    df = frame(spark, up=range(1, 50), down=range(50, 1, -1), flat=[5.0] * 40)
    assert values(I.sma(df, 3, out="s"), "s", "up")[:4].tolist()[2:] == [2.0, 3.0]
    assert values(I.rsi(df), "rsi", "up")[-1] == 100 and values(I.rsi(df), "rsi", "down")[-1] == 0 and values(I.rsi(df), "rsi", "flat")[-1] == 100
    assert np.isnan(values(I.zscore(df, 20), "z20", "flat")).all()
    adx = I.dmi_adx(df)
    assert np.isnan(values(adx, "adx", "flat")).all() and values(adx, "plus_di", "up")[-1] == 100


def test_supertrend_flips_and_row0_never_does(spark):
    path = [*range(40), *range(40, 0, -1)]
    df = frame(spark, a=path)
    ways = values(I.supertrend(df), "direction", "a")
    assert ways[35] == 1 and ways[-1] == -1
    still = I.supertrend(df, seed="row0")
    assert set(values(still, "direction", "a")) == {1} and np.isnan(values(still, "supertrend", "a")).all()


def test_pivots_flag_plateaus(spark):
    path = [5, 4, 3, 2, 1, 0, 0, 1, 2, 3, 4, 5, 6]
    assert np.flatnonzero(values(I.pivots(frame(spark, a=path)), "pivot_low", "a")).tolist() == [5, 6]


def test_votes_on_ramps_and_short_series(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, up=np.linspace(0, 25, 260), down=np.linspace(25, 0, 260), short=[1.0, 2.0, 3.0], spike=[*(0.001 * np.arange(60)), 5.0])
    votes = {(r.structure, r.name): r.bias for r in G.all_signals(df).collect()}
    for name in ("MA ribbon", "ADX/DMI", "Supertrend"):
        assert votes["up", name] == 1 and votes["down", name] == -1
    assert votes["spike", "Z-Score"] == -1 and votes["spike", "Bollinger %B"] == -1
    assert all(votes["short", n] == 0 for n in ("ADX/DMI", "Supertrend", "MACD", "RSI (adaptive)", "Bollinger %B", "Z-Score"))
    assert len(votes) == 28
    panel = G.signal_panel(G.all_signals(df)).filter("structure = 'up' and family = 'Trend'").first()
    assert (panel.bias, panel.conviction) == (1, 1.0)
    assert rng is not None


def test_score_bounds_tilt_and_reading(spark):
    names = ["MA ribbon", "Z-Score"]
    rows = [(r, 1, n, b) for r, votes in (("bull", (1, 1)), ("mixed", (1, -1)), ("none", (0, 0))) for n, b in zip(names, votes, strict=True)]
    signals = spark.createDataFrame(rows, "structure string, vintage int, name string, bias int")
    for name, mixed in (("Contango", -47.4), ("Backwardation", 36.8)):
        regimes = spark.createDataFrame([(s, 1, name) for s in ("bull", "mixed", "none")], "structure string, vintage int, regime string")
        got = {r.structure: r for r in G.composite_score(G.contributions(signals, regimes)).collect()}
        assert got["bull"].score == 100 and got["bull"].reading == "Strong bullish bias"
        assert got["mixed"].score == mixed and got["none"].score == 0 and got["none"].reading == "Neutral / no clear edge"


def test_trade_levels(spark):
    base = list(np.random.default_rng(0).normal(0, 0.05, 59))
    df = frame(spark, hi=[*base, 1.0], lo=[*base, -1.0], mid=[*base, 0.0], short=[1.0] * 5)
    for mode, hi, lo in (("Mean reversion", "Short", "Long"), ("Breakout", "Long", "Short")):
        modes = df.select("structure", "vintage").distinct().selectExpr("*", f"'{mode}' AS mode")
        got = {r.structure: r for r in G.trade_levels(df, modes).collect()}
        assert (got["hi"].side, got["lo"].side, got["mid"].side, got["short"].side) == (hi, lo, "None", "None")
        assert got["hi"].entry == 1.0 and got["hi"].risk_reward > 0 and got["short"].entry is None


def test_regime_by_sign(spark):
    got = {r.structure: r.regime for r in G.regime(frame(spark, a=[0.4, 0.5, 0.6] * 10, b=[-0.4, -0.5, -0.6] * 10)).collect()}
    assert got == {"a": "Backwardation", "b": "Contango"}


def test_diagnostics_tell_mean_reversion_from_a_walk(spark):
    rng = np.random.default_rng(0)
    ar = [0.0]
    for e in rng.normal(0, 1, 399):
        ar.append(0.3 * ar[-1] + e)
    got = {r.structure: r for r in D.regime_diagnostics(frame(spark, ar=ar, walk=np.cumsum(np.cumsum(rng.normal(0, 1, 400))), short=[1.0, 2.0])).collect()}
    assert got["ar"].is_mean_reverting and got["ar"].adf_pvalue < 0.01 and got["ar"].half_life < 2 and got["ar"].hurst < 0.3
    assert got["walk"].hurst > 0.6 and got["walk"].variance_ratio > 1 and not got["walk"].is_mean_reverting
    assert (got["short"].hurst, got["short"].half_life, got["short"].variance_ratio, got["short"].adf_pvalue, got["short"].is_mean_reverting) == (None, None, None, None, False)


@pytest.mark.parametrize(("stat", "p"), [(-3.43, 0.01), (-3.12, 0.025), (-2.86, 0.05), (-2.57, 0.10), (-0.44, 0.90), (-0.07, 0.95), (0.23, 0.975), (0.60, 0.99)])
def test_adf_p_at_the_published_percentiles(stat, p):
    """Asymptotic percentiles of the statistic with a constant (Fuller 1976, MacKinnon 1994)."""
    assert abs(D.mackinnon_p(stat) - p) < 0.005  # the percentiles have two decimals


def plain_adf(close):
    """Lag search by loops and normal equations; the p-value and the lag."""
    n, steps = len(close), [b - a for a, b in zip(close, close[1:], strict=False)]
    most = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))

    def fit(lags, skip):
        rows = [[1.0, close[t], *(steps[t - k] for k in range(1, lags + 1))] for t in range(skip, len(steps))]
        want, size = steps[skip:], lags + 2
        gram = [[sum(r[a] * r[b] for r in rows) for b in range(size)] for a in range(size)]
        inverse = np.linalg.inv(np.array(gram))
        beta = inverse @ [sum(r[a] * y for r, y in zip(rows, want, strict=True)) for a in range(size)]
        rss = sum((y - sum(b * x for b, x in zip(beta, r, strict=True))) ** 2 for r, y in zip(rows, want, strict=True))
        return len(rows) * math.log(rss / len(rows)) + 2 * size, beta[1] / math.sqrt(rss / (len(rows) - size) * inverse[1, 1])

    scores = [fit(k, most)[0] for k in range(most + 1)]
    lag = scores.index(min(scores))
    return D.mackinnon_p(fit(lag, lag)[1]), lag


def test_adf_equals_a_plain_lag_search(spark):
    rng, series, lags = np.random.default_rng(12), {}, set()
    for i, coefs in enumerate([(0.5,), (1.0,), (0.9, -0.4), (0.3, 0.2, 0.4), (1.4, -0.4), (0.1, 0.0, 0.0, 0.6)]):
        for n in (25, 60, 180):
            xs = [0.0] * len(coefs)
            for e in rng.normal(0, 1, n):
                xs.append(sum(c * xs[-k - 1] for k, c in enumerate(coefs)) + e)
            series[f"s{i}_{n}"] = [5 + x for x in xs[-n:]]
    got = {r.structure: r.adf_pvalue for r in D.adf_pvalue(frame(spark, **series)).collect()}
    for name, xs in series.items():
        p, lag = plain_adf(xs)
        lags.add(lag)
        assert got[name] == pytest.approx(p, abs=1e-6), name
    assert {0, 1} < lags and len(lags) >= 4


def test_adf_polynomial_at_the_known_critical_value():
    z = sum(c * (-2.86) ** i for i, c in enumerate(D.SMALL_P))
    assert abs(0.5 * (1 + __import__("math").erf(z / 2**0.5)) - 0.05) < 0.002


def test_supertrend_in_blocks_equals_supertrend_in_one_task(spark):
    rng = np.random.default_rng(8)
    walk = np.cumsum(rng.normal(0, 1, 900))
    series = {"walk": walk, "flat": [5.0] * 200, "trend": np.arange(500) * 0.1 + rng.normal(0, 0.01, 500), "calm": 50 + 1e-3 * np.sin(np.arange(400)), "one": [1.0], "short": [1.0, 2.0, 1.5]}
    rows = frame(spark, **{k: list(map(float, v)) for k, v in series.items()})
    holes = rows.withColumn("close", F.when(F.dayofyear("date") % 17 != 0, F.col("close")))
    for df, block in ((rows, 100), (holes, 10_000)):
        key = lambda r: (r.structure, r.date)
        whole = sorted(I.supertrend(df).collect(), key=key)
        got = sorted(I.supertrend(df, block=block).collect(), key=key)
        assert [key(r) for r in got] == [key(r) for r in whole]
        assert [r.direction for r in got] == [r.direction for r in whole]
        assert [r.supertrend for r in got] == [x.supertrend if x.supertrend is None else pytest.approx(x.supertrend, rel=1e-9) for x in whole]


def test_supertrend_of_one_long_series_in_blocks(spark):
    rows = spark.range(20_000).selectExpr("'s' AS structure", "0 AS vintage", "timestamp_seconds(id * 60) AS date", "sin(id / 50.0) * 10 + id % 7 AS close")
    whole = {r.date: r.direction for r in I.supertrend(rows).collect()}
    assert {r.date: r.direction for r in I.supertrend(rows, block=5000).collect()} == whole
