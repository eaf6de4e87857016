"""Seasonal reads against plain loops."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from curves.operators import seasonality as S

SCHEMA = "structure string, vintage int, date date, day_of_year int, days_to_expiry int, close double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for v in range(2016, 2023):
        days = sorted(rng.choice(400, 220, replace=False), reverse=True)
        close = np.cumsum(rng.normal(0, 1, 220))
        out += [("x", v, date(v, 1, 1) + timedelta(days=int(400 - d)), 1, int(d), float(c)) for d, c in zip(days, close, strict=True)]
    return out


@pytest.fixture(scope="module")
def stack(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def active(spark, vintage=2022):
    return spark.createDataFrame([("x", vintage)], "structure string, vintage int")


def capped(rows):
    by = {}
    for _, v, day, _, d, c in rows:
        if 0 <= d <= 330:
            by.setdefault(v, []).append((day, d, c))
    return {v: sorted(x) for v, x in by.items()}


def test_cone_excludes_the_active_vintage(spark, stack, rows):
    hist = [(d, c) for v, xs in capped(rows).items() if v != 2022 for _, d, c in xs]
    got = {r.d: r for r in S.seasonal_cone(stack, active(spark)).collect()}
    lo, hi = min(d for d, _ in hist), max(d for d, _ in hist)
    for d in range(lo, hi + 1):
        near = [c for x, c in hist if abs(x - d) <= 3]
        if not near:
            assert d not in got
            continue
        r = got.pop(d)
        assert r.n == len(near)
        assert np.allclose([r.mean, r.std, r.median, r.lower], [np.mean(near), np.std(near), np.median(near), np.mean(near) - np.std(near)])
    assert not got


def _bias(by, vintage, anchor, h=20):
    up = down = 0
    for v, xs in by.items():
        if v == vintage:
            continue
        j = min(range(len(xs)), key=lambda k: (abs(xs[k][1] - anchor), k))
        if abs(xs[j][1] - anchor) <= 3 and j + h < len(xs):
            move = xs[j + h][2] - xs[j][2]
            up, down = up + (move > 0), down + (move < 0)
    return up, down


def test_bias_at_three_horizons(spark, stack, rows):
    by = capped(rows)
    # an active vintage in mid life has others' later rows to look at
    cut = stack.filter("vintage <> 2022 or days_to_expiry > 150")
    by[2022] = [x for x in by[2022] if x[1] > 150]
    got = {r.horizon: (r.up, r.down) for r in S.seasonal_bias(cut, active(spark), horizons=(10, 20, 30)).collect()}
    assert got == {h: _bias(by, 2022, by[2022][-1][1], h) for h in (10, 20, 30)}
    assert sum(got[10]) > 0


def test_backtest_equals_all_pairs(spark, stack, rows):
    by, want = capped(rows), {"Tailwind": [], "Headwind": [], "Mixed": []}
    for v, xs in by.items():
        for i in range(20, len(xs) - 20):
            trend = np.sign(xs[i][2] - xs[i - 20][2])
            up, down = _bias(by, v, xs[i][1])
            kind = "Mixed" if up == down else "Tailwind" if (up > down) == (trend > 0) else "Headwind"
            want[kind].append((xs[i + 20][2] - xs[i][2]) * trend)
    for r in S.alignment_backtest(S.backtest_rows(stack)).collect():
        xs = want[r.alignment]
        assert r.n == len(xs) and np.allclose([r.avg_continuation, r.median_return], [np.mean(xs), np.median(xs)])


def test_backtest_counts_vintages_before_the_filters(spark):
    """A second vintage too short for a trend or a later close still makes the first one's rows count."""
    start, rng = date(2020, 1, 1), np.random.default_rng(2)
    long = [("x", 2020, start + timedelta(days=i), 1, 300 - i, float(c)) for i, c in enumerate(np.cumsum(rng.normal(0, 1, 200)))]
    short = [("x", 2021, start + timedelta(days=i), 1, 10 - i, 1.0) for i in range(10)]
    got = {r.alignment: r.n for r in S.alignment_backtest(S.backtest_rows(spark.createDataFrame([*long, *short], SCHEMA))).collect()}
    assert got == {"Tailwind": 0, "Headwind": 0, "Mixed": 160}
    assert S.alignment_backtest(S.backtest_rows(spark.createDataFrame(long, SCHEMA))).count() == 0


def test_percentile_of_the_richest_is_100(spark, stack):
    top = stack.withColumn("close", F.when(F.col("vintage") == 2022, 1e6).otherwise(F.col("close")))
    cut = top.filter("vintage <> 2022 or days_to_expiry > 100")
    assert S.current_percentile(cut, active(spark)).first().percentile == 100


@pytest.mark.parametrize(
    ("s", "t", "want"),
    [("Bullish", "Up", "Tailwind"), ("Bullish", "Down", "Headwind"), ("Bearish", "Down", "Tailwind"), ("Bearish", "Up", "Headwind"), ("Neutral", "Up", "Mixed"), ("Bullish", "Flat", "Mixed"), ("Bearish", "Bearish", "Tailwind"), ("Neutral", "Neutral", "Mixed")],
)
def test_alignment(spark, s, t, want):
    assert spark.range(1).select(S.alignment(F.lit(s), F.lit(t)).alias("a")).first().a == want


@pytest.mark.parametrize(("least", "phase"), [(10, "Expiry-risk"), (300, "Quiet"), (200, "Build-up"), (120, "Acceleration"), (40, "Late"), (340, "Quiet")])
def test_lifecycle(spark, stack, least, phase):
    got = S.lifecycle(stack.filter(f"vintage <> 2022 or days_to_expiry >= {least}"), active(spark)).first()
    assert got.phase == phase and (got.days_to_expiry is None) == (least == 340)


def test_bucket_edges_fall_in_two(spark):
    rows = [("x", 1, date(2020, 1, 1), 1, d, 0.0) for d in (0, 30, 183, 305, 366, 400, -5)]
    got = S.maturity_slices(spark.createDataFrame(rows, SCHEMA)).groupBy("days_to_expiry").count().collect()
    assert {r.days_to_expiry: r["count"] for r in got} == {0: 2, 30: 3, 183: 3, 305: 3, 366: 2, 400: 1}


def test_empty_stack(spark):
    none = spark.createDataFrame([], SCHEMA)
    who = active(spark)
    assert S.seasonal_cone(none, who).count() == S.current_percentile(none, who).count() == S.monthly_heatmap(none).count() == 0
    assert S.alignment_backtest(S.backtest_rows(none)).count() == 0
    assert S.lifecycle(none, who).first().phase == "Quiet"
