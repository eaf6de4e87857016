"""Indicator votes, family verdicts, regime-weighted scores, risk and trade plans: one row a series and vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curves.functions import vocab as V
from curves.operators import indicators as I

KEYS = ["structure", "vintage"]
NO_HISTORY = "insufficient history"
MIN_ROWS = {"technical": 5, "bands": 20, "score": 30}


def eligible(df: DataFrame, least: int, keys: list[str] = KEYS) -> DataFrame:
    """The rows of series with at least so many of them."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("__n") >= least).drop("__n")


def last_rows(df: DataFrame, cols: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Each series' values on its last date, and n, its number of rows."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "date").alias("l"), F.count("*").cast("int").alias("n"))
    return last.select(*keys, "n", *[F.col(f"l.{c}").alias(c) for c in cols])


def _vote(name: str, *cases: tuple[Column | None, int, Column | None, Column | str]) -> Column:
    """Struct of the first case that holds: (condition, bias, value, note)."""
    out = None
    for when, bias, value, note in cases:
        row = F.struct(
            F.lit(name).alias("name"), F.lit(bias).cast("int").alias("bias"),
            (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(note) if isinstance(note, str) else note).alias("note"),
        )
        out = F.when(when, row) if out is None else (out.otherwise(row) if when is None else out.when(when, row))
    return out


# The names and notes of votes and plans below are part of the results.


def ma_vote() -> Column:
    f, m, s = F.col("ema20"), F.col("ema50"), F.col("sma200")
    few = s.isNull()
    return _vote(
        "MA ribbon",
        (f.isNull() | m.isNull(), 0, None, NO_HISTORY),
        (few & (f > m), 1, None, "fast/mid only"), (few & (f < m), -1, None, "fast/mid only"), (few, 0, None, "fast/mid only"),
        ((f > m) & (m > s), 1, None, "stacked up"), ((f < m) & (m < s), -1, None, "stacked down"), (None, 0, None, "mixed"),
    )


def adx_vote(period: int = 14, trend: float = 25.0, quiet: float = 20.0) -> Column:
    a, plus, minus = F.col("adx"), F.col("plus_di"), F.col("minus_di")
    note = F.format_string("ADX %.0f trending", a)
    return _vote(
        "ADX/DMI",
        (F.col("n") < period + 1, 0, None, NO_HISTORY), (a.isNull(), 0, None, "range"), (a < quiet, 0, a, "range"),
        ((a >= trend) & (plus > minus), 1, a, note), (a >= trend, -1, a, note), (None, 0, a, F.format_string("ADX %.0f", a)),
    )


def supertrend_vote(period: int = 10) -> Column:
    d = F.col("direction")
    return _vote("Supertrend", (F.col("n") < period + 1, 0, None, NO_HISTORY), (d > 0, 1, d, "up-trend"), (None, -1, d, "down-trend"))


def macd_vote(slow: int = 26, signal: int = 9) -> Column:
    h, d = F.col("hist"), F.col("divergence")
    note = F.format_string("hist %+.3f", h)
    return _vote(
        "MACD",
        ((F.col("n") < slow + signal) | h.isNull(), 0, None, NO_HISTORY), (d == 1, 1, h, "bullish divergence"), (d == -1, -1, h, "bearish divergence"),
        (h > 0, 1, h, note), (h < 0, -1, h, note), (None, 0, h, note),
    )


def rsi_vote(period: int = 14) -> Column:
    r, known = F.col("rsi"), F.col("rsi_upper").isNotNull() & F.col("rsi_lower").isNotNull()
    up, low = F.when(known, F.col("rsi_upper")).otherwise(70.0), F.when(known, F.col("rsi_lower")).otherwise(30.0)
    return _vote(
        "RSI (adaptive)",
        ((F.col("n") < period + 1) | r.isNull(), 0, None, NO_HISTORY), (r >= up, -1, r, F.format_string("RSI %.0f overbought", r)),
        (r <= low, 1, r, F.format_string("RSI %.0f oversold", r)), (None, 0, r, F.format_string("RSI %.0f", r)),
    )


def bollinger_vote(period: int = 20) -> Column:
    p = F.col("pctb")
    return _vote(
        "Bollinger %B",
        ((F.col("n") < period) | p.isNull(), 0, None, NO_HISTORY), (p >= 1, -1, p, "above upper band"), (p <= 0, 1, p, "below lower band"),
        (None, 0, p, F.format_string("%%B=%.2f", p)),
    )


def zscore_vote(threshold: float = 2.0) -> Column:
    z = F.col("z60")
    return _vote(
        "Z-Score",
        (z.isNull(), 0, None, NO_HISTORY), (z >= threshold, -1, z, F.format_string("+%.1fσ rich", z)),
        (z <= -threshold, 1, z, F.format_string("%.1fσ cheap", z)), (None, 0, z, F.format_string("%+.1fσ", z)),
    )


VOTES = {"ma": ma_vote, "adx": adx_vote, "supertrend": supertrend_vote, "macd": macd_vote, "rsi": rsi_vote, "bollinger": bollinger_vote, "zscore": zscore_vote}


def _voted(df: DataFrame, parts: list[str], keys: list[str]) -> DataFrame:
    """(keys, name, bias, value, note) of the named votes. What no vote reads is pruned."""
    state = I.last_readings(df, keys)
    if "supertrend" in parts:
        state = state.join(last_rows(I.supertrend(df, keys=keys), ["direction"], keys).drop("n").hint("merge"), keys, "left")
    return state.select(*keys, F.inline(F.array(*[VOTES[p]() for p in parts])))


def vote(df: DataFrame, part: str, keys: list[str] = KEYS) -> DataFrame:
    return _voted(df, [part], keys)


def all_signals(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The seven votes of every series."""
    return _voted(df, list(VOTES), keys)


def _category(kind: int) -> Column:
    out = F
    for name, *kinds in V.INDICATORS:
        out = out.when(F.col("name") == name, kinds[kind])
    return out.otherwise("Trend" if kind == 0 else "trend")


def signal_panel(signals: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, family, bias, conviction): the sign of a family's votes, and the share of its non-neutral votes with it."""
    sums = signals.withColumn("family", _category(0)).groupBy(*keys, "family").agg(
        F.signum(F.sum("bias")).cast("int").alias("bias"), F.count_if(F.col("bias") > 0).alias("up"), F.count_if(F.col("bias") < 0).alias("down")
    )
    share = F.when(F.col("bias") == 0, 0.0).otherwise(F.when(F.col("bias") > 0, F.col("up")).otherwise(F.col("down")) / (F.col("up") + F.col("down")))
    return sums.select(*keys, "family", "bias", share.alias("conviction"))


def regime(df: DataFrame, n: int = 20, keys: list[str] = KEYS) -> DataFrame:
    """(keys, level_mean, regime) by the mean of the last n closes."""
    recent = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))).filter(F.col("__n") <= n)
    mean = recent.groupBy(*keys).agg(F.avg("close").alias("level_mean"))
    return mean.withColumn("regime", F.when(F.col("level_mean") > 0, "Backwardation").otherwise("Contango"))


def strategy_mode(regime_col: Column, level: Column) -> Column:
    return F.when((level == "Butterfly") | (regime_col == "Contango"), "Mean reversion").otherwise("Breakout")


def regime_weights(spark) -> DataFrame:
    rows = [(r, name, cat, ws[cat]) for r, ws in V.WEIGHTS.items() for name, _, cat in V.INDICATORS]
    return spark.createDataFrame(rows, "regime string, name string, category string, weight double")


def contributions(signals: DataFrame, regimes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, regime, name, category, bias, weight, contribution); unknown names count as trend."""
    weights = regime_weights(signals.sparkSession).select("regime", "category", "weight").distinct()
    rows = signals.withColumn("category", _category(1)).join(regimes.select(*keys, "regime").hint("merge"), keys)
    rows = rows.join(F.broadcast(weights), ["regime", "category"])  # eight rows
    return rows.select(*keys, "regime", "name", "category", "bias", "weight", (F.col("weight") * F.col("bias")).alias("contribution"))


def reading(value: Column) -> Column:
    out = F
    for low, text in V.READINGS[:-1]:
        out = out.when(value >= low, text)
    return out.otherwise(V.READINGS[-1][1])


def composite_score(parts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, regime, score, reading): 100 * weighted votes / weights, to one decimal; the reading is that of the
    value before it is rounded (but for float noise)."""
    value = F.round(100 * F.sum("contribution") / I.nonzero(F.sum("weight")), 9)
    out = parts.groupBy(*keys, "regime").agg(F.coalesce(value, F.lit(0.0)).alias("v"))
    return out.select(*keys, "regime", (F.round("v", 1) + 0.0).alias("score"), reading(F.col("v")).alias("reading"))


def risk_metrics(df: DataFrame, period: int = 20, atr_period: int = 14, keys: list[str] = KEYS) -> DataFrame:
    """(keys, pctb, bandwidth, atr, atr_percentile) on the last date; nulls for short series."""
    wide = I.atr(I.bollinger_layers(df.select(*keys, "date", "close"), period, keys), atr_period, "atr", keys)
    last = last_rows(wide, ["pctb", "bandwidth", "atr"], keys)
    share = wide.select(*keys, F.col("atr").alias("a")).join(last.select(*keys, F.col("atr").alias("now")).hint("merge"), keys).filter("a is not null")
    pct = share.groupBy(*keys).agg((F.avg((F.col("a") <= F.col("now")).cast("double")) * 100).alias("atr_percentile"))
    enough = F.col("n") >= period
    return last.join(pct.hint("merge"), keys, "left").select(*keys, *[F.when(enough, F.col(c)).alias(c) for c in ("pctb", "bandwidth", "atr", "atr_percentile")])


def trade_levels(df: DataFrame, modes: DataFrame, period: int = 20, keys: list[str] = KEYS) -> DataFrame:
    """(keys, mode, side, entry, take_profit, stop_loss, risk_reward, note) on the last date. modes: keys, mode."""
    cols = ["close", "mid", "u2", "l2", "u3", "l3"]
    last = last_rows(I.bollinger_layers(df.select(*keys, "date", "close"), period, keys), cols, keys).join(modes.hint("merge"), keys)
    fade = F.col("mode") == "Mean reversion"
    up, down = F.col("close") >= F.col("u2"), F.col("close") <= F.col("l2")

    def plan(side, target, stop, note):
        known = side != "None"
        level = lambda c: (F.col(c) if known else F.lit(None)).cast("double")
        return F.struct(F.lit(side).alias("side"), level("close").alias("entry"), level(target).alias("take_profit"), level(stop).alias("stop_loss"), F.lit(note).alias("note"))

    chosen = (
        F.when(F.col("mid").isNull() | (F.col("n") < period), plan("None", "", "", NO_HISTORY))
        .when(fade & up, plan("Short", "mid", "u3", "fade upper band to mean"))
        .when(fade & down, plan("Long", "mid", "l3", "fade lower band to mean"))
        .when(fade, plan("None", "", "", "inside bands — no mean-reversion setup"))
        .when(up, plan("Long", "u3", "u2", "upside breakout, trail with ATR"))
        .when(down, plan("Short", "l3", "l2", "downside breakout, trail with ATR"))
        .otherwise(plan("None", "", "", "inside bands — no breakout"))
    )
    out = last.select(*keys, "mode", F.inline(F.array(chosen)))
    risk = I.nonzero(F.abs(F.col("entry") - F.col("stop_loss")))
    return out.withColumn("risk_reward", F.abs(F.col("take_profit") - F.col("entry")) / risk)
