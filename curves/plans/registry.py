"""Queries by name, each over the tables of a folder. Values are rounded to 6 decimals, and never minus zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curves.functions import vocab as V
from curves.functions.storage import scratch, stored
from curves.operators import diagnostics as D
from curves.operators import families as P
from curves.operators import indicators as I
from curves.operators import seasonality as S
from curves.operators import series as E
from curves.operators import votes as G
from curves.plans.oracles import NUDGE, ORACLES
from curves.sources import bars

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals. Prices have few decimals, so means of them often end in a 5 just there; the nudge
    decides such ties, which float noise would else."""
    places = lambda c: 3 if c == "bandwidth" else 6  # noqa: E731  it divides by a mean near zero, which swells the noise
    return df.select(*[(F.round(F.col(c) + NUDGE, places(c)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def raw(spark: SparkSession, d: str) -> DataFrame:
    return bars.feed(spark, d)


def bars_of(make, spark: SparkSession, d: str, **options):
    """What make builds of the feed, some of which it can have made again."""
    return make(raw(spark, d), at=lambda numbers: bars.feed(spark, d, numbers), **options)


def legs(spark, d) -> DataFrame:
    return bars_of(P.outrights, spark, d, trim=False)


def trimmed(spark, d) -> DataFrame:
    return bars_of(P.outrights, spark, d)


def series(spark, d) -> DataFrame:
    return E.structure_series(trimmed(spark, d))


def stack(spark, d) -> DataFrame:
    """The seasonal stack, written: a query reads it for the active vintages and again for the others."""
    return stored(E.seasonal_stack(series(spark, d)))


def active(st: DataFrame) -> DataFrame:
    """The active vintages, written, as they are counted and joined."""
    return stored(E.current_vintage(st))


def panel(spark, d) -> DataFrame:
    """Every structure series and every hourly event series, as (structure, vintage, date, close); written, as
    several votes read it."""
    own = series(spark, d).select("structure", "vintage", F.col("date").cast("timestamp_ntz").alias("date"), "close")
    return stored(own.unionByName(bars.hourly(spark, d)))


OHLC = ["instrument_id", "symbol", "date", "open", "high", "low", "close", "volume"]


# 2.1 and 2.2: sources, symbols


@query
def raw_daily_date(spark, d):
    """Bars of each naive UTC date, the date read back from an ISO-8601 event time."""
    stamped = raw(spark, d).withColumn("ts_event", F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000000000Z"))).drop("date")
    return bars.with_date(stamped).groupBy("date").agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"))


@query
def loaded_feed(spark, d):
    """The feed saved without its order and loaded again: first bars of a day by their place in the files."""
    rows = bars.in_order(raw(spark, d), "ingest_seq").withColumn("ts_event", F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000000000Z")))
    path = scratch(spark)
    rows.drop("date", "ingest_seq").write.parquet(path)
    return rounded(P.dedup_clean(bars.load_raw(spark, path)).select(*OHLC))


@query
def saved_frames(spark, d):
    """Rows and contracts of each frame and year, from frames built, saved in folders by year and loaded again."""
    frames = bars.load_or_build(spark, scratch(spark), lambda: bars_of(P.build_all, spark, d), bars.YEARS)
    parts = [
        df.groupBy(F.lit(name).alias("frame"), F.col(bars.YEARS[name]).cast("int").alias("year")).agg(F.count("*").alias("n_rows"), F.countDistinct("contract").alias("n_contracts"))
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _symbols(spark, d, pattern, names) -> DataFrame:
    return P.parsed(raw(spark, d).select("symbol").distinct(), pattern, names)


@query
def parse_outright(spark, d):
    return _symbols(spark, d, V.OUTRIGHT, ["month_code", "year_token"])


@query
def parse_calendar(spark, d):
    return _symbols(spark, d, V.CALENDAR, ["near_code", "near_token", "far_code", "far_token"])


@query
def parse_crack(spark, d):
    return _symbols(spark, d, V.CRACK, ["product", "month_code", "year_token"])


@query
def parse_brent_wti(spark, d):
    return _symbols(spark, d, V.BRENT, ["wti_code", "wti_token", "brent_code", "brent_token"])


@query
def month_code_map(spark, d):
    codes = _symbols(spark, d, V.OUTRIGHT, ["month_code", "t"]).select("month_code").distinct()
    return codes.withColumn("month", V.month_number(F.col("month_code"))).withColumn("code_again", V.month_code(F.col("month")))


@query
def contract_history(spark, d):
    """Newest-first bars of the heating-oil cracks of a product and contract month."""
    rows = bars_of(P.cracks, spark, d).filter("product = 'HO' and month_code = 'Z'")
    return rounded(rows.select("contract", "date", "open", "high", "low", "close", "volume").orderBy(F.desc("date"), "contract"))


@query
def contract_search(spark, d):
    return E.contract_search(bars_of(P.calendars, spark, d), "clz").orderBy("contract")


@query
def symbol_family_coverage(spark, d):
    return raw(spark, d).groupBy(P.symbol_family(F.col("symbol")).alias("family")).agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"))


# 2.3: cleaning, expiry, listed families


@query
def dedup_clean(spark, d):
    return rounded(bars_of(P.dedup_clean, spark, d).select(*OHLC))


@query
def last_12_months(spark, d):
    return rounded(P.last_12_months(bars_of(P.dedup_clean, spark, d)).select("instrument_id", "symbol", "date", "close"))


@query
def expiry_year(spark, d):
    return legs(spark, d).select("instrument_id", "symbol", "month", "year_digit", "expiry_year").distinct()


@query
def far_leg_year(spark, d):
    return bars_of(P.calendars, spark, d).select("instrument_id", "symbol", "near_year", "near_month", "far_year", "far_month").distinct()


OUTRIGHT_COLS = [*OHLC, "month_code", "month", "year_digit", "expiry_year", "contract"]


@query
def outrights(spark, d):
    return rounded(trimmed(spark, d).select(*OUTRIGHT_COLS))


@query
def outright_legs(spark, d):
    return rounded(legs(spark, d).select(*OUTRIGHT_COLS))


@query
def calendars(spark, d):
    return rounded(bars_of(P.calendars, spark, d).select(*OHLC, "near_month", "near_year", "far_month", "far_year", "contract"))


@query
def cracks(spark, d):
    return rounded(bars_of(P.cracks, spark, d).select(*OHLC, "product", "month", "expiry_year", "contract"))


@query
def brent_wti(spark, d):
    return rounded(bars_of(P.brent_wti, spark, d).select(*OHLC, "wti_month", "wti_year", "brent_month", "brent_year", "contract"))


# 2.4: synthetic spreads and legs


@query
def shift_contract(spark, d):
    rows = legs(spark, d).select("contract", "month", "expiry_year").distinct()
    return rows.select("contract", *[V.shift_contract(F.col("month"), F.col("expiry_year"), g).alias(f"plus_{g}") for g in (3, 6, 12, -1)])


def _spread(spark, d, name):
    out = P.calendar_spread(legs(spark, d), V.TENORS[name], name)
    return rounded(out.select("date", "near_contract", "near_close", "near_month", "near_year", "far_contract", "far_close", "close", "contract", "structure", "gap_months", "n_legs"))


@query
def quarterly(spark, d):
    return _spread(spark, d, "quarterly")


@query
def semestral(spark, d):
    return _spread(spark, d, "semestral")


@query
def yearly(spark, d):
    return _spread(spark, d, "yearly")


@query
def flies(spark, d):
    out = P.flies(legs(spark, d))
    return rounded(out.select("date", "front_contract", "front_close", "month", "front_year", "mid_contract", "mid_close", "back_contract", "back_close", "close", "contract", "structure", "n_legs"))


@query
def structure_legs(spark, d):
    return rounded(E.structure_legs(trimmed(spark, d)))


@query
def nearest_vintage_point(spark, d):
    return rounded(S.nearest_vintage_point(stack(spark, d)))


# 2.5: composition and catalog


@query
def price_matrix(spark, d):
    """Mean closes of each date and contract: the wide matrices over all contracts, turned back to rows."""
    rows = stored(trimmed(spark, d).select("date", "contract", "close"))
    parts = [w.unpivot("date", [c for c in w.columns if c != "date"], "contract", "close") for w in E.price_matrices(rows)]
    return rounded(reduce(DataFrame.unionByName, parts).filter("close is not null"))


@query
def available_years(spark, d):
    return E.available_years(trimmed(spark, d))


@query
def structure_series(spark, d):
    return rounded(series(spark, d))


@query
def near_leg_expiry(spark, d):
    return E.expiries(E.available_years(trimmed(spark, d))).select("structure", "vintage", "expiry")


@query
def seasonal_stack(spark, d):
    return rounded(stack(spark, d))


@query
def current_vintage(spark, d):
    return active(stack(spark, d))


@query
def frame_summary(spark, d):
    return E.frame_summary(bars_of(P.build_all, spark, d))


@query
def dataset_summary(spark, d):
    return E.dataset_summary(bars_of(P.build_all, spark, d))


@query
def contract_stats(spark, d):
    return rounded(E.contract_stats(trimmed(spark, d)))


@query
def structure_dim(spark, d):
    """The universe, with the bars of the tables that its legs have."""
    listed = E.structure_legs(trimmed(spark, d)).groupBy("structure").agg(F.count("*").alias("n_leg_days"))
    return E.structure_dim(listed).join(listed.hint("merge"), "structure", "left").fillna(0, ["n_leg_days"])


# 2.6: indicators


def _indicator(name, make, cols):
    def run(spark, d):
        return rounded(make(panel(spark, d)).select("structure", "vintage", "date", *cols))

    run.__name__, run.__doc__ = name, f"{name} of every series."
    return query(run)


_indicator("sma", lambda p: I.sma(I.sma(p, 20), 200), ["sma20", "sma200"])
_indicator("ema", lambda p: I.ema(I.ema(p, 20), 50), ["ema20", "ema50"])
_indicator("wilder", lambda p: I.wilder(p, 14, "close", "wilder"), ["wilder"])
_indicator("ma_ribbon", I.ma_ribbon, ["ema20", "ema50", "sma200"])
_indicator("true_range", I.true_range, ["tr"])
_indicator("atr", I.atr, ["atr"])
_indicator("bollinger", I.bollinger, ["mid", "upper", "lower", "pctb", "bandwidth"])
_indicator("bollinger_layers", I.bollinger_layers, ["mid", "u1", "u2", "u3", "l1", "l2", "l3", "pctb", "bandwidth"])
_indicator("zscore", lambda p: I.zscore(p, 60), ["z60"])
_indicator("zscore_dual", I.zscore_dual, ["z20", "z60"])
_indicator("dmi_adx", I.dmi_adx, ["plus_di", "minus_di", "adx"])
_indicator("supertrend", I.supertrend, ["supertrend", "direction"])
_indicator("rsi", I.rsi, ["rsi"])
_indicator("adaptive_rsi", I.adaptive_rsi, ["rsi", "rsi_upper", "rsi_lower"])
_indicator("macd", I.macd, ["macd", "macd_signal", "hist"])
_indicator("pivots", I.pivots, ["pivot_low", "pivot_high"])
_indicator("trend_sign", I.trend_sign, ["trend_sign"])


@query
def macd_divergence(spark, d):
    return I.macd_divergence(panel(spark, d))


# 2.7: votes and score


def _vote(part):
    def run(spark, d):
        return rounded(G.vote(panel(spark, d), part))

    run.__name__, run.__doc__ = f"vote_{part}", f"The {part} vote of every series."
    return query(run)


for _part in ("ma", "adx", "supertrend", "macd", "rsi", "bollinger", "zscore"):
    _vote(_part)


def _long_enough(spark, d, rows="technical"):
    return G.eligible(panel(spark, d), G.MIN_ROWS[rows])


@query
def all_signals(spark, d):
    return rounded(G.all_signals(_long_enough(spark, d)))


@query
def signal_panel(spark, d):
    return rounded(G.signal_panel(G.all_signals(_long_enough(spark, d))))


def _parts(spark, d):
    long = _long_enough(spark, d, "score")
    return G.contributions(G.all_signals(long), G.regime(long))


@query
def regime_weights(spark, d):
    """Weight of each indicator by regime, with the series that it was applied to and what it gave to their scores."""
    rows = _parts(spark, d).groupBy("regime", "name", "category", "weight")
    return rounded(rows.agg(F.count("*").alias("n_series"), F.sum("contribution").alias("contribution")))


@query
def composite_score(spark, d):
    return rounded(G.composite_score(_parts(spark, d)))


@query
def score_reading(spark, d):
    """Series, and least and greatest score, of each reading."""
    scores = G.composite_score(_parts(spark, d))
    return rounded(scores.groupBy("reading").agg(F.count("*").alias("n_series"), F.min("score").alias("least"), F.max("score").alias("greatest")))


@query
def vote_breakdown(spark, d):
    return rounded(_parts(spark, d)).orderBy("structure", "vintage", F.desc("contribution"), "name")


# 2.8: regime, risk, plan


@query
def regime(spark, d):
    return rounded(G.regime(panel(spark, d)))


@query
def maturity_slices(spark, d):
    return rounded(S.maturity_slices(stack(spark, d)).select("structure", "vintage", "bucket", "date", "days_to_expiry", "close"))


def _modes(spark, p: DataFrame) -> DataFrame:
    levels = V.structures(spark).select("structure", "level")
    out = G.regime(p).join(F.broadcast(levels), "structure", "left")
    return out.select("structure", "vintage", "regime", G.strategy_mode(F.col("regime"), F.coalesce("level", F.lit("Monthly"))).alias("mode"))


@query
def strategy_mode(spark, d):
    return _modes(spark, panel(spark, d))


@query
def risk_metrics(spark, d):
    return rounded(G.risk_metrics(panel(spark, d)))


@query
def trade_levels(spark, d):
    p = panel(spark, d)
    return rounded(G.trade_levels(p, _modes(spark, p).drop("regime")))


# 2.9: seasonality


@query
def cap_window(spark, d):
    return rounded(S.cap_window(stack(spark, d)))


@query
def seasonal_cone(spark, d):
    st = stack(spark, d)
    return rounded(S.seasonal_cone(st, active(st)))


@query
def current_percentile(spark, d):
    st = stack(spark, d)
    return rounded(S.current_percentile(st, active(st)))


@query
def monthly_heatmap(spark, d):
    return rounded(S.monthly_heatmap(stack(spark, d)))


@query
def seasonal_bias(spark, d):
    st = stack(spark, d)
    return rounded(S.seasonal_bias(st, active(st)))


@query
def forward_tendency(spark, d):
    st = stack(spark, d)
    return rounded(S.seasonal_bias(st, active(st), horizons=(10, 20, 30)))


@query
def alignment(spark, d):
    """Seasonal bias of each structure against the trend of its active vintage."""
    st = stack(spark, d)
    bias = S.seasonal_bias(st, active(st)).select("structure", "vintage", "direction")
    trend = G.last_rows(I.trend_sign(S.cap_window(st)), ["trend_sign"])
    named = F.when(F.col("trend_sign") > 0, "Up").when(F.col("trend_sign") < 0, "Down").otherwise("Flat")
    out = bias.join(trend.hint("merge"), ["structure", "vintage"]).withColumn("trend", named)
    return out.select("structure", "vintage", "direction", "trend", S.alignment(F.col("direction"), F.col("trend")).alias("alignment"))


@query
def lifecycle(spark, d):
    st = stack(spark, d)
    return rounded(S.lifecycle(st, active(st)))


def _backtest(spark, d):
    return S.alignment_backtest(S.backtest_rows(stack(spark, d)))


@query
def alignment_backtest(spark, d):
    return rounded(_backtest(spark, d))


@query
def alignment_edge(spark, d):
    return rounded(S.alignment_edge(_backtest(spark, d)))


@query
def cone_by_bucket(spark, d):
    st = stack(spark, d)
    return rounded(S.cone_by_bucket(st, active(st)))


@query
def seasonal_driver(spark, d):
    """The driver of each structure that the tables hold, with its vintages and days."""
    st = stack(spark, d)
    held = st.groupBy("structure").agg(F.countDistinct("vintage").alias("n_vintages"), F.count("*").alias("n_days"))
    return held.join(F.broadcast(S.seasonal_driver(st)), "structure")  # 23 rows


# 2.10: diagnostics


@query
def hurst(spark, d):
    return rounded(D.hurst(panel(spark, d)))


@query
def half_life(spark, d):
    return rounded(D.half_life(panel(spark, d)))


@query
def variance_ratio(spark, d):
    return rounded(D.variance_ratio(panel(spark, d)))


@query
def df_tstat(spark, d):
    return rounded(D.df_tstat(panel(spark, d)))


@query
def adf_pvalue(spark, d):
    """Lag, statistic and p-value of the augmented Dickey-Fuller test of every series."""
    return rounded(D.adf(panel(spark, d)))


@query
def regime_diagnostics(spark, d):
    return rounded(D.regime_diagnostics(panel(spark, d)))


@query
def mean_reversion_verdict(spark, d):
    """The verdict of the two tests without a regression."""
    return rounded(D.regime_diagnostics(panel(spark, d), adf=False))
