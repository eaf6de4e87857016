"""Rolling and smoothed indicators, for every series of a long frame at once.

Each function adds columns to a frame of (keys, date, close). Within a series dates are unique.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from curves.functions.places import numbered
from curves.functions.storage import stored

KEYS = ["structure", "vintage"]


def _series(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date")


def _last(keys: list[str], n: int) -> WindowSpec:
    return _series(keys).rowsBetween(1 - n, 0)


def nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def _full(f, col: Column, n: int, keys: list[str]) -> Column:
    """f over the last n values, null until there are n."""
    w = _last(keys, n)
    return F.when(F.count(col).over(w) == n, f(col).over(w))


def sma(df: DataFrame, n: int, col: str = "close", out: str | None = None, keys: list[str] = KEYS) -> DataFrame:
    return df.withColumn(out or f"sma{n}", _full(F.avg, F.col(col), n, keys))


#: Powers of e beyond which a double overflows, and by which a term has faded below double precision.
_OVERFLOW, _FADED = 690.0, 46.0


def smooths(df: DataFrame, specs: dict[str, tuple[str, float]], keys: list[str] = KEYS) -> DataFrame:
    """Exponential smoothing ``y = alpha * x + (1 - alpha) * y'``, seeded with the first non-null x; x may be null only
    before it. specs: (column, alpha) by the name of the result.

    In closed form y is a running sum of ``c_j * q ** -j``. Rows are taken in blocks short enough for q ** -j to
    stay finite; at a block's end older terms have faded below double precision, so a row needs its own block's
    running sum and the last value of the block before. Smoothings whose blocks can be of one size share the
    numbers of the rows, and are three windows together.
    """
    waiting = sorted(specs, key=lambda o: specs[o][1])
    while waiting:
        size = math.ceil(_FADED / -math.log(1 - specs[waiting[0]][1]))
        shared = [o for o in waiting if size * -math.log(1 - specs[o][1]) < _OVERFLOW]
        df = _in_blocks(df, {o: specs[o] for o in shared}, size, keys)
        waiting = [o for o in waiting if o not in shared]
    return df


def _in_blocks(df: DataFrame, specs: dict[str, tuple[str, float]], size: int, keys: list[str]) -> DataFrame:
    row, block, j = "__row", "__block", "__j"
    count, part, end = ({o: f"__{n}_{o}" for o in specs} for n in ("count", "part", "end"))
    w, power = _series(keys), lambda alpha, k: F.pow(F.lit(1 - alpha), k)
    df = df.withColumns({row: F.row_number().over(w) - 1, **{count[o]: F.count(c).over(w) for o, (c, _) in specs.items()}})
    df = df.withColumn(block, F.floor(F.col(row) / size)).withColumn(j, (F.col(row) - F.col(block) * size).cast("double"))
    inside = Window.partitionBy(*keys, block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block, "date").rowsBetween(Window.unboundedPreceding, -1)

    def running(name: str) -> Column:
        col, alpha = specs[name]
        term = F.when(F.col(count[name]) == 1, F.col(col)).otherwise(F.col(col) * alpha)
        return F.when(F.col(col).isNotNull(), F.sum(term * power(alpha, -F.col(j))).over(inside) * power(alpha, F.col(j)))

    df = df.withColumns({part[o]: running(o) for o in specs})
    df = df.withColumns({end[o]: F.last(F.when(F.col(j) == size - 1, F.col(part[o])), ignorenulls=True).over(before) for o in specs})
    carried = {o: F.coalesce(F.col(end[o]) * power(alpha, F.col(j) + 1), F.lit(0.0)) for o, (_, alpha) in specs.items()}
    return df.withColumns({o: F.col(part[o]) + carried[o] for o in specs}).drop(row, block, j, *count.values(), *part.values(), *end.values())


def smooth(df: DataFrame, col: str, alpha: float, out: str, keys: list[str] = KEYS) -> DataFrame:
    return smooths(df, {out: (col, alpha)}, keys)


def _span(span: int) -> float:
    return 2 / (span + 1)


def ema(df: DataFrame, span: int, col: str = "close", out: str | None = None, keys: list[str] = KEYS) -> DataFrame:
    return smooth(df, col, _span(span), out or f"ema{span}", keys)


def wilder(df: DataFrame, period: int, col: str, out: str, keys: list[str] = KEYS) -> DataFrame:
    return smooth(df, col, 1 / period, out, keys)


def ma_ribbon(df: DataFrame, fast: int = 20, mid: int = 50, slow: int = 200, keys: list[str] = KEYS) -> DataFrame:
    df = sma(df, slow, keys=keys)
    return smooths(df, {f"ema{n}": ("close", _span(n)) for n in (fast, mid)}, keys)


def true_range(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.withColumn("tr", F.abs(F.col("close") - F.lag("close").over(_series(keys))))


def atr(df: DataFrame, period: int = 14, out: str = "atr", keys: list[str] = KEYS) -> DataFrame:
    return wilder(true_range(df, keys), period, "tr", out, keys).drop("tr")


def bollinger(df: DataFrame, n: int = 20, mult: float = 2.0, keys: list[str] = KEYS) -> DataFrame:
    """mid, upper, lower, pctb, and bandwidth (upper - lower) / mid."""
    df = df.withColumn("mid", _full(F.avg, F.col("close"), n, keys)).withColumn("__s", _full(F.stddev_pop, F.col("close"), n, keys))
    df = df.withColumns({"upper": F.col("mid") + mult * F.col("__s"), "lower": F.col("mid") - mult * F.col("__s")})
    width = F.col("upper") - F.col("lower")
    return df.withColumns({"pctb": (F.col("close") - F.col("lower")) / nonzero(width), "bandwidth": width / nonzero(F.col("mid"))}).drop("__s")


def bollinger_layers(df: DataFrame, n: int = 20, keys: list[str] = KEYS) -> DataFrame:
    """mid, bands u1 .. u3 and l1 .. l3, pctb on two sigmas, and bandwidth 2 * sigma / mid."""
    df = df.withColumn("mid", _full(F.avg, F.col("close"), n, keys)).withColumn("__s", _full(F.stddev_pop, F.col("close"), n, keys))
    df = df.withColumns({f"{p}{k}": F.col("mid") + sign * k * F.col("__s") for k in (1, 2, 3) for p, sign in (("u", 1), ("l", -1))})
    pctb = (F.col("close") - F.col("l2")) / nonzero(F.col("u2") - F.col("l2"))
    return df.withColumns({"pctb": pctb, "bandwidth": nonzero(2 * F.col("__s")) / nonzero(F.col("mid"))}).drop("__s")


def zscore(df: DataFrame, n: int, out: str | None = None, keys: list[str] = KEYS) -> DataFrame:
    z = (F.col("close") - _full(F.avg, F.col("close"), n, keys)) / nonzero(_full(F.stddev_pop, F.col("close"), n, keys))
    return df.withColumn(out or f"z{n}", z)


def zscore_dual(df: DataFrame, short: int = 20, long: int = 60, keys: list[str] = KEYS) -> DataFrame:
    return zscore(zscore(df, short, keys=keys), long, keys=keys)


def _moves(df: DataFrame, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """Changes of the close as __d, __up and __dn; `more` columns are made in the same window."""
    move = F.col("close") - F.lag("close").over(_series(keys))
    known = lambda c: F.when(F.col("__d").isNotNull(), c)
    ups = {"__up": known(F.greatest("__d", F.lit(0.0))), "__dn": known(F.greatest(-F.col("__d"), F.lit(0.0)))}
    return df.withColumns({"__d": move, **(more or {})}).withColumns(ups)


def _wilder_moves(df: DataFrame, period: int, keys: list[str]) -> DataFrame:
    """Smoothed ups, downs and true ranges as __up_s, __dn_s and __tr_s."""
    df = _moves(df, keys).withColumn("__tr", F.abs("__d"))
    return smooths(df, {f"__{c}_s": (f"__{c}", 1 / period) for c in ("up", "dn", "tr")}, keys).drop("__d", "__up", "__dn", "__tr")


def _directions() -> dict[str, Column]:
    """plus_di and minus_di of smoothed moves."""
    return {f"{n}_di": 100 * F.col(f"__{c}_s") / nonzero(F.col("__tr_s")) for n, c in (("plus", "up"), ("minus", "dn"))}


def _dx() -> Column:
    return 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / nonzero(F.col("plus_di") + F.col("minus_di"))


def _rsi() -> Column:
    return F.when(F.col("__dn_s") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("__up_s") / nonzero(F.col("__dn_s"))))


_SMOOTHED = ("__up_s", "__dn_s", "__tr_s")


def dmi_adx(df: DataFrame, period: int = 14, keys: list[str] = KEYS) -> DataFrame:
    """plus_di, minus_di and adx, from close moves."""
    df = _wilder_moves(df, period, keys).withColumns(_directions()).withColumn("__dx", _dx())
    return wilder(df, period, "__dx", "adx", keys).drop("__dx", *_SMOOTHED)


def rsi(df: DataFrame, period: int = 14, keys: list[str] = KEYS) -> DataFrame:
    """Wilder's RSI; 100 while there was no loss."""
    return _wilder_moves(df, period, keys).withColumn("rsi", _rsi()).drop(*_SMOOTHED)


def _rsi_bands(n: int, mult: float, keys: list[str]) -> dict[str, Column]:
    mean, width = _full(F.avg, F.col("rsi"), n, keys), mult * _full(F.stddev_pop, F.col("rsi"), n, keys)
    return {"rsi_upper": mean + width, "rsi_lower": mean - width}


def adaptive_rsi(df: DataFrame, period: int = 14, n: int = 20, mult: float = 2.0, keys: list[str] = KEYS) -> DataFrame:
    """rsi with bands rsi_upper and rsi_lower around its mean."""
    return rsi(df, period, keys).withColumns(_rsi_bands(n, mult, keys))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: list[str] = KEYS) -> DataFrame:
    """macd, macd_signal and hist."""
    df = smooths(df, {"__f": ("close", _span(fast)), "__l": ("close", _span(slow))}, keys).withColumn("macd", F.col("__f") - F.col("__l"))
    df = ema(df, signal, "macd", "macd_signal", keys)
    return df.withColumn("hist", F.col("macd") - F.col("macd_signal")).drop("__f", "__l")


def _pivots(left: int, right: int, keys: list[str]) -> dict[str, Column]:
    w = _series(keys).rowsBetween(-left, right)
    full = (F.count("close").over(w) == left + right + 1) & F.col("close").isNotNull()
    return {"pivot_low": full & (F.col("close") == F.min("close").over(w)), "pivot_high": full & (F.col("close") == F.max("close").over(w))}


def pivots(df: DataFrame, left: int = 5, right: int = 5, keys: list[str] = KEYS) -> DataFrame:
    """pivot_low and pivot_high: the close is the extreme of `left` rows before and `right` after."""
    return df.withColumns(_pivots(left, right, keys))


def _pivots_before(keys: list[str]) -> dict[str, Column]:
    """(close, macd) of the pivot before, at each pivot: low_before and high_before."""
    w = _series(keys).rowsBetween(Window.unboundedPreceding, -1)
    return {f"{k}_before": F.last(F.when(F.col(f"pivot_{k}"), F.struct("close", "macd")), ignorenulls=True).over(w) for k in ("low", "high")}


def _divergence() -> Column:
    """Aggregate of a series: 1 bullish, -1 bearish, 0 none, from its last two pivots; bullish is tried first."""

    def at_last(kind: str, closes, macds) -> Column:
        pair = F.max_by(F.struct("close", "macd", f"{kind}_before"), F.when(F.col(f"pivot_{kind}"), F.col("date")))
        return closes(pair["close"], pair[f"{kind}_before"]["close"]) & macds(pair["macd"], pair[f"{kind}_before"]["macd"])

    below, above = (lambda a, b: a < b), (lambda a, b: a > b)
    return F.when(at_last("low", below, above), 1).when(at_last("high", above, below), -1).otherwise(0)


def macd_divergence(df: DataFrame, keys: list[str] = KEYS, **macd_options) -> DataFrame:
    """(keys, divergence): 1 bullish, -1 bearish, 0 none, from each series' last two pivots; bullish is tried first."""
    marked = pivots(macd(df.select(*keys, "date", "close"), keys=keys, **macd_options), keys=keys).withColumns(_pivots_before(keys))
    return marked.groupBy(*keys).agg(_divergence().alias("divergence"))


def last_readings(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row a series: n, its rows, and on its last date all that the votes read but Supertrend: the columns of ma_ribbon,
    dmi_adx, macd, adaptive_rsi and bollinger, z60, and divergence. Every level of smoothing is made once for all of them."""
    close = F.col("close")
    df = df.select(*keys, "date", "close")
    wide = _moves(df, keys, more={
        "sma200": _full(F.avg, close, 200, keys), "mid": _full(F.avg, close, 20, keys), "__sd": _full(F.stddev_pop, close, 20, keys),
        "__m60": _full(F.avg, close, 60, keys), "__s60": _full(F.stddev_pop, close, 60, keys), **_pivots(5, 5, keys),
    }).withColumn("__tr", F.abs("__d"))
    first = {f"ema{n}": ("close", _span(n)) for n in (12, 20, 26, 50)} | {f"__{c}_s": (f"__{c}", 1 / 14) for c in ("up", "dn", "tr")}
    wide = smooths(wide, first, keys).withColumns(_directions()).withColumns({"__dx": _dx(), "rsi": _rsi(), "macd": F.col("ema12") - F.col("ema26")})
    wide = smooths(wide, {"macd_signal": ("macd", _span(9)), "adx": ("__dx", 1 / 14)}, keys)
    wide = wide.withColumns(_rsi_bands(20, 2.0, keys) | _pivots_before(keys))
    low, high = F.col("mid") - 2 * F.col("__sd"), F.col("mid") + 2 * F.col("__sd")
    wide = wide.withColumns({"hist": F.col("macd") - F.col("macd_signal"), "pctb": (close - low) / nonzero(high - low), "z60": (close - F.col("__m60")) / nonzero(F.col("__s60"))})
    cols = ["close", "ema20", "ema50", "sma200", "plus_di", "minus_di", "adx", "macd", "hist", "rsi", "rsi_upper", "rsi_lower", "pctb", "z60"]
    last = wide.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.max_by(F.struct(*cols), "date").alias("l"), _divergence().alias("divergence"))
    return last.select(*keys, "n", "l.*", "divergence")


def trend_sign(df: DataFrame, lookback: int = 20, keys: list[str] = KEYS) -> DataFrame:
    """Sign of the change over `lookback` rows; 0 before there are so many."""
    move = F.col("close") - F.lag("close", lookback).over(_series(keys))
    return df.withColumn("trend_sign", F.coalesce(F.signum(move).cast("int"), F.lit(0)))


#: What a row of the Supertrend needs of the one before: both bands, the way, the close before and the ATR.
_STATE = "up double, low double, way int, before double, width double"
_START = (None, None, 1, None, None)


def _walk(closes: list[float], state: tuple, period: int, mult: float) -> tuple[list, list, tuple]:
    """Lines and ways of closes that follow a state, and the state that they leave."""
    up, low, way, before, width = state
    lines, ways = [], []
    for c in closes:
        line = None
        if before is not None and c == c:
            move = abs(c - before)
            width = move if width is None else width + (move - width) / period
            w = mult * width
            up = c + w if up is None or c + w < up or before > up else up
            low = c - w if low is None or c - w > low or before < low else low
            way = (-1 if c < low else 1) if way == 1 else (1 if c > up else -1)
            line = low if way == 1 else up
        if c == c:
            before = c
        lines.append(line)
        ways.append(way)
    return lines, ways, (up, low, way, before, width)


def _state(rows: pd.DataFrame) -> tuple:
    """The state of one row or none."""
    if not len(rows):
        return _START
    own = rows.iloc[0]
    return tuple(int(own[c]) if c == "way" else None if pd.isna(own[c]) else float(own[c]) for c in ("up", "low", "way", "before", "width"))


def _block_starts(rows: DataFrame, keys: list[str], types: str, period: int, mult: float) -> DataFrame:
    """(keys, block, state): the state before each block but the first of rows (keys, block, date, close).

    A block is walked from the state that the block before left, all blocks at once, and once more wherever that state has changed, until none does. A
    band is soon reset and the ATR forgets, so that the end of a long block rarely depends on its start; then the third walk changes nothing. In
    the worst case as many walks are needed as a series has blocks.
    """
    by = [*keys, "block"]
    schema = f"{types}, block long, {_STATE}, moved boolean"
    starts = stored(rows.select(*by).limit(0).withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _STATE.split(", ")}))

    def walk(names: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        own = _state(start)
        end = _walk(pdf.sort_values("date")["close"].tolist(), own, period, mult)[2]
        return pd.DataFrame([(*names[:-1], names[-1] + 1, *end, True)], columns=[c.split()[0] for c in schema.split(", ")])

    while True:
        ends = rows.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(walk, schema)
        last = rows.groupBy(*keys).agg(F.max("block").alias("most"))
        found = stored(ends.join(last.hint("merge"), keys).filter("block <= most").drop("most", "moved"))
        near = lambda c: F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1e-12 * F.greatest(F.abs(f"a.{c}"), F.lit(1.0)), F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull())
        same = reduce(lambda x, y: x & y, [near(c.split()[0]) for c in _STATE.split(", ")])
        both = found.alias("a").join(starts.alias("b").hint("merge"), by, "left")
        if not both.filter(~same).head(1):
            return found
        starts = found


def supertrend(df: DataFrame, period: int = 10, mult: float = 3.0, seed: str = "first_valid", keys: list[str] = KEYS, block: int | None = None) -> DataFrame:
    """(keys, date, close, supertrend, direction): ratcheting bands of `mult` ATR, which flip when the close crosses them.

    Each band depends on the one before, so a series is read in order by one task, the ATR with it; with block, series are cut
    into blocks of so many rows, each a task, whose start states are found first. seed="first_valid"
    starts the bands at the first row with an ATR; "row0" starts them at the first row, whose ATR is null, so that they
    stay null and the direction stays 1.
    """
    if seed not in ("first_valid", "row0"):
        raise ValueError("seed is first_valid or row0")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, "date").schema)
    rows = df.select(*keys, "date", "close")
    if seed == "row0":
        return rows.withColumns({"supertrend": F.lit(None).cast("double"), "direction": F.lit(1)})
    schema = f"{types}, close double, supertrend double, direction int"

    def lines(pdf: pd.DataFrame, start: tuple) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        found, ways, _ = _walk(pdf["close"].tolist(), start, period, mult)
        return pdf.assign(supertrend=found, direction=ways)[[*keys, "date", "close", "supertrend", "direction"]].astype({"supertrend": "float64"})

    if block is None:
        return rows.groupBy(*keys).applyInPandas(lambda pdf: lines(pdf, _START), schema)
    placed = numbered(stored(rows), [F.col("date").asc()], keys, "at", "rows")
    cut = stored(placed.select(*keys, F.floor(F.col("at") / block).cast("long").alias("block"), "date", "close"))
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    starts, by = _block_starts(cut, keys, own, period, mult), [*keys, "block"]
    return cut.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(lambda pdf, start: lines(pdf, _state(start)), schema)
