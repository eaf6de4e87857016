"""Fixed vocabulary: month codes, symbol patterns, the structure universe, weights and texts."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the market and of the analysis.
MONTHS = "FGHJKMNQUVXZ"
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
OUTRIGHT = rf"^CL([{MONTHS}])(\d{{1,2}})$"
CALENDAR = rf"^CL([{MONTHS}])(\d{{1,2}})-CL([{MONTHS}])(\d{{1,2}})$"
CRACK = rf"^CL:C1 ([A-Z]{{2}})-CL ([{MONTHS}])(\d{{1,2}})$"
BRENT = rf"^CL([{MONTHS}])(\d{{1,2}})-BZ([{MONTHS}])(\d{{1,2}})$"
TENORS = {"quarterly": 3, "semestral": 6, "yearly": 12}
FLY_MONTHS = ("M", "Z")
MAX_DTE, BUFFER = 330, 3
BUCKETS = (("All", 0, 100_000), ("12–10m", 305, 366), ("10–6m", 183, 305), ("6–1m", 30, 183), ("1–0m", 0, 30))
INDICATORS = (
    ("MA ribbon", "Trend", "trend"), ("ADX/DMI", "Trend", "trend"), ("Supertrend", "Trend", "trend"), ("MACD", "Momentum", "momentum"),
    ("RSI (adaptive)", "Momentum", "momentum"), ("Bollinger %B", "Volatility", "volatility"), ("Z-Score", "Statistical", "statistical"),
)
WEIGHTS = {
    "Contango": {"trend": 0.5, "momentum": 0.8, "volatility": 1.2, "statistical": 1.4},
    "Backwardation": {"trend": 1.3, "momentum": 1.2, "volatility": 0.8, "statistical": 0.6},
}
READINGS = (
    (60, "Strong bullish bias"), (20, "Moderate bullish bias"), (-20, "Neutral / no clear edge"), (-60, "Moderate bearish bias"), (None, "Strong bearish bias"),
)
PHASES = {
    "Quiet": "Early life, market asleep — little seasonal signal yet.",
    "Build-up": "The slope starts to build; positioning begins.",
    "Acceleration": "Window where the move has historically tended to extend.",
    "Late": "Mature phase — higher risk of exhaustion.",
    "Expiry-risk": "Convergence / roll / thin liquidity — beware artificial spikes.",
}
DRIVERS = (
    "Heating demand / year-end; liquidity concentrates in Dec.", "Winter demand tail; refinery run-cut planning begins.",
    "Refinery maintenance season — pressure on near contracts.", "Refinery maintenance continues; pre-driving-season build.",
    "Transition into driving season; gasoline demand firms.", "Driving season (gasoline demand) — tendency toward backwardation.",
    "Peak driving season; near-month strength.", "Driving season tail; hurricane-season supply risk.",
    "Shoulder season; autumn refinery maintenance.", "Shoulder season; inventory rebuild ahead of winter.",
    "Heating demand ramps; positioning into December.", "Heating demand / year-end; peak December liquidity.",
)


def _named(months: str) -> list[str]:
    return [MONTH_NAMES[MONTHS.index(m)] for m in months]


def _universe() -> list[tuple[str, str, str, list[tuple[str, int, float]]]]:
    """(key, label, level, legs as (month code, year offset, coefficient)). A leg that comes earlier in the year than
    the one before it lies in the next year."""

    def legs(months: str, coefs: tuple[float, ...]):
        year, out = 0, []
        for k, (m, c) in enumerate(zip(months, coefs, strict=True)):
            year += bool(k and MONTHS.index(m) < MONTHS.index(months[k - 1]))
            out.append((m, year, c))
        return out

    spread = lambda kind, level, months: (f"{kind}_{months}", "-".join(_named(months)), level, legs(months, (1.0, -1.0)))
    flies = []
    for months in ("HMU", "MUZ", "UZH", "ZHM"):
        a, b, c = _named(months)
        flies.append((f"f_{months}", f"({a}-{b})-({b}-{c})", "Butterfly", legs(months, (1.0, -2.0, 1.0))))
    return [
        *(spread("m", "Monthly", a + b) for a, b in pairwise(MONTHS)),
        *(spread("q", "Quarterly", m) for m in ("HM", "MU", "UZ", "ZH")),
        *(spread("s", "Semestral", m) for m in ("HU", "MZ", "UH", "ZM")),
        *flies,
    ]


STRUCTURES = _universe()


def structures(spark: SparkSession) -> DataFrame:
    """(structure, label, level, n_legs, span_months, near_month, near_offset): 23 rows."""
    rows = []
    for key, label, level, legs in STRUCTURES:
        at = [12 * year + MONTHS.index(m) for m, year, _ in legs]
        rows.append((key, label, level, len(legs), max(at) - min(at), MONTHS.index(legs[0][0]) + 1, legs[0][1]))
    return spark.createDataFrame(rows, "structure string, label string, level string, n_legs int, span_months int, near_month int, near_offset int")


def legs(spark: SparkSession) -> DataFrame:
    """(structure, leg_no, month_code, year_offset, coef): a row for each leg."""
    rows = [(key, k, m, year, c) for key, _, _, parts in STRUCTURES for k, (m, year, c) in enumerate(parts)]
    return spark.createDataFrame(rows, "structure string, leg_no int, month_code string, year_offset int, coef double")


def buckets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUCKETS), "bucket string, lo int, hi int")


def month_number(code: Column) -> Column:
    """1 to 12 of a month code, null for anything else."""
    at = F.instr(F.lit(MONTHS), code)
    return F.when(at > 0, at)


def month_code(number: Column) -> Column:
    return F.substring(F.lit(MONTHS), number, F.lit(1))


def shift_contract(month: Column, year: Column, gap: int) -> Column:
    """Label of the outright `gap` months after (month, year)."""
    at = year * 12 + month - 1 + F.lit(gap)
    whole = F.floor(at / 12).cast("int")
    return F.concat(F.lit("CL"), month_code((at % 12 + 1).cast("int")), whole.cast("string"))
