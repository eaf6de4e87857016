"""Mean-reversion diagnostics, one row a series."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curves.operators.indicators import nonzero

KEYS = ["structure", "vintage"]

# MacKinnon (1994), constant only, one variable.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
SMALL_P, LARGE_P = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def _lagged(df: DataFrame, keys: list[str]):
    rows = df.select(*keys, "date", "close").filter("close is not null")
    return rows, Window.partitionBy(*keys).orderBy("date")


def hurst(df: DataFrame, max_lag: int = 20, keys: list[str] = KEYS) -> DataFrame:
    """(keys, hurst): slope of the log of the lagged differences' deviation on the log of the lag."""
    rows, w = _lagged(df, keys)
    lags = range(2, max_lag + 1)
    rows = rows.withColumns({f"d{k}": F.col("close") - F.lag("close", k).over(w) for k in lags})
    tau = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.stddev_pop(f"d{k}").alias(f"t{k}") for k in lags])
    points = F.array(*[F.struct(F.log(F.lit(float(k))).alias("x"), F.log(F.when(F.col(f"t{k}") > 0, F.col(f"t{k}"))).alias("y")) for k in lags])
    long = tau.select(*keys, "n", F.inline(points))
    enough = (F.max("n") >= 2 * max_lag) & (F.count("y") >= 3)
    return long.groupBy(*keys).agg(F.when(enough, F.regr_slope("y", "x")).alias("hurst"))


def _regression(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, b, t): slope of the change on the level before, and its t statistic."""
    rows, w = _lagged(df, keys)
    rows = rows.withColumn("x", F.lag("close").over(w)).withColumn("y", F.col("close") - F.col("x"))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_count("y", "x").alias("m"),
    )
    error = (F.col("syy") - F.col("b") * F.col("sxy")) / F.nullif(F.col("m") - 2, F.lit(0)) / nonzero(F.col("sxx"))
    return sums.select(*keys, "n", "b", (F.col("b") / nonzero(F.sqrt(F.when(error > 0, error)))).alias("t"))


def half_life(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, half_life): -ln 2 / b of the change on the level before; null unless b < 0."""
    good = (F.col("n") >= 20) & (F.col("b") < 0)
    return _regression(df, keys).select(*keys, F.when(good, -math.log(2) / nonzero(F.col("b"))).alias("half_life"))


def df_tstat(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, df_tstat): the Dickey-Fuller statistic without lagged differences."""
    return _regression(df, keys).select(*keys, F.when(F.col("n") >= 20, F.col("t")).alias("df_tstat"))


def variance_ratio(df: DataFrame, lag: int = 5, keys: list[str] = KEYS) -> DataFrame:
    """(keys, variance_ratio): variance of `lag`-step changes over `lag` times that of single steps."""
    rows, w = _lagged(df, keys)
    rows = rows.withColumns({"d1": F.col("close") - F.lag("close").over(w), "dk": F.col("close") - F.lag("close", lag).over(w)})
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp("d1").alias("v1"), F.var_samp("dk").alias("vk"))
    return out.select(*keys, F.when(F.col("n") >= 3 * lag, F.col("vk") / nonzero(lag * F.col("v1"))).alias("variance_ratio"))


def mackinnon_p(stat: float) -> float:
    """Approximate p-value of a Dickey-Fuller statistic with a constant."""
    if stat > TAU_MAX or stat < TAU_MIN:
        return float(stat > TAU_MAX)
    z = sum(c * stat**i for i, c in enumerate(SMALL_P if stat <= TAU_STAR else LARGE_P))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def most_lags(n: int) -> int:
    """The longest lag that the test tries for n closes."""
    return min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))


class LagSums:
    """Cross products of a series x, its steps d[r] = x[r + 1] - x[r] and their lags, for any first row of the regression.

    steps[k] is the sum of d[r] * d[r - k] over all r, levels[k] that of x[r] * d[r - k]; a sum over rows from `skip` on is one of those without
    the terms at the ends, which the first and last values give.
    """

    def __init__(self, n: int, level: float, square: float, steps: np.ndarray, levels: np.ndarray, head: np.ndarray, tail: np.ndarray):
        self.n, self.level, self.square, self.steps, self.levels = n, level, square, steps, levels
        self.head, self.tail, self.d_head, self.d_tail = head, tail, np.diff(head), np.diff(tail)

    def lagged(self, j: int, k: int, skip: int) -> float:
        """Sum of d[r - j] * d[r - k] over rows from skip, j <= k."""
        gap, end = k - j, len(self.d_tail)
        first = self.d_head[gap : skip - j] @ self.d_head[: max(skip - k, 0)] if skip > k else 0.0
        last = self.d_tail[end - j :] @ self.d_tail[end - j - gap : end - gap] if j else 0.0
        return self.steps[gap] - first - last

    def gram(self, lags: int, skip: int) -> np.ndarray:
        """Cross products of (1, level, lags 1 .., step) over rows from skip."""
        rows, head = self.n - 1 - skip, self.head
        out = np.empty((lags + 3, lags + 3))
        order = [None, None, *range(1, lags + 1), 0]
        out[0, 0], out[0, 1], out[1, 1] = rows, self.level - head[:skip].sum(), self.square - head[:skip] @ head[:skip]
        for a, j in enumerate(order[2:], 2):
            out[0, a] = self.tail[len(self.tail) - 1 - j] - head[skip - j]
            out[1, a] = self.levels[j] - (head[j:skip] @ self.d_head[: skip - j] if skip > j else 0.0)
            for b in range(a, lags + 3):
                k = order[b]
                out[a, b] = self.lagged(min(j, k), max(j, k), skip)
        return np.triu(out) + np.triu(out, 1).T


def _eliminated(gram: np.ndarray) -> np.ndarray:
    """The lower factor of cross products; its last row holds what each column explains of the last one."""
    low = np.linalg.cholesky(gram)
    if (np.diag(low) ** 2 <= 1e-10 * np.diag(gram)).any():
        raise np.linalg.LinAlgError("columns depend on each other")
    return low


def adf_of(sums: LagSums) -> tuple[int, float] | None:
    """(lag, statistic) of the augmented Dickey-Fuller test with a constant; the lag has the least AIC on the rows that all
    lags have, and is fitted again on all of its own. None where a fit is degenerate."""
    most = most_lags(sums.n)
    try:
        low = _eliminated(sums.gram(most, most))
        rows, left = sums.n - 1 - most, np.cumsum(low[-1, ::-1] ** 2)[::-1]  # what is not explained before each column
        aic = [rows * (math.log(2 * math.pi) + math.log(left[lag + 2] / rows) + 1) + 2 * (lag + 2) for lag in range(most + 1)]
        lag = aic.index(min(aic))
        last = [0, *range(2, lag + 2), 1, lag + 2]  # the level after the lags
        low = _eliminated(sums.gram(lag, lag)[np.ix_(last, last)])
    except (np.linalg.LinAlgError, ValueError):
        return None
    rows = sums.n - 1 - lag
    return lag, float(low[-1, -2] / math.sqrt(low[-1, -1] ** 2 / (rows - lag - 2)))


def lag_sums(df: DataFrame, keys: list[str] = KEYS, most: int | None = None) -> DataFrame:
    """(keys, n, kinds, level, square, steps, levels, head, tail): what LagSums takes of every series, about its mean, and the number of
    distinct closes, 3 standing for more. One shuffle of the rows, and no task keeps a series beyond what a window does.
    most: the longest lag of any series; it is counted if it isn't given."""
    rows, w = _lagged(df, keys)
    if most is None:
        longest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
        most = max(most_lags(longest or 0), 0)
    every = Window.partitionBy(*keys)
    about = rows.withColumns({"__n": F.count("*").over(every), "__m": F.avg("close").over(every), "__lo": F.min("close").over(every), "__hi": F.max("close").over(every)})
    about = about.withColumn("__x", F.col("close") - F.col("__m"))
    x = ["__x", *[f"__x{k}" for k in range(1, most + 2)]]
    wide = about.withColumns({"__i": F.row_number().over(w), **{x[k]: F.lag("__x", k).over(w) for k in range(1, most + 2)}})
    step = [F.col(x[k]) - F.col(x[k + 1]) for k in range(most + 1)]
    inner = ~F.col("close").isin(F.col("__lo"), F.col("__hi"))
    kinds = F.when(F.max("__lo") == F.max("__hi"), 1).when(F.max(inner), 3).otherwise(2)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))  # noqa: E731  a short series has no such lag
    ends = lambda near: F.transform(F.sort_array(F.collect_list(F.when(near, F.struct("__i", "__x")))), lambda p: p["__x"])
    return wide.groupBy(*keys).agg(
        F.count("*").alias("n"), kinds.alias("kinds"), F.sum("__x1").alias("level"), F.sum(F.col("__x1") * F.col("__x1")).alias("square"),
        F.array(*[total(step[0] * s) for s in step]).alias("steps"), F.array(*[total(F.col("__x1") * s) for s in step]).alias("levels"),
        ends(F.col("__i") <= most + 2).alias("head"), ends(F.col("__i") > F.col("__n") - 2 * most - 3).alias("tail"),
    )


def adf(df: DataFrame, keys: list[str] = KEYS, most: int | None = None) -> DataFrame:
    """(keys, adf_lag, adf_stat, adf_pvalue) of every series; null below 20 closes or 3 distinct ones. Least squares from
    cross products: the rows are summed up once, and each lag's fit is a step of one elimination."""

    @F.pandas_udf("struct<lag:int,stat:double,p:double>")
    def test(n: pd.Series, level: pd.Series, square: pd.Series, steps: pd.Series, levels: pd.Series, head: pd.Series, tail: pd.Series) -> pd.DataFrame:
        found = [adf_of(LagSums(*row)) for row in zip(n, level, square, steps, levels, head, tail, strict=True)]
        out = [(None, None, None) if f is None else (*f, mackinnon_p(f[1])) for f in found]
        return pd.DataFrame(out, columns=["lag", "stat", "p"]).astype({"lag": "Int32", "stat": "float64", "p": "float64"})

    sums = lag_sums(df, keys, most)
    fit = sums.filter("n >= 20 and kinds = 3").select(*keys, test("n", "level", "square", "steps", "levels", "head", "tail").alias("t"))
    none = sums.filter("n < 20 or kinds < 3").select(*keys, F.lit(None).cast(fit.schema["t"].dataType).alias("t"))
    return fit.unionByName(none).select(*keys, F.col("t.lag").alias("adf_lag"), F.col("t.stat").alias("adf_stat"), F.col("t.p").alias("adf_pvalue"))


def adf_pvalue(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, adf_pvalue) of every series."""
    return adf(df, keys).select(*keys, "adf_pvalue")


def regime_diagnostics(df: DataFrame, keys: list[str] = KEYS, adf: bool = True) -> DataFrame:
    """(keys, hurst, half_life, variance_ratio, adf_pvalue, is_mean_reverting): the verdict is a strict majority of the
    tests that are available."""
    parts = [hurst(df, keys=keys), half_life(df, keys), variance_ratio(df, keys=keys), *([adf_pvalue(df, keys)] if adf else [])]
    out = reduce(lambda a, b: a.join(b.hint("merge"), keys), parts)
    votes = [F.col("hurst") < 0.5, F.col("variance_ratio") < 1.0, *([F.col("adf_pvalue") < 0.10] if adf else [])]
    yes = reduce(lambda a, b: a + b, [F.coalesce(v.cast("int"), F.lit(0)) for v in votes])
    known = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in votes])
    return out.withColumn("is_mean_reverting", yes * 2 > known)
