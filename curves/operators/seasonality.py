"""Seasonal context of each structure across its vintages, over the stack (structure, vintage, date, day_of_year,
days_to_expiry, close). `active` names each structure's active vintage: (structure, vintage). It is counted where it is joined,
and it, with what is as small, is broadcast if it has few rows; so it should be a written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curves.functions import vocab as V
from curves.functions.joins import fits, sized
from curves.functions.storage import stored

KEYS = ["structure", "vintage"]


def cap_window(stack: DataFrame, most: int = V.MAX_DTE, least: int = 0) -> DataFrame:
    return stack.filter(F.col("days_to_expiry").between(least, most))


def maturity_slices(stack: DataFrame) -> DataFrame:
    """The stack once for each maturity bucket that a row falls in; bounds are inclusive, so edges fall in two."""
    b = F.broadcast(V.buckets(stack.sparkSession))
    return stack.join(b, F.col("days_to_expiry").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def _spread(rows: DataFrame, buffer: int) -> DataFrame:
    """Each row at every day d within the buffer of its days to expiry."""
    return rows.withColumn("d", F.explode(F.sequence(F.col("days_to_expiry") - buffer, F.col("days_to_expiry") + buffer)))


def _others(stack: DataFrame, active: DataFrame | None) -> DataFrame:
    return stack if active is None else stack.join(sized(active), KEYS, "left_anti")


def seasonal_cone(stack: DataFrame, active: DataFrame | None = None, buffer: int = V.BUFFER, most: int = V.MAX_DTE, least: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(structure, d, mean, std, lower, upper, median, n) over the days within the buffer of d, for each d between the
    first and the last day observed. `by`: more columns that keep cones apart."""
    hist = _others(cap_window(stack, most, least), active)
    keys = [*by, "structure"]
    day = Window.partitionBy(*keys, "d")
    # the median is picked by rank, so that no task holds the values of a day
    ranked = _spread(hist, buffer).withColumns({"k": F.row_number().over(day.orderBy("close")), "n": F.count("*").over(day)})
    middle = F.col("k").isin(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    near = ranked.groupBy(*keys, "d").agg(
        F.avg("close").alias("mean"), F.stddev_pop("close").alias("std"), F.avg(F.when(middle, F.col("close"))).alias("median"), F.max("n").alias("n"),
        F.min("days_to_expiry").alias("lo"), F.max("days_to_expiry").alias("hi"),
    )
    w = Window.partitionBy(*keys)
    inside = near.withColumns({"lo": F.min("lo").over(w), "hi": F.max("hi").over(w)}).filter("d between lo and hi")
    return inside.select(*keys, "d", "mean", "std", (F.col("mean") - F.col("std")).alias("lower"), (F.col("mean") + F.col("std")).alias("upper"), "median", "n")


def anchors(stack: DataFrame, active: DataFrame, small: bool | None = None) -> DataFrame:
    """(structure, vintage, anchor, current): the active vintage's last days to expiry and close. small: whether active is
    known to have few rows; the result has as many."""
    rows = stack.join(sized(active, small), KEYS, "left_semi")
    return rows.groupBy(*KEYS).agg(F.max_by("days_to_expiry", "date").alias("anchor"), F.max_by("close", "date").alias("current"))


def current_percentile(stack: DataFrame, active: DataFrame, buffer: int = V.BUFFER) -> DataFrame:
    """(structure, vintage, percentile): share of other vintages' closes near the same day that are at or below."""
    capped, small = cap_window(stack), fits(active)
    at = anchors(capped, active, small)
    other = capped.select("structure", F.col("vintage").alias("v"), "days_to_expiry", "close").join(sized(at, small), "structure")
    near = other.filter((F.col("v") != F.col("vintage")) & (F.abs(F.col("days_to_expiry") - F.col("anchor")) <= buffer))
    share = near.groupBy(*KEYS).agg((F.avg((F.col("close") <= F.col("current")).cast("double")) * 100).alias("percentile"))
    return at.select(*KEYS).join(sized(share, small), KEYS, "left")


def monthly_heatmap(stack: DataFrame) -> DataFrame:
    """(structure, month, vintage, move): last minus first close of each calendar month."""
    return cap_window(stack).groupBy("structure", F.month("date").alias("month"), "vintage").agg((F.max_by("close", "date") - F.min_by("close", "date")).alias("move"))


def _by_date() -> Window:
    return Window.partitionBy(*KEYS).orderBy("date")


def nearest_vintage_point(stack: DataFrame, buffer: int = V.BUFFER, horizons: tuple[int, ...] = (20,)) -> DataFrame:
    """(structure, vintage, d, dist, date, move_h ..): a vintage's row nearest to day d, the earlier on a tie, and its
    move over each horizon, which is taken before the choice."""
    capped = cap_window(stack)
    moves = {f"move_{h}": F.lead("close", h).over(_by_date()) - F.col("close") for h in horizons}
    rows = _spread(capped.withColumns(moves), buffer)
    cols = [F.abs(F.col("days_to_expiry") - F.col("d")).alias("dist"), "date", *moves]
    best = rows.groupBy(*KEYS, "d").agg(F.min(F.struct(*cols)).alias("best"))
    return best.select(*KEYS, "d", "best.*")


def seasonal_bias(stack: DataFrame, active: DataFrame, buffer: int = V.BUFFER, horizons: tuple[int, ...] = (20,)) -> DataFrame:
    """(structure, vintage, horizon, direction, up, down, total, hit_rate, count_label, consistency) of other vintages'
    moves from the active vintage's day."""
    small = fits(active)
    at = anchors(cap_window(stack), active, small)
    points = nearest_vintage_point(stack, buffer, horizons).withColumnsRenamed({"vintage": "v", "d": "anchor"})
    near = points.join(sized(at, small), ["structure", "anchor"]).filter("v <> vintage")
    moves = near.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"move_{h}").alias("move")) for h in horizons])))
    sums = moves.groupBy(*KEYS, "horizon").agg(F.count_if(F.col("move") > 0).alias("up"), F.count_if(F.col("move") < 0).alias("down"))
    every = at.select(*KEYS, F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")).join(sized(sums, small), [*KEYS, "horizon"], "left")
    return consistency(every.fillna(0, ["up", "down"]))


def consistency(counts: DataFrame) -> DataFrame:
    """counts (up, down) with the direction and how well the vintages agree."""
    up, down, total = F.col("up"), F.col("down"), F.col("total")
    most = F.greatest("up", "down")
    out = counts.withColumn("total", up + down).withColumns(
        {
            "direction": F.when(up > down, "Bullish").when(down > up, "Bearish").otherwise("Neutral"),
            "hit_rate": F.coalesce(most / F.nullif(total, F.lit(0)), F.lit(0.0)),
            "count_label": F.concat(most.cast("string"), F.lit("/"), total.cast("string")),
        }
    )
    rate = F.col("hit_rate")
    label = F.when((total < 5) | (F.col("direction") == "Neutral"), "Mixed").when(rate >= 0.75, "Strong").when(rate >= 0.60, "Medium").when(rate >= 0.55, "Weak")
    return out.withColumn("consistency", label.otherwise("Mixed"))


def alignment(seasonal: Column, trend: Column) -> Column:
    """Tailwind, Headwind or Mixed of two directions; Up, Down and Flat are read as Bullish, Bearish and Neutral."""
    norm = lambda c: F.when(c == "Up", "Bullish").when(c == "Down", "Bearish").when(c == "Flat", "Neutral").otherwise(c)
    s, t = norm(seasonal), norm(trend)
    return F.when((s == "Neutral") | (t == "Neutral"), "Mixed").when(s == t, "Tailwind").otherwise("Headwind")


def lifecycle(stack: DataFrame, active: DataFrame, expiry_days: int = 15) -> DataFrame:
    """(structure, vintage, phase, days_to_expiry, elapsed, note) of the active vintage; elapsed is over the days of
    all vintages. An active vintage without rows in the window is Quiet."""
    capped, small = cap_window(stack), fits(active)
    span = capped.groupBy("structure").agg(F.min("days_to_expiry").alias("lo"), F.max("days_to_expiry").alias("hi"))
    out = active.join(sized(span, small), "structure", "left").join(sized(anchors(capped, active, small), small), KEYS, "left")
    part = (F.col("hi") - F.col("anchor")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    out = out.withColumn("elapsed", F.coalesce(F.greatest(F.least(part, F.lit(1.0)), F.lit(0.0)), F.lit(0.0)))
    e, d = F.col("elapsed"), F.col("anchor")
    phase = (
        F.when(d.isNull(), "Quiet").when(d <= expiry_days, "Expiry-risk").when(e < 0.25, "Quiet").when(e < 0.50, "Build-up").when(e < 0.78, "Acceleration")
    )
    notes = stack.sparkSession.createDataFrame(list(V.PHASES.items()), "phase string, note string")
    return out.withColumn("phase", phase.otherwise("Late")).join(F.broadcast(notes), "phase").select(*KEYS, "phase", F.col("anchor").alias("days_to_expiry"), "elapsed", "note")


def backtest_rows(stack: DataFrame, horizon: int = 20, buffer: int = V.BUFFER, lookback: int = 20) -> DataFrame:
    """(structure, vintage, date, alignment, continuation) for every day with a trend and a later close, of the structures
    that have more than one vintage in the window.

    Each vintage's nearest point to day d is found once, and a structure's ups and downs at d are summed over all its
    vintages, so the work is linear in the rows. A row is its own vintage's nearest point to its day, and takes its own move away again.
    """
    capped = cap_window(stack)
    points = nearest_vintage_point(stack, buffer, (horizon,)).select(*KEYS, "d", F.signum(f"move_{horizon}").cast("int").alias("s"))
    vintages = Window.partitionBy("structure")
    sums = points.groupBy("structure", "d").agg(
        F.count_if(F.col("s") > 0).alias("ups"), F.count_if(F.col("s") < 0).alias("downs"), F.min("vintage").alias("lo"), F.max("vintage").alias("hi")
    )
    several = sums.withColumn("several", F.min("lo").over(vintages) < F.max("hi").over(vintages)).filter("several")
    sums = stored(several.select("structure", "d", "ups", "downs"))
    w = _by_date()
    rows = capped.withColumns(
        {
            "trend": F.signum(F.col("close") - F.lag("close", lookback).over(w)).cast("int"),
            "move": F.lead("close", horizon).over(w) - F.col("close"),
            "d": F.col("days_to_expiry"),
        }
    ).filter("trend <> 0 and move is not null")
    both = rows.join(sized(sums), ["structure", "d"])
    net = F.col("ups") - F.col("downs") - F.signum("move").cast("int")
    seasonal = F.when(net > 0, "Bullish").when(net < 0, "Bearish").otherwise("Neutral")
    trend = F.when(F.col("trend") > 0, "Bullish").otherwise("Bearish")
    return both.select(*KEYS, "date", alignment(seasonal, trend).alias("alignment"), (F.col("move") * F.col("trend")).alias("continuation"))


def alignment_backtest(rows: DataFrame) -> DataFrame:
    """(structure, alignment, n, avg_continuation, hit_rate, median_return): three rows for each structure with any."""
    kinds = ("Tailwind", "Headwind", "Mixed")

    def of(kind: str) -> dict[str, Column]:
        own = F.when(F.col("alignment") == kind, F.col("continuation"))
        return {"n": F.count(own), "avg_continuation": F.avg(own), "hit_rate": F.avg((own > 0).cast("double")), "median_return": F.median(own)}

    wide = rows.groupBy("structure").agg(*[c.alias(f"{kind}_{name}") for kind in kinds for name, c in of(kind).items()])
    each = [F.struct(F.lit(kind).alias("alignment"), *[F.col(f"{kind}_{name}").alias(name) for name in of(kind)]) for kind in kinds]
    return wide.select("structure", F.inline(F.array(*each)))


def alignment_edge(backtest: DataFrame) -> DataFrame:
    """(structure, edge, verdict): how much further a trend runs with the season than against it."""
    at = lambda kind: F.max(F.when(F.col("alignment") == kind, F.col("avg_continuation")))
    out = backtest.groupBy("structure").agg((at("Tailwind") - at("Headwind")).alias("edge")).filter("edge is not null")
    return out.withColumn("verdict", F.when(F.col("edge") > 0, "adds information").otherwise("visual context only"))


def cone_by_bucket(stack: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """The cone of each maturity bucket, cut to the seasonal window."""
    slices = maturity_slices(cap_window(stack))
    return seasonal_cone(slices, active, by=("bucket",))


def seasonal_driver(stack: DataFrame) -> DataFrame:
    """(structure, near_month, driver): the dominant driver by the near leg's delivery month."""
    spark = stack.sparkSession
    drivers = spark.createDataFrame([(i + 1, t) for i, t in enumerate(V.DRIVERS)], "near_month int, driver string")
    return V.structures(spark).join(F.broadcast(drivers), "near_month").select("structure", "near_month", "driver")
