"""Structure series over all vintages, the seasonal stack, and catalog aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curves.functions import vocab as V

KEYS = ["structure", "vintage"]


def structure_legs(outrights: DataFrame) -> DataFrame:
    """Price and volume of each leg of each structure and vintage; mean over duplicates of a date and contract."""
    daily = outrights.groupBy("date", "contract", "month_code", "expiry_year").agg(F.avg("close").alias("close"), F.avg("volume").alias("volume"))
    legs = F.broadcast(V.legs(outrights.sparkSession))
    out = daily.join(legs, "month_code").withColumn("vintage", F.col("expiry_year") - F.col("year_offset"))
    return out.select("structure", "vintage", "leg_no", "contract", "date", "coef", "close", "volume")


def _n_legs(df: DataFrame) -> DataFrame:
    return F.broadcast(V.structures(df.sparkSession).select("structure", "n_legs"))


def available_years(outrights: DataFrame) -> DataFrame:
    """(structure, vintage) for which every leg is listed."""
    listed = structure_legs(outrights).groupBy(*KEYS).agg(F.countDistinct("leg_no").alias("n"))
    return listed.join(_n_legs(listed), "structure").filter("n = n_legs").select(*KEYS)


def structure_series(outrights: DataFrame) -> DataFrame:
    """(structure, vintage, date, close, volume) on dates when every leg traded. volume is the least leg volume, or
    null for a whole vintage if one of its leg days has none."""
    daily = structure_legs(outrights).groupBy(*KEYS, "date").agg(
        F.sum(F.col("coef") * F.col("close")).alias("close"), F.count("close").alias("n"), F.count("volume").alias("v"), F.min("volume").alias("volume")
    )
    full = daily.join(_n_legs(daily), "structure").filter("n = n_legs")
    known = F.min((F.col("v") == F.col("n_legs")).cast("int")).over(Window.partitionBy(*KEYS)) == 1
    return full.withColumn("volume", F.when(known, F.col("volume"))).select(*KEYS, "date", "close", "volume")


def near_leg_expiry(month: Column, year: Column) -> Column:
    """The 20th of the month before delivery."""
    at = year * 12 + month - 2
    return F.make_date(F.floor(at / 12).cast("int"), (at % 12 + 1).cast("int"), F.lit(20))


def expiries(series: DataFrame) -> DataFrame:
    """series with the near leg's expiry."""
    near = F.broadcast(V.structures(series.sparkSession).select("structure", "near_month", "near_offset"))
    out = series.join(near, "structure")
    return out.withColumn("expiry", near_leg_expiry(F.col("near_month"), F.col("vintage") + F.col("near_offset"))).drop("near_month", "near_offset")


def seasonal_stack(series: DataFrame) -> DataFrame:
    """(structure, vintage, date, day_of_year, days_to_expiry, close)."""
    out = expiries(series).withColumns({"day_of_year": F.dayofyear("date"), "days_to_expiry": F.datediff("expiry", "date")})
    return out.select(*KEYS, "date", "day_of_year", "days_to_expiry", "close")


def current_vintage(stack: DataFrame) -> DataFrame:
    """(structure, vintage): of the vintages with the latest last date, the one nearest to expiry, the smallest on a tie."""
    last = stack.groupBy(*KEYS).agg(F.max("date").alias("last"), F.max_by("days_to_expiry", "date").alias("dte"))
    best = last.groupBy("structure").agg(
        F.min_by("vintage", F.struct(F.datediff(F.lit("2200-01-01"), "last").alias("age"), "dte", "vintage")).alias("vintage")
    )
    return best.select(*KEYS)


def price_matrix(outrights: DataFrame, contracts: list[str] | None = None, value: str = "close") -> DataFrame:
    """Wide matrix, date by contract, of the mean price (or volume). Contracts can be given to save a pass."""
    wide = outrights.groupBy("date").pivot("contract", contracts) if contracts else outrights.groupBy("date").pivot("contract")
    return wide.agg(F.avg(value))


#: Contracts of a wide matrix. Spark pivots 10,000 values at most, and plans get slow well before.
MOST_CONTRACTS = 2000


def price_matrices(outrights: DataFrame, value: str = "close", most: int = MOST_CONTRACTS) -> list[DataFrame]:
    """The wide matrix in groups of up to `most` contracts, in their order, so that any number of contracts has its columns. Each
    has the dates of its own contracts. Only the names of the contracts come to the driver."""
    names = [r["contract"] for r in outrights.select("contract").distinct().orderBy("contract").collect()]
    groups = [names[i : i + most] for i in range(0, len(names), most)]
    if len(groups) < 2:
        return [price_matrix(outrights, names or None, value)]
    return [price_matrix(outrights.filter(F.col("contract").between(g[0], g[-1])), g, value) for g in groups]


def frame_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and contracts of each frame."""
    parts = [
        df.agg(F.count("*").alias("n_rows"), F.countDistinct("contract").alias("n_contracts")).select(F.lit(name).alias("frame"), "n_rows", "n_contracts")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def dataset_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """Families, the sum of their contracts, and the first and last date."""
    parts = [
        df.agg(F.countDistinct("contract").alias("n"), F.min("date").alias("a"), F.max("date").alias("b")).select("n", "a", "b") for df in frames.values()
    ]
    return reduce(DataFrame.unionByName, parts).agg(
        F.count("*").alias("families"), F.sum("n").alias("contracts"), F.min("a").alias("first_date"), F.max("b").alias("last_date")
    )


def contract_stats(frame: DataFrame) -> DataFrame:
    return frame.groupBy("contract").agg(
        F.max_by("close", "date").alias("last_close"), F.min("close").alias("min_close"), F.max("close").alias("max_close"),
        F.avg("close").alias("mean_close"), F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def contract_search(frame: DataFrame, text: str) -> DataFrame:
    """Contract labels that hold the text, in either case."""
    return frame.filter(F.contains(F.upper("contract"), F.lit(text.upper()))).select("contract").distinct()


def structure_dim(df: DataFrame) -> DataFrame:
    """The universe, with each structure's legs as text."""
    spark = df.sparkSession
    sign = F.when(F.col("coef") < 0, "-").otherwise("+")
    size = F.when(F.abs("coef") != 1, F.abs("coef").cast("int").cast("string")).otherwise("")
    year = F.when(F.col("year_offset") > 0, F.concat(F.lit("+"), F.col("year_offset").cast("string"), F.lit("y"))).otherwise("")
    legs = V.legs(spark).groupBy("structure").agg(F.sort_array(F.collect_list(F.struct("leg_no", F.concat(sign, size, "month_code", year).alias("t")))).alias("l"))
    text = legs.select("structure", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("legs"))
    return V.structures(spark).join(F.broadcast(text), "structure").select("structure", "label", "level", "n_legs", "span_months", "legs")
