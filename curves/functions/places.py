"""Places of rows in an order, over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curves.functions.storage import stored


def numbered(rows: DataFrame, order: list[Column], by: list[str] | None = None, at: str = "at", n: str = "n") -> DataFrame:
    """rows, a stored table, with `at`, each one's place from 0 in the order, and `n`, their number, both among the rows
    of equal `by`.

    Rows are dealt by sampled ranges of (by, order, where they stand), so that a large group, and rows that are equal in all
    columns, spread over tasks; a row's place is its place in its range and what stands in the ranges before. No window reads
    rows: only the counts of ranges, a row for each range and group that meet, are summed up.
    """
    by = by or []
    tie, place, part, first, before, size = (f"__{c}_of_place" for c in ("tie", "place", "part", "first", "before", "size"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(k) for k in by], *order, F.col(tie)]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop(tie)
    dealt = stored(dealt.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)))
    runs = dealt.groupBy(*by, part).agg(F.min(place).alias(first), F.count("*").alias(size))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumns({before: F.coalesce(F.sum(size).over(earlier), F.lit(0)), n: F.sum(size).over(group)}).drop(size))
    # without groups there is a run for each range, else as many more as there are groups
    met = dealt.join(runs.hint("merge") if by else F.broadcast(runs), [*by, part])
    return met.withColumn(at, F.col(place) - F.col(first) + F.col(before)).select(*rows.columns, at, n)
