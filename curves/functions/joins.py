"""Joins whose strategy follows a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast: some MB of a few numbers and names each.
MOST = 50_000


def fits(side: DataFrame, most: int = MOST) -> bool:
    """Whether side has at most `most` rows. It is read for that, so it should be a stored table, or a small aggregate."""
    return side.limit(most + 1).count() <= most


def sized(side: DataFrame, small: bool | None = None, most: int = MOST) -> DataFrame:
    """side, to be joined as a broadcast if it has at most `most` rows, and by sorting else. small: if that is known already."""
    return F.broadcast(side) if (fits(side, most) if small is None else small) else side.hint("merge")
