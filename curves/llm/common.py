"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from curves.functions.storage import stored

__all__ = ["SPACES", "SPACE_RE", "WORD_RE", "free", "held_out", "integer_ids", "let", "n_words", "order_id", "quoted", "stored", "table", "training_rows", "words"]

#: The six ASCII white space characters; a word is a run of anything else.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE)),
    )


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def order_id(col: Column) -> Column:
    """A long id with null as the smallest value, so that it can be a join key."""
    return F.coalesce(col.cast("long"), F.lit(-(2**63)))


def integer_ids(docs: DataFrame, id_col: str) -> None:
    """Raises TypeError unless the ids are integers."""
    kind = docs.select(quoted(id_col)).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")


def free(docs: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that docs doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for stem in stems:
        while f"__{stem}".lower() in taken:
            stem += "_"
        out.append(f"__{stem}")
    return out


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col(f"`{name}`")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder fold; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold).alias("held_out")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int) -> tuple[DataFrame, int]:
    """(text, label) of a sample of about max_rows labelled rows outside the held-out fold, and its expected size.

    The sample takes the rows whose hashed id falls in the lowest share of the hash range, so it is the same
    in every run. It has max_rows rows on average at most, which bounds the broadcast of its ids.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("label"))
        .dropna()
        .groupBy("__id")
        .agg(F.max("label").alias("label"))
        .filter(~held_out(F.col("__id"), folds, fold))
    )
    total = known.count()
    share = min(1.0, max_rows / total) if total else 1.0
    taken = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("__id"), text.alias("text"))
        .join(F.broadcast(taken), "__id")
        .withColumn("__h", F.xxhash64("text"))
        .dropDuplicates(["__h", "label"])
        .select("text", "label")
    )
    return rows, round(total * share)
