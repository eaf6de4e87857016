"""The corpus pipeline: documents to packed training sequences, in five stages.

Every stage works on all rows of the one before and returns its columns as they were, but for the text, and n_chars if
it is there, which is made to fit the text; the last returns bins. In all stages an empty table gives an empty result, other
columns may have any names, and a very long text is one row. Null, empty and blank texts fail the base limits of the first stage, so the
others only meet them when called by themselves; their docstrings say what happens then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curves.llm import line_dedup, mixing, near_copies, packing, quality_rules
from curves.llm.common import SPACES, free, stored, table


def _recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it is there, made to fit the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines go from the others' texts. Null, empty and blank texts are rejected; equal
    rows stay or go alike; ids, null or tied, don't matter."""
    return _recounted(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated line windows go, and documents that lose all their lines by it. Null, empty and blank
    texts stay as they are; null ids come first, and ties of ids are ordered by the text's hash; rows equal in id and text stay or go alike."""
    (removed,) = free(docs, "removed")
    done = line_dedup.dedup_lines(docs, passage_words=line_dedup.PASSAGE, removed_col=removed)
    blank = F.translate(F.coalesce("text", F.lit("")), SPACES, "") == ""
    return _recounted(done.filter(~((F.col(removed) > 0) & blank)).drop(removed))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; links are pairs with a Jaccard likeness of 0.8 or more over five-word
    shingles, found by SimHash's multi-index and, beyond its 2 bits, by inverted lists of bottom-k sketches. Texts without words are one
    component; null ids are kept only where a component has no other; of ties the least text hash stays, and rows equal in id and text stay together."""
    return near_copies.drop_near_copies(docs)


#: Share of the tokens that the mix takes. Leaves are read once at most, so that no document comes twice.
MIX_SHARE, MIX_EPOCHS = 0.8, 1


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of the tokens, by the target weights of domain, language and source. Texts without words have no
    tokens and go with the prefix that they fall in; null names count as ""; rows of equal or null ids are read alike."""
    (domain,) = free(docs, "domain")
    named = docs.withColumn(domain, mixing.domain(F.col("source")))
    return mixing.select(named, path=(domain, "lang", "source"), share=MIX_SHARE, epochs=MIX_EPOCHS).drop(domain)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row a bin, with the pieces of documents in it. Texts without words have no piece; a null
    id is a null in the bin; repeated rows are packed each."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]
#: Greedy packing and components can't be put in SQL; tests hold every stage's rows against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
