"""Line dedup: overlapping three-line windows.

A document is its sequence of lines with a word, each trimmed of ASCII white space. Every run of three such
lines is a window (a document with one or two has one window: all of them). Over all documents, the first
occurrence of a window, by (id, text hash, position), stays; every line that a later occurrence covers goes, so
overlapping windows merge. A removed line always has an equal line earlier in that order, so no line vanishes from
the corpus.

``passage_words`` (off by default) adds windows for passages of fewer lines than a window, which no run of three lines
can find if their neighbours differ: a single line of more than so many words, and two neighbouring lines of more than
so many words together. The query, its SQL and the pipeline set PASSAGE. A passage that starts or ends inside a
line is in no window but those of its whole lines.

Shuffles: windows as four longs and a position, counted with partial aggregation and joined by their two hashes; the
texts once, by id, to apply the removals. Both joins read plain exchanges of written tables, so that Spark can split
a window that a third of all documents share, and rows that repeat.

Cases: ids are integers, others are refused with a TypeError; null text has no lines and stays null; empty and blank texts stay as they are; null ids sort first; rows equal
in id and text count as one document and get one result, and equal windows within a text are ordered by position; a
very long text is one row, with about as many windows as lines; an empty table gives an empty result; other
columns are returned as they were, and a column named like the count is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curves.llm.common import SPACE_RE, SPACES, free, integer_ids, let, order_id, quoted, stored

LINES, PASSAGE = 3, 50


def _units(lines: Column) -> Column:
    """Lines with a word: (trimmed text, index among all lines)."""
    return F.filter(
        F.transform(lines, lambda x, i: F.struct(F.btrim(x, F.lit(SPACES)).alias("t"), i.alias("i"))),
        lambda u: u["t"] != "",
    )


def _windows(text: Column, size: int, passage_words: int | None) -> Column:
    """Array of (position, lines, two hashes) of the windows of a text."""

    def one(ts: Column, i: Column, k: Column) -> Column:
        return let(
            F.slice(ts, i, k),
            lambda s: F.struct((i - 1).alias("p"), k.alias("k"), F.xxhash64(s).alias("a"), F.xxhash64(F.lit("second"), s).alias("b")),
        )

    def passages(ts: Column, n: Column, counts: Column) -> list[Column]:
        """First lines, counted from 1, of the one-line and the two-line windows."""
        none = F.array().cast("array<int>")
        ones = F.when(n > 1, F.sequence(F.lit(1), n)).otherwise(none)
        twos = F.when(n > 2, F.sequence(F.lit(1), n - 1)).otherwise(none)
        return [
            F.transform(F.filter(ones, lambda i: F.get(counts, i - 1) > passage_words), lambda i: one(ts, i, F.lit(1))),
            F.transform(F.filter(twos, lambda i: F.get(counts, i - 1) + F.get(counts, i) > passage_words), lambda i: one(ts, i, F.lit(2))),
        ]

    def of(ts: Column) -> Column:
        n = F.size(ts)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: one(ts, i, F.least(n, F.lit(size))))
        none = F.array().cast("array<struct<p:int,k:int,a:bigint,b:bigint>>")
        if passage_words is None:
            return F.when(n > 0, runs).otherwise(none)
        counts = F.transform(ts, lambda t: F.size(F.split(t, SPACE_RE)))
        return F.when(n > 0, let(counts, lambda c: F.concat(runs, *passages(ts, n, c)))).otherwise(none)

    units = _units(F.split(F.coalesce(text, F.lit("")), "\n"))
    return let(F.transform(units, lambda u: u["t"]), of)


def later_windows(docs: DataFrame, id_col: str, text_col: str, size: int = LINES, passage_words: int | None = None) -> DataFrame:
    """(d, t, cover): for each document, (position, lines) of the windows that occur earlier in the corpus."""
    text = quoted(text_col)
    windows = stored(docs.select(order_id(quoted(id_col)).alias("d"), F.xxhash64(text).alias("t"), F.inline(_windows(text, size, passage_words))))
    here = F.struct("d", "t", "p")
    first = stored(windows.groupBy("a", "b").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = windows.join(first.hint("merge"), ["a", "b"]).filter(here > F.col("first"))
    return stored(later.groupBy("d", "t").agg(F.collect_set(F.struct("p", "k")).alias("cover")))


def _without(text: Column, cover: Column) -> Column:
    """(text without the covered lines, number removed)."""

    def cut(lines: Column, at: Column) -> Column:
        gone = F.flatten(
            F.transform(cover, lambda w: F.transform(F.sequence(w["p"], w["p"] + w["k"] - 1), lambda c: F.get(at, c)))
        )
        return let(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone),
            lambda kept: F.struct(
                F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
                (F.size(lines) - F.size(kept)).cast("long").alias("n"),
            ),
        )

    return let(F.split(text, "\n"), lambda lines: let(F.transform(_units(lines), lambda u: u["i"]), lambda at: cut(lines, at)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LINES, passage_words: int | None = None, removed_col: str = "__removed") -> DataFrame:
    """docs with later occurrences of repeated windows removed from the text, and the number of removed lines as
    ``removed_col``."""
    integer_ids(docs, id_col)
    docs = docs.drop(removed_col)
    names, text = docs.columns, quoted(text_col)
    d, t, cover, result = free(docs, "d", "t", "cover", "result")
    later = later_windows(docs, id_col, text_col, size, passage_words).toDF(d, t, cover)
    joined = docs.withColumns({d: order_id(quoted(id_col)), t: F.xxhash64(text)}).join(later.hint("merge"), [d, t], "left")
    unchanged = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    done = F.when(F.col(cover).isNotNull(), _without(text, F.col(cover))).otherwise(unchanged)
    out = joined.select(*map(quoted, names), F.inline(F.array(F.struct(done.alias(result)))))
    return out.select(*[F.col(f"{result}.text").alias(c) if c == text_col else quoted(c) for c in names], F.col(f"{result}.n").alias(removed_col))


def op10_line_dedup(spark, sf_dir):
    """Lines removed from every document, and a digest of what is left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage_words=PASSAGE)
    return out.select(
        "doc_id",
        F.col("__removed").alias("n_removed_lines"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


ORACLE = rf"""
WITH line AS (SELECT doc_id, i, s, trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
              FROM (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i
                    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
unit AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, count(*) OVER (PARTITION BY doc_id) AS n,
                len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words
         FROM line WHERE t <> ''),
win AS (SELECT doc_id, p, n, words, list(t) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {LINES - 1} FOLLOWING) AS g,
               t, lead(t) OVER (PARTITION BY doc_id ORDER BY p) AS t2, lead(words) OVER (PARTITION BY doc_id ORDER BY p) AS words2 FROM unit),
full_win AS (SELECT doc_id, p, g FROM win WHERE p <= greatest(n - {LINES - 1}, 1)
             UNION ALL SELECT doc_id, p, [t] FROM win WHERE n > 1 AND words > {PASSAGE}
             UNION ALL SELECT doc_id, p, [t, t2] FROM win WHERE n > 2 AND words + words2 > {PASSAGE}),
later AS (SELECT doc_id, p, len(g) AS h FROM (SELECT doc_id, p, g, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM full_win) WHERE k > 1),
gone AS (SELECT DISTINCT u.doc_id, u.i FROM later l JOIN unit u ON u.doc_id = l.doc_id AND u.p BETWEEN l.p AND l.p + l.h - 1),
left_over AS (SELECT l.doc_id, string_agg(s, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(g.i) AS n
              FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT doc_id, n::BIGINT AS n_removed_lines, length(coalesce(text, ''))::BIGINT AS n_chars_left, md5(coalesce(text, '')) AS text_md5
FROM left_over
"""
