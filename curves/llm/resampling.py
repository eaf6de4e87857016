"""Target-distribution importance resampling over hashed n-grams.

A text's bytes are mapped in one pass: A-Z to lower case, and every ASCII character but letters and digits to a space;
runs of spaces become one. An n-gram is then a span between two boundaries with n - 1 spaces inside, and
``finditer(overlapped=True)``, with the boundaries as lookarounds, gives the spans of all n-grams of a length, one
beginning at each word. The CRC-32 of a span's bytes, modulo BUCKETS, is its bucket.

The corpus and the target are counted by bucket. A bucket's gain is the log of its smoothed shares' ratio, in thousandths,
a document's weight the mean gain of its n-grams. With Gumbel noise of a hash of the id on top, the documents of the
highest scores are a draw without replacement in proportion to exp(weight / 1000).

The texts are scanned once, in batches; buckets are kept as two bytes an n-gram. Each task adds up its own counts, so that
at most BUCKETS rows a task are shuffled, and the driver gets BUCKETS numbers of either side. Ranks come from ranges of the
score, in one shuffle of ids and numbers; no task reads the whole order.

Cases: a null, empty or wordless text has no n-grams, weight 0, and isn't drawn; a null id counts as an empty text in its
noise, and comes first among ties; ties of score go by id, repeated rows are ranked each, one after another; a very long text is
one row, scanned in one piece; an empty corpus gives an empty result, and with an empty target the gains are of its
smoothed shares; other input columns don't matter, and `resample` returns them as they were.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curves.functions.places import numbered
from curves.llm.common import quoted, stored, table
from curves.llm.merkle import crc_sql

BUCKETS, SEED, SHARE_PERCENT, LEAST_WORDS, NGRAMS = 10_000, 2024, 10, 20, (1, 1)
_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_MAP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))


def cleaned(text: str | None) -> bytes:
    """The words of a text in lower case, a space between them."""
    return b" ".join((text or "").encode().translate(_MAP).split())


def spans(n: int) -> regex.Pattern:
    """The pattern of n words between boundaries."""
    return regex.compile(rb"(?<![^ ])[^ ]+" + rb"(?: [^ ]+){%d}" % (n - 1) + rb"(?![^ ])")


def buckets(clean: bytes, patterns: list[regex.Pattern], size: int = BUCKETS) -> np.ndarray:
    """The bucket of each n-gram of each pattern."""
    return np.fromiter((zlib.crc32(m[0]) % size for p in patterns for m in p.finditer(clean, overlapped=True)), np.uint16)


def scanned(text: Column, ngrams: tuple[int, int] = NGRAMS, size: int = BUCKETS) -> Column:
    """struct (n_words, n_features, buckets) of a text."""
    if not 0 < size <= 1 << 16:
        raise ValueError("there are at most 65536 buckets")
    patterns = [spans(n) for n in range(ngrams[0], ngrams[1] + 1)]

    @F.pandas_udf("struct<n_words:long,n_features:long,buckets:binary>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        clean = [cleaned(t) for t in texts]
        found = [buckets(c, patterns, size) for c in clean]
        words = [c.count(b" ") + 1 if c else 0 for c in clean]
        return pd.DataFrame({"n_words": words, "n_features": [len(f) for f in found], "buckets": [f.tobytes() for f in found]})

    return scan(text)


def counts(packed: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """How many n-grams fall in each bucket. packed: one column of buckets."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf.iloc[:, 0]), np.uint16), minlength=size)
        own = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": own, "n": total[own]})

    out = np.zeros(size, np.int64)
    for r in packed.mapInPandas(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of each bucket's smoothed share in the target over that in the corpus, rounded down."""
    size = len(corpus)
    up, down = (target + 1.0) * (float(corpus.sum()) + size), (corpus + 1.0) * (float(target.sum()) + size)
    return np.array([math.floor(1000 * math.log(x)) for x in up / down], np.int64)


def weight(packed: Column, gain: np.ndarray) -> Column:
    """The mean gain of a document's n-grams, rounded down; 0 without any."""

    @F.pandas_udf("long")
    def mean(found: pd.Series) -> pd.Series:
        at = [np.frombuffer(b, np.uint16) for b in found]
        return pd.Series([int(gain[a].sum()) // len(a) if len(a) else 0 for a in at], dtype="int64")

    return mean(packed)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    unit = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 32))
    return F.floor(F.lit(-1000) * F.log(-F.log(unit)))


def _placed(docs: DataFrame, target: DataFrame, kept: dict[str, str], id_col: str, text_col: str, ngrams: tuple[int, int], size: int, seed: int, percent: int, least_words: int) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document, and columns of docs under the names of kept."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = stored(docs.select(*[quoted(c).alias(k) for k, c in kept.items()], quoted(id_col).alias("id"), scanned(text, ngrams, size).alias("f")))
    aim = target.select(scanned(F.coalesce(quoted(text_col), F.lit("")), ngrams, size).alias("f"))
    gain = gains(counts(rows.select("f.buckets"), size), counts(aim.select("f.buckets"), size))
    scored = rows.select(*kept, "id", "f.n_words", "f.n_features", weight(F.col("f.buckets"), gain).alias("weight"))
    scored = stored(scored.withColumns({"score": F.col("weight") + noise(F.col("id"), seed), "short": F.col("n_words") < least_words}))
    drawn = scored.filter("not short").count() * percent // 100
    placed = numbered(scored, [F.col("short").asc(), F.col("score").desc(), F.col("id").asc_nulls_first()], None, "at", "all")
    rank = F.when(~F.col("short") & (F.col("at") < drawn), F.col("at") + 1)
    return placed.select(*kept, "id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def ranked(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngrams: tuple[int, int] = NGRAMS, size: int = BUCKETS, seed: int = SEED, percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; rank is null unless it is drawn: of those with
    least_words words, `percent` hundredths are. target: a table with the same text column."""
    return _placed(docs, target, {}, id_col, text_col, ngrams, size, seed, percent, least_words)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngrams: tuple[int, int] = NGRAMS, size: int = BUCKETS, seed: int = SEED, percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents drawn, as they were."""
    kept = {f"__k{i}": c for i, c in enumerate(docs.columns)}
    found = _placed(docs, target, kept, id_col, text_col, ngrams, size, seed, percent, least_words)
    return found.filter("rank is not null").select(*[F.col(k).alias(c) for k, c in kept.items()])


def op12_resampling(spark, sf_dir):
    """Weights, scores and ranks of all documents when a tenth is drawn to look like the benchmark's texts."""
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_UNIT = f"((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
names AS (SELECT w, {crc_sql("w")} % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT b, count(*) AS n FROM dw JOIN names USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN names USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (coalesce((SELECT sum(n) FROM s), 0)::DOUBLE + {BUCKETS})
        / ((coalesce(s.n, 0)::DOUBLE + 1) * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + {BUCKETS}))))::BIGINT AS gain
    FROM (SELECT DISTINCT b FROM names) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN names USING (w) JOIN g USING (b) GROUP BY r),
o AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln({_UNIT})))::BIGINT AS score
    FROM d LEFT JOIN m USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) AS place,
        count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () * {SHARE_PERCENT} // 100 AS drawn FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= drawn THEN place END::BIGINT AS rank FROM k
"""
