"""Revisit resolution against plain loops, canonical URLs and odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from curves.llm import revisits

SCHEMA = f"record_id bigint, kind string, url string, ts bigint, headers {revisits.HEADERS}, body string, slice int, prior string"


def row(i, kind, url, ts, body=None, **headers):
    return (i, kind, url, ts, [(k.replace("_", "-"), v) for k, v in headers.items()], body, 0, "")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://user:pw@WWW.Ex.org:443/a/b/?b=2&utm_source=x&a=1#top", "ex.org/a/b?a=1&b=2"), ("http://ex.org/", "ex.org"), ("http://ex.org?ref=x", "ex.org"),
        (None, ""), ("ex.org/%C3%A9?q=ä", "ex.org/%C3%A9?q=ä"), ("http://ex.org:8080/x", "ex.org:8080/x"),
    ],
)
def test_canonical_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(revisits.canonical_url(F.col("u")).alias("c")).first().c == want


def test_outcomes_and_headers(spark):
    rows = [
        row(1, "response", "http://a.b/x", 10, "old", ETag='"1"', Content_Length="3", Cache_Control="max-age=1"),
        row(2, "revisit", "https://www.a.b/x/", 20, ETag='W/"1"', Cache_Control="max-age=9", Content_Length="0", Set_Cookie="s"),
        row(3, "revisit", "http://a.b/x", 20, ETag='"2"'),
        row(4, "revisit", "http://a.b/x", 10, ETag='"1"'),
        row(5, "response", "http://a.b/x", 30, "new", Last_Modified="d"),
        row(6, "revisit", "http://a.b/x", 40, ETag='"1"'),
        row(7, "revisit", "http://a.b/x", 40, Last_Modified="d"),
        row(8, "revisit", "http://a.b/y", 40, ETag='"1"'),
    ]
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.outcome for i, r in got.items()} == {2: "resolved", 3: "mismatch", 4: "no_prior", 6: "unverified", 7: "resolved", 8: "no_prior"}
    assert got[2].body == "old" and got[7].body == "new" and got[3].body is None
    assert {h.name: h.value for h in got[2].headers} == {"ETag": 'W/"1"', "Content-Length": "3", "Cache-Control": "max-age=9"}


def test_latest_earlier_response(spark, monkeypatch):
    rng = random.Random(3)
    rows = [row(i, rng.choice(["response", "revisit"]), f"http://h.org/{rng.choice('aaab')}", rng.randrange(300), "b", ETag="1") for i in range(400)]
    want = {}
    for r in rows:
        if r[1] == "revisit":
            prior = [(o[3], o[0]) for o in rows if o[1] == "response" and o[2] == r[2] and o[3] < r[3]]
            want[r[0]] = max(prior)[1] if prior else None
    for slices in (1, 7, 512):
        monkeypatch.setattr(revisits, "SLICES", slices)
        got = revisits.prior_responses(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {r.record_id: r.prior for r in got} == want


def test_one_odd_time_does_not_gather_the_others_in_a_slice(spark):
    """Slices end at quantiles, so that a hot URL spreads though one capture has a ts of 0."""
    rows = [row(i, "response", "http://h.org/a", 1_700_000_000 + i, "b", ETag="1") for i in range(5000)] + [row(9999, "revisit", "http://h.org/a", 0, ETag="1")]
    pairs = revisits._thin(spark.createDataFrame(rows, SCHEMA)).select("ts")
    sizes = [r["count"] for r in pairs.withColumn("slice", revisits._slices(pairs)).groupBy("slice").count().collect()]
    assert max(sizes) < 100 and len(sizes) > 100


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [
        row(None, "response", "http://a.b/x", 10, "null id", ETag='"1"'), row(None, "revisit", "http://a.b/x", 20, ETag='"1"'),
        row(5, "response", "http://a.b/y", 10, "first", ETag='"1"'), row(5, "response", "http://a.b/y", 10, "second", ETag='"1"'), row(5, "response", "http://a.b/z", 10, "other", ETag='"1"'),
        row(6, "revisit", "http://a.b/y", 20, ETag='"1"'), row(6, "revisit", "http://a.b/z", 20, ETag='"1"'), row(6, "revisit", "http://a.b/y", 20, ETag='"1"'),
        row(7, "response", "http://a.b/w", 10, "x" * 1_000_000, ETag='"1"'), row(8, "response", "http://a.b/w", 10, "tie", ETag='"1"'), row(9, "revisit", "http://a.b/w", 11, ETag='"1"'),
    ]
    got = sorted((str(r.record_id), r.canonical_url, r.outcome, r.body) for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [
        ("6", "a.b/y", "resolved", "second"), ("6", "a.b/y", "resolved", "second"), ("6", "a.b/z", "resolved", "other"),
        ("9", "a.b/w", "resolved", "tie"), ("None", "a.b/x", "resolved", "null id"),
    ]
    pages = spark.createDataFrame([(None, "http://a.b/c", "html"), (1, "http://a.b/d", "x" * 1_000_000)], "page_id bigint, url string, html string")
    assert revisits.captures_of(pages).groupBy("kind").count().orderBy("kind").collect()[0][1] == 2
    assert revisits.resolve(revisits.captures_of(pages)).count() == 4


def test_odd_rows(spark):
    rows = [(1, "response", None, 5, None, None, 0, ""), (2, "revisit", None, 6, None, None, 0, ""), (3, "revisit", "http://a.b", None, None, None, 0, ""), (2, "revisit", None, 6, None, None, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.record_id, r.outcome) for r in revisits.resolve(df).collect())
    assert got == [(2, "unverified"), (2, "unverified"), (3, "no_prior")]
    assert revisits.resolve(df.limit(0)).count() == 0
