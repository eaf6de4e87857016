"""WARC: not-modified revisit resolution.

Captures are rows (record_id, kind, url, ts, headers, body): ``response`` rows are full responses, ``revisit`` rows
say that the server answered 304. A revisit is resolved by the latest full response of the same canonical URL with
an earlier ts (the greatest record id among several at that ts), if their validators agree: the entity tags by weak
comparison if both have one, else the last-modified dates if both have one. Only that response is tried.

outcome: resolved, mismatch (validators differ), unverified (no common validator), no_prior (no earlier response).
The merged headers of a resolved revisit are the response's, with those the 304 may update (PERMITTED) replaced.

The as-of join is a window over the distinct (URL, time) pairs, by URL and slice of time: in a slice the latest
response so far is a running maximum, and what a URL carries over from earlier slices is a running maximum over one
row for each slice. The slices end at quantiles of the pairs' times, so that a URL with a third of all captures
spreads over many of the SLICES tasks however its times are spread, and captures that repeat at one time are one row. Bodies
move once, in the join of revisits with their responses, of which Spark can split a hot one.

Canonical URLs: scheme and user info dropped; host in lower case without ``www.`` and default port; fragment
dropped; tracking parameters dropped and the rest sorted; trailing slashes dropped.

Cases: null urls are canonically "" and null bodies stay null; empty and very long bodies are carried as they are; a
null ts never precedes anything and has nothing before it; null header lists are empty; of header names that occur
twice the first counts as validator; a null record id is an id like any other, and less than all others; every revisit row gives
one row, so repeated rows and ids give repeated rows; of several responses with one id, URL and ts the one with the
greatest headers and body is used; an empty table gives an empty result; other input columns don't matter.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curves.llm.common import stored, table

SLICES = 128
# Header fields that a 304 response may update, and query parameters that don't select content.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING_RE = r"^(?:utm_[a-z]+|ref|gclid|fbclid|sessionid)(?:=|$)"
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING_RE)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def _tag(headers: Column) -> Column:
    return F.regexp_replace(header(headers, "etag"), r"^W/", "")


def merged(response: Column, revisit: Column) -> Column:
    news = F.filter(revisit, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(news, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(response, lambda h: ~F.array_contains(names, F.lower(h["name"]))), news)


def _slices(keys: DataFrame) -> Column:
    """Number of the slice of a ts: how many of the quantiles of all ts are at or below it."""
    cuts = keys.agg(F.percentile_approx("ts", [k / SLICES for k in range(1, SLICES)], F.lit(20_000))).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]).cast("array<long>")
    return F.size(F.filter(bounds, lambda b: b <= F.col("ts")))


def prior_times(thin: DataFrame) -> DataFrame:
    """(canonical_url, ts, prior): for each pair that has a revisit and an earlier response, (ts, has_id, record_id)
    of the latest such response. thin: record_id, kind, canonical_url, ts."""
    answer = F.struct("ts", F.col("record_id").isNotNull().alias("has_id"), "record_id")
    pairs = thin.filter("ts is not null").groupBy("canonical_url", "ts").agg(
        F.max(F.when(F.col("kind") == "response", answer)).alias("own"), F.max(F.col("kind") == "revisit").alias("asked")
    )
    pairs = stored(pairs)
    rows, by = pairs.withColumn("slice", _slices(pairs)), ["canonical_url", "slice"]
    earlier = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*by).agg(F.max("own").alias("m")).withColumn("carried", F.max("m").over(before)).drop("m")
    out = rows.withColumn("here", F.max("own").over(earlier)).filter("asked").join(carried.hint("merge"), by)
    return out.select("canonical_url", "ts", F.coalesce("here", "carried").alias("prior")).filter("prior is not null")


def _thin(captures: DataFrame) -> DataFrame:
    """Captures without bodies, with canonical URLs and, of revisits, headers."""
    url, ts = canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts")
    return stored(captures.select("record_id", "kind", url, ts, F.when(F.col("kind") == "revisit", _listed("headers")).alias("rh")))


def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(HEADERS))


def prior_responses(captures: DataFrame, thin: DataFrame | None = None) -> DataFrame:
    """The revisits of captures: record_id, canonical_url, their headers rh, and the id `prior` and time `at` of the latest
    earlier response, or nulls."""
    thin = _thin(captures) if thin is None else thin
    asked = thin.filter("kind = 'revisit'").join(stored(prior_times(thin)).hint("merge"), ["canonical_url", "ts"], "left")
    return asked.select("record_id", "canonical_url", "rh", F.col("prior.record_id").alias("prior"), F.col("prior.ts").alias("at"))


def resolve(captures: DataFrame) -> DataFrame:
    """(record_id, canonical_url, outcome, response_id, headers, body) of each revisit."""
    thin = _thin(captures)
    key = {"fid": F.col("record_id"), "furl": canonical_url(F.col("url")), "fts": F.col("ts").cast("long")}
    full = captures.filter("kind = 'response'").select(*[c.alias(n) for n, c in key.items()], _listed("headers").alias("fh"), "body")
    repeated = thin.filter("kind = 'response'").groupBy("record_id", "canonical_url", "ts").count().filter("count > 1")
    if repeated.head(1):  # else the join reads plain exchanges, and Spark can split a hot response
        full = stored(full.groupBy(*key).agg(F.max(F.struct("fh", "body")).alias("r")).select(*key, "r.*"))
    asked = prior_responses(captures, thin)
    same_row = F.col("prior").eqNullSafe(F.col("fid")) & (F.col("canonical_url") == F.col("furl")) & (F.col("at") == F.col("fts"))
    known = asked.join(full.hint("merge"), same_row, "left")
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    tags, dates = (_tag(F.col("rh")), _tag(F.col("fh"))), (header(F.col("rh"), "last-modified"), header(F.col("fh"), "last-modified"))
    same = F.when(both(*tags), tags[0] == tags[1]).when(both(*dates), dates[0] == dates[1])
    outcome = F.when(F.col("at").isNull(), "no_prior").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    judged = known.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return judged.select(
        "record_id", "canonical_url", "outcome", F.col("prior").alias("response_id"),
        F.when(good, merged(F.col("fh"), F.col("rh"))).alias("headers"), F.when(good, F.col("body")).alias("body"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures derived from pages: for each page a full response (but for every eleventh) and two later revisits,
    whose validators are the page's own but for every seventh."""
    n, tag = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    ts = 1_700_000_000 + n * 60
    head = lambda k, v: F.struct(F.lit(k).alias("name"), v.cast("string").alias("value"))
    listed = lambda *hs: F.filter(F.array(*hs), lambda h: h["value"].isNotNull())
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    own = F.when(n % 5 != 4, quoted(F.col("tag")))
    seen = F.when(n % 7 == 0, quoted(F.concat("tag", F.lit("x")))).when(n % 5 != 4, F.concat(F.lit("W/"), quoted(F.col("tag"))))
    dated = F.when(n % 5 > 1, n * 60)
    row = lambda i, kind, at, headers, body: F.struct(
        (n * 4 + i).alias("record_id"), F.lit(kind).alias("kind"), at.alias("ts"), headers.alias("headers"), body.cast("string").alias("body")
    )
    first = listed(head("Content-Type", F.lit("text/html")), head("ETag", own), head("Last-Modified", dated), head("Cache-Control", F.lit("max-age=60")), head("Content-Length", F.octet_length("html")))
    again = lambda at: listed(head("ETag", seen), head("Last-Modified", dated), head("Cache-Control", F.lit("max-age=600")), head("Date", at), head("Content-Length", F.lit("0")), head("Set-Cookie", F.lit("s=1")))
    t1, t2 = ts + 3600 * (1 + n % 7), ts + 86400 * (1 + n % 3)
    rows = F.array(row(0, "response", ts, first, F.col("html")), row(1, "revisit", t1, again(t1), F.lit(None)), row(2, "revisit", t2, again(t2), F.lit(None)))
    made = pages.withColumn("tag", tag).select("url", F.inline(rows))
    return made.filter((F.col("kind") != "response") | F.coalesce(F.col("record_id") % 44 != 0, F.lit(True)))


def op2_revisits(spark, sf_dir):
    """Every revisit derived from pages, resolved; headers as sorted lines, the body as its length and digest."""
    out = resolve(captures_of(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"]))), "\n")
    return out.select(
        "record_id", "canonical_url", "outcome", "response_id", lines.alias("headers"),
        F.length("body").cast("long").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"),
    )


ORACLE = rf"""
WITH p AS (SELECT page_id AS n, md5(html) AS tag, html, 1700000000 + page_id * 60 AS ts,
                  regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS u FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '')
                || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS head,
             list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
                                   lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING_RE}'))) AS params FROM p),
k AS (SELECT *, head || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url,
             CASE WHEN n % 5 > 1 THEN n * 60 END AS dated FROM q),
f AS (SELECT n * 4 AS prior, canonical_url, ts, CASE WHEN n % 5 <> 4 THEN '"' || tag || '"' END AS tag, dated, html FROM k WHERE n % 11 <> 0),
v AS (SELECT n, i, n * 4 + i AS record_id, canonical_url, dated, CASE WHEN i = 1 THEN ts + 3600 * (1 + n % 7) ELSE ts + 86400 * (1 + n % 3) END AS ts,
             CASE WHEN n % 7 = 0 THEN '"' || tag || 'x"' WHEN n % 5 <> 4 THEN '"' || tag || '"' END AS tag
      FROM k CROSS JOIN (VALUES (1), (2)) t(i)),
j AS (SELECT v.*, f.prior, f.tag AS ftag, f.dated AS fdated, f.html FROM v ASOF LEFT JOIN f ON v.canonical_url = f.canonical_url AND v.ts > f.ts),
o AS (SELECT *, CASE WHEN prior IS NULL THEN 'no_prior'
                     WHEN tag IS NOT NULL AND ftag IS NOT NULL THEN CASE WHEN tag = ftag THEN 'resolved' ELSE 'mismatch' END
                     WHEN dated IS NOT NULL AND fdated IS NOT NULL THEN CASE WHEN dated = fdated THEN 'resolved' ELSE 'mismatch' END
                     ELSE 'unverified' END AS outcome FROM j)
SELECT record_id, canonical_url, outcome, prior AS response_id,
       CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort(list_filter([
           'cache-control: max-age=600', 'content-length: ' || strlen(html), 'content-type: text/html', 'date: ' || ts,
           'etag: ' || CASE WHEN n % 7 = 0 THEN tag ELSE coalesce('W/' || tag, ftag) END, 'last-modified: ' || coalesce(dated, fdated)], lambda x: x IS NOT NULL)), chr(10)) END AS headers,
       CASE WHEN outcome = 'resolved' THEN length(html) END AS n_chars,
       CASE WHEN outcome = 'resolved' THEN md5(html) END AS body_md5
FROM o
"""
