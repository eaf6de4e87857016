"""Line-first cleaning and line dedup against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from curves.llm import line_dedup, quality_rules
from tests.compare import assert_same
from tests.llm.data import ODD, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    ws = WORD.findall(text or "")
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def measures(spark, texts):
    return {r.doc_id: r for r in quality_rules.measure(documents(spark, list(enumerate(texts)))).collect()}


def test_base_measures(spark):
    texts = [None, "", "a b", prose(1, 30) + " " + prose(1, 30), "x " * 40, prose(2, 90, 4), "l\nl\n\nl m\n l", "a\x0bb\x0cc # * | <x>", prose(3, 12) * 2 + " z"]
    got = measures(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_lines_fail_by_rule_and_documents_by_loss(spark):
    good = prose(1, 40) + "."
    bad = {"punctuation": "THE!! CAT!! SAT!! ON!! A!! MAT!!", "navigation": "home | news | sport | about | help", "boilerplate": "All rights reserved."}
    texts = [good, *(f"{good}\n{b}" for b in bad.values()), good[:60] + "\n" + "\n".join([bad["navigation"]] * 9 + [prose(5, 15) + " |" * 9])]
    got = measures(spark, texts)
    assert [got[i].n_failed_lines for i in range(5)] == [0, 1, 1, 1, 10]
    assert [got[i].kept for i in range(5)] == [True, True, True, True, False]
    assert {got[i].clean_text for i in range(4)} == {good}


def test_clean_keeps_columns_and_odd_rows_have_results(spark):
    docs = documents(spark, [*ODD, prose(1, 40) + "\nAll rights reserved."])
    out = quality_rules.clean(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.collect()] == [prose(1, 40)]
    assert quality_rules.measure(docs).count() == docs.count()
    assert quality_rules.clean(docs.limit(0)).count() == 0


def dedup(texts, passage=None):
    """Plain version; texts in order of id. passage: words that make one or two lines a window of their own."""
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if WORD.search(x)]
        units = [lines[i].strip(" \t\n\x0b\x0c\r") for i in at]
        gone = set()
        runs = [(p, tuple(units[p : p + 3])) for p in range(max(len(units) - 2, min(len(units), 1)))]
        for k in (1, 2) if passage is not None else ():
            runs += [(p, tuple(units[p : p + k])) for p in range(len(units) - k + 1) if len(units) > k and len(" ".join(units[p : p + k]).split()) > passage]
        for p, w in sorted(runs, key=lambda r: r[0]):
            if w in seen:
                gone.update(at[p : p + len(w)])
            seen.add(w)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def _deduped(spark, texts, passage=None):
    out = line_dedup.dedup_lines(documents(spark, list(enumerate(texts))), passage_words=passage)
    return [r.text for r in out.orderBy("doc_id").collect()]


def test_later_windows_go(spark):
    texts = ["a\nb\nc\nd", "x\na\n\nb \nc\ny", "a\nb", "a\nb", "b", "a\na\na\na\na", "b\nc\nd\nz", ""]
    assert _deduped(spark, texts) == dedup(texts)
    assert _deduped(spark, texts)[1] == "x\n\ny" and _deduped(spark, texts)[3] == ""


def test_a_long_line_is_a_window_if_asked(spark):
    long, short = prose(1, 51), prose(2, 50)
    texts = [f"a\n{long}\nb\n{short}", f"c\n{long}\nd\n{short}", long, f"{long}\n{long}", long]
    assert _deduped(spark, texts, 50) == dedup(texts, 50)
    assert _deduped(spark, texts, 50)[1] == f"c\nd\n{short}" and _deduped(spark, texts, 50)[2:] == ["", "", ""]
    assert _deduped(spark, texts) == dedup(texts)
    assert _deduped(spark, texts)[1] == texts[1]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", " ", ""]), max_size=9).map("\n".join), min_size=1, max_size=12))
def test_any_lines(spark, texts):
    assert _deduped(spark, texts) == dedup(texts)
    assert _deduped(spark, texts, 1) == dedup(texts, 1)


def test_a_hot_window_and_hot_rows_can_be_split(spark):
    """With a third of all windows one window, both sides of its join are plain exchanges: Spark's plan says skew."""
    spread = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in spread}
    for k, v in spread.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('one\ntwo\nthree\n', id, '\n', id + 1, '\n', id + 2) AS text", "1 AS d", "2 AS cover", "'x' AS __d")
        windows = docs.select("doc_id", line_dedup._windows(docs["text"], 3, None).alias("w")).selectExpr("doc_id AS d", "inline(w)")
        windows = line_dedup.stored(windows)
        first = line_dedup.stored(windows.groupBy("a", "b").agg(F.min("d").alias("first"), F.count("*").alias("n")).filter("n > 1"))
        met = windows.join(first.hint("merge"), ["a", "b"])
        assert met.count() >= 20_000
        out = line_dedup.dedup_lines(docs)
        assert out.columns == [*docs.columns, "__removed"]
        assert out.agg(F.sum("__removed")).first()[0] >= 3 * 19_999
        met.write.format("noop").mode("overwrite").save()
        frame = met.select("d")
        frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_clashing_names_and_very_long_texts(spark):
    long = prose(1, 200_000, 50_000)
    docs = documents(spark, [f"{long}\nAll rights reserved.", f"{long[:1_000_000]}\na\nb"]).selectExpr("*", "'a' AS __text", "'b' AS `__text_`", "7 AS __d", "8 AS __removed", "9 AS `a.b`")
    out = quality_rules.clean(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == long and rows[0]["__text"] == "a" and rows[0]["a.b"] == 9 and len(rows) == 2
    again = line_dedup.dedup_lines(docs.unionByName(docs), passage_words=50)
    assert sorted(again.columns) == sorted(docs.columns) and {r["__removed"] for r in again.collect()} == {0}


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__removed"]
    assert out.count() == len(ODD)
    twins = [(r.text, r["__removed"]) for r in out.collect() if r.doc_id == 7]
    assert len(twins) == 2 and len(set(twins)) == 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_the_stage_takes_two_lines_as_a_window(spark):
    a, b, short = prose(1, 30), prose(2, 30), prose(3, 20)
    texts = [f"x\n{a}\n{b}\ny\n{short}\n{a}", f"p\n{a}\n\n{b}\nq\n{short}\n{a}\nr", f"{b}\n{a}", f"s\n{a}\n{b}", f"{a}\nt"]
    got = corpus_pipeline.lines(spark, documents(spark, list(enumerate(texts))), "").orderBy("doc_id").collect()
    assert [r.text for r in got] == [texts[0], f"p\n\nq\n{short}\n{a}\nr", f"{b}\n{a}", "s", f"{a}\nt"]


def test_the_query_and_its_sql_take_passages_of_one_and_two_lines(spark, tmp_path):
    a, b, long = prose(1, 30), prose(2, 30), prose(3, 51)
    texts = [f"x\n{a}\n{b}\ny", f"p\n{a}\n{b}\nq", f"r\n{long}\ns", f"t\n{long}\nu"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(line_dedup.op10_line_dedup(spark, str(tmp_path)), line_dedup.ORACLE, con)
    assert [r.n_removed_lines for r in line_dedup.op10_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [0, 2, 0, 1]


def test_the_stage_leaves_sentences_about_boilerplate_topics(spark):
    clean = ["The analog input and the catalog index differ.", "They design in the old style.", "Bake the cookie for ten minutes.", "Copyright is a right of authors in most countries of the world.", "His newsletter was read by many.", "The car was powered by steam and coal.", "Die Rechte der Autoren sind in diesem Land alle gut bekannt.", "El derecho de autor y la licencia son cosas distintas.", "The album was released under the label of her friend."]
    bad = ["Copyright 2020 Some Body", "© 2021 Some", "All rights reserved.", "Log in", "Sign in to your account to go on", "We use cookies for this site.", "Accept all cookies", "Subscribe to our newsletter", "Powered by Press", "Read our privacy policy", "Privacy Policy", "Click here to go on", "Alle Rechte vorbehalten.", "Impressum", "Tous droits réservés", "Conditions d'utilisation", "Todos los derechos reservados.", "Aceptar todas las cookies", "Released under the MIT License."]
    texts = ["\n".join(clean), "\n".join([prose(1, 300), *bad])]
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, documents(spark, texts), "").collect()}
    assert got == {0: texts[0], 1: prose(1, 300)}
