"""Cleaning, symbols and expiry years on rows made by hand."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from curves.functions import vocab as V
from curves.operators import families as P
from curves.operators import series as E
from curves.sources import bars

SCHEMA = "rtype int, publisher_id int, instrument_id bigint, open double, high double, low double, close double, volume bigint, symbol string, date date, ingest_seq bigint"


def raw(spark, rows):
    """rows: (instrument, symbol, date, close, low above high?, volume)."""
    made = [(35, 1, i, c, c, c + (1.0 if bad else 0.0), c, v, s, d, n) for n, (i, s, d, c, bad, v) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def test_first_bar_of_a_day_counts_even_if_malformed(spark):
    day = date(2020, 1, 2)
    rows = raw(spark, [(1, "CLH0", day, 1.0, True, 5), (1, "CLH0", day, 2.0, False, 5), (1, "CLJ0", day, 3.0, False, 5), (1, "CLJ0", day, 4.0, False, 5)])
    assert [(r.symbol, r.close) for r in P.dedup_clean(rows).collect()] == [("CLJ0", 3.0)]
    assert "rtype" not in P.dedup_clean(rows).columns


def test_trim_keeps_12_calendar_months_and_clamps_leap_days(spark):
    days = [date(2019, 2, 27), date(2019, 2, 28), date(2020, 2, 29)]
    rows = raw(spark, [(1, "CLZ0", d, 1.0, False, 1) for d in days])
    assert sorted(r.date for r in P.last_12_months(rows).collect()) == days[1:]


@pytest.mark.parametrize(
    ("symbol", "last", "year"),
    [("CLZ9", date(2019, 11, 20), 2019), ("CLZ9", date(2009, 11, 20), 2009), ("CLF0", date(2019, 12, 19), 2020), ("CLZ29", date(2020, 5, 1), 2029), ("CLZ05", date(2001, 5, 1), 2005), ("CLF0", date(2020, 1, 1), 2020), ("CLF0", date(2020, 1, 2), 2030)],
)
def test_expiry_years(spark, symbol, last, year):
    assert P.outrights(raw(spark, [(7, symbol, last, 1.0, False, 1)])).first().expiry_year == year


def test_symbol_of_two_decades_is_two_contracts(spark):
    rows = raw(spark, [(1, "CLZ9", date(2009, 11, 2), 1.0, False, 1), (2, "CLZ9", date(2019, 11, 1), 2.0, False, 1)])
    assert sorted(r.contract for r in P.outrights(rows).collect()) == ["CLZ2009", "CLZ2019"]


def test_far_leg_comes_after_the_near_leg(spark):
    rows = raw(spark, [(1, "CLZ9-CLH0", date(2019, 10, 1), 1.0, False, 1), (2, "CLF0-CLF21", date(2019, 10, 1), 1.0, False, 1)])
    assert sorted(r.contract for r in P.calendars(rows).collect()) == ["CLF2020-CLF2021", "CLZ2019-CLH2020"]


def test_brent_bars_are_flipped_with_high_and_low_swapped(spark):
    row = raw(spark, [(1, "CLZ2-BZF3", date(2012, 10, 1), -3.0, False, 1)]).withColumn("high", F.lit(-2.0)).withColumn("low", F.lit(-4.0))
    got = P.brent_wti(row).first()
    assert (got.close, got.high, got.low, got.contract) == (3.0, 4.0, 2.0, "CLZ2012-BZF2013")


def test_families_do_not_take_each_others_symbols(spark):
    symbols = ["CLM1", "CLM1-CLN1", "CL:C1 HO-CL Z7", "CLZ2-BZZ2", "MCLM1", "CL:BF X", "UD:1N"]
    rows = spark.createDataFrame([(s,) for s in symbols], "symbol string").select(P.symbol_family(F.col("symbol")).alias("f"))
    assert [r.f for r in rows.collect()] == ["outright", "calendar", "crack", "brent_wti", "micro", "butterfly", "user_defined"]


def test_universe_has_23_structures():
    by_level = [level for _, _, level, _ in V.STRUCTURES]
    assert {x: by_level.count(x) for x in set(by_level)} == {"Monthly": 11, "Quarterly": 4, "Semestral": 4, "Butterfly": 4}
    legs = {k: ls for k, _, _, ls in V.STRUCTURES}
    assert legs["q_ZH"] == [("Z", 0, 1.0), ("H", 1, -1.0)]
    assert legs["f_ZHM"] == [("Z", 0, 1.0), ("H", 1, -2.0), ("M", 1, 1.0)]
    assert legs["f_UZH"][2] == ("H", 1, 1.0)


def test_series_need_every_leg_and_volume_goes_for_the_whole_vintage(spark):
    days = [date(2020, 1, d) for d in (2, 3, 6)]
    rows = [(1, "CLH0", d, 10.0 + k, False, 5 + k) for k, d in enumerate(days)] + [(2, "CLM0", d, 8.0, False, 9) for d in days[:2]]
    legs = P.outrights(raw(spark, rows))
    got = {r.date: (r.close, r.volume) for r in E.structure_series(legs).filter("structure = 'q_HM'").collect()}
    assert got == {days[0]: (2.0, 5.0), days[1]: (3.0, 6.0)}
    holed = legs.withColumn("volume", F.when(F.col("date") != days[0], F.col("volume")))
    assert {r.volume for r in E.structure_series(holed).filter("structure = 'q_HM'").collect()} == {None}


def test_frames_come_back_as_they_were_saved(spark, tmp_path):
    frames = P.build_all(bars.feed(spark, "/root/testdata/sf0.001"))
    assert bars.load_frames(spark, str(tmp_path)) is None
    again = bars.load_or_build(spark, str(tmp_path), lambda: frames)
    assert bars.load_or_build(spark, str(tmp_path), dict).keys() == again.keys()
    assert {n: df.count() for n, df in again.items()} == {n: df.count() for n, df in frames.items()}
    bars.save_frames({"flies": frames["flies"]}, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv/flies"), header=True).columns == frames["flies"].columns


def test_raw_dates_from_nanosecond_stamps(spark, tmp_path):
    row = [("2020-03-01T23:59:59.123456789Z", 35, 1, 9, 1.0, 1.0, 1.0, 1.0, 1, "CLH0", 1)]
    spark.createDataFrame(row, bars.RAW_SCHEMA).write.parquet(str(tmp_path / "raw"))
    assert bars.load_raw(spark, str(tmp_path / "raw")).first().date == date(2020, 3, 1)


def test_feed_order_is_derived_from_the_files(spark, tmp_path):
    """Without ingest_seq, rows count in the order of the files and of the lines in them."""
    rows = [(f"2020-03-01T00:00:{i:02d}Z", 35, 1, 9, 1.0, 1.0, 1.0, float(i), 1, "CLH0") for i in range(40)]
    schema = bars.RAW_SCHEMA.removesuffix(", ingest_seq bigint")
    for fmt in ("parquet", "csv"):
        for part, low in (("a", 0), ("b", 20)):
            one = spark.createDataFrame(rows[low : low + 20], schema).coalesce(1)
            (one.write.option("header", True).csv if fmt == "csv" else one.write.parquet)(str(tmp_path / fmt / part))
        raw_bars = bars.load_raw(spark, str(tmp_path / fmt / "*"), fmt)
        assert [r.close for r in raw_bars.orderBy("ingest_seq").collect()] == [float(i) for i in range(40)]
        assert [r.close for r in P.dedup_clean(raw_bars).collect()] == [0.0]


def test_frames_saved_by_year_come_back_whole(spark, tmp_path):
    frames = P.build_all(bars.feed(spark, "/root/testdata/sf0.001"))
    again = bars.load_or_build(spark, str(tmp_path), lambda: frames, bars.YEARS)
    assert any((tmp_path / "outrights").glob("expiry_year=*"))
    for name, df in frames.items():
        back = again[name].select(df.columns)
        assert back.count() == df.count() and back.subtract(df).count() == 0


def _bars(spark, n, year=2020):
    return spark.range(n).selectExpr(f"cast({year} as int) AS y", f"date_add(date'{year}-01-01', cast(id % 300 as int)) AS date", "concat('C', id) AS contract", "double(id) AS close")


def test_a_year_with_most_rows_is_many_tasks_and_files(spark, tmp_path):
    rows = _bars(spark, 900).unionByName(_bars(spark, 60, 2019)).unionByName(_bars(spark, 40, 2021))
    bars.save_frames({"flies": rows}, str(tmp_path), years={"flies": "y"}, rows_a_file=100)
    held = {y.name: list(y.glob("*.parquet")) for y in (tmp_path / "flies").iterdir() if y.is_dir()}
    assert len(held["y=2020"]) >= 9 and 1 <= len(held["y=2019"]) <= 2
    files = spark.read.parquet(str(tmp_path / "flies")).withColumn("f", F.input_file_name())
    spans = sorted((r.y, r.a, r.b, r.n) for r in files.groupBy("f").agg(F.min("y").alias("y"), F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n")).collect())
    assert max(n for *_, n in spans) <= 100 and sum(n for *_, n in spans) == 1000
    assert all(one[0] != two[0] or one[2] <= two[1] for one, two in zip(spans, spans[1:], strict=False))  # files of neighbouring dates
    assert bars.by_ranges(rows, "y", 10).rdd.getNumPartitions() == 100 and bars.by_ranges(rows.limit(0), "y").count() == 0


def test_only_complete_versions_are_loaded(spark, tmp_path):
    out, frames = str(tmp_path), {name: _bars(spark, 20) for name in bars.FAMILIES}
    bars.save_frames(frames, out)  # folders alone are no version
    assert bars.load_frames(spark, out) is None

    killed = dict(frames)
    killed["yearly"] = frames["yearly"].selectExpr("y", "date", "contract", "raise_error('killed') AS close")
    with pytest.raises(Exception, match="killed"):
        bars.commit_frames(killed, out)
    assert bars.load_frames(spark, out) is None  # the build was killed between two frames

    first = bars.commit_frames(frames, out, dict.fromkeys(bars.FAMILIES, "y"))
    got = bars.load_frames(spark, out)
    assert set(got) == set(bars.FAMILIES) and got["flies"].count() == 20 and set(got["flies"].columns) == set(frames["flies"].columns)
    with pytest.raises(Exception, match="killed"):
        bars.commit_frames(killed, out)
    assert bars.load_frames(spark, out)["yearly"].count() == 20  # of the version before

    second = bars.commit_frames({n: df.limit(7) for n, df in frames.items()}, out)
    assert bars.load_frames(spark, out)["flies"].count() == 7
    next(Path(second, "cracks").glob("*.parquet")).unlink()  # a file is lost
    assert bars.load_frames(spark, out)["cracks"].count() == 20
    next(Path(first, "flies").rglob("*.parquet")).write_bytes(b"cut")
    assert bars.load_frames(spark, out) is None
    bars.commit_frames(frames, out)
    bars.remove_old_frames(spark, out)
    assert not Path(first, "flies").exists() and not Path(second, "flies").exists() and bars.load_frames(spark, out)["flies"].count() == 20


def test_matrices_of_more_contracts_than_a_pivot_takes(spark):
    rows = spark.range(300).selectExpr("date_add(date'2020-01-01', cast(id % 7 as int)) AS date", "concat('C', lpad(id % 25, 3, '0')) AS contract", "double(id) AS close")
    parts = E.price_matrices(rows, most=10)
    assert [len(p.columns) - 1 for p in parts] == [10, 10, 5] and sum(([c for c in p.columns if c != "date"] for p in parts), []) == [f"C{i:03d}" for i in range(25)]
    whole = E.price_matrix(rows).toPandas().set_index("date").sort_index()
    for p in parts:
        own = p.toPandas().set_index("date").sort_index()
        assert own.equals(whole.loc[own.index, own.columns])
    assert E.price_matrices(rows.limit(0))[0].columns == ["date"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_leaves_few_bars_to_sort(spark):
    """Bars that aren't first go before the sort, whose rows don't grow with repeats; ties of the first number are told by the rest."""
    rows = spark.range(20_000).selectExpr("35 AS rtype", "1 AS publisher_id", "id AS instrument_id", "1.0D AS open", "1.0D AS high", "1.0D AS low", "double(id) AS close", "id AS volume", "if(id % 50 = 0, NULL, concat('S', id % 50)) AS symbol", "date'2020-01-01' AS date", "struct(id div 200 AS a, -id AS b) AS ingest_seq")
    for order in (F.col("ingest_seq"), F.when(F.col("close") != 777, F.col("ingest_seq")), F.col("ingest_seq.a") * 1000 - F.col("volume") % 200):
        own = rows.withColumn("ingest_seq", order)
        want = {r.symbol: (r.ingest_seq, r.close) for r in own.orderBy(F.desc("ingest_seq")).collect()}
        got = {r.symbol: r.close for r in P.dedup_clean(own).collect()}
        assert got == {s: c for s, (_, c) in want.items()} and len(got) == 50
        assert P._foremost(own, "ingest_seq").count() <= 201
    assert P._foremost(own.limit(0), "ingest_seq").count() == 0


def test_dedup_without_a_broadcast(spark, monkeypatch):
    rows = bars.feed(spark, "/root/testdata/sf0.001")
    want = P.dedup_clean(rows)
    monkeypatch.setattr(P, "MOST_PAIRS", 10)
    got = P.dedup_clean(rows)
    assert got.count() == want.count() > 10 and got.exceptAll(want).count() == 0


def test_more_rows_are_more_tasks_in_order(spark, tmp_path):
    rows = spark.range(1000).selectExpr("struct((id * 7919) % 1000 AS a) AS k")
    out = bars.in_order(rows, "k", 100)
    assert out.rdd.getNumPartitions() == 10
    assert [r.k.a for r in out.collect()] == list(range(1000)) and bars.in_order(rows.limit(0), "k").count() == 0


def test_the_feed_has_a_row_for_each_bar_and_no_interpreted_filter(spark):
    rows = bars.feed(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert rows.count() == lines.count() + lines.filter("l_linenumber <= 4").count()
    assert "filter(array" not in _plan(rows)


def test_bars_are_made_again_only_of_lines_at_first_numbers(spark, tmp_path):
    """Repeats of all lines with later keys, and lines without a key, change nothing but what the first pass reads."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    top = lines.agg(F.max("l_orderkey")).first()[0] + 1
    copies = lines.crossJoin(spark.range(5).withColumnRenamed("id", "n")).withColumn("l_orderkey", F.col("l_orderkey") + F.col("n") * top).drop("n")
    bare = lines.filter("l_orderkey = 1").withColumn("l_orderkey", F.lit(None).cast("bigint"))
    copies.unionByName(bare).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = []

    def at(numbers):
        made.append(bars.feed(spark, str(tmp_path), numbers))
        return made[-1]

    rows = bars.feed(spark, str(tmp_path))
    for pattern in (None, V.OUTRIGHT, V.CRACK):
        want = P.dedup_clean(rows) if pattern is None else P.dedup_clean(P.parsed(rows, pattern, []))
        got = P.dedup_clean(rows, pattern=pattern, at=at)
        assert got.count() == want.count() > 500 and got.exceptAll(want).count() == 0
        assert made[-1].count() <= bars.feed(spark, "/root/testdata/sf0.001").count() + bare.count() * 2 < rows.count() / 4
    plan = _plan(made[0])
    assert plan.index("Generate") < plan.index("BroadcastHashJoin")  # the tree is printed from the top


def test_a_pair_with_a_bar_without_a_number_needs_only_that(spark):
    rows = spark.range(10).selectExpr("35 AS rtype", "1 AS publisher_id", "id AS instrument_id", "1.0D AS open", "1.0D AS high", "1.0D AS low", "double(id) AS close", "id AS volume", "'CLH0' AS symbol", "date'2020-01-01' AS date", "if(id = 4, NULL, id) AS ingest_seq")
    assert [r.close for r in P._foremost(rows, "ingest_seq").collect()] == [r.close for r in P.dedup_clean(rows).collect()] == [4.0]


def test_the_feed_makes_no_structs_of_bars(spark):
    rows = bars.feed(spark, "/root/testdata/sf0.001")
    assert "inline(" not in _plan(rows.drop("ingest_seq"))
    again = rows.select("symbol", "instrument_id").filter("instrument_id < 100000").distinct().collect()
    assert again and all(r.symbol == f"CL{V.MONTHS[r.instrument_id % 12]}{r.instrument_id // 12 % 10}" for r in again)
