"""Screens of the universe: how often bars are dealt for them, and what odd bars give."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import quality
from barloom.plans import catalogue
from barloom.sources import bars as B
from barloom.sources import sinks
from barloom.sources.versions import VersionedTable

SF = "/root/testdata/sf0.001"
SCREENS = quality.Screens(close=10.0, value=100.0, bars=12, continuity=0.5, days=5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def day(i):
    return None if i is None else f"2020-01-{i:02d}"


def odd_bars(spark):
    """Bars with nulls in each column, a day that comes twice, a ticker without a recent bar and one of null."""
    rows = [("A", day(i), 20.0, 30) for i in range(1, 31)] + [("A", day(30), 20.0, 30), ("A", None, 99.0, 1)]
    rows += [("GAP", day(i), None if i > 20 else 20.0, None if i == 3 else 30) for i in range(1, 31)]
    rows += [("OLD", day(i), 20.0, 30) for i in range(1, 21)] + [("FEW", day(i), 20.0, 30) for i in range(20, 31)]
    rows += [("THIN", day(i), 20.0, 1) for i in range(1, 31)] + [("NONE", day(i), None, None) for i in range(26, 31)]
    rows += [(None, day(i), 20.0, 30) for i in range(1, 31)]
    bars = spark.createDataFrame(rows, "ticker string, time string, close double, volume long").withColumn("time", F.col("time").cast("timestamp_ntz"))
    return bars.select("ticker", "time", *[F.col("close").alias(p) for p in B.PRICES], "volume")


def reasons(screened):
    return {r["ticker"]: (r["last_close"], r["avg_value_20d"], r["n_bars"], r["recent_active_days"], r["rejection_reason"]) for r in screened.collect()}


def test_odd_bars_are_screened(spark):
    got = reasons(quality.screen(odd_bars(spark), SCREENS))
    assert got == {
        "A": (20.0, 600.0, 31, 7, "passed"),
        None: (20.0, 600.0, 30, 6, "passed"),
        "GAP": (20.0, 600.0, 30, 6, "passed"),
        "OLD": (20.0, 600.0, 20, 0, "low_trading_continuity"),
        "FEW": (20.0, 600.0, 11, 6, "insufficient_history"),
        "THIN": (20.0, 20.0, 30, 6, "low_liquidity"),
        "NONE": (None, None, 5, 5, "penny_stock"),
    }


def test_no_bars_no_tickers(spark):
    assert quality.screen(odd_bars(spark).limit(0), SCREENS).collect() == []
    lone = odd_bars(spark).filter("ticker = 'A' and time is null")
    assert reasons(quality.screen(lone, SCREENS)) == {"A": (None, None, 0, 0, "penny_stock")}


@pytest.mark.parametrize("continuity", [0.0, 5 / 6, 0.9])
def test_expected_days_are_those_of_any_ticker(spark, continuity):
    """Six days, the last one twice for A: of six, a floor of five or six are wanted."""
    levels = quality.Screens(close=10.0, value=100.0, bars=1, continuity=continuity, days=5)
    for without, n in (("28", 5), ("28, 29", 4)):
        got = reasons(quality.screen(odd_bars(spark).filter(f"ticker = 'A' or ticker = 'GAP' and day(time) not in ({without})"), levels))
        assert got["A"][3:] == (7, "passed") and got["GAP"][3:] == (n, "passed" if n == 5 or continuity == 0 else "low_trading_continuity")


def odd_lines(spark, folder):
    """Lines of the driver's table with nulls in each column that bars take, and some that come twice."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    holes = {c: F.when(F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(c)), F.lit(9)) > 0, F.col(c)) for c in ("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")}
    lines.withColumns(holes).unionByName(lines.filter("l_orderkey % 5 = 0")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    return odd_lines(spark, tmp_path_factory.mktemp("odd"))


def exact(df):
    return sorted(map(repr, df.collect()))


def dealt_anew(df):
    """Exchanges by ticker, or by ticker and day, of the plan that ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "hashpartitioning(time#" not in x]


def test_a_screen_derives_its_bars_once(spark, lines):
    """The market's days come from the times alone, so bars of tickers are dealt for the metrics only."""
    text = plan(quality.screen(catalogue._suppliers(spark, lines), SCREENS))
    assert sum("Exchange hashpartitioning" in x and "l_shipdate" in x and "," in x.split("hashpartitioning(")[1].split("l_shipdate")[0] for x in text.splitlines()) == 1
    assert text.count("+- Window ") == 1


def test_bars_that_pass_are_dealt_once(spark, lines, monkeypatch):
    """Screens and the bars of their tickers read one table that has buckets by ticker; rows are those of bars derived each time."""
    monkeypatch.setattr("barloom.plans.catalogue.WIDE", quality.Screens(close=20_000.0, value=1e5, bars=20, continuity=0.0))
    monkeypatch.setattr("barloom.sources.clustered.BUCKET_ROWS", 500)
    entries = len(spark.catalog.listTables())
    got = catalogue.queries()["passed_universe_semi"](spark, lines)
    bars = catalogue._suppliers(spark, lines)
    want = catalogue.rounded(quality.passed_bars(bars, quality.screen(bars, catalogue.WIDE)))
    assert got.schema == want.schema and exact(got) == exact(want) and 0 < got.count() < bars.count()
    assert not dealt_anew(got) and len(dealt_anew(want)) >= 3
    assert len(spark.catalog.listTables()) == entries
    assert f"out of {-(-spark.read.parquet(f'{lines}/lineitem.parquet').count() // 500)}" in plan(got)


@pytest.fixture
def written(monkeypatch):
    """The plans of what versioned tables write."""
    found, write = [], VersionedTable.write
    monkeypatch.setattr(VersionedTable, "write", lambda self, df, *args, **options: (found.append(plan(df)), write(self, df, *args, **options))[1])
    return found


def saved_plainly(spark, lines):
    """What the screened universe's parts hold, from bars derived each time."""
    bars = catalogue._suppliers(spark, lines)
    screened = quality.screen(bars, catalogue.SCREENS)
    return quality.passed_bars(bars, screened), screened


def bars_stay(plans):
    """Neither the screens nor the bars that pass deal bars anew: only days go by time, and tickers that passed to the bars' buckets."""
    lines = [x for p in plans for x in p.splitlines() if "Exchange hashpartitioning" in x and "hashpartitioning(time#" not in x]
    return len(lines) <= 1 and not any("l_shipdate" in p or "REPARTITION" in p for p in plans)


def test_a_universe_is_counted_from_bars_dealt_once(spark, lines, written, monkeypatch):
    monkeypatch.setattr("barloom.plans.catalogue.SCREENS", quality.Screens(close=20_000.0, value=1e5, bars=20, continuity=0.0))
    passed, screened = saved_plainly(spark, lines)
    by = {r["rejection_reason"]: r["count"] for r in screened.groupBy("rejection_reason").count().collect()}
    entries = len(spark.catalog.listTables())
    got = {r["name"]: r["n"] for r in catalogue.queries()["universe_counts"](spark, lines).collect()}
    assert got == {r: by.get(r, 0) for r in sinks.REASONS} | {"rows": screened.count(), "bars": passed.count()} and got["passed"] and got["penny_stock"]
    assert len(written) == 3 and bars_stay(written) and len(spark.catalog.listTables()) == entries


@pytest.mark.parametrize("dealt", [False, True])
def test_a_saved_ticker_is_in_one_file(spark, lines, tmp_path, monkeypatch, dealt):
    """Sorted by ticker and time in each file, whether the bars come in buckets or not, and however many tickers passed."""
    bars = catalogue._suppliers(spark, lines)
    bars = catalogue._dealt(bars, lines) if dealt else bars
    levels = quality.Screens(close=20_000.0, value=1e5, bars=20, continuity=0.0)
    sinks.save_universe(bars, quality.screen(bars, levels), str(tmp_path))
    table = VersionedTable(spark, str(tmp_path))
    kept = table.read("universe_filtered")
    assert kept.columns == ["ticker", "time", *B.PRICES, "volume"]
    files = kept.select("ticker", F.input_file_name().alias("file")).groupBy("ticker").agg(F.count_distinct("file").alias("n")).collect()
    assert len(files) > 1 and {r["n"] for r in files} == {1}
    for (file,) in kept.select(F.input_file_name()).distinct().collect():
        rows = [tuple(r) for r in spark.read.parquet(file).select("ticker", F.coalesce(F.col("time").cast("string"), F.lit(""))).collect()]
        assert rows == sorted(rows)
    want = quality.passed_bars(catalogue._suppliers(spark, lines), quality.screen(catalogue._suppliers(spark, lines), levels))
    assert exact(kept) == exact(want)
    assert exact(table.read("rejected_tickers")) == exact(quality.screen(bars, levels).filter("rejection_reason <> 'passed'"))


def test_outputs_come_from_bars_dealt_once(spark, lines, written, monkeypatch):
    monkeypatch.setattr("barloom.plans.catalogue.SCREENS", quality.Screens(close=20_000.0, value=1e5, bars=20, continuity=0.0))
    passed, screened = saved_plainly(spark, lines)
    want = {(r["ticker"], "passed"): r["count"] for r in passed.groupBy("ticker").count().collect()}
    want |= {(r["ticker"], r["rejection_reason"]): r["n_bars"] for r in screened.filter("rejection_reason <> 'passed'").collect()}
    entries = len(spark.catalog.listTables())
    rows = catalogue.queries()["filter_outputs"](spark, lines).collect()
    assert {(r["ticker"], r["reason"]): r["bars"] for r in rows} == want and len(rows) == len(want) and len({r["reason"] for r in rows}) == 2
    assert len(written) == 3 and bars_stay(written) and len(spark.catalog.listTables()) == entries
