"""Every catalogue query against its SQL on the smallest tables, and pieces against plain Python."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.rolling import ewm
from barloom.functions.text import chunks, redact
from barloom.operators import backtest, indicators, quality, strategies, tracking
from barloom.plans import catalogue
from barloom.sources import bars as B
from barloom.sources import sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    text = lambda v: "" if v is None or v is pd.NA or v is pd.NaT or v != v else repr(round(float(v), 4)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0


def frame(spark, rows):
    return spark.createDataFrame(rows, "ticker string, i int, open double, high double, low double, close double").withColumns({"time": F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, i)"), "volume": F.lit(100).cast("long")})


@pytest.mark.parametrize(("n", "alpha"), [(1600, 0.2), (4000, 0.5), (10_000, 2 / 201), (10_000, 1 / 14), (50, 1.0)])
def test_ewm_over_blocks_equals_recursion(spark, n, alpha):
    values = [100 + (i * 7919) % 23 for i in range(n)]
    df = ewm(frame(spark, [("A", i, 1.0, 1.0, 1.0, float(v)) for i, v in enumerate(values)]), "close", alpha, "y")
    y = [r["y"] for r in df.orderBy("i").collect()]
    want = values[0]
    for i, v in enumerate(values):
        want = v if i == 0 else (1 - alpha) * want + alpha * v
        assert abs(y[i] - want) < 1e-9 * want


def test_market_structure_equals_loop(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(300):
        high, low = 100 + rng.randint(0, 12), 90 - rng.randint(0, 12)
        rows.append(("A", i, float(low), float(high), float(low), float(high)))
    got = indicators.market_structure(frame(spark, rows)).orderBy("i").collect()
    sh = sl = psh = psl = None
    trend, broken_h, broken_l = 0, False, False
    for i in range(1, 300):
        if got[i - 1]["SWING_HIGH"]:
            psh, sh, broken_h = sh, rows[i - 1][3], False
            if None not in (sh, psh, sl, psl):
                trend = 1 if sh > psh and sl > psl else -1 if sh < psh and sl < psl else trend
        if got[i - 1]["SWING_LOW"]:
            psl, sl, broken_l = sl, rows[i - 1][4], False
            if None not in (sh, psh, sl, psl):
                trend = 1 if sh > psh and sl > psl else -1 if sh < psh and sl < psl else trend
        up = sh is not None and not broken_h and rows[i][3] > sh
        down = sl is not None and not broken_l and rows[i][4] < sl
        broken_h, broken_l = broken_h or up, broken_l or down
        assert (got[i]["BOS_BULL"], got[i]["CHOCH_BULL"], got[i]["BOS_BEAR"], got[i]["CHOCH_BEAR"]) == (up and trend >= 0, up and trend < 0, down and trend <= 0, down and trend > 0)


def test_trades_do_not_overlap(spark):
    rows = frame(spark, [("A", i, 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i) for i in range(40)]).withColumn("SIG", F.col("i").isin(0, 3, 5, 10, 36))
    got = backtest.trades(rows, ["SIG"], (5,))
    assert [r["idx"] for r in got.orderBy("idx").collect()] == [0, 5, 10]


def test_screens_in_order_and_inclusive(spark):
    rows = [("OK", i, 5000.0, 5000.0, 5000.0, 5000.0) for i in range(300)] + [("PENNY", i, 1.0, 1.0, 1.0, 1.0) for i in range(300)] + [("SHORT", i, 9000.0, 9000.0, 9000.0, 9000.0) for i in range(200, 300)]
    out = {r["ticker"]: r["rejection_reason"] for r in quality.screen(frame(spark, rows), quality.Screens(value=500_000.0)).collect()}
    assert out == {"OK": "passed", "PENNY": "penny_stock", "SHORT": "insufficient_history"}


def test_sector_cap(spark):
    rows = spark.createDataFrame([(f"T{i:02d}", f"S{i % 4}", float(i // 3)) for i in range(14)], "ticker string, sector string, score double")
    top = strategies.capped_top(rows).collect()
    assert len(top) == 8 and all(sum(r["sector"] == s for r in top) <= 2 for s in ("S0", "S1", "S2", "S3"))


def test_rescale_is_strict(spark):
    rows = frame(spark, [("LOW", 0, 1.0, 1.0, 1.0, 999.99), ("EDGE", 0, 1.0, 1.0, 1.0, 1000.0)])
    assert {r["ticker"]: r["close"] for r in B.rescale_units(rows).collect()} == {"LOW": 999_990.0, "EDGE": 1000.0}


def test_texts(spark):
    assert all(len(c) <= 40 for c in chunks("a line of text\n" * 20 + "x" * 100, 40))
    row = spark.createDataFrame([("https://api.telegram.org/bot123:abc/send 12345678:" + "a" * 35,)], "t string").select(redact(F.col("t"), {"KEY": "send"}).alias("t")).first()
    assert row["t"] == "https://api.telegram.org/bot[REDACTED_TOKEN]/[REDACTED_KEY] [REDACTED_TOKEN]"


@pytest.mark.parametrize(("name", "acts"), [
    ("sig_smc", lambda f: f["SIG_SMC"].any()),
    ("sig_ob", lambda f: f["SIG_OB"].any()),
    ("best_strategies", lambda f: len(f) > 1),
    ("listing_normalise", lambda f: set(f["exchange"]) <= {"PROMO", "LARGE", "SMALL"} and 0 < len(f) < 25),
    ("load_summary", lambda f: set(f["status"]) == {"full_load", "delta_updated", "no_new_data", "fetch_failed", "not_attempted"}),
    ("freshness", lambda f: f["fresh"][0] > 0 and f["stale"][0] > 0),
    ("tracker_upsert", lambda f: set(f["touch_status"]) == {"HOLDING", "SL_HIT", "T1_REACHED", "T2_REACHED"} and f["return_pct"].abs().max() > 0),
    ("report_lines", lambda f: len(f) > 0),
])
def test_branches_act_on_the_data(spark, name, acts):
    assert acts(catalogue.queries()[name](spark, "/root/testdata/sf0.01").toPandas())


def test_redaction_acts(spark, duck):
    raw = {r[0]: r[1] for r in duck.execute("select doc_id, sha256(text) from documents").fetchall()}
    assert all(raw[r["doc_id"]] != r["digest"] for r in catalogue.queries()["redact_text"](spark, SF).collect() if r["doc_id"] in raw)


def test_unselected_rows_are_left_out(spark):
    rows = spark.createDataFrame([("A", True, False, False, 1.0), ("B", False, False, False, 9.0), ("C", False, True, False, -1.0), ("D", None, None, True, 0.5), ("E", False, True, False, 0.0)], "ticker string, SIG_GOLDEN boolean, SIG_ICHIMOKU boolean, SIG_SMC boolean, score double")
    assert {r["ticker"] for r in strategies.selected(rows).collect()} == {"A", "D"}


def test_todays_gate(spark):
    rows = spark.createDataFrame([("A", True, True, True, True, True)], "ticker string, " + ", ".join(f"{s} boolean" for s in strategies.SIGNALS))
    for regime, on in (("BEAR", {"SIG_MOMENTUM"}), ("SIDEWAY", {"SIG_MOMENTUM", "SIG_SMC"}), ("BULL", set(strategies.SIGNALS)), (None, set(strategies.SIGNALS))):
        days = spark.createDataFrame([("2020-01-01", "BULL"), ("2020-01-02", regime)], "date string, regime string").filter("regime is not null" if regime else "false")
        got = strategies.gate_today(rows, days).first()
        assert {s for s in strategies.SIGNALS if got[s]} == on and got["regime"] == (regime or "UNKNOWN")


def test_bars_folder(spark, tmp_path):
    path = f"{tmp_path}/bars"
    assert B.read_bars(spark, path).count() == 0
    bars = frame(spark, [(t, i, 1.0, 2.0, 0.5, float(i)) for t in ("A", "B") for i in range(5)]).drop("i")
    sinks.write_bars(bars.unionByName(bars), path)
    sinks.write_bars(B.read_bars(spark, path).filter("ticker = 'A' or close > 2"), path)  # reads what it replaces
    assert B.read_bars(spark, path).count() == 7
    assert B.read_bars(spark, path, spark.createDataFrame([("A",)], "ticker string"), "2020-01-02", "2020-01-03").count() == 2
    plain = f"{tmp_path}/plain"
    B.read_bars(spark, path).write.parquet(plain)
    (tmp_path / "plain" / "broken.parquet").write_bytes(b"PAR1 not a table")
    (tmp_path / "plain" / "_log.parquet").write_bytes(b"left out")
    assert B.read_bars(spark, plain).count() == 7
    assert [r["path"].split("/")[-1] for r in B.skipped_files(spark, plain).collect()] == ["broken.parquet"]


def test_tracker_folder(spark, tmp_path):
    rows = spark.createDataFrame([("2020-01-02", "B", 1.5, None), ("2020-01-03", "A", 2.5, "x;y")], "signal_date string, ticker string, entry_price double, note string").withColumn("signal_date", F.to_date("signal_date"))
    sinks.save_tracker(rows, str(tmp_path))
    assert next(tmp_path.glob("data/*/part-*.csv")).read_bytes().startswith(b"\xef\xbb\xbfsignal_date;ticker")
    assert sorted(sinks.typed_tracker(sinks.read_tracker(spark, str(tmp_path))).collect()) == sorted(rows.collect())
    assert sinks.read_tracker(spark, str(tmp_path), sep="|").count() == 2  # no signal_date there: from parquet


def test_equity_in_two_levels_equals_product(spark):
    import random

    rng = random.Random(7)
    rows = [("S", 5, f"T{i // 20:02d}", i, rng.uniform(-0.2, 0.22)) for i in range(200)]
    done = spark.createDataFrame(rows, "strategy string, holding_days int, ticker string, time int, ret double")
    level = top = 0.0
    for r, want in zip(backtest.drawdowns(done).orderBy("ticker", "time").collect(), rows, strict=True):
        level = (level or 1.0) * (1 + want[4])
        top = max(top, level)
        assert r["equity"] == pytest.approx(level) and r["drawdown"] == pytest.approx(level / top - 1, abs=1e-12)


def test_bars_held_equal_count(spark):
    bars = frame(spark, [("A", i, 1.0, 1.0, 1.0, 10.0) for i in range(0, 60, 2)])
    dates = [(f"2020-01-{d:02d}", "A", None if d % 2 else "WIN") for d in range(1, 29)]
    tracker = spark.createDataFrame(dates, "signal_date string, ticker string, result string").withColumn("signal_date", F.to_date("signal_date"))
    tracker = tracker.withColumns({"STOP_LOSS": F.lit(1.0), "TARGET_1": F.lit(99.0), "entry_price": F.lit(9.0), "note": F.lit(None).cast("string"), "days_held": F.lit(None).cast("int"), "exit_price": F.lit(None).cast("double"), "exit_date": F.lit(None).cast("date")})
    for r in tracking.settle(tracker, bars).collect():
        day = r["signal_date"].day - 1
        assert r["days_held"] == (sum(i > day for i in range(0, 60, 2)) if day % 2 == 0 else None)


@pytest.mark.parametrize("alpha", [0.2, 1.0, 1 / 14])
def test_a_null_costs_its_bar_alone(spark, alpha):
    """Means of the other bars are as if it weren't there, across blocks, too; other tickers have nothing of it."""
    holes = {0, 3, 4, 700, 1999}
    rows = [("A", i, 1.0, 1.0, 1.0, None if i in holes else float(i % 17)) for i in range(2500)] + [("B", i, 1.0, 1.0, 1.0, 2.0) for i in range(5)]
    got = {(r["ticker"], r["i"]): r["y"] for r in ewm(frame(spark, rows), "close", alpha, "y", 2).collect()}
    mean, seen = None, 0
    for i in range(2500):
        if i in holes:
            assert got["A", i] is None
            continue
        mean = float(i % 17) if mean is None else (1 - alpha) * mean + alpha * (i % 17)
        seen += 1
        assert got["A", i] == (pytest.approx(mean, rel=1e-9, abs=1e-9) if seen > 2 else None)
    assert got["B", 4] == pytest.approx(2.0)


def test_signs_and_days(spark):
    from barloom.functions.text import day_month_year, signed_percent

    rows = spark.createDataFrame([(1.5, "2020-03-01"), (-0.256, "2020-12-31"), (0.0, None), (None, None)], "x double, d string")
    assert [tuple(r) for r in rows.select(signed_percent("x"), day_month_year(F.to_date("d"))).collect()] == [("+1.50%", "01/03/2020"), ("-0.26%", "31/12/2020"), ("+0.00%", None), (None, None)]


def scans(df):
    """File scans and reused exchanges of the plan that ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return text.count("FileScan"), text.count("ReusedExchange")


@pytest.mark.parametrize("name", ["backtest_matrix", "best_strategies", "backtest_by_year"])
def test_a_backtest_runs_once(spark, name):
    assert scans(catalogue.queries()[name](spark, SF))[0] == 1


@pytest.mark.parametrize(("name", "most"), [("tracker_status", 2), ("weekly_metrics", 2), ("note_restore", 2)])
def test_a_tracker_reads_its_bars_for_signals_and_once_more(spark, name, most):
    assert scans(catalogue.queries()[name](spark, SF))[0] <= most


def test_metrics_equal_those_of_each_trade(spark):
    """Sums by ticker give what single trades give, the deepest fall over tickers included."""
    import random
    import statistics

    rng = random.Random(8)
    rows = [(s, 5, f"T{i % 7}", i, -1.0 if s == "B" and i == 40 else rng.uniform(-0.3, 0.32)) for s in "AB" for i in range(70)] + [("C", 5, "T0", i, 0.5) for i in range(6)]
    done = spark.createDataFrame(rows, "strategy string, holding_days int, ticker string, time int, ret double")
    falls = {r["strategy"]: r["fall"] for r in backtest.drawdowns(done).groupBy("strategy").agg(F.min("drawdown").alias("fall")).collect()}
    got = {r["strategy"]: r for r in backtest.metrics(done).collect()}
    for s in "ABC":
        returns = [r[4] for r in rows if r[0] == s]
        assert got[s]["max_drawdown"] == pytest.approx(-100 * falls[s]) and got[s]["n_trades"] == len(returns)
        assert got[s]["avg_return"] == pytest.approx(100 * statistics.mean(returns)) and got[s]["win_rate"] == pytest.approx(100 * sum(r > 0 for r in returns) / len(returns))
        gains, losses = sum(r for r in returns if r > 0), -sum(r for r in returns if r < 0)
        assert got[s]["profit_factor"] == (pytest.approx(gains / losses) if losses else 999.0)
        dev = statistics.stdev(returns)
        assert got[s]["sharpe_ratio"] == pytest.approx((statistics.mean(returns) - 0.045 * 5 / 252) / dev * (252 / 5) ** 0.5 if dev else 0.0)


def test_a_ticker_of_two_sectors_stays_one_row(spark):
    rows = spark.createDataFrame([("A",), ("B",)], "ticker string")
    sectors = spark.createDataFrame([("A", "y"), ("A", "x")], "ticker string, sector string")
    assert sorted(map(tuple, strategies.with_sector(rows, sectors).collect())) == [("A", "x"), ("B", "Unknown")]


def test_levels_let_every_screen_act():
    """On the tables that the driver compares: five reasons, some results turned away, values that differ."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    assert len(con.execute(catalogue.oracle_sql()["rejection_breakdown"]).fetchall()) == 5
    assert con.execute(f"{catalogue.TRADES_SQL} SELECT count(*) FILTER ({catalogue.ACCEPT_SQL}), count(*) FROM mt").fetchone()[0] not in (0, 15)
    assert len({r[0] for r in con.execute(f"SELECT adtv_bn FROM ({catalogue.oracle_sql()['score_snapshot']})").fetchall()}) > 1


def test_most_of_the_universe_passes(spark):
    """The bars that go on are those at the wide levels, on the tables that the driver compares: three quarters of all."""
    con = duckdb.connect()
    con.execute("create view lineitem as select * from '/root/testdata/sf0.01/lineitem.parquet'")
    want = con.execute(f"SELECT count(*) FROM ({catalogue.oracle_sql()['passed_universe_semi']})").fetchone()[0]
    every = con.execute(f"SELECT count(*) FROM ({catalogue.oracle_sql()['bars_daily']})").fetchone()[0]
    assert catalogue.queries()["passed_universe_semi"](spark, "/root/testdata/sf0.01").count() == want > 0.7 * every


def test_every_strategy_has_a_best_result(spark):
    """On the tables that the driver compares; stricter levels turn the same results away as SQL does."""
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    assert {r["strategy"] for r in catalogue.queries()["best_strategies"](spark, sf).collect()} == set(strategies.SIGNALS)
    results = backtest.metrics(backtest.trades(catalogue._loose(spark, sf)))
    strict = catalogue.rounded(backtest.best_strategies(results, catalogue.ACCEPT)).toPandas()
    assert plain(strict) == plain(con.execute(catalogue.best_sql(catalogue.ACCEPT)).df()) and 0 < len(strict) < 5
