"""Versioned tables and tables cut by month: crashes at each step, rival writers, old versions, untouched files."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import quality
from barloom.sources import bars as B
from barloom.sources import months, sinks
from barloom.sources.versions import Conflict, VersionedTable

SCHEMA = "ticker string, time timestamp_ntz, close double"


class Dies(Exception):
    pass


def numbers(df):
    return sorted(r["n"] for r in df.collect())


def ints(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


@pytest.mark.parametrize("step", ["write", "_draft", "_publish", "commit"])
@pytest.mark.parametrize("before", [True, False])
def test_a_writer_that_stops_leaves_a_whole_table(spark, tmp_path, monkeypatch, step, before):
    """Stopped before or after each step: readers see the old rows or the new ones, and the next writer goes on."""
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(ints(spark, 1, 2))
    real = getattr(VersionedTable, step)

    def dies(self, *args, **kwargs):
        if not before:
            real(self, *args, **kwargs)
        raise Dies

    monkeypatch.setattr(VersionedTable, step, dies)
    with pytest.raises(Dies):
        table.replace(table.read().unionByName(ints(spark, 3)))
    monkeypatch.setattr(VersionedTable, step, real)
    published = not before and step in ("_publish", "commit")
    assert numbers(table.read()) == ([1, 2, 3] if published else [1, 2])
    table.replace(table.read().unionByName(ints(spark, 4)))
    assert numbers(table.read()) == ([1, 2, 3, 4] if published else [1, 2, 4])


@pytest.mark.parametrize("step", ["write", "_draft", "_publish"])
def test_a_merge_that_stops_loses_no_rows(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "features")
    rows = lambda low, high, x: spark.range(low, high).select(F.lit("A").alias("ticker"), F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, int(id * 9))").alias("time"), F.lit(x).alias("close"))
    sinks.merge_features(rows(0, 10, 1.0), path)
    real, calls = getattr(VersionedTable, step), []
    for stop in (1, 2):
        calls.clear()

        def dies(self, *args, real=real, stop=stop, **kwargs):
            calls.append(1)
            if len(calls) == stop:
                raise Dies
            return real(self, *args, **kwargs)

        monkeypatch.setattr(VersionedTable, step, dies)
        try:
            sinks.merge_features(rows(8, 12, 2.0), path)
        except Dies:
            assert VersionedTable(spark, path).read().filter("close = 1").count() == 10
        monkeypatch.setattr(VersionedTable, step, real)
    sinks.merge_features(rows(8, 12, 2.0), path)
    assert VersionedTable(spark, path).read().groupBy("close").count().orderBy("close").collect() == [(1.0, 8), (2.0, 4)]


def test_the_second_of_two_writers_fails(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.replace(ints(spark, 1))
    base = two.version()
    part = two.write(ints(spark, 9))
    one.replace(ints(spark, 2))
    with pytest.raises(Conflict):
        two.commit({"": part}, "replace", base)
    assert numbers(one.read()) == [2] and one.numbers() == [0, 1]
    assert not list((tmp_path / "t" / "versions").glob("_*"))
    # rows that are only added don't conflict
    two.append(ints(spark, 3))
    assert numbers(one.read()) == [2, 3]


def test_old_versions_and_vacuum(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.version() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    for n in range(4):
        table.append(ints(spark, n))
    assert [numbers(table.read(number=n)) for n in range(4)] == [[0], [0, 1], [0, 1, 2], [0, 1, 2, 3]]
    assert [tuple(r) for r in table.history().select("version", "operation", "folders").orderBy("version").collect()] == [(n, "append", n + 1) for n in range(4)]
    table.replace(ints(spark, 7))
    stray = table.write(ints(spark, 8)).folders["all"]
    assert table.vacuum(keep=1) == []  # all too young
    gone = table.vacuum(keep=1, older=-1)
    assert len(gone) == 5 and stray.split("/")[1] in gone and numbers(table.read()) == [7] and table.numbers() == [4]


def files_of(path):
    return {f: f.stat().st_mtime_ns for f in path.glob("data/*/*/*.parquet")}


def bars_of(spark, days, close, tickers=("A", "B")):
    rows = [(t, d, close) for t in tickers for d in days]
    return spark.createDataFrame(rows, "ticker string, day string, close double").select("ticker", F.col("day").cast("timestamp_ntz").alias("time"), "close")


def test_a_merge_writes_its_months_only(spark, tmp_path):
    path = tmp_path / "f"
    days = [f"2020-{m:02d}-{d:02d}" for m in range(1, 13) for d in (3, 17)]
    sinks.merge_features(bars_of(spark, days, 1.0), str(path))
    before = files_of(path)
    sinks.merge_features(bars_of(spark, ["2020-10-17", "2020-11-03", "2021-01-05"], 2.0, ("A",)), str(path))
    after = files_of(path)
    assert all(after[f] == t for f, t in before.items())  # nothing that is there changes
    new = {str(f).split("_month=")[1].split("/")[0] for f in after if f not in before}
    assert new == {"2020-10", "2020-11", "2020-12", "2021-01"}
    live = VersionedTable(spark, str(path)).version().parts[""].folders
    assert sum(f.split("/")[1] in {str(x).split("/data/")[1].split("/")[0] for x in before} for f in live.values()) == 9
    want = B.merge_delta(bars_of(spark, days, 1.0), bars_of(spark, ["2020-10-17", "2020-11-03", "2021-01-05"], 2.0, ("A",)))
    assert sorted(VersionedTable(spark, str(path)).read().collect()) == sorted(want.collect())


def test_merges_of_any_rows_equal_a_whole_merge(spark, tmp_path):
    rng = random.Random(4)
    path, want = str(tmp_path / "f"), {}
    for turn in range(6):
        new = {(rng.choice("ABC"), f"2020-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}"): float(turn) for _ in range(rng.randrange(0, 9))}
        rows = spark.createDataFrame([(t, d, c) for (t, d), c in new.items()], "ticker string, day string, close double")
        sinks.merge_features(rows.select("ticker", F.col("day").cast("timestamp_ntz").alias("time"), "close"), path)
        starts = {}
        for t, d in new:
            starts[t] = min(d, starts.get(t, d))
        want = {k: v for k, v in want.items() if k[0] not in starts or k[1] < starts[k[0]]} | new
        got = VersionedTable(spark, path).read().collect()
        assert {(r["ticker"], str(r["time"])[:10]): r["close"] for r in got} == want and len(got) == len(want)


def test_columns_can_be_added(spark, tmp_path):
    path = str(tmp_path / "f")
    sinks.merge_features(bars_of(spark, ["2020-01-03", "2020-02-03"], 1.0), path)
    sinks.merge_features(bars_of(spark, ["2020-02-04"], 2.0).withColumn("RSI", F.lit(5.0)), path)
    assert VersionedTable(spark, path).read().groupBy("RSI").count().orderBy("RSI").collect() == [(None, 4), (5.0, 2)]


def test_many_small_changes_are_written_together(spark, tmp_path):
    path = str(tmp_path / "f")
    for d in range(1, 13):
        months.upsert(VersionedTable(spark, path), bars_of(spark, [f"2020-01-{d:02d}"], float(d)))
    table = VersionedTable(spark, path)
    assert len(table.version().parts[""].folders) <= months.MOST_FOLDERS + 1 and table.read().count() == 24


def test_dates_pick_months(spark, tmp_path):
    path = str(tmp_path / "bars")
    days = [f"2020-{m:02d}-{d:02d}" for m in range(1, 13) for d in (3, 17)]
    bars = bars_of(spark, days, 1.0).select("ticker", "time", *[F.col("close").alias(p) for p in B.PRICES], F.lit(1).cast("long").alias("volume"))
    sinks.write_bars(bars, path)
    some = B.read_bars(spark, path, start="2020-04-10", end="2020-06-03")
    assert len({f.split("_month=")[1][:7] for f in some.inputFiles()}) == 3 and some.count() == 8


def test_a_log_counts_what_it_writes(spark, tmp_path):
    rows = spark.createDataFrame([("A", "full_load"), ("B", "full_load"), ("C", "not_attempted")], "ticker string, status string")
    counts = sinks.append_log(rows, str(tmp_path / "log"), "2020-01-02")
    assert counts == {"rows": 3, "full_load": 2, "delta_updated": 0, "no_new_data": 0, "fetch_failed": 0, "not_attempted": 1}
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_a_universe_is_screened_once(spark, tmp_path):
    """Both parts of a version, and counts that come from their writes."""
    bars = bars_of(spark, [f"2020-01-{d:02d}" for d in range(1, 29)], 10_000.0, ("A", "B", "C"))
    bars = bars.select("ticker", "time", *[F.col("close").alias(p) for p in B.PRICES], F.when(F.col("ticker") == "C", 1).otherwise(10**6).cast("long").alias("volume"))
    path = str(tmp_path / "bars")
    bars.write.parquet(path)
    saved = sinks.save_universe(spark.read.parquet(path), quality.screen(spark.read.parquet(path), quality.Screens(bars=10)), str(tmp_path / "u"))
    assert saved.counts == {"rows": 3, "passed": 2, "penny_stock": 0, "low_liquidity": 1, "low_trading_continuity": 0, "insufficient_history": 0, "bars": 56}
    again = VersionedTable(spark, str(tmp_path / "u"))
    assert again.read("universe_filtered").count() == 56 and again.read("rejected_tickers").count() == 1
