"""Loading from a folder that grows, corrections, and indicators from state, against one batch over all bars."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as whole
from barloom.sources import bars as B
from barloom.sources.versions import VersionedTable
from barloom.streaming import bars as stream
from barloom.streaming import indicators as streamed


def bars_of(spark, rows):
    """Bars of ``(ticker, day number, close)``."""
    df = spark.createDataFrame([(t, d, float(c)) for t, d, c in rows], "ticker string, d int, close double")
    price = F.col("close")
    return df.select("ticker", F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, d)").alias("time"), (price - 1).alias("open"), (price + 2).alias("high"), (price - 2).alias("low"), "close", F.lit(10).cast("long").alias("volume"))


def came(spark, rows, folder, name):
    bars_of(spark, rows).coalesce(1).write.parquet(f"{folder}/{name}")


def held(spark, path):
    return {(r["ticker"], r["time"].toordinal() - 737425): r["close"] for r in B.read_bars(spark, path).collect()}


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")


def test_runs_over_a_growing_folder_equal_one(spark, places, tmp_path):
    folder, path, checkpoint = places
    rows = [(t, d, 50 + (d * 7 + ord(t)) % 11) for t in "ABC" for d in range(90)]
    for n, (low, high) in enumerate(((0, 30), (30, 31), (31, 90))):
        came(spark, [r for r in rows if low <= r[1] < high], folder, n)
        assert [x["rows"] for x in stream.load_available(spark, folder, path, checkpoint, today="2021-01-01")] == [3 * (high - low)]
    assert stream.load_available(spark, folder, path, checkpoint, today="2021-01-01") == []  # a restart finds nothing new
    assert held(spark, path) == {(t, d): c for t, d, c in rows} and B.read_bars(spark, path).count() == len(rows)
    other = str(tmp_path / "once")
    assert len(stream.load_available(spark, folder, other, str(tmp_path / "other"), today="2021-01-01", files=2)) == 2
    assert held(spark, other) == held(spark, path)


def test_a_load_leaves_history_alone_and_fetches_today_again(spark, places):
    folder, path, checkpoint = places
    came(spark, [("A", d, 10) for d in range(5)], folder, 1)
    stream.load_available(spark, folder, path, checkpoint, today="2020-01-05")
    # days 2 and 3 are history, 4 is today; B is new, with all its days
    came(spark, [("A", d, 99) for d in (2, 3, 4, 5)] + [("B", d, 7) for d in (1, 2)] + [("C", 1, None or 3)], folder, 2)
    stream.load_available(spark, folder, path, checkpoint, today="2020-01-05")
    assert held(spark, path) == {("A", 0): 10, ("A", 1): 10, ("A", 2): 10, ("A", 3): 10, ("A", 4): 99, ("A", 5): 99, ("B", 1): 7, ("B", 2): 7, ("C", 1): 3}


def test_corrections_replace_and_repeated_batches_change_nothing(spark, places):
    folder, path, checkpoint = places
    came(spark, [("A", d, 10) for d in range(60)], folder, 1)
    stream.load_available(spark, folder, path, checkpoint)
    came(spark, [("A", 3, 20), ("A", 59, 21), ("B", 1, 5)], folder, 2)
    stream.load_available(spark, folder, path, checkpoint)
    want = {("A", d): 10 for d in range(60)} | {("A", 3): 20, ("A", 59): 21, ("B", 1): 5}
    assert held(spark, path) == want
    versions = VersionedTable(spark, path).numbers()
    again = bars_of(spark, [("A", 3, 77)]).withColumns({"_seen": F.current_timestamp(), "_file": F.lit("x")})
    for batch in (0, 1):  # as after a crash between the table's commit and the stream's
        assert stream.load_batch(again, batch, path) is None
    assert held(spark, path) == want and VersionedTable(spark, path).numbers() == versions
    assert stream.load_batch(again, 0, path, stream="another").counts == {"rows": 1}  # other streams count for themselves
    assert held(spark, path) == want | {("A", 3): 77}


def test_a_run_that_dies_loads_its_batch_once(spark, places, monkeypatch):
    """Stopped after the table's commit and before the stream's."""
    folder, path, checkpoint = places
    came(spark, [("A", d, 10) for d in range(5)], folder, 1)
    real = stream.load_batch

    def dies(*args):
        real(*args)
        raise RuntimeError("dies")

    monkeypatch.setattr(stream, "load_batch", dies)
    with pytest.raises(Exception, match="dies"):
        stream.load_available(spark, folder, path, checkpoint)
    monkeypatch.setattr(stream, "load_batch", real)
    assert [x["rows"] for x in stream.load_available(spark, folder, path, checkpoint)] == [0]
    assert B.read_bars(spark, path).count() == 5 and VersionedTable(spark, path).numbers() == [0]


def test_of_several_bars_of_a_time_the_newest_file_wins(spark):
    rows = bars_of(spark, [("A", 1, 5), ("A", 1, 6), (None, 1, 5), ("A", 2, 9)]).withColumn("_file", F.lit("f"))
    seen = F.when(F.col("close") == 6, F.timestamp_seconds(F.lit(20))).otherwise(F.timestamp_seconds(F.lit(10)))
    assert {(r["ticker"], r["close"]) for r in stream.newest(rows.withColumn("_seen", seen)).collect()} == {("A", 6.0), ("A", 9.0)}


def test_indicators_from_state_equal_the_batch(spark, places):
    folder, path, checkpoint = places
    rng, rows, level = random.Random(5), [], {t: 100.0 for t in "ABD"}
    for d in range(300):
        for t in "ABD":
            if t != "D" or d > 200:
                level[t] = level[t] if t == "B" and 50 < d < 90 else max(5.0, level[t] + rng.choice([-3, -1, 0, 1, 3]))
                rows.append((t, d, level[t]))
    for n, (low, high) in enumerate(((0, 100), (100, 101), (101, 300))):
        came(spark, [r for r in rows if low <= r[1] < high], folder, n)
        assert streamed.indicators_available(spark, folder, path, checkpoint) == 1
    assert streamed.indicators_available(spark, folder, path, checkpoint) == 0
    names = [c for kind in streamed.COLUMNS.values() for c in kind]
    got = {(r["ticker"], r["time"]): r for r in VersionedTable(spark, path).read().collect()}
    want = whole.features(bars_of(spark, rows)).select("ticker", "time", *names).collect()
    assert len(got) == len(want) == len(rows)
    for r in want:
        for c in names:
            assert got[r["ticker"], r["time"]][c] == (pytest.approx(r[c], rel=1e-9, abs=1e-9) if isinstance(r[c], float) else r[c]), c
    assert any(r["BOS_BULL"] for r in want) and any(r["CHOCH_BEAR"] for r in want)


def test_state_is_bounded_and_leaves_late_bars_out():
    ticker = streamed.Ticker()
    sizes = []
    for n in range(1000):
        ticker.add(n, 10.0 + n % 7, 5.0 - n % 3, 7.0 + n % 5)
        sizes.append(len(ticker.row()) + len(ticker.closes))
    assert max(sizes) == sizes[-1] == len(ticker.row()) + max(streamed.MEANS)
    names = ["time", "closes", *streamed.NUMBERS, *streamed.PLACES]
    again = streamed.Ticker(dict(zip(names, ticker.row(), strict=True)))
    assert again.add(1000, 12.0, 4.0, 8.0) == ticker.add(1000, 12.0, 4.0, 8.0)


def test_late_and_broken_bars_give_no_indicators(spark, places):
    folder, path, checkpoint = places
    came(spark, [("A", d, 10 + d) for d in (3, 4, 5)], folder, 1)
    streamed.indicators_available(spark, folder, path, checkpoint)
    late = bars_of(spark, [("A", 4, 99), ("A", 6, 16), ("A", 7, 17)]).withColumn("high", F.when(F.col("close") != 16, F.col("high")))
    late.coalesce(1).write.parquet(f"{folder}/2")
    streamed.indicators_available(spark, folder, path, checkpoint)
    assert sorted(r["close"] for r in VersionedTable(spark, path).read().collect()) == [13, 14, 15, 17]
