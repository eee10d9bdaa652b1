"""The fetching source: the window's limit, retries, and tickers that fail."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barloom.sources import bars as B
from barloom.sources.fetch import Limits, SlidingWindow, attempted, bars_in, fetch_bars, fetched, status_in


class Clock:
    """A clock that moves when somebody sleeps, and a little at each call."""

    def __init__(self, rng=None):
        self.now, self.rng, self.slept = 0.0, rng, []

    def __call__(self):
        if self.rng:
            self.now += self.rng.choice([0, 0, 0.01, 0.3])
        return self.now

    def sleep(self, seconds):
        assert seconds >= 0
        self.slept.append(seconds)
        self.now += seconds


@pytest.mark.parametrize(("calls", "seconds"), [(1, 1.2), (10, 1.0), (3, 0.5)])
def test_no_window_has_more_calls(calls, seconds):
    clock = Clock(random.Random(calls))
    window, times = SlidingWindow(calls, seconds, clock, clock.sleep), []
    for _ in range(400):
        window.acquire()
        times.append(window.times[-1])
        assert len(window.times) <= calls
    assert all(b - a >= seconds - 1e-9 for a, b in zip(times, times[calls:], strict=False))
    still = Clock()  # and none waits longer than it must: calls come as fast as the limit lets them
    window = SlidingWindow(calls, seconds, still, still.sleep)
    for _ in range(10 * calls):
        window.acquire()
    assert still.now == pytest.approx(9 * seconds, rel=0.05)


def test_shares_keep_the_limit():
    for calls in range(1, 40):
        for workers in range(1, 12):
            n, each = Limits(calls=calls, workers=workers).share()
            assert 1 <= n <= workers and each >= 1 and n * each <= calls
    with pytest.raises(ValueError, match="limit"):
        SlidingWindow(0, 1)


def test_retries_wait_longer_and_longer():
    clock, calls = Clock(), []

    def fails(ticker, start, page):
        calls.append(page)
        if len(calls) < 5:
            raise OSError("busy")
        return [(1,)]

    window = SlidingWindow(100, 1.0, clock, clock.sleep)
    assert attempted(fails, "A", "", 0, Limits(wait=2, longest=5), window) == ([(1,)], 5)
    assert clock.slept == [2, 4, 5, 5]
    calls.clear()
    with pytest.raises(OSError, match="busy"):
        attempted(fails, "A", "", 0, Limits(tries=3), window)


def test_a_ticker_comes_whole_or_not():
    def breaks(ticker, start, page):
        if page == 2:
            raise ValueError("page 2")
        return [(page, 1.0, 1.0, 1.0, 1.0, 1)]

    clock = Clock()
    rows = list(fetched(breaks, "A", "", Limits(tries=2), SlidingWindow(9, 0, clock, clock.sleep)))
    assert rows == [("A", *[None] * 6, "fetch_failed", 4, "ValueError: page 2")]
    assert [r[7] for r in fetched(lambda *_: None, "A", "", Limits(), SlidingWindow(9, 0))] == ["no_new_data"]


def test_source_by_batches_of_tickers(spark):
    """One ticker fails, one has nothing new, and the job goes on; partitions are the workers that the limit has calls for."""

    def fetch(ticker, start, page):
        if ticker == "T3":
            raise RuntimeError("no such ticker")
        if ticker == "T4" or page == 2:
            return []
        return [(datetime(2020, 1, 1 + 2 * page + i), 1.0, 2.0, 0.5, float(page), None) for i in range(2) if str(datetime(2020, 1, 1 + 2 * page + i))[:10] >= start]

    plan = spark.createDataFrame([(f"T{i}", "2020-01-02") for i in range(10)] + [(None, "2020-01-02"), ("T1", "2020-01-02")], "ticker string, fetch_start string")
    rows = fetch_bars(spark, plan.withColumn("fetch_start", F.to_date("fetch_start")), fetch, Limits(calls=300, workers=4, tries=2, wait=0.01))
    assert rows.rdd.getNumPartitions() == 4
    kept = rows.collect()
    status = {r["ticker"]: r["status"] for r in kept if r["status"]}
    assert status == {f"T{i}": {3: "fetch_failed", 4: "no_new_data"}.get(i, "fetched") for i in range(10)}
    assert bars_in(rows).groupBy("ticker").count().collect() and {r["count"] for r in bars_in(rows).groupBy("ticker").count().collect()} == {3}
    assert status_in(rows).filter("status = 'fetch_failed'").first()["error"] == "RuntimeError: no such ticker"
    plan = plan.dropna().distinct().withColumns({"exchange": F.lit("X"), "status": F.lit("full_load"), "total_rows": F.lit(0)})
    results = {r["ticker"]: r["status"] for r in B.load_results(plan, bars_in(rows)).collect()}
    assert results["T3"] == "fetch_failed" and results["T1"] == "full_load"


def test_no_tickers(spark):
    plan = spark.createDataFrame([], "ticker string, fetch_start string")
    assert fetch_bars(spark, plan, lambda *_: None).count() == 0
