"""Fetching bars by ticker: a Spark source with a partition for each batch of tickers, retries, and a limit on calls."""

from __future__ import annotations

import json
import sys
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

register_pickle_by_value(sys.modules[__name__])  # executors needn't have the package

BAR = "ticker string, time timestamp_ntz, open double, high double, low double, close double, volume long"
SCHEMA = f"{BAR}, status string, attempts int, error string"
#: One page of a ticker's bars from a day on, as ``(time, open, high, low, close, volume)``; None or nothing after the last page.
Fetch = Callable[[str, str, int], Iterable[tuple] | None]


class SlidingWindow:
    """At most ``calls`` calls begin within any ``seconds``: the times of the last ones are kept, and a call waits for the oldest to pass."""

    def __init__(self, calls: int, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if calls < 1 or seconds < 0:
            raise ValueError("a limit is at least one call in some time")
        self.calls, self.seconds, self.clock, self.sleep = calls, seconds, clock, sleep
        self.times: deque[float] = deque()

    def acquire(self) -> None:
        while True:
            now = self.clock()
            while self.times and now - self.times[0] >= self.seconds:
                self.times.popleft()
            if len(self.times) < self.calls:
                self.times.append(now)
                return
            self.sleep(max(0.001, self.seconds - (now - self.times[0])))  # a rest too small to move the clock would never end


@dataclass(frozen=True)
class Limits:
    """``calls`` in any ``seconds``, over all ``workers`` together; ``tries`` of a call, waiting ``wait`` seconds, twice that and so on up to ``longest``."""

    calls: int = 10
    seconds: float = 1.0
    workers: int = 8
    tries: int = 5
    wait: float = 2.0
    longest: float = 60.0

    def share(self) -> tuple[int, int]:
        """Workers, and each one's calls in the time: fewer workers if there aren't calls for all, so their sum keeps the limit."""
        workers = max(1, min(self.workers, self.calls))
        return workers, self.calls // workers


def attempted(fetch: Fetch, ticker: str, start: str, page: int, limits: Limits, window: SlidingWindow) -> tuple[list[tuple] | None, int]:
    """A page, and how many calls it took; the last error if all fail."""
    for n in range(1, limits.tries + 1):
        window.acquire()
        try:
            rows = fetch(ticker, start, page)
            return (None if rows is None else list(rows)), n
        except Exception:
            if n == limits.tries:
                raise
            window.sleep(min(limits.longest, limits.wait * 2 ** (n - 1)))
    raise ValueError("at least one try")


def fetched(fetch: Fetch, ticker: str, start: str, limits: Limits, window: SlidingWindow) -> Iterator[tuple]:
    """A ticker's bars page by page, and a row with its status behind them.

    A ticker that fails gives its status and error and no bars, also of pages that came before, as a load has a ticker whole or not.
    """
    bars, attempts, page = [], 0, 0
    try:
        while True:
            rows, n = attempted(fetch, ticker, start, page, limits, window)
            attempts += n
            if not rows:
                break
            bars += [(ticker, *r, None, None, None) for r in rows]
            page += 1
    except Exception as error:
        yield (ticker, *[None] * 6, "fetch_failed", attempts + limits.tries, f"{type(error).__name__}: {error}"[:500])
        return
    yield from bars
    yield (ticker, *[None] * 6, "fetched" if bars else "no_new_data", attempts, None)


class Batch(InputPartition):
    def __init__(self, tickers: list[tuple[str, str]]):
        super().__init__(tickers)
        self.tickers = tickers


def source_of(fetch: Fetch, limits: Limits, source: str) -> type[DataSource]:
    """A data source that fetches the tickers in its option ``plan``, a JSON list of tickers and their first days."""

    class Reader(DataSourceReader):
        def __init__(self, plan: list[tuple[str, str]]):
            self.plan = plan

        def partitions(self) -> list[InputPartition]:
            workers = min(limits.share()[0], max(1, len(self.plan)))
            return [Batch(self.plan[n::workers]) for n in range(workers)]

        def read(self, partition: Batch) -> Iterator[tuple]:
            window = SlidingWindow(limits.share()[1], limits.seconds)
            for ticker, start in partition.tickers:
                yield from fetched(fetch, ticker, start, limits, window)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader([tuple(x) for x in json.loads(self.options["plan"])])

    return Pages


def fetch_bars(spark: SparkSession, plan: DataFrame, fetch: Fetch, limits: Limits = Limits(), source: str = "barpages") -> DataFrame:  # noqa: B008
    """What ``fetch`` gives for the tickers of a load plan from their ``fetch_start`` on: bars, and a status row for each ticker.

    There is a partition for each worker, each with its share of the calls, so the limit holds for all together as long as a
    partition is read once at a time. The plan comes to the driver, as it says what to ask of others: a row for each ticker. A ticker without
    name isn't asked for. Write the result before it is read more than once, as each reading fetches again.
    """
    rows = plan.filter("ticker is not null").select("ticker", F.col("fetch_start").cast("string")).distinct().orderBy("ticker").collect()
    spark.dataSource.register(source_of(fetch, limits, source))
    return spark.read.format(source).option("plan", json.dumps([tuple(r) for r in rows])).load()


def bars_in(rows: DataFrame) -> DataFrame:
    return rows.filter("status is null").select([f.split()[0] for f in BAR.split(", ")])


def status_in(rows: DataFrame) -> DataFrame:
    """``ticker, status, attempts, error`` of each ticker that was tried."""
    return rows.filter("status is not null").select("ticker", "status", "attempts", "error")


def pages_in(uri: str) -> Fetch:
    """Pages as JSON files ``URI/ticker=T/*.json`` in any store that Arrow opens, in order of name; no folder of a ticker is an error."""

    def fetch(ticker: str, start: str, page: int) -> list[tuple] | None:
        from datetime import datetime
        from urllib.parse import quote

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        found = store.get_file_info(fs.FileSelector(f"{root}/ticker={quote(ticker, safe=' ')}"))
        names = sorted(f.path for f in found if f.path.endswith(".json"))
        if page >= len(names):
            return None
        with store.open_input_stream(names[page]) as file:
            rows = [json.loads(line) for line in file.read().decode().splitlines()]
        bars = [(datetime.fromisoformat(r["time"]).replace(tzinfo=None), *[r.get(c) for c in ("open", "high", "low", "close")], r.get("volume")) for r in rows]
        return [b for b in bars if str(b[0])[:10] >= start]

    return fetch
