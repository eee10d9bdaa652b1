"""Indicators of bars as they come, from a state for each ticker that doesn't grow.

Exponential means, directional movement and market structure are recursions, so a few numbers carry them on; moving averages need the
last closes. Columns equal those of ``barloom.operators.indicators`` over all bars.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.sources import months
from barloom.sources.versions import VersionedTable
from barloom.streaming.bars import arrivals

register_pickle_by_value(sys.modules[__name__])  # executors needn't have the package
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEANS = (20, 50, 200)
#: Numbers of a ticker's state: the last two bars, running means, and the structure's swings, breaks and trend.
NUMBERS = ["close", "high", "low", "high_before", "low_before", "e12", "e26", "signal", "up", "down", "atr", "plus", "minus", "adx", "last_h", "prev_h", "last_l", "prev_l"]
PLACES = ["n", "at_h", "at_l", "hit_h", "hit_l", "trend", "late"]
STATE = "time timestamp_ntz, closes array<double>, " + ", ".join([*[f"{c} double" for c in NUMBERS], *[f"{c} long" for c in PLACES]])
COLUMNS = {
    "double": [*[f"MA_{n}" for n in MEANS], "EMA_12", "EMA_26", "MACD_12_26_9", "MACD_SIGNAL_9", "MACD_HIST", "RSI_14", "ATR_14", "DI_PLUS_14", "DI_MINUS_14", "ADX_14"],
    "boolean": ["BOS_BULL", "CHOCH_BULL", "BOS_BEAR", "CHOCH_BEAR"],
}
OUTPUT = "ticker string, time timestamp_ntz, close double, " + ", ".join(f"{c} {kind}" for kind, names in COLUMNS.items() for c in names)


def mean(old: float | None, x: float, alpha: float) -> float:
    return x if old is None else old + alpha * (x - old)


def share(part: float, whole: float) -> float:
    return 100 * part / whole if whole else 0.0


class Ticker:
    """A ticker's state, and what one more bar makes of it."""

    def __init__(self, state: dict | None = None):
        self.time, self.closes = (state["time"], list(state["closes"])) if state else (None, [])
        for c in NUMBERS:
            setattr(self, c, state[c] if state else None)
        for c in PLACES:
            setattr(self, c, state[c] if state else 0)

    def row(self) -> tuple:
        return (self.time, self.closes, *[getattr(self, c) for c in [*NUMBERS, *PLACES]])

    def add(self, time, high: float, low: float, close: float) -> list:
        self.n += 1
        means = self.averages(close)
        exponentials = self.exponentials(close)
        strength = self.strength(close)
        movement = self.movement(high, low)
        breaks = self.structure(high, low)
        self.high_before, self.low_before = self.high, self.low
        self.time, self.high, self.low, self.close = time, high, low, close
        return [time, close, *means, *exponentials, strength, *movement, *breaks]

    def averages(self, close: float) -> list[float | None]:
        self.closes = [*self.closes, close][-max(MEANS) :]
        return [sum(self.closes[-n:]) / n if len(self.closes) >= n else None for n in MEANS]

    def exponentials(self, close: float) -> list[float | None]:
        self.e12, self.e26 = mean(self.e12, close, 2 / 13), mean(self.e26, close, 2 / 27)
        if self.n < 26:
            return [self.e12 if self.n >= 12 else None, None, None, None, None]
        macd = self.e12 - self.e26
        self.signal = mean(self.signal, macd, 0.2)
        known = self.n >= 34
        return [self.e12, self.e26, macd, self.signal if known else None, macd - self.signal if known else None]

    def strength(self, close: float) -> float | None:
        if self.n == 1:
            return None
        change = close - self.close
        self.up, self.down = mean(self.up, max(change, 0.0), 1 / 14), mean(self.down, max(-change, 0.0), 1 / 14)
        if self.n < 15:
            return None
        return 100 * self.up / (self.up + self.down) if self.up + self.down else 50.0

    def movement(self, high: float, low: float) -> list[float]:
        spread, plus, minus = high - low, 0.0, 0.0
        if self.n > 1:
            spread = max(spread, abs(high - self.close), abs(low - self.close))
            up, down = high - self.high, self.low - low
            plus, minus = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)
        self.atr, self.plus, self.minus = mean(self.atr, spread, 1 / 14), mean(self.plus, plus, 1 / 14), mean(self.minus, minus, 1 / 14)
        a, b = share(self.plus, self.atr), share(self.minus, self.atr)
        self.adx = mean(self.adx, share(abs(a - b), a + b), 1 / 14)
        return [self.atr, a, b, self.adx]

    def structure(self, high: float, low: float) -> list[bool]:
        """Breaks of the last swings; a swing counts on the bar after it, when that bar shows that it was one."""
        top = self.n > 2 and self.high > self.high_before and self.high > high
        bottom = self.n > 2 and self.low < self.low_before and self.low < low
        if top:
            self.prev_h, self.last_h, self.at_h = self.last_h, self.high, self.n
            self.turn()
        if bottom:
            self.prev_l, self.last_l, self.at_l = self.last_l, self.low, self.n
            self.turn()
        above, below = self.last_h is not None and high > self.last_h, self.last_l is not None and low < self.last_l
        up, down = above and self.hit_h < self.at_h, below and self.hit_l < self.at_l
        self.hit_h, self.hit_l = self.n if above else self.hit_h, self.n if below else self.hit_l
        return [up and self.trend >= 0, up and self.trend < 0, down and self.trend <= 0, down and self.trend > 0]

    def turn(self) -> None:
        if None not in (self.prev_h, self.prev_l):
            if self.last_h > self.prev_h and self.last_l > self.prev_l:
                self.trend = 1
            elif self.last_h < self.prev_h and self.last_l < self.prev_l:
                self.trend = -1


class Indicators(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ticker", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = ["time", "closes", *NUMBERS, *PLACES]
        old = self.state.get() if self.state.exists() else None
        ticker, out = Ticker(dict(zip(names, old, strict=True)) if old is not None else None), []
        for r in pd.concat(list(rows)).sort_values("time", kind="stable").itertuples():
            if ticker.time is not None and pd.Timestamp(r.time) <= pd.Timestamp(ticker.time):
                ticker.late += 1
            else:
                out.append([key[0], *ticker.add(r.time.to_pydatetime(), float(r.high), float(r.low), float(r.close))])
        self.state.update(ticker.row())
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def indicators(bars: DataFrame) -> DataFrame:
    """Indicator columns of a stream of bars, a row for each bar that comes after its ticker's last one.

    A bar that isn't later, of a time that was seen or skipped, is left out, as the state doesn't hold what is needed to go back: load
    corrections into the table of bars and derive again. Bars without time, high, low or close are left out as well.
    """
    sound = bars.dropna(subset=["ticker", "time", "high", "low", "close"]).select("ticker", "time", "high", "low", "close")
    return sound.groupBy("ticker").transformWithStateInPandas(Indicators(), OUTPUT, "Append", "None")


def indicators_available(spark: SparkSession, folder: str, path: str, checkpoint: str, files: int | None = None) -> int:
    """Add the indicators of all bars that came into ``folder`` since the last run to the table at ``path``; how many batches there were.

    A repeated batch changes nothing, and its state is that of the batch before, so a run that died goes on without a gap.
    """
    key, done = "spark.sql.streaming.stateStore.providerClass", []
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)

    def step(rows: DataFrame, batch: int) -> None:
        months.upsert(VersionedTable(spark, path), rows, "indicators", batch)
        done.append(batch)

    try:
        stream = indicators(arrivals(spark, folder, files).drop("_seen", "_file"))
        query = stream.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return len(done)
