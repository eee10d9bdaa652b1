"""Sinks: bars, audit log, the screened universe, features, snapshot and tracker, all but the log as versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barloom.operators.quality import snapshot
from barloom.operators.tracking import in_order
from barloom.sources import months
from barloom.sources.bars import PRICES, first_of
from barloom.sources.folders import exists
from barloom.sources.versions import WHOLE, Version, VersionedTable

BOM = "\ufeff"
REASONS = ["passed", "penny_stock", "low_liquidity", "low_trading_continuity", "insufficient_history"]
STATUSES = ["full_load", "delta_updated", "no_new_data", "fetch_failed", "not_attempted"]


def count_of(column: str, values: list[str]) -> list[Column]:
    """Counts of rows, and of those with each value, to be taken while rows are written."""
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(column) == v).alias(v) for v in values]]


def write_bars(bars: DataFrame, path: str) -> Version:
    """Bars sorted by ticker within months, one of each time, in place of what was there."""
    table = VersionedTable(bars.sparkSession, path)
    base, once = table.version(), first_of(bars, ["ticker", "time"], ["close", "open", "high", "low", "volume"])
    return table.commit((base.parts if base else {}) | {"": months.written(table, once)}, "replace", base)


def append_log(summary: DataFrame, path: str, day: str) -> dict[str, int]:
    """A load's summary, marked with its day, added to the log; earlier rows aren't rewritten. Gives its counts by status, taken on the way."""
    seen = Observation()
    summary.withColumn("run_date", F.lit(day).cast("date")).observe(seen, *count_of("status", STATUSES)).write.mode("append").parquet(path)
    return dict(seen.get)


def save_universe(bars: DataFrame, screened: DataFrame, folder: str) -> Version:
    """The bars of tickers that passed, without metrics, and a row of reasons for each that didn't, as one version.

    Screens are taken once and written; both parts read that. The version's counts, of tickers by reason and of bars,
    are taken while parts are written. Bars stay where the join by ticker has them, so a clustered table's aren't dealt anew.
    """
    table = VersionedTable(bars.sparkSession, folder)
    base, tickers, kept = table.version(), Observation(), Observation()
    of = table.write(screened.observe(tickers, *count_of("rejection_reason", REASONS)))
    known = table.load(of)
    passed = bars.join(known.filter("rejection_reason = 'passed'").select("ticker").hint("merge"), "ticker", "left_semi")
    passed = passed.select("ticker", "time", *PRICES, "volume").sortWithinPartitions("ticker", "time")
    parts = {"universe_filtered": table.write(passed.observe(kept, F.count(F.lit(1)).alias("bars"))), "rejected_tickers": table.write(known.filter("rejection_reason <> 'passed'"))}
    return table.commit((base.parts if base else {}) | parts, "screen", base, counts={**tickers.get, **kept.get})


def merge_features(new: DataFrame, path: str) -> Version:
    """New feature rows in place of a ticker's old ones from its first new bar on; months without either keep their files."""
    return months.merge(VersionedTable(new.sparkSession, path), new)


def save_snapshot(features: DataFrame, path: str) -> Version:
    return VersionedTable(features.sparkSession, path).replace(snapshot(features))


def save_tracker(tracker: DataFrame, folder: str) -> Version:
    """The tracker as parquet, and as CSV parts with semicolons and a byte order mark, as spreadsheets expect; one version has both."""
    table = VersionedTable(tracker.sparkSession, folder)
    base, of = table.version(), table.write(tracker)
    saved = in_order(table.load(of))
    sheet = table.write(saved.withColumnRenamed(saved.columns[0], BOM + saved.columns[0]), format="csv", sep=";", header="true")
    return table.commit({"tracker": of, "sheet": sheet}, "save", base)


def read_tracker(spark: SparkSession, folder: str, sep: str = ";") -> DataFrame:
    """The tracker's sheet, all columns text, a byte order mark taken off; its parquet if that has no ``signal_date``.

    A ``tracker.csv`` beside the versions, as people put it there, goes first.
    """
    table = VersionedTable(spark, folder)
    saved = table.version()
    file = f"{folder}/tracker.csv" if exists(spark, f"{folder}/tracker.csv") else f"{folder}/{saved.parts['sheet'].folders[WHOLE]}"
    rows = spark.read.options(sep=sep, header=True).csv(file)
    rows = rows.toDF(*[c.removeprefix(BOM) for c in rows.columns])
    return rows if "signal_date" in rows.columns else table.read("tracker")


def typed_tracker(rows: DataFrame) -> DataFrame:
    """A tracker's text columns as dates and numbers; what isn't one is null."""
    numbers = [c for c in ("score", "entry_price", "STOP_LOSS", "TARGET_1", "TARGET_2", "current_price", "return_pct", "exit_price") if c in rows.columns]
    dates = [c for c in ("signal_date", "last_updated", "exit_date") if c in rows.columns]
    return rows.withColumns({**{c: F.expr(f"try_cast(`{c}` as double)") for c in numbers}, **{c: F.expr(f"try_cast(`{c}` as date)") for c in dates}})
