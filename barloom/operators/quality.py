"""Liquidity metrics and the screens of the universe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import rolling


@dataclass(frozen=True)
class Screens:
    close: float = 5_000.0
    value: float = 5e9
    bars: int = 252
    continuity: float = 0.75
    days: int = 90


def liquidity(bars: DataFrame) -> DataFrame:
    value = F.col("close") * F.col("volume")
    return bars.withColumns({"trading_value": value, "avg_value_20d": rolling(F.avg, value, 20, 10), "avg_volume_20d": rolling(F.avg, F.col("volume"), 20, 10)})


def last_known(column: str):
    """The last non-null value by time."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("time"))).alias(column)


def screen(bars: DataFrame, s: Screens = Screens()) -> DataFrame:  # noqa: B008
    """One row per ticker with its metrics and the first screen it fails, ``passed`` if none."""
    metrics = liquidity(bars)
    latest = bars.agg(F.date_sub(F.max("time"), s.days).alias("cutoff"))
    recent = metrics.crossJoin(F.broadcast(latest))  # one row
    days = bars.select("time").distinct().crossJoin(F.broadcast(latest))  # by time alone: no windows, no rows of tickers
    expected = days.agg(F.count(F.when(F.col("time") >= F.col("cutoff"), F.col("time"))).alias("expected"))
    per = recent.groupBy("ticker").agg(last_known("close").alias("last_close"), last_known("avg_value_20d"), F.count("time").alias("n_bars"), F.count(F.when(F.col("time") >= F.col("cutoff"), 1)).alias("recent_active_days"))
    reason = (
        F.when(~F.coalesce(F.col("last_close") >= s.close, F.lit(False)), "penny_stock")
        .when(~F.coalesce(F.col("avg_value_20d") >= s.value, F.lit(False)), "low_liquidity")
        .when(F.col("recent_active_days") < F.floor(F.col("expected") * s.continuity), "low_trading_continuity")
        .when(F.col("n_bars") < s.bars, "insufficient_history")
        .otherwise("passed")
    )
    return per.crossJoin(F.broadcast(expected)).withColumn("rejection_reason", reason).drop("expected")


def passed_bars(bars: DataFrame, screened: DataFrame) -> DataFrame:
    return bars.join(screened.filter("rejection_reason = 'passed'").select("ticker"), "ticker", "left_semi")


def snapshot(features: DataFrame) -> DataFrame:
    """One row per ticker: each column's last non-null value."""
    return features.groupBy("ticker").agg(F.max("time").alias("time"), *[last_known(c) for c in features.columns if c not in ("ticker", "time")])


def freshness(bars: DataFrame, day: str) -> DataFrame:
    last = bars.groupBy("ticker").agg(F.max("time").alias("last"))
    return last.agg(F.count_if(F.col("last") >= F.lit(day)).alias("fresh"), F.count_if(F.col("last") < F.lit(day)).alias("stale"), F.max("last").alias("newest"))


def recent_activity(bars: DataFrame, days: int = 90) -> DataFrame:
    """Per ticker, its bars of the last ``days`` days of the market, 0 if none, and the market's days in that time."""
    cut = bars.agg(F.date_sub(F.max("time"), days).alias("cutoff"))
    recent = bars.crossJoin(F.broadcast(cut))  # one row
    market = recent.agg(F.count_distinct(F.when(F.col("time") >= F.col("cutoff"), F.col("time"))).alias("market_days"))
    return recent.groupBy("ticker").agg(F.count(F.when(F.col("time") >= F.col("cutoff"), 1)).alias("recent_active_days")).crossJoin(F.broadcast(market))


def universe_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count_distinct("ticker").alias("tickers"), F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def null_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``name, null_share`` of each column, from one pass."""
    one = rows.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("null_share")) for c in columns])).alias("x")).select("x.*")


def commonest_last_day(bars: DataFrame) -> DataFrame:
    """The day on which most tickers' bars end, the earliest of ties, and how many do."""
    last = bars.groupBy("ticker").agg(F.to_date(F.max("time")).alias("last_day"))
    return last.groupBy("last_day").agg(F.count(F.lit(1)).alias("tickers")).orderBy(F.desc("tickers"), "last_day").limit(1)
