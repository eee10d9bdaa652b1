"""Non-overlapping trades, their metrics, and the choice of strategies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import bars_window, lead
from barloom.operators.strategies import SIGNALS

COST, RATE = 0.0025, 0.045


def trades(rows: DataFrame, strategies: list[str] = SIGNALS, holds: tuple[int, ...] = (5, 10, 20), by: list[str] | None = None) -> DataFrame:
    """``strategy, holding_days, ticker, idx, time, ret``: bought at the next open, sold ``hold`` bars on.

    A candidate needs both prices above 0. In bar order one is taken if it comes at least ``hold`` bars after the
    last one taken: a fold over a ticker's signals, which are few next to its bars. All pairs of
    strategy and hold come from one pass. ``by`` adds columns, such as a year, that restart the bars.
    """
    by = by or []
    over = Window.partitionBy("ticker", *by).orderBy("time") if by else bars_window()
    rows = rows.withColumns({"idx": F.row_number().over(over) - 1, "_entry": F.lead("open", 1).over(over), **{f"_exit{h}": F.lead("open", h + 1).over(over) for h in holds}})
    fired = F.filter(F.array(*[F.when(F.col(s), F.lit(s)) for s in strategies]), lambda x: x.isNotNull())
    fired = rows.filter(F.size(fired) > 0).withColumn("strategy", F.explode(fired))
    exits = F.array(*[F.struct(F.lit(h).alias("hold"), F.col(f"_exit{h}").alias("price")) for h in holds])
    picks = fired.select("ticker", *by, "strategy", "idx", "time", "_entry", F.explode(exits).alias("x")).filter("_entry > 0 and x.price > 0")
    picks = picks.select("ticker", *by, "strategy", F.col("x.hold").alias("holding_days"), F.struct("idx", "time", (F.col("x.price") / F.col("_entry") - 1 - 2 * COST).alias("ret")).alias("pick"))
    sets = picks.groupBy("ticker", *by, "strategy", "holding_days").agg(F.array_sort(F.collect_list("pick")).alias("picks"))
    kind = sets.schema["picks"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast(kind).alias("kept"))
    taken = F.aggregate("picks", start, lambda a, x: F.when(a["last"].isNull() | (x["idx"] >= a["last"] + F.col("holding_days")), F.struct(x["idx"].alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return sets.select("ticker", *by, "strategy", "holding_days", F.explode(taken).alias("t")).select("strategy", "holding_days", "ticker", *by, "t.idx", "t.time", "t.ret")


def drawdowns(done: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Equity and drawdown after each trade, in order of ticker and bar, from the first trade's equity.

    Sums of logs in two levels: over a ticker's trades, and over the tickers' totals, so no task gets all trades of a
    strategy and nothing over- or underflows. A trade that loses everything counts as a factor of 1e-12.
    """
    keys = ["strategy", "holding_days", *(by or [])]
    mine = Window.partitionBy(*keys, "ticker").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    rows = done.withColumn("_log", F.sum(F.log(F.greatest(1 + F.col("ret"), F.lit(1e-12)))).over(mine)).withColumn("_top", F.max("_log").over(mine))
    totals = rows.groupBy(*keys, "ticker").agg(F.max_by("_log", "time").alias("_sum"), F.max("_log").alias("_most"))
    before = Window.partitionBy(*keys).orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0.0))).withColumn("_high", F.max(F.col("_start") + F.col("_most")).over(before))
    rows = rows.join(totals.drop("_sum", "_most"), [*keys, "ticker"])
    level = F.col("_start") + F.col("_log")
    top = F.greatest(F.col("_start") + F.col("_top"), F.col("_high"))
    return rows.withColumns({"equity": F.exp(level), "drawdown": F.exp(level - top) - 1}).select(*done.columns, "equity", "drawdown")


def metrics(done: DataFrame, by: list[str] | None = None, least: int = 5) -> DataFrame:
    """Figures of each strategy and hold, and ``by``, with at least ``least`` trades.

    The trades are read once: a ticker's trades become one row of sums, and of logs of its equity. The deepest fall within a
    ticker is known there; below the highest equity of the tickers before, it's that of the ticker's lowest point.
    """
    keys = ["strategy", "holding_days", *(by or [])]
    mine = Window.partitionBy(*keys, "ticker").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    rows = done.withColumn("_log", F.sum(F.log(F.greatest(1 + F.col("ret"), F.lit(1e-12)))).over(mine)).withColumn("_top", F.max("_log").over(mine))
    gain, loss = F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0), F.when(F.col("ret") < 0, F.col("ret")).otherwise(0.0)
    per = rows.groupBy(*keys, "ticker").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("ret") > 0).cast("double")).alias("_wins"), F.sum("ret").alias("_ret"), (F.var_pop("ret") * F.count(F.lit(1))).alias("_spread"), F.sum(gain).alias("_gain"), F.sum(loss).alias("_loss"),
        F.max_by("_log", "time").alias("_sum"), F.max("_log").alias("_most"), F.min("_log").alias("_lowest"), F.min(F.col("_log") - F.col("_top")).alias("_fall"),
    )
    before = Window.partitionBy(*keys).orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0.0))).withColumn("_high", F.max(F.col("_start") + F.col("_most")).over(before))
    worst = F.min(F.least("_fall", F.col("_start") + F.col("_lowest") - F.col("_high")))
    n, total, gains, losses = F.sum("_n"), F.sum("_ret"), F.sum("_gain"), F.abs(F.sum("_loss"))
    spread = F.sum("_spread") + F.greatest(F.lit(0.0), F.sum(F.col("_ret") * F.col("_ret") / F.col("_n")) - total * total / n)
    dev, free = F.when(n > 1, F.sqrt(spread / (n - 1))), RATE * F.first("holding_days") / 252
    return per.groupBy(*keys).agg(
        n.alias("n_trades"),
        (F.sum("_wins") / n * 100).alias("win_rate"),
        (total / n * 100).alias("avg_return"),
        F.when(losses == 0, 999.0).otherwise(gains / F.nullif(losses, F.lit(0.0))).alias("profit_factor"),
        (F.abs(F.exp(worst) - 1) * 100).alias("max_drawdown"),
        F.when(dev == 0, 0.0).otherwise((total / n - free) / F.nullif(dev, F.lit(0.0)) * F.sqrt(F.lit(252) / F.first("holding_days"))).alias("sharpe_ratio"),
    ).filter(F.col("n_trades") >= least)


def by_year(rows: DataFrame, strategy: str, hold: int, years: tuple[int, int] = (2016, 2026)) -> DataFrame:
    """A row for every year; bars are cut to the year before trades are made."""
    spark = rows.sparkSession
    done = trades(rows.withColumn("year", F.year("time")), [strategy], (hold,), ["year"])
    found = metrics(done.withColumn("strategy", F.col("year").cast("string")), ["year"], 1).drop("strategy", "holding_days")
    each = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"))
    return each.join(found, "year", "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))


@dataclass(frozen=True)
class Accept:
    """What a result must pass: win rate and profit factor above, drawdown under, and trades at least."""

    win_rate: float
    profit_factor: float
    max_drawdown: float
    n_trades: int


USUAL, RARE = Accept(51, 1.2, 40, 50), Accept(60, 2, 20, 10)


def best_strategies(results: DataFrame, accept: tuple[Accept, ...] = (USUAL, RARE)) -> DataFrame:
    """Of the results that pass one of ``accept``, the row of the best Sharpe ratio of each strategy."""
    c = F.col
    passes = [(c("win_rate") > a.win_rate) & (c("profit_factor") > a.profit_factor) & (c("max_drawdown") < a.max_drawdown) & (c("n_trades") >= a.n_trades) for a in accept]
    best = Window.partitionBy("strategy").orderBy(F.desc("sharpe_ratio"), "holding_days")
    return results.filter(reduce(or_, passes)).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def ranked(results: DataFrame) -> DataFrame:
    """Results from the best Sharpe ratio down, then by win rate."""
    return results.orderBy(F.desc_nulls_last("sharpe_ratio"), F.desc_nulls_last("win_rate"), "strategy", "holding_days")
