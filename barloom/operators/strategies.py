"""Five boolean strategies, the market regime and its gates, score, levels, sizes and the capped top list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import lag, rolling
from barloom.operators.indicators import adx

SIGNALS = ["SIG_SMC", "SIG_ICHIMOKU", "SIG_MOMENTUM", "SIG_GOLDEN", "SIG_OB"]


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


@dataclass(frozen=True)
class Rules:
    """Levels of the strategies' conditions."""

    smc_rsi: float = 40.0
    cloud_adx: float = 25.0
    momentum_rsi: tuple[float, float] = (50.0, 70.0)
    golden_adx: float = 20.0
    block_rsi: float = 45.0


def signals(features: DataFrame, confirm_lag: int = 0, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Add the five signals. ``confirm_lag`` 3 reads order blocks only when their bars are over; 0 looks ahead."""
    c = F.col
    block = _true(lag("OB_BULL", confirm_lag)) if confirm_lag else c("OB_BULL")
    block_low = lag("OB_LOW", 1 + confirm_lag)
    rising = c("MACD_HIST") > lag("MACD_HIST")
    above = (c("close") > c("SENKOU_A")) & (c("close") > c("SENKOU_B"))
    crossed = (c("MA_50") > c("MA_200")) & (lag("MA_50") <= lag("MA_200"))
    low, high = rules.momentum_rsi
    return features.withColumns({
        "SIG_SMC": _true(c("CHOCH_BULL") & (block | _true(c("close") <= c("BB_LOWER_20"))) & (c("RSI_14") < rules.smc_rsi) & rising),
        "SIG_ICHIMOKU": _true(above & (c("TENKAN_9") > c("KIJUN_26")) & c("BOS_BULL") & (c("ADX_14") > rules.cloud_adx)),
        "SIG_MOMENTUM": _true((c("close") > c("MA_20")) & (c("MA_20") > c("MA_50")) & (c("RSI_14") > low) & (c("RSI_14") < high) & (c("MACD_12_26_9") > c("MACD_SIGNAL_9")) & (c("MACD_HIST") > 0) & rising & c("BOS_BULL")),
        "SIG_GOLDEN": _true(crossed & above & (c("ADX_14") > rules.golden_adx) & (c("volume") > rolling(F.avg, c("volume"), 20, 10))),
        "SIG_OB": _true((block | _true((c("low") <= block_low) & (block_low < c("close")))) & (c("RSI_14") < rules.block_rsi) & (c("DI_PLUS_14") > c("DI_MINUS_14")) & (c("close") > c("KIJUN_26"))),
    })


def market_regime(index: DataFrame) -> DataFrame:
    rows = adx(index.withColumn("ma200", rolling(F.avg, F.col("close"), 200, 50)))
    regime = (
        F.when(F.col("ma200").isNull(), "UNKNOWN")
        .when(F.col("close") <= F.col("ma200"), "BEAR")
        .when(F.col("ADX_14").isNull() | (F.col("ADX_14") <= 20), "SIDEWAY")
        .otherwise("BULL")
    )
    return rows.select(F.to_date("time").alias("date"), F.col("close").alias("index_close"), F.col("ma200").alias("index_ma200"), F.col("ADX_14").alias("index_adx"), regime.alias("regime"))


def with_regime(rows: DataFrame, regime: DataFrame) -> DataFrame:
    """The regime of each row's date, UNKNOWN if there is none; one row a trading day, so it is small."""
    days = regime.select(F.col("date").alias("_date"), "regime")
    return rows.join(days, F.to_date("time") == F.col("_date"), "left").drop("_date").withColumn("regime", F.coalesce("regime", F.lit("UNKNOWN")))


def gate_history(rows: DataFrame) -> DataFrame:
    bear = F.col("regime") == "BEAR"
    return rows.withColumns({"SIG_GOLDEN": F.col("SIG_GOLDEN") & (F.col("regime") == "BULL"), "SIG_ICHIMOKU": F.col("SIG_ICHIMOKU") & ~bear, "SIG_SMC": F.col("SIG_SMC") & ~bear})


def today(regime: DataFrame) -> DataFrame:
    """One row: the regime of the last day known."""
    return regime.agg(F.max_by("regime", "date").alias("_today"))


def regime_counts(regime: DataFrame, days: int = 20) -> DataFrame:
    """How many of the last ``days`` rows are in each regime."""
    return regime.orderBy(F.desc("date")).limit(days).groupBy("regime").agg(F.count(F.lit(1)).alias("n"))


#: Regimes of a day in which a strategy is off on that day.
OFF = {"SIG_GOLDEN": ["BEAR", "SIDEWAY"], "SIG_ICHIMOKU": ["BEAR", "SIDEWAY"], "SIG_SMC": ["BEAR"], "SIG_OB": ["BEAR", "SIDEWAY"]}


def gate_each(rows: DataFrame) -> DataFrame:
    """Each row's signals as the day's list takes them, by the row's own ``regime``: nothing but momentum in a BEAR market; no golden cross, cloud or order block in a SIDEWAY one."""
    return rows.withColumns({s: F.col(s) & ~_true(F.col("regime").isin(v)) for s, v in OFF.items()})


def gate_today(rows: DataFrame, regime: DataFrame) -> DataFrame:
    """Rows gated by the last regime known, as in ``gate_each``."""
    rows = rows.drop("regime").crossJoin(F.broadcast(today(regime)))  # one row
    return gate_each(rows.withColumn("regime", F.coalesce("_today", F.lit("UNKNOWN"))).drop("_today"))


def latest(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(rows.agg(F.max("time").alias("time"))), "time", "left_semi")  # one row


def score(rows: DataFrame) -> DataFrame:
    def points(x: Column, n: float) -> Column:
        return F.when(_true(x), F.lit(n)).otherwise(F.lit(0.0))

    c = F.col
    total = points(c("SIG_GOLDEN"), 2.0) + points(c("SIG_ICHIMOKU"), 1.5) + points(c("SIG_SMC"), 0.5) + points(c("ADX_14") > 30, 0.5) + points(c("RSI_14").between(40, 60), 0.3)
    total = total - points(c("close") < c("MA_200"), 1.0) - points(c("RSI_14") > 75, 0.5) - points(c("regime") == "BEAR", 2.0)
    fired = F.concat_ws(", ", F.when(c("SIG_GOLDEN"), "GOLDEN_CROSS"), F.when(c("SIG_ICHIMOKU"), "ICHIMOKU_TREND"), F.when(c("SIG_SMC"), "SMC_REVERSAL"))
    return rows.withColumns({"score": F.round(total, 4), "signals_fired": F.coalesce(F.nullif(fired, F.lit("")), F.lit("-"))})


def selected(rows: DataFrame) -> DataFrame:
    """Rows of a positive score on which one of the three trusted strategies fired."""
    return rows.filter((_true(F.col("SIG_GOLDEN")) | _true(F.col("SIG_ICHIMOKU")) | _true(F.col("SIG_SMC"))) & (F.col("score") > 0))


def top_list(rows: DataFrame, regime: DataFrame, sectors: DataFrame, capital: float = 1e9, cap: int = 2, limit: int = 10) -> DataFrame:
    """From signals to the day's list: the last day's rows, today's gate, score, levels, sector, choice and sizes."""
    scored = risk_levels(score(gate_today(latest(rows), regime)))
    return position_size(capped_top(with_sector(selected(scored), sectors), cap, limit), capital)


def risk_levels(rows: DataFrame, stop: float = 2, targets: tuple[float, float] = (2, 3), unit: float = 1e9) -> DataFrame:
    """Stop and targets, so many mean true ranges from the close, and the traded value in ``unit``."""
    c = F.col
    rows = rows.withColumns({"STOP_LOSS": F.bround(c("close") - stop * c("ATR_14")), "TARGET_1": F.bround(c("close") + targets[0] * c("ATR_14")), "TARGET_2": F.bround(c("close") + targets[1] * c("ATR_14")), "adtv_bn": F.bround(F.coalesce(c("avg_value_20d"), c("close") * c("volume")) / unit, 1)})
    return rows.withColumn("RISK_PCT", F.bround((c("close") - c("STOP_LOSS")) / F.nullif(c("close"), F.lit(0.0)) * 100, 1))


def position_size(rows: DataFrame, capital: float = 1e9, risk: float = 0.01, largest: float = 0.2) -> DataFrame:
    gap = F.col("close") - F.col("STOP_LOSS")
    shares = F.when(gap > 0, F.floor(F.least(capital * risk / F.when(gap > 0, gap), capital * largest / F.nullif(F.col("close"), F.lit(0.0))))).otherwise(0).cast("long")
    rows = rows.withColumn("shares", F.coalesce(shares, F.lit(0)))
    return rows.withColumns({"position_value": F.col("shares") * F.col("close"), "position_pct": F.bround(F.col("shares") * F.col("close") / capital * 100, 1)})


def capped_top(rows: DataFrame, cap: int = 2, limit: int = 10) -> DataFrame:
    """The best scores, at most ``cap`` of a sector; ties by ticker."""
    order = [F.desc("score"), F.asc("ticker")]
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("sector").orderBy(*order)))
    return ranked.filter(F.col("_n") <= cap).orderBy(*order).limit(limit).drop("_n")


def with_sector(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    once = sectors.groupBy("ticker").agg(F.min("sector").alias("sector"))  # a ticker that is listed twice has its first sector by name
    return rows.join(once, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def condition_counts(rows: DataFrame) -> DataFrame:
    """How many rows meet each condition of the reversal strategy, and all of them."""
    rows = rows.withColumn("_rise", F.col("MACD_HIST") - lag("MACD_HIST"))
    c = F.col
    return rows.agg(F.count_if("CHOCH_BULL").alias("choch"), F.count_if(c("RSI_14") < 40).alias("low_rsi"), F.count_if("OB_BULL").alias("blocks"), F.count_if(c("close") <= c("BB_LOWER_20")).alias("under_band"), F.count_if(c("_rise") > 0).alias("rising"), F.count_if("SIG_SMC").alias("fired"))
