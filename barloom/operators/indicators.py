"""Indicators and market structure as window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import bars_window, ewm, lag, last_bars, lead, rolling, stretch


def moving_averages(bars: DataFrame) -> DataFrame:
    """Means of the last 20, 50 and 200 closes, from sums of the last 10: a bar costs some twenty additions and not 270.

    The sums of a longer stretch add those of its parts, as they stood some bars ago; nothing is taken off again, so there's no error to grow.
    """
    bars = bars.withColumns({"_s10": F.coalesce(F.sum(F.col("close").cast("double")).over(last_bars(10)), F.lit(0.0)), "_c10": F.count("close").over(last_bars(10))})
    for n, part in ((20, 10), (50, 10), (200, 50)):
        bars = bars.withColumns({f"_{x}{n}": stretch(f"_{x}{part}", part, n) for x in "sc"})
        bars = bars.withColumn(f"MA_{n}", F.when(F.col(f"_c{n}") >= n, F.col(f"_s{n}") / F.col(f"_c{n}")))
    return bars.drop(*[f"_{x}{n}" for x in "sc" for n in (10, 20, 50, 200)])


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = rolling(F.avg, F.col("close"), n), rolling(F.stddev_pop, F.col("close"), n)
    return bars.withColumns({f"BB_UPPER_{n}": mid + k * dev, f"BB_MID_{n}": mid, f"BB_LOWER_{n}": mid - k * dev})


def emas(bars: DataFrame) -> DataFrame:
    for n in (12, 26):
        bars = ewm(bars, "close", 2 / (n + 1), f"EMA_{n}", n - 1)
    return bars


def macd(bars: DataFrame) -> DataFrame:
    bars = bars if "EMA_26" in bars.columns else emas(bars)
    bars = ewm(bars.withColumn("MACD_12_26_9", F.col("EMA_12") - F.col("EMA_26")), "MACD_12_26_9", 0.2, "MACD_SIGNAL_9", 8)
    return bars.withColumn("MACD_HIST", F.col("MACD_12_26_9") - F.col("MACD_SIGNAL_9"))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    change = F.col("close") - lag("close")
    bars = bars.withColumns({"_gain": F.greatest(change, F.when(change.isNotNull(), 0.0)), "_loss": F.greatest(-change, F.when(change.isNotNull(), 0.0))})
    bars = ewm(ewm(bars, "_gain", 1 / n, "_up", n - 1), "_loss", 1 / n, "_down", n - 1)
    both = F.col("_up") + F.col("_down")
    return bars.withColumn(f"RSI_{n}", F.when(both != 0, 100 * F.col("_up") / both).when(both == 0, 50.0)).drop("_gain", "_loss", "_up", "_down")


def ichimoku(bars: DataFrame) -> DataFrame:
    def middle(n: int):
        return (rolling(F.max, F.col("high"), n) + rolling(F.min, F.col("low"), n)) / 2

    bars = bars.withColumns({"TENKAN_9": middle(9), "KIJUN_26": middle(26), "_wide": middle(52)})
    return bars.withColumns({"SENKOU_A": lag((F.col("TENKAN_9") + F.col("KIJUN_26")) / 2, 26), "SENKOU_B": lag("_wide", 26), "CHIKOU_VIZ": lead("close", 26)}).drop("_wide")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    bars = bars.withColumns({
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close"))),
        "_plus": F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)),
        "_minus": F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)),
    })
    for x, out in (("_tr", f"ATR_{n}"), ("_plus", "_sp"), ("_minus", "_sm")):
        bars = ewm(bars, x, 1 / n, out)
    share = lambda c: F.when(F.col(f"ATR_{n}") != 0, 100 * F.col(c) / F.col(f"ATR_{n}")).otherwise(0.0)
    bars = bars.withColumns({f"DI_PLUS_{n}": share("_sp"), f"DI_MINUS_{n}": share("_sm")})
    total = F.col(f"DI_PLUS_{n}") + F.col(f"DI_MINUS_{n}")
    bars = bars.withColumn("_dx", F.when(total != 0, 100 * F.abs(F.col(f"DI_PLUS_{n}") - F.col(f"DI_MINUS_{n}")) / total).otherwise(0.0))
    return ewm(bars, "_dx", 1 / n, f"ADX_{n}").drop("_tr", "_plus", "_minus", "_sp", "_sm", "_dx")


def swings(bars: DataFrame) -> DataFrame:
    high = (F.col("high") > lag("high")) & (F.col("high") > lead("high"))
    low = (F.col("low") < lag("low")) & (F.col("low") < lead("low"))
    return bars.withColumns({"SWING_HIGH": F.coalesce(high, F.lit(False)), "SWING_LOW": F.coalesce(low, F.lit(False))})


def order_blocks(bars: DataFrame) -> DataFrame:
    bull, bear = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    bars = bars.withColumns({"_bull": bull, "_bear": bear})
    after = lambda c: lead(c, 1) & lead(c, 2) & lead(c, 3)
    bars = bars.withColumns({"OB_BULL": F.coalesce(F.col("_bear") & after("_bull"), F.lit(False)), "OB_BEAR": F.coalesce(F.col("_bull") & after("_bear"), F.lit(False))})
    either = F.col("OB_BULL") | F.col("OB_BEAR")
    return bars.withColumns({"OB_HIGH": F.when(either, F.col("high")), "OB_LOW": F.when(either, F.col("low"))}).drop("_bull", "_bear")


def market_structure(bars: DataFrame) -> DataFrame:
    """Breaks of the last swing: with the trend (BOS) or against it (CHOCH), once for each swing.

    A swing counts from the bar after it. The trend turns up when both last swings lie above those
    before, down when both lie below; it is looked at when a swing high counts and then when a
    swing low does.
    """
    bars = bars if "SWING_HIGH" in bars.columns else swings(bars)
    so_far = bars_window().rowsBetween(Window.unboundedPreceding, 0)
    before = bars_window().rowsBetween(Window.unboundedPreceding, -1)
    bars = bars.withColumns({"_sh": lag(F.when(F.col("SWING_HIGH"), F.col("high"))), "_sl": lag(F.when(F.col("SWING_LOW"), F.col("low"))), "_i": F.row_number().over(bars_window())})
    for s in ("h", "l"):
        bars = bars.withColumns({f"_last_{s}": F.last(f"_s{s}", True).over(so_far), f"_was_{s}": F.last(f"_s{s}", True).over(before), f"_at_{s}": F.last(F.when(F.col(f"_s{s}").isNotNull(), F.col("_i")), True).over(so_far)})
    for s in ("h", "l"):
        bars = bars.withColumn(f"_prev_{s}", F.last(F.when(F.col(f"_s{s}").isNotNull(), F.col(f"_was_{s}")), True).over(so_far))

    def turn(last_l, prev_l):
        up = (F.col("_last_h") > F.col("_prev_h")) & (last_l > prev_l)
        down = (F.col("_last_h") < F.col("_prev_h")) & (last_l < prev_l)
        return F.when(up, 1).when(down, -1)

    at_low = F.when(F.col("_sl").isNotNull(), turn(F.col("_last_l"), F.col("_prev_l")))
    at_high = F.when(F.col("_sh").isNotNull(), turn(lag("_last_l"), lag("_prev_l")))
    bars = bars.withColumn("_turn", F.coalesce(at_low, at_high)).withColumns({"_hit_h": F.coalesce(F.col("high") > F.col("_last_h"), F.lit(False)), "_hit_l": F.coalesce(F.col("low") < F.col("_last_l"), F.lit(False))})
    bars = bars.withColumn("_trend", F.coalesce(F.last("_turn", True).over(so_far), F.lit(0)))
    for s in ("h", "l"):
        prior = F.last(F.when(F.col(f"_hit_{s}"), F.col("_i")), True).over(before)
        bars = bars.withColumn(f"_break_{s}", F.col(f"_hit_{s}") & F.coalesce(prior < F.col(f"_at_{s}"), F.lit(True)))
    out = {"BOS_BULL": F.col("_break_h") & (F.col("_trend") >= 0), "CHOCH_BULL": F.col("_break_h") & (F.col("_trend") < 0), "BOS_BEAR": F.col("_break_l") & (F.col("_trend") <= 0), "CHOCH_BEAR": F.col("_break_l") & (F.col("_trend") > 0)}
    bars = bars.withColumns(out)
    return bars.drop(*[c for c in bars.columns if c.startswith("_")])


def features(bars: DataFrame) -> DataFrame:
    """All indicator columns. Every window is by ticker in time order, so the chain has one shuffle."""
    for step in (moving_averages, emas, rsi, macd, bollinger, ichimoku, adx, swings, market_structure, order_blocks):
        bars = step(bars)
    return bars.withColumn("avg_value_20d", rolling(F.avg, F.col("close") * F.col("volume"), 20, 10))


def tail(bars: DataFrame, n: int = 260) -> DataFrame:
    newest = Window.partitionBy("ticker").orderBy(F.desc("time"))
    return bars.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")
