"""Open and closed signals: upsert, status, weekly figures, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.bars import first_of


def upsert(tracker: DataFrame, top: DataFrame, prices: DataFrame, day: str | Column) -> DataFrame:
    """Tracked signals with today's added and all repriced; a signal of the same day, ticker and kind stays as it was.

    ``day`` is a date, or a column of ``top`` that has it.
    """
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    new = top.select(
        day.alias("signal_date"), "ticker", "sector", "signals_fired", "score", F.col("close").alias("entry_price"),
        F.coalesce("STOP_LOSS", F.col("close") * 0.95).alias("STOP_LOSS"), F.coalesce("TARGET_1", F.col("close") * 1.05).alias("TARGET_1"), F.coalesce("TARGET_2", F.col("close") * 1.1).alias("TARGET_2"), F.lit(1).alias("_age"),
    )
    rows = first_of(tracker.withColumn("_age", F.lit(0)).unionByName(new, allowMissingColumns=True), ["signal_date", "ticker", "signals_fired"], ["_age"]).drop("_age", "current_price")
    rows = rows.join(prices.select("ticker", F.col("close").alias("_price")), "ticker", "left")
    rows = rows.withColumn("current_price", F.when(F.col("_price") > 0, F.col("_price")).otherwise(F.col("entry_price"))).drop("_price")
    price = F.col("current_price")
    status = F.when((F.col("STOP_LOSS") > 0) & (price <= F.col("STOP_LOSS")), "SL_HIT").when(price >= F.col("TARGET_2"), "T2_REACHED").when(price >= F.col("TARGET_1"), "T1_REACHED").otherwise("HOLDING")
    return rows.withColumns({"return_pct": F.bround((price / F.nullif("entry_price", F.lit(0.0)) - 1) * 100, 2), "touch_status": status}).crossJoin(F.broadcast(top.agg(F.max(day).alias("last_updated"))))  # one row


def settle(tracker: DataFrame, bars: DataFrame, expiry: int = 20) -> DataFrame:
    """Close open rows that reached a target or stop, or were held ``expiry`` bars.

    Bars held are the difference of two bar numbers: the last one's and that of the last bar up to the signal. They and the last price are found in one
    pass over a ticker's bars and signals in order of date, without a join.
    """
    waits = F.col("result").isNull() | (F.col("result") == "HOLDING")
    asked = tracker.select("ticker", F.col("signal_date").alias("_date"), F.lit(0).alias("_bar"), F.struct(*tracker.columns).alias("_row"))
    marks = bars.select("ticker", F.to_date("time").alias("_date"), F.lit(1).alias("_bar"), "time", "close").unionByName(asked, allowMissingColumns=True)
    whole = Window.partitionBy("ticker")
    upto = whole.orderBy("_date", F.desc("_bar")).rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumns({"_upto": F.sum("_bar").over(upto), "_bars": F.sum("_bar").over(whole), "_price": F.max_by("close", "time").over(whole), "_day": F.max("time").over(whole)})
    rows = seen.filter("_bar = 0").select("_row.*", (F.col("_bars") - F.col("_upto")).alias("_held"), "_price", "_day")
    is_open = waits & F.col("_price").isNotNull() & F.col("signal_date").isNotNull()
    ended = F.col("_held") >= expiry
    outcome = F.when(F.col("_price") >= F.col("TARGET_1"), "WIN").when((F.col("_price") <= F.col("STOP_LOSS")) & (F.col("STOP_LOSS") > 0), "LOSS").when(ended, F.when(F.col("_price") > F.col("entry_price"), "WIN").otherwise("LOSS")).otherwise("HOLDING")
    hit = (F.col("_price") >= F.col("TARGET_1")) | ((F.col("_price") <= F.col("STOP_LOSS")) & (F.col("STOP_LOSS") > 0))
    closed = is_open & (outcome != "HOLDING")
    return rows.withColumns({
        "note": F.when(is_open & ended & ~hit, "EXPIRED_T+20").otherwise(F.col("note")),
        "days_held": F.when(is_open, F.col("_held").cast("int")).otherwise(F.col("days_held")),
        "exit_price": F.when(closed, F.col("_price")).otherwise(F.col("exit_price")),
        "exit_date": F.when(closed, F.to_date("_day")).otherwise(F.col("exit_date")),
        "result": F.when(is_open, outcome).otherwise(F.col("result")),
    }).drop("_price", "_day", "_held")


def weekly(tracker: DataFrame, day: str, days: int = 7) -> DataFrame:
    wins, losses = F.count_if(F.col("result") == "WIN"), F.count_if(F.col("result") == "LOSS")
    closed = F.col("result").isin("WIN", "LOSS")
    return tracker.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("result").isNull() | (F.col("result") == "HOLDING")).alias("holding"), wins.alias("wins"), losses.alias("losses"), (wins + losses).alias("closed"),
        F.when(wins + losses > 0, F.round(wins / F.nullif(wins + losses, F.lit(0)) * 100, 4)).alias("win_rate"),
        F.round(F.avg(F.when(closed, F.col("return_pct"))), 4).alias("avg_return"), F.count_if(F.col("signal_date") >= F.date_sub(F.lit(day).cast("date"), days)).alias("new_signals"),
    )


def restore_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Hand-written notes of the last sheet win over the table's own."""
    old = first_of(notes.select("signal_date", "ticker", F.nullif(F.trim("note"), F.lit("")).alias("_note")), ["signal_date", "ticker"], [F.desc_nulls_last("_note")])
    return rows.join(old, ["signal_date", "ticker"], "left").withColumn("note", F.coalesce("_note", F.nullif(F.trim("note"), F.lit("")), F.lit(""))).drop("_note")


def performance(tracker: DataFrame) -> DataFrame:
    """One row: tracked signals by touched level, the win rate among those that touched one, the mean return."""
    target, stop = F.count_if(F.col("touch_status").isin("T1_REACHED", "T2_REACHED")), F.count_if(F.col("touch_status") == "SL_HIT")
    rate = F.when(target + stop > 0, target / F.nullif(target + stop, F.lit(0)) * 100).otherwise(0.0)
    return tracker.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("touch_status") == "HOLDING").alias("holding"), target.alias("targets"), stop.alias("stops"), rate.alias("win_rate"), F.avg("return_pct").alias("avg_return"))


def in_order(tracker: DataFrame) -> DataFrame:
    """The newest signals first, then by ticker."""
    return tracker.orderBy(F.desc("signal_date"), "ticker")
