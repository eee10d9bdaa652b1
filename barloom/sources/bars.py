"""Bars: reading, deriving, cleaning, splicing and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources import months
from barloom.sources.folders import exists
from barloom.sources.versions import VersionedTable, is_versioned

SCHEMA = "ticker string, time timestamp_ntz, open double, high double, low double, close double, volume long"
ALIASES = {"time": ["time", "date", "tradingdate", "trading_date", "datetime"], "volume": ["volume", "vol", "matchvolume", "match_volume"]}
PRICES = ["open", "high", "low", "close"]


def derive_bars(trades: DataFrame, ticker: Column, time: str, price: str, size: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Daily bars of a table of trades; ``order`` with the price says which trade of a day is first and last.

    With ``parts`` the trades are dealt to so many by ticker, and the bars stay there: no later step by ticker deals them anew.
    """
    by = F.struct(*order, price)
    if parts:
        trades = trades.select(ticker.alias("ticker"), *dict.fromkeys([time, price, size, *order])).repartition(parts, "ticker")
        ticker = F.col("ticker")
    agg = trades.groupBy(ticker.alias("ticker"), F.col(time).alias("time"))
    return agg.agg(F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.sum(size).cast("long").alias("volume"))


def line_bars(spark: SparkSession, sf_dir: str, ticker: Column, parts: int | None = None) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return derive_bars(lines, ticker, "l_shipdate", "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber"], parts)


def read_bars(spark: SparkSession, path: str, tickers: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from parquet with inclusive dates pushed to the scan; NaN becomes null.

    Of a versioned table only the months of those dates are listed. In a plain folder, files starting with ``_`` and unreadable ones are
    skipped; ``skipped_files`` names the latter. No such path gives no bars, so everything is loaded anew.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    if is_versioned(spark, path):
        bars = VersionedTable(spark, path).read(keys=months.between(start, end))
    else:
        bars = spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    bars = bars.filter(F.col("time") >= F.lit(start).cast("timestamp_ntz")) if start else bars
    bars = bars.filter(F.col("time") <= F.lit(end).cast("timestamp_ntz")) if end else bars
    bars = bars.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in PRICES})
    return bars.join(tickers.select("ticker").distinct(), "ticker", "left_semi") if tickers is not None else bars


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files under a folder of which no row could be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    read = spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    seen = read.filter(F.col("ticker").isNotNull()).select(_file(F.col("_metadata.file_path")).alias("seen")).distinct()
    return files.join(seen, _file(F.col("path")) == F.col("seen"), "left_anti")


def _file(path: Column) -> Column:
    """A file's path without its scheme, as Spark writes schemes in two ways."""
    return F.regexp_replace(path, "^[a-z]+:/+", "/")


def normalise_bars(raw: DataFrame, ticker: str | Column, order: list[str] | None = None) -> DataFrame:
    """Rows of any spelling as bars: known aliases, bad values null, volume 0 if missing, one row of a time kept.

    That is the first by the columns ``order`` of ``raw``, such as a row number, as Spark's rows have no order of their own;
    ties, and all rows without ``order``, go by close, open, high, low and volume.
    """
    names = {c.strip().lower(): c for c in raw.columns}
    pick = {k: names[next(a for a in v if a in names)] for k, v in ALIASES.items()} | {p: names[p] for p in PRICES}
    bars = raw.select(
        (F.lit(ticker) if isinstance(ticker, str) else ticker).alias("ticker"),
        F.expr(f"try_cast(`{pick['time']}` as timestamp_ntz)").alias("time"),
        *[F.expr(f"try_cast(`{pick[p]}` as double)").alias(p) for p in PRICES],
        F.coalesce(F.expr(f"try_cast(`{pick['volume']}` as double)").cast("long"), F.lit(0)).alias("volume"),
        *[F.col(f"`{c}`").alias(f"_order{i}") for i, c in enumerate(order or [])],
    )
    by = [f"_order{i}" for i in range(len(order or []))]
    return first_of(bars.dropna(subset=["time", "close"]), ["ticker", "time"], [*by, "close", "open", "high", "low", "volume"]).drop(*by)


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def rescale_units(bars: DataFrame, below: float = 1000.0, factor: float = 1000.0) -> DataFrame:
    """Prices times ``factor`` for tickers whose exact median close is under ``below``."""
    medians = bars.groupBy("ticker").agg(F.median("close").alias("_median"))
    scale = F.when(F.col("_median") < below, factor).otherwise(1.0)
    return bars.join(medians, "ticker").withColumns({p: F.col(p) * scale for p in PRICES}).drop("_median")


def normalise_listing(raw: DataFrame, exchanges: list[str], longest: int = 4) -> DataFrame:
    """Tickers of the wanted exchanges: names and values trimmed, codes of more than ``longest`` letters dropped."""
    names = {c.strip().lower(): c for c in raw.columns}
    ticker, exchange = names.get("ticker", names.get("symbol")), names["exchange"]
    rows = raw.select(F.upper(F.trim(F.col(f"`{ticker}`"))).alias("ticker"), F.upper(F.trim(F.col(f"`{exchange}`"))).alias("exchange"))
    return first_of(rows.filter((F.length("ticker") <= longest) & F.col("exchange").isin(exchanges)), ["ticker"], ["exchange"])


def splice(recent: DataFrame, older: DataFrame, calendar_start: str, least_cover: float = 0.8) -> DataFrame:
    """``recent`` with earlier bars of ``older`` in front, scaled to agree at the first common bar.

    Only where ``recent`` holds less than ``least_cover`` of the bars to expect since ``calendar_start``; not
    scaled if the overlapping bar is missing or not positive.
    """
    stats = recent.groupBy("ticker").agg(F.min("time").alias("_first"), F.max("time").alias("_last"), F.count("time").alias("_n"))
    expected = F.greatest(F.lit(1), F.floor(F.datediff("_last", F.lit(calendar_start)) * 252 / 365))
    short = stats.filter(F.col("_n") < expected * least_cover).select("ticker", "_first")
    at = recent.select("ticker", F.col("time").alias("_first"), F.col("close").alias("_to")).join(older.select("ticker", F.col("time").alias("_first"), F.col("close").alias("_from")), ["ticker", "_first"])
    factor = F.when((F.col("_from") > 0) & (F.col("_to") > 0), F.col("_to") / F.col("_from")).otherwise(1.0)
    back = older.join(short, "ticker").filter("time < _first").join(at, ["ticker", "_first"], "left")
    back = back.withColumns({p: F.col(p) * factor for p in PRICES}).select(recent.columns)
    return recent.unionByName(back)


def merge_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows before a ticker's first new bar, and all new rows."""
    starts = new.groupBy("ticker").agg(F.min("time").alias("_from"))
    kept = old.join(starts, "ticker", "left").filter("_from is null or time < _from").drop("_from")
    return kept.unionByName(new, allowMissingColumns=True)


def load_plan(listing: DataFrame, bars: DataFrame, today: str, start: str = "2016-01-01") -> DataFrame:
    """Per listed ticker, where the next load starts and its status: a full load, a refetch of today, or what is missing.

    ``total_rows`` counts the bars that stay, as today's are fetched anew.
    """
    day = F.lit(today).cast("date")
    last = bars.groupBy("ticker").agg(F.max("time").cast("date").alias("last"), F.count_if(F.col("time") < day).alias("total_rows"))
    return listing.join(last, "ticker", "left").select(
        "ticker", "exchange", F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.when(F.col("last").isNull(), F.lit(start).cast("date")).when(F.col("last") >= day, day).otherwise(F.date_add("last", 1)).alias("fetch_start"),
        F.when(F.col("last").isNull(), "full_load").otherwise("delta_updated").alias("status"),
    )


def load_results(plan: DataFrame, fetched: DataFrame) -> DataFrame:
    """What a load did for each ticker of its plan: rows that came, rows there are now, and a status.

    Nothing fetched is a failure for a full load and no new data otherwise; a ticker that wasn't tried isn't in the plan.
    """
    came = fetched.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows_added"))
    rows = plan.join(came, "ticker", "left").withColumn("rows_added", F.coalesce("rows_added", F.lit(0)))
    full = F.col("status") == "full_load"
    status = F.when(F.col("rows_added") > 0, F.col("status")).when(full, "fetch_failed").otherwise("no_new_data")
    return rows.withColumns({"status": status, "total_rows": F.col("total_rows") + F.col("rows_added")})


def load_summary(listing: DataFrame, results: DataFrame) -> DataFrame:
    """Every listed ticker with its load's result; those without one were not attempted."""
    rows = listing.join(results.drop("exchange"), "ticker", "left")
    return rows.withColumns({"status": F.coalesce("status", F.lit("not_attempted")), "rows_added": F.coalesce("rows_added", F.lit(0)), "total_rows": F.coalesce("total_rows", F.lit(0))})


def status_counts(summary: DataFrame) -> DataFrame:
    has = lambda *s: F.count_if(F.col("status").isin(*s))
    return summary.agg(F.count(F.lit(1)).alias("tickers"), has("full_load", "delta_updated").alias("updated"), has("up_to_date", "no_new_data").alias("up_to_date"), has("fetch_failed", "worker_exception").alias("failed"), has("not_attempted").alias("not_attempted"))


def sector_mapping(raw: DataFrame, level: int = 2) -> DataFrame:
    """``ticker, sector, industry`` from a table of classifications: one level of it, one row a ticker, the first sector by name."""
    rows = raw.filter(F.col("icb_level") == level).select(F.upper(F.trim("symbol")).alias("ticker"), F.col("icb_name").alias("sector"), F.col("icb_name").alias("industry"))
    return first_of(rows, ["ticker"], ["sector"])


def latest_prices(bars: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """``ticker, close``: the snapshot's close where there is one, else the last close known."""
    last = bars.filter("close is not null").groupBy("ticker").agg(F.max_by("close", "time").alias("close"))
    if snapshot is None:
        return last
    both = last.withColumnRenamed("close", "_last").join(snapshot.select("ticker", "close"), "ticker", "full_outer")
    return both.select("ticker", F.coalesce("close", "_last").alias("close"))
