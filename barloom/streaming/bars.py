"""Loading bars from a folder that grows: each file once, each batch once, into a table cut by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import months
from barloom.sources.bars import SCHEMA, first_of, load_plan
from barloom.sources.versions import Version, VersionedTable


def arrivals(spark: SparkSession, folder: str, files: int | None = None, format: str = "parquet", **options: str) -> DataFrame:
    """A stream of the bars in a folder's files, at most ``files`` of them in a batch, with when and where each was seen."""
    reader = spark.readStream.format(format).schema(SCHEMA).options(**options).option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", str(files)) if files else reader
    return reader.load(folder).select("*", F.col("_metadata.file_modification_time").alias("_seen"), F.col("_metadata.file_name").alias("_file"))


def newest(rows: DataFrame) -> DataFrame:
    """One bar of each ticker and time that has both and a close: of several, that of the file last written."""
    sound = rows.dropna(subset=["ticker", "time", "close"])
    return first_of(sound, ["ticker", "time"], [F.desc("_seen"), F.desc("_file"), "close", "open", "high", "low", "volume"]).drop("_seen", "_file")


def wanted(rows: DataFrame, old: DataFrame | None, today: str) -> DataFrame:
    """The rows that a load takes: all of a ticker that is new, else those after its last bar, today's anew.

    The decision is that of ``load_plan``, for the tickers of the batch.
    """
    if old is None:
        return rows
    tickers = rows.select("ticker").distinct().withColumn("exchange", F.lit(None).cast("string"))
    plan = load_plan(tickers, old.join(tickers.select("ticker"), "ticker", "left_semi"), today).select("ticker", "fetch_start", "status")
    fresh = (F.col("status") == "full_load") | (F.to_date("time") >= F.col("fetch_start"))
    return rows.join(plan, "ticker").filter(fresh).drop("fetch_start", "status")


def load_batch(rows: DataFrame, batch: int, path: str, stream: str = "bars", today: str | None = None) -> Version | None:
    """Commit one batch of ``arrivals``; None if the table has it already, or if there is nothing to add.

    With ``today``, history isn't touched: only bars after a ticker's last one are taken, and those of today replace what is there.
    Without it, any bar replaces the one of its ticker and time, however old: corrections that come late. The rows and the
    batch's number are one commit, so a batch that is repeated after a crash, before or after that commit, is in the table once.
    """
    table = VersionedTable(rows.sparkSession, path)
    base = table.version()
    if base is not None and base.batches.get(stream, -1) >= batch:
        return None
    once = newest(rows)
    if today is not None:
        once = wanted(once, table.read() if base else None, today)
    return months.upsert(table, once, stream, batch)


def load_available(spark: SparkSession, folder: str, path: str, checkpoint: str, stream: str = "bars", today: str | None = None, files: int | None = None, **options: str) -> list[dict]:
    """Load all files of ``folder`` that no run with this ``checkpoint`` has loaded, then stop; what was loaded, batch by batch.

    A run that dies goes on where it stopped: files of an unfinished batch come again under the same number.
    """
    done: list[dict] = []

    def step(rows: DataFrame, batch: int) -> None:
        version = load_batch(rows, batch, path, stream, today)
        done.append({"batch": batch, "rows": version.counts["rows"] if version else 0})

    query = arrivals(spark, folder, files, **options).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done
