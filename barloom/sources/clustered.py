"""Tables clustered by ticker: windows and joins by ticker read them without an exchange, and some tickers are read from some files.

A version's folder has a file for each bucket, sorted by ticker and time. Sessions know the folder as an external table, as Spark takes
buckets from its catalog alone; files and pointer don't depend on that entry.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.sources.versions import WHOLE, Part, Version, VersionedTable

#: Tickers that are named in the scan itself; more of them are joined, which takes no exchange of the bars either.
MOST_NAMED = 1000
#: Rows of a bucket, which one task sorts and writes, and later reads, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 8


def buckets_for(rows: int) -> int:
    """Buckets of a table of at most so many rows: more rows make more tasks, not longer ones."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def write_clustered(rows: DataFrame, path: str, buckets: int = 16) -> Version:
    """``rows`` in place of the table's, dealt to ``buckets`` by ticker. All of a ticker, null included, is in one file, as windows need it."""
    if buckets < 1:
        raise ValueError("a table has at least one bucket")
    spark = rows.sparkSession
    table, name = VersionedTable(spark, path), f"barloom_{uuid.uuid4().hex}"
    base, where = table.version(), f"data/{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, "ticker")  # rows that are dealt so already stay; the write sorts each bucket
    dealt.write.bucketBy(buckets, "ticker").sortBy("ticker", "time").option("path", f"{table.path}/{where}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the entry; the files of an external table stay
    return table.commit({"": Part(rows.schema.json(), {WHOLE: where}, "parquet", {"buckets": str(buckets)})}, "cluster", base)


def _name(part: Part) -> str:
    return f"barloom_{part.folders[WHOLE].split('/')[-1]}"


def read_clustered(spark: SparkSession, path: str, tickers: DataFrame | None = None, number: int | None = None) -> DataFrame:
    """The table as of a version, of the given tickers only; a few of them are named to the scan, which then reads their buckets alone."""
    table = VersionedTable(spark, path)
    version = table.version(number)
    if version is None:
        raise FileNotFoundError(path)
    part = version.parts[""]
    name = _name(part)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(part.schema)))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (ticker) SORTED BY (ticker, time) INTO {part.options['buckets']} BUCKETS LOCATION '{table.path}/{part.folders[WHOLE]}'")
    rows = spark.table(name)
    if tickers is None:
        return rows
    wanted = tickers.select("ticker").filter("ticker is not null").distinct()
    named = [r[0] for r in wanted.limit(MOST_NAMED + 1).collect()]
    if len(named) <= MOST_NAMED:
        return rows.filter(F.col("ticker").isin(named)) if named else rows.filter("false")
    return rows.join(wanted, "ticker", "left_semi")


def forget(spark: SparkSession, path: str) -> None:
    """Take the table's versions out of the session's catalog; their files stay."""
    table = VersionedTable(spark, path)
    for n in table.numbers():
        spark.sql(f"DROP TABLE IF EXISTS {_name(table.version(n).parts[''])}")
