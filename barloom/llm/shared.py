"""Helpers the training-data operators share: shared tables, skew-safe ranks, text hashing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application."""
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        root = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(Path(tempfile.mkdtemp()) / f"{root.name}.zip", "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(out.filename)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a folder of its own; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table in the shared folder that is dealt by ``column``, so groups by it need no shuffle."""
    spark = df.sparkSession
    ship(spark)
    name = f"barloom_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def dropped_buckets(df: DataFrame) -> None:
    """Forget a table of ``in_buckets`` that nothing reads any more, and delete its files."""
    names = {Path(f).parent.name for f in df.inputFiles()}
    drop_table(df)
    for name in names:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def row_place(df: DataFrame) -> Column:
    """A number for every row: its place in the files that ``df`` reads, the same at each reading.

    Spark cuts files into splits by the number of cores it has, which changes as executors come and
    go. Two readings must agree, so the session keeps the number that it had at the first one.
    """
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.files.minPartitionNum"
    if not conf.get(key, None):
        conf.set(key, str(df.sparkSession.sparkContext.defaultParallelism))
    return F.monotonically_increasing_id()


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialize`` made and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_bucket_offsets(df: DataFrame, group: list[str], bucket: str, value: str, order: list[str]) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same group that come earlier.

    Rows are ordered by ``bucket`` and then by ``order``. The sum is taken in two levels, within
    (group, bucket) and over the buckets' totals, so no task gets all rows of one hot group.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_bucket_sum"))
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_k_{c}") for c in [*group, bucket]], F.coalesce(F.sum("_bucket_sum").over(over), F.lit(0)).alias("_start"))
    match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*group, bucket]]
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inner.join(starts, match, "left")
    return joined.withColumn("before", F.col("_start") + F.col("_within")).drop("_within", "_start", *[f"_k_{c}" for c in [*group, bucket]])


class WordHashes(dict):
    """64-bit hashes of words, kept from one text to the next up to a bound."""

    def __init__(self, most: int = 60_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 (bytes.lower and bytes.split know only ASCII)."""
    return text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` word hashes; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (hashes[i : i + n] ^ np.uint64(0xD6E8FEB86659FD93 * (i + 1) % 2**64))
    return mix64(out)
