"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import SPACE, fresh_name, materialize, read, row_place, shared_dir, shuffle_width

#: What must agree for two texts to count as equal: two unrelated digests and the length.
DIGEST = ["_sha", "_check", "_length"]


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One narrow row per document: its id, its place in the table and its digests."""
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    return (
        docs.select(F.col(key).alias("_key"), normal.alias("_text"))
        .select("_key", F.unhex(F.sha2("_text", 256)).alias("_sha"), F.xxhash64("_text").alias("_check"), F.octet_length("_text").alias("_length"))
        .withColumn("_row", row_place(docs))
    )


def places_of(width: int, fan_in: int) -> tuple[int, int]:
    """Rounds until one run of at least ``width`` is left, and the number of places in each."""
    if fan_in < 2:
        raise ValueError("a round merges at least two runs")
    rounds = 1
    while fan_in**rounds < width:
        rounds += 1
    return rounds, fan_in**rounds


def in_runs(rows: DataFrame, fan_in: int) -> DataFrame:
    """``rows`` as a table in the shared folder, dealt by ``_run``: the partition they are in, so writing it moves nothing.

    The table knows that a run is in one place, so a run is sorted and merged where it is, without an exchange.
    """
    spark, name = rows.sparkSession, f"barloom_{uuid.uuid4().hex}"
    places = places_of(shuffle_width(spark), fan_in)[1]
    marked = rows.withColumn("_run", F.pmod(F.spark_partition_id(), F.lit(places)).cast("long"))
    marked.write.bucketBy(places, "_run").option("path", f"{shared_dir(spark)}/digests-{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry alone: the plan has the files
    return table


def merge_runs(rows: DataFrame, fan_in: int = 2) -> DataFrame:
    """Merge digest runs of a table of ``in_runs`` in rounds until one run is left.

    A run is a digest-sorted list, cut into slices by digest. At first each run is sorted and its equal texts merged where it is, so of
    a text that most rows hold a run sends one entry. In each round ``fan_in`` neighbouring runs exchange slices: their run number
    loses its lowest digit while the digest gives one more digit of the slice, so the number of places, each a slice of a run,
    stays the same. A round has one exchange, by place alone; a place merges the pieces of ``fan_in`` runs in digest order
    and keeps one entry per text: the smallest (id, row) and the number of rows. Entries merge only if SHA-256, a second hash
    and the length all agree.
    """
    rounds, places = places_of(shuffle_width(rows.sparkSession), fan_in)
    first = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_row").alias("row"))
    entries = rows.select(*DIGEST, first.alias("_first"), F.lit(1).cast("long").alias("_size"), "_run")
    runs = entries.sortWithinPartitions("_run", *DIGEST).groupBy("_run", *DIGEST).agg(F.min("_first").alias("_first"), F.sum("_size").alias("_size"))
    for done in range(1, rounds + 1):
        slices = fan_in**done
        place = F.floor(F.col("_run") / fan_in) * slices + F.pmod("_check", F.lit(slices))
        dealt = runs.withColumn("_place", place).drop("_run").repartition(places, "_place").sortWithinPartitions("_place", *DIGEST)
        merged = dealt.groupBy("_place", *DIGEST).agg(F.min("_first").alias("_first"), F.sum("_size").alias("_size"))
        runs = merged.withColumn("_run", F.floor(F.col("_place") / slices)).drop("_place")
    return runs.drop("_run")


def exact_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", fan_in: int = 2) -> DataFrame:
    """One row per document: ``_key, keep_id, group_size, kept, text_sha256, _row``.

    Null texts count as empty. Ids may be null or repeat: null ids come last, and of rows with
    the same smallest id the first row in reading order stays, so one row of each text is kept.
    Texts of any length are hashed whole; repeated rows are copies; columns besides ``text`` and ``key`` aren't
    looked at, whatever their names. An empty table gives no rows.
    """
    rows = in_runs(digests(docs, text, key), fan_in)
    classes = merge_runs(rows, fan_in).filter("_size > 1")
    classes = classes.select(*[F.col(c).alias(f"_c{c}") for c in DIGEST], F.col("_first.key").alias("_first_key"), F.col("_first.row").alias("_first_row"), F.col("_size"))
    joined = rows.join(classes, [F.col(c) == F.col(f"_c{c}") for c in DIGEST], "left")
    alone = F.col("_size").isNull()
    return joined.select(
        "_key",
        F.when(alone, F.col("_key")).otherwise(F.col("_first_key")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_first_row"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        "_row",
    )


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", fan_in: int = 2, stable: bool = False) -> DataFrame:
    """``docs``, all columns, without rows whose text equals another's, up to white space.

    The row with the smallest id stays; of rows that agree in text and id the first in reading
    order. Rows are told apart by their place in the table, so an input that isn't ``stable``
    (a plain read of files) is written to the shared folder first.
    """
    docs = docs if stable else materialize(docs, "docs")
    row = fresh_name(docs, "row_number")
    dropped = exact_classes(docs, text, key, fan_in).filter("not kept").select(F.col("_row").alias(row))
    return docs.withColumn(row, row_place(docs)).join(dropped, row, "left_anti").drop(row)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_classes(read(spark, sf_dir, "documents"))
    return out.select(F.col("_key").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
