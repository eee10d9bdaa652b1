"""Mixing sources to target weights: capped water-filling, then seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import WORD, fresh_name, materialize, read, row_place, with_bucket_offsets

#: Words that one bucket of a source's documents should hold, and the most buckets a source gets.
BUCKET_WORDS = 100_000
MOST_BUCKETS = 65_536
WORD_START = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def text_size(text: str):
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, source: str, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Give sources the weights of ``cycle`` by turns, by code point, null last.

    A source's rank is the number of sources under earlier two-letter prefixes plus its rank under
    its own, so no task ranks all sources.
    """
    null = F.col(source).isNull()
    ranked = sources.withColumns({"_one": F.lit(1).cast("long"), "_all": F.lit(0), "_null": null, "_bucket": F.struct(null.alias("null"), F.substring(source, 1, 2).alias("prefix"))})
    ranked = with_bucket_offsets(ranked, ["_all"], "_bucket", "_one", ["_null", source])
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("before") % len(cycle) + 1).cast("int"))
    return ranked.withColumn("weight", weights).drop("_bucket", "_null", "_one", "_all", "before")


def water_fill(sources: DataFrame, total: float | None = None, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to a table of sources with ``source_size`` and ``weight``.

    Targets are shares of ``total`` (all sizes, unless given) by weight. A source whose target is
    above ``max_epochs`` times its size is clamped there, and what that frees goes to the others by
    weight, again and again until none is above. Each round is one aggregate with one row. Sources
    of no words are clamped at 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = None
    clamped = F.lit(False)
    size, count = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    total = float(size) if total is None else float(total)
    before = -1
    for _ in range(count + 1):
        row = sources.withColumn("_clamped", clamped).agg(
            F.coalesce(F.sum(F.when(F.col("_clamped"), cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~F.col("_clamped"), F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.coalesce(F.sum(F.col("_clamped").cast("long")), F.lit(0)).alias("n"),
        ).first()
        if row["n"] == before or row["weight"] == 0:
            break
        before = row["n"]
        level = max(0.0, total - row["held"]) / row["weight"]
        clamped = F.col("weight") * F.lit(level) > cap
    target = cap if level is None else F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def repetitions(docs: DataFrame, targets: DataFrame, source: str, key: str, seed: int = 17) -> DataFrame:
    """Add ``source_size, target, repeats, part`` to rows with ``size``.

    Every document is taken ``repeats`` whole times, as often as the target holds the whole source.
    The rest of the target is filled in a seeded order of the source's documents: those before the
    end of it once more, and the one that crosses it with only its first ``part`` words, so the
    source's words come to the rounded target. ``docs`` needs ``_tie``, a hash that tells rows apart.
    """
    plan = targets.select(
        F.col(source).alias("_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
        F.least(F.lit(MOST_BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / BUCKET_WORDS))).cast("long").alias("_buckets"),
    ).withColumn("rest", F.rint(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    mixed = docs.join(plan, F.col(source).eqNullSafe(F.col("_source")), "left")
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col("_tie")), F.lit(2**62))
    mixed = mixed.withColumn("_place", place).withColumn("_bucket", F.floor(F.col("_place") / F.lit(2.0**62) * F.col("_buckets")).cast("long"))
    mixed = with_bucket_offsets(mixed, ["_source"], "_bucket", "size", ["_place", "_tie", key])
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    mixed = mixed.withColumn("_extra", extra)
    whole_extra = (F.col("_extra") == F.col("size")).cast("long")
    return (
        mixed.withColumn("repeats", F.col("whole") + F.when(F.col("size") > 0, whole_extra).otherwise(F.lit(0)))
        .withColumn("part", F.when(F.col("_extra") < F.col("size"), F.col("_extra")).otherwise(F.lit(0)).cast("long"))
        .withColumn("taken", F.col("repeats") * F.col("size") + F.col("part"))
        .drop("_source", "_buckets", "_place", "_bucket", "before", "_extra", "whole", "rest")
    )


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """One row per document: ``_key, _src, _row, size, source_size, target, repeats, part, taken``.

    Null texts have size 0 and are never taken. A null source is a source of its own. Rows that
    agree in id, source and text are interchangeable. An empty table gives no rows. The same seed
    gives the same mix.
    """
    sized = docs.select(F.col(key).alias("_key"), F.col(source).alias("_src"), text_size(text).alias("size"), F.xxhash64(F.col(text)).alias("_tie"))
    sized = materialize(sized.withColumn("_row", row_place(docs)), "sizes")
    sources = materialize(cycled_weights(sized.groupBy("_src").agg(F.sum("size").alias("source_size")), "_src"), "sources")
    return repetitions(sized, water_fill(sources, max_epochs=max_epochs), "_src", "_key", seed).drop("_tie")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", max_epochs: float = 3.0, seed: int = 17, stable: bool = False) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: each document as often as the plan takes it.

    The document that crosses a source's target ends with a copy of its first words, cut before the
    white space that follows. Rows without words are left out. Rows are told apart by their place in
    the table, so an input that isn't ``stable`` (a plain read of files) is written first.
    """
    docs = docs if stable else materialize(docs, "docs")
    row, repeats, part, copy = (fresh_name(docs, x) for x in ("row_number", "repeats", "part", "copy"))
    plan = mix_plan(docs, text, source, key, max_epochs, seed).filter("taken > 0")
    plan = plan.select(F.col("_row").alias(row), F.col("repeats").alias(repeats), F.col("part").alias(part))
    joined = docs.withColumn(row, row_place(docs)).join(plan, row)
    last = F.col(repeats) + (F.col(part) > 0).cast("long")
    rows = joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), last)))
    pieces = F.split(F.col(text), WORD_START)  # each word with the white space after it
    leading = F.when(F.regexp_like(F.col(text), F.lit("^[\\x20\\x09-\\x0D]")), 1).otherwise(0)
    cut = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (F.col(part) + leading).cast("int")), ""), "[\\x20\\x09-\\x0D]+$", "")
    return rows.withColumn(text, F.when(F.col(copy) > F.col(repeats), cut).otherwise(F.col(text))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read(spark, sf_dir, "documents"))
    return plan.select(F.col("_key").alias("doc_id"), "size", "source_size", "target", "taken")
