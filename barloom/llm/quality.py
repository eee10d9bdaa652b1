"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import WordHashes, fresh_name, materialize, mix64, read, row_place

#: Buckets of hashed n-grams; a model is one float each, so models are broadcast.
BUCKETS = 1 << 16
#: Lengths, in bytes, of the character n-grams.
GRAMS = (3, 4)
#: Standard errors by which the share of good rows among labelled ones is raised, to keep good text.
MARGIN = 2.0
#: Good labelled rows that the target model is counted from, at most; their ids are broadcast.
FIT_ROWS = 20_000
#: Bins of a selection round.
BINS = 4096

_words = WordHashes()


def buckets_of(text: str | None) -> np.ndarray:
    """Buckets of a text's n-grams, repeats included: bytes, and pairs of neighbouring words.

    A word that is its neighbour's equal goes to one bucket whatever it is. Empty texts have none.
    """
    if not isinstance(text, str) or not text:
        return np.empty(0, np.int64)
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    parts = []
    for n in GRAMS:
        if len(data) >= n:
            code = np.full(len(data) - n + 1, n, np.uint64)
            for i in range(n):
                code = (code << np.uint64(8)) | data[i : len(data) - n + 1 + i]
            parts.append(mix64(code) & np.uint64(BUCKETS // 2 - 1))
    words = _words.of(raw.split())
    if len(words) > 1:
        pair = mix64(words[:-1] * np.uint64(3) + words[1:])
        pair[words[:-1] == words[1:]] = 0
        parts.append((pair & np.uint64(BUCKETS // 2 - 1)) + np.uint64(BUCKETS // 2))
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def ngram_counts(texts: DataFrame) -> DataFrame:
    """``bucket, target, raw``: how often each bucket comes in target rows and in all rows.

    ``texts`` has ``_text`` and ``_target``. Every task sums its rows before the shuffle, so what
    is shuffled is at most ``BUCKETS`` rows a task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 100):
                some = batch.iloc[at : at + 100]
                found = [buckets_of(text) for text in some["_text"]]
                sums[1] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                sums[0] += np.bincount(np.concatenate([np.empty(0, np.int64), *[f for f, target in zip(found, some["_target"], strict=True) if target]]), minlength=BUCKETS)
        some = np.flatnonzero(sums[1])
        yield pd.DataFrame({"bucket": some, "target": sums[0][some], "raw": sums[1][some]})

    counts = texts.mapInPandas(count, "bucket long, target long, raw long")
    return counts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log of target over raw probability by bucket, with one half added to each count; at most ``BUCKETS`` numbers.

    The byte n-grams and the word pairs are two models of the same text.
    """
    rows = counts.toPandas()
    both = np.full((2, BUCKETS), 0.5)
    both[0, rows["bucket"]] += rows["target"]
    both[1, rows["bucket"]] += rows["raw"]
    half = BUCKETS // 2
    for part in (slice(0, half), slice(half, BUCKETS)):
        both[:, part] /= both[:, part].sum(axis=1, keepdims=True)
    return np.log(both[0]) - np.log(both[1])


def importance_weights(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", seed: int = 11, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, float]:
    """``_key, _row, log_weight, priority`` for every document, and the share of good text to keep.

    The target model is counted from the documents of at most ``fit_rows`` ids whose label says good,
    those of smallest seeded hash; the raw model from all documents. ``log_weight`` is the sum over the text's n-grams of their log ratio (0 for empty
    or null texts). ``priority`` adds seeded Gumbel noise, so the k largest priorities are a draw of k
    documents without replacement by weight. Null ids have no label. Documents labelled twice are
    good if any label says so.
    """
    marks = labels.groupBy(F.col(key).alias("_label_key")).agg(F.max(quality).alias("_good")).filter("_label_key is not null and _good is not null")
    base = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), row_place(docs).alias("_row"))
    good = marks.filter("_good = 1").select("_label_key").orderBy(F.xxhash64(F.lit(seed), "_label_key"), "_label_key").limit(fit_rows)
    marked = base.join(F.broadcast(good), F.col("_key") == F.col("_label_key").cast("string"), "left").withColumn("_target", F.col("_label_key").isNotNull())
    ratios = log_ratios(ngram_counts(marked.select("_text", "_target")))
    kind = docs.select(F.col(key).alias("_key")).schema["_key"].dataType.simpleString()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["_key", "_row"]].assign(log_weight=[float(ratios[buckets_of(t)].sum()) for t in batch["_text"]])

    weights = base.mapInPandas(weigh, "_key string, _row long, log_weight double").withColumn("_key", F.col("_key").cast(kind))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("_key").cast("string"), F.col("_row")), F.lit(2**52)) + 0.5) / F.lit(2.0**52)
    n, share = marks.agg(F.count(F.lit(1)), F.avg("_good")).first()
    share = min(1.0, share + MARGIN * (share * (1 - share) / n) ** 0.5) if n else 1.0
    return weights.withColumn("priority", F.col("log_weight") - F.log(-F.log(uniform))), share


def kth_largest(rows: DataFrame, value: str, k: int, bins: int = BINS) -> float:
    """The k-th largest value of a column, by narrowing a range of bins; every round sends ``bins`` counts at most."""
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n == 0 or k <= 0:
        return float("inf")
    k = min(k, n)
    above = 0
    while True:
        width = (high - low) / bins
        if not low + width > low:
            return low
        place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.lit(low)) / F.lit(width)))
        found = rows.filter(F.col(value).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        for row in sorted(found, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if row["low"] == row["high"]:
            return row["low"]
        if above + row["n"] == k:
            return row["low"]
        low, high = row["low"], row["high"]


def quality_decisions(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", share: float | None = None, seed: int = 11) -> DataFrame:
    """One row per document: ``_key, _row, log_weight, priority, kept``.

    Kept are the k documents of largest priority, k being ``share`` of all rows, rounded up; unless
    given, the share of good rows among labelled ones plus ``MARGIN`` standard errors. Rows whose
    priority equals the k-th are all kept. Without labels all rows are kept. Repeated rows are weighed alike and drawn
    each by itself; very long texts are weighed whole; an empty table gives no rows; other columns aren't looked at.
    """
    weights, found = importance_weights(docs, labels, text, key, quality, seed)
    weights = materialize(weights, "weights")
    k = int(np.ceil((found if share is None else share) * weights.count()))
    return weights.withColumn("kept", F.col("priority") >= F.lit(kth_largest(weights, "priority", k)))


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", share: float | None = None, seed: int = 11, stable: bool = False) -> DataFrame:
    """``docs``, all columns, without the rows that importance resampling leaves out."""
    docs = docs if stable else materialize(docs, "docs")
    row = fresh_name(docs, "row_number")
    kept = quality_decisions(docs, labels, text, key, share=share, seed=seed).filter("kept").select(F.col("_row").alias(row))
    return docs.withColumn(row, row_place(docs)).join(kept, row, "left_semi").drop(row)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_decisions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(F.col("_key").alias("doc_id"), "log_weight", "priority", "kept")
