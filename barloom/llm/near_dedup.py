"""Near-dedup: SetSketch registers, banded, estimated jointly by likelihood, verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.components import connected_components
from barloom.llm.shared import WordHashes, fresh_name, materialize, mix64, read, rolling_hash, row_place, words_of

SHINGLE = 5
PERCENT = 75
#: 128 registers of 16 bits in 32 bands: two sets of similarity 0.75 share no band once in 180,000 times.
REGISTERS, ROWS = 128, 4
#: Base and rate of the exponential spacing: registers cover sets of up to 10^20 shingles.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Candidates whose likelihood estimate is this far under the threshold aren't verified: five standard errors.
SLACK = 0.2
#: Tasks that the rows of one large group are dealt to when they get its first id.
SHARES = 32

_words = WordHashes()
_rng = np.random.default_rng(20240)
_A = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles. Fewer than ``k`` words are one shingle; no words, none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = _words.of(words)
    if len(hashes) < k:
        return mix64(rolling_hash(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(rolling_hash(hashes, k))


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set: floor(1 - log_b of the smallest exponential value), cut to [0, TOP + 1].

    Register i takes the exponential values -ln(1 - u_i(x)) / RATE; the logarithm is monotone, so
    the smallest uniform value is found first. Registers of a union are the larger of both sets'.
    """
    low = np.full(REGISTERS, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[i : i + 2048, None] * _A + _B).min(axis=0))
    uniform = (low.astype(np.float64) + 0.5) / 2.0**64
    value = np.floor(1 - np.log(-np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE) / np.log(BASE))
    return np.clip(value, 0, TOP + 1).astype("<u2")


def joint_estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets of known sizes, by maximum likelihood over their registers.

    A register is larger in the left set with probability p(u - v J), in the right one with
    p(v - u J), for shares u, v of the sizes and p(x) = -log_b(1 - x (b - 1) / b). The likelihood of the
    three counts is maximised by ternary search.
    """
    more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(a, 1e-12)) + less * np.log(np.maximum(b, 1e-12)) + same * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        right_better = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(right_better, low + third, low), np.where(right_better, high, high - third)
    return (low + high) / 2


def sketches(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``_key, _row, n_shingles, set_hash, registers`` of every document; registers are null for empty sets."""
    kind = docs.select(F.col(key).alias("_key")).schema["_key"].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, hashes, regs = [], [], []
            for t in batch["_text"]:
                s = shingle_set(t)
                sizes.append(len(s))
                mixed = mix64(s + np.uint64(0x9E3779B97F4A7C15))
                hashes.append(s.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mixed, initial=0).tobytes() + mixed.sum(dtype=np.uint64).tobytes())
                regs.append(registers_of(s).tobytes() if len(s) else None)
            yield batch[["_key", "_row"]].assign(n_shingles=sizes, set_hash=hashes, registers=regs)

    base = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), row_place(docs).alias("_row"))
    return base.mapInPandas(sketch, "_key string, _row long, n_shingles long, set_hash binary, registers binary").withColumn("_key", F.col("_key").cast(kind))


def bands(reps: DataFrame) -> DataFrame:
    """``node, band``: a 64-bit hash for each of a representative's bands of register values."""
    width = 2 * ROWS
    each = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, F.lit(width))))
    return reps.select("node", F.explode(each).alias("band"))


def with_estimates(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose registers make a similarity near the threshold likely."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                left, right = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(len(batch), REGISTERS) for c in ("r_a", "r_b"))
                found = joint_estimate(left, right, batch["n_a"].to_numpy(float), batch["n_b"].to_numpy(float))
                yield batch[["a", "b"]].assign(estimate=found)[found >= PERCENT / 100 - SLACK]

    return both.mapInPandas(estimate, "a long, b long, estimate double")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets share at least ``PERCENT`` % of their union.

    ``texts`` has ``node, text``. Both texts meet the pair in two joins on node, which Spark splits where
    one node is in many pairs; a text's set is kept while its pairs come one after the other.
    """
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, None
        for batch in batches:
            keep = []
            for a, s, t in zip(batch["a"], batch["t_a"], batch["t_b"], strict=True):
                if a != last:
                    last, mine = a, shingle_set(s)
                other = shingle_set(t)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(mine) + len(other) - common))
            yield batch.loc[keep, ["a", "b"]]

    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").mapInPandas(verify, "a long, b long")


def overlap_needed(s: str, t: str):
    """How many shingles sets of these sizes must share to be similar enough: 3/7 of both sizes, for 75 %."""
    share = PERCENT / (100 + PERCENT)
    return F.ceil((F.col(s) + F.col(t)) * F.lit(share) - F.lit(1e-9))


def prefix_pairs(texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes of different components that can be similar enough, from ``node, component, text``.

    Shingles are put in one order, the rarest first. If sets of sizes s <= t must share o shingles,
    the first s - o + 1 of the one and t - o + 1 of the other share one. A near copy that lies too far from
    its hub has as many shingles of its own as its prefix is long, so a large group of near copies
    makes few pairs here. Lists of a shingle and a class of sizes (steps of 2 %) whose nodes are all in
    one component are left out before the pairs are made.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, component, text in zip(batch["node"], batch["component"], batch["text"], strict=True):
                found = shingle_set(text)
                yield pd.DataFrame({"node": node, "component": component, "size": len(found), "shingle": found.view(np.int64)})

    rows = materialize(texts.mapInPandas(explode, "node long, component long, size long, shingle long"), "shingles")
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").withColumnRenamed("shingle", "common")
    by_node = Window.partitionBy("node")
    order = by_node.orderBy("df", "shingle")
    ranked = rows.join(common, F.col("shingle") == F.col("common")).withColumn("place", F.col("size") - F.count(F.lit(1)).over(by_node) + F.row_number().over(order))
    ranked = ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * PERCENT / 100 - 1e-9) + 1)
    ranked = materialize(ranked.select("node", "component", "size", "shingle", "place", F.floor(F.log("size") / np.log(1.02)).alias("class")), "prefixes")
    index = ranked.withColumn("twin", F.col("size")).filter(F.col("place") <= F.col("size") - overlap_needed("size", "twin") + 1)
    index = index.select(F.col("node").alias("s_node"), F.col("component").alias("s_component"), F.col("size").alias("s"), F.col("shingle").alias("s_shingle"), F.col("place").alias("s_place"), F.col("class").alias("s_class"))
    lists = index.groupBy(F.col("s_shingle").alias("l_shingle"), F.col("s_class").alias("l_class")).agg(F.min("s").alias("low"), F.max("s").alias("high"), F.min("s_component").alias("c_low"), F.max("s_component").alias("c_high"))
    fits = (F.col("low") <= F.col("size")) & (F.col("high") * 100 >= F.col("size") * PERCENT) & (F.col("place") <= F.col("size") - overlap_needed("size", "low") + 1)
    other = (F.col("c_low") != F.col("component")) | (F.col("c_high") != F.col("component"))
    probes = ranked.join(lists, (F.col("shingle") == F.col("l_shingle")) & fits & other)
    sizes = (F.col("s") <= F.col("size")) & (F.col("s") * 100 >= F.col("size") * PERCENT) & (F.col("s_component") != F.col("component"))
    places = (F.col("s_place") <= F.col("s") - overlap_needed("s", "size") + 1) & (F.col("place") <= F.col("size") - overlap_needed("s", "size") + 1)
    pairs = probes.join(index, (F.col("l_shingle") == F.col("s_shingle")) & (F.col("l_class") == F.col("s_class")) & sizes & places)
    return pairs.select(F.least("node", "s_node").alias("a"), F.greatest("node", "s_node").alias("b")).distinct()


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``_key, _row, n_shingles, component_id, kept``.

    Documents with equal shingle sets are one node. Nodes that share a band are candidates. In
    each band's bucket the hub is the node that shares most bands with others; it is tried against
    every member, and components are built from the pairs that hold. What is left are members of
    different components in one bucket. Their pairs are tried in a second round, but for those whose
    rarest shingles rule it out (``prefix_pairs``), so no link is lost to the hubs, and a large group
    of near copies is joined by its hubs instead of by all its pairs.

    Null texts and texts without words have no shingles and stay alone. ``component_id`` is the
    smallest id of the component; null ids come last. Of rows with the same smallest id the first in
    reading order is kept. An empty table gives no rows.
    """
    table = materialize(sketches(docs, text, key), "sketches")
    filled = table.filter("n_shingles > 0")
    sets = filled.groupBy("set_hash", "n_shingles").agg(F.min("_row").alias("node"), F.first("registers").alias("registers"))
    reps = materialize(sets, "sets")
    banded = bands(reps)
    counted = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("band", "shared")
    members = materialize(banded.join(counted, F.col("band") == F.col("shared")).select("node", "band", "n"), "bands")
    central = members.groupBy("node").agg(F.sum("n").alias("reach")).withColumnRenamed("node", "peer")
    ranked = materialize(members.join(central, F.col("node") == F.col("peer")).select("node", "band", "n", "reach"), "ranked")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("reach", (-F.col("node")).alias("node"))).alias("hub"))
    hubs = hubs.select(F.col("band").alias("hub_band"), (-F.col("hub.node")).alias("a"))
    tried = ranked.join(hubs, (F.col("band") == F.col("hub_band")) & (F.col("node") != F.col("a"))).select("a", F.col("node").alias("b")).distinct()

    involved = members.select(F.col("node").alias("_node")).distinct()
    source = docs.select(F.col(text).alias("text"), row_place(docs).alias("node"))
    texts = materialize(source.join(involved, F.col("node") == F.col("_node"), "left_semi"), "candidates")
    links = materialize(verified(with_estimates(tried, reps), texts), "links")
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "member")

    # members of a bucket that are in different components by now; buckets of two have had their pair
    placed = members.filter("n > 2").join(groups, F.col("node") == F.col("member"), "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    open_bands = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select(F.col("band").alias("open"))
    loose = materialize(placed.join(open_bands, F.col("band") == F.col("open")).select("node", "component").distinct(), "open")
    rest = prefix_pairs(texts.join(loose.withColumnRenamed("node", "loose"), F.col("node") == F.col("loose")).select("node", "component", "text"))
    done = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    rest = rest.join(done, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")
    more = materialize(verified(with_estimates(rest, reps), texts), "links")
    groups = connected_components(links.unionByName(more), "a", "b").withColumnRenamed("node", "member")

    named = reps.join(groups, F.col("node") == F.col("member"), "left").select("set_hash", "n_shingles", F.coalesce("component", "node").alias("group"))
    named = named.withColumnsRenamed({"set_hash": "s_hash", "n_shingles": "s_size"})
    placed = table.join(named, (F.col("set_hash") == F.col("s_hash")) & (F.col("n_shingles") == F.col("s_size")), "left")
    placed = placed.select("_key", "_row", "n_shingles", F.coalesce("group", "_row").alias("group"))
    first = placed.groupBy(F.col("group").alias("g")).agg(F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_row").alias("row"))).alias("first"), F.count(F.lit(1)).alias("n"))
    # groups of several come once for each share of their rows, so a large group is in many tasks
    shared = first.filter("n > 1").select("g", "first", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("s"))
    spread = placed.withColumn("share", F.pmod(F.xxhash64("_row"), F.lit(SHARES)).cast("int"))
    joined = spread.join(shared, (F.col("group") == F.col("g")) & (F.col("share") == F.col("s")), "left")
    alone = F.col("g").isNull()
    return joined.select("_key", "_row", "n_shingles", F.when(alone, F.col("_key")).otherwise(F.col("first.key")).alias("component_id"), (alone | (F.col("_row") == F.col("first.row"))).alias("kept"))


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", stable: bool = False) -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies: that of the smallest id."""
    docs = docs if stable else materialize(docs, "docs")
    row = fresh_name(docs, "row_number")
    kept = near_classes(docs, text, key).filter("kept").select(F.col("_row").alias(row))
    return docs.withColumn(row, row_place(docs)).join(kept, row, "left_semi").drop(row)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(read(spark, sf_dir, "documents"))
    return out.select(F.col("_key").alias("doc_id"), "n_shingles", "component_id", "kept")
