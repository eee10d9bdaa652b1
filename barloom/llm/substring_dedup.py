"""Substring dedup: shared k-mer seeds, collinear chains through a Fenwick tree, aligned passages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.shared import WordHashes, drop_table, materialize, mix64, read, rolling_hash, row_place, words_of

#: Words of a seed, and seeds of which the one of smallest hash is kept: any 19 equal words share a seed.
SEED_WORDS, WINDOW = 8, 12
#: Least words and least share of equal words of a passage.
MIN_WORDS, IDENTITY = 50, 0.75
#: Cost of each word of a gap, on either side; a seed is worth its words.
GAP_COST = 0.1
#: Words by which a chain's ends may grow at first, and how much farther those that are still alike there may at the next step.
REACH, FARTHER = 64, 16
#: Chains that are joined with the texts by broadcast, at 48 bytes each; beyond, both sides are shuffled.
FEW = 500_000
#: Words that runs of seeds cover, at least. Any 50 equal words hold a run of 28, as their outer seeds lie at most
#: 11 words within, and any 72 equal words hold one of 50.
RUN_WORDS = (MIN_WORDS - 2 * (WINDOW - 1), 39, MIN_WORDS)
#: Words within which an equal seed counts as said again, as in a word or phrase repeated over and over.
AGAIN = 2 * WINDOW

_words = WordHashes()


def extremes(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[: len(values) - step], values[step:])
        done += step
    return values


def minimizers(hashes: np.ndarray, k: int = SEED_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds of a text: in every run of ``window`` k-mers the smallest, all of equals."""
    seeds = rolling_hash(hashes, k)
    if not len(seeds):
        return np.empty(0, np.int64), seeds
    if len(seeds) <= window:
        at = np.flatnonzero(seeds == seeds.min())
    else:
        least = extremes(seeds, window, np.minimum)
        edge = np.zeros(window - 1, np.uint64)  # a k-mer is a seed if it's the least of a run that holds it
        at = np.flatnonzero(extremes(np.concatenate([edge, least, edge]), window, np.maximum) == seeds)
    return at, seeds[at]


def occurrence(at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """How many equal seeds come before each, every one within ``AGAIN`` words of the next.

    So a word said over and over makes seeds that rise in both texts, and a second copy of a passage has the first one's seeds.
    """
    order = np.lexsort((at, seeds))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(seeds[order]) != 0) | (np.diff(at[order]) > AGAIN)])) if len(seeds) else np.empty(0, np.int64)
    out = np.empty(len(seeds), np.uint64)
    out[order] = np.arange(len(seeds)) - np.repeat(new, np.diff(np.append(new, len(seeds))))
    return out


def runs(row: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which seeds start a run, and the run's hash: from each seed the shortest runs that cover ``RUN_WORDS`` words.

    Seeds come in order of row and place. Neighbours in a run lie at most ``WINDOW`` words apart, as they do in equal words.
    Where parts of a passage have different first holders, the runs across the seam have the first holder of the whole.
    """
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    step = np.append(0, np.diff(at))
    cut = np.concatenate([[True], (np.diff(row) != 0) | (step[1:] > WINDOW)])
    stretch = np.cumsum(cut) - 1
    line = at - at[np.flatnonzero(cut)[stretch]] + np.concatenate([[0], np.cumsum((np.diff(np.append(np.flatnonzero(cut), len(at))) + 1) * WINDOW)])[stretch]
    starts, found, before = [], [], np.full(len(at), -1)
    for words in RUN_WORDS:
        end = np.minimum(np.searchsorted(line, line + words - SEED_WORDS), len(at) - 1)
        full = np.flatnonzero((stretch[end] == stretch) & (line[end] - line >= words - SEED_WORDS) & (end > before))
        before[full] = end[full]
        value = seeds[full] + np.uint64(words)
        for k in range(1, int((end[full] - full).max()) + 1 if len(full) else 0):
            on = full + k <= end[full]
            i = full[on] + k
            value[on] = mix64(value[on] * np.uint64(0x9E3779B97F4A7C15) + seeds[i] + step[i].astype(np.uint64))
        starts.append(full)
        found.append(mix64(value ^ np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(starts), np.concatenate(found)


def seed_table(docs: DataFrame, text: str) -> DataFrame:
    """``row, pos, seed`` of every document's seeds; ``row`` is the document's place in the table."""

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, places, found = [], [], []
            for row, t in zip(batch["row"], batch["_text"], strict=True):
                at, seed = minimizers(_words.of(words_of(t)))
                rows.append(np.full(len(at), row))
                places.append(at)
                found.append(mix64(seed + occurrence(at, seed)).view(np.int64))
            if rows:
                yield pd.DataFrame({"row": np.concatenate(rows), "pos": np.concatenate(places), "seed": np.concatenate(found)})

    return docs.select(row_place(docs).alias("row"), F.col(text).alias("_text")).mapInPandas(seeds, "row long, pos long, seed long")


def with_first_holder(seeds: DataFrame) -> DataFrame:
    """``row, pos, seed, source, source_pos`` of the seeds that several documents hold; ``source`` is the first of them.

    Holders are counted before the shuffle, so a seed that most documents hold is one row a task, and
    Spark splits the join where one seed has many rows.
    """
    first = seeds.groupBy("seed").agg(F.min(F.struct("row", "pos")).alias("first"), F.max("row").alias("last")).filter("first.row < last")
    first = first.select(F.col("seed").alias("shared"), F.col("first.row").alias("source"), F.col("first.pos").alias("source_pos"))
    return seeds.join(first, F.col("seed") == F.col("shared")).select("row", "pos", "seed", "source", "source_pos")


def best_chains(x: np.ndarray, y: np.ndarray, worth: float = SEED_WORDS, gap: float = GAP_COST) -> list[np.ndarray]:
    """Disjoint chains of seeds that rise in both texts, the best first.

    A chain's score is ``worth`` a seed less ``gap`` for each word between neighbours, on both sides.
    With f(i) + gap * (x + y) kept in a Fenwick tree of prefix maxima over y, the best predecessor of
    a seed is one lookup; seeds at the same x see none of each other.
    """
    order = np.lexsort((-y, x))
    x, y = x[order], y[order]
    rank = np.unique(y, return_inverse=True)[1] + 1
    size = int(rank.max())
    value, owner = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, back = np.zeros(len(x)), np.full(len(x), -1)
    for i, (a, b, r) in enumerate(zip(x.tolist(), y.tolist(), rank.tolist(), strict=True)):
        top, who, j = -np.inf, -1, r - 1
        while j > 0:
            if value[j] > top:
                top, who = value[j], owner[j]
            j -= j & -j
        joined = worth + top - gap * (a + b)
        if who >= 0 and joined > worth:
            score[i], back[i] = joined, who
        else:
            score[i] = worth
        mine, j = score[i] + gap * (a + b), r
        while j <= size:
            if mine > value[j]:
                value[j], owner[j] = mine, i
            j += j & -j
    used, chains = np.zeros(len(x), bool), []
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            chains.append(order[chain[::-1]])
    return chains


def certain(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last seeds of the stretches of chains that share enough words for a passage whatever lies between their seeds.

    Seeds come chain by chain, each told by its ``group``.
    """
    dx = np.diff(x)
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (dx != np.diff(y)) | (dx > WINDOW)]))
    last = np.append(cuts[1:], len(x)) - 1
    held = np.append(0, np.cumsum(np.minimum(dx, SEED_WORDS)))
    span = x[last] - x[cuts] + SEED_WORDS
    sure = (span >= MIN_WORDS) & (held[last] - held[cuts] + SEED_WORDS >= IDENTITY * span)
    return cuts[sure], last[sure]


def chained(shared: DataFrame, with_runs: bool) -> DataFrame:
    """Chains of the seeds that a document shares with the first holder of each: ``row, source, x0, x1, y0, y1, seeds``.

    A task gets all matches of a document, which are as many as its seeds, and takes one pair of
    documents after the other. With ``with_runs``, rows of ``seeds`` 0 hold the runs of those seeds that no chain explains,
    the first holders' own among them: ``x0`` is the run's place and ``x1`` its hash.
    """

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
            open_row = batch["row"].iloc[-1] if len(batch) else None
            closed = int(np.searchsorted((batch["row"].to_numpy() == open_row).astype(int), 1)) if len(batch) else 0
            rest = batch.iloc[closed:]
            yield of_rows(batch.iloc[:closed])
        if rest is not None:
            yield of_rows(rest)

    def of_rows(some: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("row", "source", "x0", "x1", "y0", "y1", "seeds")})
        row, source, x, y, seed = (some[c].to_numpy() for c in ("row", "source", "pos", "source_pos", "seed"))
        other = np.concatenate([[True], (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        row, source, x, y, seed = row[other], source[other], x[other], y[other], seed[other]  # several runs may name the same places
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (source[1:] != source[:-1])]))
        ends = np.append(new[1:], len(row))
        mine = np.repeat(np.arange(len(new)), ends - new)
        dx, dy = np.diff(x), np.diff(y)
        bent = (np.diff(mine) == 0) & ((dx != dy) | (dx <= 0) | (2 * GAP_COST * dx >= SEED_WORDS))
        other = row[new] != source[new]
        straight = other & (np.bincount(mine[1:], weights=bent, minlength=len(new)) == 0)  # one chain, as each seed gains by joining
        chains = [np.flatnonzero(straight[mine])]
        names = [mine[chains[0]]]
        for g in np.flatnonzero(other & ~straight).tolist():
            for chain in best_chains(x[new[g] : ends[g]], y[new[g] : ends[g]]):
                names.append(np.full(len(chain), len(new) + len(names)))
                chains.append(new[g] + chain)
        at, name = np.concatenate(chains), np.concatenate(names)
        cut = np.flatnonzero(np.diff(name, prepend=-1, append=-1) != 0)
        i, j = at[cut[:-1]], at[cut[1:] - 1]
        out = {"row": row[i], "source": source[i], "x0": x[i], "x1": x[j] + SEED_WORDS, "y0": y[i], "y1": y[j] + SEED_WORDS, "seeds": np.diff(cut)}
        explained = []
        if with_runs and len(at):
            low, high = certain(name, x[at], y[at])
            explained = [row[at[low]], x[at[low]], x[at[high]]]
        parts = [pd.DataFrame(out)]
        if with_runs:
            order = np.lexsort((x, row))
            row, x, seed = row[order], x[order], seed[order]
            known = np.zeros(len(row) + 1, np.int64)
            if len(explained) and len(explained[0]):
                r, low, high = explained
                name, code = np.unique(row, return_inverse=True)
                width = int(x.max()) + 2
                key, r = code * width + x, np.searchsorted(name, r) * width
                np.add.at(known, np.searchsorted(key, r + low), 1)
                np.add.at(known, np.searchsorted(key, r + high, side="right"), -1)
            left = np.cumsum(known)[:-1] == 0
            row, x, seed = row[left], x[left], seed[left]
            start, run = runs(row, x, seed.view(np.uint64))
            parts.append(pd.DataFrame({"row": row[start], "source": -1, "x0": x[start], "x1": run.view(np.int64), "y0": 0, "y1": 0, "seeds": 0}))
        return pd.concat(parts, ignore_index=True).astype("int64")

    dealt = shared.repartition("row").sortWithinPartitions("row", "source", "pos", "source_pos")
    return dealt.mapInPandas(chains, "row long, source long, x0 long, x1 long, y0 long, y1 long, seeds long")


def grown(a: np.ndarray, b: np.ndarray) -> tuple[int, bool]:
    """How many words two texts stay alike, and whether that ended: the best prefix by 1 for an equal word and -2 for another, ended 24 below its best."""
    n = min(len(a), len(b))
    if not n:
        return 0, False
    run = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    low = np.flatnonzero(run < np.maximum.accumulate(run) - 24)
    run = run[: low[0]] if len(low) else run
    best = int(np.argmax(run)) if len(run) else 0
    return best + 1 if len(run) and run[best] > 0 else 0, bool(len(low))


def equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words that align: on the diagonal if lengths agree, else the longest common subsequence in a band."""
    straight = int((a == b).sum()) if len(a) == len(b) else 0
    if straight >= 0.9 * max(len(a), len(b)):
        return straight
    band = abs(len(a) - len(b)) + 24
    before = np.zeros(len(b) + 1, np.int64)
    for i in range(len(a)):
        centre = i * len(b) // max(1, len(a))
        low, high = max(0, centre - band), min(len(b), centre + band)
        now = before.copy()
        hit = before[low:high] + (b[low:high] == a[i])
        now[low + 1 : high + 1] = np.maximum(now[low + 1 : high + 1], hit)
        now[low:] = np.maximum.accumulate(now[low:])
        before = now
    return max(straight, int(before[-1]))


def aligned(chains: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Chains grown at both ends and verified: ``row, source, start, end, source_start, source_end, equal``.

    Ends grow until the texts differ or one of them ends. Chains of which an end is still alike at the last word that was cut out are
    aligned once more with ``FARTHER`` times as many, again and again; there are few, and fewer each time.
    """
    done, reach, few = [], REACH, False
    while True:
        step = materialize(aligned_within(chains, docs, text, reach, few), "aligned")
        done.append(step.filter("open = 0").drop("open"))
        chains = materialize(run_together(step.filter("open > 0"), reach), "open")
        left = chains.count()
        if not left:
            return reduce(DataFrame.unionByName, done)
        few, reach = left <= FEW, reach * FARTHER


def run_together(chains: DataFrame, reach: int) -> DataFrame:
    """Open chains of two documents as one where they are alike all the way from one to the next, with the same offset."""
    same = Window.partitionBy("row", "source", F.col("start") - F.col("source_start"), F.col("end") - F.col("source_end")).orderBy("start", "end")
    met = (F.col("start") - F.lag("end").over(same) <= reach) & ((F.lag("open").over(same) >= 2) | (F.col("open") % 2 == 1)) & (F.col("end") - F.col("start") == F.col("source_end") - F.col("source_start"))
    rows = chains.withColumn("_new", F.when(met, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("row", "source", F.col("start") - F.col("source_start"), F.col("end") - F.col("source_end"), "_run")
    return rows.agg(F.min("start").alias("x0"), F.max("end").alias("x1"), F.min("source_start").alias("y0"), F.max("source_end").alias("y1")).select("row", "source", "x0", "x1", "y0", "y1")


def aligned_within(chains: DataFrame, docs: DataFrame, text: str, reach: int, few: bool = False) -> DataFrame:
    """As ``aligned``, with at most ``reach`` words at each end; chains that need more come as they are, ``open`` to the left (1), right (2) or both (3).

    A ``few`` chains go to the texts, and what is cut out for each is joined; else the texts are shuffled to the chains.
    """
    texts = docs.select(row_place(docs).alias("t_row"), F.col(text).alias("_text"))
    columns = ["row", "source", "x0", "x1", "y0", "y1"]
    kinds = ", ".join(f"{c} long" for c in columns)

    def cutter(first: str, last: str, name: str, rest: list[str]):
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, hashes = None, None
            for batch in batches:
                out = []
                for row, a, b, t in zip(batch["t_row"], batch[first], batch[last], batch["_text"], strict=True):
                    if row != held:
                        held, hashes = row, _words.of(words_of(t)).astype(np.uint32)
                    out.append(hashes[max(0, a - reach) : b + reach].tobytes())
                yield batch[columns + rest].assign(**{name: out})

        return cut

    asked = F.broadcast(chains) if few else chains
    mine = asked.join(texts, F.col("row") == F.col("t_row")).mapInPandas(cutter("x0", "x1", "mine", []), f"{kinds}, mine binary")
    if few:
        both = mine.join(asked.join(texts, F.col("source") == F.col("t_row")).mapInPandas(cutter("y0", "y1", "other", []), f"{kinds}, other binary"), columns)
    else:
        both = mine.join(texts, F.col("source") == F.col("t_row")).mapInPandas(cutter("y0", "y1", "other", ["mine"]), f"{kinds}, mine binary, other binary")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                a, b = np.frombuffer(r.mine, np.uint32), np.frombuffer(r.other, np.uint32)
                i, j = min(r.x0, reach), min(r.y0, reach)
                p, q = i + r.x1 - r.x0, j + r.y1 - r.y0
                (left, left_ended), (right, right_ended) = grown(a[:i][::-1], b[:j][::-1]), grown(a[p:], b[q:])
                more = (not left_ended and r.x0 > reach < r.y0) + 2 * (not right_ended and min(len(a) - p, len(b) - q) >= reach)
                if more:
                    out.append((r.row, r.source, r.x0, r.x1, r.y0, r.y1, 0, more))
                    continue
                inner = equal_words(a[i - left : p + right], b[j - left : q + right])
                size = max(p - i, q - j) + left + right
                if size >= MIN_WORDS and inner >= IDENTITY * size:
                    out.append((r.row, r.source, r.x0 - left, r.x1 + right, r.y0 - left, r.y1 + right, inner, 0))
            yield pd.DataFrame(out, columns=["row", "source", "start", "end", "source_start", "source_end", "equal", "open"]).astype("int64")

    return both.mapInPandas(align, "row long, source long, start long, end long, source_start long, source_end long, equal long, open long")


def outermost(found: DataFrame) -> DataFrame:
    """Passages that lie within no other of the same two documents, as several chains may grow to one passage."""
    other = found.select(*[F.col(c).alias(f"o_{c}") for c in found.columns])
    same = (F.col("row") == F.col("o_row")) & (F.col("source") == F.col("o_source"))
    inside = (F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end")) & (F.col("o_source_start") <= F.col("source_start")) & (F.col("source_end") <= F.col("o_source_end"))
    bounds = ["start", "end", "source_start", "source_end"]
    differs = F.struct(*bounds) != F.struct(*[f"o_{c}" for c in bounds])
    return found.join(other, same & inside & differs, "left_anti").dropDuplicates(["row", "source", *bounds])


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", stable: bool = False) -> DataFrame:
    """Fuzzy passages of at least ``MIN_WORDS`` words that a document shares with an earlier one.

    ``_key, source_key, start, end, source_start, source_end, equal``: word offsets in both documents
    and the number of words that align. A seed's occurrences are linked to the first document that
    holds it instead of to each other, so a passage of n documents makes n - 1 rows; the other pairs
    follow through the first holder. Seeds that no sure chain explains, as where parts of a passage were held before by
    different documents, are linked once more by runs of them, each to the run's first holder. Of passages of two documents,
    those within another are left out. A passage that a document holds twice is found twice; repeats of a document's own words
    are left alone. Null, empty and short texts have no seeds; repeated rows are copies of the first. Very long texts are
    read whole; columns besides ``text`` and ``key`` aren't looked at, whatever their names. An empty table gives no rows.
    """
    docs = docs if stable else materialize(docs, "docs")
    seeds = materialize(seed_table(docs, text), "seeds")
    shared = materialize(with_first_holder(seeds), "shared")
    drop_table(seeds)
    linked = materialize(chained(shared, True), "chains")
    drop_table(shared)
    left = with_first_holder(linked.filter("seeds = 0").select("row", F.col("x0").alias("pos"), F.col("x1").alias("seed")))
    more = chained(left.filter("row <> source"), False)
    chains = materialize(linked.filter("seeds > 0").unionByName(more).select("row", "source", "x0", "x1", "y0", "y1").distinct(), "chains")
    drop_table(linked)
    found = aligned(chains, docs, text)
    found = materialize(found.distinct(), "passages")
    found = outermost(found)
    ids = docs.select(row_place(docs).alias("i_row"), F.col(key).alias("_key"))
    names = ids.withColumnsRenamed({"i_row": "s_row", "_key": "source_key"})
    return found.join(ids, F.col("row") == F.col("i_row")).join(names, F.col("source") == F.col("s_row")).select("_key", "source_key", "start", "end", "source_start", "source_end", "equal")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(read(spark, sf_dir, "documents"), stable=True)
    return out.withColumnsRenamed({"_key": "doc_id", "source_key": "source_doc_id"})
