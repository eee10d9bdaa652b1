"""Ranked lexical search: the three phases of TPUT over postings that are dealt by term.

Heads of all lists give each item a lower bound of its k-th best score. A document that reaches it has the bound's share of one list at least, so
every list is cut at that share, and the documents left in any of an item's lists are looked up and scored exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from barloom.llm.packing import ragged
from barloom.llm.shared import drop_table, materialize, read, row_place, shuffle_width

TOP = 20
#: Postings that phase one takes from the head of each list.
HEAD = 64
#: Documents of a block, and the occurrences after which one ends early.
BLOCK, BLOCK_HITS = 2048, 1 << 20
#: Read partitions of a piece of the lists, blocks of a partition that it has at most, and tasks that a piece's lists are dealt to.
PIECE_PARTS, PIECE, DEALT = 8, 64, 8
#: Terms of items that one pass over the documents serves; more items go to further passes.
PASS_TERMS = 200_000
#: ASCII letters lower-cased, other ASCII characters but digits as spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, only A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(LETTERS).split() if isinstance(text, str) else []


@dataclass
class Items:
    """The items of a pass: each one's terms and how often it has them, and each term's items."""

    counts: list[Counter]
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    docs: int = 0
    words: int = 0

    def __post_init__(self) -> None:
        self.code = {t: i for i, t in enumerate(sorted({t for c in self.counts for t in c}))}
        self.terms = [np.array(sorted(self.code[t] for t in c), np.int64) for c in self.counts]
        known = list(self.code)
        self.times = [np.array([c[known[i]] for i in t], np.int64) for c, t in zip(self.counts, self.terms, strict=True)]
        pairs = np.concatenate([np.empty(0, np.int64), *self.terms])
        order = np.argsort(pairs, kind="stable")
        self.pair_item = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])[order]
        self.pair_times = np.concatenate([np.empty(0, np.int64), *self.times])[order]
        self.first = np.searchsorted(pairs[order], np.arange(len(self.code) + 1))

    def weigh(self, found: dict[int, int]) -> None:
        """Take the counts of documents and words, under -1 and -2, and of each term's documents; a term that none has weighs nothing."""
        self.docs, self.words = found.get(-1, 0), found.get(-2, 0)
        n = self.docs
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * found[i] + 1))) if i in found else 0 for i in range(len(self.code))], np.int64)

    def lists(self, item: int) -> np.ndarray:
        """The item's terms that can score, by place in ``terms``."""
        return np.flatnonzero(self.weight[self.terms[item]] > 0)

    def cuts(self, bounds: dict[int, int]) -> np.ndarray:
        """The least impact that a posting needs, for each pair of term and item: the bound over the item's lists, over the term's worth."""
        lists = [max(1, len(self.lists(i))) for i in range(len(self.terms))]
        codes = np.repeat(np.arange(len(self.code)), np.diff(self.first))
        least = [-(-bounds.get(i, 0) // (lists[i] * q * w)) if (w := int(self.weight[c])) > 0 else 1 << 62 for c, i, q in zip(codes.tolist(), self.pair_item.tolist(), self.pair_times.tolist(), strict=True)]
        return np.array([max(1, x) for x in least], np.int64)


@dataclass
class Block:
    """Postings of some documents by term: the terms, how many documents each has, and their numbers and counts one term after the other."""

    codes: np.ndarray
    counts: np.ndarray
    local: np.ndarray
    times: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(*(np.frombuffer(row[c], t) for c, t in (("codes", "<i4"), ("counts", "<i4"), ("local", "<u2"), ("times", "<i4"))), np.array(row["words"], np.int64))

    def impacts(self, docs: int, words: int) -> np.ndarray:
        """(10^9 tf) div (1000 tf + 12 m) of each posting, m = 75 + (25 n N) div L of its document."""
        m = np.array([75 + 25 * n * docs // words for n in self.words.tolist()], np.int64)
        tf = self.times.astype(np.int64)
        return 10**9 * tf // (1000 * tf + 12 * m[self.local])

    def scores(self, items: Items, item: int, wanted: np.ndarray, impacts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The item's exact scores of the ``wanted`` documents, 0 for the others."""
        terms, times = items.terms[item], items.times[item]
        at = np.minimum(np.searchsorted(self.codes, terms), max(0, len(self.codes) - 1))
        held = np.flatnonzero(self.codes[at] == terms) if len(self.codes) else np.empty(0, np.int64)
        counts = self.counts[at[held]].astype(np.int64)
        postings = ragged(starts[at[held]], counts)
        worth = np.repeat(times[held] * items.weight[terms[held]], counts)
        keep = wanted[self.local[postings]]
        postings, worth = postings[keep], worth[keep]
        out = np.zeros(len(wanted), np.int64)
        np.add.at(out, self.local[postings], worth * impacts[postings])
        return out


INDEX = [("codes", "<i4"), ("counts", "<i4"), ("local", "<u2"), ("times", "<i4")]


def blocks_of(docs: DataFrame, items: Items, text: str, key: str) -> DataFrame:
    """Blocks of documents with the postings of the items' terms, and from each task a row, without ``block``, of the terms' documents.

    ``keys`` are a block's ids and ``words`` their numbers of terms; in a task's row ``words`` are its documents with terms and
    all their terms.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType
    schema = StructType([StructField("block", LongType()), StructField("keys", ArrayType(kind)), StructField("words", ArrayType(LongType())), *[StructField(c, BinaryType()) for c, _ in INDEX]])
    known = items.code

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of, part, number = known.get, TaskContext.get().partitionId(), 0
        held, total = np.zeros(len(known), np.int64), [0, 0]
        keys, words, hits, size = [], [], [], 0

        def row(block: int | None, ids: pa.Array, sizes: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            blobs = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, (_, t) in zip(arrays, INDEX, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), lists, pa.array([sizes], pa.list_(pa.int64())), *blobs], schema.names)

        def block() -> pa.RecordBatch:
            both = np.concatenate([np.empty(0, np.int64), *hits])
            found, times = np.unique(both, return_counts=True)
            codes, counts = np.unique(found // BLOCK, return_counts=True)
            held[codes] += counts
            ids = pa.concat_arrays([x.cast(keys[0].type) for x in keys])
            return row((part << 32) + number, ids, words, [codes, counts, found % BLOCK, times])

        for batch in batches:
            none = batch.column(0).slice(0, 0)
            for i, text in enumerate(batch.column(1)):
                terms = terms_of(text.as_py())
                codes = np.fromiter(map(code_of, terms, repeat(-1)), np.int64, len(terms))
                codes = codes[codes >= 0]
                total[0] += len(terms) > 0
                total[1] += len(terms)
                keys.append(batch.column(0).slice(i, 1))
                hits.append(codes * BLOCK + len(words))
                words.append(len(terms))
                size += len(codes)
                if len(words) == BLOCK or size >= BLOCK_HITS:
                    yield block()
                    keys, words, hits, size, number = [], [], [], 0, number + 1
        if words:
            yield block()
        if total[0]:
            codes = np.flatnonzero(held)
            yield row(None, none, total, [codes, held[codes], codes[:0], codes[:0]])

    return rows.mapInArrow(index, schema)


def term_counts(blocks: DataFrame) -> dict[int, int]:
    """Each term's number of documents; under -1 all documents with terms, under -2 all terms. A row for each term of the pass."""

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for words, codes, counts in zip(part["words"], part["codes"], part["counts"], strict=True):
                yield pd.DataFrame({"code": np.append(np.frombuffer(codes, "<i4"), [-1, -2]), "n": np.append(np.frombuffer(counts, "<i4"), words).astype(np.int64)})

    rows = blocks.filter("block is null").select("words", "codes", "counts").mapInPandas(spread, "code int, n long")
    return {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def postings_of(blocks: DataFrame, items: Items) -> DataFrame:
    """Postings dealt by term: ``piece, dealt, block, code, local, impact``, a row for a term and a block.

    A piece is the lists' share of some blocks, those of ``PIECE_PARTS`` partitions as they were read, so the list of a word that every
    document has is dealt to many tasks, and what a task gets doesn't grow with the table.
    """
    docs, words = items.docs, items.words

    def lists(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                block = Block.of(row)
                impacts, ends = block.impacts(docs, words).astype("<i4"), np.cumsum(block.counts)
                cuts = list(zip((ends - block.counts).tolist(), ends.tolist(), strict=True))
                yield pd.DataFrame({"block": row["block"], "code": block.codes, "local": [block.local[a:b].tobytes() for a, b in cuts], "impact": [impacts[a:b].tobytes() for a, b in cuts]})

    rows = blocks.filter("block is not null").select("block", "words", *[c for c, _ in INDEX]).mapInPandas(lists, "block long, code int, local binary, impact binary")
    part, number = F.shiftright("block", 32), F.pmod("block", F.lit(1 << 32))
    by = [F.hash(F.floor(part / PIECE_PARTS), F.floor(number / PIECE)).alias("piece"), F.pmod(F.hash("code"), F.lit(DEALT)).alias("dealt")]
    rows = rows.select(*by, "block", "code", "local", "impact")
    return rows.repartition(shuffle_width(blocks.sparkSession), "piece", "dealt").sortWithinPartitions("piece", "dealt", "block", "code")


def heads(postings: DataFrame, head: int = HEAD) -> DataFrame:
    """The ``head`` postings of the greatest impact of each list, ties by place: ``code, block, local``; each task sends as many of its part of a list."""

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for part in parts:
            for code, block, local, impact in zip(part["code"], part["block"], part["local"], part["impact"], strict=True):
                impact, local = np.frombuffer(impact, "<i4"), np.frombuffer(local, "<u2")
                top = np.argsort(-impact, kind="stable")[:head]
                old = held.get(code)
                new = (impact[top], np.full(len(top), block), local[top].astype(np.int32))
                if old is not None:
                    if len(old[0]) == head and new[0][0] < old[0][-1]:
                        continue
                    new = tuple(np.concatenate([a, b]) for a, b in zip(old, new, strict=True))
                    order = np.lexsort((new[2], new[1], -new[0]))[:head]
                    new = tuple(x[order] for x in new)
                held[code] = new
        for code, (impact, block, local) in held.items():
            yield pd.DataFrame({"code": code, "impact": impact, "block": block, "local": local})

    rows = postings.select("code", "block", "local", "impact").mapInPandas(best, "code int, impact int, block long, local int")
    order = Window.partitionBy("code").orderBy(F.desc("impact"), "block", "local")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= head).select("code", "block", "local")


def lower_bounds(blocks: DataFrame, head: DataFrame, items: Items, top: int) -> dict[int, int]:
    """The ``top``-th best score that the documents of an item's heads have, looked up whole; an item with fewer has none."""
    docs, words = items.docs, items.words

    def look_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                block = Block.of(row)
                impacts, starts, found = block.impacts(docs, words), np.cumsum(block.counts) - block.counts, []
                codes, local = (np.array([x[c] for x in row["heads"]], np.int64) for c in ("code", "local"))
                times = items.first[codes + 1] - items.first[codes]
                item, place = items.pair_item[ragged(items.first[codes], times)], np.repeat(local, times)
                for i in np.unique(item).tolist():
                    wanted = np.zeros(len(block.words), bool)
                    wanted[place[item == i]] = True
                    scores = block.scores(items, i, wanted, impacts, starts)
                    found.append(pd.DataFrame({"item": i, "score": -np.sort(-scores[scores > 0])[:top]}))
                if found:
                    yield pd.concat(found)

    grouped = head.groupBy("block").agg(F.collect_list(F.struct("code", "local")).alias("heads"))
    index = blocks.filter("block is not null").select("block", "words", *[c for c, _ in INDEX])
    rows = index.join(grouped, "block").mapInPandas(look_up, "item int, score long")
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("_n") <= top)
    return {r["item"]: r["score"] for r in best.filter(F.col("_n") == top).select("item", "score").collect()}


def candidates(postings: DataFrame, items: Items, bounds: dict[int, int]) -> DataFrame:
    """``block, item, docs``: the documents, as bits, of which one of the item's postings reaches its cut."""
    cuts = items.cuts(bounds)

    def packed(block: int, seen: dict[int, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"block": block, "item": list(seen), "docs": [np.packbits(x).tobytes() for x in seen.values()]})

    def reach(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen = None, {}
        for part in parts:
            for block, code, local, impact in zip(part["block"], part["code"], part["local"], part["impact"], strict=True):
                if block != at:
                    if seen:
                        yield packed(at, seen)
                    at, seen = block, {}
                impact, local = np.frombuffer(impact, "<i4"), np.frombuffer(local, "<u2")
                most = int(impact.max())
                for pair in range(items.first[code], items.first[code + 1]):
                    if cuts[pair] <= most:
                        item = int(items.pair_item[pair])
                        if item not in seen:
                            seen[item] = np.zeros(BLOCK, bool)
                        seen[item][local[impact >= cuts[pair]]] = True
        if seen:
            yield packed(at, seen)

    return postings.select("block", "code", "local", "impact").mapInPandas(reach, "block long, item int, docs binary")


def exact_scores(blocks: DataFrame, found: DataFrame, items: Items, bounds: dict[int, int], top: int) -> DataFrame:
    """``item, _key, block, local, score`` of candidates that reach the item's bound; of a block's no more than can be among the ``top``, with ties."""
    docs, words = items.docs, items.words
    schema = StructType([StructField("item", LongType()), StructField("_key", blocks.schema["keys"].dataType.elementType), StructField("block", LongType()), StructField("local", LongType()), StructField("score", LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            for n, row in enumerate(batch.drop_columns(["keys"]).to_pylist()):
                block = Block.of(row)
                impacts, starts = block.impacts(docs, words), np.cumsum(block.counts) - block.counts
                wanted: dict[int, np.ndarray] = {}
                for x in row["found"]:
                    bits = np.unpackbits(np.frombuffer(x["docs"], np.uint8)).astype(bool)[: len(block.words)]
                    wanted[x["item"]] = wanted[x["item"]] | bits if x["item"] in wanted else bits
                out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for item, some in wanted.items():
                    scores = block.scores(items, item, some, impacts, starts)
                    reached = np.flatnonzero(scores >= max(1, bounds.get(item, 1)))
                    if len(reached) > top:
                        reached = reached[scores[reached] >= np.partition(scores[reached], -top)[-top]]
                    for part, x in zip(out, (np.full(len(reached), item), reached, scores[reached]), strict=True):
                        part.append(x)
                item, local, score = map(np.concatenate, out)
                ids = keys.slice(n, 1).flatten().take(pa.array(local))
                yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(np.full(len(local), row["block"])), pa.array(local), pa.array(score)], schema.names)

    grouped = found.groupBy("block").agg(F.collect_list(F.struct("item", "docs")).alias("found"))
    index = blocks.filter("block is not null")
    return index.join(grouped, "block").select("block", "keys", "words", *[c for c, _ in INDEX], "found").mapInArrow(look_up, schema)


def one_pass(docs: DataFrame, items: Items, top: int, head: int, text: str, key: str) -> DataFrame | None:
    """``item, rank, _key, score`` of some items; None if no document has any of their terms."""
    blocks = materialize(blocks_of(docs, items, text, key), "blocks")
    items.weigh(term_counts(blocks))
    if not items.words:
        drop_table(blocks)
        return None
    postings = materialize(postings_of(blocks, items), "postings")
    bounds = lower_bounds(blocks, heads(postings, head), items, top)
    scored = exact_scores(blocks, candidates(postings, items, bounds), items, bounds, top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("_key").asc_nulls_last(), "block", "local")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = materialize(ranked.select("item", "rank", "_key", "score"), "ranked")
    drop_table(blocks)
    drop_table(postings)
    return out


def ranked_search(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id", query_text: str = "text", query_key: str = "item_id", top: int = TOP, head: int = HEAD) -> DataFrame:
    """Each query's ``top`` documents of the greatest score above 0: ``_query, rank, _key, score``, ties by key, null keys last, then by place.

    A null text has no terms and a query without terms no rows; repeated rows are queries and documents of their own. Texts are
    read whole. No documents, or no queries, give no rows. Other columns aren't looked at, whatever their names. Queries
    are served in passes over the documents of about ``PASS_TERMS`` terms each, so what tasks hold of them is bounded.
    """
    spark = docs.sparkSession

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(terms=[len(set(terms_of(t))) for t in part["text"]])

    place = queries.select(F.col(query_text).alias("text"), row_place(queries).alias("place"))
    total = place.mapInPandas(counted, "text string, place long, terms long").agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    passes = max(1, -(-total // PASS_TERMS))
    rows = queries.select(F.col(query_key).alias("_query"), F.col(query_text).alias("_text"), row_place(queries).alias("_place"))
    kind, parts = rows.schema["_query"], []
    for n in range(passes):
        some = rows.filter(F.pmod(F.xxhash64("_place"), F.lit(passes)) == n).orderBy("_place").collect()
        found = one_pass(docs, Items([Counter(terms_of(r["_text"])) for r in some]), top, head, text, key) if some else None
        if found is not None:
            named = spark.createDataFrame([(i, r["_query"]) for i, r in enumerate(some)], StructType([StructField("item", LongType()), kind]))
            parts.append(found.join(named, "item").select("_query", "rank", "_key", "score"))
    none = StructType([kind, StructField("rank", LongType()), StructField("_key", docs.schema[key].dataType), StructField("score", LongType())])
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], none).withColumn("rank", F.col("rank").cast("int"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("_query").alias("item_id"), "rank", F.col("_key").alias("doc_id"), "score")


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), al AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, al GROUP BY term, n_docs),
m AS (SELECT doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM len, al),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term) JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0) WHERE k <= 20
"""
