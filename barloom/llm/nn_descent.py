"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import shared
from barloom.llm.shared import drop_table, read, ship, shuffle_width

#: Neighbours of a node, random orders that start the graph, rows of a run of an order.
NEIGHBOURS, ORDERS, RUN = 32, 6, 192
#: NN-descent ends with a round that brings at most this share of new edges.
DELTA = 0.01
#: Neighbours that a node takes from one meeting.
MEET = 12
#: Best nodes that a walk leaves at first, and of those the ones that it leaves in a step.
BEAM, STRIDE = 96, 64
#: Queries whose true neighbours are found by scanning all rows, and the share of them that walks must find; else the beam grows.
SAMPLE, TARGET = 64, 0.95
#: Nodes from which every walk starts, besides its own.
STARTS = 16
#: Nodes of a block at most on average, blocks of a smaller table; a node's number is its block times SLOTS and its place there.
BLOCK, BLOCKS, SLOTS = 3072, 32, 8192
#: What blocks tell each other: packed arrays, one row for each pair of blocks.
MESSAGE = "to int, sender int, kind int, a binary, b binary, c binary, d binary"
COLUMNS = [x.split()[0] for x in MESSAGE.split(", ")]
GRAPH = "block int, edges long, fresh long, degrees binary, others binary, nears binary, news binary"
#: Nodes that a walk remembers having measured, the latest; one measured before may be measured again. Groups of nodes or walks of a smaller table.
SEEN, GROUPS = 8192, 6


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``shared.materialize``, whose shuffle files go when the table is written; else those of all rounds would stay until the driver collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return shared.materialize(df, name)
    finally:
        conf.set(key, before)


def usable(vectors: DataFrame, vector: str, key: str, size: int | None = None) -> DataFrame:
    """``id, vec`` of rows that take part: not null, no null or non-finite component, not zero, of the given length."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter("id is not null and vec is not null")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.filter(fine)
    return rows if size is None else rows.filter(F.size("vec") == size)


def commonest_length(rows: DataFrame) -> int:
    """The length that most vectors have, the smallest of ties."""
    row = rows.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    return row["size"] if row else 0


def matrix(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f4").reshape(len(blobs), -1)


def with_unit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` and, as ``unit``, their ``vec`` of length 1 as 32-bit floats."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["vec"].to_numpy())
                vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                yield batch[columns].assign(unit=[v.tobytes() for v in vectors.astype("<f4")])

    return rows.select(*columns, "vec").mapInPandas(convert, f"{kinds}, unit binary")


def distinct_vectors(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """One node for each distinct vector, ``node, unit``, named by its smallest id; and its ``most`` smallest ids, ``node, id``.

    Ties go to smaller ids, so no more than those can be among a query's nearest.
    """
    same = Window.partitionBy("vec").orderBy("id")
    ranked = rows.withColumn("rank", F.row_number().over(same)).filter(F.col("rank") <= most).withColumn("node", F.min("id").over(Window.partitionBy("vec")))
    ranked = materialize(ranked, "vectors")
    return materialize(with_unit(ranked.filter("rank = 1"), ["node"]), "nodes"), ranked.select("node", "id")


def packed(nodes: DataFrame) -> DataFrame:
    """``block, ids, units``: nodes dealt by a hash of their names, a row for each block, in order of names."""
    total = nodes.count()
    blocks = max(-(-total // BLOCK), min(BLOCKS, -(-total // 1024)), 1)

    if blocks * SLOTS > 1 << 32:
        raise ValueError("more nodes than 32-bit numbers")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > SLOTS:
            raise ValueError("a block has more nodes than numbers")
        rows = rows.sort_values("node")
        return pd.DataFrame({"block": [key[0]], "ids": [rows["node"].to_numpy(np.int64).tobytes()], "units": [b"".join(rows["unit"])]})

    dealt = nodes.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), "node", "unit").repartition(blocks, "block")
    return materialize(dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, units binary"), "blocks")


def numbers(blocks: DataFrame) -> DataFrame:
    """``number, name``: every node's number and name."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, ids in zip(batch["block"], batch["ids"], strict=True):
                names = np.frombuffer(ids, np.int64)
                yield pd.DataFrame({"number": block * SLOTS + np.arange(len(names)), "name": names})

    return blocks.select("block", "ids").mapInPandas(unpack, "number long, name long")


def message(to: int, sender: int, kind: int, *arrays: np.ndarray | bytes) -> tuple:
    blobs = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return (int(to), int(sender), kind, *blobs, *[None] * (4 - len(blobs)))


def told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def joined(blobs: pd.Series, kind: type | str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def to_blocks(numbers: np.ndarray, of: np.ndarray | None = None) -> Iterator[tuple[int, slice]]:
    """The stretches of sorted ``numbers`` that belong to one block, or to one of ``of``."""
    blocks = numbers // SLOTS if of is None else of
    cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(blocks[a]), slice(int(a), int(b))


def distinct(node: np.ndarray, other: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Places of the distinct pairs, in order; of equal ones any, or the first for which ``last`` is false, if given."""
    pair = node.astype(np.int64) << 32 | other
    order = np.argsort(pair) if last is None else np.argsort(pair << 1 | last, kind="stable")
    pair = pair[order]
    return order[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else order


def best_edges(node: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Places of each node's ``most`` nearest edges, nodes in order and nearest first; ties as they come."""
    order = np.argsort(node.astype(np.int64) << 32 | ((1.5 - near.astype(float)) * 2**30).astype(np.int64), kind="stable")
    node = node[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, int)
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    return order[rank < most]


def candidates(sender: int, node: np.ndarray, other: np.ndarray, near: np.ndarray) -> pd.DataFrame:
    """Edges told to the blocks of their nodes, equal ones once."""
    keep = distinct(node, other)
    node, other, near = node[keep], other[keep], near[keep]
    return told([message(block, sender, 1, node[at].astype(np.uint32), other[at].astype(np.uint32), near[at].astype(np.float32)) for block, at in to_blocks(node)])


def dealt(messages: DataFrame, blocks: int, work, schema: str = MESSAGE) -> DataFrame:
    """``work`` on the messages of every block."""
    return messages.repartition(max(2, blocks), "to").groupBy("to").applyInPandas(work, schema)


def best_of(nodes: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's ``most`` nearest others of a small set: node, other, nearness."""
    near = vectors @ vectors.T
    near[nodes[:, None] == nodes[None, :]] = -3  # a run may end in one order and go on in the next
    most = min(most, len(nodes) - 1)
    at = np.argpartition(-near, most - 1, axis=1)[:, :most] if most > 0 else np.empty((len(nodes), 0), int)
    node, other, found = np.repeat(nodes, most), nodes[at].ravel(), np.take_along_axis(near, at, axis=1).ravel()
    return node[found > -2], other[found > -2], found[found > -2]


def first_edges(blocks: DataFrame, width: int, size: int, neighbours: int, run: int, seed: int) -> DataFrame:
    """A start for NN-descent, as messages: the nearest within short runs of several random orders.

    Rows are sorted across partitions by the signs of a few random projections and then by one
    more, and every run of ``run`` rows is searched by itself; equal projections make long stretches, not large groups.
    """
    planes = np.random.default_rng(seed).standard_normal((ORDERS, 9, size)).astype(np.float32)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, units in zip(batch["block"], batch["units"], strict=True):
                vectors = np.frombuffer(units, "<f4").reshape(-1, size)
                rows = pd.DataFrame({"number": block * SLOTS + np.arange(len(vectors)), "unit": [v.tobytes() for v in vectors]})
                for order in range(ORDERS):
                    found = vectors @ planes[order].T
                    yield rows.assign(order=order, sign=(found[:, :8] > 0) @ (1 << np.arange(8)), place=found[:, 8])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, found = None, []
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cut = 0
            while len(rest) - cut >= 2 * run:
                found.append(best_of(rest["number"].to_numpy()[cut : cut + run], matrix(rest["unit"][cut : cut + run]), neighbours))
                cut += run
            rest = rest.iloc[cut:].reset_index(drop=True)
            if sum(len(x[0]) for x in found) > 1 << 20:
                yield candidates(-1, *(np.concatenate(x) for x in zip(*found, strict=True)))
                found = []
        if rest is not None and len(rest) > 1:
            found.append(best_of(rest["number"].to_numpy(), matrix(rest["unit"]), neighbours))
        if found:
            yield candidates(-1, *(np.concatenate(x) for x in zip(*found, strict=True)))

    placed = blocks.mapInPandas(project, "number long, unit binary, order int, sign long, place float")
    by = ["order", "sign", "place", "number"]
    return placed.repartitionByRange(width, *by).sortWithinPartitions(*by).select("number", "unit").mapInPandas(runs, MESSAGE)


def held(table: DataFrame, *columns: str) -> DataFrame:
    """Columns of a table by blocks, as messages of the blocks to themselves."""
    rest = [F.lit(None).cast("binary").alias(c) for c in "abcd"[len(columns) :]]
    return table.select(F.col("block").alias("to"), F.col("block").alias("sender"), F.lit(0).alias("kind"), *[F.col(x).alias(c) for x, c in zip(columns, "abcd")], *rest)


def as_messages(graph: DataFrame) -> DataFrame:
    return held(graph, "degrees", "others", "nears", "news")


def edges_of(row: object) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's edges, from its message: degrees, places of their nodes, others, nearness, whether new."""
    degrees = np.frombuffer(row.a, np.uint32)
    return degrees, np.repeat(np.arange(len(degrees)), degrees), np.frombuffer(row.b, np.uint32).astype(np.int64), np.frombuffer(row.c, np.float32), np.frombuffer(row.d, bool)


def merged(messages: DataFrame, blocks: DataFrame, count: int, neighbours: int) -> DataFrame:
    """The ``neighbours`` nearest distinct others of every node, from edges told; an edge is new unless it was there before."""
    sizes = held(blocks, "ids").withColumn("kind", F.lit(2))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = sum(len(x) for x in rows["a"][rows["kind"] == 2]) // 8
        found = rows[rows["kind"] == 1].sort_values("sender", kind="stable")
        node, other, near = joined(found["a"], np.uint32).astype(np.int64) % SLOTS, joined(found["b"], np.uint32).astype(np.int64), joined(found["c"], np.float32)
        new = np.ones(len(node), bool)
        for row in rows[rows["kind"] == 0].itertuples():
            _, at, others, nears, _ = edges_of(row)
            node, other, near, new = np.append(at, node), np.append(others, other), np.append(nears, near), np.append(np.zeros(len(at), bool), new)
        keep = distinct(node, other, new)
        keep = keep[best_edges(node[keep], near[keep], neighbours)]
        degrees = np.bincount(node[keep], minlength=size).astype(np.uint32)
        row = [key[0], len(keep), int(new[keep].sum()), degrees.tobytes(), other[keep].astype(np.uint32).tobytes(), near[keep].tobytes(), new[keep].tobytes()]
        return pd.DataFrame([row], columns=[x.split()[0] for x in GRAPH.split(", ")])

    return dealt(messages.unionByName(sizes), count, merge, GRAPH)


def reversed_edges(graph: DataFrame) -> DataFrame:
    """Every block's edges, and each edge told to the block of its other end."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, at, other, near, new = edges_of(row)
                order = np.argsort(other, kind="stable")
                node, other, near, new = row.to * SLOTS + at[order], other[order], near[order], new[order]
                found = [message(block, row.to, 1, other[x].astype(np.uint32), node[x].astype(np.uint32), near[x], new[x]) for block, x in to_blocks(other)]
                yield told([message(row.to, row.to, 0, row.a, row.b, row.c, row.d), *found])

    return as_messages(graph).mapInPandas(turn, MESSAGE)


def both_ways(rows: pd.DataFrame, neighbours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's links ``node, other, fresh``: edges, and for every node as many of the nearest that name it, so the links of a hub are bounded; and floors."""
    degrees, node, other, near, new = edges_of(next(rows[rows["kind"] == 0].itertuples()))
    ends = np.cumsum(degrees)
    full = degrees >= neighbours
    floors = np.full(len(degrees), -2, np.float32)
    floors[full] = near[ends[full].astype(np.int64) - 1]
    back = rows[rows["kind"] == 1].sort_values("sender")
    b_node, b_other, b_near, b_new = joined(back["a"], np.uint32).astype(np.int64) % SLOTS, joined(back["b"], np.uint32).astype(np.int64), joined(back["c"], np.float32), joined(back["d"], bool)
    best = best_edges(b_node, b_near, neighbours)
    node, other, new = np.append(node, b_node[best]), np.append(other, b_other[best]), np.append(new, b_new[best])
    keep = distinct(node, other, ~new)
    return node[keep], other[keep], new[keep], floors


def met(numbers: np.ndarray, units: np.ndarray, floors: np.ndarray, lengths: np.ndarray, members: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of each list that have a ``fresh`` member and are nearer than the node's floor, ``MEET`` at most of a node in a list."""
    units, floors, width = np.vstack([units, np.zeros((1, units.shape[1]), np.float32)]), np.append(floors, np.float32(9)), int(lengths.max())
    starts, found = np.cumsum(lengths) - lengths, []
    some = max(1, (1 << 20) // (width * max(width, units.shape[1])))
    for a in range(0, len(lengths), some):
        long = lengths[a : a + some]
        there = np.arange(width) < long[:, None]
        at = np.where(there, starts[a : a + some, None] + np.arange(width), 0)
        who, new = np.where(there, members[at], len(units) - 1), there & fresh[at]
        vectors = units[who]
        near = vectors @ vectors.transpose(0, 2, 1)
        near[:, np.arange(width), np.arange(width)] = -3
        good = (near > floors[who][:, :, None]) & (new[:, :, None] | new[:, None, :]) & there[:, None, :]
        many = np.nonzero(good.sum(axis=2) > MEET)
        if len(many[0]):
            some_near = np.where(good[many], near[many], np.float32(-3))
            good[many] = some_near >= -np.partition(-some_near, MEET - 1, axis=1)[:, MEET - 1 : MEET]
        x, i, j = np.nonzero(good)
        found.append((who[x, i], who[x, j], near[x, i, j]))
    node, other, near = (np.concatenate(x) for x in zip(*found, strict=True))
    return numbers[node], numbers[other], near


def meetings(graph: DataFrame, blocks: DataFrame, count: int, neighbours: int) -> DataFrame:
    """One round of NN-descent, as messages: everyone's neighbours, and those it is a neighbour of, meet each other.

    Only pairs with a member that is new in a list meet, so lists without one are left out. A block asks others for the
    vectors of all its lists at once, so a vector comes to a block once; with it comes the least nearness that its node still needs.
    """

    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = key[0]
        node, other, fresh, floors = both_ways(rows, neighbours)
        any_new = np.zeros(len(floors), bool)
        any_new[node[fresh]] = True
        own = np.flatnonzero(any_new)
        take = any_new[node]
        node, other, fresh = np.append(node[take], own), np.append(other[take], block * SLOTS + own), np.append(fresh[take], np.zeros(len(own), bool))
        keep = distinct(node, other, ~fresh)
        node, other, fresh = node[keep], other[keep], fresh[keep]
        wanted, members = np.unique(other, return_inverse=True)
        lengths = np.bincount(node, minlength=len(floors))[own]
        out = [message(block, block, 1, floors)]
        if len(own):
            out.append(message(block, block, 3, wanted.astype(np.uint32), lengths.astype(np.uint32), members.astype(np.uint32), fresh))
        return told(out + [message(to, block, 2, wanted[at].astype(np.uint32)) for to, at in to_blocks(wanted)])

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [message(*row[1:4], *row[4:]) for row in rows[rows["kind"] == 3].itertuples()]
        floors = joined(rows["a"][rows["kind"] == 1], np.float32)
        units = joined(rows["a"][rows["kind"] == 0], "<f4").reshape(len(floors), -1)
        for row in rows[rows["kind"] == 2].itertuples():
            at = np.frombuffer(row.a, np.uint32) % SLOTS
            out.append(message(row.sender, key[0], 4, units[at], floors[at]))
        return told(out)

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lists = next(rows[rows["kind"] == 3].itertuples(), None)
        if lists is None:
            return told([])
        came = rows[rows["kind"] == 4].sort_values("sender")
        wanted = np.frombuffer(lists.a, np.uint32).astype(np.int64)
        pairs = met(wanted, joined(came["a"], "<f4").reshape(len(wanted), -1), joined(came["b"], np.float32), np.frombuffer(lists.b, np.uint32).astype(np.int64), np.frombuffer(lists.c, np.uint32).astype(np.int64), np.frombuffer(lists.d, bool))
        return candidates(key[0], *pairs)

    asked = dealt(reversed_edges(graph), count, ask)
    return dealt(dealt(asked.unionByName(held(blocks, "units")), count, answer), count, meet)


def descended(blocks: DataFrame, neighbours: int = NEIGHBOURS, delta: float = DELTA, run: int = RUN, seed: int = 23) -> DataFrame:
    """The neighbour graph of ``packed`` nodes, a row for each block.

    Rounds go on until one brings at most ``delta`` of the graph's edges anew. Neighbours only become nearer, so they end.
    """
    first, count = blocks.select(F.octet_length("units") * 2 / F.octet_length("ids")).first(), blocks.count()
    width = shuffle_width(blocks.sparkSession)
    graph = materialize(merged(first_edges(blocks, max(width, count), int(first[0]), neighbours, run, seed), blocks, count, neighbours), "graph")
    while True:
        after = materialize(merged(as_messages(graph).unionByName(meetings(graph, blocks, count, neighbours)), blocks, count, neighbours), "graph")
        drop_table(graph)
        graph = after
        edges, new = graph.agg(F.sum("edges"), F.sum("fresh")).first()
        if new <= delta * edges:
            return graph


EDGES = "number long, other_number long, near float, fresh boolean"


def edge_rows(graph: DataFrame, blocks: DataFrame) -> DataFrame:
    """``node, other, near, fresh``: a row for each edge of a graph in blocks, by names."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, at, other, near, new = edges_of(row)
                yield pd.DataFrame({"number": row.to * SLOTS + at, "other_number": other, "near": near, "fresh": new})

    rows, names = as_messages(graph).mapInPandas(unpack, EDGES), numbers(blocks)
    rows = rows.join(names.withColumnRenamed("name", "node"), "number")
    return rows.join(names.select(F.col("number").alias("other_number"), F.col("name").alias("other")), "other_number").select("node", "other", "near", "fresh")


def graph_of(edges: DataFrame, blocks: DataFrame, count: int, neighbours: int) -> DataFrame:
    """A graph in blocks from rows of edges; their ``fresh`` stays."""
    names = numbers(blocks)
    rows = edges.join(names.select(F.col("number"), F.col("name").alias("node")), "node").join(names.select(F.col("number").alias("other_number"), F.col("name").alias("other")), "other")
    rows = rows.select((F.col("number") / SLOTS).cast("int").alias("block"), *[F.col(x.split()[0]) for x in EDGES.split(", ")])
    sizes = {r["block"]: r["n"] for r in blocks.select("block", (F.octet_length("ids") / 8).cast("int").alias("n")).collect()}

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["number"].to_numpy() % SLOTS
        keep = best_edges(node, rows["near"].to_numpy(), neighbours)
        other, near, new = (rows[c].to_numpy()[keep] for c in ("other_number", "near", "fresh"))
        row = [key[0], len(keep), int(new.sum()), np.bincount(node[keep], minlength=sizes[key[0]]).astype(np.uint32).tobytes(), other.astype(np.uint32).tobytes(), near.astype(np.float32).tobytes(), new.astype(bool).tobytes()]
        return pd.DataFrame([row], columns=[x.split()[0] for x in GRAPH.split(", ")])

    return materialize(rows.groupBy("block").applyInPandas(pack, GRAPH), "graph")


def descend(graph: DataFrame, nodes: DataFrame, neighbours: int) -> DataFrame:
    """One round of NN-descent on rows of edges ``node, other, near, fresh``."""
    blocks = packed(nodes)
    count = blocks.count()
    before = graph_of(graph, blocks, count, neighbours)
    return edge_rows(materialize(merged(as_messages(before).unionByName(meetings(before, blocks, count, neighbours)), blocks, count, neighbours), "graph"), blocks)


def neighbour_graph(nodes: DataFrame, neighbours: int = NEIGHBOURS, delta: float = DELTA, run: int = RUN, seed: int = 23) -> DataFrame:
    """``node, other, near, fresh``: about the ``neighbours`` nearest others of every node by cosine."""
    if nodes.isEmpty():
        return nodes.select("node", F.col("node").alias("other"), F.lit(0.0).cast("float").alias("near"), F.lit(True).alias("fresh")).limit(0)
    blocks = packed(nodes)
    return edge_rows(descended(blocks, neighbours, delta, run, seed), blocks)


def links_of(graph: DataFrame, count: int, neighbours: int) -> DataFrame:
    """``block, degrees, others``: what a walk that leaves a node goes to, neighbours both ways."""

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        node, other, _, floors = both_ways(rows, neighbours)
        return pd.DataFrame({"block": [key[0]], "degrees": [np.bincount(node, minlength=len(floors)).astype(np.uint32).tobytes()], "others": [other.astype(np.uint32).tobytes()]})

    return materialize(dealt(reversed_edges(graph), count, link, "block int, degrees binary, others binary"), "links")


def front_of(left: np.ndarray, beam: int) -> np.ndarray:
    """The places of the nodes that a walk leaves next: the nearest of its beam that it hasn't left."""
    return np.flatnonzero(~left[:beam])[: max(STRIDE, beam * STRIDE // BEAM)]


WALK = "walk int, query long, own long, unit binary, ids binary, near binary, left binary, seen binary, visited long, open long"
WALK_COLUMNS = [x.split()[0] for x in WALK.split(", ")]


def parts(row: object) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A walk's best nodes, their nearness, whether it left them, and the nodes it measured last."""
    return np.frombuffer(row.ids, np.uint32).astype(np.int64), np.frombuffer(row.near, np.float32), np.frombuffer(row.left, bool), np.frombuffer(row.seen, np.uint32).astype(np.int64)


def step(state: DataFrame, blocks: DataFrame, links: DataFrame, groups: int, walks: int, starts: np.ndarray, beam: int) -> DataFrame:
    """Walks after they left the front of their beams and measured what they hadn't seen there.

    Walks and nodes are dealt in groups that tell each other packed numbers: a group of walks asks for the links of its
    fronts, then for the nearness of what these lead to. A group of walks sends its vectors to a group of nodes once.
    """

    def grouped(numbers: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, slice]]]:
        group = numbers // SLOTS % groups
        order = np.argsort(group, kind="stable")
        return order, to_blocks(numbers, group[order])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for walk, rows in batch.groupby("walk"):
                left = [parts(row) for row in rows.itertuples()]
                wanted = np.unique(np.concatenate([ids[front_of(gone, beam)] for ids, _, gone, _ in left]))
                order, cuts = grouped(wanted)
                yield told([message(group, walk, 2, wanted[order][at].astype(np.uint32)) for group, at in cuts])

    def places(rows: pd.DataFrame, sizes: list[int]):
        """Where a group's nodes lie in its blocks' arrays, one after the other."""
        ids, base = rows["sender"].to_numpy(np.int64), np.cumsum([0, *sizes])
        return lambda numbers: base[np.searchsorted(ids, numbers // SLOTS)] + numbers % SLOTS

    def lead(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, out = rows[rows["kind"] == 0].sort_values("sender"), []
        place = places(own, [len(x) // 4 for x in own["a"]])
        degrees, others = joined(own["a"], np.uint32).astype(np.int64), joined(own["b"], np.uint32)
        ends = np.cumsum(degrees)
        for row in rows[rows["kind"] == 2].itertuples():
            at = place(np.frombuffer(row.a, np.uint32).astype(np.int64))
            long = degrees[at]
            run = np.repeat(ends[at] - np.cumsum(long), long) + np.arange(long.sum())
            out.append(message(-1 - row.sender, key[0], 1, row.a, long.astype(np.uint32), others[run]))
        return told(out)

    def reach(key: tuple, state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return told([])
        left, long, others = joined(found["a"], np.uint32).astype(np.int64), joined(found["b"], np.uint32).astype(np.int64), joined(found["c"], np.uint32).astype(np.int64)
        order, ends = np.argsort(left, kind="stable"), np.cumsum(long)
        state, who, what, floors = state.sort_values("query"), [], [], []
        for number, row in enumerate(state.itertuples()):
            ids, near, gone, seen = parts(row)
            if row.visited:
                at = order[np.searchsorted(left, ids[front_of(gone, beam)], sorter=order)] if len(left) else np.empty(0, int)
                new = np.concatenate([np.empty(0, np.int64), *[others[ends[x] - long[x] : ends[x]] for x in at]])
            else:
                new = np.append(starts, row.own) if row.own >= 0 else starts
            new = np.unique(new)
            new = new[~np.isin(new, seen, assume_unique=True)]
            who.append(np.full(len(new), number))
            what.append(new)
            floors.append(near[4 * beam - 1] if len(near) >= 4 * beam else -2)
        who, what = np.concatenate(who), np.concatenate(what)
        order, cuts = grouped(what)
        units, floors, to = b"".join(state["unit"]), np.array(floors, np.float32), -1 - key[0]
        asked = [message(group, key[0], 2, who[order][at].astype(np.uint16), what[order][at].astype(np.uint32), floors, units) for group, at in cuts]
        return told([message(to, to, 3, who.astype(np.uint16), what.astype(np.uint32)), *asked])

    def measure(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return rows
        own, out = rows[rows["kind"] == 0].sort_values("sender"), []
        asked = rows[rows["kind"] == 2]
        size = len(asked["d"].iloc[0]) // len(asked["c"].iloc[0]) if len(asked) else 1
        place, units = places(own, [len(x) // (4 * size) for x in own["a"]]), joined(own["a"], "<f4").reshape(-1, size)
        for row in asked.itertuples():
            who, what, floors, walks = np.frombuffer(row.a, np.uint16), np.frombuffer(row.b, np.uint32), np.frombuffer(row.c, np.float32), np.frombuffer(row.d, "<f4").reshape(-1, size)
            at = place(what.astype(np.int64))
            some = 1 << 14
            near = np.concatenate([np.einsum("ij,ij->i", units[at[a : a + some]], walks[who[a : a + some]]) for a in range(0, len(at), some)])
            good = near >= floors[who]
            out.append(message(-1 - row.sender, key[0], 1, who[good], what[good], near[good]))
        return told(out)

    def merge(key: tuple, state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame(columns=WALK_COLUMNS)
        asked, came, out = found[found["kind"] == 3], found[found["kind"] == 1].sort_values("sender"), []
        a_who, a_what = joined(asked["a"], np.uint16), joined(asked["b"], np.uint32)
        who, what, nears = joined(came["a"], np.uint16), joined(came["b"], np.uint32).astype(np.int64), joined(came["c"], np.float32)
        order = np.argsort(who, kind="stable")
        state, numbers = state.sort_values("query"), np.arange(len(state) + 1)
        cuts, a_cuts = np.searchsorted(who[order], numbers), np.searchsorted(a_who, numbers)
        for number, row in enumerate(state.itertuples()):
            ids, near, left, seen = parts(row)
            left = left.copy()
            left[front_of(left, beam)] = True
            mine, new = order[cuts[number] : cuts[number + 1]], a_what[a_cuts[number] : a_cuts[number + 1]]
            again = ~np.isin(what[mine], ids)
            mine = mine[again]
            ids, near, left = np.append(ids, what[mine]), np.append(near, nears[mine]), np.append(left, np.zeros(len(mine), bool))
            best = np.lexsort((ids, -near))[: 4 * beam]
            ids, near, left, seen = ids[best], near[best], left[best], np.append(seen, new)[-SEEN:]
            out.append((row.walk, row.query, row.own, row.unit, ids.astype(np.uint32).tobytes(), near.tobytes(), left.tobytes(), seen.astype(np.uint32).tobytes(), row.visited + len(new), int((~left[:beam]).sum())))
        return pd.DataFrame(out, columns=WALK_COLUMNS)

    def walked(replies: DataFrame, work, schema: str) -> DataFrame:
        replies = replies.filter("to < 0").withColumn("walk", -1 - F.col("to")).repartition(max(2, walks), "walk")
        return state.repartition(max(2, walks), "walk").groupBy("walk").cogroup(replies.groupBy("walk")).applyInPandas(work, schema)

    units = held(blocks, "units").withColumn("to", F.col("to") % groups)
    linked = held(links, "degrees", "others").withColumn("to", F.col("to") % groups)
    led = dealt(state.mapInPandas(ask, MESSAGE).unionByName(linked), groups, lead)
    reached = walked(led, reach, MESSAGE)
    measured = dealt(reached.unionByName(units), groups + walks, measure)
    return walked(measured, merge, WALK)


def greedy_search(points: DataFrame, blocks: DataFrame, graph: DataFrame, sample: list[tuple[int, np.ndarray]], neighbours: int = NEIGHBOURS, beam: int = BEAM, target: float = TARGET) -> DataFrame:
    """Walks over the graph, one a point ``query, unit``: the best nodes each found.

    All walk at once. In a step each leaves some of the ``beam`` best nodes that it has seen, those it hasn't left yet, for
    their neighbours both ways. When less than a node a walk is left in the beams, the walks of ``sample``, points with the nearness
    of their true k nearest, are looked at: while they found less than ``target`` of these, the beam doubles and
    the walks go on from where they are, at last over all nodes; else they leave the rest of their beams and end.
    """
    count, asked = blocks.count(), points.count()
    groups, walks = max(min(GROUPS, count), count // 8), max(min(GROUPS, -(-asked // 16)), -(-asked // 128), 1)
    links = links_of(graph, count, neighbours)
    names = numbers(blocks)
    total = names.count()
    starts = np.array([r["number"] for r in names.orderBy(F.xxhash64("name"), "name").limit(STARTS).collect()], np.int64)
    empty = {c: F.lit(bytearray()).alias(c) for c in ("ids", "near", "left", "seen")}
    begun = points.join(names, F.col("query") == F.col("name"), "left").select(F.pmod(F.xxhash64("query"), F.lit(walks)).cast("int").alias("walk"), "query", F.coalesce("number", F.lit(-1).cast("long")).alias("own"), "unit", *empty.values(), F.lit(0).cast("long").alias("visited"), F.lit(1).cast("long").alias("open"))
    going = materialize(begun, "walk")
    old, resting = [going], []
    wanted, enough = {q: x for q, x in sample}, False
    while True:
        after = materialize(step(going, blocks, links, groups, walks, starts, beam), "walk")
        for table in old:
            drop_table(table)
        left, ended = after.agg(F.coalesce(F.sum("open"), F.lit(0)), F.count_if(F.col("open") == 0)).first()
        # walks that left all of their beam rest where they are, until it doubles
        if left and (left >= asked or enough):
            resting += [after] if ended else []
            going, old = after.filter("open > 0"), [] if ended else [after]
            continue
        state = reduce(DataFrame.unionByName, [*(t.filter("open = 0") for t in resting), after])
        rows = state.filter(F.col("query").isin(list(wanted))).select("query", "own", "ids", "near").collect() if wanted else []  # SAMPLE rows of a few beams
        share = [(np.frombuffer(r["near"], np.float32)[np.frombuffer(r["ids"], np.uint32) != r["own"]][: len(wanted[r["query"]])] >= wanted[r["query"]][-1] - 1e-5).sum() / len(wanted[r["query"]]) for r in rows if len(wanted[r["query"]])]
        enough = not share or np.mean(share) >= target or beam >= total
        if not enough:
            beam, going, old, resting = 2 * beam, state, [*resting, after], []
        elif left:
            resting += [after] if ended else []
            going, old = after.filter("open > 0"), [] if ended else [after]
        else:
            drop_table(links)
            return state


def true_nearness(points: DataFrame, nodes: DataFrame, k: int, sample: int = SAMPLE, seed: int = 23) -> list[tuple[int, np.ndarray]]:
    """At most ``sample`` points with the nearness of their true k nearest nodes, by a scan of all nodes."""
    some = points.orderBy(F.xxhash64(F.lit(seed), "query"), "query").limit(sample).select("query", "unit").toPandas()
    if not len(some):
        return []
    queries, ids = matrix(some["unit"]), some["query"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full((len(ids), k), -3, np.float32)
        for batch in batches:
            if len(batch):
                near = queries @ matrix(batch["unit"]).T
                near[ids[:, None] == batch["node"].to_numpy()[None, :]] = -3
                best = -np.sort(-np.concatenate([best, near], axis=1), axis=1)[:, :k]
        yield pd.DataFrame({"query": np.repeat(ids, k), "near": best.ravel()})

    found = nodes.mapInPandas(scan, "query long, near float").filter("near > -2")
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near")))).filter(F.col("rank") <= k).toPandas()
    return [(int(q), np.sort(rows["near"].to_numpy())[::-1]) for q, rows in top.groupby("query")]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", neighbours: int = NEIGHBOURS, delta: float = DELTA, beam: int = BEAM, target: float = TARGET, run: int = RUN, seed: int = 23) -> DataFrame:
    """``query_id, rank, vec_id, score, visited``: the k nearest rows found for each query, by cosine in double precision.

    ``queries`` are rows of ``vectors``; a query's own id is left out, equal vectors under other ids
    aren't. Rows whose vector is null, zero, of another length than most, or holds a null or non-finite number take
    no part on either side. Ties go to smaller ids, among all that the walk found; a repeated id counts once. Fewer than k others
    give fewer rows, an empty table none. Equal vectors share a node of the graph, which carries as many ids as can be asked for.
    Other columns aren't looked at, whatever their names. ``visited`` is the number of nodes that the query's walk measured.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, vector, key)
    size = commonest_length(rows)
    rows = rows.filter(F.size("vec") == size).groupBy("id").agg(F.min("vec").alias("vec"))
    nodes, ids = distinct_vectors(rows, k + 1)
    if nodes.isEmpty():
        return nodes.select(F.col("node").alias("query_id"), F.lit(1).alias("rank"), F.col("node").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("visited")).limit(0)
    blocks = packed(nodes)
    graph = descended(blocks, neighbours, delta, run, seed)
    asked = usable(queries, vector, key, size).groupBy("id").agg(F.min("vec").alias("q_vec"))
    named = ids.withColumnsRenamed({"node": "home", "id": "h_id"}).filter("home = h_id").join(rows, F.col("h_id") == F.col("id")).select("home", F.col("vec").alias("h_vec"))
    asked = materialize(asked.join(named, F.col("q_vec") == F.col("h_vec"), "left").select("id", "q_vec", F.coalesce("home", "id").alias("home")), "queries")
    points = materialize(with_unit(asked.select(F.col("home").alias("query"), F.col("q_vec").alias("vec")).dropDuplicates(["query"]), ["query"]), "points")
    walks = greedy_search(points, blocks, graph, true_nearness(points, nodes, k), neighbours, beam, target)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query, found, near, visited in zip(batch["query"], batch["ids"], batch["near"], batch["visited"], strict=True):
                near = np.frombuffer(near, np.float32)
                good = near >= near[min(k, len(near) - 1)] - 1e-5 if len(near) else np.empty(0, bool)
                yield pd.DataFrame({"query": query, "number": np.frombuffer(found, np.uint32)[good].astype(np.int64), "visited": visited})

    found = walks.select("query", "ids", "near", "visited").mapInPandas(best, "query long, number long, visited long").join(numbers(blocks), "number").select("query", F.col("name").alias("node"), "visited")
    top = found.join(ids.withColumnsRenamed({"node": "i_node", "id": "vec_id"}), F.col("node") == F.col("i_node")).select("query", "vec_id", "visited")
    pairs = asked.join(top, F.col("home") == F.col("query")).filter("id <> vec_id").select(F.col("id").alias("query_id"), "vec_id", "q_vec", "visited")
    exact = pairs.join(rows.withColumnRenamed("id", "r_id"), F.col("vec_id") == F.col("r_id"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    score = dot("q_vec", "vec") / (F.sqrt(dot("q_vec", "q_vec")) * F.sqrt(dot("vec", "vec")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "visited")


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return nearest(table, table.filter("vec_id % 50 = 0"))
