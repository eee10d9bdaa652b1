"""LM scoring: a hierarchical Pitman-Yor model, its seating sampled by Gibbs, spread over buckets of dishes.

Every context of one or two words has a restaurant, whatever the corpus's size; a token's is that of the longest
context before it. All share the parents of their shorter contexts, down to the
root, where every word is served. A bucket holds all dishes of the contexts that end with some words, so these
restaurants are whole there. The dishes of a last word of ``HOT`` tokens or more are spread over buckets by the word they
serve, and their restaurants' sums are exchanged. Root dishes are seated apart, in parts of words by their hashes:
in each sweep the buckets send the customers that they have for each word, and hear how it is served in all. Words
go by numbers that their parts give them, which rise with their hashes, so what is exchanged is sorted and small.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import WordHashes, drop_table, dropped_buckets, in_buckets, materialize, mix64, read, ship, words_of

#: A context gets a restaurant if at least so many training tokens follow it, and a word's dishes are spread if it comes this often.
LEAST, HOT = 1, 300_000
#: Sweeps, those that aren't averaged, and seatings that are proposed for each whole dish in a sweep.
SWEEPS, BURN_IN, MOVES = 3, 1, 2
#: Tokens of a block of documents, and of a bucket of words.
BLOCK_TOKENS, BUCKET_TOKENS = 1_000_000, 1_000_000
#: Cells in which contexts are counted if few have a restaurant, the parts that they are summed in, and bits of a key of ``Contexts`` that tell pairs apart.
CELLS, CELL_PARTS, PAIR_BITS = 1 << 24, 64, 24
STRENGTH = (1.0, 1.0, 1.0)
END = b" end"

_hashes = WordHashes()


def pack(array: np.ndarray) -> bytes:
    """Bytes of an array, one byte plane after the other, compressed."""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(len(array), array.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def in_training(key: object) -> bool:
    return zlib.crc32(str(key).encode()) % 7 != 2


def pair_hash(second: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a context of two words, from theirs."""
    return mix64(second * np.uint64(3) + mix64(last))


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(CELLS)).astype(np.int64)


class Cells:
    """Which cells of contexts are frequent."""

    def __init__(self, frequent: np.ndarray):
        self.bits = frequent

    def have(self, hashes: np.ndarray) -> np.ndarray:
        cell = cell_of(hashes)
        return (self.bits[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)


def context_cells(docs: DataFrame, least: int) -> Cells:
    """Cells whose contexts ``least`` training tokens follow together, which never takes one for rarer than it is.

    A task adds its contexts up in ``CELLS`` counts, which compress to what it read; a bit a cell reaches the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, some = np.zeros(CELLS, np.uint32), False
        for batch in (whole.iloc[i : i + 500] for whole in batches for i in range(0, len(whole), 500)):
            texts = [[END, *words_of(t)] for t, k in zip(batch["_text"], batch["_key"], strict=True) if in_training(k)]
            if texts:
                some = True
                hashes = _hashes.of([w for words in texts for w in words])
                inner = np.ones(len(hashes), bool)
                inner[np.cumsum([0, *map(len, texts)])[:-1]] = False
                found, n = np.unique(cell_of(np.concatenate([hashes, pair_hash(hashes[:-1], hashes[1:])[inner[1:]]])), return_counts=True)
                cells[found] += n.astype(np.uint32)
        if some:
            width = CELLS // CELL_PARTS
            yield pd.DataFrame([[p, pack(cells[p * width : (p + 1) * width])] for p in range(CELL_PARTS)], columns=["part", "cells"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // CELL_PARTS, np.int64)
        for blob in rows["cells"]:
            total += unpack(blob, "u4")
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "frequent": [np.packbits(total >= least).tobytes()]})

    found = docs.mapInPandas(count, "part long, cells binary").groupBy("part").applyInPandas(add, "part long, frequent binary").orderBy("part").collect()
    return Cells(np.concatenate([np.frombuffer(r["frequent"], np.uint8) for r in found]) if found else np.zeros(CELLS // 8, np.uint8))


class Contexts:
    """Restaurants by key: the last word, and in the lower bits the pair, or 0; the root is 0."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.size = keys, len(keys)
        low = np.uint64(PAIR_BITS)
        single = keys >> low << low
        pair = single != keys
        self.level = np.where(pair, 2, np.where(keys > 0, 1, 0))
        self.parent = np.searchsorted(keys, np.where(pair, single, np.uint64(0)))


#: Bits of a place in a dish's order of customers, and of the entry before it, in a table's key.
PLACE_BITS = 36
PLACE = (1 << PLACE_BITS) - 1
#: Customers drawn singly, and dishes, of a step of a sweep.
STEP_DRAWS = 200_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series eight above."""
    low, y = x.copy(), x + 8
    for i in range(1, 8):
        low *= x + i
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(low)


class Worth:
    """What a new table of a dish is worth: (strength + d * tables of the restaurant) times the parent's probability.

    Both rise with the dish's own tables k, each of which is a customer of the parent: the restaurant's ``others`` come from
    other dishes, and the parent gives (x + k) / (y + k), without the customers that this dish sent there; the root gives the base.
    """

    def __init__(self, strength: float, d: float, others: np.ndarray, x: np.ndarray, y: np.ndarray, rises: int):
        self.strength, self.d, self.others, self.x, self.y, self.rises = strength, d, others, x, y, rises

    def part(self, s: slice) -> Worth:
        return Worth(self.strength, self.d, self.others[s], self.x[s], self.y[s], self.rises)

    def of(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The worth of the table that follows ``k`` tables of dishes ``i``."""
        parent = (self.x[i] + self.rises * k) / (self.y[i] + self.rises * k)
        return np.maximum((self.strength + self.d * (self.others[i] + k)) * parent, 1e-12)


class Guide:
    """Draws whole seatings of dishes with ``c`` customers, a new table being worth about ``a``, and ``worth`` exactly.

    A seating is told by the places, in the order of customers, of those that open a table. Its weight is ``a`` for each
    of them and (m - d * tables so far) for the customer after m others at an old table. A place opens
    a table independently with about its mean chance under these weights, known from their
    generating function exp(a * (1 - (1 - z)^d) / d), and Metropolis-Hastings corrects what is left. The
    first ``head`` places, where a fifth or more open a table, are drawn singly and the others by the tables' Poisson gaps.
    """

    def __init__(self, c: np.ndarray, a: np.ndarray, d: float, worth: Worth):
        self.c, self.a, self.d, self.worth = c.astype(np.int64), a, d, worth
        n = np.maximum(self.c, 1)
        x = np.minimum(np.log(a / (a + n)), np.log(a / n) / (1 - d))
        x = np.minimum(x, -1e-9)
        for _ in range(8):  # Newton from the right of the root of a concave function
            e = np.exp(x)
            x = np.minimum(x - (np.log(a / n) + np.log1p(-e) + (d - 1) * x) / (d - 1 - e / (1 - e)), -1e-9)
        self.e = np.exp(x)
        self.z = 1 - self.e
        dense = n / self.z * ((0.2 * n / (a * self.z)) ** (1 / (d - 1)) - self.e)
        self.head = np.minimum(self.c, np.maximum(8, np.ceil(np.minimum(dense, 4e10)))).astype(np.int64)
        self.places = None

    def part(self, s: slice) -> Guide:
        out = Guide.__new__(Guide)
        out.c, out.a, out.e, out.z, out.head, out.d = self.c[s], self.a[s], self.e[s], self.z[s], self.head[s], self.d
        out.worth, out.places = self.worth.part(s), None
        return out

    def reach(self, i: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Expected tables up to place ``m`` of entries ``i``, and a constant."""
        return self.a[i] / self.d * (self.e[i] + self.z[i] * m / np.maximum(self.c[i], 1)) ** self.d

    def odds(self, i: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Odds that place ``m`` of entry ``i`` opens a table when drawn."""
        step = self.z / np.maximum(self.c, 1)
        q = np.clip((self.a * step)[i] * (self.e[i] + step[i] * m) ** (self.d - 1), 1e-9, 1 - 1e-9)
        out, far = q / (1 - q), np.flatnonzero(m >= self.head[i])
        if len(far):
            i, m = i[far], m[far]
            out[far] = np.expm1(self.reach(i, m + 1) - self.reach(i, m)).clip(1e-300)
        return out

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        """Keys (entry, place) of the tables of a seating of each entry, in order."""
        if self.places is None:  # those after the first, which always opens one, and their chances
            n = np.maximum(self.head - 1, 0)
            i = np.repeat(np.arange(len(self.c)), n)
            m = np.arange(1, len(i) + 1) - np.repeat(np.cumsum(n) - n, n)
            odds = self.odds(i, m)
            far = np.flatnonzero(self.c > self.head)
            low = self.reach(far, self.head[far])
            self.places = i << PLACE_BITS | m, odds / (1 + odds), far, low, np.maximum(self.reach(far, self.c[far]) - low, 0), np.flatnonzero(self.head > 0) << PLACE_BITS
        keys, chance, far, low, more, start = self.places
        j = np.repeat(np.arange(len(far)), rng.poisson(more))
        level, j = low[j] + rng.random(len(j)) * more[j], far[j]
        at = ((level * self.d / self.a[j]) ** (1 / self.d) - self.e[j]) * self.c[j] / self.z[j]
        at = np.clip(at.astype(np.int64), self.head[j], self.c[j] - 1)
        drawn = np.sort(np.concatenate([start, keys[rng.random(len(keys)) < chance], j << PLACE_BITS | at]))
        return drawn[np.diff(drawn, prepend=-1) != 0]

    def fitted(self, owner: np.ndarray, place: np.ndarray, seated: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Keys of the tables held by the first ``seated`` customers that are still there, and of new ones drawn for those who came."""
        fits, drawn = place < np.minimum(self.c, seated)[owner], self.draw(rng)
        drawn = drawn[(drawn & PLACE) >= seated[drawn >> PLACE_BITS]]
        return np.sort(np.concatenate([owner[fits] << PLACE_BITS | place[fits], drawn]))

    def weight(self, keys: np.ndarray) -> np.ndarray:
        """log of each entry's seating's weight over its chance of being drawn, but for a constant."""
        i, m = keys >> PLACE_BITS, keys & PLACE
        last = np.diff(i, append=-1) != 0
        until = np.where(last, self.c[i], np.append(m[1:], 0))
        start = np.flatnonzero(np.diff(i, prepend=-1) != 0)
        k = np.arange(1, len(i) + 1) - np.repeat(start, np.diff(np.append(start, len(i))))
        gain, more = np.zeros(len(i)), np.flatnonzero(m)
        gain[more] = np.log(self.worth.of(i[more], k[more] - 1) / self.odds(i[more], m[more]))
        old = np.flatnonzero(until > m + 1)
        gain[old] += log_gamma(until[old] - self.d * k[old]) - log_gamma(m[old] + 1 - self.d * k[old])
        return np.bincount(i, weights=gain, minlength=len(self.c))

    def accept(self, held: np.ndarray, drawn: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        take = np.log(rng.random(len(self.c))) < self.weight(drawn) - self.weight(held)
        return np.sort(np.concatenate([drawn[take[drawn >> PLACE_BITS]], held[~take[held >> PLACE_BITS]]]))


class Seating:
    """The restaurants of a bucket: entries (word, context) with customers, tables and, as ``sizes``, the
    customers from each table's opening to the next one's. ``up`` is each entry's dish in the parent.

    The first ``away`` entries are root dishes that are seated elsewhere: only what they have in all is known.
    """

    def __init__(self, word: np.ndarray, ctx: np.ndarray, own: np.ndarray, contexts: Contexts | Tree, up: np.ndarray | None = None, away: int = 0):
        self.ctx, self.own, self.contexts, self.away = ctx, own, contexts, away
        self.level = contexts.level[ctx]
        self.up = np.searchsorted(word * contexts.size + ctx, word * contexts.size + contexts.parent[ctx]) if up is None else up
        self.at = [np.flatnonzero(self.level[away:] == level) + away for level in range(3)]
        self.tables = np.zeros(len(ctx), np.int64)
        self.sizes = np.empty(0, np.int64)
        self.root = np.zeros((2, away))
        self.fresh = True

    def customers(self, level: int) -> np.ndarray:
        """Customers of a level's entries: their tokens and a table of each child's."""
        if level == 2:
            return self.own
        below = self.at[level + 1]
        return self.own + np.bincount(self.up[below], weights=self.tables[below], minlength=len(self.own)).astype(np.int64)

    def probabilities(self, totals: np.ndarray, discounts: np.ndarray, base: float, levels: int = 3) -> np.ndarray:
        """Predictive probability of each entry's word in its context, given the restaurants' sums, for the first ``levels``."""
        p = np.zeros(len(self.ctx))
        p[: self.away] = (self.root[0] - discounts[0] * self.root[1] + (STRENGTH[0] + discounts[0] * totals[1, 0]) * base) / (STRENGTH[0] + totals[0, 0])
        for level, at in enumerate(self.at[:levels]):
            c, d = self.customers(level)[at], discounts[level]
            parent = base if level == 0 else p[self.up[at]]
            full, tables = totals[0, self.ctx[at]], totals[1, self.ctx[at]]
            p[at] = (c - d * self.tables[at] + (STRENGTH[level] + d * tables) * parent) / (STRENGTH[level] + full)
        return p

    def sums(self) -> np.ndarray:
        """This bucket's customers and tables in each restaurant."""
        out = np.zeros((2, self.contexts.size))
        for level, at in enumerate(self.at):
            out[0] += np.bincount(self.ctx[at], weights=self.customers(level)[at], minlength=self.contexts.size)
            out[1] += np.bincount(self.ctx[at], weights=self.tables[at], minlength=self.contexts.size)
        return out

    def open(self) -> None:
        """Seat everyone at one table for each dish, from the longest contexts to the root."""
        sizes = np.zeros(len(self.ctx), np.int64)
        for level in (2, 1, 0):
            at = self.at[level]
            sizes[at] = self.customers(level)[at]
            self.tables[at] = sizes[at] > 0
        self.sizes = sizes[sizes > 0]

    def sweep(self, totals: np.ndarray, discounts: np.ndarray, base: float, moves: int, rng: np.random.Generator) -> None:
        """Redraw the seats of all customers of every dish, ``moves`` times, from the longest contexts to the root.

        Dishes of a restaurant are redrawn at once, given its sums from the last exchange and the
        parent's probabilities. Tables that open or close are customers that come or go in the parent, which is redrawn next.
        """
        for level in (2, 1, 0):
            at = self.at[level]
            if not len(at):
                continue
            customers, d = self.customers(level), discounts[level]
            entries = at[(customers[at] != 1) & (customers[at] + self.tables[at] > 0)]
            alone = at[customers[at] == 1]  # who has a table to himself however he is seated
            mine = self.tables[entries]
            if level:
                up = self.up[entries]
                parents, held = self.customers(level - 1), self.tables
                if level == 1:
                    parents[: self.away], held = self.root[0], np.concatenate([self.root[1], self.tables[self.away :]])
                    p = base
                else:
                    p = self.probabilities(totals, discounts, base, 1)[self.up[up]]
                above, full = parents[up], totals[0, self.ctx[up]]
                rest = np.maximum(above - mine, 0)
                open_share = (STRENGTH[level - 1] + discounts[level - 1] * totals[1, self.ctx[up]]) * p
                x = rest - discounts[level - 1] * held[up] * rest / np.maximum(above, 1) + open_share
                worth = Worth(STRENGTH[level], d, totals[1, self.ctx[entries]] - mine, x, STRENGTH[level - 1] + np.maximum(full - mine, 0), 1)
            else:
                worth = Worth(STRENGTH[0], d, totals[1, self.ctx[entries]] - mine, np.full(len(entries), base), np.ones(len(entries)), 0)
            worth.others = np.maximum(worth.others, 0)
            self.redraw(entries, customers[entries], worth.of(np.arange(len(entries)), mine), d, moves, rng, worth, alone)
        self.fresh = False

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ctx)), self.tables)

    def redraw(self, entries: np.ndarray, customers: np.ndarray, a: np.ndarray, d: float, moves: int, rng: np.random.Generator, worth: Worth, alone: np.ndarray) -> None:
        """Seat all ``customers`` of ``entries`` anew, and the only one of each of ``alone``, in steps of a bounded number of dishes and customers drawn singly.

        In a first sweep nobody keeps a seat; later, those who came since are seated by a draw before any proposal.
        """
        ends, owners = np.cumsum(self.tables), self.owners()
        places = np.cumsum(self.sizes) - self.sizes
        places -= np.repeat(places[np.minimum(ends - self.tables, max(0, len(places) - 1))], self.tables) if len(places) else 0
        tables, new = self.tables.copy(), [(alone, np.ones(len(alone), np.int64))]
        tables[alone] = 1
        seated = np.zeros(len(self.ctx), np.int64) if self.fresh else np.bincount(owners, weights=self.sizes, minlength=len(self.ctx)).astype(np.int64)
        guides = Guide(customers, a, d, worth)
        step = np.cumsum(guides.head + 1) // STEP_DRAWS
        cuts = np.flatnonzero(np.diff(step, prepend=-1, append=step[-1] + 1 if len(step) else -1))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            mine, guide = entries[i:j], guides.part(slice(i, j))
            n = self.tables[mine]
            at = np.repeat(ends[mine] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
            held = guide.fitted(np.repeat(np.arange(len(mine)), n), places[at], seated[mine], rng)
            for _ in range(moves):
                held = guide.accept(held, guide.draw(rng), rng)
            owner, place = held >> PLACE_BITS, held & PLACE
            tables[mine] = np.bincount(owner, minlength=len(mine))
            new.append((mine[owner], np.append(place[1:], 0) - place + np.where(np.diff(owner, append=-1) != 0, guide.c[owner] - np.append(place[1:], 0), 0)))
        rest = np.ones(len(self.ctx), bool)
        rest[entries] = rest[alone] = False
        kept = rest[owners]
        owner = np.concatenate([owners[kept], *[x for x, _ in new]])
        sizes = np.concatenate([self.sizes[kept], *[x for _, x in new]])
        self.sizes, self.tables = sizes[np.argsort(owner, kind="stable")], tables


#: Rows that jobs send each other: who gets it, where it comes from or goes to, and arrays.
ROW = "who long, part long, a binary, b binary, c binary, d binary, e binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame([[*row, *[None] * (7 - len(row))] for row in rows], columns=NAMES)


def cut(array: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Number, start and end of the pieces of a sorted array that lie below each of ``ends`` and have anything."""
    at = np.append(np.searchsorted(array, ends), len(array))
    starts = np.append(0, at[:-1])
    return zip(np.flatnonzero(at > starts).tolist(), starts[at > starts].tolist(), at[at > starts].tolist(), strict=True)


def hash_ends(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)


def rising(array: np.ndarray) -> bytes:
    """A sorted array of numbers below 2^32, as differences."""
    return pack(np.diff(array, prepend=0).astype(np.uint32))


def risen(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "u4"), dtype=np.int64)


BLOCKS = "block long, ids array<string>, lengths array<long>, words binary, counts binary, stream binary"


class Codes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def text_blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of documents: the sorted hashes of their words, the training tokens of each, and the texts as places in these."""

    def row_of(number: int, keys: list, codes: Codes, streams: list[np.ndarray]) -> pd.DataFrame:
        hashes, lengths = np.fromiter(map(xxhash.xxh3_64_intdigest, codes), np.uint64, len(codes)), np.array([len(x) for x in streams])
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        stream = rank[np.concatenate(streams)]
        counts = np.bincount(stream, weights=np.repeat([in_training(k) for k in keys], lengths), minlength=len(order))
        return pd.DataFrame([[number, keys, lengths.tolist(), pack(hashes[order]), pack(counts.astype(np.uint32)), pack(stream.astype(np.uint32))]], columns=[x.split()[0] for x in BLOCKS.split(", ")])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, keys, codes, streams, size = TaskContext.get().partitionId() << 24, [], Codes({END: 0}), [], 0
        for batch in batches:
            for k, t in zip(batch["_key"].tolist(), batch["_text"], strict=True):
                words = [*words_of(t), END]
                keys.append(k)
                streams.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= block_tokens:
                    yield row_of(number, keys, codes, streams)
                    number, keys, codes, streams, size = number + 1, [], Codes({END: 0}), [], 0
        if keys:
            yield row_of(number, keys, codes, streams)

    return docs.mapInPandas(blocks, BLOCKS)


def numbered_words(blocks: DataFrame, parts: int) -> DataFrame:
    """Numbers of all words, in order of their hashes, and training tokens.

    A word's number is its part's, shifted by 32 bits, and its rank in it from 1. Rows are ``who`` (block), ``part``, ranks and tokens of the block's
    words there, and of each part, as ``who`` -1, its words, those that training saw, and training tokens.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, words, counts in zip(batch["block"], batch["words"], batch["counts"], strict=True):
                words, counts = unpack(words, "u8"), unpack(counts, "u4")
                yield frame([[block, p, pack(words[i:j]), pack(counts[i:j])] for p, i, j in cut(words, hash_ends(parts))])

    def number(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words, counts = [unpack(x, "u8") for x in rows["a"]], np.concatenate([unpack(x, "u4") for x in rows["b"]])
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)
        out, ends = [], np.cumsum([len(x) for x in words])
        for block, i, j in zip(rows["who"], np.append(0, ends[:-1]), ends, strict=True):
            out.append([block, key[0], rising(at[i:j] + 1), pack(total[at[i:j]])])
        return frame([*out, [-1, key[0], pack(np.array([len(known), (total > 0).sum(), total.sum()]))]])

    return materialize(blocks.select("block", "words", "counts").mapInPandas(deal, ROW).groupBy("part").applyInPandas(number, ROW), "words")


def words_of_block(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and training tokens of a block's words."""
    rows = rows.sort_values("part")
    ranks = [risen(x) for x in rows["a"]]
    return np.concatenate([r + (p << 32) for r, p in zip(ranks, rows["part"].tolist(), strict=True)]), np.concatenate([unpack(x, "i8") for x in rows["b"]])


def distinct_triples(v: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples in order, and which of them each is."""
    wide, low = int(w.max()).bit_length(), int(u.max()).bit_length()
    if int(v.max()).bit_length() + wide + low < 64:
        found, at = np.unique((v << wide | w) << low | u, return_inverse=True)
        return found >> (wide + low), found >> low & ((1 << wide) - 1), found & ((1 << low) - 1), at
    pairs, pair = np.unique(v << wide | w, return_inverse=True)
    found, at = np.unique(pair << low | u, return_inverse=True)
    return pairs[found >> low] >> wide, pairs[found >> low] & ((1 << wide) - 1), found & ((1 << low) - 1), at


def block_entries(row: pd.Series, number: np.ndarray, count: np.ndarray, cells: Cells | None, hot: int, buckets: int) -> tuple:
    """A block's distinct entries by bucket, in order of context's last word, word and the word before: bucket, the three, whether
    the last word is spread, training tokens, and each token's entry. Words are places in the block from 1, 0 being none.
    """
    stream, lengths = unpack(row["stream"], "u4").astype(np.int64), np.array(row["lengths"])
    first = np.cumsum(lengths) - lengths
    end = stream[-1]
    v = np.concatenate([[end], stream[:-1]])  # the end of a text stands before the next one
    u = np.concatenate([[end], v[:-1]]) + 1
    u[first] = 0
    v = v + 1
    if cells:
        hashes = unpack(row["words"], "u8")
        fit = np.append(False, cells.have(hashes))
        v[~fit[v]] = 0
        u[(v == 0) | ~fit[u]] = 0
        paired = np.flatnonzero(u)
        u[paired[~cells.have(pair_hash(hashes[u[paired] - 1], hashes[v[paired] - 1]))]] = 0
    training = np.repeat([in_training(k) for k in row["ids"]], lengths)
    v, w, u, at = distinct_triples(v, stream + 1, u)
    n = np.bincount(at, weights=training, minlength=len(v)).astype(np.uint32)
    number, spread = np.append(0, number), np.append(False, count >= hot)[v]
    bucket = bucket_of(number[np.where(v == 0, w, v)], np.where(spread, number[w], 0), buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return bucket[order], number[v[order]], number[w[order]], number[u[order]], spread[order], n[order], rank[at]


def bucket_of(last: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a context's last word, or of both words where ``word`` isn't 0."""
    mixed = mix64(last.astype(np.uint64))
    return (np.where(word == 0, mixed, mix64(mixed ^ word.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


class Tree:
    """A bucket's contexts: the root, ``ones`` of one word, and those of two words, with their parents."""

    def __init__(self, ones: int, parents: np.ndarray):
        self.size = 1 + ones + len(parents)
        self.level = np.repeat([0, 1, 2], [1, ones, len(parents)])
        self.parent = np.concatenate([np.zeros(1 + ones, np.int64), parents])


class Bucket:
    """A bucket's entries as they are stored: root dishes of ``words``, then dishes of contexts of one word and of two.

    ``shared`` are the contexts of which other buckets have dishes, too, with ``keys`` that tell them everywhere.
    """

    KINDS = {"words": "i8", "word": "u4", "one": "r", "up": "r", "pair": "u4", "parents": "r", "own": "u4", "shared": "u4", "keys": "u8"}

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @staticmethod
    def of(v: np.ndarray, w: np.ndarray, u: np.ndarray, spread: np.ndarray, n: np.ndarray) -> tuple[Bucket, np.ndarray]:
        """The bucket of these entries, and the place of each of them."""
        runs = np.flatnonzero(np.diff(v, prepend=-1))
        last, v = np.unique(np.append(0, v[runs]), return_inverse=True)
        v = np.append(0, np.repeat(v[1:], np.diff(np.append(runs, len(w)))))
        (words, w), (before, u) = (np.unique(np.append(0, x), return_inverse=True) for x in (w, u))
        v, w, u, at = distinct_triples(v[1:], w[1:], u[1:])
        n = np.bincount(at, weights=n, minlength=len(v)).astype(np.int64)
        words, w = words[1:], w - 1
        some = np.flatnonzero(v > 0)
        opens = np.concatenate([[True], (v[some][1:] != v[some][:-1]) | (w[some][1:] != w[some][:-1])])[: len(some)]
        dish = np.cumsum(opens) - 1
        deep = u[some] > 0
        up = dish[deep]
        low = int(u.max()).bit_length() if len(u) else 0
        pairs, pair = np.unique(v[some][deep] << low | u[some][deep], return_inverse=True)
        one, word, parents = v[some][opens], w[some][opens], pairs >> low
        ones = int(opens.sum())
        place = np.empty(len(v), np.int64)
        place[v == 0] = w[v == 0]
        place[some] = np.where(deep, len(words) + ones + np.cumsum(deep) - 1, len(words) + dish)
        own = np.zeros(len(words) + ones + len(up), np.int64)
        own[place] = n
        hot = np.isin(last, np.unique(spread))
        hot[0] = False
        single, double = np.flatnonzero(hot), np.flatnonzero(hot[parents])
        keys = mix64(np.append(last[single], 0).astype(np.uint64))[:-1]
        keys = np.append(keys, mix64(mix64(before[pairs[double] & ((1 << low) - 1)].astype(np.uint64)) ^ (last[parents[double]].astype(np.uint64) * np.uint64(3))))
        shared, order = np.append(single, len(last) + double), np.argsort(keys)
        return Bucket(words=words, word=word, one=one, up=up, pair=pair, parents=parents, own=own, shared=shared[order], keys=keys[order]), place[at]

    def blob(self) -> bytes:
        out = b""
        for name, kind in self.KINDS.items():
            array = getattr(self, name)
            piece = rising(array) if kind == "r" else pack(array.astype(kind))
            out += len(piece).to_bytes(8, "little") + piece
        return out

    @staticmethod
    def load(blob: bytes) -> Bucket:
        out, start = {}, 0
        for name, kind in Bucket.KINDS.items():
            end = start + 8 + int.from_bytes(blob[start : start + 8], "little")
            piece, start = blob[start + 8 : end], end
            out[name] = unpack(piece, "u4").astype(np.int64) if kind == "u4" else risen(piece) if kind == "r" else unpack(piece, kind)
        return Bucket(**out)

    def seating(self) -> Seating:
        words, ones = len(self.words), len(self.one)
        count = int(self.one.max()) if ones else 0
        tree = Tree(count, self.parents)
        ctx = np.concatenate([np.zeros(words, np.int64), self.one, 1 + count + self.pair])
        up = np.concatenate([np.arange(words), self.word, words + self.up])
        return Seating(np.empty(0, np.int64), ctx, self.own, tree, up, words)

    def sent(self, who: int, seating: Seating, kept: np.ndarray, parts: int) -> list[list]:
        """The seating as the row of part -1, and by part what it adds to words' root dishes and to shared contexts."""
        out = [[who, -1, pack(seating.tables.astype(np.uint32)), pack(seating.sizes.astype(np.uint32)), rising(kept)]]
        customers, keys = seating.customers(0), self.keys[kept]
        sums = seating.sums()[:, self.shared[kept]] if len(kept) else np.zeros((2, 0))
        rows = {p: [rising(self.words[i:j] & 0xFFFFFFFF), pack(customers[i:j].astype(np.uint32))] for p, i, j in cut(self.words >> 32, np.arange(1, parts))}
        asks = {p: [pack(keys[i:j]), *[pack(x[i:j].astype(np.uint32)) for x in sums]] for p, i, j in cut(keys, hash_ends(parts))}
        nothing = pack(np.empty(0, np.uint32))
        for p in sorted({*rows, *asks}):
            out.append([who, p, *rows.get(p, [nothing, nothing]), *asks.get(p, [pack(np.empty(0, np.uint64)), nothing, nothing])])
        return out

    def told(self, rows: pd.DataFrame, root: tuple[float, float]) -> tuple[Seating, np.ndarray, np.ndarray]:
        """The seating that the row of part -1 and the answers to it make, its restaurants' sums, and the shared contexts that others have."""
        state, heard = rows[rows["part"] < 0].iloc[0], rows[rows["part"] >= 0].sort_values("part")
        seating, kept = self.seating(), risen(state["c"])
        seating.tables, seating.sizes = unpack(state["a"], "u4").astype(np.int64), unpack(state["b"], "u4").astype(np.int64)
        join = lambda name, kind="u4": np.concatenate([np.empty(0, kind), *[unpack(x, kind) for x in heard[name]]]).astype(np.int64)
        seating.root = np.stack([join("a"), join("b")])
        totals = seating.sums()
        totals[:, self.shared[kept]] = join("c", "i8"), join("d", "i8")
        totals[:, 0] = root
        return seating, totals, kept[join("e") > 1]


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over, which Spark deletes once the driver has collected their plans."""
    spark._jvm.System.gc()


def joined(rows: DataFrame, other: DataFrame) -> DataFrame:
    return rows.select(*NAMES).unionByName(other.select(*NAMES))


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", sweeps: int = SWEEPS, burn_in: int = BURN_IN, moves: int = MOVES, least: int = LEAST, hot: int = HOT, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, seed: int = 3) -> DataFrame:
    """``_key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Scores are log10 probabilities of the whole text and its end, under the averaged predictive
    probabilities of the samples after ``burn_in`` sweeps. Rows whose id has crc32 2 modulo 7 aren't learnt
    from. Null texts are empty and have the end alone; null ids are the text ``None``; repeated rows count as often
    as they come. An empty table gives no rows; very long texts make long blocks. Columns besides ``text`` and ``key`` aren't
    looked at. Words that training never saw share one part in V + 1 of the root's base. Scores don't depend on how rows
    are dealt to tasks: counts are exact, buckets follow from the number of tokens, and each draws from its own seed.
    """
    spark = docs.sparkSession
    base_docs = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    kind = docs.select(F.col(key).alias("_key")).schema["_key"].dataType.simpleString()
    ship(spark)
    cells = context_cells(base_docs, least) if least > 1 else None
    width = max(8, (base_docs.select(F.sum(F.octet_length("_text"))).first()[0] or 0) // (6 * block_tokens))  # about the number of blocks
    blocks = in_buckets(text_blocks(base_docs, block_tokens), "block", width)
    tokens = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(8, -(-tokens // bucket_tokens))
    words = numbered_words(blocks, buckets)
    if not cells:  # which alone need the words' hashes again
        hashed, blocks = blocks, in_buckets(blocks.drop("words", "counts"), "block", width)
        dropped_buckets(hashed)
    known = [unpack(r[0], "i8") for r in words.filter("who = -1").select("a").collect()]
    vocabulary, train_tokens = (int(sum(x[i] for x in known)) for i in (1, 2))
    base = 1 / (vocabulary + 1)

    def deal(keys: tuple, mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, v, w, u, spread, n, _ = block_entries(mine.iloc[0], *words_of_block(rows), cells, hot, buckets)
        out = []
        for b, i, j in cut(bucket, np.arange(1, buckets)):
            out.append([keys[0], b, pack(v[i:j]), pack(w[i:j]), pack(u[i:j]), pack(n[i:j]), pack(spread[i:j].view(np.uint8))])
        return frame(out)

    def merge(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("who")
        v, w, u, n, spread = (np.concatenate([unpack(x, kind) for x in rows[name]]) for name, kind in (("a", "i8"), ("b", "i8"), ("c", "i8"), ("d", "u4"), ("e", "u1")))
        bucket, at = Bucket.of(v, w, u, v[spread > 0], n)
        ends = np.cumsum([len(unpack(x, "u1")) for x in rows["e"]])
        # places rise within a block but for steps between levels
        seating = bucket.seating()
        seating.open()
        few = [int((seating.customers(level)[seating.at[level]] == c).sum()) for level in (1, 2) for c in (1, 2)]
        sent = bucket.sent(keys[0], seating, np.arange(len(bucket.keys)), buckets)
        sent[0].append(pack(np.array(few)))
        places = zip(rows["who"], np.append(0, ends[:-1]), ends, strict=True)
        out = frame([*sent, [keys[0], -1, bucket.blob()], *[[keys[0], block, pack(np.diff(at[i:j], prepend=0).astype(np.int32).view(np.uint32))] for block, i, j in places]])
        return out.assign(asked=np.arange(len(out)) < len(sent))

    dealt = blocks.groupBy("block").cogroup(words.filter("who >= 0").groupBy("who")).applyInPandas(deal, ROW)
    merged = in_buckets(dealt.groupBy("part").applyInPandas(merge, ROW + ", asked boolean"), "who", buckets)
    static = merged.filter("part = -1 and not asked").select("who", "a")

    swept(spark)
    asked, parts, samples = merged.filter("asked").select(*NAMES), None, []
    few = [unpack(r[0], "i8") for r in asked.filter("part = -1").select("d").collect()]
    discounts = np.array([0, *[estimate(*sum(x[2 * i : 2 * i + 2] for x in few)) if few else 0.5 for i in (0, 1)]], float)

    def root_step(number: int, discounts: np.ndarray, before: tuple[float, float]):
        def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            part, state = int(keys[0]), rows[rows["who"] < 0]
            rows = rows[rows["who"] >= 0].sort_values("who")
            ranks = [risen(x) - 1 for x in rows["a"]]
            own = np.bincount(np.concatenate(ranks), weights=np.concatenate([unpack(x, "u4") for x in rows["b"]])).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
            seating = Seating(np.arange(len(own)), np.zeros(len(own), np.int64), own, Contexts(np.zeros(1, np.uint64)))
            if number:
                seating.tables, seating.sizes = (unpack(state[x].iloc[0], "u4").astype(np.int64) for x in ("a", "b"))
                seating.fresh = number == 1
                seating.sweep(np.array(before, float).reshape(2, 1), discounts, base, moves, np.random.default_rng([seed, number, buckets + part]))
            else:
                seating.open()
            keys_of = [unpack(x, "u8") for x in rows["c"]]
            found, at = np.unique(np.concatenate([np.empty(0, np.uint64), *keys_of]), return_inverse=True)
            sums = [np.bincount(at, weights=np.concatenate([np.empty(0), *[unpack(x, "u4") for x in rows[name]]])).astype(np.int64) for name in ("d", "e")]
            askers, ends = np.bincount(at), np.cumsum([len(x) for x in keys_of])
            out = [[-1, part, pack(seating.tables.astype(np.uint32)), pack(seating.sizes.astype(np.uint32)), pack(np.array([own.sum(), seating.tables.sum(), (own == 1).sum(), (own == 2).sum()]))]]
            for who, mine, end, size in zip(rows["who"], ranks, ends, map(len, keys_of), strict=True):
                k = at[end - size : end]
                out.append([who, part, pack(own[mine].astype(np.uint32)), pack(seating.tables[mine].astype(np.uint32)), *[pack(x[k]) for x in sums], pack(askers[k].astype(np.uint32))])
            return frame(out)

        return run

    def step(number: int, root: tuple[float, float]):
        def run(keys: tuple, mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            bucket = Bucket.load(mine["a"].iloc[0])
            seating, totals, kept = bucket.told(rows, root)
            seating.fresh = not number
            seating.sweep(totals, discounts, base, moves, np.random.default_rng([seed, number, int(keys[0])]))
            return frame(bucket.sent(int(keys[0]), seating, kept, buckets))

        return run

    root, done, kept = (0.0, 0.0), [], []
    for number in range(sweeps + 1):
        requests = asked.filter("part >= 0")
        heard = materialize((joined(requests, parts) if parts else requests).groupBy("part").applyInPandas(root_step(number, discounts, root), ROW), "heard")
        for table in done:
            drop_table(table)
        swept(spark)
        known = [unpack(r[0], "i8") for r in heard.filter("who = -1").select("c").collect()]
        sums = np.sum(known, axis=0) if known else np.zeros(4)
        if not number:
            discounts = np.append(estimate(sums[2], sums[3]), discounts[1:])
        root, parts = (float(sums[0]), float(sums[1])), heard.filter("who = -1")
        told = joined(asked.filter("part = -1"), heard.filter("who >= 0"))
        if number > burn_in:
            samples.append((number, root, told))
            kept += [*[asked][: int(number > 0)], heard]
        done = [*[asked][: int(number > 0)], heard] if number <= burn_in else []
        if number < sweeps:
            asked = materialize(static.groupBy("who").cogroup(told.groupBy("who")).applyInPandas(step(number, root), ROW), "seats")
    roots = {number: root for number, root, _ in samples}

    def answer(keys: tuple, mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, p = Bucket.load(mine["a"][mine["part"] < 0].iloc[0]), 0.0
        for number, root in roots.items():
            seating, totals, _ = bucket.told(rows[rows["number"] == number], root)
            p = p + seating.probabilities(totals, discounts, base)
        p = np.log10(p / len(roots)).astype(np.float32)
        places = mine[mine["part"] >= 0]
        return frame([[block, keys[0], pack(p[np.cumsum(unpack(x, "u4").view(np.int32), dtype=np.int64)])] for block, x in zip(places["part"], places["a"], strict=True)])

    told = None
    for number, _, rows in samples:
        rows = rows.withColumn("number", F.lit(number))
        told = rows if told is None else told.unionByName(rows)
    answers = merged.filter("not asked").select("who", "part", "a").groupBy("who").cogroup(told.groupBy("who")).applyInPandas(answer, ROW)
    answers = materialize(answers, "answers")
    dropped_buckets(merged)
    for table in kept:
        drop_table(table)
    swept(spark)

    def score(keys: tuple, mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        row, found = mine.iloc[0], rows[rows["answer"]].sort_values("part")
        number, count = words_of_block(rows[~rows["answer"]])
        at = block_entries(row, number, count, cells, hot, buckets)[-1]
        p = np.concatenate([unpack(x, "f4").astype(float) for x in found["a"]])[at]
        stream, lengths = unpack(row["stream"], "u4"), np.array(row["lengths"])
        first = np.cumsum(lengths) - lengths
        simple = np.log10((count + 1.0) / (train_tokens + vocabulary + 1))
        return pd.DataFrame({"_key": row["ids"], "held_out": [not in_training(k) for k in row["ids"]], "n_tokens": lengths, "n_known": np.add.reduceat((count > 0)[stream].astype(np.int64), first), "train_tokens": train_tokens, "base_score": np.add.reduceat(simple[stream], first), "score": np.add.reduceat(p, first)})

    rows = words.filter("who >= 0").select("who", "part", "a", "b", F.lit(False).alias("answer")).unionByName(answers.select("who", "part", "a", "b", F.lit(True).alias("answer")))
    schema = "_key string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(rows.groupBy("who")).applyInPandas(score, schema).withColumn("_key", F.col("_key").cast(kind))


def estimate(one: float, two: float) -> float:
    """A level's discount, from its dishes of one customer and of two."""
    return min(0.95, max(0.05, one / max(1, one + 2 * two)))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents")).withColumnRenamed("_key", "doc_id")
