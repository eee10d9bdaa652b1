"""Packing: documents as token ids, first-fit decreasing with a tournament tree, in random groups."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import materialize, read, row_place

SEQUENCE = 4096
END_ID = 2
#: Tokens a group should hold: about a thousand sequences, packed by one task.
GROUP_TOKENS = 4_000_000
#: Words whose ids a worker remembers.
CACHED_WORDS = 600_000


class WordIds(dict):
    """Token ids of words between ASCII white space, each encoded once while it is remembered.

    Right for tokenizers that lower-case text, split it at white space, drop that, and never join
    across it, as the one in use does. Texts that hold ``<|``, which may be the start of a special
    token, are encoded whole.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.marks = {ord(m): self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in ".,"}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pending: list[bytes] = []
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.known = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = code = self.known + len(self.pending)
        self.pending.append(word)
        return code

    def learn(self) -> None:
        """Find the ids of the words met since the last call; a known word of letters with a full stop or comma isn't encoded anew."""
        self.pending, new = [], self.pending
        known = [self.get(w[:-1], self.known) if w[-1] in self.marks and w[-2:-1].isalpha() else self.known for w in new]
        built = np.array(known) < self.known
        cores = np.array(known)[built]
        self.place(np.flatnonzero(built), cores, [self.marks[new[i][-1]] for i in np.flatnonzero(built)], self.encoded([w.decode() for w, b in zip(new, built, strict=True) if not b]), len(new))

    def place(self, built: np.ndarray, cores: np.ndarray, marks: list[int], rest: tuple[np.ndarray, np.ndarray], n: int) -> None:
        """Append the ids of ``n`` new words: those of a known word and its stop, and those just encoded."""
        count = self.starts[cores + 1] - self.starts[cores]
        lengths = np.zeros(n, np.int64)
        lengths[built] = count + 1
        others = np.setdiff1d(np.arange(n), built, assume_unique=True)
        lengths[others] = rest[1]
        first = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.uint32)
        out[ragged(first[built], count)] = self.flat[ragged(self.starts[cores], count)]
        out[first[built] + count] = marks
        out[ragged(first[others], rest[1])] = rest[0]
        self.append(out, lengths)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has.

        A run of letters is one unit of the tokenizer, and with full stops or commas behind it two, so
        such words are encoded joined by spaces, and units tell their ids apart. Others go one by one.
        """
        cores = [w.rstrip(".,") for w in words]
        units = np.fromiter((c.isalpha() and 1 + (len(c) < len(w)) for c, w in zip(cores, words, strict=True)), np.int64, len(words))
        lengths, ids = np.zeros(len(words), np.int64), [np.empty(0, np.uint32)] * len(words)
        plain, order, blocks = np.flatnonzero(units), [], []
        for i in range(0, len(plain), 1024):
            some = plain[i : i + 1024]
            encoded = self.tokenizer.encode(" ".join([words[j] for j in some]), add_special_tokens=False)
            per_unit = np.bincount(np.asarray(encoded.word_ids, np.int64), minlength=int(units[some].sum()))
            ends = np.cumsum(units[some])
            if len(per_unit) != ends[-1]:
                units[some] = 0
                continue
            lengths[some] = np.add.reduceat(per_unit, ends - units[some])
            order.append(some)
            blocks.append(np.asarray(encoded.ids, np.uint32))
        rest = np.flatnonzero(units == 0)
        ids = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[j] for j in rest], add_special_tokens=False)]
        lengths[rest] = [len(x) for x in ids]
        order, found = np.concatenate([*order, rest]), np.concatenate([*blocks, *ids, np.empty(0, np.uint32)])
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(lengths[order]) - lengths[order]
        return found[ragged(first, lengths)], lengths

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        total = int(self.starts[self.known])
        while total + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.known + len(lengths) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[total : total + len(ids)] = ids
        self.starts[self.known + 1 : self.known + 1 + len(lengths)] = total + np.cumsum(lengths)
        self.known += len(lengths)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        if len(self) > self.most:
            self.forget()
        texts = [t if isinstance(t, str) else "" for t in texts]
        split = [() if "<|" in t else t.encode("utf-8", "replace").lower().split() for t in texts]
        codes = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in split]
        if self.pending:
            self.learn()
        for text, code in zip(texts, codes, strict=True):
            if "<|" in text:
                yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield self.flat[ragged(self.starts[code], self.starts[code + 1] - self.starts[code])]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of every run, one run after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


_encoders: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, text: str, key: str, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Cut each document into pieces of at most ``sequence`` ids, the end id included.

    Gives ``_key, start, length, doc_tokens, ids``; ids are little-endian unsigned 32-bit integers.
    A null text is empty: one piece that holds the end id alone.
    """
    schema = docs.select(F.col(key).alias("_key")).schema
    kind = schema["_key"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoders.setdefault(tokenizer, None) or WordIds(tokenizer)
        _encoders[tokenizer] = encoder
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                rows = []
                for k, ids in zip(some["_key"], encoder.encode(list(some["_text"])), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(k, start, len(part := ids[start : start + sequence]), len(ids), part.tobytes()) for start in range(0, len(ids), sequence)]
                yield pd.DataFrame(rows, columns=["_key", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text")).mapInPandas(cut, "_key string, start long, length long, doc_tokens long, ids binary").withColumn("_key", F.col("_key").cast(kind))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each size.

    Sizes are placed from the largest to the smallest, each into the leftmost bin with room. The bins' room
    is held in a tournament tree, a node being the larger of its two children, so the leftmost bin
    is found by going down from the root: left wherever the left child has room.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
    return bins, offsets


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, group_tokens: int = GROUP_TOKENS, seed: int = 5) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    Pieces go to random groups of about ``group_tokens`` tokens, so a group's size doesn't follow
    any key; each group is packed on its own. ``pieces`` should be a table in files, as it is read
    once for its total and once to be packed.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_tokens))
    columns = pieces.columns
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), F.col("_key").cast("string"), "start", "length", row_place(pieces)), F.lit(groups)))
    kind = pieces.schema["_key"].dataType.simpleString()
    dealt = dealt.withColumn("_key", F.col("_key").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(columns).schema) + ", sequence_id long, offset long"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_key", "start"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), sequence)
        return rows[columns].assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    return dealt.groupBy("_group").applyInPandas(pack, schema).withColumn("_key", F.col("_key").cast(kind))


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", keep_ids: bool = True, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents with their sequence and offset: ``_key, start, length, doc_tokens,
    ids_crc32, sequence_id, offset``, and the ids themselves unless ``keep_ids`` is false.

    Repeated rows are packed as often as they come, null ids like any other. An empty table gives
    no pieces. A very long text is cut into pieces like any other; ties of size go by id and start; other columns aren't
    looked at. Sequences are padded at the end up to ``sequence``; see ``sequences``.
    """
    pieces = token_pieces(docs, text, key, tokenizer, sequence).withColumn("ids_crc32", F.crc32("ids"))
    return pack_pieces(materialize(pieces if keep_ids else pieces.drop("ids"), "pieces"), sequence)


def sequences(packed: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """One row per sequence: its ids, padded to ``sequence`` unless their number is a power of two, and the number of ids before padding."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(rows.sort_values("offset")["ids"]), "<u4")
        size = len(ids) if len(ids) & (len(ids) - 1) == 0 else sequence
        return pd.DataFrame({"sequence_id": [rows["sequence_id"].iloc[0]], "used": [len(ids)], "ids": [np.pad(ids, (0, size - len(ids)), constant_values=pad_id).astype("int32")]})

    return packed.groupBy("sequence_id").applyInPandas(join, "sequence_id long, used long, ids array<int>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read(spark, sf_dir, "documents"), default_tokenizer(), keep_ids=False)
    return packed.select(F.col("_key").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
