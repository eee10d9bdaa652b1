"""Token files: documents as lists of token ids in Parquet that is laid out for selective reads.

A folder holds ``tokens``, one row per document in ascending order of ids, and ``parts``, one row per file of it. Token
ids are dictionary-encoded (or delta-encoded), the numbers beside them delta-encoded; row groups and pages have a set size,
and pages have indexes, so a reader of some documents, of a span of tokens, or of lengths alone reads little else.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from barloom.llm.packing import ragged
from barloom.llm.shared import read, row_place, shared_dir, shuffle_width

END_ID = 0
#: Pieces whose ids a worker remembers.
CACHED_PIECES = 1_000_000
#: Bytes of texts that are encoded at once.
SLICE = 10 << 20
#: Letters below this one (Latin, Greek, Cyrillic) are letters for Python and the tokenizer alike.
LETTERS = "\u0530"
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on.
_printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
SYMBOLS = dict(zip([b for b in range(256) if b not in _printable], range(256, 512), strict=False))
NUMBERS = ["part", "offset", "stop", "ids_crc32"]


@dataclass(frozen=True)
class Layout:
    """How files are written: ids by ``dictionary`` or by ``delta``, bytes of a row group and of a page, most rows of a page."""

    ids: str = "dictionary"
    row_group: int = 16 << 20
    page: int = 64 << 10
    page_rows: int = 1000
    codec: str = "zstd"

    def options(self, numbers: list[str]) -> dict[str, str]:
        if self.ids not in ("dictionary", "delta"):
            raise ValueError("ids are encoded by dictionary or delta")
        flags = {f"parquet.enable.dictionary#{c}": "false" for c in numbers} | {"parquet.enable.dictionary#ids.list.element": str(self.ids == "dictionary").lower()}
        return flags | {"parquet.writer.version": "v2", "parquet.block.size": str(self.row_group), "parquet.page.size": str(self.page), "parquet.page.row.count.limit": str(self.page_rows), "compression": self.codec}


class PieceIds(dict):
    """Ids of a byte-level tokenizer, each piece of a text encoded once while it is remembered.

    Pieces are what lies between spaces, with the space before it, so the key of a text's first piece starts with a
    space instead. The tokenizer's own pattern ends at such a space too, unless white space stands on both sides of it: those
    texts are encoded whole, as are texts that hold ``<|``, which may start a special token. Pieces can be encoded
    together, as every id stands for a known number of bytes.
    """

    def __init__(self, path: str, most: int = CACHED_PIECES):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]  # a character stands for a byte
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in ".,"}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pending: list[str] = []
        self.flat, self.starts, self.known = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0
        self.opens, self.closes = np.zeros(1 << 12, bool), np.zeros(1 << 12, bool)  # white space at a piece's start or end

    def __missing__(self, piece: str) -> int:
        self[piece] = code = self.known + len(self.pending)
        self.pending.append(piece)
        return code

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def word(self, word: str) -> list[int]:
        """Ids of a space and a word of letters: the pattern takes it whole, so the model alone is asked."""
        symbols = f"Ġ{word}" if word.isascii() else f" {word}".encode().decode("latin-1").translate(SYMBOLS)
        return [t.id for t in self.tokenizer.model.tokenize(symbols)]

    def joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces with a space before each, one after the other, and how many each has; no piece starts or ends with white space."""
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        blocks = [pieces[at : at + 256] for at in range(0, len(pieces), 256)]
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(b) for b in blocks], add_special_tokens=False)
        for some, found in zip(blocks, (np.asarray(e.ids, np.int32) for e in encoded), strict=True):
            ends = np.cumsum([1 + (len(p) if p.isascii() else len(p.encode())) for p in some])
            ids.append(found)
            counts.append(np.diff(np.searchsorted(np.cumsum(self.bytes[found]), ends), prepend=-1))
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self) -> None:
        """Find the ids of the pieces met since the last call; a word with a full stop or comma behind it is the word and the mark."""
        new, base = self.pending, self.known
        marked = [i for i, p in enumerate(new) if p[-1:] in self.marks and p[-2:-1].isalpha() and p[-2] < LETTERS]
        cores = np.array([self[new[i][:-1]] for i in marked], np.int64)  # unknown ones join the pieces to find
        n, is_marked = len(new), np.zeros(len(new), bool)
        is_marked[marked] = True
        opens = np.array([not p or p[0].isspace() for p in new], bool)
        closes = np.array([not p or p[-1].isspace() for p in new], bool)
        alone = np.flatnonzero((opens | closes) & ~is_marked)
        letters = np.array([p.isalpha() and max(p) < LETTERS for p in new], bool)
        simple, plain = np.flatnonzero(letters), np.flatnonzero(~(opens | closes | is_marked | letters))
        words = [self.word(new[i]) for i in simple]
        ids, counts = self.joined([new[i] for i in plain])
        rest = [self.whole(new[i][1:] if new[i][:1] == " " else " " + new[i]) for i in alone]
        lengths = np.zeros(n, np.int64)
        lengths[plain], lengths[alone], lengths[simple] = counts, [len(x) for x in rest], [len(x) for x in words]
        known = cores < base
        of_core = np.zeros(len(cores), np.int64)
        of_core[known] = self.starts[cores[known] + 1] - self.starts[cores[known]]
        of_core[~known] = lengths[cores[~known] - base]
        lengths[is_marked] = of_core + 1
        first = self.room(lengths, opens, closes)
        self.flat[ragged(first[plain], counts)] = ids
        self.flat[ragged(first[simple], lengths[simple])] = np.fromiter(itertools.chain.from_iterable(words), np.int32)
        self.flat[ragged(first[alone], lengths[alone])] = np.concatenate([np.empty(0, np.int32), *rest])
        self.flat[ragged(first[is_marked], of_core)] = self.flat[ragged(self.starts[cores], of_core)]
        self.flat[first[is_marked] + of_core] = [self.marks[new[i][-1]] for i in marked]
        self.pending = []

    def room(self, lengths: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Where the ids of new pieces start."""
        total, n = int(self.starts[self.known]), self.known + len(lengths)
        while total + int(lengths.sum()) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n >= len(self.starts):
            self.starts, self.opens, self.closes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.opens, self.closes))
        self.starts[self.known + 1 : n + 1] = total + np.cumsum(lengths)
        self.opens[self.known : n], self.closes[self.known : n] = opens, closes
        first = self.starts[self.known : n].copy()
        self.known = n
        return first

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with ``end_id`` behind each, and how many each has; null is empty."""
        if len(self) > self.most or int(self.starts[self.known]) > 8 * self.most:
            self.forget()
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        bounds = np.asarray(split.offsets).astype(np.int64)
        bounds -= bounds[0]
        words = split.flatten().dictionary_encode()
        at = np.asarray(words.indices)
        firsts, known = at[bounds[:-1]], words.dictionary.to_numpy(zero_copy_only=False).tolist()
        later = np.ones(len(at), bool)
        later[bounds[:-1]] = False
        code = np.fromiter(map(self.__getitem__, known), np.int64, len(known))[at]
        code[bounds[:-1]] = np.fromiter((self[" " + known[i]] for i in firsts), np.int64, len(firsts))
        if self.pending:
            self.learn()
        unsure = np.flatnonzero(self.closes[code[:-1]] & self.opens[code[1:]] & later[1:]) + 1
        apart = np.asarray(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False), bool)
        apart[np.searchsorted(bounds, unsure, "right") - 1] = True
        counts = self.starts[code + 1] - self.starts[code]
        ids = self.flat[ragged(self.starts[code], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[bounds]
        lengths = np.diff(ends)
        if apart.any():
            parts = [self.whole(texts[i].as_py()) if apart[i] else ids[ends[i] : ends[i + 1]] for i in range(len(lengths))]
            lengths = np.array([len(x) for x in parts], np.int64)
            ids = np.concatenate(parts)
        stops = np.cumsum(lengths + 1)
        out = np.full(int(stops[-1]) if len(stops) else 0, end_id, np.int32)
        inner = np.ones(len(out), bool)
        inner[stops - 1] = False
        out[inner] = ids
        return out, lengths + 1


_encoders: dict[str, PieceIds] = {}


def encoder(path: str) -> PieceIds:
    """The process's one encoder of a tokenizer."""
    if path not in _encoders:
        _encoders[path] = PieceIds(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch cut so that the texts of a column come to about ``SLICE`` bytes, or one text has more."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    number = (np.cumsum(sizes) - sizes) // SLICE
    starts = np.concatenate([np.flatnonzero(np.diff(number, prepend=-1)), [batch.num_rows]])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def token_rows(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """One row per document in files' order: ``doc_id, part, offset, stop, ids_crc32, ids``.

    Documents are dealt by ranges of their id, and rows of one id by their place in the table, so a range is bounded
    whatever ids repeat; ``part`` is the range, and ``offset`` and ``stop`` count the ids before a document and up to its end in
    its part.
    """
    place, parts = row_place(docs), parts or shuffle_width(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_last(), F.col("_place")]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), place.alias("_place"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "_text")
    kind = dealt.schema["doc_id"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, total = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, 1):
                ids, lengths = known.encode(some.column(1), end_id)
                stops = np.cumsum(lengths)
                offsets = stops - lengths
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, stops, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(offsets, stops[-1]), pa.int32()), pa.array(ids, pa.int32()))
                numbers = [pa.array(np.full(len(lengths), part, np.int32)), pa.array(total + offsets), pa.array(total + stops), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([some.column(0), *numbers, lists], ["doc_id", *NUMBERS, "ids"])
                total += int(stops[-1])

    long = [StructField(c, LongType()) for c in NUMBERS[1:]]
    schema = StructType([StructField("doc_id", kind.dataType), StructField("part", IntegerType()), *long, StructField("ids", ArrayType(IntegerType(), False))])
    return dealt.mapInArrow(write, schema)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID, layout: Layout = Layout(), parts: int | None = None) -> None:  # noqa: B008
    """Write ``docs`` as token files in the new folder ``path``.

    Each text is encoded whole, however long, and ``end_id`` put behind it; a null text is empty, so it has that id alone. Null ids
    come last; rows of one id stay in the order of the table, repeated rows as often as they come. No documents make no rows. Other columns aren't
    looked at, whatever their names. ``parts``, the last table written, marks the folder as whole.
    """
    spark = docs.sparkSession
    rows = token_rows(docs, tokenizer, text, key, end_id, parts)
    names = ["doc_id", *NUMBERS] if rows.schema["doc_id"].dataType.simpleString() in ("bigint", "int") else NUMBERS
    rows.write.options(**layout.options(names)).parquet(f"{path}/tokens")
    files = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count(F.lit(1)).alias("documents"), F.max("stop").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids``: ``start`` counts the ids of all documents before. A reader of the numbers alone reads no ids."""
    parts = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("_start"))
    rows = spark.read.parquet(f"{path}/tokens").join(parts, "part")
    return rows.select("doc_id", (F.col("_start") + F.col("offset")).alias("start"), (F.col("stop") - F.col("offset")).alias("n_tokens"), "ids_crc32", "ids")


def span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids from place ``first`` up to ``last`` of all ids: ``doc_id, start, ids``, the first and last document's cut.

    The parts' table says which parts hold them and where in a part they start and stop; those bounds go to the scan,
    which skips files, row groups and pages.
    """
    parts = spark.read.parquet(f"{path}/parts").filter((F.col("start") < last) & (F.col("start") + F.col("tokens") > first))
    low, high = parts.agg(F.min(F.struct("part", "start")), F.max(F.struct("part", "start"))).first()
    rows = spark.read.parquet(f"{path}/tokens")
    if low is None:
        return rows.filter("false").select("doc_id", F.col("offset").alias("start"), "ids")
    rows = rows.filter(F.col("part").between(low["part"], high["part"]))
    rows = rows.filter((F.col("part") > low["part"]) | (F.col("stop") > first - low["start"])).filter((F.col("part") < high["part"]) | (F.col("offset") < last - high["start"]))
    rows = rows.join(parts.select("part", F.col("start").alias("_start")), "part").withColumn("_start", F.col("_start") + F.col("offset"))
    cut = F.greatest(F.lit(0), first - F.col("_start"))
    length = F.least(F.size("ids").cast("long"), last - F.col("_start")) - cut
    return rows.select("doc_id", (F.col("_start") + cut).alias("start"), F.slice("ids", (cut + 1).cast("int"), length.cast("int")).alias("ids"))


def read_digests(rows: DataFrame) -> DataFrame:
    """``n_tokens`` and ``ids_crc32`` of the column ``ids`` as it was read, in place of it."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], [*batch.schema.names[:-1], "n_tokens", "ids_crc32"])

    rest = [c for c in rows.columns if c != "ids"]
    schema = StructType([*rows.select(rest).schema, StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])
    return rows.select(*rest, "ids").mapInArrow(digest, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_digests(documents(spark, path).select("doc_id", "start", "ids"))
