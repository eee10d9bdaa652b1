"""Token files, ball k-means and ranked search, against the tokenizer, plain Lloyd rounds and plain scoring."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import ball_kmeans, ranked_search, token_files
from barloom.llm.shared import materialize

SCHEMA = "doc_id long, text string, ids string, part string, _key string, block string"
SPACES = ["a\x1cb.\x1cc d", "x \n y  z\n\n\nQ  ", "don't. I'll, it's\tgo ", "<|endoftext|> hi", "", " ", "\n", "日本 語。 . ,. a., .a. é.", "a  b   c", "the end", "a" * 5000, "été, où."]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(token_files.default_tokenizer())


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_equal_tokenizer(plain):
    """Texts of all kinds of white space, marks and special tokens; a memory that is full forgets."""
    rng = random.Random(3)
    texts = SPACES + ["".join(rng.choice(" \n\t 　ab.,'s19é日<|") for _ in range(rng.randrange(60))) for _ in range(1500)] + [None]
    for most in (10, 10**6):
        known = token_files.PieceIds(token_files.default_tokenizer(), most)
        for at in range(0, len(texts), 100):
            ids, lengths = known.encode(pa.array(texts[at : at + 100], pa.string()), 0)
            assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [ids_of(plain, t) for t in texts[at : at + 100]]
    assert len(token_files.PieceIds(token_files.default_tokenizer()).encode(pa.array([], pa.string()), 0)[1]) == 0


@pytest.fixture(scope="module")
def token_table(spark):
    rows = [(i, f"{t} number {i}") for i, t in enumerate(SPACES * 80)] + [(None, "no id"), (3, None), (3, "again three"), (3, "again three"), (7_000, "word " * 30_000)]
    random.Random(1).shuffle(rows)
    return materialize(spark.createDataFrame([(i, t, "x", "y", "z", "b") for i, t in rows], SCHEMA), "tokens")


@pytest.mark.parametrize("way", ["dictionary", "delta"])
def test_token_files(spark, token_table, plain, tmp_path, way):
    path = str(tmp_path / way)
    token_files.write_tokens(token_table, path, token_files.default_tokenizer(), layout=token_files.Layout(ids=way, row_group=4000, page=1000, page_rows=20), parts=3)
    rows = token_files.documents(spark, path).orderBy("start").collect()
    source = token_table.collect()
    want = Counter((r["doc_id"], tuple(ids_of(plain, r["text"]))) for r in source)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted((k for k in keys if k is not None)) + [None]
    starts = np.cumsum([0] + [len(r["ids"]) for r in rows])
    assert [r["start"] for r in rows] == starts[:-1].tolist() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    read = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_files.read_digests(token_files.documents(spark, path).select("doc_id", "start", "ids")).collect()}
    assert read == {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in rows}
    # a span of tokens, from the middle of a document to the middle of another
    flat = [i for r in rows for i in r["ids"]]
    for first, last in ((0, 10), (17, 950), (starts[40] + 1, starts[200] + 2), (len(flat) - 5, len(flat) + 9), (len(flat) + 1, len(flat) + 5)):
        some = token_files.span(spark, path, int(first), int(last)).orderBy("start").collect()
        assert [i for r in some for i in r["ids"]] == flat[first:last] and (not some or some[0]["start"] == first)
    # layout: several row groups, pages with indexes, encodings by column
    groups = 0
    for file in (tmp_path / way / "tokens").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                coded = set(column.encodings)
                delta = way == "delta" if column.path_in_schema.startswith("ids.") else True
                assert column.has_offset_index and ("DELTA_BINARY_PACKED" in coded if delta else "RLE_DICTIONARY" in coded and "DELTA_BINARY_PACKED" not in coded)
    assert groups > 3


def test_token_reads_are_selective(spark, token_table, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_tokens(token_table, path, token_files.default_tokenizer(), parts=4)

    def scan(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return next(x for x in plan.splitlines() if "FileScan" in x and "offset#" in x)

    assert "ids" not in scan(token_files.documents(spark, path).select("doc_id", "start", "n_tokens")).split("ReadSchema")[1].replace("ids_crc32", "")
    assert "PushedFilters: [" in (one := scan(token_files.documents(spark, path).filter("doc_id = 7"))) and "EqualTo(doc_id,7)" in one
    assert "GreaterThanOrEqual(part," in scan(token_files.span(spark, path, 100, 200))


def test_no_documents_make_no_tokens(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), path, token_files.default_tokenizer())
    assert token_files.documents(spark, path).count() == 0 and token_files.span(spark, path, 0, 9).count() == 0


def lloyd(vectors, k, rounds):
    """Plain rounds over all centroids: each row's cluster and squared distance, and the centroids."""
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, hashlib.sha256(f"2:{vectors[i][0]}".encode()).hexdigest() if vectors[i][0] is not None else "", vectors[i][1]))
    centroids = [list(vectors[i][1]) for i in order[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in vectors]
        if step < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, n) in zip(vectors, near, strict=True) if n == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return near, centroids


@pytest.mark.parametrize(("k", "spread"), [(12, 0.2), (5, 1.0), (40, 0.05), (400, 0.2)])
def test_balls_equal_lloyd(spark, k, spread):
    rng = np.random.default_rng(k)
    middles = rng.normal(0, 1, (8, 6))
    rows = [(i, (middles[i % 8] + rng.normal(0, spread, 6)).tolist(), 0, "c") for i in range(300)]
    rows += [(7, rows[7][1], 0, "c")] * 40 + [(400 + i, [float(i % 3), 0.0, 0.0, 0.0, 0.0, 0.0], 0, "c") for i in range(30)] + [(None, rows[1][1], 0, "c")]
    bad = [(900, None, 0, "c"), (901, [1.0], 0, "c"), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, "c"), (903, [math.nan] + [0.0] * 5, 0, "c"), (904, [math.inf] + [0.0] * 5, 0, "c"), (905, [], 0, "c")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int, cluster string").repartition(3)
    members, clusters = ball_kmeans.ball_kmeans(table, k=k, rounds=4, dims=6)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows]
    near, centroids = lloyd(whole, k, 4)
    found = Counter((r["_key"], tuple(r["components"]), r["cluster"], r["distance"]) for r in members.collect())
    assert found == Counter((i, tuple(v), n, d) for (i, v), (d, n) in zip(whole, near, strict=True))
    of = {r["cluster"]: r for r in clusters.collect()}
    assert [list(of[j]["centroid"]) for j in range(len(centroids))] == centroids
    assert sum(r["inertia"] for r in of.values()) == sum(d for d, _ in near) and sum(r["size"] for r in of.values()) == len(whole)
    if k == 12:  # balls apart from each other: most comparisons of later rounds are left out
        assert of[0]["taken"] < 0.6 * 5 * k * len(whole)


def test_balls_of_few_and_large_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    members, clusters = ball_kmeans.ball_kmeans(spark.createDataFrame([(1, None)], schema), dims=2)
    assert members.count() == 0 and clusters.count() == 0
    members, _ = ball_kmeans.ball_kmeans(spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], schema), k=1, rounds=0, dims=2)
    assert {r["_key"]: r["components"] for r in members.collect()} == {1: [2**27, -(2**27)], 2: [0, 0]}
    with pytest.raises(ValueError, match="clusters"):
        ball_kmeans.ball_kmeans(spark.createDataFrame([], schema), k=10_000)


def ranked(docs, items, top):
    """Every document's score for every item, plainly."""
    split = [Counter(ranked_search.terms_of(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in split]
    n, words, out = sum(s > 0 for s in sizes), sum(sizes), []
    df = Counter(t for c in split for t in c)
    for item, text in items:
        scores = []
        for (key, _), c, size in zip(docs, split, sizes, strict=True):
            m = 100 - 25 + (25 * size * n) // words
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(ranked_search.terms_of(text)).items() if c[t])
            if score:
                scores.append((-score, key is None, key or 0))
        out += [(item, rank, None if none else key, -s) for rank, (s, none, key) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize(("passes", "block", "head"), [(200_000, 2048, 64), (20, 8, 1), (200_000, 64, 2)])
def test_ranks_equal_plain_scoring(spark, monkeypatch, passes, block, head):
    """With items in one pass or many, documents in one block or many, and long and short heads."""
    monkeypatch.setattr(ranked_search, "PASS_TERMS", passes)
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    rng = np.random.default_rng(5)
    word = lambda: f"W{min(int(rng.exponential(25)), 90)}"
    docs = [(i, " ".join(word() for _ in range(rng.integers(1, 60)))) for i in range(500)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(None, docs[4][1]), (2000, None), (2001, ""), (2002, "Éa-ÉA w1_w2"), (2003, "w5 " * 20_000), (5, docs[5][1])]
    items = [(i, " ".join(word() for _ in range(rng.integers(1, 12)))) for i in range(12)] + [(50, None), (51, "nowhere"), (52, "éa Éa w1"), (None, "w1 w2 w2"), (3, "w1"), (54, docs[3][1])]
    table = materialize(spark.createDataFrame([(i, t, "x", 1, None, "q") for i, t in docs], "doc_id long, text string, _text string, block int, score string, item string").repartition(3), "docs")
    queries = materialize(spark.createDataFrame([(i, t, "k", "p") for i, t in items], "item_id long, text string, _key string, place string"), "items")
    found = ranked_search.ranked_search(table, queries, top=7, head=head)
    assert Counter(tuple(r) for r in found.collect()) == Counter(ranked(docs, items, 7))


def test_cuts_leave_documents_out(spark):
    """Most documents hold a common word alone, which no bound needs."""
    docs = [(i, "common " + (f"rare{i // 20 % 5} " * 3 if i % 20 == 0 else "filler")) for i in range(2000)]
    items = ranked_search.Items([Counter(ranked_search.terms_of("common rare1 rare2"))])
    table = materialize(spark.createDataFrame(docs, "doc_id long, text string"), "docs")
    blocks = materialize(ranked_search.blocks_of(table, items, "text", "doc_id"), "blocks")
    items.weigh(ranked_search.term_counts(blocks))
    postings = materialize(ranked_search.postings_of(blocks, items), "postings")
    bounds = ranked_search.lower_bounds(blocks, ranked_search.heads(postings, 3), items, 5)
    left = sum(int(np.unpackbits(np.frombuffer(r["docs"], np.uint8)).sum()) for r in ranked_search.candidates(postings, items, bounds).collect())
    assert 0 < left <= 40


def test_no_documents_no_ranks(spark):
    schema = "doc_id long, text string"
    none, items = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.ranked_search(none, items).count() == 0
    assert ranked_search.ranked_search(spark.createDataFrame([(1, "a")], schema), items.limit(0)).count() == 0
    assert ranked_search.ranked_search(spark.createDataFrame([(1, "...")], schema), items).schema.names == ["_query", "rank", "_key", "score"]
    assert ranked_search.ranked_search(spark.createDataFrame([(1, "a")], schema), items).select(F.count("score")).first()[0] == 1
