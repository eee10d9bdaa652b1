"""Operators on small tables with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import chat, exact_dedup, lm_score, mixing, near_dedup, nn_descent, packing, quality, registry, substring_dedup, url_filter
from barloom.llm.components import connected_components
from barloom.llm.shared import materialize, row_place

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _key string, _row string"
WORDS = [f"w{i:04d}" for i in range(400)]
BASE = " ".join(WORDS[:120])
NEAR = " ".join([*WORDS[:119], "other"])
LONG = " ".join(WORDS[i * i % 400] for i in range(9000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(5, BASE, "s1"), (3, BASE.replace(" ", "  "), "s1"), (9, NEAR, None), (7, None, "s2"), (8, "", "s2"), (None, "a null id here", "s2"), (11, "one", "s3"), (12, LONG, "s3"), (11, "one", "s3"), (13, " x " + " ".join(WORDS[200:290]), "s1"), (14, " ".join(WORDS[300:330]) + " " + " ".join(WORDS[205:285]), "é")]
    table = spark.createDataFrame([(i, t, "en", s, 0, True, "k", "r") for i, t, s in rows], SCHEMA)
    return materialize(table, "fixture")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (3, 1, 0), (12, 0, 0), (None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")


def test_exact(docs, none):
    out = {(r["_key"], r["kept"]): r for r in exact_dedup.exact_classes(docs).collect()}
    assert out[(3, True)]["group_size"] == 2 and out[(5, False)]["keep_id"] == 3
    assert out[(7, True)]["group_size"] == 2 and out[(8, False)]["keep_id"] == 7
    assert (11, True) in out and (11, False) in out and out[(None, True)]["keep_id"] is None
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    assert exact_dedup.exact_classes(none).count() == 0


def test_merge_exchanges_runs_by_place_alone(spark, docs):
    for fan_in, rounds in ((2, 2), (4, 1)):
        merged = exact_dedup.merge_runs(exact_dedup.in_runs(exact_dedup.digests(docs), fan_in), fan_in)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(exchanges) == rounds and all("hashpartitioning(_place#" in x and x.split("hashpartitioning(")[1].split("]")[0].count("#") == 1 for x in exchanges)
        assert "HashAggregate" not in plan and plan.count("Sort [_place#") == rounds and plan.count("Sort [_run#") == 1
        assert sum(r["_size"] for r in merged.collect()) == docs.count()


def test_query_merges_in_rounds(spark):
    """The query's own plan at eight partitions: runs merged where they are, then three binomial rounds."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = exact_dedup.op7_exact_dedup(spark, "/root/testdata/sf0.001")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sum("hashpartitioning(_place#" in x for x in plan.splitlines() if "Exchange" in x) == 3
        assert plan.count("Sort [_place#") == 3 and plan.count("Sort [_run#") == 1
        assert out.count() == 200 and not [t for t in spark.catalog.listTables() if t.name.startswith("barloom_")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_are_merged_before_they_move(spark):
    """Of a text that most rows hold, a run sends one entry to the first round."""
    table = materialize(spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(4), "hot")
    rows = exact_dedup.in_runs(exact_dedup.digests(table), 2)
    merged = exact_dedup.merge_runs(rows, 2)
    assert merged.count() == 1001 and {r["_size"] for r in merged.filter("_size > 1").collect()} == {2000}
    local = rows.groupBy("_run", *exact_dedup.DIGEST).count()
    assert "Exchange" not in local._jdf.queryExecution().executedPlan().toString() and local.count() <= 1000 + 4


def test_mixing(docs, none):
    rows = [r.asDict() for r in mixing.mix_plan(docs).collect()]
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    sums = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6
        sums.setdefault(r["_src"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    assert all(abs(k - t) <= 1 for k, t, _ in sums.values())
    # brute force water filling
    order = sorted(k for k in sums if k is not None) + [None]
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    held = set()
    while True:
        level = (total - sum(3 * sums[k][2] for k in held)) / sum(w for k, w in weight.items() if k not in held)
        more = {k for k, w in weight.items() if k not in held and w * level > 3 * sums[k][2]}
        if not more:
            break
        held |= more
    for k in order:
        assert sums[k][1] == pytest.approx(3 * sums[k][2] if k in held else weight[k] * level)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.text_size("text"))).first()[0] == sum(r["taken"] for r in rows)
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_sources(none).count() == 0


def test_quality(docs, none, labels):
    out = quality.quality_decisions(docs, labels)
    assert out.count() == docs.count()
    values = sorted(r["priority"] for r in out.collect())
    for k in (1, 4, len(values)):
        assert quality.kth_largest(out, "priority", k) == values[-k]
    assert quality.quality_filter(docs, labels).columns == docs.columns
    assert quality.quality_filter(docs, labels.limit(0)).count() == docs.count()
    assert quality.quality_filter(none, labels).count() == 0


def test_weights_equal_brute_force(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in marks.collect() if r["quality"] == 1}
    both = [Counter(), Counter()]
    for i, t in texts.items():
        found = quality.buckets_of(t).tolist()
        both[1].update(found)
        if i in good:
            both[0].update(found)
    half = quality.BUCKETS // 2
    sums = [[sum(n for b, n in c.items() if (b < half) == low) + half / 2 for low in (True, False)] for c in both]
    weight = lambda b: np.log((both[0][b] + 0.5) / sums[0][b >= half]) - np.log((both[1][b] + 0.5) / sums[1][b >= half])
    out = quality.quality_decisions(docs, marks).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r["log_weight"] == pytest.approx(sum(weight(b) for b in quality.buckets_of(texts[r["_key"]]).tolist()), abs=1e-6)
    kept = [r["priority"] for r in out if r["kept"]]
    assert min(kept) > max((r["priority"] for r in out if not r["kept"]), default=-np.inf)


def test_mixing_over_many_buckets(docs, monkeypatch):
    whole = {(r["_key"], r["_row"]): (r["target"], r["source_size"]) for r in mixing.mix_plan(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKET_WORDS", 40)
    sums = {}
    for r in mixing.mix_plan(docs).collect():
        assert whole[r["_key"], r["_row"]] == (r["target"], r["source_size"])
        sums.setdefault((r["_src"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(x) - t) <= 1 for (_, t), x in sums.items())


def test_packing_in_many_groups(docs):
    pieces = materialize(packing.token_pieces(docs, "text", "doc_id", packing.default_tokenizer(), 512).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    rows = packing.pack_pieces(pieces, 512, group_tokens=4000).collect()
    place = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert place.get(r["sequence_id"], 0) == r["offset"]
        place[r["sequence_id"]] = r["offset"] + r["length"]
    assert len({k >> 32 for k in place}) > 1 and max(place.values()) <= 512
    assert Counter((r["_key"], r["start"], r["ids_crc32"]) for r in rows) == Counter((r["_key"], r["start"], r["ids_crc32"]) for r in pieces.collect())


def test_packing(docs, none):
    path = packing.default_tokenizer()
    packed = packing.pack_documents(docs, path)
    rows = packed.collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        want[(r["doc_id"], tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]))] += 1
    for (key, ids), n in want.items():
        mine = [r for r in rows if r["_key"] == key and r["doc_tokens"] == len(ids)]
        found = Counter((r["start"], r["ids"]) for r in mine)
        for start in range(0, len(ids), 4096):
            assert found[(start, np.array(ids[start : start + 4096], "<u4").tobytes())] >= n
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    place = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert place.get(r["sequence_id"], 0) == r["offset"]
        place[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(place.values()) <= 4096
    full = packing.sequences(packed).collect()
    assert sorted((r["used"]) for r in full) == sorted(place.values())
    assert packing.pack_documents(none, path).count() == 0


def test_word_ids_equal_tokenizer():
    ids = packing.WordIds(packing.default_tokenizer())
    for text in ["The, THE. Don't ... x.,y", "a<|endoftext|>b", "a\xa0b c\x1cd\x85e\x0bf\x0cg", "ΣΑΣ, é x", "日本語 テスト,", "a\x00b", ""]:
        assert next(iter(ids.encode([text]))).tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing():
    sizes = np.random.default_rng(0).integers(1, 60, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        assert bins[i] == b and offsets[i] == 100 - room[b]
        room[b] -= sizes[i]


def test_near(spark, docs, none):
    out = {(r["_key"], r["n_shingles"]): r for r in near_dedup.near_classes(docs).collect()}
    assert out[(9, 116)]["component_id"] == 3 and out[(5, 116)]["component_id"] == 3 and out[(3, 116)]["kept"]
    assert out[(7, 0)]["kept"] and out[(8, 0)]["kept"] and out[(11, 1)]["component_id"] == 11
    assert near_dedup.near_dedup(docs).columns == docs.columns
    assert near_dedup.near_dedup(none).count() == 0
    # a chain whose ends are too far apart, found through the leftover pairs
    chain = [" ".join(f"v{j}" if j < 12 * i else w for j, w in enumerate(WORDS[:150])) for i in range(4)]
    table = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    sets = [set(near_dedup.shingle_set(t).tolist()) for t in chain]
    assert all(100 * len(a & b) >= 75 * len(a | b) for a, b in zip(sets, sets[1:], strict=False))
    assert {r["component_id"] for r in near_dedup.near_classes(table).collect()} == {0}


def near_groups(texts):
    """Smallest id of each text's component, by sets of all pairs."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    same = {i: i for i in texts}

    def root(i):
        while same[i] != i:
            i = same[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                same[b] = a
    return {i: (root(i), len(sets[i])) for i in ids}


def test_near_equals_brute_force(spark):
    """The smallest table, and random near copies of its first texts at every similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = np.random.default_rng(3)
    for i, text in [r for r in rows if 40 < len((r[1] or "").split()) < 400][:60]:
        words = text.split()
        for copy in range(3):
            changed = list(words)
            for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0, 0.06))), replace=False):
                changed[at] = f"new{rng.integers(0, 10**9)}"
            rows.append((10_000 + 10 * i + copy, " ".join(changed)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_groups(dict(rows))
    found = {r["_key"]: (r["component_id"], r["n_shingles"]) for r in near_dedup.near_classes(materialize(table, "near")).collect()}
    assert found == want and len({a for a, _ in want.values()}) < len(rows) - 60


def test_estimate_is_near():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[600:], rng.integers(0, 2**63, 500).astype(np.uint64)])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    found = near_dedup.joint_estimate(near_dedup.registers_of(a)[None], near_dedup.registers_of(b)[None], np.array([len(a)]), np.array([len(b)]))
    assert abs(found[0] - true) < 0.2
    union = near_dedup.registers_of(np.union1d(a, b))
    assert (union == np.maximum(near_dedup.registers_of(a), near_dedup.registers_of(b))).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 50), (None, 3), (60, 61), (61, 60)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(out[i] == i // 10 * 10 for i in range(40)) and out[61] == 60 and 50 not in out


def test_urls(spark):
    link = '<html><link href="{}" rel="canonical"></html>'
    pages = [(1, "http://a.org/x", link.format("http://bad.net/y")), (2, "http://b.org/fr/x", link.format("http://a.org/x")), (3, "http://c.org/q?a=1", '<meta http-equiv="refresh" content="0; url=/z">'), (4, None, None), (5, "no scheme", ""), (6, "HTTP://Sub.Example.NET/en/p#f", ""), (7, "http://net", ""), (8, "http://bad.net/y", None), (8, "http://bad.net/y", None)]
    rows = [(r[: r.index("/")], r[r.index("/") :], v) for r, v in url_filter.RULES]
    rules = spark.createDataFrame(rows, "host string, path string, verdict string")
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (1000, 0):
        url_filter.LITERAL_RULES, old = limit, url_filter.LITERAL_RULES
        out = {r["_key"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(table, rules).collect()}
        url_filter.LITERAL_RULES = old
        assert out == {1: ("a.org", "/x", None, "block"), 2: ("b.org", "/fr/x", "org/fr/", "allow"), 3: ("c.org", "/q", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("sub.example.net", "/en/p", "example.net/en/", "allow"), 7: ("net", "", None, "allow"), 8: ("bad.net", "/y", "net/", "block")}
    assert url_filter.judge(table.limit(0), rules).count() == 0


def test_relative_links(spark):
    base = "http://A.org/x/y/page?q=1#f"
    links = {"../b": "http://a.org/x/b", "./b": "http://a.org/x/y/b", "/x/../b": "http://a.org/b", "?p=1": "http://a.org/x/y/page?p=1", "#g": "http://a.org/x/y/page?q=1", "../../../b/.": "http://a.org/b/", "c": "http://a.org/x/y/c", "//B.net/z": "http://b.net/z"}
    rows = spark.createDataFrame([(base, k, v) for k, v in links.items()], "base string, link string, want string")
    assert rows.filter(url_filter.node_of(url_filter.resolved(F.col("base"), F.col("link"))) != F.col("want")).collect() == []


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 5, "user", "a"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c"), (4, 2, "user", "c"), (5, 0, None, None), (None, 0, "user", "z")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r["conv"]: (r["n_turns"], r["copies"], r["rendered"]) for r in chat.format_chats(table).collect()}
    assert set(out) == {2, 5, None} and out[2][:2] == (3, 2)
    assert out[2][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert chat.format_chats(table.limit(0)).count() == 0


def test_chat_parts(spark):
    """Conversations of more turns than a part, many rows in one turn, and clashing columns."""
    turns = [(1, i, "user", f"t{i}") for i in range(1203)] + [(2, i, "user", f"t{i}") for i in range(700)] + [(None, 0, "user", f"x{i:04d}") for i in range(1100)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(3), "n": F.lit(0), "place": F.lit("p"), "segment": F.lit(None)})
    out = sorted(((r["conv"] or 0, r["part"], r["n_turns"], r["rendered"]) for r in chat.format_chats(table).collect()))
    render = lambda rows: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in rows)
    want = [(c, p, n, render([x[2:] for x in turns if (x[0] or 0) == c][500 * p : 500 * p + 500])) for c, n in ((0, 1100), (1, 1203)) for p in range(3)]
    assert out == want


def test_chat_orders_by_whole_texts(spark):
    """Rows of one turn and role whose texts share their first 32 characters, in an order that their hashes don't have, against SQL."""
    head = "the same thirty-two characters.."
    turns = [(c, 1, "user", f"{head}{x}") for c in (1, 2) for x in "dgbaehcf"] + [(1, 2, "user", "more"), (3, 0, "user", head), (3, 0, "user", head + "é"), (3, 0, "user", head + "z"), (None, 0, "user", head + "2"), (None, 0, "user", head + "10")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv"]: r["rendered"] for r in chat.format_chats(table).collect()}
    render = lambda rows: "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in rows)
    assert got == {1: render([*[head + x for x in "abcdefgh"], "more"]), 3: render([head, head + "z", head + "é"]), None: render([head + "10", head + "2"])}
    con = duckdb.connect()
    con.register("conversations", table.filter("conv_id is not null").toPandas())
    assert {r[0]: r[4] for r in con.execute(chat.ORACLE).fetchall()} == {k: v for k, v in got.items() if k}


def test_scores(docs, none):
    rows = lm_score.score_texts(docs).collect()
    assert len(rows) == docs.count()
    counts = Counter()
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update([*(r["text"] or "").split(), None])
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        assert r["train_tokens"] == total and np.isfinite(r["score"]) and r["score"] < 0
    empty = next(r for r in rows if r["_key"] == 7)
    assert empty["n_tokens"] == 1 and empty["base_score"] == pytest.approx(np.log10((counts[None] + 1) / (total + distinct + 1)))
    assert lm_score.score_texts(none).count() == 0


def test_a_rare_context_counts_in_a_corpus_of_any_size(spark):
    """What followed two words twice is foretold after them, however many other texts there are."""
    learnt, held = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 7 != 2], [i for i in range(9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    for size in (20, 600):
        texts = [(i, " ".join(f"f{(i * 31 + j * j * 7) % 400}" for j in range(20))) for i in learnt[:size]]
        texts += [(i, "north wind rises") for i in learnt[-2:]] + [(i, f"{x} rises") for i, x in zip(learnt[-8:-2], "abcdef", strict=True)]
        table = spark.createDataFrame([*texts, (held[0], "north wind rises"), (held[1], "wind north rises")], "doc_id long, text string")
        rows = {r["_key"]: r["score"] for r in lm_score.score_texts(table).collect()}
        assert rows[held[0]] > rows[held[1]] + 2
        other = {r["_key"]: r["score"] for r in lm_score.score_texts(table.repartition(5), least=1).collect()}
        assert other == rows


def test_probabilities_sum_to_one():
    contexts = lm_score.Contexts(np.array([0, 1 << 24, 2 << 24, (2 << 24) + 3], np.uint64))
    words, per = 30, 4
    rng = np.random.default_rng(0)
    seating = lm_score.Seating(np.repeat(np.arange(words), per), np.tile(np.arange(per), words), rng.integers(0, 5, words * per), contexts)
    seating.open()
    d, base = np.array([0.6, 0.7, 0.7]), 1 / (words + 1)
    for i in range(4):
        seating.sweep(seating.sums(), d, base, 3, np.random.default_rng(i))
        seated = np.bincount(seating.owners(), weights=seating.sizes, minlength=len(seating.ctx))
        for level in range(3):
            at = seating.level == level
            assert (seated[at] == seating.customers(level)[at]).all()
    p = seating.probabilities(seating.sums(), d, base)
    sums = seating.sums()
    unseen = (1.0 + d[0] * sums[1, 0]) * base / (1.0 + sums[0, 0])
    assert p[seating.ctx == 0].sum() + unseen == pytest.approx(1)


def test_sweep_redraws_whole_dishes():
    """Tables of a dish follow their exact distribution given its customers, however many they are."""
    contexts, dishes = lm_score.Contexts(np.zeros(1, np.uint64)), 2000
    for customers, worth, d in ((3, 5.0, 0.7), (20, 0.5, 0.6), (300, 900.0, 0.6), (600, 40.0, 0.7)):
        seating = lm_score.Seating(np.arange(dishes), np.zeros(dishes, np.int64), np.full(dishes, customers), contexts)
        seating.open()
        totals, base = np.array([[0.0], [(1000 * worth - 1) / d]]), 0.001
        for i in range(4):
            seating.sweep(totals, np.full(3, d), base, 2, np.random.default_rng(i))
        chance, t = np.zeros(customers + 1), np.arange(customers + 1)
        chance[1] = 1
        for n in range(1, customers):
            chance = np.append(0, chance[:-1]) * worth + chance * np.maximum(n - d * t, 0)
            chance /= chance.sum()
        mean = (chance * t).sum()
        sd = np.sqrt((chance * (t - mean) ** 2).sum())
        assert seating.tables.mean() == pytest.approx(mean, abs=0.15 * sd + 0.01) and seating.tables.std() == pytest.approx(sd, rel=0.2)
        assert (np.bincount(seating.owners(), weights=seating.sizes) == customers).all()


class PlainModel:
    """The hierarchical model customer by customer: leave a table at random, sit down by the Chinese-restaurant chances."""

    def __init__(self, discounts, base, seed):
        self.tables, self.d, self.base, self.rng = {}, discounts, base, np.random.default_rng(seed)

    def p(self, u, w):
        parent = self.p(u[:-1], w) if u else self.base
        dishes = self.tables.get(u, {})
        c, t = (sum(sum(x) for x in dishes.values()), sum(len(x) for x in dishes.values()))
        mine, d = dishes.get(w, []), self.d[len(u)]
        return (sum(mine) - d * len(mine) + (1 + d * t) * parent) / (1 + c)

    def sit(self, u, w):
        dishes, d = self.tables.setdefault(u, {}), self.d[len(u)]
        mine = dishes.setdefault(w, [])
        chances = [n - d for n in mine] + [(1 + d * sum(len(x) for x in dishes.values())) * (self.p(u[:-1], w) if u else self.base)]
        i = self.rng.choice(len(chances), p=np.array(chances) / sum(chances))
        if i < len(mine):
            mine[i] += 1
        else:
            mine.append(1)
            if u:
                self.sit(u[:-1], w)

    def leave(self, u, w):
        mine = self.tables[u][w]
        i = self.rng.choice(len(mine), p=np.array(mine) / sum(mine))
        mine[i] -= 1
        if not mine[i]:
            mine.pop(i)
            if u:
                self.leave(u[:-1], w)


def test_scores_equal_plain_sampler(spark):
    """Averaged scores are those of a customer-by-customer sampler, however rows and dishes are dealt; a richer model gains more."""
    rng = np.random.default_rng(6)
    after = rng.integers(0, 25, (25, 3))
    texts = []
    for _ in range(70):
        words = [int(rng.integers(0, 25))]
        while len(words) < 30:
            words.append(int(after[words[-1]][rng.integers(0, 3)]) if rng.random() < 0.8 else int(min(24, rng.exponential(6))))
        texts.append(words)
    table = spark.createDataFrame([(i, " ".join(f"v{w}" for w in x)) for i, x in enumerate(texts)], "doc_id long, text string")
    least, run = 25, {"sweeps": 14, "burn_in": 4, "bucket_tokens": 400}
    gains = []
    for low in (10**9, least):
        rows = {r["_key"]: r for r in lm_score.score_texts(table.coalesce(1), least=low, **run).collect()}
        other = {r["_key"]: r["score"] for r in lm_score.score_texts(table.repartition(7), least=low, block_tokens=200, **run).collect()}
        assert other == {k: r["score"] for k, r in rows.items()}
        gains.append(np.mean([(r["score"] - r["base_score"]) / r["n_tokens"] for r in rows.values() if r["held_out"]]))
    assert gains[1] > gains[0] + 0.1
    spread = {r["_key"]: r["score"] for r in lm_score.score_texts(table, least=least, hot=120, **{**run, "bucket_tokens": 250}).collect()}

    tokens = [(i, [None, *x][max(0, j - 1) : j + 1][::-1], w) for i, x in enumerate(texts) for j, w in enumerate([*x, None])]
    train = [(u, w) for i, u, w in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    ones, twos = Counter(u[0] for u, _ in train), Counter(tuple(u) for u, _ in train if len(u) == 2)

    def context(u):
        if ones[u[0]] < least:
            return ()
        return tuple(u) if len(u) == 2 and ones[u[1]] >= least and twos[tuple(u)] >= least else (u[0],)

    train = [(context(u), w) for u, w in train]
    seen = [{(u, w) for u, w in train if len(u) >= n} for n in (0, 1, 2)]
    total, vocabulary = len(train), len({w for _, w in train})
    first = Counter(train)
    one = Counter((u[:1], w) for (u, w), n in first.items() for _ in range(n if len(u) == 1 else 1) if u)
    few = [[sum(c == k for c in x.values()) for k in (1, 2)] for x in (Counter(), one, {k: c for k, c in first.items() if len(k[0]) == 2})]
    root = Counter(w for (u, w), n in first.items() for _ in range(n if not u else 0)) + Counter(w for _, w in one)
    few[0] = [sum(c == k for c in root.values()) for k in (1, 2)]
    d = [min(0.95, max(0.05, a / max(1, a + 2 * b))) for a, b in few]
    assert seen[2] and total == next(iter(rows.values()))["train_tokens"]
    model, sums = PlainModel(d, 1 / (vocabulary + 1), 1), Counter()
    for u, w in train:
        model.sit(u, w)
    for sweep in range(40):
        for u, w in train:
            model.leave(u, w)
            model.sit(u, w)
        if sweep >= 10:
            for key in {(context(u), w) for _, u, w in tokens}:
                sums[key] += model.p(*key) / 30
    want = Counter()
    for i, u, w in tokens:
        want[i] += np.log10(sums[context(u), w])
    for found in ({k: r["score"] for k, r in rows.items()}, spread):
        gap = [(found[i] - want[i]) / rows[i]["n_tokens"] for i in want]
        assert abs(np.mean(gap)) < 0.01 and np.max(np.abs(gap)) < 0.05, (np.mean(gap), np.max(np.abs(gap)))


def test_passages(docs, none):
    out = [(r["_key"], r["source_key"]) for r in substring_dedup.repeated_passages(docs).collect()]
    pairs = {frozenset(p) for p in out}
    assert frozenset((13, 14)) in pairs and {5, 3, 9} <= {i for p in out for i in p}
    assert not {7, 8, 11} & {i for p in out for i in p}
    assert substring_dedup.repeated_passages(none).count() == 0


def test_passages_of_two_halves(spark):
    """Two documents share 60 to 90 words whose halves were held before by different documents."""
    rng, rows, want = np.random.default_rng(8), [], []
    fill = lambda n: [f"f{v}" for v in rng.integers(0, 10**12, n)]
    for half in [30] * 15 + [38] * 15 + [45] * 15:
        one, two = fill(half), fill(half)
        texts = [fill(60) + one + fill(60), fill(60) + two + fill(60), fill(60) + one + two + fill(60), fill(60) + one + two + fill(60)]
        want.append((len(rows) + 3, len(rows) + 2))
        rows += [(len(rows) + i, " ".join(x)) for i, x in enumerate(texts)]
    table = materialize(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "halves")
    found = [r for r in substring_dedup.repeated_passages(table, stable=True).collect()]
    assert sorted((r["_key"], r["source_key"]) for r in found) == sorted(want)
    assert all(r["equal"] >= 60 for r in found)


def test_passages_of_overlapping_parts(spark):
    """Parts of a passage were held before by several documents, and overlap; a document holds another's passage twice."""
    rng, rows, want = np.random.default_rng(12), [], []
    fill = lambda n: [f"f{v}" for v in rng.integers(0, 10**12, n)]
    for _ in range(20):
        whole = fill(90)
        texts = [fill(60) + whole[i : i + 40] + fill(60) for i in (0, 15, 30, 50)] + [fill(60) + whole + fill(60), fill(60) + whole + fill(60)]
        want.append((len(rows) + 5, len(rows) + 4))
        rows += [(len(rows) + i, " ".join(x)) for i, x in enumerate(texts)]
    once = fill(70)
    twice = len(rows)
    rows += [(twice, " ".join(fill(30) + once + fill(30))), (twice + 1, " ".join(fill(30) + once + fill(80) + once + fill(9)))]
    table = materialize(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "parts")
    found = substring_dedup.repeated_passages(table, stable=True).collect()
    assert {(r["_key"], r["source_key"]) for r in found} == {*want, (twice + 1, twice)}
    assert sorted(r["start"] for r in found if r["_key"] == twice + 1) == [30, 180]


def test_passages_equal_brute_force(spark):
    """Every run of 50 equal words of two documents lies in a passage found in both, and links join the two."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: tuple((r["text"] or "").lower().split()) for r in docs.collect()}
    found = substring_dedup.repeated_passages(docs.withColumns({"row": F.lit(1), "source": F.lit("s"), "start": F.lit(0)}), stable=True).collect()
    first, same = {}, {i: i for i in texts}

    def root(i):
        while same[i] != i:
            i = same[i]
        return i

    covered = {i: np.zeros(len(w), bool) for i, w in texts.items()}
    for r in found:
        covered[r["_key"]][r["start"] : r["end"]] = True
        covered[r["source_key"]][r["source_start"] : r["source_end"]] = True
        same[root(r["_key"])] = root(r["source_key"])
        mine, other = texts[r["_key"]][r["start"] : r["end"]], texts[r["source_key"]][r["source_start"] : r["source_end"]]
        assert min(len(mine), len(other)) >= 30 and r["equal"] >= 0.75 * max(len(mine), len(other)) and sum((Counter(mine) & Counter(other)).values()) >= r["equal"]
    grams = 0
    for i, words in sorted(texts.items()):
        for at in range(len(words) - 49):
            gram = words[at : at + 50]
            j, there = first.setdefault(gram, (i, at))
            if j != i:
                grams += 1
                assert root(i) == root(j) and covered[i][at : at + 50].mean() > 0.7 and covered[j][there : there + 50].mean() > 0.7
    assert grams > 500


def planted_recall(spark, words, share):
    """Share of passages found of ``words`` words with ``share`` of them equal, scattered substitutions."""
    rng, rows = np.random.default_rng(9), []
    fill = lambda n: [f"f{v}" for v in rng.integers(0, 10**12, n)]
    for _ in range(150):
        one = fill(words)
        two = list(one)
        for i in rng.choice(words, words - int(np.ceil(words * share)), replace=False):
            two[i] = fill(1)[0]
        rows += [(len(rows) + i, " ".join(fill(40) + x + fill(40))) for i, x in enumerate((one, two))]
    table = materialize(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "planted")
    pairs = {(r["_key"], r["source_key"]) for r in substring_dedup.repeated_passages(table, stable=True).collect()}
    assert all(k == s + 1 and k % 2 for k, s in pairs)
    return len(pairs) / 150


def test_fuzzy_passages(spark):
    """Few seeds are shared by short or changed passages; one has to do."""
    found = {(n, p): planted_recall(spark, n, p) for n in (60, 120) for p in (0.75, 0.8, 0.85, 0.9)}
    print(found)
    assert found[60, 0.9] >= 0.85 and found[120, 0.9] >= 0.9 and found[120, 0.85] >= 0.85 and found[60, 0.85] >= 0.6


def test_passages_come_whole(spark):
    """Sixty equal words, then hundreds with every sixth or seventh changed, before or behind: ends grow until the texts differ."""
    rng, rows, want = np.random.default_rng(11), [], []
    fill = lambda n: [f"f{v}" for v in rng.integers(0, 10**12, n)]
    for pair in range(40):
        words = 260 if pair % 4 else 1200
        one = fill(words)
        two = [w if i < 60 or i % (6 + pair % 2) else fill(1)[0] for i, w in enumerate(one)]
        one, two = (one, two) if pair % 3 else (one[::-1], two[::-1])
        rows += [(len(rows) + i, " ".join(fill(300) + x + fill(300))) for i, x in enumerate((one, two))]
        want.append(words)
    table = materialize(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "planted")
    found = {}
    for r in substring_dedup.repeated_passages(table, stable=True).collect():
        assert r["_key"] == r["source_key"] + 1 and r["equal"] >= 0.75 * (r["end"] - r["start"]) and r["end"] - r["start"] == r["source_end"] - r["source_start"]
        found[r["source_key"] // 2] = max(found.get(r["source_key"] // 2, 0), r["end"] - r["start"])
    assert all(want[n] - 10 <= found[n] <= want[n] + 6 for n in range(40))


def test_chains_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, y = rng.integers(0, 300, 25), rng.integers(0, 300, 25)
        chain = substring_dedup.best_chains(x, y)[0]
        order = np.lexsort((-y, x))
        a, b, best = x[order], y[order], np.zeros(25)
        for i in range(25):
            best[i] = 8 + max([0, *(best[j] - 0.1 * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if a[j] < a[i] and b[j] < b[i])])
        score = sum(8 - (0.1 * (x[j] - x[i] + y[j] - y[i])) for i, j in zip(chain, chain[1:], strict=False)) + 8
        assert score == pytest.approx(best.max())


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.standard_normal(12)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(9)] + [(400, None), (401, [0.0] * 12), (402, [float("nan")] * 12), (403, [None] * 12), (404, [1.0]), (None, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.filter("vec_id % 50 = 0")
    out = {}
    for r in nn_descent.nearest(table, queries).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    good = {i: np.array(v) for i, v in rows if i is not None and i < 400}
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    hits = 0
    for q in (0, 50, 100, 150, 200, 250, 300):
        want = sorted((i for i in good if i != q), key=lambda i: (-round(cosine(good[q], good[i]), 12), i))[:5]
        hits += len(set(want) & set(out[q]))
    assert set(out) == {0, 50, 100, 150, 200, 250, 300} and out[0] == [300, 301, 302, 303, 304] and hits >= 32
    assert nn_descent.nearest(table.limit(0), queries.limit(0)).count() == 0


def test_descent_goes_on_until_few_edges_change(spark):
    vectors = np.random.default_rng(4).standard_normal((2000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "node long, vec array<double>")
    nodes = materialize(nn_descent.with_unit(table, ["node"]), "nodes")
    graph = nn_descent.neighbour_graph(nodes, 10, run=20)
    edges = {(r["node"], r["other"]) for r in graph.collect()}
    everything = graph.withColumn("fresh", F.lit(True))
    more = {(r["node"], r["other"]) for r in nn_descent.descend(everything, nodes, 10).collect()}
    assert len(edges) == 20_000 and len(more - edges) <= 20 * nn_descent.DELTA * len(edges)


def test_search_shuffles_few_rows(spark):
    """Blocks tell each other packed rows, so a whole search moves a few rows for each vector, not one for each edge and measured node."""
    bus, store, gateway = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        bus.waitUntilEmpty()
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    before = stages()
    assert nn_descent.nearest(table, table.filter("vec_id % 50 = 0")).count() == 50
    assert 0 < sum(n for stage, n in stages().items() if stage > max(before, default=-1)) < 40 * table.count()


def test_a_round_equals_brute_force(spark, monkeypatch):
    """One round over several blocks, with hubs, against lists that meet one by one."""
    monkeypatch.setattr(nn_descent, "BLOCK", 64)
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((400, 8)) * np.where(np.arange(400) < 40, 0.1, 1)[:, None] + 1
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    near, k = unit @ unit.T, 4
    start = {v: sorted(rng.choice(np.delete(np.arange(400), v), k, replace=False).tolist(), key=lambda w: -near[v, w]) for v in range(400)}
    fresh = {(v, w): bool(rng.random() < 0.3) for v in start for w in start[v]}
    nodes = spark.createDataFrame([(7 * v + 3, u.tobytes()) for v, u in enumerate(unit)], "node long, unit binary")
    edges = spark.createDataFrame([(7 * v + 3, 7 * w + 3, float(near[v, w]), new) for (v, w), new in fresh.items()], "node long, other long, near float, fresh boolean")
    want = {v: set(start[v]) for v in start}
    for v in start:
        back = sorted((u for u in start if v in start[u]), key=lambda u: -near[u, v])[:k]
        new = {w for w in start[v] if fresh[v, w]} | {u for u in back if fresh[u, v]}
        members = {v, *start[v], *back}
        for a in members:
            want[a] |= {b for b in members if a != b and (a in new or b in new)}
    found = {}
    for r in nn_descent.descend(edges, nodes, k).collect():
        v, w = (r["node"] - 3) // 7, (r["other"] - 3) // 7
        found.setdefault(v, set()).add(w)
        assert r["fresh"] == (w not in start[v]) and abs(r["near"] - near[v, w]) < 1e-5
    assert all(found[v] == set(sorted(want[v], key=lambda w: -near[v, w])[:k]) for v in want)
    assert nn_descent.packed(nodes).count() == 7


def test_search_without_queries(spark):
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert nn_descent.nearest(table, table.limit(0)).count() == 0


def test_search_equals_scan(spark):
    """The whole table of 1,000 vectors, whose start graph is in short runs, against a scan; also ties, lengths and clashing columns."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    double = table.filter("vec_id % 100 = 7").select((F.col("vec_id") + 100_000).alias("vec_id"), F.transform("embedding", lambda x: x * 2).alias("embedding"))
    odd = spark.createDataFrame([(200_000, [1.0, 2.0]), (200_050, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    rows = table.unionByName(double).unionByName(odd).withColumns({"id": F.lit("x"), "node": F.lit(1), "rank": F.lit(0), "unit": F.lit(None)})
    found = nn_descent.nearest(rows, rows.filter("vec_id % 50 = 0"), run=24, neighbours=12, beam=24).collect()
    kept = {r["vec_id"]: np.array(r["embedding"]) for r in rows.collect() if len(r["embedding"]) == 64}
    names, vectors = np.array(sorted(kept)), np.array([kept[i] for i in sorted(kept)])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = total = 0
    for q in names[names % 50 == 0]:
        near = unit @ unit[np.searchsorted(names, q)]
        order = [i for i in np.lexsort((names, -np.round(near, 12))) if names[i] != q][:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"], r["visited"]) for r in found if r["query_id"] == q)
        assert len(mine) == 5 and all(abs(s - near[np.searchsorted(names, v)]) < 1e-12 for _, v, s, _ in mine) and mine[0][3] < len(names)
        hits += len({names[i] for i in order} & {v for _, v, _, _ in mine})
        total += 5
    assert hits >= 0.95 * total and 200_050 not in {r["query_id"] for r in found}


def test_pipeline_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = materialize(stage(spark, docs, folder), "stage")
        rows = out.collect()
        kept = Counter(r["doc_id"] for r in rows)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "quality classifier":
            assert set(kept) == {r["_key"] for r in quality.quality_decisions(docs, labels).filter("kept").collect()} and len(kept) < len(before)
        if name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[i]["text"] or ""), i)
            assert kept == Counter(first.values())
        if name == "MinHash near-dedup":
            assert kept == Counter({a for a, _ in near_groups({i: r["text"] for i, r in before.items()}).values()})
        if name == "mixing sources":
            plan = {r["_key"]: r for r in mixing.mix_plan(docs).collect()}
            assert kept == Counter({i: r["repeats"] + (r["part"] > 0) for i, r in plan.items() if r["taken"]})
            assert all(r["text"] == before[r["doc_id"]]["text"] or before[r["doc_id"]]["text"].startswith(r["text"]) for r in rows)
        if name == "packing":
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(packing.default_tokenizer())
            want = Counter(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
            assert sum(r["length"] for r in rows) == sum(n * k for n, k in want.items()) and max(r["length"] for r in rows) <= 4096
            assert Counter(r["doc_tokens"] for r in rows if r["start"] == 0) == want
        docs = out


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations", "embeddings", "labels"):
        con.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda f: Counter(tuple("" if v is None or v != v else str(v) for v in row) for row in f[columns].itertuples(index=False))
    assert plain(got) == plain(want) and len(want)


def test_row_places_outlast_a_change_of_cores(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(200_000).repartition(1).write.parquet(path)
    rows = spark.read.parquet(path)
    first = rows.select("id", row_place(rows).alias("place"))
    pinned = spark.conf.get("spark.sql.files.minPartitionNum")
    assert pinned == str(spark.sparkContext.defaultParallelism)
    again = rows.select(F.col("id").alias("other"), row_place(rows).alias("place"))
    assert first.join(again, "place").filter("id <> other").count() == 0
