"""Sketches of returns: exact in small groups, within the stated error in large ones, and the same however they are merged."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import returns


def test_small_groups_equal_data_frames(spark):
    rng = np.random.default_rng(2)
    rows = [("A", 5, float(x)) for x in rng.normal(0, 1, 4096)] + [("B", 5, float(x)) for x in rng.integers(0, 4, 37)] + [("C", 5, 1.5), ("D", 5, 1.0), ("D", 10, 3.0), ("D", 10, 4.0)]
    frame = pd.DataFrame(rows, columns=["strategy", "hold", "ret"])
    table = spark.createDataFrame(rows + [("A", 5, None), ("E", 5, float("nan"))], "strategy string, hold int, ret double").repartition(5)
    want = frame.groupby(["strategy", "hold"])["ret"].describe()
    got = {(r["strategy"], r["hold"]): r for r in returns.describe(table, ["strategy", "hold"]).collect()}
    assert set(got) == set(want.index)
    for key, w in want.iterrows():
        names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "median": "50%", "q75": "75%", "max": "max"}
        for a, b in names.items():
            assert got[key][a] is None if w[b] != w[b] else got[key][a] == pytest.approx(w[b], rel=1e-12, abs=1e-12), (key, a)


def test_parts_merge_to_the_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i % 3), int(i % 7), float(x)) for i, x in enumerate(rng.normal(100, 2, 3000))]
    table = spark.createDataFrame(rows, "strategy string, day int, ret double")
    parts = returns.sketches(table, ["strategy", "day"])
    twice = returns.merged(returns.merged(parts.withColumn("half", F.col("day") % 2), ["strategy", "half"]), ["strategy"])
    once = returns.described(returns.merged(parts, ["strategy"]))
    for a, b, c in zip(*[sorted(x.collect()) for x in (once, returns.described(twice), returns.describe(table, ["strategy"]))], strict=True):
        assert [x if isinstance(x, str) else pytest.approx(x, rel=1e-9) for x in a] == list(c)
        assert [x if isinstance(x, str) else pytest.approx(x, rel=1e-9) for x in b] == list(c)


def test_large_groups_keep_the_error(spark):
    """A million values, skewed, sorted so that tasks see different parts; from parts, too."""
    table = spark.range(1_000_000).select(F.exp(F.col("id") / 1e5).alias("ret"), (F.col("id") % 10).alias("part"))
    whole = returns.describe(table, []).first()
    parts = returns.described(returns.merged(returns.sketches(table, ["part"]), [])).first()
    for row in (whole, parts):
        assert row["count"] == 1_000_000
        for name, share in returns.QUARTILES.items():
            assert abs(np.log(row[name]) * 1e5 / 1e6 - share) < returns.ERROR
    assert returns.ERROR < 0.001


def test_quantiles_equal_sql(spark):
    rows = [(g, float((i * 7919) % 101)) for g in ("x", "y") for i in range(50 if g == "x" else 33)]
    frame = pd.DataFrame(rows, columns=["g", "ret"])  # noqa: F841
    want = sorted(duckdb.sql("SELECT g, count(*), avg(ret), stddev_samp(ret), min(ret), quantile_cont(ret, 0.25), median(ret), quantile_cont(ret, 0.75), max(ret) FROM frame GROUP BY g").fetchall())
    got = sorted(tuple(r) for r in returns.describe(spark.createDataFrame(rows, "g string, ret double"), ["g"]).collect())
    assert [[x if isinstance(x, str) else pytest.approx(x) for x in w] for w in want] == [list(g) for g in got]


def test_nothing_to_describe(spark):
    none = spark.createDataFrame([], "strategy string, ret double")
    assert returns.describe(none, ["strategy"]).count() == 0
    assert returns.merged(returns.sketches(none, ["strategy"]), ["strategy"]).count() == 0


def test_reasons_of_dropped_signals(spark):
    rows = [("A", i, 0.0 if i == 4 else 5.0, i in (0, 3, 5, 8, 9)) for i in range(10)] + [("B", 0, 1.0, True)]
    table = spark.createDataFrame(rows, "ticker string, i int, open double, SIG boolean").withColumn("time", F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, i)"))
    got = {r["reason"]: r["n"] for r in returns.dropped(table, "SIG", 2).collect()}
    assert got == {"kept": 2, "bad_price": 1, "no_exit_bar": 1, "no_entry_bar": 2}
