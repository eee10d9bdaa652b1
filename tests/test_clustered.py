"""Tables clustered by ticker: no exchange for windows and joins, some buckets for some tickers."""

import re

import pytest
from pyspark.sql import functions as F

from barloom.functions.rolling import rolling
from barloom.operators import indicators, quality
from barloom.plans import catalogue
from barloom.sources.clustered import forget, read_clustered, write_clustered
from barloom.sources.versions import VersionedTable

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def buckets(df):
    return tuple(map(int, re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan(df.groupBy("ticker").count())).groups()))


@pytest.fixture(scope="module")
def suppliers(spark):
    return catalogue._suppliers(spark, SF).cache()


def test_windows_take_no_exchange(spark, suppliers, tmp_path):
    path = str(tmp_path / "bars")
    write_clustered(suppliers, path, 8)
    bars = read_clustered(spark, path)
    assert "Exchange" in plan(indicators.features(suppliers)) and "Exchange" not in plan(indicators.features(bars))
    assert "Exchange" not in plan(bars.groupBy("ticker").agg(F.max("time")))
    names = [c for c in bars.columns if c != "volume"]
    assert sorted(map(tuple, bars.select(names).collect())) == sorted(map(tuple, suppliers.select(names).collect()))
    a, b = (indicators.rsi(x).select("ticker", "time", F.round("RSI_14", 6)) for x in (bars, suppliers))
    assert a.exceptAll(b).count() == 0
    assert quality.snapshot(indicators.moving_averages(bars)).count() == suppliers.select("ticker").distinct().count()
    forget(spark, path)


def test_some_tickers_read_some_files(spark, suppliers, tmp_path, monkeypatch):
    path = str(tmp_path / "bars")
    write_clustered(suppliers, path, 8)
    assert len(list(tmp_path.glob("bars/data/*/*.parquet"))) <= 8  # one of each bucket that has rows
    some = suppliers.select("ticker").distinct().orderBy("ticker").limit(2)
    few = read_clustered(spark, path, some)
    assert buckets(few)[0] <= 2 and buckets(few)[1] == 8
    want = suppliers.join(some, "ticker", "left_semi").count()
    assert few.count() == want
    assert read_clustered(spark, path, some.limit(0)).count() == 0
    monkeypatch.setattr("barloom.sources.clustered.MOST_NAMED", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = read_clustered(spark, path, some)
    text = plan(indicators.moving_averages(joined))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == want
    scan = next(i for i, x in enumerate(text.splitlines()) if "FileScan" in x and "Bucketed: true" in x)
    assert not any("Exchange" in x for x in text.splitlines()[scan - 3 : scan])
    forget(spark, path)


def test_versions_of_a_clustered_table(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = lambda x: spark.createDataFrame([("A", x), (None, x), ("B'", x)], "ticker string, close double").withColumn("time", F.lit("2020-01-01").cast("timestamp_ntz"))
    write_clustered(rows(1.0), path, 2)
    write_clustered(read_clustered(spark, path).withColumn("close", F.col("close") + 1), path, 4)  # reads what it replaces
    assert {r["close"] for r in read_clustered(spark, path).collect()} == {2.0} and read_clustered(spark, path, number=0).filter("close = 1").count() == 3
    assert [v for v in VersionedTable(spark, path).numbers()] == [0, 1]
    forget(spark, path)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("barloom_")]
    with pytest.raises(FileNotFoundError):
        read_clustered(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="bucket"):
        write_clustered(rows(1.0), path, 0)


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    """A bucket is one task's, so more lines make more of them; lines are dealt once, for the bars and for their buckets."""
    monkeypatch.setattr("barloom.sources.clustered.BUCKET_ROWS", 500)
    found = []
    write = catalogue.clustered.write_clustered
    monkeypatch.setattr("barloom.sources.clustered.write_clustered", lambda rows, path, n: (found.append((n, plan(rows.repartition(n, "ticker")).count("Exchange"))), write(rows, path, n))[1])
    df = catalogue.queries()["clustered_means"](spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert found == [(-(-lines // 500), 1)] and found[0][0] > 8
    assert buckets(df)[1] == found[0][0]


def test_means_add_few_terms_a_bar(spark):
    """No frame as long as the longest mean, and the same means as from such frames, with closes missing, too."""
    rows = spark.range(2600).selectExpr("concat('T', id % 2) ticker", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, int(id)) time", "if(id % 1300 = 5 or id between 900 and 1000, null, (id * 7919 % 1009) * pow(10, id % 5)) close")
    got = indicators.moving_averages(rows)
    assert "-199" not in plan(got) and got.columns == [*rows.columns, "MA_20", "MA_50", "MA_200"]
    want = rows.withColumns({f"W_{n}": rolling(F.avg, F.col("close"), n) for n in (20, 50, 200)})
    for r in got.join(want, ["ticker", "time"]).collect():
        for n in (20, 50, 200):
            assert r[f"MA_{n}"] == (None if r[f"W_{n}"] is None else pytest.approx(r[f"W_{n}"], rel=1e-12))
    assert got.filter("MA_200 is not null").count() == want.filter("W_200 is not null").count() > 0
