"""The hot-key ways must give the rows of the plain ways."""

import random

import pytest
from pyspark.sql import functions as F

from linestream.scale import Split, fits, flag, hot_keys, lookup_join, materialize, running, runs


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key; NULLs among values and keys."""
    rnd = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None, "d"])
        data.append((key, rnd.randrange(10_000), i, rnd.choice([None, 1, 2, 5]), rnd.choice([None, "x", "y"])))
    return spark.createDataFrame(data, "key string, ts long, id long, n int, v string").repartition(5)


def scan(df, hot_rows):
    split = Split.of(df, ["key"], ["ts", "id"], hot_rows)
    out = running(
        df,
        split,
        sums={"s": F.col("n"), "rn": F.lit(1)},
        lasts={"l": F.col("v")},
        lags={"p": F.col("v")},
        leads={"q": F.col("v"), "nid": F.col("id")},
    )
    return split, out


@pytest.mark.parametrize("hot_rows", [250, 60, 20])
def test_running_in_chunks_equals_one_window(skewed, rows, hot_rows):
    plain_split, plain = scan(skewed, 10**9)
    split, cut = scan(skewed, hot_rows)
    assert plain_split.cuts is None and split.cuts is not None
    assert plain.columns == cut.columns
    assert rows(cut) == rows(plain)


def test_chunks_of_a_hot_key_are_even(skewed):
    split = Split.of(skewed, ["key"], ["ts", "id"], 30)
    hot = skewed.where("key = 'hot'")
    sizes = [r["count"] for r in split.chunked(hot).groupBy("__chunk").count().collect()]
    assert sum(sizes) == 300 and len(sizes) > 5
    assert max(sizes) < 60


def test_rows_in_one_moment_still_scan_right(spark, rows):
    df = spark.range(100).select(F.lit("k").alias("key"), F.lit(5).cast("long").alias("ts"), F.col("id"))
    split = Split.of(df, ["key"], ["ts", "id"], 10)
    assert max(r["count"] for r in split.chunked(df).groupBy("__chunk").count().collect()) <= 10
    out = running(df, split, sums={"rn": F.lit(1)})
    assert [r["rn"] for r in out.orderBy("id").collect()] == list(range(1, 101))


def test_split_on_timestamps_without_zone(spark, rows):
    df = spark.range(200).select(
        (F.col("id") % 2).alias("key"),
        F.expr("timestamp_ntz'2024-03-31 00:00:00' + id * interval '97' second").alias("ts"),
        "id",
    )
    cut = running(df, Split.of(df, ["key"], ["ts"], 15), leads={"n": F.col("ts")})
    plain = running(df, Split(["key"], ["ts"]), leads={"n": F.col("ts")})
    assert rows(cut) == rows(plain)


def test_hot_keys_are_exact_and_the_aim_grows_with_the_rows(spark, monkeypatch):
    df = spark.range(1200).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 60).alias("k"))
    found, aim = hot_keys(df, ["k"], 5)
    assert aim == 5 and sorted(n for _, n in found) == [10] * 59 + [610]
    assert hot_keys(df, ["k"], 610) == ([], 610)
    monkeypatch.setattr("linestream.scale.PARTS", 10)  # at most about ten cuts, whatever the table
    found, aim = hot_keys(df, ["k"], 5)
    assert aim == 70 and [n for _, n in found] == [610]


def test_cuts_of_a_large_table_are_few_and_even(spark, rows, monkeypatch):
    """Cuts found from a part of the rows; most rows of a hot key share their moment."""
    monkeypatch.setattr("linestream.scale._LOOKS", 8)
    df = spark.range(6000).select(
        (F.col("id") % 3 == 0).alias("key"), F.when(F.col("id") % 10 < 8, 5).otherwise(F.col("id")).alias("ts"), "id"
    )
    split = Split.of(df, ["key"], ["ts", "id"], 200)
    sizes = split.chunked(df).groupBy("key", "__chunk").count().collect()
    assert len(sizes) > 12 and max(r["count"] for r in sizes) < 1000
    scanned = {r["key"]: r for r in running(df, split, sums={"rn": F.lit(1)}).groupBy("key").agg(F.count("*").alias("n"), F.max("rn").alias("m"), F.countDistinct("rn").alias("d")).collect()}
    assert {k: (r["n"], r["m"], r["d"]) for k, r in scanned.items()} == {True: (2000,) * 3, False: (4000,) * 3}


def test_keys_and_orders_with_nulls_are_cut_in_order(spark, rows):
    data = [(None if i % 3 else "a", None if i % 4 == 0 else i % 7, i) for i in range(300)]
    df = spark.createDataFrame(data, "key string, ts int, id int")
    split = Split.of(df, ["key"], ["ts", "id"], 12)
    plain = running(df, Split(["key"], ["ts", "id"]), sums={"rn": F.lit(1)}, lags={"p": F.col("id")})
    cut = running(df, split, sums={"rn": F.lit(1)}, lags={"p": F.col("id")})
    assert split.cuts is not None and rows(cut) == rows(plain)


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
@pytest.mark.parametrize("small", [True, False])
def test_lookup_join_ways_agree(spark, skewed, rows, how, small):
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("zzz", 3)], "key string, w int")
    want = skewed.join(right, "key", how)
    got = lookup_join(skewed, right, ["key"], how, small=small)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


@pytest.mark.parametrize("hot_rows", [250, 30, 8])
def test_runs_and_flags_in_chunks(skewed, rows, hot_rows):
    plain, cut = Split(["key"], ["ts", "id"]), Split.of(skewed, ["key"], ["ts", "id"], hot_rows)
    assert cut.cuts is not None
    opens = lambda before, here: here - before > 40
    get = lambda s: runs(skewed, s, "open", F.col("ts"), opens, F.col("id"))
    assert rows(get(cut), "id", "open") == rows(get(plain), "id", "open")
    set_to = F.when(F.col("id") % 40 == 1, 1).when(F.col("id") % 40 == 2, 0)
    get = lambda s: flag(skewed, s, "on", set_to, F.col("n") == 2)
    assert rows(get(cut), "id", "on") == rows(get(plain), "id", "on")
    never = F.lit(None).cast("int")
    get = lambda s: flag(skewed, s, "on", never, F.col("n") == 2)
    assert rows(get(cut), "id", "on") == rows(get(plain), "id", "on")


def test_fits_counts_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert fits(df, 100, 10**6)
    assert not fits(df, 99, 10**6)
    assert not fits(df, 100, 50_000)


def test_materialize_cuts_the_lineage(spark):
    df = materialize(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    assert "rand" not in df._jdf.queryExecution().optimizedPlan().toString()
