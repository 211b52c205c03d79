"""Totals, positions and pieces over ranges; order of lines in a folder."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import batches, evaluate, ordering, requests
from plumbline.sources import datasets


def test_running_totals_of_one_hot_group(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), i, rnd.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, w int").repartition(7)
    got = {r.i: r.total for r in ordering.running_total(df, ["g"], ["i"], F.col("w"), "total").collect()}
    sums = {}
    for g, i, w in rows:
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + w
    alone = ordering.running_total(df.select("i", "w"), [], ["i"], F.lit(1), "pos")
    assert all(r.pos == r.i for r in alone.collect())
    # Several tasks share a hot group.
    parts = ordering.ranged(df, ["g", "i"]).where("g = 'hot'").select(ordering.PART).distinct().count()
    assert parts > 1


def test_positions_and_ranks_of_one_group(spark):
    df = spark.range(1000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 1000).alias("t"), "id")
    got = batches.number_batches(df, ["g"], "t", 16).collect()
    assert all(r.pos == r.t and r.chunk == r.t // 16 for r in got)
    x = df.withColumns({"x": F.rand(3), "g": F.lit("one")}).withColumn("y", F.col("x") * F.col("x"))
    assert evaluate.spearman(x, "g", "x", "y").first().spearman == pytest.approx(1.0)
    ranks = {r.v: r.rank for r in evaluate.average_ranks(spark.createDataFrame([("g", 1.0, 3), ("g", 2.0, 1), ("g", 5.0, 2)], "g string, v double, n int"), "g", "v", "rank").collect()}
    assert ranks == {1.0: 2.0, 2.0: 4.0, 5.0: 5.5}


def test_one_tenant_is_replayed_in_pieces(spark):
    rnd = random.Random(7)
    at, calls = 0.0, []
    for i in range(3000):
        at += rnd.choice([1, 2, 5, 20, 61])
        calls.append((i, "only", float(at), 3))
    df = spark.createDataFrame(calls, "call_id long, tenant string, ts double, quota int")
    window, want = [], {}
    for i, _, ts, quota in calls:
        window = [t for t in window if ts - t <= 60]
        want[i] = len(window) < quota
        window += [ts] if want[i] else []
    got = requests.replay_quota(df)
    assert {r.call_id: r.admitted for r in got.collect()} == want
    cut = ordering.pieces(df, ["tenant"], "ts", ["ts", "call_id"], 60.0, "piece")
    before = F.lag("ts").over(Window.orderBy("ts", "call_id"))
    assert cut.select("piece").distinct().count() == 1 + df.withColumn("b", before).where("ts - b > 60").count() > 100
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put together
    try:
        assert requests.replay_quota(df).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_of_a_folder_come_in_order_of_paths(spark, tmp_path):
    sizes = {"a": 3, "b": 400, "c": 1, "d/e": 50}
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(f"{name} {i}\n" + ("\n" if i % 3 == 0 else "") for i in range(n)))
    want = [f"{name} {i}" for name, n in sizes.items() for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # several splits a file, several files a task
    try:
        got = {int(r.id): r.text for r in datasets.read_texts(spark, ["first", " "], [str(tmp_path / x) for x in ("a", "b", "c", "d")]).collect()}
        folder = {int(r.id): r.text for r in datasets.read_texts(spark, paths=[str(tmp_path / "*")]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got[i] for i in range(len(got))] == ["first", *want] and [folder[i] for i in range(len(folder))] == want
    (tmp_path / "rare").write_text("x\u2028y\x0cz\x85\x1c w")
    assert [r.text for r in datasets.read_texts(spark, paths=[str(tmp_path / "rare")]).orderBy("id").collect()] == ["x", "y", "z", " w"]
