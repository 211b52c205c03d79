"""Event-time streams: the same results as on tables, however rows are shuffled and cut into micro-batches."""

import random

from pyspark.sql import functions as F

from plumbline.operators import requests, viewer
from plumbline.streaming import jobs, ordered

FAR = 10_000_000


def in_batches(spark, tmp_path, name, rows, schema, at, late, batches=5):
    """Rows up to ``late`` seconds late, in micro-batches of one file, and a row of a far later time."""
    rnd = random.Random(len(rows))
    rows = sorted(rows, key=lambda r: r[at] + rnd.random() * late)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    last = tuple(type(rows[0][at])(FAR) if i == at else None for i in range(len(names)))
    cuts = [len(rows) * k // batches for k in range(batches + 1)]
    for part in [*[rows[a:b] for a, b in zip(cuts, cuts[1:])], [last]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_quotas_of_shuffled_micro_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("abc"), float(rnd.randint(0, 3000)), rnd.randint(0, 3)) for i in range(600)] + [(i, "hot", float(i), 2) for i in range(600, 1600)]
    schema = "call_id long, tenant string, ts double, quota int"
    want = sorted(requests.replay_quota(spark.createDataFrame(rows, schema)).collect())
    s = in_batches(spark, tmp_path, "calls", rows, schema, 2, 200)
    # Quiet tenants are forgotten after their window: nothing changes.
    assert sorted(jobs.run_available(ordered.quota_in_order(s, delay="200 seconds", slot_s=50.0, idle_s=60.0), "quota").collect()) == want


def test_state_is_visited_by_bucket_not_by_key(spark, tmp_path, monkeypatch):
    """Thousands of keys share few buckets, so that timers and state don't grow with keys and slots."""
    monkeypatch.setattr(ordered, "BUCKETS", 8)
    monkeypatch.setattr(ordered, "PACK_ROWS", 700)
    rnd = random.Random(7)
    rows = [(i, i % 2000, float(rnd.randint(0, 300)), rnd.randint(0, 2)) for i in range(4000)]
    schema = "call_id long, tenant int, ts double, quota int"
    want = sorted(requests.replay_quota(spark.createDataFrame(rows, schema)).collect())
    s = in_batches(spark, tmp_path, "many", rows, schema, 2, 50, batches=2)
    with ordered.keyed_state(spark):
        q = ordered.quota_in_order(s, delay="50 seconds", slot_s=100.0).writeStream.format("memory").queryName("many").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(spark.table("many").collect()) == want
    assert 0 < max(op.numRowsTotal for p in q.recentProgress for op in p.stateOperators) < 200


def test_changes_of_shuffled_micro_batches(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice(["n", "m", None]), t, rnd.choice(["aa", "bb", "c", None, "aa"])) for t in rnd.sample(range(4000), 500)]
    schema = "node string, ts int, text string"
    want = viewer.text_changes(spark.createDataFrame(rows, schema), ["node"], ["ts"]).collect()
    s = in_batches(spark, tmp_path, "nodes", rows, schema, 1, 300)
    out = ordered.changes_in_order(s, ["node"], F.timestamp_seconds(F.col("ts") + 10), ["ts"], delay="300 seconds", slot_s=100.0)
    assert sorted(map(str, jobs.run_available(out, "changes").collect())) == sorted(map(str, want))


def test_stale_verdicts_before_and_after_the_change(spark, tmp_path):
    rnd = random.Random(6)
    schema, v_schema = "node string, s int, text string", "node string, s int, text string, vid int"
    texts = [(rnd.choice("nm"), t, rnd.choice(["aa", "bb", "c", None])) for t in rnd.sample(range(10, 4000), 300)]
    verdicts = [(n, t + rnd.choice([-5, 0, 1, 90, 400]), x, i) for i, (n, t, x) in enumerate(texts) if x]
    verdicts += [("never", 50, "aa", 900), ("n", 1, "aa", 901)]

    def timed(df):
        return df.withColumn("ts", F.timestamp_seconds("s"))

    want = viewer.fresh_verdicts(timed(spark.createDataFrame(verdicts, v_schema)), timed(spark.createDataFrame(texts, schema)), ["node"]).collect()
    # Verdicts arrive long before or after the texts they belong to.
    a = timed(in_batches(spark, tmp_path, "texts", texts, schema, 1, 50))
    b = timed(in_batches(spark, tmp_path, "verdicts", verdicts, v_schema, 1, 600, batches=3))
    out = ordered.fresh_verdict_stream(a, b, ["node"], ["vid"], delay="3000 seconds", slot_s=500.0, idle_s=100_000.0)
    got = jobs.run_available(out, "fresh").collect()
    assert sorted((r.node, r.vid, r.text) for r in got) == sorted((r.node, r.vid, r.text) for r in want) and 50 < len(got) < len(verdicts)


def test_verdicts_of_many_nodes_share_the_state(spark, tmp_path, monkeypatch):
    """State rows follow from buckets and slots, and what is remembered of quiet nodes goes."""
    monkeypatch.setattr(ordered, "BUCKETS", 8)
    schema, v_schema = "node int, s int, text string", "node int, s int, text string, vid int"
    texts = [(i % 1500, i % 500 + i // 1500 * 10, ("aa", "bb", "c", None)[i % 7 % 4]) for i in range(3000)]
    verdicts = [(n, t + 20, x, i) for i, (n, t, x) in enumerate(texts) if x]

    def timed(df):
        return df.withColumn("ts", F.timestamp_seconds("s"))

    want = viewer.fresh_verdicts(timed(spark.createDataFrame(verdicts, v_schema)), timed(spark.createDataFrame(texts, schema)), ["node"]).collect()
    a = timed(in_batches(spark, tmp_path, "texts", texts, schema, 1, 50, batches=2))
    b = timed(in_batches(spark, tmp_path, "verdicts", verdicts, v_schema, 1, 50, batches=2))
    with ordered.keyed_state(spark):
        out = ordered.fresh_verdict_stream(a, b, ["node"], ["vid"], delay="200 seconds", slot_s=200.0, idle_s=10_000.0)
        q = out.writeStream.format("memory").queryName("nodes").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.node, r.vid, r.text) for r in spark.table("nodes").collect()) == sorted((r.node, r.vid, r.text) for r in want) and len(want) > 500
    left = [op.numRowsTotal for p in q.recentProgress for op in p.stateOperators]
    assert 0 < max(left) < 300 and left[-1] < 50, left
