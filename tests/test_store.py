"""The verdict table on disk and the scoring ledger."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cache, resumable
from plumbline.operators.verdict_store import VerdictStore
from plumbline.streaming import jobs

SCHEMA = "backend string, rubric_version string, text_hash string, level double, created int"


def sha(i):
    return hashlib.sha256(str(i).encode()).hexdigest()[:16]


def entries(spark, ids, level=1.0, created=1, version="v"):
    return spark.createDataFrame([("lex", version, sha(i), level, created) for i in ids], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select("backend", "rubric_version", "text_hash", "level", "created").collect()))


def test_store_equals_upserts_of_a_table(spark, tmp_path):
    store = VerdictStore(spark, str(tmp_path / "s"), buckets=8, segments=3, share=0.9)
    assert store.read() is None and store.candidates(entries(spark, [1]), "lex", "v") is None
    plain = None
    for step, (ids, level, created) in enumerate([(range(300), 1.0, 5), (range(250, 400), 2.0, 5), (range(0, 90), 3.0, 4), (range(395, 420), 4.0, 9), (range(5), 5.0, 9), (range(2), 6.0, 9)]):
        new = entries(spark, ids, level, created)
        both = cache.upsert(new.limit(0) if plain is None else plain, new)
        plain = spark.createDataFrame(both.collect(), both.schema)
        report = store.upsert(new, note=step)
        assert report["version"] == step + 1 and store.note() == step
        assert rows(store.read()) == rows(plain)
    assert store.upsert(new)["merged"] > 0  # segments had become many
    assert {r.entries for r in store.size().collect()} == {plain.count()}
    assert rows(store.read(3)) == rows(store.read(3))  # an old version is still there
    assert store.vacuum() > 0 and rows(store.read()) == rows(plain)
    with pytest.raises(Exception):
        store.read(3).count()
    with pytest.raises(ValueError):
        store.upsert(new.withColumn("more", F.lit(1)))


def test_small_upserts_write_their_own_entries_only(spark, tmp_path):
    store = VerdictStore(spark, str(tmp_path / "s"), buckets=16)
    first = store.upsert(entries(spark, range(4000)))
    assert (first["written"], first["touched"], first["merged"]) == (4000, 16, 0)
    before = set((tmp_path / "s" / "data").rglob("*.parquet"))
    report = store.upsert(entries(spark, range(4000, 4040)))
    assert report["written"] == 40 and report["merged"] == 0
    after = set((tmp_path / "s" / "data").rglob("*.parquet"))
    assert before < after and sum(f.stat().st_size for f in after - before) < 0.5 * sum(f.stat().st_size for f in before)
    # Put in again and again, a range is merged now and then: the work stays in proportion.
    total = sum(store.upsert(entries(spark, range(4040 + 40 * k, 4080 + 40 * k)))["written"] for k in range(9))
    assert total < 9 * 40 + 3 * 4400 and store.read().count() == 4400


def test_unknown_hashes_read_no_entry_and_known_ones_their_ranges(spark, tmp_path):
    store = VerdictStore(spark, str(tmp_path / "s"), buckets=64)
    for k in range(4):
        store.upsert(entries(spark, range(1000 * k, 1000 * k + 1000)))
    fresh = store.candidates(entries(spark, range(100_000, 100_040)), "lex", "v")
    assert fresh.count() == 0 and len(fresh.inputFiles()) <= 4  # a filter errs for one text in some hundreds
    assert store.candidates(entries(spark, [5]), "lex", "other").count() == 0
    known = store.candidates(entries(spark, [5, 1005, 100_000]), "lex", "v")
    assert sorted(r.text_hash for r in known.collect()) == sorted([sha(5), sha(1005)])
    assert len(known.inputFiles()) <= 3 * 4 < len(store.read().inputFiles())


def test_two_writers_and_a_failed_one(spark, tmp_path):
    a = VerdictStore(spark, str(tmp_path / "s"))
    a.upsert(entries(spark, range(10)))
    manifest = a._manifest()
    a.upsert(entries(spark, [1], 9.0, 2))
    with pytest.raises(RuntimeError, match="another job"):
        a._publish(manifest | {"version": 2})
    with pytest.raises(Exception):
        a.upsert(entries(spark, [1]).withColumn("level", F.raise_error(F.lit("lost")).cast("double")))
    assert a.read().count() == 10 and a.versions() == [1, 2]


class Counting:
    """Writes down every call; fails at some texts."""

    name = "counting"

    def __init__(self, log, broken=(), fail_once=None):
        self.log, self.broken, self.fail_once = str(log), set(broken), fail_once

    def grade(self, texts):
        import os

        with open(self.log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if self.fail_once in texts and not os.path.exists(f"{self.log}.failed"):
            open(f"{self.log}.failed", "w").close()
            raise OSError("no answer")
        if self.broken & set(texts):
            raise ValueError("can't be scored")
        return [{"level_probs": [1.0, 0, 0, 0, 0], "targeted": 0.0, "confidence": 1.0, "input_tokens": 1.0} for t in texts]


def test_texts_are_scored_once_whatever_fails(spark, tmp_path):
    texts = spark.createDataFrame([(sha(i), f"t{i}") for i in range(200)], "text_hash string, text string")
    ledger, log = str(tmp_path / "ledger"), tmp_path / "calls"
    half, none = resumable.score_resumable(texts.where("length(text) < 3"), Counting(log), ledger, batch=4, task_texts=20)
    assert half.count() == 10 and none.count() == 0
    ok, failed = resumable.score_resumable(texts, Counting(log, broken={"t50", "t51"}, fail_once="t20"), ledger, batch=4, task_texts=20)
    assert ok.count() == 198 and sorted(r.text_hash for r in failed.collect()) == sorted([sha(50), sha(51)])
    assert "can't be scored" in failed.first().error
    calls = log.read_text().split()
    again = {t for t in calls if calls.count(t) > 1}
    # Only batches with a failing text were asked again.
    assert {"t20", "t50", "t51"} <= again and len(again) <= 12 and set(calls) == {f"t{i}" for i in range(200)}
    # A rerun asks for nothing; failed texts are asked again on request.
    resumable.score_resumable(texts, Counting(log), ledger)
    assert log.read_text().split() == calls
    ok, failed = resumable.score_resumable(texts, Counting(log), ledger, retry_failed=True)
    assert ok.count() == 200 and failed.count() == 0 and sorted(log.read_text().split()[len(calls) :]) == ["t50", "t51"]


def test_a_job_that_dies_keeps_what_its_tasks_have_paid_for(spark, tmp_path):
    texts = spark.createDataFrame([(sha(i), f"t{i}") for i in range(120)], "text_hash string, text string")
    ledger, log = str(tmp_path / "ledger"), tmp_path / "calls"

    class Dying(Counting):
        def grade(self, batch):
            import os

            if "t60" in batch:
                os._exit(1)  # the worker is gone, and with it the job
            return super().grade(batch)

    with pytest.raises(Exception):
        resumable.score_resumable(texts, Dying(log), ledger, batch=4, task_texts=5)
    kept = resumable.read_ledger(spark, ledger, "counting").count()
    ok, _ = resumable.score_resumable(texts, Counting(log), ledger, batch=4, task_texts=5)
    assert 0 < kept < 120 and ok.count() == 120
    calls = log.read_text().split()
    assert sum(calls.count(t) > 1 for t in set(calls)) <= 120 - kept


def test_repeated_feedback_batches_leave_one_copy(spark, tmp_path):
    schema = "text_hash string, human_action string, expected_level int"
    spark.createDataFrame([("h", "block", 2), ("g", "pass", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for k in range(2):  # a lost checkpoint repeats the batch
        jobs.feedback_stream(s, str(tmp_path / "out"), F.lit("t"), str(tmp_path / f"check{k}")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 2 and {r.tenant for r in got.collect()} == {"t"}
