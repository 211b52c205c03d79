"""Datasets, batches, evaluation, requests, viewers and streams."""

import json
import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from plumbline.functions.verdict import CATEGORIES, expected_level
from plumbline.operators import batches, evaluate, grading, lexicon, policy, requests, viewer
from plumbline.operators.verdict_store import VerdictStore
from plumbline.sources import datasets
from plumbline.streaming import jobs
from tests.test_grading import Counting


def test_read_texts_and_golden_round_trip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("one\n\n  \ntwo\n", encoding="utf-8")
    got = datasets.read_texts(spark, ["zero", " "], [str(tmp_path / "in.txt")]).collect()
    assert [(r.id, r.text) for r in got] == [("0", "zero"), ("1", "one"), ("2", "two")]
    folder = tmp_path / "golden"
    folder.mkdir()
    for lang in ("en", "xx"):
        (folder / f"{lang}.jsonl").write_text(json.dumps({"id": f"{lang}-1", "text": "hi", "level": 0, "categories": [], "targeted": False}) + "\n", encoding="utf-8")
    assert {(r.id, r.lang) for r in datasets.read_golden(spark, str(folder)).collect()} == {("en-1", "en"), ("xx-1", "xx")}
    assert [r.lang for r in datasets.read_golden(spark, str(folder), ["xx"]).collect()] == ["xx"]


def test_to_golden_counts_unmapped_rows(spark, tmp_path):
    (tmp_path / "d.csv").write_text('TEXT,label\n" a, b ",1\n"skip",9\n"line\nbreak",0\n', encoding="utf-8")
    rows = datasets.indexed(datasets.read_labelled(spark, str(tmp_path / "d.csv")))
    got = datasets.to_golden(rows, "TEXT", "label", "zh", {"1": 2, "0": 0}, "d", "d.csv", "hate").collect()
    assert [(r.id, r.text, r.level, r.categories, r.note) for r in got] == [("zh-d-0", "a, b", 2, ["hate"], "from d.csv, label 1"), ("zh-d-2", "line\nbreak", 0, [], "from d.csv, label 0")]
    assert datasets.to_golden(rows, "TEXT", "label", "zh", {"1": 2, "0": 0}, "d", "d.csv", limit=1).count() == 1


def test_positions_over_several_parts(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text("".join(f"line {i} {k}\n" for k in range(i + 2)), encoding="utf-8")
    df = spark.createDataFrame([(i,) for i in range(57)], "v int").repartition(5)
    rows = datasets.indexed(df).collect()
    assert sorted(r["index"] for r in rows) == list(range(57)) and [r["index"] for r in rows] == list(range(57))
    got = datasets.read_texts(spark, [], [str(tmp_path / f"f{i}.txt") for i in range(3)]).collect()
    assert [(r.id, r.text) for r in got] == [(str(n), f"line {i} {k}") for n, (i, k) in enumerate((i, k) for i in range(3) for k in range(i + 2))]
    assert datasets.indexed(df.limit(0)).collect() == []


def test_golden_and_verdict_files(spark, tmp_path):
    g = spark.createDataFrame([("a", "x\ny", 2, ["hate"], False, "n", "en"), ("b", "z", 0, [], True, None, "ja")], f"{datasets.GOLDEN}, lang string")
    datasets.write_golden(g, str(tmp_path / "g"))
    assert sorted(tuple(r) for r in datasets.read_golden(spark, str(tmp_path / "g")).select(g.columns).collect()) == sorted(tuple(r) for r in g.collect())
    v = grading.grade(spark.createDataFrame([("1", "w " * 40, "en")], "id string, text string, lang string"), [])
    short = datasets.verdict_rows(v).first()
    assert short.text == ("w " * 40)[:57] + "..." and short.action == "pass"
    datasets.write_verdicts(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).select("id", "action").first() == ("1", "pass")


def test_tenants_of_keys(spark):
    keys = spark.createDataFrame([("k1", "a")], "api_key string, tenant string")
    calls = spark.createDataFrame([(1, "k1", "x"), (2, "zz", "x"), (3, None, "x"), (4, "", None)], "id int, api_key string, client string")
    known, refused = requests.with_tenants(calls, keys)
    assert {r.id: r.tenant for r in known.collect()} == {1: "a", 3: "anonymous:x", 4: "anonymous:unknown"} and {r.id: r.reason for r in refused.collect()} == {2: "unknown key"}
    known, refused = requests.with_tenants(calls, keys, open_access=False)
    assert [r.id for r in known.collect()] == [1] and {r.id: r.reason for r in refused.collect()} == {2: "unknown key", 3: "no key", 4: "no key"}


def test_misjudgments_give_each_verdict_of_a_hash_once(spark):
    fb = spark.createDataFrame([("h", "en", "pass")], "text_hash string, lang string, human_action string")
    v = spark.createDataFrame([("h", "en", "block", 3.0), ("h", "en", "block", 3.0), ("h", "fr", "pass", 0.0), ("h", "de", "review", 2.0)], "text_hash string, lang string, action string, level double")
    assert sorted(r.action for r in requests.misjudgments(fb, v).collect()) == ["block", "review"]
    assert [r.action for r in requests.misjudgments(fb, v, ("text_hash", "lang")).collect()] == ["block"]


def test_too_many_combinations_are_refused(spark):
    v = spark.createDataFrame([(1, 0, None)], "id int, level_argmax int, top_category string")
    many = spark.range(policy.MAX_COMBINED_ROWS + 1).select(F.col("id").cast("string").alias("viewer"), F.lit(True).alias("enabled"), F.lit(2).alias("hide_level"), F.lit(True).alias("blur"), F.lit(None).cast("map<string,boolean>").alias("allow"))
    with pytest.raises(ValueError, match="join"):
        viewer.viewer_matrix(v, many)


def test_scratch_tables_go_and_results_stay(spark):
    from plumbline.sources.shared import keep, scratch

    with scratch(spark):
        a = keep(spark.range(5), "a")
        b = keep(a, "b", stays=True)
    assert b.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        a.collect()


def test_guard_output(spark):
    outs = ["Safety: Unsafe\nCategories: Violent, Suicide & Self-Harm", "safety: controversial\ncategories: None", "gibberish", "Safety: Safe\nCategories: Unknown, "]
    df = batches.parse_guard_output(spark.createDataFrame([(o,) for o in outs], "o string"), "o")
    rows = df.withColumn("level", expected_level(F.col("level_probs"))).collect()
    assert [r.label for r in rows] == ["unsafe", "controversial", "safe", "safe"]
    assert rows[0].cat_violence == rows[0].cat_self_harm == 0.9 and rows[0].cat_illegal == 0.05
    assert [round(r.level, 2) for r in rows] == [2.85, 1.75, 0.21, 0.21] and rows[1].targeted == 0.5


def test_requests_and_responses(spark):
    items = spark.createDataFrame([("b", i, f"t{i}") for i in range(3)], "g string, i int, text string")
    rows = batches.build_requests(items, ["g"], "i", 2).orderBy("chunk").collect()
    assert [(r.n_items, r.n_questions) for r in rows] == [(2, 18), (1, 9)]
    assert list(json.loads(rows[0].state)) == ["context", "c0", "c1"] and json.loads(rows[1].state)["c0"] == "t2"
    assert {"c1_risk", "c0_cat_hate", "c1_targeted"} <= set(json.loads(rows[0].questions))
    answers = {}
    for i in range(2):
        answers |= {f"c{i}_risk": {"type": "score", "confidence": 0.9, "probabilities": {"1": 0.1, "2": 1.8, "3": 0.1} if i == 0 else {}}, f"c{i}_targeted": {"noul": 0.9}}
        answers |= {f"c{i}_cat_{c}": {"noul": 0.9 if c == "harassment" else 0.05} for c in CATEGORIES}
    body = json.dumps({"model": "m", "answers": answers, "usage": {"input_tokens": 300, "output_tokens": 30}})
    got = batches.parse_responses(spark.createDataFrame([(body, 2)], "r string, n int"), "r", "n").orderBy("item").collect()
    assert [round(x, 3) for x in got[0].level_probs] == [0, 0.05, 0.9, 0.05, 0] and got[1].level_probs == [0.0] * 5
    assert got[0].input_tokens == 150.0 and got[0].cat_harassment == 0.9 and got[0].cat_hate == 0.05


def test_spearman_matches_a_plain_one(spark):
    rnd = random.Random(5)
    rows = [(lang, rnd.randint(0, 4), round(rnd.random(), 1)) for lang in "ab" for _ in range(60)] + [("one", 1, 0.5), ("flat", 2, 0.1), ("flat", 2, 0.3)]
    got = {r.g: r.spearman for r in evaluate.spearman(spark.createDataFrame(rows, "g string, x int, y double"), "g", "x", "y").collect()}

    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    for g in "ab":
        x, y = ranks([r[1] for r in rows if r[0] == g]), ranks([r[2] for r in rows if r[0] == g])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        cov = sum((a - mx) * (b - my) for a, b in zip(x, y))
        assert got[g] == pytest.approx(cov / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)))
    assert math.isnan(got["one"]) and math.isnan(got["flat"])


def test_f1_without_positives_is_nan(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "bad int, level double")
    assert math.isnan(evaluate.binary_evaluation(df, []).first().f1)


def test_quota_replay_in_order_of_time(spark):
    rnd = random.Random(9)
    calls = sorted((float(rnd.randint(0, 300)), t, i) for i, t in enumerate(rnd.choices("abc", k=200)))
    quota = {"a": 3, "b": 0, "c": 1}
    rows = [(i, t, ts, quota[t]) for ts, t, i in calls]
    df = spark.createDataFrame(rows, "call_id long, tenant string, ts double, quota int")
    want, windows = {}, {}
    for i, t, ts, qn in sorted(rows, key=lambda r: (r[2], r[0])):
        w = windows.setdefault(t, deque())
        while w and ts - w[0] > 60:
            w.popleft()
        want[i] = qn <= 0 or len(w) < qn
        if want[i] and qn > 0:
            w.append(ts)
    assert {r.call_id: r.admitted for r in requests.replay_quota(df).collect()} == want

def test_default_limits(spark):
    calls = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "call_id int, tenant string")
    tenants = spark.createDataFrame([("a", 5), ("b", 0)], "name string, rate_limit int")
    assert {r.tenant: r.quota for r in requests.with_limits(calls, tenants, 600).collect()} == {"a": 5, "b": 600, "c": 600}


def test_feedback_is_checked_and_appended(spark, tmp_path):
    fb = spark.createDataFrame([("h", "block", 2)], "text_hash string, human_action string, expected_level int")
    for _ in range(2):
        requests.append_feedback(fb, str(tmp_path / "fb"), F.lit("t1"))
    assert spark.read.json(str(tmp_path / "fb")).count() == 2
    with pytest.raises(Exception, match="bad human_action"):
        requests.append_feedback(fb.withColumn("human_action", F.lit("zap")), str(tmp_path / "fb2"), F.lit("t1"))


def test_viewer_rules(spark):
    def act(level, top, hide=2, blur=True, enabled=True, allow=None):
        df = spark.createDataFrame([(level, top, enabled, hide, blur, allow or {})], "level int, top string, enabled boolean, hide int, blur boolean, allow map<string,boolean>")
        return df.select(viewer.viewer_action(F.col("enabled"), viewer.hide_level(F.col("hide")), F.col("blur"), F.col("allow"), F.col("level"), F.col("top")).alias("a")).first().a

    assert act(2, "hate") == "hide" and act(1, None) == "blur" and act(0, None) == "show" and act(1, None, blur=False) == "show"
    assert act(3, "hate", allow={"hate": True}) == "show" and act(4, "hate", allow={"hate": True}) == "hide"
    assert act(4, None, hide=9) == "show" and act(2, None, hide=0) == "hide" and act(4, None, enabled=False) == "show" and act(1, None, hide=-3) == "hide"


def test_text_changes_and_stale_verdicts(spark):
    rows = [(1, "aa"), (2, "aa"), (3, "b"), (4, "aa"), (5, "cc"), (6, None), (7, "cc")]
    df = spark.createDataFrame([("n", t, x) for t, x in rows], "node string, ts int, text string")
    assert [r.ts for r in viewer.text_changes(df, ["node"], ["ts"]).orderBy("ts").collect()] == [1, 4, 5, 7]
    v = spark.createDataFrame([("n", 2, "aa"), ("n", 3, "aa"), ("n", 6, "cc"), ("n", 9, "cc"), ("m", 9, "cc"), ("n", 0, "aa")], "node string, ts int, text string")
    assert sorted((r.node, r.ts) for r in viewer.fresh_verdicts(v, df, ["node"]).collect()) == [("n", 2), ("n", 9)]


def test_stream_grades_like_batch_and_scores_once(spark, tmp_path):
    entries = lexicon.lexicon_entries(spark, [{"term": "idiot", "level": 2, "lang": "en", "category": "harassment"}])
    df = spark.createDataFrame([(1, "you idiot", "en"), (2, "hello", None), (3, "hello ", None)], "id long, text string, lang string")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    cols = ["id", "lang", "level", "action"]
    assert sorted(jobs.run_available(jobs.grade_stream(s, entries), "g").select(cols).collect()) == sorted(grading.grade(df, entries).select(cols).collect())
    out, store = str(tmp_path / "out"), str(tmp_path / "store")
    for _ in range(2):
        jobs.scored_once(s, entries, Counting(), store, out, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    got = spark.read.parquet(out)
    assert got.where("batch_id = 0").count() == 3 and VerdictStore(spark, store).read().count() == 2
    assert {r.cached for r in got.where("batch_id = 1").collect()} == {True}


def test_tenants_and_unknown_policies(spark):
    req = spark.createDataFrame([(1, "a", None), (2, "a", "relaxed"), (3, "b", ""), (4, "c", "zzz")], "id int, tenant string, policy string")
    tenants = spark.createDataFrame([("a", "strict"), ("b", "")], "name string, policy string")
    asked = policy.effective_policy(req, tenants, "balanced")
    assert {r.id: r.effective_policy for r in asked.collect()} == {1: "strict", 2: "relaxed", 3: "balanced", 4: "zzz"}
    known, refused = policy.split_known_policies(asked, policy.policy_frame(spark))
    assert known.count() == 3 and [r.reason for r in refused.collect()] == ["no policy zzz"]
