"""Word lists, policies, the grading pipeline, the cache and the scorer contract."""

import random
import pytest
from pyspark.sql import functions as F

from plumbline.functions.verdict import CATEGORIES, argmax_level, present, top_category
from plumbline.operators import cache, grading, lexicon, policy
from plumbline.operators.policy import Policy, load_policy

LIST = [
    {"term": "kxz", "level": 4, "lang": "en", "category": "self_harm", "targeted": True},
    {"term": "bad word", "level": 2, "lang": "en", "category": "harassment", "targeted": True},
    {"term": "muérdete", "level": 3, "lang": "es", "category": "violence"},
    {"term": "坏话", "level": 2, "lang": "zh", "category": "harassment"},
    {"term": "chat @", "level": 1, "lang": "any", "category": "spam"},
]
TEXTS = [
    "nobody likes kxz here", "k x z", "kxzy is fine", "a BAD   word!", "badword", "¡muérdete ya!", "这是坏话吗", "join my chatroom", "clean text", "楼主kxz", "k.x.z bad word", "",
]


class Counting:
    """Level 2 harassment for texts with 'idiot', else safe."""

    name = "counting"

    def grade(self, texts):
        out = []
        for t in texts:
            bad = "idiot" in t.lower()
            raw = {f"cat_{c}": 0.02 for c in CATEGORIES} | {"targeted": 0.9 if bad else 0.02, "confidence": 0.95, "input_tokens": 100.0}
            raw["level_probs"] = [0.0, 0.0, 1.0, 0.0, 0.0] if bad else [0.97, 0.03, 0.0, 0.0, 0.0]
            if bad:
                raw["cat_harassment"] = 0.95
            out.append(raw)
        return out


class Short(Counting):
    name = "short"

    def grade(self, texts):
        return super().grade(texts)[1:]


def items(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "id long, text string, lang string")


@pytest.fixture(scope="module")
def entries(spark):
    return lexicon.lexicon_entries(spark, LIST)


def terms(df):
    return {r.id: [h.term for h in r.hits] for r in df.collect()}


def test_matching(spark, entries):
    got = terms(grading.prepare(items(spark, TEXTS), entries))
    assert got == {
        0: ["kxz"], 1: ["kxz"], 2: [], 3: ["bad word"], 4: [], 5: ["muérdete"], 6: ["坏话"], 7: ["chat @"], 8: [], 9: ["kxz"], 10: ["bad word"], 11: [],
    }


def test_long_lists_match_the_same(spark, entries, monkeypatch):
    short = terms(grading.prepare(items(spark, TEXTS), entries))
    monkeypatch.setattr(lexicon, "INLINE_ENTRIES", 0)
    assert terms(grading.prepare(items(spark, TEXTS), entries)) == short
    rows = spark.createDataFrame([(i, r["term"], r.get("level", 2), r.get("lang", "any"), r.get("category"), r.get("targeted", False)) for i, r in enumerate(LIST)], "idx int, term string, level int, lang string, category string, targeted boolean")
    assert terms(grading.prepare(items(spark, TEXTS), lexicon.entry_table(rows))) == short


@pytest.mark.parametrize("seed", [1, 2])
def test_indexed_terms_of_any_length_match_the_same(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    letters = "ab1é坏 .'@"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    texts += [" ".join("".join(rnd.choice("ab") for _ in range(8)) for _ in range(12)) for _ in range(50)]
    terms_ = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(150)} | {"".join(rnd.choice("ab") for _ in range(8)) for _ in range(40)}
    own = [{"term": t, "level": i % 5} for i, t in enumerate(sorted(terms_)) if any(c in "ab1é坏" for c in t) and t.strip()]
    found = lexicon.lexicon_entries(spark, own)
    short = terms(grading.prepare(items(spark, texts), found))
    monkeypatch.setattr(lexicon, "INLINE_ENTRIES", 0)
    assert terms(grading.prepare(items(spark, texts), found)) == short and sum(map(len, short.values())) > 300
    assert any(len(t) > lexicon.GRAM for found_ in short.values() for t in found_)


def test_an_entry_table_may_have_ids_beyond_ints(spark):
    """Ids of ``monotonically_increasing_id`` over several partitions are longs."""
    rows = spark.createDataFrame([(i << 33, r["term"], 2, "any", None, False) for i, r in enumerate([*LIST, {"term": "..."}, {"term": "to"}])], "idx long, term string, level int, lang string, category string, targeted boolean")
    got = grading.prepare(items(spark, ["bad word kxz", "K X Z", "... to", "k.xz", "t o", "坏 话@"]), lexicon.entry_table(rows))
    assert terms(got) == {0: ["kxz", "bad word"], 1: ["kxz"], 2: ["...", "to"], 3: ["kxz"], 4: [], 5: ["坏话"]}
    assert max(h.idx for r in got.collect() for h in r.hits) > 1 << 33


def test_a_term_without_letters_is_refused(spark):
    with pytest.raises(ValueError, match="would match every text"):
        lexicon.lexicon_entries(spark, [{"term": "@@"}])


def test_language_filter_applies_to_the_floor_only(spark, entries):
    g = {r.id: r for r in grading.grade(items(spark, ["bad word", "bad word chat"], "es"), entries).collect()}
    assert g[0].reasons == [] and g[0].cat_harassment == 0.9 and g[0].level_argmax == 2
    assert g[1].reasons == ["lexicon:any:chat @"]


def test_floor_lifts_a_safe_verdict(spark, entries):
    (r,) = grading.grade(items(spark, ["bad word"]), entries, scorer=Counting()).collect()
    assert r.level_argmax == 2 and r.cat_harassment == 0.9 and r.targeted == 0.8 and r.reasons == ["lexicon:en:bad word"]
    assert [round(x, 4) for x in r.level_probs] == [0.485, 0.015, 0.5, 0.0, 0.0]


def test_presets_follow_the_closed_form(spark):
    want = {"balanced": ["pass", "pass", "review", "review", "block"], "strict": ["pass", "review", "block", "block", "block"], "relaxed": ["pass", "pass", "pass", "pass", "review"]}
    for name, actions in want.items():
        got = []
        for level, conf in ((0.44, 0.3), (1.15, 0.6), (2.0, 0.6), (2.85, 0.6), (3.7, 0.6)):
            df = spark.createDataFrame([(level, conf)], "level double, confidence double")
            got.append(df.select(policy.decide(F.col("level"), F.col("confidence"), {c: F.lit(0.05) for c in CATEGORIES}, load_policy(name)).alias("a")).first().a)
        assert got == actions


def test_cap_wins_over_minimum(spark):
    p = Policy("t", category_min_action={"spam": "block"}, category_max_action={"self_harm": "review"})
    df = spark.createDataFrame([(1.0, 0.9, 0.0), (3.9, 0.0, 0.9), (1.0, 0.9, 0.9), (3.5, 0.0, 0.0)], "level double, spam double, harm double")
    cats = {c: F.lit(0.0) for c in CATEGORIES} | {"spam": F.col("spam"), "self_harm": F.col("harm")}
    assert [r.a for r in df.select(policy.decide(F.col("level"), F.lit(0.95), cats, p).alias("a")).collect()] == ["block", "review", "review", "block"]
    assert df.limit(1).select(policy.decide(F.lit(3.5), F.lit(0.4), cats, p).alias("a")).first().a == "block"


def test_policy_table_decides_like_the_presets(spark, entries):
    v = grading.grade(items(spark, TEXTS), entries, policy=None)
    many = {(r.id, r.policy): r.action for r in policy.policy_matrix(v, policy.policy_frame(spark)).collect()}
    for name in policy.builtin_policies():
        assert {(r.id, name): r.action for r in policy.apply_policy(v, name).collect()}.items() <= many.items()


def test_unknown_policy_names_the_presets():
    with pytest.raises(FileNotFoundError, match="balanced, relaxed, strict"):
        load_policy("mild")


def test_present_and_top(spark):
    rows = [(0.97, 0.93, 0.0), (0.96, 0.0, 0.55), (0.1, 0.1, 0.1), (0.7, 0.7, 0.0)]
    df = spark.createDataFrame(rows, "harassment double, violence double, sexual double")
    cats = {c: F.col(c) if c in df.columns else F.lit(0.0) for c in CATEGORIES}
    got = df.select(present(cats).alias("p"), top_category(present(cats)).alias("t")).collect()
    assert [r.t for r in got] == ["violence", "harassment", None, "violence"]
    assert got[0].p == ["harassment", "violence"] and got[3].p == ["harassment", "violence"]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.5, 0.0, 0.5, 0.0, 0.0],)], "p array<double>")
    assert df.select(argmax_level(F.col("p")).alias("a")).first().a == 0


def test_dedupe_gives_the_same_verdicts(spark, entries):
    cols = ["id", "text_hash", "level", "level_argmax", "action", "targeted", "confidence"]
    it = items(spark, TEXTS * 3)
    one = grading.grade(it, entries).select(cols)
    assert sorted(one.collect()) == sorted(grading.grade(it, entries, dedupe=True).select(cols).collect())


def test_scorer_sees_distinct_misses_only(spark, entries):
    texts = ["same text", "same  text", "other", "an IDIOT"]
    prepared = grading.prepare(items(spark, texts), entries)
    scored, new = grading.with_raw(prepared, Counting(), "id")
    assert new.count() == 3 and not any(r.cached for r in scored.collect())
    store = new.withColumn("rubric_version", F.lit(grading.RUBRIC_VERSION))
    again, new2 = grading.with_raw(prepared, Counting(), "id", cache=store)
    assert new2.count() == 0 and all(r.cached and r.input_tokens == 0 for r in again.collect())
    old = store.withColumn("rubric_version", F.lit("before"))
    assert grading.with_raw(prepared, Counting(), "id", cache=old)[1].count() == 3


def test_a_scorer_that_loses_texts_is_an_error(spark, entries):
    with pytest.raises(Exception, match="gave 0 verdicts for 1 texts|verdicts for"):
        grading.grade(items(spark, ["a", "b"]), entries, scorer=Short()).collect()


def test_upsert_keeps_the_last(spark):
    cols = "backend string, rubric_version string, text_hash string, level double, created long, last_used long"
    old = spark.createDataFrame([("m", "1", "a", 0.1, 5, 5), ("m", "1", "b", 0.2, 5, 9)], cols)
    new = spark.createDataFrame([("m", "1", "a", 0.3, 5, 6), ("m", "2", "a", 0.4, 1, 1)], cols)
    got = {(r.rubric_version, r.text_hash): r.level for r in cache.upsert(old, new).collect()}
    assert got == {("1", "a"): 0.3, ("1", "b"): 0.2, ("2", "a"): 0.4}
    assert [r.text_hash for r in cache.retain_recent(old, 1).collect()] == ["b"]


def test_native_path_has_no_shuffle_and_no_python_but_nfkc(spark, entries):
    plan = grading.grade(items(spark, TEXTS), entries, use_nfkc=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_filters_on_items_reach_the_scan_and_verdicts_are_not_computed_twice(spark, entries, tmp_path):
    items(spark, TEXTS, "en").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "t"))
    g = grading.grade(spark.read.parquet(str(tmp_path / "t")), entries)
    plan = g.where("source = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,x)" in plan
    patterns = lambda df: df._jdf.queryExecution().executedPlan().toString().count("bad word")
    assert patterns(g.where("action = 'block'").select("id")) == patterns(g.select("id", "action"))


def test_builtin_lists_are_the_default(spark):
    entries = lexicon.load_lexicon(spark)
    assert {e.lang for e in entries} == {"any", "en", "es", "zh", "ja", "ko", "ru"} and all(0 <= e.level <= 4 for e in entries)
    got = terms(grading.prepare(items(spark, ["You IDIOT", "я тебя  убью", "殺してやる!", "fine"]), entries))
    assert got == {0: ["idiot"], 1: ["я тебя убью"], 2: ["殺してやる"], 3: []}


def test_lists_from_files(spark, tmp_path):
    (tmp_path / "xx.json").write_text('{"entries": [{"term": "Foo  Bar", "level": 3}]}', encoding="utf-8")
    got = lexicon.load_lexicon(spark, [tmp_path / "xx.json"])
    assert [(e.term, e.level, e.lang) for e in got] == [("foo bar", 3, "xx")]


def test_invalid_requests(spark):
    rows = [("r1", "ok"), ("r2", ""), ("r3", "x" * 11), ("r4", "a"), ("r4", "b"), ("r4", "c"), ("r5", None)]
    df = spark.createDataFrame(rows, "request_id string, text string")
    got = {r.request_id: r.reason for r in grading.invalid_requests(df, 2, 10).collect()}
    assert got == {"r2": "empty text", "r3": "text too long", "r4": "too many items", "r5": "empty text"}
