"""The registered queries: each applies operators to the given tables and returns flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.verdict import CATEGORIES, argmax_level, cats, expected_level
from plumbline.operators import batches, cache, evaluate, grading, lexicon, policy, requests, resumable, viewer
from plumbline.operators.verdict_store import VerdictStore
from plumbline.plans import samples
from plumbline.sources import datasets
from plumbline.sources.shared import keep, new_path, spread
from plumbline.streaming import jobs, ordered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang", "source")


def word_list(spark: SparkSession) -> list[lexicon.Entry]:
    return lexicon.lexicon_entries(spark, samples.WORD_LIST)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.prepare(items(spark, sf_dir), word_list(spark))


def graded(spark: SparkSession, sf_dir: str, preset: str = "balanced") -> DataFrame:
    return grading.grade(items(spark, sf_dir), word_list(spark), preset)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def n(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


# --- texts -----------------------------------------------------------------------------------------


@query
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = T.normalize(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", norm.alias("norm")).select("doc_id", n(F.length("norm")).alias("norm_chars"), F.sha2("norm", 256).alias("norm_sha256"))


@query
def compact_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = T.compact(T.normalize(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", comp.alias("c")).select("doc_id", n(F.length("c")).alias("compact_chars"), F.sha2("c", 256).alias("compact_sha256"))


@query
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.cache_key(F.lit("lexicon"), F.lit(grading.RUBRIC_VERSION), F.col("text_hash"))
    return documents(spark, sf_dir).select("doc_id", T.text_hash(T.normalize(F.col("text"))).alias("text_hash")).withColumn("cache_key", key)


@query
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir).select("doc_id", T.script_counts(F.col("text")).alias("m"))
    get = lambda s: n(F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0)))
    return c.select("doc_id", get("LATIN").alias("latin"), get("CYRILLIC").alias("cyrillic"), get("HAN").alias("han"), get("OTHER").alias("other"))


@query
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", T.detect_language(F.col("text")).alias("x"))
    return d.select("doc_id", F.col("x.lang").alias("detected"), r6("x.confidence").alias("confidence"))


@query
def resolve_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.lit(""))
    return documents(spark, sf_dir).select("doc_id", T.resolve_language(given, F.col("text")).alias("resolved"), T.resolve_language(given, F.col("text"), detect=False).alias("undetected"))


@query
def display_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("+"), F.col("turn").cast("string"), F.lit("  "), F.col("text"), F.lit(" \n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.display_clean(shown), 256).alias("clean_sha256"))


@query
def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.client_key(F.col("text")), 256).alias("key_sha256"))


@query
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    given = F.when(F.col("turn") == 0, F.lit("first"))
    return grading.long_enough(c, 3).select("conv_id", "turn", T.item_id(given, F.col("turn")).alias("id"), T.preview(F.col("text")).alias("preview"))


# --- grading ---------------------------------------------------------------------------------------


@query
def lexicon_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = prepared(spark, sf_dir).select("id", "lang", F.explode("hits").alias("h"))
    own = F.col("h.lang").isin("any") | (F.col("h.lang") == F.col("lang"))
    return h.select("id", F.col("h.term").alias("term"), n("h.level").alias("level"), own.alias("own_language"))


@query
def lexicon_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = prepared(spark, sf_dir).withColumns(lexicon.lexicon_raw(F.col("hits")))
    probs = F.col("level_probs")
    return v.select("id", r6(expected_level(probs)).alias("level"), n(argmax_level(probs)).alias("level_argmax"), *[f"cat_{c}" for c in CATEGORIES], "targeted", "confidence")


@query
def grade_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir)
    return g.select("id", "lang", "text_hash", r6("level").alias("level"), n("level_argmax").alias("level_argmax"), "targeted", "confidence", "top_category", "action", F.array_join("reasons", ",").alias("reasons"))


def guard_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a guard model, made from the whole documents by expression; the text follows the two lines."""
    size = F.length(F.coalesce("text", F.lit("")))
    label = F.element_at(F.array(*[F.lit(x) for x in ("Safe", "UNSAFE", "Controversial", "nothing")]), (size % 4 + 1).cast("int"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("None", "Violent, Unethical Acts", "Suicide & Self-Harm", "Sexual Content or Sexual Acts , Other", "Non-violent Illegal Acts,")]), (size % 5 + 1).cast("int"))
    out = F.concat(F.lit("Safety: "), label, F.when(size % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("\nCategories: "), names)), F.lit("\n"), F.coalesce("text", F.lit("")))
    return documents(spark, sf_dir).withColumn("answer", out)


@query
def parse_guard_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = batches.parse_guard_output(guard_outputs(spark, sf_dir), "answer")
    return g.select("doc_id", "label", r6(expected_level(F.col("level_probs"))).alias("level"), *[f"cat_{c}" for c in CATEGORIES], "targeted", "confidence")


@query
def fuse_with_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = batches.parse_guard_output(guard_outputs(spark, sf_dir), "answer").withColumnRenamed("doc_id", "id")
    g = grading.finish(grading.prepare(raw, word_list(spark)), "strict")
    return g.select("id", r6("level").alias("level"), n("level_argmax").alias("level_argmax"), *[r6(f"cat_{c}").alias(f"cat_{c}") for c in CATEGORIES], "targeted", "action", F.array_join("reasons", ",").alias("reasons"))


@query
def top_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir)
    return g.groupBy("source", F.coalesce("top_category", F.lit("none")).alias("top")).agg(F.count("*").alias("n"))


@query
def policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = policy.policy_matrix(graded(spark, sf_dir).drop("action").select("id", "lang", "level", "confidence", *[f"cat_{c}" for c in CATEGORIES]), policy.policy_frame(spark))
    return m.groupBy("lang", "policy", "action").agg(F.count("*").alias("n"))


@query
def tenant_policy_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir).drop("action").withColumns({"tenant": F.col("source"), "policy": F.when(F.col("id") % 10 == 0, F.lit("relaxed"))})
    tenants = spark.createDataFrame(samples.TENANTS, samples.TENANT_SCHEMA)
    asked = policy.effective_policy(g, tenants, "balanced").drop("policy")
    table_ = policy.policy_frame(spark)
    known, refused = policy.split_known_policies(asked, table_)
    done = known.join(F.broadcast(table_), known["effective_policy"] == table_["policy"])
    done = done.withColumn("action", policy.decide(F.col("level"), F.col("confidence"), cats()))
    both = done.select("tenant", "effective_policy", "action").unionByName(refused.select("tenant", "effective_policy", F.lit("refused").alias("action")))
    return both.groupBy("tenant", "effective_policy", "action").agg(F.count("*").alias("n"))


def viewers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(samples.VIEWERS, samples.VIEWER_SCHEMA)


@query
def viewer_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir).select("id", "level_argmax", "top_category")
    return viewer.viewer_matrix(g, viewers(spark)).select("id", "viewer", "shown")


@query
def display_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir).select("id", "level_argmax", "top_category").withColumn("cached", F.col("id") % 2 == 0)
    return viewer.display_stats(viewer.viewer_matrix(g, viewers(spark)))


# --- sources, sinks and what callers bring ---------------------------------------------------------


@query
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a text file, read back line by line."""
    path = new_path(spark, "texts")
    documents(spark, sf_dir).where(F.col("text").isNotNull()).select("text").write.text(path)
    lines = datasets.read_texts(spark, paths=[path]).withColumn("sha", F.sha2("text", 256))
    return lines.groupBy("sha").agg(F.count("*").alias("n"), n(F.max(F.length("text"))).alias("chars"), F.count_distinct("id").alias("ids"))


@query
def text_line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' first characters as lines of seven files of unequal sizes: ids follow the files' paths."""
    path = new_path(spark, "lines")
    line = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    d = documents(spark, sf_dir).select("doc_id", F.floor(F.sqrt(F.col("doc_id") % 49)).cast("int").alias("f"), line.alias("line"))
    d.repartition("f").sortWithinPartitions("f", "doc_id").select("f", "line").write.partitionBy("f").text(path)
    return datasets.read_texts(spark, paths=[path]).select("id", F.col("text").alias("line"))


@query
def golden_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden rows of the labelled documents, written a folder a language and read back."""
    g = datasets.to_golden(labelled(spark, sf_dir).withColumnRenamed("lang", "own"), "text", "toxic", "en", {"1": 2, "0": 0}, "labels", "labels.parquet", "harassment", "doc_id")
    langs = documents(spark, sf_dir).select(F.concat(F.lit("en-labels-"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("own"))
    path = new_path(spark, "golden")
    datasets.write_golden(g.join(langs, "id").withColumn("lang", F.coalesce("own", F.lit("und"))).drop("own"), path)
    back = datasets.read_golden(spark, path)
    return back.select("id", "lang", F.sha2("text", 256).alias("text_sha256"), n("level").alias("level"), F.array_join("categories", ",").alias("categories"), "targeted", "note")


@query
def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as CSV and as JSON lines, read back."""
    rows = labelled(spark, sf_dir).select("doc_id", "text", "toxic")
    parts = []
    for form in ("csv", "jsonl"):
        path = f"{new_path(spark, 'labelled')}.{form}"
        out = rows.write.option("header", True).option("escape", '"').option("quoteAll", True)
        out.csv(path) if form == "csv" else out.json(path)
        back = datasets.read_labelled(spark, path)
        parts.append(back.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(form).alias("form"), F.sha2("text", 256).alias("text_sha256"), F.col("toxic").cast("long").alias("toxic")))
    return parts[0].unionByName(parts[1])


@query
def builtin_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the package's own word lists find."""
    h = grading.prepare(items(spark, sf_dir), lexicon.load_lexicon(spark)).select("id", F.explode("hits").alias("h"))
    return h.select("id", F.col("h.term").alias("term"), F.col("h.lang").alias("lang"), n("h.level").alias("level"))


@query
def long_list_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a list of every longer word that any of them has."""
    # Written once, as it is read for the terms, for the texts and for the rows; the compact form follows from the normal one.
    p = keep(grading.prepare(items(spark, sf_dir), []).select("id", "text_hash", "norm"), "prepared").withColumn("compact", T.compact(F.col("norm")))
    terms = p.select(F.explode(F.regexp_extract_all("norm", F.lit("[a-z]{7,}"), F.lit(0))).alias("term")).distinct()
    rows = terms.select(F.monotonically_increasing_id().alias("idx"), "term", (F.length("term") % 5).alias("level"), F.lit("any").alias("lang"), F.lit(None).alias("category"), F.lit(False).alias("targeted"))
    entries = keep(lexicon.entry_table(rows), "entries")
    h = lexicon.with_indexed_hits(p, entries).withColumn("terms", F.array_sort(F.transform("hits", lambda x: x["term"])))
    levels = F.aggregate("hits", F.lit(0).cast("long"), lambda t, x: t + x["level"])
    return h.select("id", n(F.size("terms")).alias("n_terms"), levels.alias("levels"), F.sha2(F.array_join("terms", ","), 256).alias("terms_sha256"))


@query
def feedback_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human verdicts appended in two runs and read back."""
    fb = labelled(spark, sf_dir).select(
        "doc_id", "source", T.text_hash(T.normalize(F.col("text"))).alias("text_hash"), F.when(F.col("toxic") == 1, "block").otherwise("pass").alias("human_action"), F.when(F.col("toxic") == 1, 3).alias("expected_level")
    )
    path = new_path(spark, "feedback")
    for quality in (0, 1):
        own = fb.join(table(spark, sf_dir, "labels").where(F.col("quality") == quality).select("doc_id"), "doc_id", "left_semi")
        requests.append_feedback(own, path, F.concat(F.lit("tenant-"), F.col("source")), F.lit("2026-01-01 00:00:00"))
    back = spark.read.json(path)
    return back.select("doc_id", "tenant", "text_hash", "human_action", n("expected_level").alias("expected_level"), "ts")


@query
def scored_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grading with a caller's batch scorer: each distinct text is scored once."""
    g = grading.grade(items(spark, sf_dir), word_list(spark), "balanced", scorer=samples.LengthScorer())
    return g.select("id", r6("level").alias("level"), n("level_argmax").alias("level_argmax"), r6("cat_spam").alias("cat_spam"), "targeted", "action", "cached", "backend", "input_tokens")


@query
def scored_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a ledger: a first run scores every other document, the second one only what is left."""
    ledger, docs = new_path(spark, "ledger"), items(spark, sf_dir)
    resumable.grade_resumable(docs.where("id % 2 = 0"), word_list(spark), samples.LengthScorer(), ledger)
    g, _ = resumable.grade_resumable(docs, word_list(spark), samples.LengthScorer(), ledger)
    return g.select("id", r6("level").alias("level"), n("level_argmax").alias("level_argmax"), r6("cat_spam").alias("cat_spam"), "targeted", "action", "cached", "backend", "input_tokens")


@query
def custom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a caller's table of entries."""
    rows = [(r["term"], r["level"], r.get("lang"), r.get("category"), r.get("targeted", False)) for r in samples.WORD_LIST]
    frame = spark.createDataFrame(rows, "term string, level int, lang string, category string, targeted boolean").coalesce(1)
    h = grading.prepare(items(spark, sf_dir), lexicon.frame_entries(frame)).select("id", "lang", F.explode("hits").alias("h"))
    return h.select("id", F.col("h.term").alias("term"), n("h.level").alias("level"))


@query
def custom_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under a caller's own policy."""
    g = grading.grade(items(spark, sf_dir), word_list(spark), samples.HOUSE_POLICY)
    return g.groupBy("source", "action").agg(F.count("*").alias("n"))


@query
def all_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter counts of every script; most documents get letters of rarer ones put behind them."""
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", "ԱԲԳ", "தமிழ் அ", "ᚠᚢ Ж", "ጀ漢か")]), (F.length(F.coalesce("text", F.lit(""))) % 5 + 1).cast("int"))
    d = documents(spark, sf_dir).select("doc_id", T.script_counts(F.concat(F.col("text"), tail)).alias("m"))
    # Spark puts a filter on the map's size before ``explode``, which counts everything twice.
    return d.select("doc_id", F.explode_outer("m").alias("script", "k")).where(F.col("script").isNotNull()).select("doc_id", "script", n("k").alias("n"))


@query
def tenants_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenant of each call by its key; calls without one are anonymous, unknown keys are refused."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("key"), (F.col("user_id") % 7).cast("string")))
    calls = e.select("event_id", key.alias("api_key"), F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("client"))
    known, refused = requests.with_tenants(calls, spark.createDataFrame(samples.KEYS, "api_key string, tenant string"))
    return known.select("event_id", "tenant", F.lit(None).cast("string").alias("reason")).unionByName(refused.select("event_id", F.lit(None).cast("string").alias("tenant"), "reason"))


# --- dedupe and cache ------------------------------------------------------------------------------


@query
def dedupe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grading.prepare(items(spark, sf_dir), [])
    d = grading.distinct_texts(p.withColumn("first_id", F.col("id")), "id", "first_id")
    return d.select("text_hash", F.col("text").alias("first_id"), "n_items")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hash and raw word-list verdict, computed once and written."""
    v = grading.with_raw(prepared(spark, sf_dir), None, "id")[0]
    return keep(v.select("id", "text_hash", *grading.RAW_COLS), "scored")


def yesterday(v: DataFrame) -> DataFrame:
    """A verdict table of all texts, some entries of an older version."""
    version = F.when(F.col("id") % 4 < 2, F.lit(grading.RUBRIC_VERSION)).otherwise(F.lit("old"))
    v = v.withColumns({"rubric_version": version, "created": F.col("id"), "last_used": F.col("id") * 7 % 1000}).select(*cache.KEY, *[c for c in grading.RAW_COLS if c != "backend"], "created", "last_used")
    return cache.upsert(v.limit(0), v)


@query
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against yesterday's table on disk."""
    p = scored(spark, sf_dir)
    store = VerdictStore(spark, new_path(spark, "store"))
    store.upsert(yesterday(p))
    p = p.select("id", "text_hash")
    old = store.candidates(p, lexicon.SCORER, grading.RUBRIC_VERSION)
    hit = cache.lookup(p, old, lexicon.SCORER, grading.RUBRIC_VERSION)
    left = cache.misses(p, old, lexicon.SCORER, grading.RUBRIC_VERSION).select(F.col("id").alias("mid"))
    return hit.join(left, hit["id"] == left["mid"], "left").select("id", "cached", F.col("mid").isNotNull().alias("missed"))


@query
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's table on disk, and today's entries put into it."""
    v = scored(spark, sf_dir)
    old = yesterday(v)
    created = F.col("id") + F.when(F.col("id") % 3 == 0, 10).otherwise(-10)
    new = v.withColumns({"rubric_version": F.lit(grading.RUBRIC_VERSION), "created": created, "last_used": created}).select(*old.columns)
    store = VerdictStore(spark, new_path(spark, "store"))
    store.upsert(old)
    store.upsert(new)
    return store.read().select("backend", "rubric_version", "text_hash", "created", "last_used")


@query
def cache_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.cache_size(yesterday(scored(spark, sf_dir)))


@query
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    once, _ = grading.with_raw(p, None, "id", dedupe=True)
    return grading.finish(once).select("id", "text_hash", r6("level").alias("level"), "action", "cached")


@query
def lru_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scored(spark, sf_dir)
    used = v.select("text_hash", (F.col("id") * 13 % 1500).alias("used_at"))
    touched = cache.touch(yesterday(v).where(F.col("rubric_version") == grading.RUBRIC_VERSION), used)
    return cache.retain_recent(touched, 100).select("text_hash", "last_used")


@query
def client_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("source").alias("viewer"), F.col("doc_id").alias("seq"))
    return cache.retain_last(d, 20)


# --- evaluation ------------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


@query
def labels_to_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.to_golden(labelled(spark, sf_dir), "text", "toxic", "en", {"1": 2}, "labels", "labels.parquet", "harassment", "doc_id")
    return g.select("id", n(F.length("text")).alias("chars"), n("level").alias("level"), F.array_join("categories", ",").alias("categories"), "targeted", "note", "lang")


@query
def golden_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.to_golden(labelled(spark, sf_dir), "text", "quality", "xx", {"0": 3, "1": 0}, "q", "q.csv", "spam", "doc_id", limit=50)
    return g.select("id", n("level").alias("level"), F.array_join("categories", ",").alias("categories"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded documents with expectations carried along: toxic 1 is level 2 harassment aimed at a person."""
    bad = F.col("toxic") == 1
    rows = labelled(spark, sf_dir).withColumns({
        "id": F.col("doc_id"), "expected_level": F.when(bad, 2).otherwise(0), "expected_targeted": bad,
        "categories": F.when(bad, F.array(F.lit("harassment"))).otherwise(F.array().cast("array<string>")),
    })
    g = grading.grade(rows, word_list(spark), "balanced").withColumn("text", F.substring("text", 1, 60))
    # Grading is done once; the measures then read a narrow table.
    return keep(g.drop("level_probs", "reasons"), "evaluated")


@query
def eval_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluation(evaluated(spark, sf_dir), "balanced"))


@query
def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluation(evaluated(spark, sf_dir), "strict", overall=True))


def _rounded(e: DataFrame) -> DataFrame:
    return e.select("lang", "n", *[r6(c).alias(c) for c in ("exact", "within1", "f1_l2", "spearman", "cat", "targeted")], "false_blocks", "misses", "tokens_per_item")


@query
def gross_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluate.gross_errors(evaluated(spark, sf_dir))
    return e.select("id", "lang", n("expected_level").alias("expected_level"), r6("level").alias("level"), n("level_argmax").alias("level_argmax"), "top_category", "text_60")


@query
def spearman_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.spearman(evaluated(spark, sf_dir), "lang", "expected_level", "level")
    return s.select("lang", "n", r6("spearman").alias("spearman"))


@query
def binary_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluate.binary_evaluation(evaluated(spark, sf_dir).withColumn("bad", F.col("toxic")), ["source"])
    return e.withColumn("f1", r6("f1"))


# --- requests --------------------------------------------------------------------------------------


@query
def invalid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "request_id")
    return grading.invalid_requests(c, max_items=6, max_chars=1200)


@query
def validate_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), "text")).alias("items"))
    return grading.validate_nested(c, 6, 1200).select("conv_id", "reason")


@query
def usage_by_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumns({"cached": F.col("turn") % 2 == 1, "input_tokens": F.when(F.col("turn") % 2 == 1, 0.0).otherwise(F.length("text") / 4.0)})
    u = requests.usage(c, ["conv_id"])
    return u.withColumn("cost_usd", F.round("cost_usd", 9))


@query
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batches.number_batches(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4)
    return b.select("conv_id", "turn", n("pos").alias("pos"), n("chunk").alias("chunk"))


@query
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batches.build_requests(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4)
    n_state = F.size(F.from_json("state", "map<string,string>"))
    return b.select("conv_id", n("chunk").alias("chunk"), n("n_items").alias("n_items"), n("n_questions").alias("n_questions"), n(n_state).alias("n_state"))


@query
def batch_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request says: one row a text with its state and how many questions are asked about it."""
    b = batches.build_requests(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4)
    asked = b.select("conv_id", "chunk", F.from_json("state", "map<string,string>").alias("state"), F.explode(F.from_json("questions", "map<string,string>")).alias("name", "question"))
    key = F.regexp_extract("name", "^(c[0-9]+)_", 1)
    asked = asked.select("conv_id", "chunk", key.alias("key"), F.regexp_extract("name", "^c[0-9]+_(.*)$", 1).alias("about"), F.element_at("state", key).alias("text"), F.contains("question", F.concat(F.lit("`"), key, F.lit("`"))).alias("named"))
    out = asked.groupBy("conv_id", "chunk", "key").agg(F.array_join(F.array_sort(F.collect_set("about")), ",").alias("about"), F.bool_and("named").alias("named"), F.max(F.sha2("text", 256)).alias("text_sha256"))
    return out.withColumn("chunk", n("chunk"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch answers of a model, made from the whole documents by expression: two items each, the second without level 4."""
    size = F.length(F.coalesce("text", F.lit("")))
    x = size % 10 / 10.0
    level = lambda ps: F.to_json(F.struct(F.lit("score").alias("type"), F.lit(0.9).alias("confidence"), F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(len(ps))]), F.array(*ps)).alias("probabilities")))
    yes = lambda p: F.to_json(F.struct(F.lit("noul").alias("type"), p.alias("noul")))
    parts = []
    for i in range(2):
        parts.append((f"c{i}_risk", level([x, F.lit(0.2), F.lit(0.1), F.lit(0.1), *([F.lit(0.1)] if i == 0 else [])] if i == 0 else [F.lit(0.0), x, F.lit(0.0), x])))
        parts.append((f"c{i}_targeted", yes(x)))
        parts += [(f"c{i}_cat_{c}", yes(F.lit(0.1 * (k + i)))) for k, c in enumerate(CATEGORIES)]
    answers = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts])
    out = F.concat(F.lit('{"model":"m","answers":{'), answers, F.lit('},"usage":{"input_tokens":'), size.cast("string"), F.lit("}}"))
    return documents(spark, sf_dir).select("doc_id", out.alias("response"), F.lit(2).alias("n_items"))


@query
def parse_model_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = batches.parse_responses(responses(spark, sf_dir), "response", "n_items")
    return p.select("doc_id", n("item").alias("item"), r6(expected_level(F.col("level_probs"))).alias("level"), n(argmax_level(F.col("level_probs"))).alias("level_argmax"), r6("cat_hate").alias("cat_hate"), r6("cat_illegal").alias("cat_illegal"), "targeted", "confidence", "input_tokens")


@query
def results_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("id"), "text")
    got = c.where("(batch_id + id) % 4 <> 0").select("batch_id", "id", F.sha2("text", 256).alias("answer"))
    return batches.results_to_items(c.drop("text"), got)


@query
def quota_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("tenant"), micros("ts").alias("us"))
    calls = calls.select("call_id", "tenant", (F.col("us") / 1e6).alias("ts"), (F.col("tenant") % 4).cast("int").alias("quota"))
    return requests.replay_quota(calls, samples.QUOTA_S).select("call_id", "tenant", "admitted")


@query
def tenant_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = documents(spark, sf_dir).select(F.col("doc_id").alias("call_id"), F.col("source").alias("tenant"))
    out = requests.with_limits(calls, spark.createDataFrame(samples.TENANTS, samples.TENANT_SCHEMA), 600)
    return out.select("call_id", "tenant", n("quota").alias("quota"))


@query
def feedback_misjudgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir)
    human = g.join(table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id"))
    fb = human.select("doc_id", "text_hash", F.when(F.col("toxic") == 1, "block").otherwise("pass").alias("human_action"))
    return requests.misjudgments(fb, g.select("text_hash", "action", "level")).select("doc_id", "human_action", "action", r6("level").alias("level"))


# --- nodes and streams -----------------------------------------------------------------------------


def node_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as texts of nodes: a user is a node, the event type its text; errors clear it."""
    text = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.lit("page").alias("surface"), F.col("user_id").alias("node_id"), "ts", text.alias("text"))


@query
def text_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.text_changes(node_events(spark, sf_dir), ["surface", "node_id"], ["ts", "event_id"]).select("event_id", "node_id", "text")


@query
def stale_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = node_events(spark, sf_dir)
    v = e.where("text <> ''").select("surface", "node_id", "event_id", (F.col("ts") + F.expr("interval 12 hours")).alias("ts"), "text")
    return viewer.fresh_verdicts(v, e.drop("event_id"), ["surface", "node_id"]).select("event_id", "node_id", "text")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # A pattern, as a stream source takes no single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query
def stream_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang").repartition(spark.sparkContext.defaultParallelism)
    out = jobs.run_available(jobs.grade_stream(s, word_list(spark)), "graded")
    return out.select("id", "lang", "text_hash", r6("level").alias("level"), n("level_argmax").alias("level_argmax"), "targeted", "confidence", "top_category", "action", F.array_join("reasons", ",").alias("reasons"))


def arrivals(rows: DataFrame, at: Column, by: str, late_s: int, batches: int = 5) -> DataFrame:
    """A table as a stream of some micro-batches: each row comes up to ``late_s`` after its time, in an order of its own.

    A last row of a far later time, with nulls otherwise, lets the watermark pass all others.
    """
    spark = rows.sparkSession
    inbox, files = new_path(spark, "inbox"), max(4, rows.rdd.getNumPartitions())
    comes = rows.withColumns({"at": at, "comes": F.unix_micros(at) / 1e6 + F.pmod(F.xxhash64(by), F.lit(late_s))})
    cuts = comes.approxQuantile("comes", [k / batches for k in range(1, batches)], 0.001)
    part = sum(((F.col("comes") >= c).cast("int") for c in cuts), F.lit(0))
    for k in range(batches):
        comes.where(part == k).drop("comes").repartition(files).write.mode("append").parquet(inbox)
    last = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema] + [F.expr("timestamp'2200-01-01'").alias("at")]
    spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(inbox)
    return spark.readStream.schema(spark.read.parquet(inbox).schema).option("maxFilesPerTrigger", files).parquet(inbox)


@query
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls come in five micro-batches, up to a day late: the same ones are admitted as in order."""
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("tenant"), F.col("ts").cast("timestamp").alias("t"), (F.col("user_id") % 4).cast("int").alias("quota"))
    s = arrivals(spread(calls), F.col("t"), "call_id", 86_400).withColumn("ts", F.unix_micros("at") / 1e6)
    return jobs.run_available(ordered.quota_in_order(s, samples.QUOTA_S, "1 day", 86_400.0, 5 * 86_400.0), "quota").select("call_id", "tenant", "admitted")


@query
def stream_text_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("text"))
    s = arrivals(spread(c), F.timestamp_seconds((F.col("turn") + 1) * 60), "conv_id", 300)
    return jobs.run_available(ordered.changes_in_order(s, ["conv_id"], F.col("at"), ["turn"], delay="5 minutes", slot_s=1800.0), "changes")


@query
def stream_stale_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and their verdicts, twelve hours later, as two streams that come in five micro-batches each."""
    e = node_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    texts = arrivals(spread(e), F.col("ts"), "event_id", 40_000)
    v = e.where("text <> ''").withColumn("ts", F.col("ts") + F.expr("interval 12 hours"))
    verdicts = arrivals(spread(v), F.col("ts"), "event_id", 80_000)
    both = [x.drop("ts").withColumnRenamed("at", "ts") for x in (texts, verdicts)]
    out = ordered.fresh_verdict_stream(*both, ["surface", "node_id"], ["event_id"], delay="1 day", slot_s=86_400.0)
    return jobs.run_available(out, "fresh").select("event_id", "node_id", "text")


@query
def stream_scored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two micro-batches: texts that the first one scored are not scored again."""
    inbox, rows = new_path(spark, "inbox"), items(spark, sf_dir)
    files = rows.rdd.getNumPartitions()
    for odd in (0, 1):
        rows.where(F.pmod("id", F.lit(2)) == odd).repartition(files).write.mode("append").parquet(f"{inbox}/part={odd}")
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(inbox)
    out, store = new_path(spark, "verdicts"), new_path(spark, "store")
    jobs.scored_once(s, word_list(spark), samples.LengthScorer(), store, out, new_path(spark, "scored-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("id", "cached", r6("level").alias("level"), n("level_argmax").alias("level_argmax"), "action", "input_tokens")
