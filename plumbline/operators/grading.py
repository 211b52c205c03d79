"""Grading a table of texts (WL1): prepare, score, fuse, round, decide; input checks (V1, V2); scorers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import compact, normalize, resolve_language, text_hash
from plumbline.functions.verdict import CAT_COLS, argmax_level, expected_level, once, present, round4, top_category
from plumbline.functions.verdict import cats as category_columns
from plumbline.operators import lexicon
from plumbline.operators.cache import lookup, misses
from plumbline.operators.lexicon import Entry, as_table, fuse_floor, hits_for_language, lexicon_hits, lexicon_raw, with_indexed_hits
from plumbline.operators.policy import Policy, apply_policy
from plumbline.sources.shared import keep

#: Part of every cache key; raised whenever what scorers are asked changes.
RUBRIC_VERSION = "2026.11.1"
RAW_COLS = ("level_probs", *CAT_COLS, "targeted", "confidence", "backend", "input_tokens")
RAW_SCHEMA = "level_probs array<double>, " + ", ".join(f"{c} double" for c in CAT_COLS) + ", targeted double, confidence double, backend string, input_tokens double"


class Scorer(Protocol):
    """A batch scorer: one raw verdict (a dict with RAW_COLS) for each text, in order."""

    name: str

    def grade(self, texts: Sequence[str]) -> Sequence[dict]: ...


def prepare(items: DataFrame, entries: Sequence[Entry] | DataFrame, detect: bool = True, use_nfkc: bool = True, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Adds norm, text_hash, lang (resolved) and hits (of any language). Null texts are dropped.

    Long lists, and tables of ``entry_table``, are joined by an index instead of standing in the plan.
    """
    df = items.where(F.col(text_col).isNotNull()).withColumn("norm", normalize(F.col(text_col), use_nfkc))
    given = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    df = df.withColumns({"text_hash": text_hash(F.col("norm")), "lang": resolve_language(given, F.col(text_col), detect), "compact": compact(F.col("norm"))})
    if isinstance(entries, DataFrame) or len(entries) > lexicon.INLINE_ENTRIES:
        return with_indexed_hits(df, entries if isinstance(entries, DataFrame) else as_table(df.sparkSession, entries))
    hits = lexicon_hits(entries, F.col("norm"), F.col("compact"))
    return once(df, {"hits": hits}) if entries else df.withColumn("hits", hits)


def score_distinct(texts: DataFrame, scorer: Scorer, batch: int = 16, partitions: int | None = None) -> DataFrame:
    """U1. (text_hash, raw verdict columns) of a table (text_hash, text) of distinct texts.

    A scorer that gives another number of verdicts than it got texts is an error; nothing is made up.
    """
    df = texts.select("text_hash", "text")
    df = df.repartition(partitions, "text_hash") if partitions else df

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                raws = list(scorer.grade(part["text"].tolist()))
                if len(raws) != len(part):
                    raise ValueError(f"scorer {scorer.name} gave {len(raws)} verdicts for {len(part)} texts")
                yield pd.DataFrame([{"text_hash": h, **{c: r.get(c, 0.0) for c in RAW_COLS}, "backend": scorer.name} for h, r in zip(part["text_hash"], raws, strict=True)])

    return df.mapInPandas(run, f"text_hash string, {RAW_SCHEMA}")


def distinct_texts(prepared: DataFrame, order_col: str, text_col: str = "text") -> DataFrame:
    """A1. One row for each hash, with its first text by ``order_col`` and how many items have it."""
    return prepared.groupBy("text_hash").agg(F.min_by(text_col, order_col).alias("text"), F.count("*").alias("n_items"))


def with_raw(prepared: DataFrame, scorer: Scorer | None, order_col: str, dedupe: bool = False, cache: DataFrame | Callable[[DataFrame], DataFrame | None] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Adds the raw verdict columns and ``cached``; the second result has the newly scored hashes.

    Without a scorer the word-list score is a row expression: no shuffle, unless ``dedupe`` is asked for.
    With one, only distinct texts that the cache lacks are scored (J2, A1), then joined back (J3). The cache is a
    table, or a function that gives the entries that may belong to some text hashes (or None).
    """
    if scorer is None and not dedupe:
        return prepared.withColumns(lexicon_raw(F.col("hits")) | {"cached": F.lit(False)}), None
    name = scorer.name if scorer else "lexicon"
    # Written once, as it is read for the distinct texts and again for the join back.
    prepared = keep(prepared.drop("norm", "compact"), "prepared")
    if callable(cache):
        cache = cache(prepared.select("text_hash"))
    rest = prepared if cache is None else misses(prepared, cache, name, RUBRIC_VERSION)
    if scorer is None:
        first = rest.groupBy("text_hash").agg(F.min_by("hits", order_col).alias("hits"))
        new = first.withColumns(lexicon_raw(F.col("hits"))).drop("hits")
    else:
        new = score_distinct(distinct_texts(rest, order_col), scorer)
    if scorer is not None or cache is not None:
        new = keep(new, "scored")  # once too: the caller adds these verdicts to the cache
    if cache is None:
        return prepared.join(new, "text_hash").withColumn("cached", F.lit(False)), new
    old = lookup(prepared.select("text_hash").distinct(), cache, name, RUBRIC_VERSION).where("cached")
    known = new.withColumn("cached", F.lit(False)).unionByName(old.select("text_hash", *RAW_COLS, "cached").withColumn("input_tokens", F.lit(0.0)))
    return prepared.join(known, "text_hash"), new


def finish(scored: DataFrame, policy: str | Policy | dict | None = "balanced") -> DataFrame:
    """Fuse the floor, round, and decide on the rounded values."""
    own = scored.withColumn("own_hits", hits_for_language(F.col("hits"), F.col("lang")))
    fused = fuse_floor(own, "own_hits")
    probs = F.col("level_probs")
    fused = fused.withColumns({"level": round4(expected_level(probs)), "level_argmax": argmax_level(probs)})
    again = {c: round4(F.col(c)) for c in (*CAT_COLS, "targeted", "confidence")}
    fused = fused.withColumns(again | {"level_probs": F.transform("level_probs", round4)})
    fused = fused.withColumn("present", present(category_columns())).withColumn("top_category", top_category(F.col("present")))
    out = apply_policy(fused, policy) if policy is not None else fused
    verdict = ("level_probs", *CAT_COLS, "targeted", "confidence", "reasons", "level", "level_argmax", "present", "top_category", *(["action"] if policy is not None else []))
    return once(out, {c: F.col(c) for c in verdict})


def grade(
    items: DataFrame,
    entries: Sequence[Entry],
    policy: str | Policy | dict | None = "balanced",
    scorer: Scorer | None = None,
    cache: DataFrame | None = None,
    dedupe: bool = False,
    detect: bool = True,
    use_nfkc: bool = True,
    id_col: str = "id",
    lang_col: str | None = "lang",
) -> DataFrame:
    """WL1. One verdict for each item: the item's columns, then lang, text_hash and the verdict columns.

    Filters on the item's columns reach the scan; filters on the verdict don't repeat its work.
    """
    prepared = prepare(items, entries, detect, use_nfkc, lang_col=lang_col)
    scored, _ = with_raw(prepared, scorer, id_col, dedupe, cache)
    return finish(scored, policy).drop("norm", "compact", "hits", "own_hits")


def invalid_requests(requests: DataFrame, max_items: int = 100, max_chars: int = 5000, request_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """V1. (request, n_items, reason) of every request of an exploded log that must be refused as a whole."""
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    per = requests.groupBy(request_col).agg(F.count("*").alias("n_items"), F.min(size).alias("shortest"), F.max(size).alias("longest"))
    reason = F.when(F.col("n_items") > max_items, "too many items").when(F.col("longest") > max_chars, "text too long").when(F.col("shortest") == 0, "empty text")
    return per.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(request_col, "n_items", "reason")


def validate_nested(requests: DataFrame, max_items: int = 100, max_chars: int = 5000) -> DataFrame:
    """V1 for a log whose items are still an array (items: array<struct<id, text, lang>>): adds reason, no shuffle."""
    items = F.col("items")
    size = lambda x: F.length(F.coalesce(x["text"], F.lit("")))
    reason = F.when(F.coalesce(F.size(items), F.lit(0)) < 1, "no items").when(F.size(items) > max_items, "too many items")
    reason = reason.when(F.exists(items, lambda x: size(x) > max_chars), "text too long").when(F.exists(items, lambda x: size(x) == 0), "empty text")
    return requests.withColumn("reason", reason)


def long_enough(texts: DataFrame, least: int = 2, text_col: str = "text") -> DataFrame:
    """V2. Texts of at least ``least`` characters (2 for shown texts, 3 for drafts)."""
    return texts.where(F.length(text_col) >= least)

