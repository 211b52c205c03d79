"""Evaluation against labelled rows (A2-A4, A8, D2) and Spearman's rho without a window over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.verdict import CATEGORIES
from plumbline.operators.ordering import running_total
from plumbline.operators.policy import Policy, decide, load_policy


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0."""
    return F.when(b == 0, float("nan")).otherwise(a / b)


def f1(expected: Column, predicted: Column) -> Column:
    """A4. Aggregate F1 of two boolean columns."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    tp, fp, fn = n(expected & predicted), n(~expected & predicted), n(expected & ~predicted)
    return ratio(2 * tp, (2 * tp + fp + fn))


def expected_action(policy: Policy) -> Column:
    """The policy's action on the labels: level, confidence 1, labelled categories at 1."""
    cats = {c: F.array_contains("categories", c).cast("double") for c in CATEGORIES}
    return decide(F.col("expected_level").cast("double"), F.lit(1.0), cats, policy)


def judged(verdicts: DataFrame, policy: str | Policy | dict) -> DataFrame:
    """Adds the per-row outcomes. ``verdicts`` carries expected_level, categories (array) and expected_targeted."""
    e, p = F.col("expected_level"), F.col("level_argmax")
    none = F.size("categories") == 0
    cat_ok = F.when(none, F.size("present") == 0).otherwise(F.size(F.array_except("categories", "present")) == 0)
    want = expected_action(load_policy(policy))
    return verdicts.withColumns({
        "exact": p == e, "within1": F.abs(p - e) <= 1, "cat_ok": cat_ok, "targeted_ok": (F.col("targeted") >= 0.5) == F.col("expected_targeted"),
        "false_block": (want == "pass") & (F.col("action") == "block"), "miss": (want == "block") & (F.col("action") == "pass"),
    })


def evaluation(verdicts: DataFrame, policy: str | Policy | dict, overall: bool = False) -> DataFrame:
    """A2, and with ``overall`` A3: one row a language, lang null for all (there F1 and Spearman stay blank)."""
    j = judged(verdicts, policy)
    share = lambda c: F.avg(F.col(c).cast("double"))
    aggs = [
        F.count("*").alias("n"), share("exact").alias("exact"), share("within1").alias("within1"),
        f1(F.col("expected_level") >= 2, F.col("level") >= 1.5).alias("f1_l2"), share("cat_ok").alias("cat"), share("targeted_ok").alias("targeted"),
        F.sum(F.col("false_block").cast("long")).alias("false_blocks"), F.sum(F.col("miss").cast("long")).alias("misses"), F.avg("input_tokens").alias("tokens_per_item"),
    ]
    rho = spearman(verdicts, "lang", "expected_level", "level").select(F.col("lang").alias("__lang"), "spearman")
    of_lang = F.col("lang").eqNullSafe(F.col("__lang"))
    if not overall:
        return j.groupBy("lang").agg(*aggs).join(rho, of_lang, "left").drop("__lang")
    out = j.rollup("lang").agg(*aggs, F.grouping("lang").alias("__all"))
    out = out.join(rho, of_lang & (F.col("__all") == 0), "left")
    blank = lambda c: F.when(F.col("__all") == 0, F.col(c))
    return out.withColumns({"f1_l2": blank("f1_l2"), "tokens_per_item": blank("tokens_per_item")}).drop("__all", "__lang")


def gross_errors(verdicts: DataFrame, text_col: str = "text") -> DataFrame:
    """A8. Rows that are two or more levels off, with the first 60 characters."""
    off = F.abs(F.col("level_argmax") - F.col("expected_level")) >= 2
    return verdicts.where(off).select("id", "lang", "expected_level", "level", "level_argmax", "top_category", F.substring(text_col, 1, 60).alias("text_60"))


def average_ranks(counts: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """W1. (by, value, rank): mean rank of each distinct value, from a table of counts ``n``."""
    per = counts.groupBy(by, value).agg(F.sum("n").alias("n"))
    return running_total(per, [by], [value], F.col("n"), "before").select(by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out))


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """W1. (by, n, spearman): Pearson of the ranks, over value counts only; NaN under two rows or without variance."""
    counts = df.groupBy(by, x, y).agg(F.count("*").alias("n"))
    rows = counts.join(average_ranks(counts, by, x, "rx"), [by, x]).join(average_ranks(counts, by, y, "ry"), [by, y])
    n = F.sum("n")
    mean = rows.groupBy(by).agg(n.alias("total"), (F.sum(F.col("n") * F.col("rx")) / n).alias("mx"), (F.sum(F.col("n") * F.col("ry")) / n).alias("my"))
    dx, dy = F.col("rx") - F.col("mx"), F.col("ry") - F.col("my")
    out = rows.join(mean, by).groupBy(by).agg(
        F.first("total").alias("n_rows"), F.sum(F.col("n") * dx * dy).alias("cov"), F.sum(F.col("n") * dx * dx).alias("vx"), F.sum(F.col("n") * dy * dy).alias("vy")
    )
    flat = (F.col("n_rows") < 2) | (F.col("vx") == 0) | (F.col("vy") == 0)
    rho = F.when(flat, float("nan")).otherwise(F.try_divide("cov", F.sqrt("vx") * F.sqrt("vy")))
    return out.select(by, F.col("n_rows").alias("n"), rho.alias("spearman"))


def binary_evaluation(rows: DataFrame, by: list[str]) -> DataFrame:
    """D2. Counts and F1 of level >= 2 for rows with ``bad`` (0/1) and a verdict."""
    e, p = F.col("bad") == 1, F.col("level") >= 1.5
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), n(e & p, "tp"), n(~e & p, "fp"), n(e & ~p, "fn"), f1(e, p).alias("f1"))
