"""Operator 1: quality rules by host, with DataFrame functions only.

Each document is measured inside its own row. Failures are then counted by host, the hosts' failure
rates are shrunk with an empirical beta prior (fitted by moments to all hosts), and a host whose
shrunk rate reaches ``max_host_rate`` has all its documents rejected.

Defined cases: a null text has no words and fails; a null host gets no verdict, so only the rules
count for its documents; repeated rows count each; an empty table gives an empty result. Only the
three named columns are read. Windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import WORD_GAP, keep, rows_at_most, words

SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\x0c\r"
#: A host table of at most this many rows (about 40 bytes each) is broadcast.
BROADCAST_HOSTS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so that the lambdas in ``body`` don't compute it again for each element."""
    return F.transform(F.array(value), body)[0]


def repeated_words(ws: Column, k: int = 3) -> Column:
    """How many words lie in windows of ``k`` words that are found twice or more in the array."""

    def covered(pos: Column) -> Column:
        n = F.size(pos)
        step = F.transform(pos, lambda p, i: F.when(i + 1 < n, F.least(F.get(pos, i + 1) - p, F.lit(k))).otherwise(F.lit(k)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(s: Column) -> Column:
        twice = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"]))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - k)
        return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("h"), i.alias("i"))))

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    found = let(hashed, lambda h: let(windows(h), lambda s: let(positions(s), covered)))
    return F.when(F.size(ws) > k, found).otherwise(F.lit(0).cast("long"))


def document_measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, GAPS, "")) > 0)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"), words(text).alias("ws"), lines.alias("ls"))
    return d.select(
        "doc_id",
        "host",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.translate("t", GAPS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
    )


def beta_prior(hosts: DataFrame, max_strength: float = 1000.0) -> tuple[float, float]:
    """Beta parameters fitted by moments to (host, n, fails); one row comes to the driver."""
    n, k = F.sum("n"), F.sum("fails")
    p = k / n
    row = hosts.agg(
        p.alias("p"), F.count("*").alias("hosts"), n.alias("n"), F.sum(F.col("fails") * F.col("fails") / F.col("n")).alias("second"), F.sum(F.col("fails")).alias("k")
    ).first()
    if not row["hosts"] or not row["n"]:
        return 0.5, 0.5
    mean = row["p"]
    # Weighted variance of the rates around the pooled rate, less what sampling alone gives.
    between = row["second"] / row["n"] - mean * mean
    sampling = mean * (1 - mean) * row["hosts"] / row["n"]
    spread = between - sampling
    strength = max_strength if spread <= 0 else mean * (1 - mean) / spread - 1
    strength = min(max_strength, max(1.0, strength))
    return max(mean, 1e-6) * strength, max(1 - mean, 1e-6) * strength


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_host_rate: float = 0.5,
) -> DataFrame:
    """One row a document: its measures, base_failed, the host's shrunk failure rate, and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    d = keep(document_measures(docs, id_col, text_col, host_col).withColumn("base_failed", failed), "rules")
    hosts = d.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    hosts = keep(hosts, "hosts")
    a, b = beta_prior(hosts)
    verdicts = hosts.select("host", ((F.col("fails") + a) / (F.col("n") + a + b)).alias("host_rate"))
    verdicts = F.broadcast(verdicts) if rows_at_most(hosts, BROADCAST_HOSTS) else verdicts
    out = d.join(verdicts, "host", "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) < max_host_rate)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))
