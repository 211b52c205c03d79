"""Operator 10: mix sources to target weights with hash-threshold histograms.

Each source takes whole repeats of all its documents and, for what is left of its target, the
documents whose hash lies below a threshold. The threshold comes from histograms: sizes are summed by
source and hash bucket, and only the bucket in which the budget ends is refined by the next bits of
the hash. Documents are never sorted or gathered; a histogram has at most 4,096 rows a source. Sources are
ranked and filled up in ranges, so that neither they nor rows of one hash need to fit into one task.

Defined cases: a null text has size 0; a null source is a source of its own that comes last; an empty
table gives an empty result; rows with one id share a hash and are then told apart by size; sizes of 0
take 0. Only the three named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.store import keep, same, text_hash, words
from plumbline.operators.ordering import running_total

LEVELS, BITS = 4, 12


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of a summary (source, source_size) with one row a source: shares by weight, each stopped
    at ``most`` times the source's size, the excess shared again by weight until none is above."""
    s = running_total(sources.withColumn("last", F.col("source").isNull()), [], ["last", "source"], F.lit(1), "rn")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rn") % len(weights) + 1).cast("int"))
    s = s.withColumns({"w": weight.cast("long"), "cap": most * F.col("source_size")})
    s = s.withColumn("fills", F.col("cap").cast("double") / F.col("w"))
    for c in ("cap", "w"):
        s = running_total(s, [], ["fills", "rn"], F.col(c), f"{c}_before")
    s = keep(s, "fills")
    # In order of the rate at which a source is full, those before the first that isn't are stopped.
    words_all, weight_all = s.agg(F.sum("source_size"), F.sum("w")).first()
    rate = (F.lit(words_all).cast("double") - F.col("cap_before")) / (F.lit(weight_all) - F.col("w_before"))
    s = s.withColumn("rate", rate)
    free = s.where(F.col("fills") > F.col("rate")).agg(F.min(F.struct("fills", "rn", "rate"))).first()[0]
    target = F.col("cap").cast("double")
    if free:
        full = F.struct("fills", "rn") < F.struct(F.lit(free["fills"]).alias("fills"), F.lit(free["rn"]).cast("long").alias("rn"))
        target = F.when(full, target).otherwise(F.least(F.col("w") * F.lit(free["rate"]), target))
    s = s.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("whole", whole)
    return s.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    with_hash: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words the mix takes of each document; with
    ``with_hash`` also th, the hash of its text."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, LEVELS * BITS // 4), 16, 10).cast("long")
    d = keep(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), h.alias("h"), text_hash(F.col(text_col)).alias("th")),
        "mix",
    )
    sums = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = keep(source_targets(sums, weights, most), "targets")

    # Nested thresholds: `low` is where the open bucket begins, `used` what lies below it.
    edge = targets.select("source", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("used"))
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        inside = d if level == 0 else d.join(F.broadcast(edge) if small else edge, same(d["source"], edge["source"])).where(
            F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS)
        ).select(d["source"], "size", "h")
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("size"))
        total = F.sum("size").over(Window.partitionBy("source").orderBy("b"))
        hist = hist.withColumn("end", total)
        small = targets.count() <= 100_000 if level == 0 else small
        hist = hist.alias("a").join(F.broadcast(edge.alias("e")) if small else edge.alias("e"), same(F.col("a.source"), F.col("e.source")))
        crossing = F.col("used") + F.col("end") > F.col("rest")
        edge = keep(
            hist.where(crossing)
            .groupBy(F.col("a.source").alias("source"))
            .agg(F.min(F.struct("b", "end", "size", "rest", "used")).alias("x"))
            .select("source", "x.rest", F.shiftleft("x.b", shift).alias("low"), (F.col("x.used") + F.col("x.end") - F.col("x.size")).alias("used")),
            f"edge{level}",
        )
    t, e = targets.alias("t"), edge.alias("e")
    both = t.join(e, same(F.col("t.source"), F.col("e.source")), "left").select("t.*", "e.low", "e.used")
    out = d.alias("d").join(F.broadcast(both.alias("b")) if small else both.alias("b"), same(F.col("d.source"), F.col("b.source")))
    # Rows that share the boundary hash are taken one by one, smallest first, while that comes nearer to the budget.
    at_edge = out.where(F.col("h") == F.col("low")).select("d.*", "source_size", "target", "whole", "rest", "used")
    at_edge = running_total(at_edge, ["source"], ["size", "doc_id", "th"], F.col("size"), "before").alias("d")
    more = [F.col("d.th").alias("th")] if with_hash else []
    result = lambda extra: [*more, F.col("d.doc_id").alias("doc_id"), F.col("d.size").alias("size"), "source_size", "target", (F.col("d.size") * (F.col("whole") + extra.cast("long"))).alias("taken")]
    edge_rows = at_edge.select(*result(F.col("used") + F.col("before") + F.col("d.size") / 2 <= F.col("rest")))
    other = out.where((F.col("h") != F.col("low")) | F.col("low").isNull())
    return other.select(*result(F.coalesce(F.col("h") < F.col("low"), F.lit(True)) & (F.col("rest") > 0))).unionByName(edge_rows)
