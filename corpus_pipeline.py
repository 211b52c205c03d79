"""Corpus pipeline: classifier, line dedup, near-dedup, decontamination, mixing.

Each stage takes the documents that its predecessor kept and is written as Parquet in the shared
folder before the next one reads it, so a lost executor costs one stage's tasks at most.

Defined cases of all stages: an empty table stays empty; null ids and null or empty texts are allowed, and
no stage but line dedup and mixing drops a document for them; rows that repeat an id are told apart by
their text; texts of any length are read whole; columns other than doc_id, text, source and n_chars are
kept as they are, whatever their names, and n_chars may be missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontaminate import contaminated
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.mixing import mix_sources
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.quality_classifier import quality_classifier
from plumbline.llm.store import keep, rows_at_most, with_verdicts
from plumbline.sources.shared import scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-resampling classifier keeps.

    Null and empty texts have log weight 0 and count as unremarkable; rows with one id share their noise
    but are judged by their own text; ties at the last key stay; without labels of both kinds all stay.
    """
    verdicts = quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), with_hash=True)
    rejected = keep(verdicts.where("not kept").select("doc_id", "th").distinct(), "rejected")
    return with_verdicts(docs, rejected, "left_anti")


def dedup_text_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later of similar lines; documents that lose all their lines go.

    Documents without a line (null, empty, blank) stay as they are. Of rows that repeat id and text one
    keeps its lines, the others go. n_chars, where there is one, is counted again for texts that were cut.
    """
    out = dedup_lines(docs)
    cut = F.col("line_dedup_removed") > 0
    out = out.where(~cut | (F.col("line_dedup_removed") < F.col("line_dedup_lines")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate group.

    Documents with a null id and those without words are linked with nothing and stay; rows that repeat an
    id are one document for links, so they stay or go together.
    """
    gone = keep(near_duplicates(docs, k=5).where("not kept").select("doc_id").distinct(), "repeated")
    return docs.join(F.broadcast(gone) if rows_at_most(gone, 1_000_000) else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts are clean, and items without words match nothing."""
    found = keep(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "th"), "contaminated")
    return with_verdicts(docs, found, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (words, repeats counted).

    Documents without words take nothing and go; a null source is one of its own; columns of the four
    names are replaced.
    """
    taken = keep(mix_sources(docs, with_hash=True).where("taken > 0").distinct(), "taken")
    return with_verdicts(docs, taken, "inner")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_text_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]

#: Hashed models, minima and similarity joins can't be put in SQL; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage writes on the way goes once its result is written
            docs = keep(stage(spark, docs, sf_dir), name, stays=True)
    return docs
