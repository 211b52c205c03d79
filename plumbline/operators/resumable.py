"""Scoring that is paid once (U1): a ledger of what was scored, and a quarantine of what can't be.

The ledger is a table in the shared folder, one folder a scorer and rubric version. A run scores only texts that
it lacks. Texts are dealt out to small tasks, and each finished task moves its file into the ledger at once
(commit algorithm 2 of Hadoop's committer), so a task that is repeated after an executor is lost repeats at most
its own ``task_texts`` texts, and a job that fails or is stopped keeps what its finished tasks have paid for.
A scorer's error doesn't fail the task: the batch is tried ``attempts`` times, then its texts one by one, and a
text that fails alone goes to the ledger with its error. Such texts are the quarantine: they are not asked again
until ``retry_failed``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.grading import RAW_COLS, RAW_SCHEMA, RUBRIC_VERSION, Scorer, distinct_texts, finish, prepare
from plumbline.operators.lexicon import Entry
from plumbline.operators.verdict_store import _fs
from plumbline.sources.shared import keep

SCHEMA = f"text_hash string, {RAW_SCHEMA}, error string"


def _batch(scorer: Scorer, texts: list[str], attempts: int) -> list[dict]:
    """One verdict or error a text."""
    error = ""
    for _ in range(attempts):
        try:
            raws = list(scorer.grade(texts))
            if len(raws) == len(texts):
                return raws
            error = f"{len(raws)} verdicts for {len(texts)} texts"
        except Exception as e:  # whatever a scorer raises is kept with the text
            error = f"{type(e).__name__}: {e}"
    if len(texts) == 1:
        return [{"error": error}]
    return [r for t in texts for r in _batch(scorer, [t], attempts)]


def read_ledger(spark, ledger: str, name: str, version: str = RUBRIC_VERSION) -> DataFrame:
    """(text_hash, raw verdict columns, error) of what is recorded; where a text was tried again, its verdict."""
    path = f"{ledger}/backend={name}/rubric_version={version}"
    p, fs = _fs(spark, path)
    rows = spark.read.schema(SCHEMA).parquet(path) if fs.exists(p) else spark.createDataFrame([], SCHEMA)
    cols = [c for c in rows.columns if c != "text_hash"]
    # A task that two executors finished is recorded twice.
    best = F.min_by(F.struct(*cols), F.coalesce(F.col("error"), F.lit("")))
    return rows.groupBy("text_hash").agg(best.alias("r")).select("text_hash", *[f"r.{c}" for c in cols])


def score_resumable(
    texts: DataFrame, scorer: Scorer, ledger: str, batch: int = 16, task_texts: int = 256, attempts: int = 2, wave_tasks: int = 20_000, retry_failed: bool = False, version: str = RUBRIC_VERSION
) -> tuple[DataFrame, DataFrame]:
    """((text_hash, raw verdict columns), (text_hash, error)) of a table (text_hash, text) of distinct texts.

    Very many texts are scored in waves of ``wave_tasks`` tasks.
    """
    spark = texts.sparkSession
    known = read_ledger(spark, ledger, scorer.name, version)
    known = known.where(F.col("error").isNull()) if retry_failed else known
    texts = texts.select("text_hash", "text")
    todo = keep(texts.join(known.select("text_hash"), "text_hash", "left_anti"), "todo")
    n = todo.count()
    waves = -(-n // (task_texts * wave_tasks))
    name, cols = scorer.name, [c for c in SCHEMA.replace(",", "").split() if c in (*RAW_COLS, "text_hash", "error")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                raws = _batch(scorer, part["text"].tolist(), attempts)
                rows = [{"text_hash": h, **{c: r.get(c, 0.0) for c in RAW_COLS}, "backend": name, "error": r.get("error")} for h, r in zip(part["text_hash"], raws, strict=True)]
                yield pd.DataFrame([r | ({"level_probs": None} if r["error"] else {}) for r in rows])[cols]

    for w in range(waves):
        part = todo.where(F.pmod(F.xxhash64("text_hash"), F.lit(waves)) == w)
        scored = part.repartition(max(1, -(-n // waves // task_texts)), F.xxhash64("text_hash", F.lit(1))).mapInPandas(run, SCHEMA)
        out = scored.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        out.parquet(f"{ledger}/backend={name}/rubric_version={version}")
    done = read_ledger(spark, ledger, name, version).join(texts.select("text_hash"), "text_hash", "left_semi")
    ok = F.col("error").isNull()
    return done.where(ok).drop("error"), done.where(~ok).select("text_hash", "error")


def grade_resumable(items: DataFrame, entries: Sequence[Entry], scorer: Scorer, ledger: str, policy: str = "balanced", id_col: str = "id", **scoring) -> tuple[DataFrame, DataFrame]:
    """(verdicts, quarantined items with their error): ``grading.grade`` with a scorer, through the ledger."""
    prepared = keep(prepare(items, entries).drop("norm", "compact"), "prepared")
    raw, failed = score_resumable(distinct_texts(prepared, id_col), scorer, ledger, **scoring)
    verdicts = finish(prepared.join(raw, "text_hash").withColumn("cached", F.lit(False)), policy)
    return verdicts.drop("hits", "own_hits"), prepared.drop("hits").join(failed, "text_hash")
