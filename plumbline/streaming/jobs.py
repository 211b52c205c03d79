"""The same work on streams: grading (Q1), scoring each text once (Q2); see ``ordered`` for Q3 and Q4."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.grading import RUBRIC_VERSION, Scorer, finish, prepare, with_raw
from plumbline.operators.lexicon import Entry
from plumbline.operators.requests import stamped_feedback
from plumbline.operators.verdict_store import VerdictStore
from plumbline.sources.shared import new_path
from plumbline.streaming.ordered import keyed_state


def grade_stream(items: DataFrame, entries: Sequence[Entry], policy: str = "balanced", lang_col: str | None = "lang") -> DataFrame:
    """Q1. Row-local grading of an unbounded table."""
    scored, _ = with_raw(prepare(items, entries, lang_col=lang_col), None, "id")
    return finish(scored, policy).drop("norm", "compact", "hits", "own_hits")


def scored_once(items: DataFrame, entries: Sequence[Entry], scorer: Scorer, cache_path: str, out_path: str, checkpoint: str, policy: str = "balanced", buckets: int = 16):
    """Q2. Starts a query that scores only hashes the verdict store lacks, and appends verdicts to ``out_path``.

    A batch asks the store's filters for its own hashes and reads entries only where they may be (see
    ``verdict_store``): texts seen for the first time cost no read, however many batches went before. It writes
    its verdicts under its batch id, and then its entries with the id in the store's manifest, so a batch that is
    repeated is known there, or does the same again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store = VerdictStore(batch.sparkSession, cache_path, buckets)
        if store.note() is not None and store.note() >= batch_id:
            return
        scored, new = with_raw(prepare(batch, entries), scorer, "id", cache=lambda h: store.candidates(h, scorer.name, RUBRIC_VERSION), dedupe=True)
        out = finish(scored, policy).drop("norm", "compact", "hits", "own_hits")
        out.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        now = F.current_timestamp()
        store.upsert(new.withColumns({"rubric_version": F.lit(RUBRIC_VERSION), "created": now, "last_used": now}), note=batch_id)

    return items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def feedback_stream(feedback: DataFrame, path: str, tenant: Column, checkpoint: str, now: Column | None = None):
    """S9. Starts a query that appends checked feedback, each batch in the folder of its id.

    A batch that is repeated overwrites its folder: no second copy.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        stamped_feedback(batch, tenant, now).write.mode("overwrite").json(f"{path}/batch_id={batch_id}")

    return feedback.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, into a table of the shared folder, and return that table."""
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    with keyed_state(spark):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
