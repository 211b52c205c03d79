"""Request logs: usage (A5), quotas (W4), tenants (S6) and human feedback."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.verdict import ACTIONS
from plumbline.operators.ordering import pieces
from plumbline.operators.policy import small

#: Fixed values.
DEFAULT_LIMIT, WINDOW_S, PRICE_PER_MILLION = 600, 60.0, 0.042


def usage(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """A5. Items, cached items, input tokens (one decimal) and cost by request, tenant or both."""
    tokens = F.sum("input_tokens")
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("items"), F.sum(F.col("cached").cast("long")).alias("cached"), F.round(tokens, 1).alias("backend_input_tokens"), (tokens * PRICE_PER_MILLION / 1e6).alias("cost_usd")
    )


def with_tenants(calls: DataFrame, keys: DataFrame, open_access: bool = True) -> tuple[DataFrame, DataFrame]:
    """S6. (calls with their tenant, refused calls with reason), from api_key and client.

    ``keys`` has api_key and tenant. An unknown key is refused. A call without a key belongs to its client's
    anonymous tenant, or is refused where access is not open.
    """
    k = small(keys.where(F.col("api_key").isNotNull()).select("api_key", F.col("tenant").alias("__tenant")).dropDuplicates(["api_key"]))
    given = F.coalesce("api_key", F.lit("")) != ""
    found = calls.join(k, "api_key", "left")
    anonymous = F.concat(F.lit("anonymous:"), F.coalesce("client", F.lit("unknown")))
    found = found.withColumn("tenant", F.when(given, F.col("__tenant")).when(F.lit(open_access), anonymous))
    reason = F.when(given, "unknown key").otherwise("no key")
    known = F.col("tenant").isNotNull()
    return found.where(known).drop("__tenant"), found.where(~known).withColumn("reason", reason).drop("__tenant", "tenant")


def with_limits(calls: DataFrame, tenants: DataFrame, default: int = DEFAULT_LIMIT) -> DataFrame:
    """Adds quota: the tenant's rate_limit, or the default where it is null or 0."""
    t = small(tenants.select(F.col("name").alias("tenant"), "rate_limit"))
    return calls.join(t, "tenant", "left").withColumn("quota", F.coalesce(F.nullif(F.col("rate_limit"), F.lit(0)), F.lit(default)).cast("int")).drop("rate_limit")


def admit(window: deque, at: float, quota: int, seconds: float) -> bool:
    """One call at time ``at``: old times leave the window, and the call enters it if there is room."""
    if quota <= 0:
        return True
    while window and at - window[0] > seconds:
        window.popleft()
    if len(window) >= quota:
        return False
    window.append(at)
    return True


def replay_quota(calls: DataFrame, seconds: float = WINDOW_S) -> DataFrame:
    """W4. (call_id, tenant, ts, admitted) of calls with call_id, tenant, ts (seconds) and quota.

    Only admitted calls fill the window, so calls are replayed in order; but a pause longer than the window
    empties it, so a tenant's calls are cut there and the pieces are replayed side by side. Rows reach the
    helper sorted in batches: it holds one window of at most ``quota`` times, never a piece. Only a tenant that
    never pauses is one task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}

    def run(batches):
        here, window = object(), deque()
        for pdf in batches:
            out = []
            for t, piece, at, quota in zip(pdf["tenant"], pdf["piece"], pdf["ts"], pdf["quota"], strict=True):
                if (t, piece) != here:
                    here, window = (t, piece), deque()
                out.append(admit(window, at, quota, seconds))
            yield pdf[["call_id", "tenant", "ts"]].assign(admitted=pd.Series(out, index=pdf.index, dtype=bool))

    rows = pieces(calls.select("call_id", "tenant", "ts", "quota"), ["tenant"], "ts", ["ts", "call_id"], seconds, "piece")
    rows = rows.repartition("tenant", "piece").sortWithinPartitions("tenant", "piece", "ts", "call_id")
    return rows.mapInPandas(run, f"call_id {kinds['call_id']}, tenant {kinds['tenant']}, ts double, admitted boolean")


def stamped_feedback(feedback: DataFrame, tenant: Column, now: Column | None = None) -> DataFrame:
    """Feedback rows with ts and tenant; unknown actions and levels outside 0..4 are refused."""
    ok = F.col("human_action").isin(*ACTIONS) & (F.col("expected_level").isNull() | F.col("expected_level").between(0, 4))
    checked = feedback.withColumn("human_action", F.when(ok, F.col("human_action")).otherwise(F.raise_error(F.lit("bad human_action or expected_level"))))
    return checked.withColumns({"ts": now if now is not None else F.current_timestamp(), "tenant": tenant})


def append_feedback(feedback: DataFrame, path: str, tenant: Column, now: Column | None = None) -> None:
    """S9. Append stamped feedback; a run that is repeated appends again (``feedback_stream`` doesn't)."""
    stamped_feedback(feedback, tenant, now).write.mode("append").json(path)


def misjudgments(feedback: DataFrame, verdicts: DataFrame, on: tuple[str, ...] = ("text_hash",)) -> DataFrame:
    """J10. Feedback whose human action differs from the verdict's, joined on text_hash.

    A hash has several verdicts where the floor depends on the language: all different ones are given, or
    that of the row alone with ``on=("id",)`` or ``on=("text_hash", "lang")``.
    """
    v = verdicts.select(*on, "action", "level").distinct()
    return feedback.join(v, list(on)).where(F.col("human_action") != F.col("action"))
