"""Keyed work in order of event time: quotas (Q3), text changes and stale verdicts (Q4).

Rows of a stream come late and out of order. ``in_order`` keeps them in the state store and hands each key's
rows to a fold in order of time, once the watermark (the latest time seen less ``delay``) has passed them:

* Keys are dealt into ``BUCKETS`` by hash, and rows come to the state in packs of one bucket and slot of event time, as
  every visit of the state costs far more than a row. A bucket's packs are buffered by slot, and a timer is set for a
  slot's end. When the watermark reaches it, the slot's rows are put in order and folded key by key, and their state
  goes. A task holds one slot of one bucket at a time, never a bucket's micro-batch.
* What a fold must remember (admitted times, the text shown) is one small value a key, packed by bucket; with ``idle`` it
  goes once event time has moved on so far without rows of the key.
* Packs whose latest row is later than the watermark are dropped by Spark and counted in the query's progress
  (``numRowsDroppedByWatermark``, in packs): choose ``delay`` as long as rows can be late.

At the end of input the last ``delay`` is still held back; a stream that is run over what is available is ended
by one row of a far later time, of a key of its own: it stays buffered, and all others are released. The state store must be RocksDB's
(``with keyed_state(spark):`` sets it for queries that start inside).
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from plumbline.operators.requests import WINDOW_S, admit

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt into so many buckets, each with a state of its own; results don't depend on it.
BUCKETS = 256
#: Rows that a task packs at once, and rows of a pack of results.
PACK_ROWS = 50_000
#: Bytes of packs from which on a chunk is put away.
CHUNK_BYTES = 4 << 20

#: Takes what is remembered of a key (None at first) and rows in order; yields results, and returns what to remember.
Fold = Callable[[tuple | None, Iterable[tuple]], Iterator[tuple]]


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and maps of keyed state need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _packed(slot_ms: int):
    """Packs the rows of a task by bucket and slot; rows end with their bucket and their time in milliseconds."""

    def packs(by: dict[tuple[int, int], list[tuple]]) -> pa.RecordBatch:
        times = pa.array([max(r[-1] for r in rows) * 1000 for rows in by.values()], pa.timestamp("us", "UTC"))
        rows = [pickle.dumps([r[:-2] for r in rows], 5) for rows in by.values()]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in by], pa.int64()), pa.array([k[1] for k in by], pa.int64()), pa.array(rows, pa.binary()), times], names=["bucket", "slot", "rows", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[int, int], list[tuple]] = {}
        n = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                by.setdefault((row[-2], row[-1] // slot_ms), []).append(row)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield packs(by)
                by, n = {}, 0
        if by:
            yield packs(by)

    return run


def _unpacked(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in pdf["rows"]:
                cols = zip(*pickle.loads(rows), strict=True)
                yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, cols, strict=True)})

    return run


class _InOrder(StatefulProcessor):
    def __init__(self, fold: Fold, key: list[int], order: list[int], given: list[int], slot_ms: int, idle_ms: int | None):
        self.fold, self.key, self.order, self.given = fold, key, order, given
        self.slot_ms, self.idle_ms = slot_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "chunks int")
        self.rows = handle.getMapState("rows", "slot long, chunk int", "packed binary")
        # By key: the end of the slot that it was last seen in, and what is remembered of it.
        self.memory = handle.getValueState("memory", "packed binary, due long")

    def _place(self, row: tuple) -> tuple:
        # Nulls first, as Spark sorts them.
        return tuple((row[i] is not None, row[i]) for i in self.order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Packs are put away by slot, some together."""
        by: dict[int, list[bytes]] = {}
        size = 0
        for row in rows:
            by.setdefault(row[1], []).append(row[2])
            size += len(row[2])
            if size >= CHUNK_BYTES:
                self._put(by)
                by, size = {}, 0
        self._put(by)
        return iter(())

    def _put(self, by: dict[int, list[bytes]]) -> None:
        for slot, packs in by.items():
            old = self.slots.getValue((slot,))
            n = old[0] if old else 0
            self.rows.updateValue((slot, n), (pickle.dumps(packs, 5),))
            self.slots.updateValue((slot,), (n + 1,))
            if not n:
                self.handle.registerTimer((slot + 1) * self.slot_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        slot = at // self.slot_ms - 1
        found = self.slots.getValue((slot,)) if at % self.slot_ms == 0 else None
        held = self.memory.get()
        memory, due = (pickle.loads(held[0]), held[1]) if held else ({}, None)
        if self.idle_ms:
            memory = {k: m for k, m in memory.items() if self._idle_end(m[0]) > at}
        if found:
            rows = []
            for c in range(found[0]):
                for pack in pickle.loads(self.rows.getValue((slot, c))[0]):
                    rows += pickle.loads(pack)
                self.rows.removeKey((slot, c))
            self.slots.removeKey((slot,))
            yield from self._folded(memory, rows, at)
        elif at == due:
            due = None
        if not memory:
            if held:
                self.memory.clear()
            return
        if self.idle_ms and due is None:
            # One timer a bucket, for when it stays quiet; never a slot's end.
            due = self._idle_end(max(m[0] for m in memory.values()))
            self.handle.registerTimer(due)
        self.memory.update((pickle.dumps(memory, 5), due))

    def _folded(self, memory: dict, rows: list[tuple], at: int) -> Iterator[Row]:
        """Folds the rows of a slot key by key, which changes ``memory``; gives packs of results."""
        by: dict[tuple, list[tuple]] = {}
        for row in rows:
            by.setdefault(tuple([row[i] for i in self.key]), []).append(row)
        rows.clear()
        packs, out = Row("rows"), []
        given = itemgetter(*self.given)
        for k in list(by):
            part = by.pop(k)
            part.sort(key=self._place)
            results = self.fold(memory[k][1] if k in memory else None, map(given, part))
            while True:
                try:
                    out.append(tuple(next(results)))
                except StopIteration as end:
                    left = end.value
                    break
                if len(out) >= PACK_ROWS:
                    yield packs(pickle.dumps(out, 5))
                    out = []
            if left is None:
                memory.pop(k, None)
            else:
                memory[k] = at, left
        if out:
            yield packs(pickle.dumps(out, 5))

    def _idle_end(self, at: int) -> int:
        end = at + self.idle_ms
        return end if end % self.slot_ms else end + 1

    def close(self) -> None:
        pass


def in_order(
    stream: DataFrame, key_cols: list[str], at: Column, order_cols: list[str], columns: list[str], fold: Fold, out: dict[str, str], delay: str = "1 minute", slot_s: float = 60.0, idle_s: float | None = None
) -> DataFrame:
    """Rows of an unbounded table, by key, in order of time ``at`` and of ``order_cols``, through ``fold``.

    The fold gets tuples of ``order_cols`` and ``columns``; its results are rows of ``out`` (names and types), and what it remembers
    of a key is a tuple of plain values. Order columns must have no nulls.
    """
    slot_ms = max(2, int(1000 * slot_s))
    sent = list(dict.fromkeys([*key_cols, *order_cols, *columns]))
    place = lambda cols: [sent.index(c) for c in cols]
    bucket = F.pmod(F.xxhash64(*key_cols), F.lit(BUCKETS))
    rows = stream.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(sent)], bucket.alias("__bucket"), F.unix_millis(at).alias("__ms"))
    packs = rows.mapInArrow(_packed(slot_ms), "bucket long, slot long, rows binary, at timestamp").withWatermark("at", delay)
    processor = _InOrder(fold, place(key_cols), place(order_cols), place([*order_cols, *columns]), slot_ms, None if idle_s is None else int(1000 * idle_s))
    done = packs.groupBy("bucket").transformWithState(processor, "rows binary", "Append", "EventTime")
    return done.mapInPandas(_unpacked(list(out)), ", ".join(f"{c} {kind}" for c, kind in out.items()))


def _quota_fold(seconds: float) -> Fold:
    def fold(memory, rows):
        window = deque(memory[0]) if memory else deque()
        for ts, call_id, tenant, quota in rows:
            yield call_id, tenant, ts, admit(window, ts, quota, seconds)
        return (list(window),)

    return fold


def quota_in_order(calls: DataFrame, seconds: float = WINDOW_S, delay: str = "1 minute", slot_s: float = 60.0, idle_s: float | None = None) -> DataFrame:
    """Q3. (call_id, tenant, ts, admitted) of a stream of calls (call_id, tenant, ts in seconds, quota).

    The same calls are admitted as by ``replay_quota``, however batches are cut and rows are ordered within the
    delay. ``idle_s`` (never less than the window) forgets quiet tenants, which changes nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    idle_s = None if idle_s is None else max(idle_s, seconds + slot_s)
    out = {"call_id": kinds["call_id"], "tenant": kinds["tenant"], "ts": "double", "admitted": "boolean"}
    at = F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))
    return in_order(calls, ["tenant"], at, ["ts", "call_id"], ["tenant", "quota"], _quota_fold(seconds), out, delay, slot_s, idle_s)


def _shown(text: str | None, least: int) -> str | None:
    return text if text is not None and len(text) >= least else None


def _change_fold(n_order: int, least: int) -> Fold:
    def fold(memory, rows):
        last = memory[0] if memory else None
        for *row, text in rows:
            text = _shown(text, least)
            if text is not None and text != last:
                yield (*row[n_order:], *row[:n_order], text)
            last = text
        return None if last is None else (last,)

    return fold


def changes_in_order(
    events: DataFrame, node_cols: list[str], at: Column, order_cols: list[str], text_col: str = "text", least: int = 2, delay: str = "1 minute", slot_s: float = 60.0, idle_s: float | None = None
) -> DataFrame:
    """Q4. Text changes of each node, (node, order, text), as ``text_changes`` gives them for a table."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = {c: kinds[c] for c in [*node_cols, *order_cols, text_col]}
    return in_order(events, node_cols, at, order_cols, [*node_cols, text_col], _change_fold(len(order_cols), least), out, delay, slot_s, idle_s)


def _fresh_fold(least: int) -> Fold:
    def fold(memory, rows):
        shown = memory[0] if memory else None
        for _, is_verdict, *row, text in rows:
            if not is_verdict:
                shown = _shown(text, least)
            elif shown is not None and shown == text:
                yield (*row, text)
        return None if shown is None else (shown,)

    return fold


def fresh_verdict_stream(
    texts: DataFrame, verdicts: DataFrame, node_cols: list[str], verdict_cols: list[str], least: int = 2, delay: str = "1 minute", slot_s: float = 60.0, idle_s: float | None = None
) -> DataFrame:
    """Q4, J9. Verdicts (node, ``verdict_cols``, ts, text) whose node still shows that text at their time.

    Two streams meet in one state a node: ``texts`` (node, ts, text) says what is shown from ts on, and a short or
    null text clears the node. A verdict counts if the text shown at its ts, texts of the same ts included, is the
    one it was given for, whether it comes before or after the change in the streams.
    """
    kinds = {f.name: f.dataType.simpleString() for f in verdicts.schema}
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in verdict_cols]
    a = texts.select(*node_cols, "ts", F.lit(0).alias("__verdict"), *none, "text")
    rows = a.unionByName(verdicts.select(*node_cols, "ts", F.lit(1).alias("__verdict"), *verdict_cols, "text")).withColumn("__us", F.unix_micros("ts"))
    cols = [*node_cols, *verdict_cols, "text"]
    return in_order(rows, node_cols, F.col("ts"), ["__us", "__verdict"], cols, _fresh_fold(least), {c: kinds[c] for c in cols}, delay, slot_s, idle_s)
