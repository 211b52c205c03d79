"""Operator 6: removal of repeated word passages with an FM-index for each shard.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it has
the same words as a window that starts anywhere else.

Equal windows have equal minimizers (the smallest hash of the runs of ``GRAM`` words in them), so
windows are dealt out by minimizer: a segment is a run of neighbouring windows with one minimizer, at
most 2 * window words long. Only segments whose minimizer is found in another segment can repeat, and
equal segments are folded into one with a weight, so a passage copied any number of times is one
sequence. The remaining sequences are gathered in shards of bounded size; each shard builds an
FM-index of its sequences with their weights, streams them through it by backward search, and reports
the runs of at least ``window`` words that occur twice.

A minimizer whose different segments have more than ``SHARD_WORDS`` words together is dealt out again,
before any index is built: its segments are cut by a second minimizer, under another order of the runs,
pieces that are equal are folded, and minimizer pairs take the place of minimizers; so on for ``LEVELS``
levels. What is still too large then is cut into single windows, dealt out by their own hash. So no shard
grows with a frequent phrase, and all windows are searched in an index.

Defined cases: null texts and texts shorter than a window lose nothing; repeated rows are each other's
copies; texts of any length are read whole, very long ones ``LONG`` windows at a time; ties between runs of
one hash go to the first; an empty table gives an empty result; only the two named columns are read, and
the result has doc_id, n_words, n_removed, kept_sha256 and kept_text, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.fm_index import FMIndex
from plumbline.llm.kernel import grams, mix, pieces, sequence_hashes, signed, span_hashes, text_buffers, word_bounds
from plumbline.llm.store import keep, same

GRAM = 8
SHARD_WORDS = 400_000
LEVELS = 4
#: Windows of one text whose minimizers are found at a time; below 2**24, as a place has 24 bits.
LONG = 1 << 22
#: Documents with removed words, or wanted segments, are broadcast up to this many bytes of spans.
BROADCAST_BYTES = 48 << 20


def window_minimizers(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its first word, the place of its minimizer, and the minimizer's hash."""
    if len(h) - window >= LONG:
        # Stretches that overlap by all but one word of a window.
        parts = []
        for a in range(0, len(h) - window + 1, LONG):
            b = min(len(h), a + LONG + window - 1)
            edges = np.unique(np.concatenate([[0, b - a], np.clip(first, a, b) - a]))
            start, place, m = _stretch_minimizers(h[a:b], edges, window, gram)
            parts.append((start + a, place + (a // LONG << 40), m))  # places of two stretches are never the same
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _stretch_minimizers(h, first, window, gram)


def _stretch_minimizers(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g, _, row_first = grams(h, first, gram)
    wide = window - gram + 1
    counts = np.maximum(np.diff(first) - window + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    if not ends[-1]:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    v = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(g), dtype=np.uint64)
    low, size = v, 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(v) - wide + 1], low[wide - size :])
    in_row = np.arange(ends[-1]) - np.repeat(ends[:-1], counts)
    start = in_row + np.repeat(first[:-1], counts)
    place = (low[in_row + np.repeat(row_first[:-1], counts)] & np.uint64(0xFFFFFF)).astype(np.int64)
    return start, place, g[place]


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(m, c, doc_id, th, start, n): minimizer, hash of the words, place and length of every segment."""

    def rows(batches):
        for batch in batches:
            for i, j, buf, offs in pieces(batch.column(2), 1 << 20):
                s, e, first = word_bounds(buf, offs)
                h = span_hashes(buf, s, e)
                start, place, m = window_minimizers(h, first, window, gram)
                row = np.searchsorted(first, start, "right") - 1
                new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])) if len(start) else np.zeros(0, np.int64)
                last = np.append(new[1:], len(start)) - 1
                a, b = start[new], (start[last] + window if len(new) else start[new])
                at = pa.array(row[new] + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(m[new])), pa.array(signed(sequence_hashes(h, a, b, 2))), batch.column(0).take(at), batch.column(1).take(at), pa.array((a - first[row[new]]).astype(np.int32)), pa.array((b - a).astype(np.int32))],
                    ["m", "c", "doc_id", "th", "start", "n"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"m long, c long, doc_id {kind}, th long, start int, n int")


def with_spans(docs: DataFrame, spans: DataFrame, n_bytes: int, how: str) -> DataFrame:
    """``docs`` joined with one packed row a document; broadcast only if its bytes are few."""
    s = F.broadcast(spans) if n_bytes <= BROADCAST_BYTES else spans
    d, s = docs.alias("d"), s.alias("s")
    return d.join(s, same(F.col("d.doc_id"), F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")), how).select("d.doc_id", "d.th", "d.text", "s.spans")


def sequences(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(m, c, copies, words): the word codes of each distinct segment, read at its first place."""
    wanted = distinct.groupBy("p.doc_id", "p.th").agg(F.collect_list(F.struct("m", "c", "copies", F.col("p.start").alias("start"), F.col("p.n").alias("n"))).alias("spans"))
    wanted = keep(wanted, "wanted")
    n_bytes = 40 * (wanted.agg(F.sum(F.size("spans"))).first()[0] or 0)

    def rows(batches):
        for batch in batches:
            spans = batch.column(1)
            for i, j, buf, offs in pieces(batch.column(0), 1 << 20):
                s, e, first = word_bounds(buf, offs)
                h = (span_hashes(buf, s, e) >> np.uint64(32)).astype(np.uint32)
                part = spans.slice(i, j - i)
                flat = part.flatten()
                each = np.diff(np.asarray(part.offsets))
                at = np.repeat(first[:-1], each) + flat.field("start").to_numpy()
                n = flat.field("n").to_numpy()
                words = [h[a : a + k].tobytes() for a, k in zip(at, n, strict=True)]
                yield pa.RecordBatch.from_arrays([flat.field("m"), flat.field("c"), flat.field("copies"), pa.array(words, pa.binary())], ["m", "c", "copies", "words"])

    return with_spans(docs, wanted, n_bytes, "inner").select("text", "spans").mapInArrow(rows, "m long, c long, copies long, words binary")


def repeated_runs(seqs: DataFrame, n_shards: int, window: int) -> DataFrame:
    """(m, c, lo, hi): runs of each sequence that occur elsewhere, by one FM-index for each shard."""

    def search(table: pa.Table) -> pa.Table:
        # Different minimizers of a shard share no window, so one index serves them all.
        parts = table.column("words").to_pylist()
        n = np.array([len(x) // 4 for x in parts], np.int64)
        copies = table.column("copies").to_numpy()
        m, c = table.column("m").to_numpy(), table.column("c").to_numpy()
        index = FMIndex(np.frombuffer(b"".join(parts), np.uint32), np.concatenate([[0], np.cumsum(n)]), copies)
        runs = index.repeated(np.arange(len(n)), window)
        seq, lo, hi = (np.array([r[k] for r in runs], np.int64) for k in range(3))
        return pa.table({"m": m[seq], "c": c[seq], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    shard = F.pmod(F.xxhash64("m"), F.lit(n_shards)).cast("int").alias("shard")
    return seqs.withColumn("shard", shard).groupBy("shard").applyInArrow(search, "m long, c long, lo int, hi int")


def finer(seqs: DataFrame, window: int, gram: int, level: int) -> DataFrame:
    """(m, c, copies, lo, m2, c2, words): the sequences' pieces by one more minimizer, or their single windows."""

    def rows(batches):
        salt = np.uint64(2 * level + 1) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            parts = batch.column(3).to_pylist()
            step = max(1, (1 << 20) // max(1, max(map(len, parts), default=1)))
            for i in range(0, len(parts), step):
                first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts[i : i + step]])])
                codes = np.frombuffer(b"".join(parts[i : i + step]), np.uint32)
                h = mix(codes.astype(np.uint64) ^ salt)
                if level < LEVELS:
                    start, place, m2 = window_minimizers(h, first, window, gram)
                else:
                    counts = np.maximum(np.diff(first) - window + 1, 0)
                    start = np.concatenate([np.arange(a, a + n) for a, n in zip(first[:-1], counts, strict=True)]) if counts.sum() else np.zeros(0, np.int64)
                    place, m2 = start, sequence_hashes(h, start, start + window, 3)
                row = np.searchsorted(first, start, "right") - 1
                new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])) if len(start) else np.zeros(0, np.int64)
                last = np.append(new[1:], len(start)) - 1
                a, b = start[new], (start[last] + window if len(new) else start[new])
                at = pa.array(row[new] + i)
                m = batch.column(0).take(at)
                m2 = mix(m.to_numpy().view(np.uint64) ^ m2[new])
                words = [codes[x:y].tobytes() for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [m, batch.column(1).take(at), batch.column(2).take(at), pa.array((a - first[row[new]]).astype(np.int32)), pa.array(signed(m2)), pa.array(signed(sequence_hashes(h, a, b, 2))), pa.array(words, pa.binary())],
                    ["m", "c", "copies", "lo", "m2", "c2", "words"],
                )

    return seqs.select("m", "c", "copies", "words").mapInArrow(rows, "m long, c long, copies long, lo int, m2 long, c2 long, words binary")


def indexed_runs(seqs: DataFrame, window: int, gram: int, level: int = 0) -> DataFrame:
    """(m, c, lo, hi): the repeated runs of written sequences (m, c, copies, words)."""
    per = seqs.groupBy("m").agg(F.sum(F.length("words") / 4).alias("n"))
    hot = keep(per.where(F.col("n") > SHARD_WORDS).select("m"), "hot") if level <= LEVELS else None
    if hot is None or hot.isEmpty():
        rest, split = seqs, None
    else:
        rest = seqs.join(hot, "m", "left_anti")
        split = keep(finer(seqs.join(hot, "m", "left_semi"), window, gram, level), "pieces")
    total = rest.agg(F.sum(F.length("words"))).first()[0] or 0
    runs = repeated_runs(rest, max(1, -(-total // 4 * 2 // SHARD_WORDS)), window)
    if split is None:
        return runs
    pieces = split.groupBy(F.col("m2").alias("m"), F.col("c2").alias("c")).agg(F.sum("copies").alias("copies"), F.first("words").alias("words"))
    inner = keep(indexed_runs(keep(pieces, "different"), window, gram, level + 1), "inner").select(F.col("m").alias("m2"), F.col("c").alias("c2"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    inner = split.select("m", "c", "lo", "m2", "c2").join(inner, ["m2", "c2"])
    return runs.unionByName(inner.select("m", "c", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi")))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Some words of a text, joined by one space."""
    if not len(starts):
        return b""
    spaced = np.append(buf, np.uint8(32))
    spaced[ends] = 32
    edge = np.zeros(len(spaced) + 1, np.int8)
    edge[starts] += 1
    edge[ends + 1] -= 1  # a word's end is a gap, so the next word begins there at the earliest
    return spaced[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()[:-1]


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, spans): packed, merged word spans of each document that lie in repeated windows."""
    gram = min(GRAM, window)
    segs = keep(segments(docs, window, gram), "segments")
    # Written, so that the join may split a frequent minimizer's segments over several tasks.
    shared = keep(segs.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m"), "minimizers")
    cand = keep(segs.join(shared, "m"), "shared")
    distinct = keep(cand.groupBy("m", "c").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "start", "n")).alias("p")), "distinct")
    runs = keep(indexed_runs(keep(sequences(docs, distinct), "sequences"), window, gram), "runs")
    found = cand.join(runs, ["m", "c"]).select("doc_id", "th", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    per_doc = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def pack(batches):
        for batch in batches:
            out = [np.array(merged(x), np.int64).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "th", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keep(per_doc.mapInArrow(pack, f"doc_id {kind}, th long, spans binary"), "spans")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = repeated_spans(d, window)
    n_bytes = spans.agg(F.sum(F.length("spans") + 48)).first()[0] or 0

    def rows(batches):
        for batch in batches:
            n, gone, sha, kept = [], [], [], []
            for k in range(batch.num_rows):
                buf, offs = text_buffers(batch.column(2).slice(k, 1))
                s, e, _ = word_bounds(buf, offs)
                stay = np.ones(len(s), bool)
                x = batch.column(3)[k]
                for lo, hi in np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) if x.is_valid else ():
                    stay[lo:hi] = False
                n.append(len(s))
                gone.append(len(s) - int(stay.sum()))
                kept.append(joined(buf, s[stay], e[stay]))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return with_spans(d, spans, n_bytes, "left").mapInArrow(rows, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
