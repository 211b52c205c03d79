"""Operator 2: language-model scoring with a log-frequency Bloom filter.

Training text is turned into one- and two-word gram counts. A count c has level 1 + floor(log2 c), and
a gram of level q is put into a Bloom filter q times, once with each level 1..q; asking for levels
1, 2, ... until a probe fails gives the quantised count back. The filter is made of one segment for
each range of hash values, so every segment is built by one task from its own grams, with no merging.
Probability of word w after v: ``mixed * c(v, w) / c(v) + (1 - mixed) * (c(w) + 1) / (N + V + 1)``.
Two-word grams count from ``min_pair`` occurrences on.

The filter is never put together. Documents are packed into written chunks of about ``CHUNK_BYTES``; the
distinct grams of each chunk, with their counts in training text, are dealt out by hash range. The task of a
range adds the counts up, builds the segment, probes it for all grams it was sent, and answers each chunk
in the order of the chunk's sorted grams, so answers need no keys. Exact word counts, which the base score
needs, come back with them. Words are told apart by 64-bit hashes, pairs by the range and 40 further bits.

Defined cases: a null text is empty and has one token, the end; the first word follows an end; a null
id counts as the empty string for the fold; repeated rows each get a result and each count in training;
with no training text every count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kernel import mix, pieces, span_hashes, text_buffers, word_bounds
from plumbline.llm.store import keep

END = np.uint64(0x5E17D0CE57A11EAD)
PAIR = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)
BITS_PER_ENTRY, PROBES = 10, 7
#: Bytes of text whose grams are dealt out together, and whose grams go to one range.
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 4 << 20
#: Bytes of a pair's hash that are sent, besides its range.
PAIR_BYTES = 5


def doc_tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with the end of each row, of the token before each, and the first token of each row."""
    s, e, first = word_bounds(buf, offs)
    h = span_hashes(buf, s, e, lower=True)
    n = len(first) - 1
    tokens = np.insert(h, first[1:], END)
    starts = first + np.arange(n + 1)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = END
    return tokens, before, starts


def pair_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * PAIR + tokens)


def levels(c: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), exact for all counts below 2**53."""
    return np.frexp(c.astype(np.float64))[1].astype(np.int64)


def level_values(q: np.ndarray) -> np.ndarray:
    """The middle of the counts that have level q; 0 for level 0."""
    return np.where(q <= 1, q, 1.5 * np.exp2(q - 1.0) - 0.5)


def positions(h: np.ndarray, level: np.ndarray | int, bits: np.ndarray) -> list[np.ndarray]:
    a = mix(h + STEP * np.asarray(level).astype(np.uint64))
    b = mix(a) | np.uint64(1)
    return [((((a + np.uint64(i) * b) >> np.uint64(32)) * bits) >> np.uint64(32)).astype(np.int64) for i in range(PROBES)]


def build_segment(h: np.ndarray, q: np.ndarray) -> bytes:
    """Bits of a Bloom filter that holds each hash with levels 1..q."""
    size = max(8, -(-int(q.sum()) * BITS_PER_ENTRY // 8) * 8)
    marks = np.zeros(size, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for p in positions(h[q >= level], level, np.uint64(size)):
            marks[p] = True
    return np.packbits(marks, bitorder="little").tobytes()


class Filter:
    """All segments side by side; ``level`` probes it."""

    def __init__(self, segments: dict[int, bytes | pa.Buffer], range_bits: int) -> None:
        n = 1 << range_bits
        sizes = np.array([len(segments.get(i, b"\0")) for i in range(n)], np.int64)
        self.shift, self.bits = np.uint64(64 - range_bits), (sizes * 8).astype(np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.data = np.zeros(int(sizes.sum()), np.uint8)
        for i, x in segments.items():
            self.data[self.offsets[i] : self.offsets[i] + sizes[i]] = np.frombuffer(x, np.uint8)

    def level(self, h: np.ndarray, seg: np.ndarray | None = None) -> np.ndarray:
        """Levels of hashes, in the segments of their ranges unless ``seg`` names others."""
        out = np.zeros(len(h), np.int64)
        alive = np.arange(len(h))
        if seg is None:
            seg = (h >> self.shift).astype(np.int64)
        for level in range(1, 64):
            at = h[alive]
            bits, off = self.bits[seg[alive]], self.offsets[seg[alive]]
            there = np.ones(len(alive), bool)
            for p in positions(at, level, bits):
                there &= (self.data[off + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 > 0
            alive = alive[there]
            if not len(alive):
                break
            out[alive] = level
        return out


def slim(x: np.ndarray) -> bytes:
    """Numbers from 0, each in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``slim``."""
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def cut_pairs(h: np.ndarray, range_bits: int) -> np.ndarray:
    """Pair hashes without the bits that are not sent; their order and range stay."""
    unsent = np.uint64(64 - range_bits - 8 * PAIR_BYTES)
    return h >> unsent << unsent


def sent_pairs(h: np.ndarray, range_bits: int) -> bytes:
    low = h << np.uint64(range_bits) >> np.uint64(64 - 8 * PAIR_BYTES)
    return low.view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES].tobytes()


def read_pairs(data: bytes, part: int, range_bits: int) -> np.ndarray:
    out = np.zeros((len(data) // PAIR_BYTES, 8), np.uint8)
    out[:, :PAIR_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, PAIR_BYTES)
    low = out.view(np.uint64).ravel() << np.uint64(64 - range_bits - 8 * PAIR_BYTES)
    return low | np.uint64(part << (64 - range_bits))


def chunked(docs: DataFrame, range_bits: int | None) -> tuple[DataFrame, int]:
    """The kept table (chunk, packed) of all documents, and the bits of the ranges."""

    def pack(batches):
        for batch in batches:
            size = batch.column(batch.num_columns - 1).nbytes
            for i, j, _, offs in pieces(batch.column(batch.num_columns - 1), -(-size // max(1, -(-size // CHUNK_BYTES)))):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([int(offs[-1])]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["size", "packed"])

    chunks = keep(docs.mapInArrow(pack, "size long, packed binary").withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    if range_bits is None:
        size = chunks.agg(F.sum("size")).first()[0] or 0
        range_bits = min(20, max(6, math.ceil(math.log2(size / RANGE_BYTES + 1))))
    return chunks.select("chunk", "packed"), range_bits


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def range_cuts(h: np.ndarray, range_bits: int) -> np.ndarray:
    """Where the ranges of sorted hashes begin; one more at the end."""
    return np.append(np.searchsorted(h, np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits)), len(h))


def range_answers(chunks: DataFrame, range_bits: int, min_pair: int) -> DataFrame:
    """The kept table (chunk, range, wc, wq, pq, n, v): for the sorted words and pairs that a chunk has in a range, the words' exact counts
    and the filter's levels. One row of each range has its numbers of training tokens and of distinct words."""

    def ask(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs = unpack(data.as_py())
                tokens, before, starts = doc_tokens(*text_buffers(docs.column("text")))
                learnt = np.repeat(~docs.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), np.diff(starts))
                sent = []
                for h in (tokens, cut_pairs(pair_hashes(before, tokens), range_bits)):
                    order = np.argsort(h, kind="stable")
                    h = h[order]
                    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    h, c = h[new], np.add.reduceat(learnt[order].astype(np.int64), new)
                    sent.append((h, c, range_cuts(h, range_bits)))
                (wh, wc, wcut), (ph, pc, pcut) = sent
                full = np.flatnonzero((np.diff(wcut) > 0) | (np.diff(pcut) > 0))
                w, p = [slice(wcut[i], wcut[i + 1]) for i in full], [slice(pcut[i], pcut[i + 1]) for i in full]
                kinds = [[wh[x].tobytes() for x in w], [slim(wc[x]) for x in w], [sent_pairs(ph[x], range_bits) for x in p], [slim(pc[x]) for x in p]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([chunk] * len(full), pa.int64()), *[pa.array(x, pa.binary()) for x in kinds]],
                    ["range", "chunk", "wh", "wc", "ph", "pc"],
                )

    def answer(table: pa.Table) -> pa.Table:
        part = table.column("range")[0].as_py()
        wh, ph = [np.frombuffer(x, np.uint64) for x in table.column("wh").to_pylist()], [read_pairs(x, part, range_bits) for x in table.column("ph").to_pylist()]
        found = []
        for hs, cs in ((wh, "wc"), (ph, "pc")):
            u, back = np.unique(np.concatenate(hs), return_inverse=True)
            c = np.concatenate([wide(x, len(h)) for x, h in zip(table.column(cs).to_pylist(), hs, strict=True)])
            # Sums of doubles are exact below 2**53.
            found.append((u, back, np.bincount(back, weights=c, minlength=len(u)).astype(np.int64)))
        (wu, wback, wc), (pu, pback, pc) = found
        known, pairs = wc > 0, pc >= max(1, min_pair)
        filt = Filter({0: build_segment(np.concatenate([wu[known], pu[pairs]]), levels(np.concatenate([wc[known], pc[pairs]])))}, 0)
        wq, pq = (filt.level(u, np.zeros(len(u), np.int64)).astype(np.uint8)[back] for u, back in ((wu, wback), (pu, pback)))
        wcut, pcut = np.cumsum([len(x) for x in wh])[:-1], np.cumsum([len(x) for x in ph])[:-1]
        rows = table.num_rows
        return pa.table({
            "chunk": table.column("chunk"), "range": table.column("range"), "wc": pa.array([slim(x) for x in np.split(wc[wback], wcut)], pa.binary()),
            "wq": pa.array([x.tobytes() for x in np.split(wq, wcut)], pa.binary()), "pq": pa.array([x.tobytes() for x in np.split(pq, pcut)], pa.binary()),
            "n": pa.array([int(wc.sum())] + [0] * (rows - 1), pa.int64()), "v": pa.array([int(known.sum())] + [0] * (rows - 1), pa.int64()),
        })

    asked = chunks.mapInArrow(ask, "range long, chunk long, wh binary, wc binary, ph binary, pc binary")
    return keep(asked.groupBy("range").applyInArrow(answer, "chunk long, range long, wc binary, wq binary, pq binary, n long, v long"), "answers")


def token_log(c1: np.ndarray, c2: np.ndarray, cw: np.ndarray, n: int, v: int, mixed: float) -> np.ndarray:
    """log10 of the smoothed probability, from the counts of history, pair and word."""
    alone = (cw + 1) / (n + v + 1)
    pair = np.minimum(c2, c1) / np.maximum(c1, 1)
    return np.log10(np.where(c1 > 0, mixed * pair + (1 - mixed) * alone, alone))


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_out_fold: int = 2,
    mixed: float = 0.25,
    min_pair: int = 1,
    max_dictionary: int = 1_000_000,
    max_filter_bytes: int = 128 << 20,
    range_bits: int | None = None,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``max_dictionary`` and ``max_filter_bytes`` bounded what was broadcast; nothing is now, and they change nothing.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == held_out_fold
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text.alias("text"))
    chunks, range_bits = chunked(d, range_bits)
    answers = range_answers(chunks, range_bits, min_pair)
    size = answers.agg(F.sum("n"), F.sum("v")).first()
    n, v = size[0] or 0, size[1] or 0

    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        docs = unpack(packed.column("packed")[0].as_py())
        tokens, before, starts = doc_tokens(*text_buffers(docs.column("text")))
        answers = answers.sort_by("range")
        wq, pq = (np.frombuffer(b"".join(answers.column(x).to_pylist()), np.uint8).astype(np.int64) for x in ("wq", "pq"))
        wc = np.concatenate([wide(x, len(q)) for x, q in zip(answers.column("wc").to_pylist(), answers.column("wq").to_pylist(), strict=True)])
        u, back = np.unique(tokens, return_inverse=True)
        pu, pback = np.unique(cut_pairs(pair_hashes(before, tokens), range_bits), return_inverse=True)
        if len(u) != len(wq) or len(u) != len(wc) or len(pu) != len(pq):
            raise ValueError("a chunk's answers don't match its grams")
        cw, c2 = level_values(wq)[back], level_values(pq)[pback]
        history = np.empty(len(tokens))
        history[1:] = cw[:-1]
        history[before == END] = level_values(wq[np.searchsorted(u, END)])
        total = lambda x: np.add.reduceat(x, starts[:-1])
        n_tokens = np.diff(starts)
        base = total(np.log10(wc + 1.0)[back]) - n_tokens * math.log10(n + v + 1)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(total((wc > 0).astype(np.int64)[back])),
            "train_tokens": pa.array(np.full(len(n_tokens), n, np.int64)), "base_score": pa.array(base), "score": pa.array(total(token_log(history, c2, cw, n, v, mixed))),
        })

    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "range", "wc", "wq", "pq").groupBy("chunk")).applyInArrow(score, schema)
