"""Operator 5: line dedup by an exact set-similarity join.

The words of a line are a set. A line is removed if an earlier line (smaller id, then smaller line
number; itself removed or not) has Jaccard similarity of at least ``percent`` hundredths.

Lines with equal sets are folded first; all but the earliest go. For the others a set's words are
ordered by rarity (hashed word counts of the corpus, a table of fixed size), and only its prefix is
dealt out by word: two sets that are similar enough share a word of their prefixes. Rows that share
a word become a candidate pair if their sizes, the word's positions and a parity sketch of the set (which
differs in at most as many bits as the sets differ in words; larger sets have larger ones) allow the similarity; candidates are
verified on the full sets. Rows are numbered by place (id, text hash, line), so a row meets earlier lines only.
Each row first meets only the ``FIRST`` earliest candidates of each word, so
many near copies of a line cost a few comparisons each; rows with more candidates of which none was
confirmed then meet all of theirs. Words of very high count are dealt in pairs of blocks.

Defined cases: lines without a word, null and empty texts are left alone; rows with one id are compared
by text hash and line number like any others; of rows that repeat id and text one is the first, whichever
it is, and the others lose all lines with words; lines of any length are compared whole; an empty table
stays empty. Columns other than the named ones are kept as they are; the three added columns replace columns
of their names, and names that begin with ``__plumbline`` are used inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kernel import mix, pieces, signed, span_hashes, word_bounds
from plumbline.llm.quality_rules import let
from plumbline.llm.store import bytes_at_most, keep, same

BUCKETS, SLICE = 1 << 18, 1 << 12
FIRST = 2
HOT_WORD = 50_000
#: Tables of documents with lines to read or remove are broadcast up to this many bytes, words up to this number.
BROADCAST_BYTES = 16 << 20
BROADCAST_WORDS = 500_000
ADDED = ("line_dedup_lines", "line_dedup_removed", "line_dedup_numbers")
ROW = np.dtype([("word", "<u4"), ("rid", "<i8"), ("n", "<u4"), ("pos", "<u2"), ("bits", "<u8"), ("open", "u1")])
#: Sketch sizes in 64-bit words, for sets of fewer words than given; a sketch folds into a smaller one by xor.
SKETCHES = ((96, 1), (192, 2), (448, 4), (1 << 62, 32))


def sketch_words(n: np.ndarray) -> np.ndarray:
    """How many 64-bit words the parity sketch of a set of ``n`` words has."""
    return np.array([w for _, w in SKETCHES])[np.searchsorted([b for b, _ in SKETCHES], n, "right")]


def wide_sketches(u: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity sketches of the sets too large for 64 bits; empty for the others."""
    out = [b""] * len(at)
    for i in np.flatnonzero(sketch_words(size) > 1):
        bits = int(sketch_words(size[i])) * 64
        odd = np.bincount((u[at[i] : at[i] + size[i]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return out


def folded(rows: np.ndarray, width: np.ndarray, words: np.ndarray) -> dict[int, np.ndarray]:
    """For each larger sketch size, the sketches of all rows that have at least it (zero for the others)."""
    start = np.cumsum(np.where(width > 1, width, 0)) - np.where(width > 1, width, 0)
    out = {}
    for _, size in SKETCHES[1:]:
        if (width >= size).any():
            out[size] = np.zeros((len(rows), size), np.uint64)
            for w in {x for _, x in SKETCHES if x >= size}:
                own = np.flatnonzero(width == w)
                if len(own):
                    full = words[start[own][:, None] + np.arange(w)].reshape(len(own), w // size, size)
                    out[size][own] = np.bitwise_xor.reduce(full, axis=1)
    return out


def line_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines, the first word of each line, and each line's row and number in its row."""
    breaks = np.flatnonzero(buf == 10) + 1
    bounds = np.concatenate([offs[:-1], breaks])
    order = np.argsort(bounds, kind="stable")
    starts = bounds[order]
    row = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, breaks - 1, "right") - 1])[order]
    # A break at the very end of a row begins an empty line of that row, before the next row's first line.
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    s, e, first = word_bounds(buf, np.append(starts, len(buf)))
    return span_hashes(buf, s, e), first, row, number


def by_line(line: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The stable order of lines, then of numbers under 2**40; one number holds both unless a text has 2**24 lines."""
    if len(line) and int(line[-1]) >> 24:
        return np.lexsort((low, line))
    return np.argsort((line << np.uint64(40)) | low, kind="stable")


def line_sets(h: np.ndarray, first: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line, rarest first, and the first of each line."""
    line = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    order = by_line(line, h >> np.uint64(24))
    h, line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[new], line[new]
    if counts is not None:
        c = np.minimum(counts[(h & np.uint64(BUCKETS - 1)).astype(np.int64)], (1 << 40) - 1).astype(np.uint64)
        # Words of one count stay in order of their hashes.
        h = h[by_line(line, c)]
    return h, np.searchsorted(line, np.arange(len(first), dtype=np.uint64))


def word_counts(docs: DataFrame) -> np.ndarray:
    """Hashed word counts over all texts, ``BUCKETS`` numbers; summed by slice on the executors."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buf, offs in pieces(batch.column(0), 1 << 20):
                s, e, _ = word_bounds(buf, offs)
                total += np.bincount((span_hashes(buf, s, e) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        parts = total.reshape(-1, SLICE)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([parts[i].tobytes() for i in full], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"slice": [table.column("slice")[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "slice long, counts binary"
    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(count, kind).groupBy("slice").applyInArrow(add, kind).collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return out


def line_table(docs: DataFrame, shared, percent: int) -> DataFrame:
    """One row a line with words: doc_id, th, line, whether it is its row's first, set hash s1 s2, size n, parity sketches, prefix words packed (32 bits of
    their hashes: rows that share a key by chance are only a needless candidate)."""

    def rows(batches):
        for batch in batches:
            for i, _, buf, offs in pieces(batch.column(2), 1 << 20):
                h, first, row, number = line_words(buf, offs)
                u, start = line_sets(h, first, shared.value)
                n = np.diff(start)
                full = np.flatnonzero(n)
                at = start[:-1][full]
                size = n[full]
                prefix = size - -(-size * percent // 100) + 1
                ends = np.concatenate([[0], np.cumsum(prefix)])
                take = np.arange(ends[-1]) + np.repeat(at - ends[:-1], prefix)
                s1 = np.add.reduceat(mix(u), at) if len(at) else u[:0]
                s2 = np.bitwise_xor.reduceat(mix(u + np.uint64(77)), at) if len(at) else u[:0]
                bits = np.bitwise_xor.reduceat(np.uint64(1) << (u & np.uint64(63)), at) if len(at) else u[:0]
                where = pa.array(row[full] + i)
                keys = (u[take] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                head = np.diff(row[full], prepend=-1) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), pa.array(number[full].astype(np.int32)), pa.array(head), pa.array(signed(s1)), pa.array(signed(s2)), pa.array(size.astype(np.int32)), pa.array(signed(bits)),
                     pa.array(wide_sketches(u, at, size), pa.binary()), pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(keys)])],
                    ["doc_id", "th", "line", "head", "s1", "s2", "n", "bits", "wide", "prefix"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc_id {kind}, th long, line int, head boolean, s1 long, s2 long, n int, bits long, wide binary, prefix binary")


def prefix_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed words of all rows, and where each row's begin; one more at the end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(np.uint32), (ends - ends[0]) // 4


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def similar_sketches(n: np.ndarray, bits: np.ndarray, wide: dict[int, np.ndarray], width: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The numbers of the pairs of rows x, y whose sketches allow the similarity: at most (100 - p) (n_x + n_y) / (100 + p) words differ."""
    slack = (100 - percent) * (n[x] + n[y])
    ok = np.flatnonzero((100 + percent) * bit_count(bits[x] ^ bits[y]) <= slack)
    for size, sketch in wide.items():
        there = (width[x[ok]] >= size) & (width[y[ok]] >= size)
        some = ok[there]
        if len(some):
            there[there] = (100 + percent) * bit_count(sketch[x[some]] ^ sketch[y[some]]).sum(axis=1) > slack[some]
            ok = ok[~there]
    return ok


def candidate_pairs(sets: DataFrame, shared, percent: int, range_bits: int, every: bool, wanted=None) -> DataFrame:
    """(b, a, more): rows that share a prefix word and may be similar, a before b (rids are in order of place).

    With ``every`` all earlier candidates of rows b marked open are given, else the ``FIRST`` of each row
    and word; ``more`` says that b has others. ``wanted`` may hold the only words to deal out.
    """

    def deal(batches):
        only = wanted.value if wanted is not None else None
        for batch in batches:
            rid, n, bits, opened = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 5))
            w, ends = prefix_words(batch.column(4))
            at = np.repeat(np.arange(len(rid)), np.diff(ends))
            pos = np.arange(len(w)) - ends[:-1][at]
            if only is not None:
                some = np.flatnonzero(np.isin(w, only))
                w, at, pos = w[some], at[some], pos[some]
            blocks = 1 + shared.value[w & np.uint32(BUCKETS - 1)] // HOT_WORD
            own = (mix(rid[at].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            copies = np.repeat(np.arange(len(w)), blocks)
            other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            lo, hi = np.minimum(own[copies], other), np.maximum(own[copies], other)
            key = mix(w[copies].astype(np.uint64) + (lo.astype(np.uint64) << np.uint64(32)) + (hi.astype(np.uint64) << np.uint64(48)))
            part = (key >> np.uint64(64 - range_bits)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, part = at[copies][order], part[order]
            rows = np.empty(len(at), ROW)
            rows["word"] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
            rows["rid"], rows["n"], rows["bits"], rows["open"] = rid[at], n[at], bits[at].view(np.uint64), opened[at]
            rows["pos"] = np.minimum(pos[copies][order], 0xFFFF)
            wide = batch.column(3).to_pylist()
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            stop = np.append(cut[1:], len(part))[: len(cut)]
            large = np.flatnonzero(np.array([len(x) > 0 for x in wide], bool)[at])
            sketches = [b"".join(wide[k] for k in at[large[a:b]]) for a, b in zip(np.searchsorted(large, cut), np.searchsorted(large, stop), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cut]), pa.array([rows[a:b].tobytes() for a, b in zip(cut, stop, strict=True)], pa.binary()), pa.array(sketches, pa.binary())],
                ["range", "rows", "wide"],
            )

    def pair(table: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(table.column("rows").to_pylist()), ROW)
        width = sketch_words(r["n"])
        wide = folded(r, width, np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64))
        # Sets of sizes that can be similar lie in one class of sizes or in neighbouring ones.
        size_class = np.floor(np.log(r["n"]) / np.log(max(1.001, 100.0001 / percent))).astype(np.uint64)
        key = (r["word"].astype(np.uint64) << np.uint64(16)) | (size_class + np.uint64(1))
        # Groups of one key and the rows' ranks by rid, as one ascending number: it finds the earlier rows of any group.
        keys, group = np.unique(key, return_inverse=True)
        rids, rank = np.unique(r["rid"], return_inverse=True)
        place = group * len(rids) + rank
        order = np.argsort(place, kind="stable")
        r, key, width, wide = r[order], key[order], width[order], {k: v[order] for k, v in wide.items()}
        group, rank, place = group[order], rank[order], place[order]
        n, bits = r["n"].astype(np.int64), np.ascontiguousarray(r["bits"])
        # Of rows x, y with a common word, p (n_x + n_y) / (100 + p) words must be common, and at most the rest of each set from that word on can be;
        # times (100 + p) that is room_x >= cost_y and room_y >= cost_x. As no rest is larger than its set, it holds for sizes in proportion only.
        cost = percent * n
        room = (100 + percent) * (n - r["pos"]) - cost
        found = np.zeros(len(r), np.int64)
        last = np.full(len(r), -1, np.int64)
        a, b = [], []
        asked = r["open"] > 0 if every else np.ones(len(r), bool)
        for step in (0, -1, 1):
            near = key + np.int64(step).astype(np.uint64)
            other = np.minimum(np.searchsorted(keys, near), len(keys) - 1)
            begin = np.searchsorted(place, other * len(rids))
            stop = np.where(keys[other] == near, np.searchsorted(place, other * len(rids) + rank), 0)
            # Step d compares each row with the d-th of the span; rows with long spans are first, and rows are dropped once they have enough.
            alive = np.flatnonzero((begin < stop) & asked & (every | (found <= FIRST)))
            alive = alive[np.argsort(begin[alive] - stop[alive], kind="stable")]
            x, y_room, y_cost, d = begin[alive], room[alive], cost[alive], 0
            shorter = begin[alive] - stop[alive]
            while len(alive):
                near_by = np.flatnonzero((room[x] >= y_cost) & (y_room >= cost[x]))
                src, hit = x[near_by], alive[near_by]
                ok = similar_sketches(n, bits, wide, width, src, hit, percent)
                src, hit = src[ok], hit[ok]
                d += 1
                left = int(np.searchsorted(shorter, -d))
                stay = slice(0, left)
                if len(hit):
                    free = np.ones(len(hit), bool) if every else found[hit] < FIRST
                    a.append(src[free])
                    b.append(hit[free])
                    last[hit[~free]] = 1
                    found[hit] += 1
                    if not every and not free.all():
                        stay = np.flatnonzero(found[alive[:left]] <= FIRST)
                alive, x, y_room, y_cost, shorter = alive[stay], x[stay] + 1, y_room[stay], y_cost[stay], shorter[stay]
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"b": r["rid"][b], "a": r["rid"][a], "more": last[b] > 0})

    packed = sets.select("rid", "n", "bits", "wide", "prefix", "open").mapInArrow(deal, "range long, rows binary, wide binary")
    pairs = packed.groupBy("range").applyInArrow(pair, "b long, a long, more boolean")
    return pairs.groupBy("b", "a").agg(F.max("more").alias("more"))


def confirmed_lines(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Adds to (b, a) whether the full word sets reach the similarity: column ``ok``."""
    rids = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    needed = sets.join(rids, "rid", "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "rid")).alias("wanted"))
    needed = keep(needed, "wanted")
    small = bytes_at_most(needed, 48 + 24 * F.size("wanted"), BROADCAST_BYTES)
    d, w = docs.alias("d"), (F.broadcast(needed) if small else needed).alias("w")
    texts = d.join(w, same(F.col("d.doc_id"), F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))).select("d.text", "w.wanted")

    def items(batches):
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for i, j, buf, offs in pieces(batch.column(0), 1 << 20):
                h, first, row, _ = line_words(buf, offs)
                u, start = line_sets(h, first, None)
                base = np.searchsorted(row, np.arange(j - i))
                rid, out = [], []
                for q in range(i, j):
                    for x in wanted[q]:
                        at = base[q - i] + x["line"]
                        rid.append(x["rid"])
                        out.append(u[start[at] : start[at + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(out, pa.binary())], ["rid", "items"])

    def verify(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(p) + len(q) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["b", "a", "ok"])

    got = texts.mapInArrow(items, "rid long, items binary").dropDuplicates(["rid"])
    x, y = got.select(F.col("rid").alias("b"), F.col("items").alias("x")), got.select(F.col("rid").alias("a"), F.col("items").alias("y"))
    return pairs.select("b", "a").join(x, "b").join(y, "a").select("b", "a", "x", "y").mapInArrow(verify, "b long, a long, ok boolean")


def removed_sets(sets: DataFrame, docs: DataFrame, shared, percent: int, range_bits: int) -> DataFrame:
    """(rid) of the sets whose earliest line has an earlier line that is similar."""

    def later(pairs: DataFrame) -> DataFrame:
        return keep(confirmed_lines(pairs, sets, docs, percent).where("ok"), "similar").select(F.col("b").alias("rid")).distinct()

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(prefix_words(batch.column(0))[0]).view(np.int32))], ["w"])

    pairs = keep(candidate_pairs(sets.withColumn("open", F.lit(0).cast("byte")), shared, percent, range_bits, False), "candidates")
    gone = keep(later(pairs), "gone")
    # Rows that had more candidates than were tried, and are still there, meet all of them: all of these are earlier rows.
    rest = keep(pairs.where("more").select(F.col("b").alias("rid")).distinct().join(gone, "rid", "left_anti"), "rest")
    if rest.count():
        marked = sets.join(rest.withColumn("o", F.lit(1)), "rid", "left").withColumn("open", F.coalesce("o", F.lit(0)).cast("byte"))
        # Only their words matter then; the list is sent to the tasks if it is short.
        words_ = sets.join(rest, "rid", "left_semi").select("prefix").mapInArrow(each, "w int").distinct().limit(BROADCAST_WORDS + 1).toArrow()["w"].to_numpy()
        few = docs.sparkSession.sparkContext.broadcast(words_.astype(np.int32).view(np.uint32)) if len(words_) <= BROADCAST_WORDS else None
        every = keep(candidate_pairs(marked, shared, percent, range_bits, True, few).join(pairs, ["b", "a"], "left_anti"), "candidates2")
        gone = gone.union(later(every)).distinct()
    return gone


def with_copies(named: DataFrame, lines: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``named`` with __plumbline_copy (0 for one row of each id and text, 1 for further ones), and the kept table
    (doc_id, th) of the ids and texts that repeat."""
    again = lines.where("head").groupBy("doc_id", "th").agg(F.count("*").alias("rows")).where("rows > 1")
    again = keep(again.select("doc_id", "th"), "again")
    n_again = again.count()
    if not n_again:
        return named.withColumn("__plumbline_copy", F.lit(0)), again
    n, a = named.alias("n"), (F.broadcast(again) if 24 * n_again <= BROADCAST_BYTES else again).alias("a")
    cond = same(F.col(f"n.{id_col}"), F.col("a.doc_id")) & (F.col("n.__plumbline_th") == F.col("a.th"))
    # The rows are written with their numbers, so that the choice of the first one holds.
    repeats = keep(n.join(a, cond, "left_semi").withColumn("__plumbline_row", F.monotonically_increasing_id()), "repeats")
    first = keep(repeats.groupBy(id_col, "__plumbline_th").agg(F.min("__plumbline_row").alias("__plumbline_row")).select("__plumbline_row"), "first_rows")
    first = F.broadcast(first) if 24 * n_again <= BROADCAST_BYTES else first
    marked = repeats.join(first.withColumn("__plumbline_copy", F.lit(0)), "__plumbline_row", "left").withColumn("__plumbline_copy", F.coalesce("__plumbline_copy", F.lit(1)))
    return n.join(a, cond, "left_anti").withColumn("__plumbline_copy", F.lit(0)).unionByName(marked.drop("__plumbline_row")), again


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, range_bits: int | None = None) -> DataFrame:
    """``docs`` with the later of similar lines taken out of the text, and three columns:
    line_dedup_lines (lines with words), line_dedup_removed (how many went), line_dedup_numbers (which)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
    named = docs.withColumn("__plumbline_th", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    d = named.select(F.col(id_col).alias("doc_id"), F.col("__plumbline_th").alias("th"), F.col(text_col).cast("string").alias("text"))
    if range_bits is None:
        range_bits = min(20, max(6, int(np.ceil(np.log2(max(1, docs.count()) / 512 + 1)))))
    shared = docs.sparkSession.sparkContext.broadcast(word_counts(d))
    lines = keep(line_table(d, shared, percent), "lines")
    first = F.min(F.struct("doc_id", "th", "line", "n", "bits", "wide", "prefix")).alias("x")
    sets = lines.groupBy("s1", "s2").agg(first, F.count("*").alias("copies")).select("x.*", "s1", "s2", "copies")
    # In order of place, so that a smaller rid is an earlier line.
    sets = keep(sets.orderBy("doc_id", "th", "line").withColumn("rid", F.monotonically_increasing_id()), "sets")
    gone = removed_sets(sets, d, shared, percent, range_bits)
    touched = sets.join(gone.withColumn("gone", F.lit(True)), "rid", "left").where("copies > 1 or gone")
    touched = touched.select("s1", "s2", F.struct("doc_id", "th", "line").alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    numbers = F.array_sort(F.collect_set("line")).alias("numbers")
    # The lines of all rows of the first place share its fate; further rows of a place lose theirs anyway.
    elsewhere = ~same(F.struct("doc_id", "th", "line"), F.col("first"))
    out = lines.select("doc_id", "th", "line", "s1", "s2").join(touched, ["s1", "s2"]).where(F.col("gone") | elsewhere)
    per_doc = out.groupBy("doc_id", "th").agg(numbers).withColumn("copy", F.lit(0))
    named, again = with_copies(named, lines, id_col)
    if again.count():
        x, y = lines.alias("x"), again.alias("y")
        every = x.join(y, same(F.col("x.doc_id"), F.col("y.doc_id")) & (F.col("x.th") == F.col("y.th")), "left_semi")
        per_doc = per_doc.unionByName(every.groupBy("doc_id", "th").agg(numbers).withColumn("copy", F.lit(1)))
    per_doc = keep(per_doc, "removed")
    small = bytes_at_most(per_doc, 48 + 4 * F.size("numbers"), BROADCAST_BYTES)
    n, r = named.alias("n"), (F.broadcast(per_doc) if small else per_doc).alias("r")
    both = n.join(r, same(F.col(f"n.{id_col}"), F.col("r.doc_id")) & (F.col("n.__plumbline_th") == F.col("r.th")) & (F.col("n.__plumbline_copy") == F.col("r.copy")), "left")
    text = F.col(f"n.{text_col}")
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.transform("r.numbers", lambda x: x.cast("int")))
    cut = let(F.split(text, "\n"), lambda parts: F.array_join(F.transform(stay(parts), lambda i: F.get(parts, i)), "\n"))
    new_text = F.when(F.col("r.numbers").isNull(), text).otherwise(cut).alias(text_col)
    n_lines = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: (F.ascii(x) > 32) | (F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)))
    return both.select(
        *[new_text if c == text_col else F.col(f"n.`{c}`") for c in docs.columns],
        n_lines.cast("long").alias("line_dedup_lines"),
        F.coalesce(F.size("r.numbers"), F.lit(0)).cast("long").alias("line_dedup_removed"),
        F.coalesce(F.array_join(F.transform("r.numbers", lambda x: x.cast("string")), ","), F.lit("")).alias("line_dedup_numbers"),
    )
