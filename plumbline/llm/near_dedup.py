"""Operator 8: MinHash near-duplicate groups, confirmed on full shingle sets.

1. One pass gives each document its shingle-set hash, the minima of ``bands * rows`` universal hash
   functions and one hash for each band. Equal sets are folded into their smallest id first.
2. Sets that share a band form a bucket; only buckets of several sets go on. Each set first meets two sets
   only: of its buckets' smallest ids, and of their smallest hashed ids, the one it shares most bands with.
   Pairs whose signatures agree are confirmed by the exact Jaccard similarity of the full sets, and
   components of these links are found.
3. Buckets that hold several components are then compared across components, so no link is lost. Their
   sets travel with signature and shingle codes to blocks of bounded size: the sets of the bucket's
   largest component once each, the others once for each of its blocks. Inside a block the signatures are
   compared, then the sets, and only links between components are given out, one for each two components;
   they are confirmed on the full sets again, as codes have 32 bits. No list of candidate pairs is made.
4. Components come from alternating large-star and small-star.

The signature check is loose (four standard deviations below the threshold). A pair at similarity 0.8
shares no band with probability (1 - 0.8**4)**24, about 3 in a million.

Defined cases: documents with fewer words than a shingle have their whole sequence as one; null or
empty texts have an empty set and are linked with nothing; a null id is linked with nothing and kept;
ids are integers; rows that repeat an id are one document for links and each get a row; ties go to the
smallest id; an empty table gives an empty result; only the two named columns are read, and the result has
just doc_id, n_shingles, component_id and kept, so other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.kernel import grams, mix, pieces, sequence_hashes, signed, span_hashes, word_bounds
from plumbline.llm.store import keep, rows_at_most

BANDS, ROWS = 24, 4
#: Tables of at most three longs a row are broadcast up to this number of rows.
BROADCAST_ROWS = 200_000
#: Ids of documents whose sets are read again are broadcast up to this number (8 bytes each).
BROADCAST_IDS = 1_000_000
#: The sets of a block have about this many shingles together; a set counts for ``LEAST`` at least.
BLOCK_SHINGLES, LEAST = 500_000, 250
_rng = np.random.default_rng(81)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(np.uint64)
#: How a set takes part in a block: sets of one side are not compared there, unless the side is ``BOTH``.
MAIN, BOTH, ASIDE, LOW, HIGH = range(5)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the first of each row."""
    s, e, first = word_bounds(buf, offs)
    h = span_hashes(buf, s, e, lower=True)
    g, _, row_first = grams(h, first, k)
    short = np.flatnonzero((np.diff(first) < k) & (np.diff(first) > 0))
    alone = dict(zip(short.tolist(), sequence_hashes(h, first[short], first[short + 1]), strict=True))
    out, sizes = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        u = np.unique(g[row_first[i] : row_first[i + 1]]) if i not in alone else np.array([alone[i]], np.uint64)
        sizes[i] = len(u)
        out.append(u)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def min_hashes(u: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets that are not empty: eight bits of each of their minima, and the hash of each band."""
    minima = np.zeros((len(starts), BANDS * ROWS), np.uint64)
    band = np.zeros((len(starts), BANDS), np.uint64)
    if len(starts):
        for f in range(BANDS * ROWS):
            minima[:, f] = np.minimum.reduceat((u * _A[f] + _B[f]) >> np.uint64(32), starts)
    for b in range(BANDS):
        x = np.full(len(starts), b, np.uint64)
        for r in range(ROWS):
            x = mix(x * _A[1] + minima[:, b * ROWS + r])
        band[:, b] = x
    return (minima & np.uint64(255)).astype(np.uint8), band


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, s1, s2 (set hash), sig (eight bits of each minimum) and bands of every row."""

    def rows(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, offs in pieces(batch.column(1), 1 << 20):
                u, first = shingle_sets(buf, offs, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                starts = first[full]
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(full):
                    s1[full] = np.add.reduceat(mix(u), starts)
                    s2[full] = np.bitwise_xor.reduceat(mix(u + _A[0]), starts)
                low, band = min_hashes(u, starts)
                sigs = [b""] * len(n)
                for q, at in enumerate(full):
                    sigs[at] = low[q].tobytes()
                ends = np.zeros(len(n) + 1, np.int32)
                ends[1:] = np.cumsum((n > 0) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(band.ravel())))],
                    ["doc_id", "n", "s1", "s2", "sig", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc_id {kind}, n long, s1 long, s2 long, sig binary, bands array<long>")


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the eight-bit minima of two signatures differ; the last axis holds 64-bit words."""
    d = x ^ y
    d |= d >> np.uint64(4)
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return np.bitwise_count(d & np.uint64(0x0101010101010101)).sum(axis=-1, dtype=np.int32)


def loose_bound(percent: int) -> float:
    """The most differing minima of a pair at the threshold, four standard deviations allowed."""
    t = percent / 100
    t += (1 - t) / 256  # eight bits of different minima agree by chance
    return BANDS * ROWS * (1 - t + 4 * (t * (1 - t) / (BANDS * ROWS)) ** 0.5)


def fixed_width(column: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` numbers, as a matrix over Arrow's own buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype)
    size = width * np.dtype(dtype).itemsize
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + size * len(column)].view(dtype).reshape(-1, width)


def first_candidates(members: DataFrame) -> DataFrame:
    """(a, b): each set with at most two others, of its buckets' smallest ids and smallest hashed ids
    that with which it shares most buckets."""
    met = members.select("rep", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("p")) for i, c in enumerate(("low", "other"))])).alias("m"))
    shared = met.where("m.p <> rep").groupBy("rep", "m.kind", "m.p").agg(F.count("*").alias("c"))
    best = shared.groupBy("rep", "kind").agg(F.max(F.struct("c", (-F.col("p")).alias("p"))).alias("x"))
    p = -F.col("x.p")
    return best.select(F.least("rep", p).alias("a"), F.greatest("rep", p).alias("b")).distinct()


def agreeing(pairs: DataFrame, reps: DataFrame, most: float) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most ``most`` minima."""

    def check(batches):
        for batch in batches:
            x, y = (fixed_width(batch.column(i), np.uint64, BANDS * ROWS // 8) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(differing(x, y) <= most))

    x, y = reps.select(F.col("rep").alias("a"), F.col("sig").alias("x")), reps.select(F.col("rep").alias("b"), F.col("sig").alias("y"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, f"a {kind}, b {kind}").distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in the kept table ``ids``."""
    return docs.join(F.broadcast(ids) if rows_at_most(ids, BROADCAST_IDS) else ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; ``pairs`` is kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    wanted = texts_of(docs, ids)

    def sets(batches):
        for batch in batches:
            for i, j, buf, offs in pieces(batch.column(1), 1 << 20):
                u, first = shingle_sets(buf, offs, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([u[first[q] : first[q + 1]].tobytes() for q in range(j - i)], pa.binary())], ["doc_id", "items"])

    def verify(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(p) + len(q) - inter))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    items = wanted.select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, items binary")
    left = items.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = items.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(verify, f"a {kind}, b {kind}")


def blocks(members: DataFrame) -> DataFrame:
    """(rep, comp, targets): the blocks that each set of a bucket with several components is sent to.

    ``members`` has band, at (which of the bands it is), rep, n and comp.
    """
    weight = F.greatest(F.col("n"), F.lit(LEAST))
    by_comp = members.groupBy("band", "comp").agg(F.sum(weight).alias("w"))
    by_band = by_comp.groupBy("band").agg(F.count("*").alias("comps"), F.max(F.struct("w", "comp")).alias("main"), F.sum("w").alias("all"))
    count = lambda w: F.ceil(w / F.lit(BLOCK_SHINGLES)).cast("int")
    mixed = by_band.where("comps > 1").select("band", F.col("main.comp").alias("main"), count(F.col("main.w")).alias("n_main"), count(F.col("all") - F.col("main.w")).alias("n_rest"))
    m = members.join(mixed, "band")
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("rep", "band"), F.when(is_main, F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    m = m.withColumn("own", own)
    target = lambda t, x, y, side: F.struct(F.xxhash64("band", F.lit(t), x, y).alias("key"), side.cast("int").alias("side"), F.col("at").cast("int").alias("at"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    alone = F.col("n_rest") == 1
    of_main = F.transform(up_to(F.col("n_rest")), lambda i: target(0, F.col("own"), i, F.lit(MAIN)))
    # The other sets meet the main component block by block, and each other in its first block or in pairs of blocks.
    against = F.transform(up_to(F.col("n_main")), lambda d: target(0, d, F.col("own"), F.when(alone & (d == 0), F.lit(BOTH)).otherwise(F.lit(ASIDE))))
    side = lambda j: F.when(j == F.col("own"), F.lit(BOTH)).when(j < F.col("own"), F.lit(HIGH)).otherwise(F.lit(LOW))
    among = F.transform(up_to(F.col("n_rest")), lambda j: target(1, F.least("own", j), F.greatest("own", j), side(j)))
    none = F.filter(among, lambda x: F.lit(False))
    m = m.select("rep", "comp", F.explode(F.when(is_main, of_main).otherwise(F.concat(against, F.when(alone, none).otherwise(among)))).alias("t"))
    return m.groupBy("rep", "comp").agg(F.collect_list("t").alias("targets"))


def block_links(r: dict[str, np.ndarray], codes: np.ndarray, first: np.ndarray, most: float, percent: int) -> list[tuple[int, int]]:
    """Links between components in one block, given as rows; rows of the ``MAIN`` side come last.

    Two components that a sure link joins are one from then on.
    """
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    comp, side, n = r["comp"], r["side"], r["n"]
    u = np.diff(first)  # distinct codes; fewer than n if some collide
    out = []
    ask = int(np.searchsorted(side == MAIN, True))
    step = max(1, (1 << 21) // (len(comp) * BANDS * ROWS // 8 + 1))
    for lo in range(0, ask, step):
        x, y = slice(lo, min(ask, lo + step)), slice(lo + 1, None)
        d = differing(r["sig"][x][:, None], r["sig"][y][None])
        a, b = n[x][:, None], n[y][None]
        ok = (d <= most) & (comp[x][:, None] != comp[y][None]) & ((side[x][:, None] != side[y][None]) | (side[y] == BOTH)[None])
        ok &= (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (np.arange(x.start, x.stop)[:, None] < np.arange(lo + 1, len(comp))[None])
        p, q = np.nonzero(ok)
        d, p, q = d[p, q], p + x.start, q + y.start
        # A pair is looked at only in the first of the bands that it shares.
        here = np.argmax(r["bands"][p] == r["bands"][q], axis=1) == r["at"][p] if len(p) else np.zeros(0, bool)
        p, q, d = p[here], q[here], d[here]
        order = np.lexsort((d, p))
        p, q = p[order], q[order]
        cut = np.append(np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])), len(p)) if len(p) else np.zeros(1, np.int64)
        for s, t in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i, others = int(p[s]), q[s:t]
            mine = codes[first[i] : first[i + 1]]
            # The most alike first; what joins them need not be looked at again.
            for size in (4, 60, len(others)):
                others = others[[root(int(comp[o])) != root(int(comp[i])) for o in others]]
                some, others = others[:size], others[size:]
                if not len(some):
                    break
                at = np.repeat(first[some] - np.concatenate([[0], np.cumsum(u[some])[:-1]]), u[some]) + np.arange(u[some].sum())
                theirs = codes[at]
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                inter = np.add.reduceat(hit.astype(np.int64), np.cumsum(u[some]) - u[some])
                need = -(-percent * (n[i] + n[some]) // (100 + percent))
                lost = np.maximum(n[i] - u[i], n[some] - u[some])
                for o, got in zip(some[inter + lost >= need].tolist(), (inter - need)[inter + lost >= need].tolist(), strict=True):
                    c, e = root(int(comp[i])), root(int(comp[o]))
                    if c != e:
                        out.append((i, o))
                        if got >= 3:  # more than a chance agreement of codes
                            parent[max(c, e)] = min(c, e)
    return out


def links_across(members: DataFrame, docs: DataFrame, k: int, percent: int, most: float) -> DataFrame:
    """(a, b): possible links between different components that share a bucket, few for each two components."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = keep(blocks(members), "blocks")
    size = wanted.agg(F.count("*"), F.sum(F.size("targets"))).first()
    n_ranges = max(64, (size[1] or 0) // 500)
    texts = texts_of(docs, wanted.select(F.col("rep").alias("doc_id")).distinct()).alias("d")
    few = 40 * (size[1] or 0) <= 16 << 20
    w = (F.broadcast(wanted) if few else wanted).alias("w")
    sent = texts.join(w, F.col("d.doc_id") == F.col("w.rep")).select("d.doc_id", "d.text", F.col("w.comp").cast("long").alias("comp"), "w.targets")

    def send(batches):
        for batch in batches:
            for i, j, buf, offs in pieces(batch.column(1), 1 << 19):
                u, first = shingle_sets(buf, offs, k)
                n = np.diff(first)
                low, band = min_hashes(u, first[:-1][n > 0])
                place = np.cumsum(n > 0) - 1
                short = (band & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                part = batch.column(3).slice(i, j - i)
                each = np.diff(np.asarray(part.offsets)) * (n > 0)
                flat = part.filter(pa.array(n > 0)).flatten()
                at = np.repeat(np.arange(j - i), each)
                words = [np.unique((u[first[q] : first[q + 1]] >> np.uint64(32)).astype(np.uint32)).tobytes() for q in range(j - i)]
                for lo in range(0, len(at), 512):
                    some = at[lo : lo + 512]
                    t = flat.slice(lo, 512)
                    key = t.field("key").to_numpy()
                    take = pa.array(some + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key % n_ranges), pa.array(key), batch.column(0).take(take).cast(pa.int64()), batch.column(2).take(take), t.field("side"), t.field("at"), pa.array(n[some]),
                         pa.array([low[place[q]].tobytes() for q in some], pa.binary()), pa.array([short[place[q]].tobytes() for q in some], pa.binary()), pa.array([words[q] for q in some], pa.binary())],
                        ["range", "key", "rep", "comp", "side", "at", "n", "sig", "bands", "codes"],
                    )

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        r = {c: table.column(c).to_numpy() for c in ("key", "rep", "comp", "side", "at", "n")}
        r["sig"], r["bands"] = fixed_width(table.column("sig"), np.uint64, BANDS * ROWS // 8), fixed_width(table.column("bands"), np.uint32, BANDS)
        column = table.column("codes").combine_chunks()
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
        codes = np.frombuffer(column.buffers()[2], np.uint32)
        order = np.lexsort((r["rep"], r["side"] == MAIN, r["key"]))
        cut = np.append(np.flatnonzero(np.concatenate([[True], np.diff(r["key"][order]) != 0])), len(order))
        a, b = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = order[lo:hi]
            first = np.concatenate([[0], np.cumsum(ends[own + 1] - ends[own])])
            packed = np.concatenate([codes[ends[x] : ends[x + 1]] for x in own])
            for x, y in block_links({c: v[own] for c, v in r.items()}, packed, first, most, percent):
                p, q = int(r["rep"][own[x]]), int(r["rep"][own[y]])
                a.append(min(p, q))
                b.append(max(p, q))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = sent.mapInArrow(send, "range long, key long, rep long, comp long, side int, at int, n long, sig binary, bands binary, codes binary")
    found = rows.groupBy("range").applyInArrow(link, "a long, b long")
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the id is its component's smallest) of every document."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = keep(signatures(d, k), "minhash")
    linked = rows.where("n > 0 and doc_id is not null")
    folded = keep(linked.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "sets")
    few = F.broadcast(folded) if rows_at_most(folded, BROADCAST_ROWS) else folded
    reps = linked.join(few, ["s1", "s2"]).where("doc_id = rep").select("rep", "n", "sig", "bands")

    # Buckets of several sets, and the two sets that each of their sets meets first.
    placed = reps.select("rep", "n", F.posexplode("bands").alias("at", "band"))
    other = F.min(F.struct(F.xxhash64("rep").alias("h"), "rep"))
    buckets = placed.groupBy("band").agg(F.min("rep").alias("low"), other.alias("o"), F.count("*").alias("c")).where("c > 1")
    buckets = keep(buckets.select("band", "low", F.col("o.rep").alias("other")), "buckets")
    members = keep(placed.join(F.broadcast(buckets) if rows_at_most(buckets, BROADCAST_ROWS) else buckets, "band"), "members")
    most = loose_bound(percent)
    pairs = keep(agreeing(first_candidates(members), reps, most), "pairs")
    edges = keep(confirmed(pairs, d, k, percent), "links")
    comps = keep(connected_components(edges), "components")

    # Then the buckets that hold several components.
    c = F.broadcast(comps) if rows_at_most(comps, BROADCAST_ROWS) else comps
    placed = members.join(c.withColumnRenamed("node", "rep"), "rep", "left").select("band", "at", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    more = keep(links_across(placed, d, k, percent, most), "pairs2")
    more = keep(confirmed(more, d, k, percent), "links2")
    # What the first links joined is joined already: each node with its component says the same in fewer rows.
    joined = comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = keep(connected_components(joined.union(more.select("a", "b"))), "groups") if more.count() else comps
    final = F.broadcast(final) if rows_at_most(final, BROADCAST_ROWS) else final

    out = rows.select("doc_id", "n", "s1", "s2").join(few, ["s1", "s2"], "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
