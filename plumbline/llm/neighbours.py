"""Operator 13: nearest vectors by inner product, from balanced posting lists.

1. Equal vectors are one: each different vector is searched, and is a query, once, and its ids are joined in
   at the end (the ``k`` + 1 smallest of each vector are enough, as ties go to smaller ids).
2. Largest inner product becomes least distance: a vector gets one more component, so that all have the norm
   of the longest; a query gets 0 there and is stretched to that norm.
3. A sample, bounded by ``sample`` vectors, is cut in halves again and again, each time at the middle of the
   difference of the distances to two centres, so that all leaves hold equally many; their means are the
   centroids, one for about ``list_rows`` vectors, ``lists`` at most.
4. The centroids are a graph in the memory of each task: every centroid is linked with its nearest ones, both
   ways. A search starts at some pivots and goes on along the links of every centroid whose distance is at most
   a given ratio of the best so far, until there is no more.
5. Every vector goes to the list of its nearest centroid, and boundary vectors also to the next ones, within
   ``boundary`` times that distance, at most ``replicas`` lists in all.
6. A query takes all lists whose centroids are within ``ratio`` times the distance of its nearest one: there is
   no cap. Long lists are cut into chunks of ``chunk_rows`` and their queries into blocks of ``block_rows``;
   each pair of chunk and block is one group. All inner products in it are exact.
7. First a query meets only its ``first`` nearest lists, without copies of boundary vectors. The score of its
   ``k`` + 1st best there is a floor: in the search of all its lists a group gives out no lower score, so what
   is put together for a query is little, however many lists it takes.

Memory: a group has at most about ``chunk_rows`` vectors and ``block_rows`` queries, whatever list is hot; the
centroids are at most ``lists`` vectors. Lists grow with the data beyond ``lists`` * ``list_rows`` rows.

Defined cases: null, empty and zero vectors, vectors with a null or non-finite component, vectors of another
length than that of the smallest id, and rows without an id take no part; rows that repeat id and vector are
one row; of rows that repeat an id with different vectors each is a query and a candidate, but never for its
own id; ties go to the smaller id; a query has fewer rows if there are fewer candidates; an empty table gives
an empty result; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.store import keep
from plumbline.llm.vectors import finite, matrix, usable


def balanced_leaves(x: np.ndarray, n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The rows' numbers in ``n`` groups of as nearly one size as can be."""
    done, todo = [], [(np.arange(len(x)), n)]
    while todo:
        rows, m = todo.pop()
        if m <= 1 or len(rows) < 2:
            done.append(rows)
            continue
        at = len(rows) * (m // 2) // m
        centres = x[rows[rng.choice(len(rows), 2, replace=False)]]
        for _ in range(6):
            order = np.argsort(x[rows] @ (centres[1] - centres[0]), kind="stable")
            centres = np.stack([x[rows[order[:at]]].mean(axis=0), x[rows[order[at:]]].mean(axis=0)])
        todo += [(rows[order[:at]], m // 2), (rows[order[at:]], m - m // 2)]
    return [r for r in done if len(r)]


class CentroidGraph:
    """Centroids with links to their neighbours, searched along the links."""

    def __init__(self, points: np.ndarray, links: int = 16, seed: int = 7):
        self.points = points
        n = len(points)
        self.norms = (points**2).sum(axis=1)
        near = []
        for i in range(0, n, 256):
            d = self.norms - 2 * points[i : i + 256] @ points.T
            near.append(np.argsort(d, axis=1, kind="stable")[:, : links + 1])
        pairs = {(i, int(j)) for i, row in enumerate(np.concatenate(near)) for j in row if i != int(j)}
        pairs |= {(j, i) for i, j in pairs}
        # A ring through all centroids, so that each can be reached.
        ring = np.random.default_rng(seed).permutation(n)
        pairs |= {(int(a), int(b)) for a, b in zip(ring, np.roll(ring, 1), strict=True) if a != b}
        ends = sorted(pairs)
        self.begins = np.searchsorted([i for i, _ in ends], np.arange(n + 1))
        self.ends = np.array([j for _, j in ends], np.int64)
        self.pivots = ring[: max(1, int(np.sqrt(n)))]

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances from each row to the centroids that the search came by, and infinity for the others."""
        out = np.full((len(x), len(self.points)), np.inf)
        own = (x**2).sum(axis=1)
        dist = own[:, None] + self.norms[self.pivots] - 2 * x @ self.points[self.pivots].T
        out[:, self.pivots] = np.sqrt(np.maximum(0, dist))
        opened = np.zeros(out.shape, bool)
        while True:
            row, at = np.nonzero((out <= ratio * out.min(axis=1)[:, None]) & ~opened)
            if not len(row):
                return out
            opened[row, at] = True
            n = self.begins[at + 1] - self.begins[at]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            to = self.ends[np.repeat(self.begins[at] - first, n) + np.arange(n.sum())]
            pair = np.unique(np.repeat(row, n) * len(self.points) + to)
            row, to = pair // len(self.points), pair % len(self.points)
            new = np.isinf(out[row, to])
            row, to = row[new], to[new]
            for i in range(0, len(row), 1 << 16):
                r, t = row[i : i + (1 << 16)], to[i : i + (1 << 16)]
                d = own[r] + self.norms[t] - 2 * np.einsum("ij,ij->i", x[r], self.points[t])
                out[r, t] = np.sqrt(np.maximum(0, d))


def groups(postings: DataFrame, asked: DataFrame, d: int, k: int, chunk_rows: int, block_rows: int, n_lists: int) -> DataFrame:
    """(q1, q2, k1, k2, id, score): the best of each chunk of a list for each query of a block that asks it.

    ``postings`` has list, k1, k2, id, vec; ``asked`` has list, q1, q2, q and floor.
    """
    kind = postings.schema["id"].dataType.simpleString()
    # One row a list, so a bounded number of rows.
    count = lambda df, c: df.groupBy("list").agg(F.count("*").alias(c))
    sizes = count(postings, "a").join(count(asked, "b"), "list").limit(n_lists).collect()
    sizes = [(r["list"], -(-r["a"] // chunk_rows), -(-r["b"] // block_rows)) for r in sizes]
    sizes = F.broadcast(postings.sparkSession.createDataFrame(sizes, "list int, chunks int, blocks int"))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["list", "chunk", "block"]
    left = postings.join(sizes, "list").withColumns({"chunk": F.pmod("k1", "chunks").cast("int"), "block": all_of("blocks")}).select(*key, "k1", "k2", "id", "vec")
    right = asked.join(sizes, "list").withColumns({"block": F.pmod("q1", "blocks").cast("int"), "chunk": all_of("chunks")}).select(*key, "q1", "q2", "q", "floor")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c, score = best_of(matrix(left.column("vec"), d), left.column("id").to_numpy(), matrix(right.column("q"), d), right.column("floor").to_numpy(), k)
        a, b = right.select(["q1", "q2"]).take(pa.array(q)), left.select(["k1", "k2", "id"]).take(pa.array(c))
        return pa.table({"q1": a["q1"], "q2": a["q2"], "k1": b["k1"], "k2": b["k2"], "id": b["id"], "score": score})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, f"q1 long, q2 long, k1 long, k2 long, id {kind}, score double")


def lists_of(dist: np.ndarray, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, lists): for each row the centroids within ``ratio`` of the nearest, the ``most`` nearest at most."""
    inside = dist <= ratio * dist.min(axis=1)[:, None]
    if most < dist.shape[1]:
        best = np.argsort(dist, axis=1, kind="stable")[:, :most]
        among = np.zeros(dist.shape, bool)
        np.put_along_axis(among, best, True, axis=1)
        inside &= among
    return np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32), np.nonzero(inside)[1].astype(np.int32)


def best_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the ``k`` best of each query that reach its floor, ties to smaller ids.

    Scores are added up in one order, so that a pair has the same score in whatever group it meets.
    """
    found = []
    slack = 1e-9 * np.sqrt((x**2).sum(axis=1).max() * (q**2).sum(axis=1).max()) if len(x) and len(q) else 0.0
    step = max(1, (4 << 20) // max(1, len(x)))
    for i in range(0, len(q) if len(x) else 0, step):
        s = q[i : i + step] @ x.T
        least = np.partition(s, -k, axis=1)[:, -k] if k < len(x) else np.full(len(s), -np.inf)
        r, c = np.nonzero(s >= (np.maximum(least, floor[i : i + step]) - slack)[:, None])
        exact = (q[i + r] * x[c]).sum(axis=1)
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < k
        found.append((i + r[top], c[top], exact[top]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (none, none, np.zeros(0))


def longer(x: np.ndarray, norm2: float) -> np.ndarray:
    """One more component, so that all rows have one norm."""
    return np.concatenate([x, np.sqrt(np.maximum(0, norm2 - (x**2).sum(axis=1)))[:, None]], axis=1)


def stretched(q: np.ndarray, norm2: float) -> np.ndarray:
    q = q * np.sqrt(norm2 / (q**2).sum(axis=1))[:, None]
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def nearest_neighbours(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    sample: int = 32_768,
    lists: int = 1024,
    list_rows: int = 160,
    boundary: float = 1.1,
    replicas: int = 4,
    ratio: float = 1.15,
    first: int = 2,
    chunk_rows: int = 65_536,
    block_rows: int = 8192,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest rows found for each row where ``is_query``."""
    given = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = finite(F.col("vec")) & F.exists("vec", lambda c: c != 0) & F.col("id").isNotNull()
    v, d = usable(given, good, "id", "vec")
    v = v.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    kind, vec_kind = (v.schema[c].dataType.simpleString() for c in ("id", "vec"))
    norm2 = F.aggregate("vec", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double"))
    whole = v.agg(F.approx_count_distinct("k1", 0.02).alias("n"), F.max(norm2).alias("norm2")).first()
    count, norm2 = whole["n"], whole["norm2"]
    if not d:
        return v.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")

    # The index: fitted on a bounded sample of different vectors.
    share = min(1.0, sample / max(1, count))
    some = v.where(F.pmod("k1", F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else v
    some = some.groupBy("k1", "k2").agg(F.first("vec").alias("vec")).orderBy("k1", "k2").select("vec").toArrow()
    x = longer(matrix(some.column("vec"), d), norm2) if len(some) else np.zeros((1, d + 1))
    n_lists = max(1, min(lists, count // list_rows, len(x) // 8))
    leaves = balanced_leaves(x, n_lists, np.random.default_rng(seed))
    graph = CentroidGraph(np.stack([x[r].mean(axis=0) for r in leaves]))
    step = max(64, (1 << 19) // len(graph.points))

    def deal(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                x = matrix(part.column(2), d)
                asks = part.column(4).to_numpy(zero_copy_only=False)
                dist = graph.search(longer(x, norm2), boundary)
                own, (offs, to) = dist.argmin(axis=1).astype(np.int32), lists_of(dist, boundary, replicas)
                n, probes, nearest = np.zeros(len(x), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
                start = np.zeros(len(x), np.int64)
                if asks.any():
                    dist = graph.search(stretched(x[asks], norm2), ratio)
                    q_offs, probes = lists_of(dist, ratio, len(graph.points))
                    s_offs, nearest = lists_of(dist, ratio, first)
                    n[asks], start[asks] = np.diff(q_offs), np.diff(s_offs)
                ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(o, pa.array(v)) for o, v in ((pa.array(offs), to), (ends(n), probes), (ends(start), nearest))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(own), *lists], ["k1", "k2", "vec", "id", "own", "lists", "probes", "nearest"])

    each = v.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.min("id").alias("id"), F.max("asks").alias("asks"))
    dealt = keep(each.mapInArrow(deal, f"k1 long, k2 long, vec {vec_kind}, id {kind}, own int, lists array<int>, probes array<int>, nearest array<int>"), "dealt")
    q = [F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("vec").alias("q")]
    some = groups(
        dealt.select(F.col("own").alias("list"), "k1", "k2", "id", "vec"), dealt.select(F.explode("nearest").alias("list"), *q, F.lit(float("-inf")).alias("floor")), d, k + 1, chunk_rows, block_rows, lists
    )
    place = F.row_number().over(W.partitionBy("q1", "q2").orderBy(F.desc("score")))
    floors = some.withColumn("place", place).where(F.col("place") == k + 1).select("q1", "q2", F.col("score").alias("floor"))
    asked = dealt.where(F.size("probes") > 0).select(*q, "probes").join(keep(floors, "floors"), ["q1", "q2"], "left")
    asked = asked.select(F.explode("probes").alias("list"), "q1", "q2", "q", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    found = groups(dealt.select(F.explode("lists").alias("list"), "k1", "k2", "id", "vec"), asked, d, k + 1, chunk_rows, block_rows, lists)

    # A pair that met in several lists has one place in this order.
    place = F.dense_rank().over(W.partitionBy("q1", "q2").orderBy(F.desc("score"), "id", "k1", "k2"))
    near = keep(found.withColumn("place", place).where(F.col("place") <= k + 1).drop("place", "id").distinct(), "near")
    ids = v.select("k1", "k2", "id").distinct()
    ids = ids.withColumn("n", F.row_number().over(W.partitionBy("k1", "k2").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = ids.groupBy("k1", "k2").agg(F.collect_list("id").alias("ids"))
    each = near.join(ids, ["k1", "k2"]).groupBy("q1", "q2").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    flat = F.flatten(F.transform("near", lambda n: F.transform(n["ids"], lambda i: F.struct((-n["score"]).alias("far"), i.alias("id")))))
    each = each.select("q1", "q2", F.slice(F.array_sort(flat), 1, k + 1).alias("near"))
    queries = v.where("asks").select("id", "k1", "k2").distinct()
    out = queries.join(each, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).select("id", F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k).alias("near"))
    out = out.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.far")).alias("score"))
