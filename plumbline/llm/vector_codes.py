"""Operator 12: product codes of vectors, with memoised grid cells.

A vector's components become integers, floor(``scale`` * x), and the vector is cut into ``parts`` equal
consecutive parts. Each part position has a codebook of ``entries`` integer points: it starts as that part
of the vectors with the smallest ids, and in each of ``rounds`` rounds every part goes to its nearest entry
(squared distance, ties to the lower number) and every entry becomes the floor of its parts' mean.

Which entry is nearest is not looked up by trying all entries. The part's space is cut into a coarse grid.
For a cell that comes up, the least and the greatest distance from its box to each entry are worked out
once: an entry whose least distance exceeds another's greatest one is dominated, for every point of the
box. The others are remembered with the cell, and only they are evaluated, exactly, for the parts that fall
into it. Cells are remembered by each task, at most ``memo`` of them a part position; when that is full it
starts anew, so memory is bounded and answers never depend on it.

On Spark a round is one scan: each task sends sums and counts, at most parts * entries rows, which are added
up; the new codebooks (of fixed size) go to the tasks of the next round. All arithmetic is on integers, so
the result doesn't depend on how rows are dealt out.

Defined cases: null and empty vectors, vectors with a null or non-finite component, with one beyond
``LIMIT`` (whose squares would leave 64 bits), and vectors of another length than that of the smallest id
are left out; if the length isn't a multiple of ``parts``, parts differ by one component; null ids are kept
and come last in order; rows that repeat an id are put in order by their vectors for the first codebook,
and coded one by one; fewer rows than ``entries`` give fewer entries; equal entries are possible, and
then only the first is used; labels may be null or missing (one group then); an empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import bytes_at_most, keep, same
from plumbline.llm.vectors import finite, matrix, usable

LIMIT = float(1 << 20)
#: Errors by label are broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20


class Cells:
    """The entries that may be nearest, for each coarse cell of one part's space that has come up."""

    def __init__(self, book: np.ndarray, memo: int):
        self.book = book.astype(np.int64)
        spread = float(book.std(axis=0).mean()) if len(book) else 0.0
        self.width = max(1, int(spread))
        self.memo = memo
        self.known: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []
        self.evaluated = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each of some different cells, the numbers of the entries that no other dominates."""
        if len(self.known) + len(cells) > self.memo:
            self.known, self.lists = {}, []
        keys = [c.tobytes() for c in cells]
        new = [k for k, key in enumerate(keys) if key not in self.known]
        step = max(1, (4 << 20) // max(1, 8 * self.book.size))
        for i in range(0, len(new), step):
            low = (cells[new[i : i + step]] * self.width)[:, None, :]
            high = low + self.width - 1
            under, over = low - self.book, self.book - high
            least = (np.maximum(0, np.maximum(under, over)) ** 2).sum(axis=2)
            most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=2)
            stay = least <= most.min(axis=1)[:, None]
            for k, row in zip(new[i : i + step], stay, strict=True):
                self.known[keys[k]] = len(self.lists)
                self.lists.append(np.flatnonzero(row))
        return [self.lists[self.known[key]] for key in keys]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest entry of each row."""
        cells, which = np.unique(x // self.width, axis=0, return_inverse=True)
        lists = self.candidates(cells)
        sizes = np.array([len(v) for v in lists])
        flat, begins = np.concatenate(lists), np.concatenate([[0], np.cumsum(sizes)])
        code, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        which = which.reshape(-1)
        # A bounded number of evaluations at a time.
        each = sizes[which]
        ends = np.cumsum(each)
        self.evaluated += int(ends[-1])
        i = 0
        while i < len(x):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")))
            n = each[i:j]
            row = np.repeat(np.arange(i, j), n)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            e = flat[np.repeat(begins[which[i:j]] - first, n) + np.arange(len(row))]
            d = ((x[row] - self.book[e]) ** 2).sum(axis=1)
            dist[i:j] = np.minimum.reduceat(d, first)
            # The lowest number among those at the least distance.
            code[i:j] = np.minimum.reduceat(np.where(d == dist[row], e, len(self.book)), first)
            i = j
        return code, dist


def bounds(d: int, parts: int) -> list[tuple[int, int]]:
    return [(d * p // parts, d * (p + 1) // parts) for p in range(parts)]


def integers(column: pa.Array, d: int, scale: float) -> np.ndarray:
    return np.floor(matrix(column, d) * scale).astype(np.int64)


def sums(vectors: DataFrame, books: list[np.ndarray], d: int, scale: float, memo: int) -> DataFrame:
    """(part, entry, n, total): how many parts of all vectors are nearest to each entry, and their sums."""
    cuts = bounds(d, len(books))

    def rows(batches):
        cells = [Cells(b, memo) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(0), d, scale)
            for p, (a, b) in enumerate(cuts):
                code, _ = cells[p].nearest(x[:, a:b])
                n[p] += np.bincount(code, minlength=len(n[p]))
                order = np.argsort(code, kind="stable")
                used, at = np.unique(code[order], return_index=True)
                total[p][used] += np.add.reduceat(x[order, a:b], at, axis=0)
        for p in range(len(books)):
            used = np.flatnonzero(n[p])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[p][used]), pa.array(total[p][used].tolist(), pa.list_(pa.int64()))],
                    ["part", "entry", "n", "total"],
                )

    sent = vectors.select("vec").mapInArrow(rows, "part int, entry int, n long, total array<long>")
    at = F.posexplode("total").alias("k", "x")
    added = sent.select("part", "entry", "n", at).groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return added.withColumn("mean", F.floor(F.expr("x div n - if(x % n < 0, 1, 0)")))


def moved(books: list[np.ndarray], added: DataFrame) -> list[np.ndarray]:
    """The codebooks after a round: at most parts * entries points, read by the driver."""
    out = [b.copy() for b in books]
    for r in added.select("part", "entry", "k", "mean").collect():
        out[r["part"]][r["entry"], r["k"]] = r["mean"]
    return out


def codebooks(vectors: DataFrame, d: int, parts: int, entries: int, rounds: int, scale: float, memo: int) -> list[np.ndarray]:
    """The final codebook of each part position, of vectors (id, vec)."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()
    start = np.floor(np.array([r["vec"] for r in first], np.float64).reshape(-1, d) * scale).astype(np.int64)
    books = [start[:, a:b] for a, b in bounds(d, parts)]
    for _ in range(rounds):
        books = moved(books, sums(vectors, books, d, scale, memo))
    return books


def vector_codes(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, memo: int = 1 << 16
) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, codes, error, label_error) of every row that takes part, the codebooks).

    ``codes`` has the number of the nearest entry for each part, ``error`` the squared distances added up,
    ``label_error`` the errors of all rows with an equal label added up (null labels together).
    """
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    given = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec"), label.alias("label"))
    good, d = usable(given, finite(F.col("vec"), LIMIT), "id", "vec")
    if d < parts and d:
        raise ValueError(f"vectors of {d} components can't be cut into {parts} parts")
    books = codebooks(good.select("id", "vec"), d, parts, entries, rounds, scale, memo) if d else []
    cuts = bounds(d, parts)

    def code(batches):
        cells = [Cells(b, memo) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(1), d, scale)
            found = [cells[p].nearest(x[:, a:b]) for p, (a, b) in enumerate(cuts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            error = sum(e for _, e in found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists, pa.array(error)], ["vec_id", "label", "codes", "error"])

    kind, label_kind = (good.schema[c].dataType.simpleString() for c in ("id", "label"))
    coded = keep(good.mapInArrow(code, f"vec_id {kind}, label {label_kind}, codes array<int>, error long"), "codes")
    by = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "errors")
    size = F.coalesce(F.length(F.col("label").cast("string")), F.lit(0)) + 16
    by = (F.broadcast(by) if bytes_at_most(by, size, BROADCAST_BYTES) else by).alias("b")
    out = coded.alias("c").join(by, same(F.col("c.label"), F.col("b.label"))).select("c.vec_id", "c.label", "codes", "error", "label_error")
    return out, books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and component, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
