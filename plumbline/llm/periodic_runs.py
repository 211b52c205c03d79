"""Operator 11: runs of repeated words, found by Lyndon roots.

A run is a stretch of consecutive words with smallest period q that neither neighbour extends; it counts
if it has at least ``least`` words and ``exponent`` * q words. Every run contains a Lyndon root: a longest
Lyndon word at its place, under one order of the words or under the opposite one. So for each text:

1. Words that cannot lie in a run are cut away, without loss: inside a run every sequence of ``m`` words
   comes again within a period, so a word stays only if such a sequence covers it, and what is left is
   looked at again by itself.
2. Grouping, the first phase of a linear suffix sorter, under both orders: places start out grouped by
   their word; groups are taken from the highest down, and a group of places with the Lyndon word u
   lengthens the nearest lower place before them by u, as often as it follows. When a group is taken, its
   word is the longest Lyndon word at its places. No suffix array is made.
3. A root of length q (where three periods are asked for, only one followed by its copy) is extended both ways by longest common extensions
   (hashes of prefixes, binary search) into the run with period q.

Each text is worked on by itself in one batch of its task: memory and time are linear in its words (times
a logarithm for sorting), and nothing is shuffled.

Defined cases: null, empty and blank texts have no word and no run; texts of any length are read whole;
rows that repeat an id or a text are judged one by one; runs that share places are all listed, by start,
then period; an empty table gives an empty result; only the two named columns are read, and the result has
doc_id, n_words, runs and collapsed_text, so other columns may have any name. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kernel import U64, grams, mix, pieces, powers, span_hashes, word_bounds

_ODD = U64(0x9E3779B97F4A7C15)
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def gram_length(least: int, exponent: int) -> int:
    """The most words that every run has once more, a period later; at most 5."""
    return max(1, min(5, *(max(least, exponent * q) - q for q in range(1, least + 6))))


def stretches(h: np.ndarray, first: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): the words that may lie in a run, and where each stretch of neighbouring ones begins."""
    m = gram_length(least, exponent)
    places = np.arange(len(h))
    while True:
        g, start, _ = grams(h[places], first, m)
        size = np.diff(first)
        part = np.searchsorted(first, start, "right") - 1
        key = mix(g + part.astype(U64) * _ODD)
        order = np.argsort(key, kind="stable")
        a, b = order[:-1], order[1:]
        # A run's period is at most its stretch over the exponent, and so is the way to the next copy.
        near = (key[a] == key[b]) & ((start[b] - start[a]) * exponent <= size[part[a]])
        edge = np.zeros(len(places) + 1, np.int64)
        again = np.unique(np.concatenate([start[a[near]], start[b[near]]]))
        edge[again] += 1
        edge[again + m] -= 1
        kept = np.flatnonzero(np.cumsum(edge[:-1]))
        row = np.searchsorted(first, kept, "right") - 1
        new = np.concatenate([[True], (np.diff(kept) != 1) | (np.diff(row) != 0)]) if len(kept) else np.zeros(0, bool)
        begins = np.append(np.flatnonzero(new), len(kept))
        long = np.diff(begins) >= least
        kept = kept[np.repeat(long, np.diff(begins))]
        sizes = np.diff(begins)[long]
        if len(kept) == len(places) and len(sizes) == len(size):
            return places, first
        places, first = places[kept], np.concatenate([[0], np.cumsum(sizes)])
        if not len(kept):
            return places, first


def lyndon_lengths(codes: list[int], n_codes: int) -> list[int]:
    """The length of the longest Lyndon word at each place; 0 is a border, below all words, and comes first.

    Places of taken groups are linked to the left, so the nearest lower place before one is found by
    following links, which are shortened on the way. A place changes its group once for each group that
    lengthens it, and that group's places are then done: the work is linear but for the links.
    """
    n = len(codes)
    group = list(codes)
    members: list[list[int]] = [[] for _ in range(n_codes)]
    for s in range(n):
        members[group[s]].append(s)
    length = [1] * n_codes
    below, above = list(range(-1, n_codes - 1)), list(range(1, n_codes + 1))
    left = list(range(n))
    out = [0] * n
    g = n_codes - 1
    while g:
        size = length[g]
        now = [s for s in members[g] if group[s] == g]
        members[g] = []
        for s in now:
            out[s] = size
            left[s] = s - 1
        copies: dict[int, int] = {}
        for s in now:
            p = s - 1
            while left[p] != p:
                left[p] = p = left[left[p]]
            if codes[p]:
                copies[p] = copies.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in copies.items():
            moved.setdefault((k, group[p]), []).append(p)
        # More copies stand higher, and all stand above the places that no copy follows.
        for k, old in sorted(moved, reverse=True):
            new = len(length)
            length.append(length[old] + k * size)
            members.append(moved[k, old])
            for p in members[new]:
                group[p] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = below[up] = new
        g = below[g]
    return out


class Extensions:
    """Longest common extensions of two places, both ways, for many pairs at once."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.pw, self.inv = powers(self.n + 1, 1)
        self.total = np.zeros(self.n + 1, U64)
        np.cumsum(h * self.pw[:-1], out=self.total[1:])

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i equal the n words from j; all lie inside."""
        one = (self.total[i + n] - self.total[i]) * self.inv[i]
        return one == (self.total[j + n] - self.total[j]) * self.inv[j]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        return self._most(self.n - j, lambda n: self.same(i, j, n))

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        return self._most(i, lambda n: self.same(i - n, j - n, n))

    @staticmethod
    def _most(bound: np.ndarray, holds) -> np.ndarray:
        low, high = np.zeros_like(bound), bound.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = holds(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def find_runs(h: np.ndarray, first: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the rows, by start, then period; start counts over all rows."""
    none = np.zeros(0, np.int64)
    places, begins = stretches(h, first, least, exponent)
    if not len(places):
        return none, none, none
    # A border, unlike any other, stands before each stretch and at the end.
    at = np.arange(len(places)) + np.repeat(np.arange(1, len(begins)), np.diff(begins))
    n = len(places) + len(begins)
    seq = mix(np.arange(n).astype(U64) + _ODD)
    seq[at] = h[places]
    words, inverse = np.unique(h[places], return_inverse=True)
    ext = Extensions(seq)
    found = []
    for code in (inverse + 1, len(words) - inverse):
        codes = np.zeros(n, np.int64)
        codes[at] = code
        root = np.array(lyndon_lengths(codes.tolist(), len(words) + 1), np.int64)
        i, q = at, root[at]
        if exponent > 2:  # then a root of the first period has its copy after it
            i, q = i[i + 2 * q <= n], q[i + 2 * q <= n]
            i, q = (x[ext.same(i, i + q, q)] for x in (i, q))
        # Of the roots of one run the first will do: the one without its copy before it.
        before = i >= q
        copied = np.zeros(len(i), bool)
        copied[before] = ext.same(i[before] - q[before], i[before], q[before])
        i, q = i[~copied], q[~copied]
        back, ahead = ext.back(i, i + q), ext.ahead(i, i + q)
        found.append(np.stack([i - back, back + q + ahead, q], axis=1))
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(least, exponent * runs[:, 2])]
    word = np.full(n, -1)
    word[at] = places
    runs[:, 0] = word[runs[:, 0]]
    runs = np.unique(runs[:, [0, 2, 1]], axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed_text of every row.

    ``start`` is a word's number from 0. The collapsed text has the words that no run contains after its
    first period, joined by one space. ``exponent`` is at least 2.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")

    def rows(batches):
        for batch in batches:
            column = batch.column(1)
            for a, b, buf, offs in pieces(column, 1 << 21):
                s, e, first = word_bounds(buf, offs)
                start, length, period = find_runs(span_hashes(buf, s, e), first, least, exponent)
                edge = np.zeros(len(s) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                stays = np.cumsum(edge[:-1]) == 0
                row = np.searchsorted(first, start, "right") - 1
                has = np.searchsorted(row, np.arange(b - a + 1))
                data = buf.tobytes()
                texts = []
                for k in range(b - a):
                    ws = data[offs[k] : offs[k + 1]].split()
                    if has[k] < has[k + 1]:
                        ws = [ws[x] for x in np.flatnonzero(stays[first[k] : first[k + 1]])]
                    texts.append(b" ".join(ws))
                runs = pa.StructArray.from_arrays([pa.array(start - first[row]), pa.array(length), pa.array(period)], fields=list(RUN.value_type))
                lists = pa.ListArray.from_arrays(pa.array(has, pa.int32()), runs, type=RUN)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"])

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(rows, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string")
