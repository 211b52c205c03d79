"""Periodic runs, vector codes and nearest neighbours against plain versions, and on awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.kernel import mix
from plumbline.llm.neighbours import CentroidGraph, balanced_leaves, nearest_neighbours
from plumbline.llm.periodic_runs import find_runs, lyndon_lengths, periodic_runs, stretches
from plumbline.llm.queries import op11_periodic_runs, with_repeats
from plumbline.llm.vector_codes import Cells, books_digest, vector_codes
from tests.llm import brute


def plain_runs(w, least, exponent):
    """Every period is tried at every place."""
    codes = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if w else np.zeros(0, int)
    out = []
    for q in range(1, len(w) // exponent + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (codes[:-q] == codes[q:]).astype(int), [0]])))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            n = j - i + q
            if n >= max(least, exponent * q) and not any((codes[i : i + n - r] == codes[i + r : i + n]).all() for r in range(1, q)):
                out.append((i, n, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_collapsed(w, runs):
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def repetitive(rnd, k):
    w = []
    for _ in range(rnd.randint(0, 5)):
        u = [rnd.randint(1, k) for _ in range(rnd.randint(1, 6))]
        w += u * rnd.randint(1, 7)
        w = w[: len(w) - rnd.randint(0, 2)]
    return w


def test_lyndon_lengths_under_both_orders():
    rnd = random.Random(3)
    for _ in range(300):
        k = rnd.choice([1, 2, 3, 5])
        c = [0]
        for _ in range(rnd.randint(1, 3)):
            c += [rnd.randint(1, k) for _ in range(rnd.randint(1, 14))] + [0]
        for codes in (c, [x and k + 1 - x for x in c]):
            want = []
            for i, x in enumerate(codes):
                end = codes.index(0, i)
                words = [codes[i:j] for j in range(i + 1, end + 1)]
                want.append(max((len(u) for u in words if all(u < u[t:] for t in range(1, len(u)))), default=0) if x else 0)
            assert lyndon_lengths(codes, k + 1) == want


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 3), (6, 2), (12, 4)])
def test_op11_runs_against_every_period(least, exponent):
    rnd = random.Random(least * 10 + exponent)
    for _ in range(400):
        k = rnd.choice([1, 2, 3, 6])
        docs = [repetitive(rnd, k) for _ in range(rnd.randint(1, 4))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        h = mix(np.array(sum(docs, []), np.uint64) + np.uint64(99))
        got = sorted(zip(*(x.tolist() for x in find_runs(h, first, least, exponent)), strict=True))
        assert got == sorted((i + int(f), n, q) for d, f in zip(docs, first, strict=False) for i, n, q in plain_runs(d, least, exponent))


def test_op11_words_outside_runs_are_cut_and_time_is_linear():
    rnd = np.random.default_rng(1)
    plain = mix(rnd.zipf(1.3, 200_000).astype(np.uint64))
    places, _ = stretches(plain, np.array([0, len(plain)]), 6, 4)
    assert len(places) < 2_000
    # One word many times, then one that is greater in one order: the grouping takes a step a place.
    for tail in (1, 2):
        w = np.concatenate([np.full(100_000, 7), np.full(tail, 9), np.full(100_000, 7)]).astype(np.uint64)
        got = list(zip(*(x.tolist() for x in find_runs(mix(w), np.array([0, len(w)]), 6, 4)), strict=True))
        assert got == [(0, 100_000, 1), (100_000 + tail, 100_000, 1)]
    a, b = [1], [1, 2]  # a Fibonacci word: runs at many periods
    while len(b) < 500:
        a, b = b, b + a
    for exponent in (2, 3):
        got = find_runs(mix(np.array(b, np.uint64)), np.array([0, len(b)]), 2, exponent)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == plain_runs(b, 2, exponent)


def test_op11_query_against_a_plain_version(spark, tmp_path):
    rows = [(d, t) for d, t, *_ in brute.corpus()[0] if len(t or '') < 40_000]
    rnd = random.Random(8)
    rows += [(1000 + i, " ".join(f"w{x}" for x in repetitive(rnd, 4))) for i in range(60)] + [(None, "a a a a a a a"), (2000, None), (2001, ""), (2002, " \n ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = {r.doc_id: r.text for r in with_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert len(got) == len(rows) and sum(r.n_runs for r in got.values()) > 50
    for d, text in planted.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        runs = plain_runs(w, 6, 4)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{i},{n},{q}\n" for i, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()


def test_op11_awkward_tables(spark):
    schema = "doc_id string, text string, runs int, n_words string, start long"
    long = "x y " * 300_000
    rows = [("a", long, 1, "", 2), ("a", long, None, None, None), (None, None, 1, "1", 1), ("b", "x", 1, "1", 1)]
    got = periodic_runs(spark.createDataFrame(rows, schema)).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in sorted(got, key=lambda r: (r.doc_id or "", r.n_words))] == [
        (None, 0, [], ""), ("a", 600_000, [(0, 600_000, 2)], "x y"), ("a", 600_000, [(0, 600_000, 2)], "x y"), ("b", 1, [], "x"),
    ]
    assert periodic_runs(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([], schema), exponent=1)


def clustered(n, d, seed, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return (centres[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)


VECTORS = "vec_id long, embedding array<float>, label int, error string, list int"
AWKWARD = [
    (900, None, 1, "", 0), (901, [], 1, "", 0), (902, [1.0] * 23 + [None], 1, "", 0), (903, [float("nan")] * 24, 1, "", 0),
    (904, [math.inf] + [0.0] * 23, 1, "", 0), (905, [1.0] * 25, 1, "", 0),
]


def plain_codes(x, parts, entries, rounds):
    v = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    cuts = [(v.shape[1] * p // parts, v.shape[1] * (p + 1) // parts) for p in range(parts)]
    books = [v[:entries, a:b].copy() for a, b in cuts]
    for again in range(rounds + 1):
        dist = [((v[:, None, a:b] - books[p]) ** 2).sum(axis=2) for p, (a, b) in enumerate(cuts)]
        code = np.stack([z.argmin(axis=1) for z in dist], axis=1)
        if again < rounds:
            for p, (a, b) in enumerate(cuts):
                for k in set(code[:, p]):
                    books[p][k] = v[code[:, p] == k, a:b].sum(axis=0) // (code[:, p] == k).sum()
    return code, sum(z.min(axis=1) for z in dist), books


@pytest.mark.parametrize("d,parts,entries", [(24, 4, 16), (24, 5, 64), (24, 16, 7)])
def test_op12_against_all_entries(spark, d, parts, entries):
    x = clustered(400, d, d + parts)
    x[50:200] = x[50]  # a hot vector
    x[3] = x[1]  # an entry that is there twice
    label = [None if i % 5 == 0 else i % 3 for i in range(len(x))]
    rows = [(i, [float(c) for c in v], label[i], "clash", 1) for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    out, books = vector_codes(spark.createDataFrame(rows + AWKWARD, VECTORS).repartition(5), parts=parts, entries=entries, memo=50)
    code, error, want = plain_codes(x, parts, entries, 2)
    by = Counter()
    for k, e in zip(label, error, strict=True):
        by[k] += int(e)
    got = {r.vec_id: r for r in out.collect()}
    assert sorted(got) == list(range(len(x)))
    for i, r in got.items():
        assert (r.codes, r.error, r.label, r.label_error) == (code[i].tolist(), error[i], label[i], by[label[i]])
    assert books_digest(books) == books_digest(want)


def test_op12_cells_leave_out_dominated_entries_only():
    rng = np.random.default_rng(5)
    book = rng.integers(-60, 60, (64, 4))
    x = rng.integers(-90, 90, (5_000, 4))
    for memo in (1 << 16, 10):
        cells = Cells(book, memo)
        code, dist = cells.nearest(x)
        all_of = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (code == all_of.argmin(axis=1)).all() and (dist == all_of.min(axis=1)).all()
        assert cells.evaluated < 0.6 * all_of.size
    again = cells.evaluated
    cells.nearest(x[:10])
    assert cells.evaluated > again and len(cells.known) <= max(10, len(x))


def test_op12_awkward_tables(spark):
    for rows in ([], AWKWARD[:5]):
        out, books = vector_codes(spark.createDataFrame(rows, VECTORS))
        assert out.count() == 0 and not books
    rows = [(None, [1.0] * 16, None, "", 1), (5, [2.0] * 16, 3, "", 1), (5, [2.0] * 16, 3, "", 1)]
    out, _ = vector_codes(spark.createDataFrame(rows, VECTORS))
    assert sorted((r.vec_id or -1, r.codes[0], r.error, r.label_error) for r in out.collect()) == [(-1, 2, 0, 0), (5, 0, 0, 0), (5, 0, 0, 0)]
    out, _ = vector_codes(spark.createDataFrame([(1, [0.5] * 16)], "vec_id int, embedding array<double>"), label_col=None)
    assert [tuple(r) for r in out.collect()] == [(1, None, [0] * 16, 0, 0)]


def plain_neighbours(x, ids, asks, k):
    x = x.astype(np.float64)
    s = x[asks] @ x.T
    out = {}
    for row, i in enumerate(np.flatnonzero(asks)):
        order = [j for j in np.lexsort((ids, -np.round(s[row], 9))) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(int(ids[j]), s[row, j]) for j in order]
    return out


@pytest.mark.parametrize("same_norm", [True, False])
def test_op13_recall_and_scores(spark, same_norm):
    x = clustered(3_000, 24, 2)
    if same_norm:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.random.default_rng(1).permutation(len(x)) * 5
    rows = [(int(i), [float(c) for c in v], 1, "", 2) for i, v in zip(ids, x, strict=True)] + [(a + 20_000, *r) for a, *r in AWKWARD] + [(77_780, [0.0] * 24, 1, "", 0), (None, [1.0] * 24, 1, "", 0)]
    got: dict[int, list] = {}
    # Small chunks and blocks, so that a list is searched in many groups.
    df = nearest_neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, list_rows=60, chunk_rows=100, block_rows=20, sample=1_500)
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = plain_neighbours(x, ids, ids % 20 == 0, 20)
    assert set(got) == set(want)
    hits = 0
    by_id = {int(i): v.astype(np.float64) for i, v in zip(ids, x, strict=True)}
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, 21)) and len({v for _, v, _ in near}) == 20
        assert all(abs(s - by_id[q] @ by_id[v]) < 1e-9 for _, v, s in near)
        assert near == sorted(near, key=lambda n: (-n[2], n[1]))
        hits += len({v for _, v, _ in near} & {v for v, _ in want[q]})
    assert hits >= 0.94 * 20 * len(want), hits


def test_op13_copies_ties_and_few_rows(spark):
    x = clustered(300, 24, 4)
    x[100:] = x[100]  # two thirds are one vector
    rows = [(i, [float(c) for c in v], 1, "", 2) for i, v in enumerate(x)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows + rows[:3], VECTORS), F.col("vec_id") % 20 == 0, list_rows=20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = plain_neighbours(x, np.arange(300), np.arange(300) % 20 == 0, 20)
    for q in range(120, 300, 20):  # the vectors that equal the query come first, by id
        assert [got[q][r][0] for r in range(1, 21)] == [v for v, _ in want[q]]
    few = spark.createDataFrame(rows[:4] + [(20, rows[0][1], 1, "", 2)], VECTORS)
    assert [(r.query_id, r.vec_id) for r in nearest_neighbours(few, F.col("vec_id") == 20).orderBy("rank").limit(1).collect()] == [(20, 0)]
    assert nearest_neighbours(few, F.col("vec_id") == 20).count() == 4
    assert nearest_neighbours(few, F.lit(None).cast("boolean")).count() == 0
    for rows in ([], AWKWARD[:5]):
        assert nearest_neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 2 == 0).count() == 0


def test_op13_leaves_are_balanced_and_the_graph_finds_what_is_near():
    x = clustered(4_000, 16, 9).astype(np.float64)
    leaves = balanced_leaves(x, 60, np.random.default_rng(0))
    assert len(leaves) == 60 and sorted(np.concatenate(leaves)) == list(range(len(x)))
    assert max(map(len, leaves)) <= 1.2 * min(map(len, leaves))
    points = np.stack([x[r].mean(axis=0) for r in leaves])
    graph = CentroidGraph(points, links=6)
    found = graph.search(x[:500], 1.2)
    true = np.sqrt(((x[:500, None] - points) ** 2).sum(axis=2))
    wanted = true <= 1.2 * true.min(axis=1)[:, None]
    assert (np.abs(found - true)[np.isfinite(found)] < 1e-6).all()
    assert np.isfinite(found[wanted]).mean() > 0.98
