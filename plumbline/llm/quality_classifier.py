"""Operator 9: quality classifier by importance resampling.

Two generative models over hashed one- and two-word grams are compared: one of the target (documents
labelled good and not toxic, a bounded sample of at most ``max_labelled`` rows) and one of the raw
text (all documents). A document's log weight is its mean log ratio a gram, drawn towards zero for short
texts by ``prior`` grams of ratio one, over ``temperature``: a sum would grow with the length and let long
documents win or lose whatever they say. Gumbel noise, fixed by the id and ``seed``, is added, and the k
largest keys are kept, which draws k documents without replacement by their weights. The k-th key is found
by histograms, so no document is sorted or gathered. ``k`` is a parameter; if it is not given, it is the
number of documents whose log weight reaches the cutoff that tells labelled rows apart best.

Defined cases: a null or empty text has no grams and gets log weight 0; a null id draws the noise of its
own hash; with no labels of both kinds nothing can be told apart and every document is kept unless k is
given; rows that repeat an id share their noise, and a labelled id with several rows counts once, with
their mean, when the cutoff is fitted; ties at the k-th key are all kept; texts of any length are read
whole, a piece at a time; an empty table gives an empty result; only the named columns are read, and the
result has doc_id, n_features, log_weight, key and kept (and th), so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kernel import grams, pieces, span_hashes, word_bounds
from plumbline.llm.store import keep, text_hash

SLICE = 4096


def feature_buckets(buf: np.ndarray, offs: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all one- and two-word grams and the row of each."""
    s, e, first = word_bounds(buf, offs)
    h = span_hashes(buf, s, e, lower=True)
    g, at, _ = grams(h, first, 2)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    both = np.concatenate([h, g]) & np.uint64(n_buckets - 1)
    return both.astype(np.int64), np.concatenate([row, row[at]])


def bucket_counts(docs: DataFrame, text_col: str, n_buckets: int) -> np.ndarray:
    """Counts of hashed grams over all rows: ``n_buckets`` numbers, whatever the size of the input.

    Every task sends its counts in slices that are added up by slice on the executors.
    """

    def count(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, _, buf, offs in pieces(batch.column(0)):
                total += np.bincount(feature_buckets(buf, offs, n_buckets)[0], minlength=n_buckets)
        parts = total.reshape(-1, min(SLICE, n_buckets))
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([parts[i].tobytes() for i in full], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"slice": [table.column("slice")[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "slice long, counts binary"
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, kind).groupBy("slice").applyInArrow(add, kind).collect()
    out = np.zeros(n_buckets, np.int64)
    width = min(SLICE, n_buckets)
    for r in rows:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, alpha: float, margin: float) -> np.ndarray:
    """Log of target over raw probability of each bucket, both smoothed by the same ``alpha``.

    Ratios nearer to one than ``margin`` (in logs) count as one, the others are drawn towards it by as
    much: the target is part of the raw text, so small differences say nothing about a document.
    """
    scale = target.sum() / max(1, raw.sum())
    t, r = target + alpha, raw * scale + alpha
    ratio = np.log(t / t.sum()) - np.log(r / r.sum())
    return (np.sign(ratio) * np.maximum(np.abs(ratio) - margin, 0)).astype(np.float32)


def scored(docs: DataFrame, text_col: str, weights: np.ndarray, temperature: float, prior: float) -> DataFrame:
    """Adds n_features and log_weight to ``docs``."""
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(weights)
    n_buckets = len(weights)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.drop(text_col).schema)}, n_features long, log_weight double"
    names = [c for c in docs.columns if c != text_col]

    def score(batches):
        w = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j, buf, offs in pieces(column):
                b, row = feature_buckets(buf, offs, n_buckets)
                n[i:j] = np.bincount(row, minlength=j - i)
                total[i:j] = np.bincount(row, weights=w[b], minlength=j - i)
            value = total / (n + prior) / temperature
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(n), pa.array(value)], [*names, "n_features", "log_weight"])

    return docs.mapInArrow(score, schema)


def fit_cutoff(scores: np.ndarray, good: np.ndarray, keep_good: float) -> float:
    """The cutoff that separates labelled rows best among those that keep ``keep_good`` of the good ones."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    caught = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    # In a small sample two good rows may be lost, so that no single odd one decides.
    gain = np.where(lost <= max(1 - keep_good, 2 / g.sum()), caught - 2 * lost, -np.inf)
    i = int(np.argmax(gain))
    return -np.inf if i == 0 else float(s[i - 1] + (s[i] - s[i - 1]) / 2 if i < len(s) else s[-1])


def gumbel(doc_id: Column, seed: Column | int) -> Column:
    """Gumbel noise that an id and a seed fix."""
    h = F.xxhash64(doc_id, F.lit(seed) if isinstance(seed, int) else seed)
    return -F.log(-F.log((F.pmod(h, F.lit(1 << 40)) + 0.5) / float(1 << 40)))


def kth_key(keys: DataFrame, k: int, n: int) -> float | None:
    """The k-th largest ``key`` by histograms of 1,024 bins, each round over the bin that holds it."""
    if k >= n or k <= 0:
        return None
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    for _ in range(8):
        if not low < high:
            break
        width = (high - low) / 1024
        bin_of = F.least(F.floor((F.col("key") - low) / width), F.lit(1023))
        hist = {r["b"]: r["n"] for r in keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()}
        above = keys.where(F.col("key") > high).count()
        for b in sorted(hist, reverse=True):
            if above + hist[b] >= k:
                low, high = low + b * width, low + (b + 1) * width
                break
            above += hist[b]
        if above + hist[b] == k or hist[b] == 1:
            break
    return low


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_buckets: int = 1 << 18,
    alpha: float = 5.0,
    margin: float = 0.4,
    temperature: float = 1 / 300,
    prior: float = 60.0,
    k: int | None = None,
    keep_good: float = 0.997,
    max_labelled: int = 40_000,
    seed: int = 1,
    with_hash: bool = False,
) -> DataFrame:
    """doc_id, n_features, log_weight, key, kept (and th, the text's hash, with ``with_hash``). ``labels`` has the id, quality (1 good) and toxic (1 bad).

    A good target row has quality 1 and toxic 0. The labelled sample is the ``max_labelled`` rows with the
    smallest hash of the id; every other figure is taken over all documents.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    lab = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(good.cast("int")).alias("good"))
    lab = lab.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labelled)
    sample = keep(d.join(F.broadcast(lab), "doc_id"), "labelled")
    raw = bucket_counts(d, "text", n_buckets)
    # One half of the labelled rows gives the target model, the other half the cutoff, as neither may judge itself.
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)) == 0
    target = bucket_counts(sample.where("good = 1").where(half), "text", n_buckets)
    weights = log_ratio(target, raw, alpha, margin) if target.sum() else np.zeros(n_buckets, np.float32)
    fit = scored(sample.where(~half).select("doc_id", "good", "text"), "text", weights, temperature, prior)
    fit = fit.groupBy("doc_id").agg(F.min("good").alias("good"), F.avg("log_weight").alias("log_weight")).drop("doc_id").toPandas()
    cutoff = fit_cutoff(fit["log_weight"].to_numpy(float), fit["good"].to_numpy() == 1, keep_good)
    if with_hash:
        d = d.withColumn("th", text_hash(F.col("text")))
    s = keep(scored(d, "text", weights, temperature, prior).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "weights")
    n, reach = s.agg(F.count("*"), F.sum((F.col("log_weight") >= cutoff).cast("long"))).first()
    k = min(n, k) if k is not None else reach or 0
    least = kth_key(s, k, n)
    kept = F.lit(bool(k)) if least is None else F.col("key") >= least
    return s.withColumn("kept", kept)
