"""Verdict tables: lookup (J2, V3), upsert (S11), retention (K1, K2), size.

A verdict table has backend, rubric_version, text_hash, the raw verdict columns, created and last_used.
It holds no texts. Written partitioned by (backend, rubric_version), other scorers' entries are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("backend", "rubric_version", "text_hash")


def lookup(items: DataFrame, cache: DataFrame, backend: str, rubric_version: str) -> DataFrame:
    """J2. ``items`` (with text_hash) left-joined to the entries of one scorer and version; adds cached."""
    own = cache.where((F.col("backend") == backend) & (F.col("rubric_version") == rubric_version)).drop("rubric_version", "created", "last_used")
    return items.join(own.withColumn("__hit", F.lit(True)), "text_hash", "left").withColumn("cached", F.coalesce("__hit", F.lit(False))).drop("__hit")


def misses(items: DataFrame, cache: DataFrame, backend: str, rubric_version: str) -> DataFrame:
    """Items whose hash the cache lacks."""
    own = cache.where((F.col("backend") == backend) & (F.col("rubric_version") == rubric_version)).select("text_hash")
    return items.join(own, "text_hash", "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """S11. The new snapshot: one entry a key, the one created last (the new table wins ties)."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in both.columns if c not in KEY]
    last = F.max_by(F.struct(*rest), F.struct("created", "__new"))
    return both.groupBy(*KEY).agg(last.alias("e")).select(*KEY, *[F.col(f"e.{c}").alias(c) for c in rest if c != "__new"])


def touch(cache: DataFrame, used: DataFrame) -> DataFrame:
    """Raise last_used by the uses (text_hash, used_at) of a run."""
    last = used.groupBy("text_hash").agg(F.max("used_at").alias("__used"))
    return cache.join(last, "text_hash", "left").withColumn("last_used", F.greatest("last_used", "__used")).drop("__used")


def retain_recent(cache: DataFrame, n: int = 50_000) -> DataFrame:
    """K1. The ``n`` entries used last; the hash settles ties."""
    return cache.orderBy(F.desc("last_used"), "text_hash").limit(n)


def retain_last(entries: DataFrame, n: int = 3000, viewer_col: str = "viewer", seq_col: str = "seq") -> DataFrame:
    """K2. The last ``n`` entries of each viewer, by insertion order."""
    rn = F.row_number().over(Window.partitionBy(viewer_col).orderBy(F.desc(seq_col)))
    return entries.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def cache_size(cache: DataFrame) -> DataFrame:
    """A7. Entries by scorer and version."""
    return cache.groupBy("backend", "rubric_version").agg(F.count("*").alias("entries"))
