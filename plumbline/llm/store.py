"""Shared tables that cut lineage, and small helpers that every operator uses.

Intermediate tables go to the folder named in ``spark.checkpoint.dir`` so that every executor can
read them again after another executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import keep, shared_dir

__all__ = ["WORD_GAP", "bytes_at_most", "keep", "rows_at_most", "same", "shared_dir", "text_hash", "with_verdicts", "words"]

#: Words are runs of characters other than ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def same(a: Column, b: Column) -> Column:
    """Equality that also holds between two nulls."""
    return a.eqNullSafe(b)


def rows_at_most(df: DataFrame, limit: int) -> bool:
    """Whether a table that is already written has at most ``limit`` rows."""
    return df.count() <= limit


def bytes_at_most(df: DataFrame, row_bytes: Column, limit: int) -> bool:
    """Whether a table that is already written has at most ``limit`` bytes, counted as ``row_bytes`` for each row."""
    return (df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= limit


def text_hash(text: Column) -> Column:
    """Tells rows with one id but different texts apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


#: Verdict tables are broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20


def with_verdicts(docs: DataFrame, verdicts: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join ``docs`` with a kept table (doc_id, th, ...) by id and text hash.

    The table is broadcast only if its rows have few bytes together. Its other columns come after those of
    ``docs``, and take the place of columns of the same name, unless ``how`` is a semi or anti join.
    """
    row = F.lit(16)
    for f in verdicts.schema:
        row += F.coalesce(F.length(f.name), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8)
    v = (F.broadcast(verdicts) if bytes_at_most(verdicts, row, BROADCAST_BYTES) else verdicts).alias("v")
    d = docs.withColumn("__plumbline_th", text_hash(F.col(text_col))).alias("d")
    both = d.join(v, same(F.col(f"d.`{id_col}`"), F.col("v.doc_id")) & (F.col("d.__plumbline_th") == F.col("v.th")), how)
    extra = [] if how in ("left_semi", "left_anti") else [c for c in verdicts.columns if c not in ("doc_id", "th")]
    return both.select(*[F.col(f"d.`{c}`") for c in docs.columns if c not in extra], *[F.col(f"v.{c}") for c in extra])
