"""Verdict columns: levels, rounding, present and top categories.

In flight a verdict is flat: ``level_probs`` array of five doubles and one double ``cat_<name>`` for
each category.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
CATEGORIES = ("spam", "harassment", "hate", "sexual", "violence", "self_harm", "illegal")
CRITICAL = ("self_harm", "violence")
ACTIONS = ("pass", "review", "block")
LEVELS = range(5)

CAT_COLS = tuple(f"cat_{c}" for c in CATEGORIES)


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds columns that are computed once a row, whatever is filtered or read of them later.

    They come out of a generator that gives one row a row: filters on them stay above it, so matching and
    scoring are not repeated inside a filter, while filters on the other columns still reach the scan.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[x.alias(c) for c, x in columns.items()]))))


def cats(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}cat_{c}") for c in CATEGORIES}


def expected_level(probs: Column) -> Column:
    return sum((probs[i] * i for i in LEVELS), F.lit(0.0))


def argmax_level(probs: Column) -> Column:
    """The lowest level among those of the highest probability."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def round4(x: Column) -> Column:
    return F.round(x, 4)


def present(categories: Mapping[str, Column], least: float = 0.5) -> Column:
    """Names of the categories of at least 0.5, most probable first, ties in the fixed order."""
    ranked = F.array(*[F.struct((-p).alias("p"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, p) in enumerate(categories.items())])
    return F.transform(F.sort_array(F.filter(ranked, lambda x: x["p"] <= -least)), lambda x: x["c"])


def top_category(present_: Column) -> Column:
    critical = F.filter(present_, lambda c: c.isin(*CRITICAL))
    return F.coalesce(F.get(critical, 0), F.get(present_, 0))


def action_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (rank + 1).cast("int"))


def action_rank(name: Column) -> Column:
    return (F.nullif(F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), name), F.lit(0)) - 1).cast("int")
