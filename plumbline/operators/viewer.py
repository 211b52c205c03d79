"""The viewer's side: show, blur or hide (L6, J6), text changes (W3), stale verdicts (J9), counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.policy import MAX_COMBINED_ROWS, small

DEFAULT_HIDE = 2


def hide_level(value: Column) -> Column:
    """The setting, within 1..5; 0 and null give 2."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(F.nullif(value, F.lit(0)), F.lit(DEFAULT_HIDE))))


def viewer_action(enabled: Column, hide: Column, blur: Column, allow: Column, level: Column, top: Column) -> Column:
    """L6. ``hide`` is already clamped; ``allow`` is a map of category to boolean."""
    allowed = top.isNotNull() & F.coalesce(F.try_element_at(allow, top), F.lit(False)) & (level < 4)
    on = hide <= 4
    return (
        F.when(~enabled | allowed, "show")
        .when(on & (level >= hide), "hide")
        .when(blur & on & (level >= 1) & (level == hide - 1), "blur")
        .otherwise("show")
    )


def viewer_matrix(verdicts: DataFrame, viewers: DataFrame, on: str | None = None) -> DataFrame:
    """J6. Verdicts (level_argmax, top_category) for viewers (viewer, enabled, hide_level, blur, allow): adds viewer, shown.

    With ``on`` by equality of that column, else each verdict for each viewer of a small table.
    """
    v = viewers.withColumn("hide_level", hide_level(F.col("hide_level")))
    if on:
        both = verdicts.join(small(v), on)
    else:
        if v.limit(MAX_COMBINED_ROWS + 1).count() > MAX_COMBINED_ROWS:
            raise ValueError("too many viewers for all combinations; give a column to join on")
        both = verdicts.crossJoin(F.broadcast(v))
    shown = viewer_action(*[F.col(c) for c in ("enabled", "hide_level", "blur", "allow", "level_argmax", "top_category")])
    return both.withColumn("shown", shown).select(*verdicts.columns, "viewer", "shown")


def display_stats(shown: DataFrame) -> DataFrame:
    """A6. Counts by viewer."""
    n = lambda c: F.count_if(c)
    return shown.groupBy("viewer").agg(F.count("*").alias("graded"), n(F.col("cached")).alias("cached"), n(F.col("shown") == "hide").alias("hidden"), n(F.col("shown") == "blur").alias("blurred"))


def text_changes(events: DataFrame, node_cols: list[str], order_cols: list[str], text_col: str = "text", least: int = 2) -> DataFrame:
    """W3. Events at which a node's text becomes another text of at least ``least`` characters.

    An empty or short text forgets the node, so the same text after it counts as a change.
    """
    text = F.when(F.length(text_col) >= least, F.col(text_col))
    before = F.lag("__t").over(Window.partitionBy(*node_cols).orderBy(*order_cols))
    rows = events.withColumn("__t", text).withColumn("__before", before)
    return rows.where(F.col("__t").isNotNull() & ~F.col("__t").eqNullSafe(F.col("__before"))).drop("__t", "__before")


def fresh_verdicts(verdicts: DataFrame, texts: DataFrame, node_cols: list[str], least: int = 2) -> DataFrame:
    """J9. Verdicts (node, ts, text) whose node still shows that text at their time; ``texts`` has node, ts, text.

    Both are put in one stream a node and the last text before each verdict is taken: no range join.
    """
    kind = [F.lit(0).alias("__v"), F.when(F.length("text") >= least, F.col("text")).alias("__shown")]
    a = texts.select(*node_cols, "ts", *kind)
    b = verdicts.withColumns({"__v": F.lit(1), "__shown": F.lit(None).cast("string")})
    both = b.unionByName(a, allowMissingColumns=True)
    # The last text row at or before the verdict; a short text counts and clears the node.
    mark = F.when(F.col("__v") == 0, F.struct("__shown"))
    last = F.last(mark, ignorenulls=True).over(Window.partitionBy(*node_cols).orderBy("ts", "__v").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__last", last).where((F.col("__v") == 1) & (F.col("__last.__shown") == F.col("text"))).drop("__v", "__shown", "__last")
