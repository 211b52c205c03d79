"""Reading and writing texts, labelled data and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import preview
from plumbline.functions.unicode import SPACE_CHARS
from plumbline.functions.verdict import CATEGORIES
from plumbline.operators.ordering import running_total
from plumbline.operators.policy import small

#: Separators besides line feed and carriage return.
RARE_ENDS = r"\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
GOLDEN = "id string, text string, level int, categories array<string>, targeted boolean, note string"


def indexed(df: DataFrame, name: str = "index") -> DataFrame:
    """Adds each row's 0-based position in source order, by counting partitions first: no global sort.

    The counts, one number a partition, give the place of each partition's first row.
    """
    marked = df.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    counts = marked.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()
    starts = [(r["__part"], at) for r, at in zip(counts, accumulate([0, *[r["n"] for r in counts]]), strict=False)]
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __start long"))
    # The lower 33 bits of the id number the rows of a partition.
    index = F.col("__start") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(starts, "__part").select(*df.columns, index.alias(name))


def read_texts(spark: SparkSession, texts: Sequence[str] = (), paths: Sequence[str] = ()) -> DataFrame:
    """S1. (id, text): given texts, then the lines of each path in order; blank lines go; ids are positions.

    The files of a folder come in order of their paths. A line's place is its file's, its split's first byte and its
    number in the split, so nothing is sorted: the splits' counts, one row a split, are added up. Besides
    the usual line ends the separators in ``RARE_ENDS`` end a line.
    """
    parts = [spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(F.lit(0).alias("__k"), F.lit("").alias("__file"), F.lit(0).cast("long").alias("__at"), "text")] if texts else []
    for k, p in enumerate(paths):
        lines = spark.read.text(p).select(F.lit(k + 1).alias("__k"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.explode(F.split("value", f"[{RARE_ENDS}]")).alias("text"))
        parts.append(lines)
    if not parts:
        return spark.createDataFrame([], "id string, text string")
    lines = reduce(DataFrame.unionByName, parts)
    full = lines.where(F.length(F.regexp_replace("text", f"[{SPACE_CHARS}]", "")) > 0).withColumn("__row", F.monotonically_increasing_id())
    place = ["__k", "__file", "__at"]
    splits = running_total(full.groupBy(*place).agg(F.min("__row").alias("__first"), F.count("*").alias("__n")), [], place, F.col("__n"), "__start").drop("__n")
    # Rows of a split are next to each other in one task, so their numbers are too.
    index = F.col("__start") + F.col("__row") - F.col("__first")
    return full.join(small(splits), place).select(index.cast("string").alias("id"), "text")


def read_golden(spark: SparkSession, directory: str, langs: Sequence[str] | None = None) -> DataFrame:
    """S2. All golden files of a folder; lang is the file's stem, or the name of its folder as ``write_golden`` makes them."""
    df = spark.read.schema(GOLDEN).json(directory)
    if "lang" not in df.columns:
        df = df.withColumn("lang", F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1))
    df = df.withColumns({"categories": F.coalesce("categories", F.array().cast("array<string>")), "targeted": F.coalesce("targeted", F.lit(False))})
    return df.where(F.col("lang").isin(*langs)) if langs else df


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """S3. CSV with a header, or JSON lines if the path ends in .jsonl or .json."""
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def to_golden(
    rows: DataFrame, text_col: str, label_col: str, lang: str, levels: Mapping[str, int], stem: str, file: str, category: str | None = None, index_col: str = "index", limit: int = 0
) -> DataFrame:
    """D1, V5, K3. Golden rows of labelled ones; unmapped labels go, but count in the index.

    ``index_col`` is the row's position in its source (see ``indexed``) or a key of the table.
    """
    if category is not None and category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}")
    label = F.col(label_col).cast("string")
    level = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[label] if levels else F.lit(None).cast("int")
    out = rows.withColumn("__level", level.cast("int")).where(F.col("__level").isNotNull())
    if limit:
        out = out.orderBy(index_col).limit(limit)
    text = F.regexp_replace(F.col(text_col).cast("string"), f"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+$", "")
    none = F.array().cast("array<string>")
    return out.select(
        F.concat(F.lit(f"{lang}-{stem}-"), F.col(index_col).cast("string")).alias("id"),
        text.alias("text"),
        F.col("__level").alias("level"),
        (F.when(F.col("__level") >= 2, F.array(F.lit(category))).otherwise(none) if category else none).alias("categories"),
        F.lit(False).alias("targeted"),
        F.concat(F.lit(f"from {file}, label "), label).alias("note"),
        F.lit(lang).alias("lang"),
    )


def write_golden(golden: DataFrame, path: str) -> None:
    """S7. JSON lines, one folder a language."""
    golden.write.mode("overwrite").partitionBy("lang").json(path)


def verdict_rows(verdicts: DataFrame, text: Column | str = "text") -> DataFrame:
    """S8. The short form of verdicts."""
    t = F.col(text) if isinstance(text, str) else text
    return verdicts.select("id", "level", "action", "top_category", "targeted", "confidence", "lang", preview(t).alias("text"))


def write_verdicts(verdicts: DataFrame, path: str, form: str = "parquet") -> None:
    """S8. All columns, partitioned by action."""
    verdicts.write.mode("overwrite").partitionBy("action").format(form).save(path)
