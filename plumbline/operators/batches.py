"""Model calls as tables: numbering and packing (W2, L9), parsing (L7, L8), results back to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.verdict import CATEGORIES
from plumbline.operators.ordering import running_total

BATCH = 16
# Profiles and category names of the guard model's labels.
LABEL_PROBS = {
    "safe": (0.85, 0.10, 0.04, 0.01, 0.00),
    "controversial": (0.10, 0.30, 0.40, 0.15, 0.05),
    "unsafe": (0.00, 0.05, 0.25, 0.50, 0.20),
}
LABEL_CATEGORIES = {
    "violent": "violence",
    "non-violent illegal acts": "illegal",
    "sexual content or sexual acts": "sexual",
    "suicide & self-harm": "self_harm",
    "unethical acts": "harassment",
}
#: Our own wording of what a scorer is asked about each text.
CONTEXT = "Short comments that people post in public. Jokes and strong reactions are usual; attacks on people are not."
SCALE = ("no harm", "rude or crude", "insulting or harassing a person, or spam", "hateful, or wishing harm", "a threat, self-harm, or help with a grave crime")
ABOUT = {
    "spam": "advertising or a scam", "harassment": "an attack on a person", "hate": "an attack on a group", "sexual": "sexual content",
    "violence": "a threat or praise of violence", "self_harm": "self-harm or suicide", "illegal": "help with a serious crime",
}


def number_batches(items: DataFrame, group_cols: list[str], order_col: str, size: int = BATCH) -> DataFrame:
    """W2. Adds pos (from 0, within the group) and chunk = pos div size; ``order_col`` tells a group's items apart.

    A very long group is numbered by several tasks.
    """
    numbered = running_total(items, group_cols, [order_col], F.lit(1), "pos").withColumn("pos", F.col("pos").cast("int"))
    return numbered.withColumn("chunk", F.floor(F.col("pos") / size).cast("int"))


def questions(key: Column) -> Column:
    """L9. Map of the nine questions about one text: level, targeted, seven categories."""
    ask = lambda kind, text: F.to_json(F.struct(F.lit(kind).alias("type"), text.alias("instructions")))
    parts = [F.struct(F.concat(key, F.lit("_risk")), ask("score", F.concat(F.lit("How harmful is `"), key, F.lit("`? From 0 to 4: " + "; ".join(SCALE)))))]
    parts.append(F.struct(F.concat(key, F.lit("_targeted")), ask("noul", F.concat(F.lit("Is `"), key, F.lit("` aimed at one person?")))))
    for c, what in ABOUT.items():
        parts.append(F.struct(F.concat(key, F.lit(f"_cat_{c}")), ask("noul", F.concat(F.lit("Is `"), key, F.lit(f"` {what}?")))))
    return F.map_from_entries(F.array(*parts))


def build_requests(items: DataFrame, group_cols: list[str], order_col: str, size: int = BATCH, text_col: str = "text") -> DataFrame:
    """L9. One row for each chunk: n_items, state and questions as JSON. A chunk has at most ``size`` texts."""
    key = F.concat(F.lit("c"), (F.col("pos") % size).cast("string"))
    rows = number_batches(items, group_cols, order_col, size).withColumn("key", key)
    got = F.array_sort(F.collect_list(F.struct("pos", "key", F.col(text_col).alias("text"))))
    out = rows.groupBy(*group_cols, "chunk").agg(got.alias("got"))
    state = F.map_concat(F.create_map(F.lit("context"), F.lit(CONTEXT)), F.map_from_entries(F.transform("got", lambda x: F.struct(x["key"], x["text"]))))
    asked = F.map_from_entries(F.flatten(F.transform("got", lambda x: F.map_entries(questions(x["key"])))))
    return out.select(*group_cols, "chunk", F.size("got").alias("n_items"), F.to_json(state).alias("state"), F.to_json(asked).alias("questions"), F.size(asked).alias("n_questions"))


def parse_guard_output(df: DataFrame, output_col: str, backend: str = "guard") -> DataFrame:
    """L7. Adds label and the raw verdict columns read from a guard model's two-line answer."""
    out = F.col(output_col)
    found = F.lower(F.regexp_extract(out, r"(?i)Safety:\s*(Safe|Unsafe|Controversial)", 1))
    names = F.transform(F.split(F.regexp_extract(out, r"(?i)Categories:\s*(.+)", 1), ","), lambda x: F.lower(F.trim(x)))
    df = df.withColumns({"label": F.when(found == "", "safe").otherwise(found), "names": F.filter(names, lambda n: (n != "") & (n != "none"))})
    probs = F.when(F.col("label") == "safe", F.array(*map(F.lit, LABEL_PROBS["safe"])))
    for label in ("controversial", "unsafe"):
        probs = probs.when(F.col("label") == label, F.array(*map(F.lit, LABEL_PROBS[label])))
    cols = {"level_probs": probs}
    for c in CATEGORIES:
        own = [n for n, to in LABEL_CATEGORIES.items() if to == c]
        hit = F.arrays_overlap("names", F.array(*map(F.lit, own))) if own else F.lit(False)
        cols[f"cat_{c}"] = F.when(hit, 0.9).otherwise(0.05)
    cols |= {"targeted": F.when(F.col("label") == "safe", 0.05).otherwise(0.5), "confidence": F.lit(0.7), "backend": F.lit(backend), "input_tokens": F.lit(0.0)}
    return df.withColumns(cols).drop("names")


RESPONSE = (
    "model string, answers map<string, struct<type: string, score: double, confidence: double, probabilities: map<string, double>, noul: double>>, "
    "usage struct<input_tokens: double, output_tokens: double>"
)


def parse_responses(df: DataFrame, response_col: str, n_col: str, backend: str = "model") -> DataFrame:
    """L8. One row for each item of a batch response: item (0-based) and the raw verdict columns."""
    keep = [c for c in df.columns if c != response_col]
    df = df.withColumn("__r", F.from_json(F.col(response_col), RESPONSE)).where(F.col(n_col) > 0)
    df = df.withColumn("item", F.explode(F.sequence(F.lit(0), F.col(n_col).cast("int") - 1)))
    answer = lambda what: F.col("__r.answers")[F.concat(F.lit("c"), F.col("item").cast("string"), F.lit(what))]
    levels = F.array(*[F.coalesce(answer("_risk")["probabilities"][str(i)], F.lit(0.0)) for i in range(5)])
    total = F.aggregate("levels", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("levels", levels).withColumn("total", F.when(total == 0, 1.0).otherwise(total))
    cols = {"level_probs": F.transform("levels", lambda p: p / F.col("total"))}
    cols |= {f"cat_{c}": answer(f"_cat_{c}")["noul"] for c in CATEGORIES}
    cols |= {
        "targeted": answer("_targeted")["noul"],
        "confidence": answer("_risk")["confidence"],
        "backend": F.lit(backend),
        "input_tokens": F.coalesce("__r.usage.input_tokens", F.lit(0.0)) / F.greatest(F.col(n_col), F.lit(1)),
    }
    return df.withColumns(cols).select(*keep, "item", *cols)


def results_to_items(items: DataFrame, results: DataFrame) -> DataFrame:
    """J8. Results by (batch_id, id); items without a result are left out."""
    return items.join(results, ["batch_id", "id"])
