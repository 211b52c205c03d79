"""The registered query of each operator, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.chat_format import repair_roles
from plumbline.llm.decontaminate import decontaminate
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.lm_scoring import lm_scores
from plumbline.llm.mixing import mix_sources
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.neighbours import nearest_neighbours
from plumbline.llm.periodic_runs import periodic_runs
from plumbline.llm.pii import personal_data
from plumbline.llm.quality_classifier import quality_classifier
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.substring_dedup import dedup_passages
from plumbline.llm.vector_codes import books_digest, vector_codes
from plumbline.sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir))
    return out.withColumn("host_rate", F.round("host_rate", 6))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("decontam_found").alias("contaminated"), F.col("decontam_n_items").alias("n_items"), F.col("decontam_items").alias("items"))


def op7_repair_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(table(spark, sf_dir, "conversations"))


def op5_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return out.select("doc_id", F.col("line_dedup_lines").alias("n_lines"), F.col("line_dedup_removed").alias("n_removed"), F.col("line_dedup_numbers").alias("removed_lines"), digest.alias("text_sha256"))


def op6_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(documents(spark, sf_dir), window=35).drop("kept_text")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten, chosen by its id's checksum, the words from one on repeat with a period."""

    def rows(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                g, rest = divmod(zlib.crc32(str(doc).encode()), 10)
                if doc is None or rest or not (ws := (text or b"").split()):
                    continue
                a = g % len(ws)
                p = 1 + (len(ws) - a) // (3 + g % 8)
                texts[k] = b" ".join(ws[:a] + [ws[a + i % p] for i in range(len(ws) - a)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(rows, d.schema)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_repeats(documents(spark, sf_dir)))

    def longer(best, run):  # runs come by start, then period, so the first of equals stays
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), longer)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    exact = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exact, "runs_sha256", "collapsed_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes(spread(table(spark, sf_dir, "embeddings")))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spread(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_lm_scores, op3_personal_data, op4_decontaminate, op5_dedup_lines, op6_dedup_passages, op7_repair_roles, op8_near_duplicates, op9_quality_classifier, op10_mix_sources, op11_periodic_runs, op12_vector_codes, op13_nearest_neighbours)
}

OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
gap AS (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS n FROM dup),
rep AS (SELECT doc_id, sum(n) AS n FROM gap GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(k)::DOUBLE / sum(n) AS p, sum(k::DOUBLE * k / n) / sum(n) AS sec, count(*) AS hosts, sum(n) AS n FROM h),
v AS (SELECT p, sec - p * p - p * (1 - p) * hosts / n AS spread FROM s),
st AS (SELECT p, least(1000.0, greatest(1.0, CASE WHEN spread <= 0 THEN 1000.0 ELSE p * (1 - p) / spread - 1 END))::DOUBLE AS st FROM v),
r AS (SELECT source, (k + greatest(p, 1e-6) * st) / (n + greatest(p, 1e-6) * st + greatest(1 - p, 1e-6) * st) AS rate FROM h, st)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       round(rate, 6) AS host_rate, NOT base_failed AND coalesce(rate, 0) < 0.5 AS kept
FROM f LEFT JOIN r USING (source)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, ((rn - 1) % 3 + 1)::DOUBLE AS w, 3 * source_size::DOUBLE AS cap FROM s),
k AS (SELECT *, cap / w AS fills, row_number() OVER (ORDER BY cap / w, rn) AS k FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate
      FROM k WINDOW b AS (ORDER BY fills, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fr AS (SELECT min(k) AS k, arg_min(rate, k) AS rate FROM l WHERE fills > rate),
t AS (SELECT source, source_size, least(CASE WHEN fr.k IS NULL OR l.k < fr.k THEN cap ELSE w * fr.rate END, cap) AS target FROM l, fr),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + (run - size / 2.0 <= rest AND rest > 0)::INT))::BIGINT AS taken FROM c
"""

_NEAREST = """SELECT w.vec_id, p, min((((w.x1 - b.x1) * (w.x1 - b.x1) + (w.x2 - b.x2) * (w.x2 - b.x2) + (w.x3 - b.x3) * (w.x3 - b.x3) + (w.x4 - b.x4) * (w.x4 - b.x4)) * 64 + k)) AS m
  FROM w JOIN {books} b USING (p) GROUP BY w.vec_id, p"""
_MEANS = """SELECT p, b.k, coalesce(floor(y1)::BIGINT, b.x1) AS x1, coalesce(floor(y2)::BIGINT, b.x2) AS x2, coalesce(floor(y3)::BIGINT, b.x3) AS x3, coalesce(floor(y4)::BIGINT, b.x4) AS x4
  FROM {books} b LEFT JOIN (SELECT p, m % 64 AS k, sum(x1) / count(*) AS y1, sum(x2) / count(*) AS y2, sum(x3) / count(*) AS y3, sum(x4) / count(*) AS y4
                            FROM {nearest} JOIN w USING (vec_id, p) GROUP BY ALL) USING (p, k)"""
#: Vectors of 64 components, so parts of 4; every part is compared with every entry.
OP12_SQL = f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
w AS (SELECT vec_id, p, v[4 * p + 1] AS x1, v[4 * p + 2] AS x2, v[4 * p + 3] AS x3, v[4 * p + 4] AS x4 FROM e, range(16) t(p)),
b0 AS (SELECT p, k - 1 AS k, x1, x2, x3, x4 FROM w JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM e) USING (vec_id) WHERE k <= 64),
n0 AS MATERIALIZED ({_NEAREST.format(books="b0")}),
b1 AS MATERIALIZED ({_MEANS.format(books="b0", nearest="n0")}),
n1 AS MATERIALIZED ({_NEAREST.format(books="b1")}),
b2 AS MATERIALIZED ({_MEANS.format(books="b1", nearest="n1")}),
n2 AS MATERIALIZED ({_NEAREST.format(books="b2")}),
c AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM n2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256
FROM c JOIN e USING (vec_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op10_mix_sources": OP10_SQL, "op12_vector_codes": OP12_SQL}
