"""The corpus pipeline, each stage against a plain version on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm.store import keep
from tests.llm import brute


def test_stages(spark, tmp_path):
    corpus, labels, items = brute.corpus(seed=8, n=200)
    spark.createDataFrame(corpus, brute.DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    bad = {i for i, q, t in labels if (not q or t) and corpus[i][1]}
    rows = {r.doc_id: tuple(r) for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = rows, d.columns
        d = keep(stage(spark, d, str(tmp_path)), name)
        out = d.collect()
        rows = {r.doc_id: tuple(r) for r in out}
        old = list(before.values())
        assert len(out) == len(rows)
        if name == "mix_sources":
            assert rows.keys() <= before.keys() and all(0 < r.taken <= 3 * r.size for r in out)
            continue
        assert d.columns == columns
        if name == "quality_classifier":
            gone = before.keys() - rows.keys()
            assert len(gone & bad) >= 0.9 * len(bad) and len(gone - bad) <= 0.05 * len(before)
        elif name == "line_dedup":
            lines = brute.removed_lines(old)
            want = {}
            for r in old:
                cut = lines.get(r[0], [])
                parts = (r[1] or "").split("\n")
                if cut and len(cut) == sum(bool(brute.words(x)) for x in parts):
                    continue
                want[r[0]] = r[1] if not cut else "\n".join(x for i, x in enumerate(parts) if i not in cut)
            assert {k: v[1] for k, v in rows.items()} == want
        elif name == "near_dedup":
            assert rows.keys() == {k for k, (_, c) in brute.groups(old, 5).items() if c == k}
        else:
            assert rows.keys() == before.keys() - brute.contaminated(old, items).keys()
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "taken").collect()) == sorted(d.select("doc_id", "taken").collect())


def tables(spark, path, rows, schema, labels=(), items=()):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
AWKWARD = [
    (None, "a text without an id", "en", "s", 5, "kept"), (None, None, None, None, None, None), (1, None, "en", "s", 0, "kept"), (2, "", "en", "s", 0, "kept"), (3, " \n ", None, "s", 3, "kept"),
    (4, LONG, "en", None, 1, "kept"), (5, "same words here and there " * 20, "en", "s", 1, "kept"), (5, "same words here and there " * 20, "en", "s", 1, "kept"),
    (5, "another text with this id", "en", "t", 1, "kept"), (6, "same words here and there " * 20, "en", "t", 1, "kept"), (7, "Seven words of an item stand here now", "en", "t", 1, "kept"),
]


def test_stages_on_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, no n_chars, items of few words."""
    tables(spark, tmp_path, AWKWARD, "doc_id long, text string, lang string, source string, n_chars long, size string", [(5, 1, 0)], [(1, "words of an item stand here NOW"), (2, None), (3, "")])
    sf = str(tmp_path)
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (whole, whole.drop("n_chars")):
        for c in ("taken", "kept", "th", "target", "line_dedup_lines_", "decontam_x", "rep", "items"):
            d = d.withColumn(c, F.lit("clash"))
        out = {name: keep(stage(spark, d, sf), name) for name, stage in corpus_pipeline.STAGES}
        assert all(out[n].columns == d.columns for n in list(out)[:-1])
        ids = {n: sorted(str(r.doc_id) for r in x.collect()) for n, x in out.items()}
        every = sorted(str(r[0]) for r in AWKWARD)
        assert ids["quality_classifier"] == every  # no labels of both kinds
        # One of the rows that repeat keeps its line, and the row of the other text under that id stays.
        assert set(ids["line_dedup"]) == set(every) - {"6"} and (ids["line_dedup"].count("None"), ids["line_dedup"].count("5")) == (2, 2)
        assert ids["near_dedup"] == sorted(x for x in every if x != "6")
        assert ids["decontaminate"] == sorted(x for x in every if x != "7")
        mixed = out["mix_sources"]
        assert {"size", "source_size", "target", "taken"} <= set(mixed.columns) and all(isinstance(r["size"], int) and r.th == "clash" for r in mixed.collect())
        assert set(ids["mix_sources"]) <= {"None", "4", "5", "6", "7"}
        if "n_chars" in d.columns:
            assert {r.n_chars for r in out["line_dedup"].collect() if r.doc_id == 4} == {1}


def test_stages_on_an_empty_table(spark, tmp_path):
    tables(spark, tmp_path, [], brute.DOCS)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
