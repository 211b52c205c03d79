"""Word lists: loading (S4), matching (J1, V4), the offline scorer (L1) and the floor it sets (L2)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import compact, normalize
from plumbline.functions.verdict import CATEGORIES, argmax_level
from plumbline.sources.shared import keep

SCORER = "lexicon"
#: Lists of up to this many entries become constant patterns inside the plan, longer ones an index that is joined.
INLINE_ENTRIES = 200
#: A term without a Latin word is filed under one run of so many characters, or under the whole of it if it is shorter.
GRAM = 6
#: Of so many texts the words and runs of characters are counted, to choose each term's rarest; results don't depend on it.
GRAM_SAMPLE = 2_000
#: Lists that pass through the driver have at most so many entries; ``entry_table`` has no limit.
MAX_ENTRIES = 1_000_000
HIT = "idx long, level int, lang string, term string, category string, targeted boolean"
_HITS = f"array<struct<{', '.join(f.replace(' ', ': ') for f in HIT.split(', '))}>>"
_LATIN = re.compile(r"[a-z0-9 '._-]+")
WORD = "[a-z0-9]+"


@dataclass(frozen=True)
class Entry:
    """One term, already normalized; ``compact`` is its letters and digits."""

    term: str
    level: int = 2
    lang: str = "any"
    category: str | None = None
    targeted: bool = False
    compact: str = ""

    @property
    def latin(self) -> bool:
        return bool(_LATIN.fullmatch(self.term))


def lexicon_entries(spark: SparkSession, rows: Iterable[dict]) -> list[Entry]:
    """Entries from dicts (term, level, lang, category, targeted), normalized by the same expression as texts.

    Order is kept. A term that is not Latin and has no letter or digit would match every text: it is refused.
    """
    raw = [{"term": str(r["term"]), "level": int(r.get("level", 2)), "lang": r.get("lang") or "any", "category": r.get("category"), "targeted": bool(r.get("targeted", False))} for r in rows]
    if len(raw) > MAX_ENTRIES:
        raise ValueError(f"a word list may have at most {MAX_ENTRIES} entries")
    for r in raw:
        if r["category"] is not None and r["category"] not in CATEGORIES:
            raise ValueError(f"unknown category {r['category']!r}; there are {', '.join(CATEGORIES)}")
        if not 0 <= r["level"] <= 4:
            raise ValueError(f"level {r['level']} of {r['term']!r} is not in 0..4")
    if not raw:
        return []
    df = spark.createDataFrame([(i, r["term"]) for i, r in enumerate(raw)], "i int, term string").withColumn("norm", normalize(F.col("term")))
    terms = {x["i"]: x for x in df.select("i", "norm", compact(F.col("norm")).alias("compact")).collect()}
    out = [Entry(**(r | {"term": terms[i]["norm"], "compact": terms[i]["compact"]})) for i, r in enumerate(raw)]
    for e in out:
        if not e.latin and not e.compact:
            raise ValueError(f"term {e.term!r} has no letter or digit and would match every text")
    return out


def builtin_lists() -> list[Path]:
    """The files of the package's own word lists, by name."""
    return sorted((Path(__file__).parent.parent / "wordlists").glob("*.json"))


def load_lexicon(spark: SparkSession, paths: Sequence[str | Path] | None = None) -> list[Entry]:
    """S4. Files {lang, entries: [...]} as JSON (or YAML where a parser is installed); lang defaults to the file's stem.

    Without ``paths`` the package's own lists are loaded, all of them.
    """
    rows: list[dict] = []
    for path in map(Path, paths or builtin_lists()):
        text = path.read_text(encoding="utf-8")
        if path.suffix in (".yaml", ".yml"):
            import yaml

            doc = yaml.safe_load(text) or {}
        else:
            doc = json.loads(text)
        rows += [r | {"lang": doc.get("lang", path.stem)} for r in doc.get("entries", [])]
    return lexicon_entries(spark, rows)


def frame_entries(df: DataFrame) -> list[Entry]:
    """U2. Entries of a caller's table, which must be small enough for one driver: its size is checked."""
    rows = df.limit(MAX_ENTRIES + 1).collect()
    return lexicon_entries(df.sparkSession, [r.asDict() for r in rows])


def _pattern(term: str) -> str:
    return r"(?<![a-z0-9])" + re.sub(r"([^a-z0-9 ])", r"\\\1", term) + r"(?![a-z0-9])"


def _matches(e: Entry, norm: Column, comp: Column) -> Column:
    if not e.latin:
        return comp.contains(e.compact)
    # `contains` is cheap and necessary, so the pattern runs on few texts.
    hit = norm.contains(e.term) & norm.rlike(_pattern(e.term))
    return hit | (comp.contains(e.term) & comp.rlike(_pattern(e.term))) if len(e.term) >= 3 else hit


def _hit(i: int, e: Entry) -> Column:
    values = (i, e.level, e.lang, e.term, e.category, e.targeted)
    return F.struct(*[F.lit(v).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for v, f in zip(values, HIT.split(", "), strict=True)])


def lexicon_hits(entries: Sequence[Entry], norm: Column, comp: Column) -> Column:
    """J1. Array of the entries found in a text, of any language, in list order; long lists: ``with_indexed_hits``."""
    if not entries:
        return F.array().cast(_HITS)
    return F.filter(F.array(*[F.when(_matches(e, norm, comp), _hit(i, e)) for i, e in enumerate(entries)]), lambda h: h.isNotNull())


def entry_table(rows: DataFrame) -> DataFrame:
    """Entries of a table (idx, term, level, lang, category, targeted) of any length, normalized; order is that of idx.

    Terms that are neither Latin nor have a letter or digit are left out, as they would match every text.
    """
    norm = normalize(F.col("term"))
    t = rows.withColumn("term", norm).withColumns({"compact": compact(F.col("term")), "latin": F.col("term").rlike("^(?:" + _LATIN.pattern + ")$")})
    quoted = F.regexp_replace("term", "([^a-z0-9 ])", r"\\$1")
    pattern = F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))
    kinds = {f.split(" ")[0]: f.split(" ")[1] for f in HIT.split(", ")}
    return t.where(F.col("latin") | (F.col("compact") != "")).select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], "compact", "latin", pattern.alias("pattern"))


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """All different runs of so many characters; the characters are split off once."""

    def of(c: Column, q: int) -> Column:
        at = F.sequence(F.lit(0), F.size(c) - q)
        runs = F.transform(at, lambda i: F.concat(*[F.get(c, i + k) for k in range(q)]))
        return F.when(F.size(c) >= q, runs).otherwise(F.array().cast("array<string>"))

    each = F.transform(F.array(F.split(text, "")), lambda c: F.array_distinct(F.concat(*[of(c, q) for q in sizes])))
    return F.get(each, 0)


def _words(text: Column, least: int = 1, most: int | None = None) -> Column:
    """All different words of Latin letters and digits: where a Latin term is found, its words are words of the text.

    Words of other lengths than from ``least`` to ``most`` are left out.
    """
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))
    return found if most is None else F.filter(found, lambda w: F.length(w) <= most)


def indexed_hits(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """J1. (text_hash, hits) of texts (text_hash, norm, compact) with a hit, for a table of entries of any length.

    A Latin term of one word is found where the text has that word, so words are joined with words. Other Latin terms
    are filed under their rarest word, the rest under their rarest run of up to ``GRAM`` characters; what the texts have of
    these gives the few terms that may be in a text, and those are looked for by the rules of the inline path.
    """
    hit = F.struct(*[f.split(" ")[0] for f in HIT.split(", ")]).alias("hit")
    word = F.col("latin") & F.col("term").rlike(f"^{WORD}$")
    size = F.length("term")
    seen = entries.agg(F.min(F.when(word, size)).alias("least"), F.max(F.when(word, size)).alias("most"), F.count_if(~word).alias("others")).first()
    texts = texts.select("text_hash", "norm", "compact")
    parts = []
    if seen["others"]:
        texts = keep(texts.dropDuplicates(["text_hash"]), "texts")
        parts.append(_hits_of_runs(texts, entries.where(~word), hit))
    if seen["most"]:
        parts.append(_hits_of_words(texts, entries.where(word), hit, seen["least"], seen["most"]))
    if not parts:
        return texts.limit(0).select("text_hash", F.array().cast(_HITS).alias("hits"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.groupBy("text_hash").agg(F.array_sort(F.collect_set("hit")).cast(_HITS).alias("hits"))


def _hits_of_words(texts: DataFrame, entries: DataFrame, hit: Column, least: int, most: int) -> DataFrame:
    """Hits of terms that are one Latin word; those under three characters count in the normal form only."""
    # Compact forms are often one long word, which no term is.
    own = texts.select("text_hash", _words(F.col("norm"), least, most).alias("n"), _words(F.col("compact"), max(3, least), most).alias("c"))
    own = own.select("text_hash", F.explode(F.array_union("n", "c")).alias("term"))
    return own.join(entries, "term").select("text_hash", hit)


def _hits_of_runs(texts: DataFrame, entries: DataFrame, hit: Column) -> DataFrame:
    """Hits of terms that must be looked for: several words (form 2), no Latin letter or digit (0), other scripts (1)."""
    wordless = ~F.col("term").rlike(WORD)
    form = F.when(~F.col("latin"), 1).when(wordless, 0).otherwise(2)
    needles = entries.select("idx", form.alias("form"), F.when(F.col("latin"), F.col("term")).otherwise(F.col("compact")).alias("needle"))
    # A needle of at most GRAM characters is its own run; a longer one has several to choose from.
    runs = F.when(F.length("needle") > GRAM, _grams(F.col("needle"), [GRAM])).otherwise(F.array("needle"))
    own = needles.select("idx", "form", F.explode(F.when(F.col("form") == 2, _words(F.col("needle"))).otherwise(runs)).alias("gram"))

    def forms(t: DataFrame, sizes: dict[int, list[int]]) -> DataFrame:
        parts = {0: lambda q: _grams(F.col("norm"), q), 1: lambda q: _grams(F.col("compact"), q), 2: lambda q: _words(F.col("norm"), min(q), max(q))}
        each = [F.struct(F.lit(i).alias("form"), parts[i](q).alias("grams")) for i, q in sorted(sizes.items())]
        return t.select("text_hash", F.explode(F.array(*each)).alias("f")).select("text_hash", "f.form", F.explode("f.grams").alias("gram"))

    sizes: dict[int, list[int]] = {}
    for r in own.select("form", F.length("gram").alias("q")).distinct().sort("form", "q").collect():
        sizes.setdefault(r["form"], []).append(r["q"])
    often = forms(texts.limit(GRAM_SAMPLE), sizes).groupBy("form", "gram").agg(F.count("*").alias("n"))
    rarest = F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram"))
    index = keep(own.join(often, ["form", "gram"], "left").groupBy("idx", "form").agg(rarest.alias("gram")), "index")
    cands = forms(texts, sizes).join(index, ["form", "gram"]).select("text_hash", "form", "idx").distinct()
    text = F.when(F.col("form") == 1, F.col("compact")).otherwise(F.col("norm"))
    # The texts come last, so that they are sent once each and not with every term that may be in them.
    both = cands.join(entries.withColumnRenamed("compact", "__own"), "idx").join(texts, "text_hash").withColumn("__t", text)
    latin = F.expr("contains(__t, term) and regexp_like(__t, pattern)")
    return both.where(F.when(F.col("latin"), latin).otherwise(F.expr("contains(__t, __own)"))).select("text_hash", hit)


def with_indexed_hits(prepared: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds hits to rows with text_hash, norm and compact."""
    found = indexed_hits(prepared, entries)
    return prepared.join(found, "text_hash", "left").withColumn("hits", F.coalesce("hits", F.array().cast(_HITS)))


def as_table(spark: SparkSession, entries: Sequence[Entry]) -> DataFrame:
    """Entries of a list, which are normalized already, as ``entry_table`` gives them."""
    rows = [(i, e.level, e.lang, e.term, e.category, e.targeted, e.compact, e.latin, _pattern(e.term)) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, f"{HIT}, compact string, latin boolean, pattern string")


def hits_for_language(hits: Column, lang: Column) -> Column:
    """V4. Without a language (null, empty, und) all hits, else those of the language or of any."""
    free = F.coalesce(lang, F.lit("")).isin("", "und")
    return F.filter(hits, lambda h: free | (h["lang"] == lang) | (h["lang"] == "any"))


def _of_category(category: str):
    return lambda h: h["category"] == category


def lexicon_raw(hits: Column) -> dict[str, Column]:
    """L1. Raw verdict columns of the offline scorer."""
    none = F.size(hits) == 0
    most = F.array_max(F.transform(hits, lambda h: h["level"]))
    clean = F.array(*[F.lit(p) for p in (0.7, 0.2, 0.07, 0.02, 0.01)])
    dirty = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == most, F.lit(0.88)).otherwise(F.lit(0.03)))
    out = {"level_probs": F.when(none, clean).otherwise(dirty)}
    for c in CATEGORIES:
        out[f"cat_{c}"] = F.when(F.exists(hits, _of_category(c)), F.lit(0.9)).otherwise(F.lit(0.05))
    targeted = F.when(F.exists(hits, lambda h: h["targeted"]), F.lit(0.85)).otherwise(F.lit(0.1))
    out["targeted"] = F.when(none, F.lit(0.05)).otherwise(targeted)
    out["confidence"] = F.when(none, F.lit(0.3)).otherwise(F.lit(0.6))
    out["backend"] = F.lit(SCORER)
    out["input_tokens"] = F.lit(0.0)
    return out


def fuse_floor(df: DataFrame, hits: str) -> DataFrame:
    """L2. Adds reasons and lifts level, categories and targeted of a raw verdict to what the hits say."""
    h = F.col(hits)
    floor = F.array_max(F.transform(h, lambda x: x["level"]))
    lift = F.coalesce(argmax_level(F.col("level_probs")) < floor, F.lit(False))
    lifted = F.transform("level_probs", lambda p, i: p * 0.5 + F.when(i == floor, 0.5).otherwise(0.0))
    new = {"reasons": F.transform(h, lambda x: F.concat(F.lit("lexicon:"), x["lang"], F.lit(":"), x["term"])), "level_probs": F.when(lift, lifted).otherwise(F.col("level_probs"))}
    for c in CATEGORIES:
        p = F.col(f"cat_{c}")
        new[f"cat_{c}"] = F.when(F.exists(h, _of_category(c)), F.greatest(p, F.lit(0.9))).otherwise(p)
    t = F.col("targeted")
    new["targeted"] = F.when(F.exists(h, lambda x: x["targeted"]), F.greatest(t, F.lit(0.8))).otherwise(t)
    return df.withColumns(new)
