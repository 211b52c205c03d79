"""Text columns: normal form, compact form, scripts, language, hashes, previews.

Everything is an expression inside the JVM, but for NFKC, which Spark lacks: a vectorized helper sees
only the texts that have characters NFKC could change.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType

from plumbline.functions import unicode as U

# Look-alike letters and what they stand for.
CYRILLIC_ALIKE = ("аеорсухкнвтмі", "aeopcyxkhbtmi")
GREEK_ALIKE = ("αβεορτυνκχι", "abeoptyvkxi")
#: The two ranges that hold these letters: most texts have none of them.
MAYBE_ALIKE = "[" + U.chars((0x3B1, 0x3C9), (0x430, 0x456)) + "]"
#: Fixed value: letters that mark Vietnamese.
VIETNAMESE = "[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"
#: Stop words by language; earlier languages win ties.
STOP_WORDS = {
    "en": "the and you your is are this that to of it for with was not have they what just",
    "es": "el la los las que de es un una por con para muy este esta y no te tu se lo",
    "fr": "le la les des est une un que qui pas vous pour sur avec tu je ne ce et",
    "de": "der die das und ist nicht ein eine ich du sie mit wird auch nur wenn",
    "pt": "o a os as que de é um uma não com para você muito mas isso",
    "it": "il la che di è un una non per con sei questo ma anche",
    "id": "yang dan di ini itu tidak dengan untuk kamu aku dari ada",
}
WORD = "[a-zà-ÿ]+"
PREVIEW = 60


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), 0)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(~text.rlike(U.NFKC_STABLE), text)), text)


def _count(text: Column, cls: str) -> Column:
    # Lengths, as counting matches would make an array of them first.
    return F.length(text) - F.length(F.regexp_replace(text, f"{cls}+", ""))


def _if_minor(text: Column, original: Column, cls: str, pair: tuple[str, str]) -> Column:
    """Translate look-alikes where their alphabet has some letters but under 0.3 of all, counted in ``original``."""
    n = _count(original, cls)
    minor = original.rlike(cls) & (n < F.lit(0.3) * _count(original, U.LETTER))
    return F.when(minor, F.translate(text, *pair)).otherwise(text)


def normalize(text: Column, use_nfkc: bool = True) -> Column:
    """T1. Canonical form for hashing and matching; null stays null."""
    t = nfkc(text) if use_nfkc else text
    t = F.lower(F.regexp_replace(t, f"[{U.ZERO_WIDTH}{U.SOFT_HYPHEN}]", ""))
    n = let(t, lambda t: F.when(t.rlike(MAYBE_ALIKE), _without_look_alikes(t)).otherwise(t))
    n = F.regexp_replace(n, r"(?s)(.)\1{3,}", "$1$1$1")
    return F.trim(F.regexp_replace(n, f"{U.SPACE}+", " "))


def _without_look_alikes(t: Column) -> Column:
    # Both shares are taken before either translation. The first one adds no Greek letters.
    return _if_minor(_if_minor(t, t, U.script_class("CYRILLIC"), CYRILLIC_ALIKE), t, U.script_class("GREEK"), GREEK_ALIKE)


def compact(norm: Column) -> Column:
    """T2. Letters and digits of a normal form."""
    return F.regexp_replace(norm, f"[^{U.LETTER_OR_DIGIT}]+", "")


def script_count(text: Column, script: str) -> Column:
    """T3. How many letters of the script the text has."""
    cls = U.script_class(script)
    return F.when(text.rlike(cls), _count(text, cls)).otherwise(0)


def _scripts_of(letters: str) -> dict[str, int]:
    out: Counter[str] = Counter()
    for ch, n in Counter(letters).items():
        out[U.script_of(ch)] += n
    return dict(out)


@F.pandas_udf(MapType(StringType(), IntegerType()))
def _rare_scripts(letters: pd.Series) -> pd.Series:
    return letters.map(_scripts_of, na_action="ignore")


def script_counts(text: Column) -> Column:
    """T3. Map of script to letter count, scripts with letters only; letters without a name count as OTHER.

    ASCII letters are Latin, and only what lies beyond ASCII is searched for scripts: those that decide a language and
    Latin are counted in the JVM; a helper sees only what letters are left of a text.
    """
    beyond = F.regexp_replace(text, f"[{U.ASCII}]+", "")

    def counts(seen: Column) -> Column:
        plain = F.coalesce(_count(seen["text"], U.ASCII_LETTER), F.lit(0))
        each = {s: script_count(seen["beyond"], s) + (plain if s == "LATIN" else 0) for s in U.SCRIPTS}
        return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(s).alias("k"), n.alias("n")) for s, n in each.items()]), lambda p: p["n"] > 0))

    known = let(F.struct(text.alias("text"), beyond.alias("beyond")), counts)
    rest = F.regexp_replace(beyond, f"[[^{U.LETTER}]{''.join(U.script_class(s) for s in U.SCRIPTS)}]+", "")
    rare = _rare_scripts(F.when(rest != "", rest))
    return F.when(rare.isNull(), known).otherwise(F.map_concat(known, rare))


def verdict_of(lang: Column | str, confidence: Column | float) -> Column:
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.struct(lang.alias("lang"), (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"))


def detect_language(text: Column) -> Column:
    """T4. struct(lang, confidence) of the raw text."""
    seen = F.struct(text.alias("text"), _count(text, U.LETTER).cast("double").alias("letters"))
    return let(seen, lambda s: F.when(s["text"].isNull(), F.lit(None)).when(s["letters"] == 0, verdict_of("und", 0.0)).otherwise(_by_script(s["text"], s["letters"])))


#: Latin letters that are letters of the Latin script by name too, and those of a lowered Vietnamese text.
COMMON_LATIN = "A-Za-z" + U.chars((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F))
_VIETNAMESE = "[ăâđêôơư" + U.chars((0x1EA0, 0x1EF9)) + "]"


def _by_script(text: Column, letters: Column) -> Column:
    words = let(F.lower(text), lambda low: F.when(low.rlike(_VIETNAMESE), verdict_of("vi", 0.9)).otherwise(let(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), _by_stop_words)))
    counts = F.struct(*[script_count(text, s).alias(s) for s in U.SCRIPTS])

    def decide(n: Column) -> Column:
        kana = n["HIRAGANA"] + n["KATAKANA"]
        out = F.when(kana > 0, verdict_of("ja", F.least(F.lit(1.0), F.lit(0.6) + kana / letters)))
        for script, lang in U.SCRIPT_LANGS.items():
            if lang != "ja":
                share = n[script] / letters
                out = out.when(share >= F.lit(0.3), verdict_of(lang, F.least(F.lit(1.0), F.lit(0.5) + share / 2)))
        return out.when(n["LATIN"] / letters < F.lit(0.5), verdict_of("und", 0.0)).otherwise(words)

    # Most texts have common Latin letters only: one search tells.
    return F.when(text.rlike(f"[{U.LETTER}&&[^{COMMON_LATIN}]]"), let(counts, decide)).otherwise(words)


def _one_of(values: list[str]):
    return lambda w: w.isin(values)


def _by_stop_words(words: Column) -> Column:
    langs = F.array(*[F.lit(x) for x in STOP_WORDS])
    every = sorted({w for s in STOP_WORDS.values() for w in s.split()})

    def best(h: Column) -> Column:
        most = F.array_max(h)
        lang = F.when(most == 0, F.lit("en")).otherwise(F.element_at(langs, F.array_position(h, most).cast("int")))
        conf = F.when(most == 0, F.lit(0.2)).otherwise(F.least(F.lit(1.0), F.lit(0.4) + most / F.size(words)))
        return verdict_of(lang, conf)

    # Stop words of any language first: the seven counts then read a short list.
    counts = lambda stops: F.array(*[F.size(F.filter(stops, _one_of(s.split()))) for s in STOP_WORDS.values()])
    decided = let(let(F.filter(words, _one_of(every)), counts), best)
    return F.when(F.size(words) == 0, verdict_of("und", 0.0)).otherwise(decided)


def resolve_language(given: Column, text: Column, detect: bool = True) -> Column:
    """T5. The given language if there is one, else the detected one, else ``und``."""
    return F.coalesce(F.nullif(given, F.lit("")), detect_language(text)["lang"] if detect else F.lit("und"))


def text_hash(norm: Column) -> Column:
    """T6."""
    return F.substring(F.sha2(norm, 256), 1, 16)


def cache_key(scorer: Column, rubric_version: Column, hash_: Column) -> Column:
    """T7, as one string; tables keep the three parts as columns."""
    return F.concat_ws("|", scorer, rubric_version, hash_)


def display_clean(text: Column) -> Column:
    """T8."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"{U.BROWSER_SPACE}+", " ")
    return F.trim(F.regexp_replace(t, r"^\+[0-9]+ ", ""))


def client_key(text: Column, use_nfkc: bool = True) -> Column:
    """T9. A weaker normal form: no look-alikes, no repeats, the soft hyphen stays."""
    t = F.regexp_replace(nfkc(text) if use_nfkc else text, f"[{U.ZERO_WIDTH}]", "")
    return F.trim(F.regexp_replace(F.lower(t), f"{U.BROWSER_SPACE}+", " "))


def item_id(given: Column, position: Column) -> Column:
    """T10."""
    return F.coalesce(F.nullif(given, F.lit("")), position.cast("string"))


def preview(text: Column, most: int = PREVIEW) -> Column:
    """S8."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
