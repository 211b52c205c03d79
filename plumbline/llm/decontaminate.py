"""Operator 4: benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask keeps some positions of a short window of words and ignores the others, so a replaced word at
an ignored position doesn't hide a match. Hashes of all masked windows of the benchmark items and of
the documents are joined; a hit fixes how item and document are aligned. The words along each alignment
are then compared: an item is found if some run of ``overlap`` aligned words (the whole item if it is
shorter) has at least ``percent`` hundredths equal words.

A seed that more than ``HOT_ITEMS`` places of the benchmark share isn't joined as it is: each aligned run that
is equal enough has more equal words than a mask spans, so such a seed is extended by one word before or
after it, at each distance at which that word may stand, and again as long as the extended seed is shared by
too many. Only if the words that must be equal are used up are all places of a seed compared.

The benchmark's seeds, items and candidates are broadcast if their bytes are few; otherwise the same
joins are shuffled. Texts are lower-cased. With the default ``overlap`` and ``percent`` no set of
replaced words hides an item: the three masks leave a hit for every choice of two of 13 words, and the
short masks, which only items of 7 to 12 words use, for every choice that such an item may have.

Defined cases: null and empty texts are clean; items with fewer words than the shortest mask must
appear whole and unchanged; items without words match nothing; repeated rows each get a result, and rows
with one id are told apart by their text; ties don't arise, as every item found is named; an
empty table gives an empty result; only the named columns are read, the others are kept, and the added
ones are decontam_found, decontam_n_items and decontam_items (a column of such a name is replaced).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.quality_rules import let
from plumbline.llm.store import bytes_at_most, keep, same, text_hash, with_verdicts, words

#: Fixed masks of five words each, and those that items of 7 to 12 words need besides.
MASKS = ("1101011", "11100101", "110010011")
SHORT_MASKS, SHORT = ("11111", "1110111"), range(7, 13)
HOT_ITEMS = 32
#: Tables are broadcast up to this many bytes, which are summed over their rows.
BROADCAST_BYTES = 32 << 20


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text.cast("string"))), lambda w: F.xxhash64(w))


def seeds(h: Column, masks: tuple[str, ...]) -> Column:
    """For each mask, the hashes of all masked windows of an array of word hashes, in order."""

    def of(h: Column, mask: str) -> Column:
        kept = [i for i, c in enumerate(mask) if c == "1"]
        at = F.sequence(F.lit(0), F.size(h) - len(mask))
        values = F.transform(at, lambda i: F.xxhash64(F.lit(mask), *[F.get(h, i + k) for k in kept]))
        return F.when(F.size(h) >= len(mask), values).otherwise(F.array().cast("array<bigint>"))

    return let(h, lambda x: F.array(*[of(x, m) for m in masks]))


def exploded(df: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    """(keys, mask, pos, seed), one row for each masked window; ``mask`` is its number."""
    each = df.select(*keys, F.posexplode(seeds(F.col("h"), masks)).alias("mask", "s"))
    return each.select(*keys, "mask", F.posexplode("s").alias("pos", "seed"))


def aligned(h: Column, item: Column, diag: Column, overlap: int, percent: int) -> Column:
    """Whether some run of ``overlap`` aligned words is equal enough; item word q stands at diag + q."""
    lo = F.greatest(F.lit(0), -diag)
    hi = F.least(F.size(item), F.size(h) - diag)
    x, y = F.slice(h, diag + lo + 1, hi - lo), F.slice(item, lo + 1, hi - lo)
    equal = F.zip_with(x, y, lambda a, b: (a == b).cast("int"))
    length = F.least(F.lit(overlap), F.size(item))
    need = F.ceil(F.lit(percent) * length / 100)
    short = F.size(item) < min(map(len, MASKS))
    need = F.when(short, length).otherwise(need)
    total = lambda e, i: F.aggregate(F.slice(e, i + 1, length), F.lit(0), lambda a, b: a + b)
    found = let(equal, lambda e: F.exists(F.sequence(F.lit(0), F.size(e) - length), lambda i: total(e, i) >= need))
    return F.when(hi - lo >= length, found).otherwise(F.lit(False))


def extended(rows: DataFrame, keys: list[str], overlap: int) -> DataFrame:
    """Each row's key with one more word of its context, which stands beyond the words used so far."""
    most = overlap - 1

    def fits(o: Column) -> Column:
        outside = ((o < 0) & (o >= F.col("span") - overlap)) | (o >= F.col("span"))
        return (o > F.col("used")) & outside & F.get("ctx", o + most).isNotNull()

    further = F.filter(F.sequence(F.lit(-most), F.lit(most)), fits)
    each = F.transform(further, lambda o: F.struct(o.alias("used"), F.xxhash64("key", o, F.get("ctx", o + most)).alias("key")))
    return rows.select(*keys, "span", "ctx", F.explode(each).alias("e")).select(*keys, "span", "ctx", "e.used", "e.key")


def hot_hits(docs: DataFrame, hits: DataFrame, bench: DataFrame, items: DataFrame, masks: tuple[str, ...], overlap: int, percent: int) -> DataFrame:
    """(doc_id, th, item_id, diag) of seeds that too many items share, by extended seeds.

    ``hits`` are the documents' places of such seeds (doc_id, th, mask, pos, seed), ``bench`` the items' (item_id,
    mask, q, seed).
    """
    offsets = F.sequence(F.lit(1 - overlap), F.lit(overlap - 1))
    span = F.get(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask"))
    size = F.least(F.lit(overlap), F.size("h"))
    # Of ``size`` aligned words so many are equal, so at least that less a mask's span stand outside it.
    need = F.when(F.size("h") < min(map(len, MASKS)), size).otherwise(F.ceil(F.lit(percent) * size / 100)).cast("int")

    def placed(rows: DataFrame, at: str, keys: list[str], *more: Column) -> DataFrame:
        ctx = F.transform(offsets, lambda o: F.get("h", F.col(at) + o))
        return rows.select(*keys, span.alias("span"), F.lit(-overlap).alias("used"), F.col("seed").alias("key"), ctx.alias("ctx"), *more)

    item_keys, doc_keys = ["item_id", "q", "depth"], ["doc_id", "th", "pos"]
    i, b = items.withColumnRenamed("item", "h").alias("i"), bench.alias("b")
    i = b.join(i, same(F.col("b.item_id"), F.col("i.item_id"))).select("b.item_id", "mask", "q", "seed", "h")
    i = keep(placed(i, "q", ["item_id", "q"], (need - span).alias("depth")).select(*item_keys, "span", "used", "key", "ctx"), "hot_items")
    a, b = docs.dropDuplicates(["doc_id", "th"]).alias("a"), hits.alias("b")
    d = b.join(a, same(F.col("a.doc_id"), F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))).select("b.doc_id", "b.th", "mask", "pos", "seed", "h")
    d = keep(placed(d, "pos", doc_keys).select(*doc_keys, "span", "used", "key", "ctx"), "hot_places")
    found, level = [], 0
    out = [*doc_keys[:2], "item_id", (F.col("pos") - F.col("q")).alias("diag")]
    while True:
        found.append(d.join(i.where(F.col("depth") <= level).select("item_id", "q", "key"), "key").select(*out))
        i = keep(extended(i.where(F.col("depth") > level), item_keys, overlap), "extended")
        if i.isEmpty():
            break
        shared = keep(i.groupBy("key").agg(F.count("*").alias("n")), "shared")
        d = keep(extended(d, doc_keys, overlap).join(shared.select("key"), "key", "left_semi"), "further")
        hot = shared.where(F.col("n") > HOT_ITEMS).select("key")
        found.append(d.join(i.join(hot, "key", "left_anti").select("item_id", "q", "key"), "key").select(*out))
        i, d, level = i.join(hot, "key", "left_semi"), d.join(hot, "key", "left_semi"), level + 1
    return reduce(DataFrame.unionByName, found)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    overlap: int = 13,
    percent: int = 80,
) -> DataFrame:
    """doc_id, th (hash of the text), n_items, items of the documents in which a benchmark item is found."""
    items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("h"))
    items = keep(items.where(F.size("h") > 0).dropDuplicates(["item_id", "h"]), "items").withColumnRenamed("h", "item")
    sizes = {r["n"] for r in items.select(F.size("item").alias("n")).where(F.col("n") <= SHORT[-1]).distinct().collect()}
    tiny = sorted(n for n in sizes if n < SHORT[0])
    # Each mask with the sizes of the items that use it.
    uses = [(m, F.lit(True)) for m in MASKS]
    uses += [(m, F.col("size").between(SHORT[0], SHORT[-1])) for m in SHORT_MASKS if sizes & set(SHORT)]
    uses += [("1" * n, F.col("size") == n) for n in tiny]
    masks = tuple(m for m, _ in uses)
    bench = exploded(items.withColumnRenamed("item", "h").withColumn("size", F.size("h")), ["item_id", "size"], masks)
    bench = bench.where(reduce(or_, [(F.col("mask") == i) & fits for i, (_, fits) in enumerate(uses)]))
    text_bytes = lambda c: F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))
    bench = keep(bench.select("item_id", "mask", F.col("pos").alias("q"), "seed").distinct(), "seeds")
    hot = keep(bench.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ITEMS).select("seed"), "hot_seeds")
    few = bytes_at_most(bench, text_bytes("item_id") + 32, BROADCAST_BYTES)
    d = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("th"), word_hashes(F.col(text_col)).alias("h"))
    places = exploded(d, ["doc_id", "th"], masks)
    cold = bench.drop("mask").join(F.broadcast(hot) if few else hot, "seed", "left_anti")
    hits = places.join(F.broadcast(cold) if few else cold, "seed").select("doc_id", "th", "item_id", (F.col("pos") - F.col("q")).alias("diag"))
    if not hot.isEmpty():
        frequent = places.join(F.broadcast(hot) if few else hot, "seed").select("doc_id", "th", "mask", "pos", "seed")
        hits = hits.unionByName(hot_hits(d, keep(frequent, "frequent"), bench.join(hot, "seed", "left_semi"), items, masks, overlap, percent))
    cands = keep(hits.distinct(), "candidates")
    small = bytes_at_most(cands, text_bytes("doc_id") + 24, BROADCAST_BYTES)
    small_items = bytes_at_most(items, 8 * F.size("item") + text_bytes("item_id") + 32, BROADCAST_BYTES)
    with_items = cands.join(F.broadcast(items) if small_items else items, same(cands["item_id"], items["item_id"])).select("doc_id", "th", cands["item_id"], "diag", "item")
    ids = cands.select("doc_id", "th").distinct()
    a, b = d.alias("a"), (F.broadcast(ids) if small else ids).alias("b")
    on = same(F.col("a.doc_id"), F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
    hashed = a.join(b, on, "left_semi").dropDuplicates(["doc_id", "th"]).alias("a")
    b = with_items.alias("b")
    ok = hashed.join(b, on).where(aligned(F.col("a.h"), F.col("b.item"), F.col("b.diag"), overlap, percent))
    found = ok.groupBy("b.doc_id", "b.th").agg(F.array_sort(F.collect_set("b.item_id")).alias("found"))
    return found.select("doc_id", "th", F.size("found").cast("long").alias("n_items"), F.array_join(F.transform("found", lambda x: x.cast("string")), ",").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Every row of ``docs`` with contaminated, n_items and items added (as decontam_... columns)."""
    found = keep(contaminated(docs, benchmark, id_col, text_col, **kw), "contaminated")
    found = found.select("doc_id", "th", F.col("n_items").alias("decontam_n_items"), F.col("items").alias("decontam_items"))
    kept = [c for c in docs.columns if not c.startswith("decontam_")]
    both = with_verdicts(docs.select(*[F.col(f"`{c}`") for c in kept]), found, "left", id_col, text_col)
    return both.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("decontam_n_items").isNotNull().alias("decontam_found"),
        F.coalesce("decontam_n_items", F.lit(0)).cast("long").alias("decontam_n_items"),
        F.coalesce("decontam_items", F.lit("")).alias("decontam_items"),
    )
