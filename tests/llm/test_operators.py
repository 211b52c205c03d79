"""Every operator against a plain version, and on empty and awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate as decontaminate_module
from plumbline.llm import chat_format, kernel, line_dedup, lm_scoring, near_dedup, pii, substring_dedup
from plumbline.llm.chat_format import repair_roles
from plumbline.llm.components import connected_components
from plumbline.llm.decontaminate import decontaminate
from plumbline.llm.fm_index import FMIndex
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.lm_scoring import lm_scores
from plumbline.llm.mixing import mix_sources, source_targets
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.pii import personal_data
from plumbline.llm.quality_classifier import gumbel, quality_classifier
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.store import keep
from plumbline.llm.substring_dedup import dedup_passages
from tests.llm import brute

CORPUS, LABELS, ITEMS = brute.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, brute.DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_op1_measures_and_host_verdicts(spark, docs):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for d, t, *_ in CORPUS:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(t), d
    bad_host = [(i, "x y", "en", "bad", 3) for i in range(1000, 1040)] + [(2000, " ".join(f"w{i}" for i in range(60)), "en", "bad", 9), (2001, " ".join(f"w{i}" for i in range(60)), "en", None, 9)]
    r = {x.doc_id: x for x in quality_rules(docs.union(spark.createDataFrame(bad_host, brute.DOCS))).collect()}
    assert not r[2000].kept and not r[2000].base_failed and r[2000].host_rate > 0.5 and r[2001].kept and r[2001].host_rate is None
    assert sum(x.kept for x in r.values() if x.doc_id < 1000) == sum(not x.base_failed for x in got.values())


def test_op2_counts_scores_and_both_paths(docs):
    want, n = brute.lm_base(CORPUS)
    a = {r.doc_id: r for r in lm_scores(docs).collect()}
    b = {r.doc_id: r for r in lm_scores(docs, max_filter_bytes=0, max_dictionary=5).collect()}
    for d in want:
        for r in (a[d], b[d]):
            assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[d][:2], n)
            assert r.base_score == pytest.approx(want[d][2], abs=1e-6)
        # The filter may give a gram a higher level than it has, in about one case of a hundred.
        assert abs(a[d].score - b[d].score) <= 0.15 * abs(b[d].score) + 2
    assert sum(r.score for r in a.values()) == pytest.approx(sum(r.score for r in b.values()), rel=0.01)
    held = [r for r in a.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op2_size_of_the_filter_changes_no_score(spark, docs):
    a = {r.doc_id: r.score for r in lm_scores(docs).collect()}
    b = {r.doc_id: r.score for r in lm_scores(docs.repartition(3), max_filter_bytes=0).collect()}
    assert b == pytest.approx(a, abs=1e-9) and len(a) == len(CORPUS)
    # Pairs seen once count: a text scores better than one of the same words in another order.
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(40)] + [(100 + i, f"e{i} d{i} c{i} b{i} a{i}") for i in range(40)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    got = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    unseen = [got[i + 100] for i in range(40) if i + 100 in held and i not in held]
    assert unseen and max(unseen) < min(got[i] for i in range(40) if i not in held)


def test_op2_sends_no_filter_through_the_driver(spark, docs, monkeypatch):
    want = {r.doc_id: r for r in lm_scores(docs).collect()}

    def no(*args):
        raise AssertionError("nothing of the model may pass through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", no)
    monkeypatch.setattr(type(docs), "toArrow", no)
    assert len(lm_scores(docs).limit(3).take(3)) == 3
    # Chunks of any size give the same; a text longer than a chunk is one.
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 300)
    got = {r.doc_id: r for r in lm_scores(docs.repartition(3)).collect()}
    assert got == want and len(got) == len(CORPUS)


def test_op2_numbers_and_pairs_as_sent():
    for most in (0, 1, 255, 256, 70_000, 2**33):
        x = np.array([0, most // 2, most])
        assert (lm_scoring.wide(lm_scoring.slim(x), 3) == x).all()
    for bits in (6, 13, 20):
        h = np.sort(lm_scoring.cut_pairs(kernel.mix(np.arange(5000, dtype=np.uint64)), bits))
        cut = lm_scoring.range_cuts(h, bits)
        full = np.flatnonzero(np.diff(cut)).tolist()
        parts = [lm_scoring.read_pairs(lm_scoring.sent_pairs(h[cut[i] : cut[i + 1]], bits), i, bits) for i in full]
        assert (np.concatenate(parts) == h).all() and len(np.unique(h)) == 5000


def test_op2_against_a_plain_model(docs):
    want = brute.lm_scores(CORPUS)
    got = {r.doc_id: (r.n_tokens, r.score) for r in lm_scores(docs).collect()}
    off = []
    for d, (n, score) in want.items():
        assert got[d][0] == n
        off.append(abs(got[d][1] - score) / n)
    # Only wrong answers of the filter, about one probe in a hundred, make a difference.
    assert sum(off) / len(off) < 0.03 and max(off) < 0.3


def test_op3_base_spans_and_model(docs):
    rnd = random.Random(1)
    for k in range(6000):
        t = "".join(rnd.choice("12. 9@a-" if k % 3 else "0123456789@..--+ ()aZ%_\n1234") for _ in range(rnd.randint(0, 45)))
        assert pii.base_spans(t) == brute.pii(t), repr(t)
    for r in personal_data(docs).collect():
        base = brute.pii(CORPUS[r.doc_id][1])
        text = ",".join(f"{k}:{s}:{e}" for k, v in base.items() for s, e in v)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(",")) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in base.values()]


def luhn_card(rnd):
    body = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


def random_island(rnd):
    ip = ".".join(str(rnd.randint(1, 255)) for _ in range(4))
    digits = "".join(rnd.choice("0123456789") for _ in range(10))
    return rnd.choice((f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}", ip, luhn_card(rnd), f"me{digits[:2]}@mail{digits[3]}.example.com", f"v{digits[:1]}.0", digits[:6]))


def test_op3_model_on_held_out_islands():
    rnd = random.Random(4)
    weights = pii.train([random_island(rnd) for _ in range(300)])
    right = total = 0
    for _ in range(200):
        for text, truth in pii.rewritten(random_island(rnd)):
            borders, cands = pii.candidates(text, 0, len(text))
            got = {(cands[c][2], borders[cands[c][0]], borders[cands[c][1]]) for c in pii.best_segments(len(borders) - 1, cands, weights)}
            right += got == {(k, *s) for k, v in truth.items() for s in v}
            total += 1
    assert right / total > 0.95
    base, extra = pii.find_spans("call (743) 555-3824 now", weights)
    assert not base["phone"] and extra["phone"] == [(5, 19)]


def test_op3_sums_and_best_path_against_every_segmentation():
    rnd = random.Random(7)
    weights = pii.train([random_island(rnd) for _ in range(200)])
    for _ in range(60):
        text = " ".join(random_island(rnd) for _ in range(2))[: rnd.randint(8, 34)]
        borders, cands = pii.candidates(text, 0, len(text))
        scores = [sum(weights.get(x, 0.0) for x in f) for *_, f in cands]

        def every(at):
            """All ways to pick segments from border ``at`` on, as tuples of candidates."""
            if at == len(borders) - 1:
                return [()]
            return every(at + 1) + [(c, *rest) for c, (i, j, *_) in enumerate(cands) if i == at for rest in every(j)]

        if len(cands) > 40:
            continue
        ways = every(0)
        weight = [math.exp(sum(scores[c] for c in w)) for w in ways]
        log_z, chance = pii.segment_chances(len(borders) - 1, cands, scores)
        assert log_z == pytest.approx(math.log(sum(weight)), abs=1e-9)
        for c, p in enumerate(chance):
            assert p == pytest.approx(sum(x for x, w in zip(weight, ways) if c in w) / sum(weight), abs=1e-9)
        got = pii.best_segments(len(borders) - 1, cands, weights)
        assert sum(scores[c] for c in got) == pytest.approx(max(sum(scores[c] for c in w) for w in ways), abs=1e-9)


def test_op3_long_words_and_many_addresses_take_linear_time():
    import time

    rnd = random.Random(3)
    old = re.compile(r"[^\s]*[0-9@][^\s]*(?: [^\s]*[0-9@][^\s]*)*")
    for _ in range(3000):
        t = "".join(rnd.choice("ab 1@\n  .x9") for _ in range(rnd.randint(0, 40)))
        assert [m.span() for m in old.finditer(t)] == list(pii.island_spans(t)), repr(t)
    weights = pii.train([random_island(rnd) for _ in range(100)])
    for text, n in (("x" * 1_000_000 + " 1", 0), ("1" * 1_000_000, 0), (" ".join(f"me{i}@host{i}.example.com" for i in range(20_000)), 20_000)):
        began = time.perf_counter()
        base, _ = pii.find_spans(text, weights)
        assert time.perf_counter() - began < 30 and len(base["email"]) == n


def test_op3_sample_holds_different_islands(spark):
    rows = [(i, "call +1 (743) 555-3824 now") for i in range(50)] + [(100 + i, f"v{i}.{i}.{i} seen") for i in range(20)]
    out = personal_data(spark.createDataFrame(rows, "doc_id long, text string"), max_islands=5).collect()
    assert len(out) == 70 and all(r.n_phone == (r.doc_id < 50) for r in out)


def test_op4_against_all_alignments(docs, benchmark):
    got = {r.doc_id: r.decontam_items for r in decontaminate(docs, benchmark).collect() if r.decontam_found}
    assert got == brute.contaminated(CORPUS, ITEMS) and len(got) >= 5


def test_op4_every_choice_of_replaced_words(spark):
    """Items of 7 to 16 words, each with every set of as many replaced words as the rule allows (and one more)."""
    docs, items = [], []
    for n in range(1, 17):
        words = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        size = min(n, 13)
        wrong = 0 if n < 7 else size - -(-80 * size // 100)
        for k in (wrong, wrong + 1):
            for bad in itertools.islice(itertools.combinations(range(n), k), 700):
                docs.append((len(docs), "before it " + " ".join(f"x{i}" if i in bad else w for i, w in enumerate(words)) + " and after"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.decontam_items for r in decontaminate(d, b).collect() if r.decontam_found}
    assert got == brute.contaminated(docs, items) and len(got) > 300


def test_op4_seeds_that_many_items_share(spark, monkeypatch):
    rnd = random.Random(5)
    opening = [f"o{i}" for i in range(8)]
    items = [(i, " ".join(opening + [f"i{i}w{k}" for k in range(12)])) for i in range(1500)]
    docs = [(i, " ".join(opening + [f"d{i}w{k}" for k in range(20)])) for i in range(600)]
    for n in range(60):  # a run of 13 words with the opening, two of them replaced
        w = items[n * 20][1].split()
        for k in rnd.sample(range(13), 2):
            w[k] = "z"
        docs.append((1000 + n, " ".join(["x"] * (n % 3) + w[:13] + ["y"] * 5)))
    docs.append((2000, " ".join(opening)))
    kept = {}

    def kept_as(df, name):
        kept[name] = keep(df, name)
        return kept[name]

    monkeypatch.setattr(decontaminate_module, "keep", kept_as)
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("decontam_found").collect()
    assert {r.doc_id: r.decontam_items for r in found} == {1000 + n: str(n * 20) for n in range(60)}
    assert kept["candidates"].count() < 10_000


@pytest.mark.parametrize("hot", [0, 2])
def test_op4_every_seed_extended(spark, docs, benchmark, monkeypatch, hot):
    monkeypatch.setattr(decontaminate_module, "HOT_ITEMS", hot)
    test_op4_against_all_alignments(docs, benchmark)
    test_op4_every_choice_of_replaced_words(spark)


def test_op5_packed_prefixes_and_sketches():
    rnd = random.Random(5)
    packed = pa.array([b"", np.array([7, 2**32 - 1], np.uint32).tobytes(), b"", np.array([3], np.uint32).tobytes()], pa.binary())
    for column, want, ends in ((packed, [7, 2**32 - 1, 3], [0, 0, 2, 2, 3]), (packed.slice(2), [3], [0, 0, 1]), (packed.slice(0, 0), [], [0])):
        words, at = line_dedup.prefix_words(column)
        assert words.tolist() == want and at.tolist() == ends
    sets = [[rnd.getrandbits(64) for _ in range(rnd.randint(1, 60))] for _ in range(40)]
    sets += [[w for w in x if rnd.random() < 0.9] or x for x in sets]
    n = np.array([len(x) for x in sets])
    bits = np.array([np.bitwise_xor.reduce(np.uint64(1) << (np.array(x, np.uint64) & np.uint64(63))) for x in sets])
    x, y = (v.ravel() for v in np.meshgrid(np.arange(80), np.arange(80)))
    for percent in (50, 80, 97, 100):
        need = -(-percent * (n[x] + n[y]) // (100 + percent))
        want = line_dedup.bit_count(bits[x] ^ bits[y]) <= n[x] + n[y] - 2 * need
        assert line_dedup.similar_sketches(n, bits, {}, np.ones(80, int), x, y, percent).tolist() == np.flatnonzero(want).tolist()


def test_op5_against_all_pairs_and_in_small_steps(docs, monkeypatch):
    gone = brute.removed_lines(CORPUS)
    for first, hot in ((2, 50_000), (1, 3)):
        monkeypatch.setattr(line_dedup, "FIRST", first)
        monkeypatch.setattr(line_dedup, "HOT_WORD", hot)
        for r in dedup_lines(docs).collect():
            text, out = CORPUS[r.doc_id][1], gone.get(r.doc_id, [])
            assert r.line_dedup_numbers == ",".join(map(str, out)), r.doc_id
            want = text if not out else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
            assert r.text == want and r.line_dedup_lines == sum(bool(brute.words(x)) for x in (text or "").split("\n"))


@pytest.mark.parametrize("order", ["as given", "reversed", "shuffled"])
def test_op5_later_lines_of_neighbouring_sizes(spark, order):
    rnd = random.Random(5)
    line = [f"w{i}" for i in range(23)]
    # Shorter and longer versions of document 1; few of them are alike among themselves.
    rows = [(1, " ".join(line))]
    for i in range(2, 62):
        left = sorted(set(line) - set(rnd.sample(line, 3 if i < 32 else 1)))
        rows.append((i, " ".join(left + [f"n{i}x{j}" for j in range(2 if i < 32 else 4)])))
    gone = brute.removed_lines(rows)
    assert sorted(gone) == list(range(2, 62))
    if order != "as given":
        rows = rows[::-1] if order == "reversed" else rnd.sample(rows, len(rows))
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string")
    assert {r.doc_id for r in dedup_lines(d).collect() if r.line_dedup_removed} == set(gone)


def test_op5_one_copy_of_repeated_rows_stays(spark):
    text = "some words of a line\n\nother things said there\nlast one"
    rows = [(1, text)] * 3 + [(1, "a text under the same id"), (2, "before the\nothers"), (3, text + "\nand this is new"), (None, "no id here")] + [(None, "no id here")]
    got = dedup_lines(spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted(r.text for r in got if r.doc_id == 1) == sorted(["", "", "a text under the same id", text])
    assert sorted(r.line_dedup_numbers for r in got if r.doc_id == 1) == ["", "", "0,2,3", "0,2,3"]
    assert sorted(r.text for r in got if r.doc_id is None) == ["", "no id here"]
    assert [r.text for r in got if r.doc_id == 3] == ["\nand this is new"] and [r.text for r in got if r.doc_id == 2] == ["before the\nothers"]


@pytest.mark.parametrize("window,shard,levels,long", [(35, 400_000, 4, 1 << 22), (35, 150, 1, 64), (12, 60, 2, 20), (12, 1, 0, 1 << 22)])
def test_op6_against_all_windows_in_small_shards_and_stretches(docs, monkeypatch, window, shard, levels, long):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring_dedup, "LEVELS", levels)
    monkeypatch.setattr(substring_dedup, "LONG", long)
    want = brute.without_repeats(CORPUS, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_passages(docs, window=window).collect()} == want


def test_op6_minimizers_of_stretches_are_those_of_the_whole(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(4)
    h = kernel.mix(rnd.integers(0, 50, 4_000).astype(np.uint64))
    for first in (np.array([0, 4_000]), np.array([0, 100, 110, 110, 2_500, 4_000])):
        monkeypatch.setattr(substring_dedup, "LONG", 1 << 22)
        whole = substring_dedup.window_minimizers(h, first, 12, 8)
        monkeypatch.setattr(substring_dedup, "LONG", 300)
        cut = substring_dedup.window_minimizers(h, first, 12, 8)
        assert (whole[0] == cut[0]).all() and (whole[2] == cut[2]).all()


def test_fm_index_counts():
    import numpy as np

    rnd = np.random.default_rng(3)
    seqs = [rnd.integers(0, 3, rnd.integers(1, 40)) for _ in range(30)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    index = FMIndex(np.concatenate(seqs), first)
    # With weights, sequences that are there several times repeat as a whole.
    weights = rnd.choice([1, 1, 1, 2, 5], len(seqs))
    weighted = FMIndex(np.concatenate(seqs), first, weights)
    for window in (4, 9):
        seen = {}
        for s, x in enumerate(seqs):
            for i in range(len(x) - window + 1):
                seen.setdefault(tuple(x[i : i + window]), []).append((s, i))
        for one, times in ((index, np.ones(len(seqs), int)), (weighted, weights)):
            got = {(s, i) for s, lo, hi in one.repeated(np.arange(len(seqs)), window) for i in range(lo, hi)}
            assert got == {(s, i + k) for v in seen.values() if sum(times[s] for s, _ in v) > 1 for s, i in v for k in range(window)}


def test_op7_costs_are_least_and_rendering_is_undone(spark):
    rnd = random.Random(2)
    data = {c: [(i, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rnd.choice(["hi", "<|end|>", "a\\b", "\\<\\|x", None, ""])) for i in range(rnd.randint(1, 7))] for c in range(60)}
    rows = [(c, *x) for c, v in data.items() for x in v]

    def least(roles):
        best = 10**9
        for qs in itertools.product(range(3), repeat=len(roles)):
            s, cost = chat_format.START, 0
            for r, x in zip(roles, qs):
                step = chat_format.STEPS.get((s, x))
                cost, s = (cost + step[0] + chat_format.RELABEL * (r != chat_format.ROLES[x]), x) if step else (10**9, x)
            best = min(best, cost + chat_format.INSERT * len(chat_format.CLOSING[s]))
        return best

    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (20_000, 7):
        by = {}
        for r in repair_roles(t, block_rows=block).collect():
            by.setdefault(r.conv_id, []).append(r)
        assert sum(map(len, by.values())) == len(rows)
        for c, rs in by.items():
            rs.sort(key=lambda r: r.turn)
            cost = sum(chat_format.MERGE * ("merge" in r.action) + chat_format.RELABEL * ("relabel" in r.action) + chat_format.INSERT * r.n_inserted for r in rs)
            assert cost == least([x[1] for x in data[c]])
            parts = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", "".join(r.rendered for r in rs), re.DOTALL)
            roles = [p[0] for p in parts if p[0] != "system"]
            assert roles == ["user", "assistant"] * (len(roles) // 2) and roles
            said = "".join(chat_format.unescaped(p[1]).replace("\n", "") for p in parts)
            assert said == "".join((x[2] or "") for x in data[c])


def test_op7_result_is_the_same_wherever_blocks_are_cut(spark):
    rnd = random.Random(12)
    data = {0: ["user", "assistant", "tool", "user", "assistant"]}
    data |= {c: [rnd.choice(["system", "user", "user", "assistant", "tool", None]) for _ in range(rnd.choice((3, 10, 40, 150)))] for c in range(1, 25)}
    rows = [(c, i, r, f"t{i}") for c, v in data.items() for i, r in enumerate(v)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    had = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n, block in (("1", 10**6), ("5", 10**6), ("50", 10**6), ("1", 7), ("1", 1)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(tuple(r) for r in repair_roles(t, block_rows=block).drop("role").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert all(x == seen[0] for x in seen)
    # One block is plain dynamic programming over the whole conversation.
    for c, roles in data.items():
        want = [chat_format.ROLES[q] for _, q in chat_format.path(roles, chat_format.AT_START, None)]
        assert [r[2] for r in seen[0] if r[0] == c] == want


def test_op7_very_long_texts_and_equal_turns(spark):
    text = "word <|end|> \\ " * 60_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (2, 5, "user", "x"), (2, 5, "user", "x"), (2, 5, "assistant", "y")]
    out = repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    whole = "".join(r.rendered for r in sorted(out, key=lambda r: r.turn) if r.conv_id == 1)
    assert whole == "".join(chat_format.opened(q) + chat_format.escaped(text) + chat_format.CLOSED for q in (1, 2))
    assert len(out) == 5 and {r.n_inserted for r in out if r.conv_id == 1} == {0}


def test_op8_against_all_pairs(docs):
    for k in (4, 5):
        want = brute.groups(CORPUS, k)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, k=k).collect()} == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def family(rnd, n, size=60):
    """Versions of one text that differ in one to twelve words: some links are near the threshold, some below."""
    base = [f"b{i}" for i in range(size)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.choice((1, 1, 2, 3, 4, 6, 12))):
            w[rnd.randrange(size)] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("shingles", [500_000, 2_000, 300])
def test_op8_families_around_the_threshold_in_blocks(spark, monkeypatch, shingles):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    rnd = random.Random(6)
    rows = family(rnd, 150) + [(1000 + i, t) for i, t in family(rnd, 40, 25)]
    rnd.shuffle(rows)
    want = brute.groups(rows, 4)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(d, k=4).collect()} == want
    assert 5 < len({c for _, c in want.values()}) < 150


def test_op8_links_across_components_need_no_first_round(spark):
    rnd = random.Random(9)
    rows = family(rnd, 120, 300)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    s = near_dedup.signatures(d, 4).select(F.col("doc_id").alias("rep"), "n", F.posexplode("bands").alias("at", "band"))
    links = near_dedup.links_across(s.withColumn("comp", F.col("rep")), d, 4, 80, near_dedup.loose_bound(80)).collect()
    component = {r.node: r.component for r in connected_components(spark.createDataFrame(links)).collect()}
    want = brute.groups(rows, 4)
    assert all(component.get(i, i) == c for i, (_, c) in want.items())
    # Links between components, not all pairs that are alike.
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for _, t in rows for w in [t.split()]]
    alike = sum(100 * len(x & y) >= 80 * len(x | y) for x, y in itertools.combinations(sets, 2))
    assert 4 * len(links) < alike


def test_components_of_a_chain_a_star_and_a_clique(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + list(itertools.combinations(range(200, 208), 2)) + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 208)}


def test_op9_rejects_planted_documents(docs, labels):
    got = {r.doc_id: r for r in quality_classifier(docs, labels).collect()}
    bad = [i for i, q, t in LABELS if (not q or t) and CORPUS[i][1]]
    good = [i for i, q, t in LABELS if q and not t]
    assert sum(not got[i].kept for i in bad) >= 0.9 * len(bad) and sum(got[i].kept for i in good) >= 0.95 * len(good)
    again = {r.doc_id: (r.key, r.kept) for r in quality_classifier(docs.repartition(7), labels).collect()}
    assert again == {d: (r.key, r.kept) for d, r in got.items()}
    assert all(r.kept for r in quality_classifier(docs, labels.limit(0)).collect())


def test_op9_log_weights_against_plain_counts(docs, labels):
    kw = {"alpha": 0.5, "margin": 0.1, "prior": 20.0, "temperature": 1.0}
    half = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)) == 0).collect()}
    target = [i for i, q, t in LABELS if q and not t and i in half]
    want = brute.log_weights(CORPUS, target, 1 << 22, **kw)
    got = {r.doc_id: (r.n_features, r.log_weight) for r in quality_classifier(docs, labels, n_buckets=1 << 22, **kw).collect()}
    # Some of the tens of thousands of grams share a bucket of four million.
    off = [abs(got[d][1] - w) for d, (_, w) in want.items()]
    assert all(got[d][0] == n for d, (n, _) in want.items()) and max(off) < 0.02 and sum(off) / len(off) < 0.001
    assert max(abs(w) for _, w in want.values()) > 0.3


def test_op9_draws_k_by_weight(spark, docs, labels):
    import numpy as np

    out = quality_classifier(docs, labels, k=60).collect()
    assert sum(r.kept for r in out) == 60 and min(r.key for r in out if r.kept) > max(r.key for r in out if not r.kept)
    # Inclusion rates over many seeds are those of Gumbel top-k on the same weights.
    n, k, seeds = 120, 30, 300
    weights = np.linspace(-3, 3, n)
    rows = spark.range(n).crossJoin(spark.range(seeds).withColumnRenamed("id", "seed"))
    keys = np.zeros((seeds, n))
    for r in rows.select("id", "seed", gumbel(F.col("id"), F.col("seed")).alias("g")).collect():
        keys[r.seed, r.id] = r.g
    rate = lambda g: np.mean(np.argsort(np.argsort(-(weights + g), axis=1), axis=1) < k, axis=0)
    expected = rate(np.random.default_rng(1).gumbel(size=(20_000, n)))
    assert np.abs(rate(keys) - expected).max() < 0.13 and np.abs(rate(keys) - expected).mean() < 0.03


def test_op10_targets_and_taken(docs):
    got = mix_sources(docs).collect()
    size = {d: len(brute.words(t)) for d, t, *_ in CORPUS}
    source = {d: s for d, _, _, s, _ in CORPUS}
    totals = {}
    for d, n in size.items():
        totals[source[d]] = totals.get(source[d], 0) + n
    want = brute.targets(totals)
    taken = dict.fromkeys(totals, 0)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], totals[source[r.doc_id]]) and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(size.values()) / 2 + 1 for s in totals) and len(got) == len(CORPUS)
    assert sorted(got) == sorted(mix_sources(docs.repartition(5)).collect())


def test_op10_targets_of_many_sources_with_equal_sizes(spark):
    rnd = random.Random(5)
    totals = {f"s{i:04}": rnd.choice([0, 1, 5, 5, 5, 40, 900]) for i in range(700)} | {None: 30}
    rows = spark.createDataFrame(list(totals.items()), "source string, source_size long").repartition(5)
    got = source_targets(rows).collect()
    want = brute.targets(totals)
    assert len(got) == 701 and all(r.target == pytest.approx(want[r.source]) for r in got)
    assert any(r.target == 3 * r.source_size for r in got) and any(r.target < 3 * r.source_size for r in got)
    assert all(r.whole * r.source_size + r.rest == pytest.approx(r.target) and 0 <= r.whole <= 3 for r in got)


def test_op10_ids_that_repeat_share_the_boundary_hash(spark):
    rows = [(None, " ".join(["w"] * (i % 7)), "a") for i in range(400)] + [(i, "x y z", "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    a = [r for r in got if r.doc_id is None]
    assert len(got) == 450 and len(a) == 400 and abs(sum(r.taken for r in a) - a[0].target) <= 4
    assert sorted(map(repr, got)) == sorted(map(repr, mix_sources(docs.repartition(6)).collect()))


def test_word_hashes_tell_words_apart():
    import numpy as np
    import pyarrow as pa

    texts = ["a b\tab  a\x0bb", None, "", "é\x85é \x1c x" * 3, "A a", "x" * 600_000 + " y"]
    seen = {}
    for i, j, buf, offs in kernel.pieces(pa.array(texts), 16):
        s, e, first = kernel.word_bounds(buf, offs)
        h = kernel.span_hashes(buf, s, e)
        for row in range(j - i):
            w = brute.words(texts[i + row])
            assert len(w) == first[row + 1] - first[row]
            for x, y in zip(w, h[first[row] : first[row + 1]].tolist()):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen) and np.uint64 is kernel.U64


# --- empty and awkward tables ------------------------------------------------------------------------

EXTRA = ("n_words", "kept", "size", "taken", "th", "host", "h", "spans", "score", "bucket", "rep", "rid", "key", "items")
OPERATORS = {
    "rules": lambda d, lab, b: quality_rules(d),
    "lm": lambda d, lab, b: lm_scores(d),
    "pii": lambda d, lab, b: personal_data(d),
    "decontaminate": lambda d, lab, b: decontaminate(d, b),
    "lines": lambda d, lab, b: dedup_lines(d),
    "passages": lambda d, lab, b: dedup_passages(d),
    "near": lambda d, lab, b: near_duplicates(d),
    "classifier": lambda d, lab, b: quality_classifier(d, lab),
    "mix": lambda d, lab, b: mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, labels, benchmark, name):
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [(None, "a b c", None, None, None), (None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n ", None, "s", 3)]
    rows += [(4, long_text, "en", None, 1), (5, "same words here " * 20, "en", "s", 1), (5, "same words here " * 20, "en", "s", 1), (5, "another text with this id", "en", "t", 1), (6, "same words here " * 20, "en", "t", 1)]
    d = spark.createDataFrame(rows, brute.DOCS)
    for c in EXTRA:
        d = d.withColumn(c, F.lit("clash"))
    out = OPERATORS[name](d, labels, benchmark).collect()
    assert len(out) == len(rows)
    if name == "near":
        assert {r.doc_id: r.component_id for r in out if r.doc_id in (1, 2, 5, 6)} == {1: 1, 2: 2, 5: 5, 6: 5} and all(r.kept for r in out if r.doc_id is None)
    if name == "lines":
        assert all(r.n_words == "clash" for r in out) and [r.text for r in out if r.doc_id == 6] == [""]
    empty = OPERATORS[name](d.limit(0), labels, benchmark.limit(0))
    assert empty.collect() == [] and len(empty.columns) >= 4


def test_awkward_conversations(spark):
    rows = [(None, None, None, None), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, None, "tool", None), (2, 1, "assistant", "")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash")).withColumn("seq", F.lit("clash"))
    out = repair_roles(t).collect()
    assert len(out) == 5 and sorted(r.action for r in out if r.conv_id == 1) == ["keep", "relabel", "relabel"]
    assert repair_roles(t.limit(0)).collect() == []
