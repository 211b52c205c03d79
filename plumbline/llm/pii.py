"""Operator 3: personal data by rules and a semi-Markov conditional random field.

Four rules give the base spans of each kind. Around them a semi-Markov model reads islands: runs of
neighbouring words that hold a digit or an ``@``. Every run of at most ``MAX_ATOMS`` atoms (digit runs,
letter runs, single marks) is a candidate segment of each kind; features of the whole span give its
score, and dynamic programming over the atoms picks boundaries and kinds together. Its segments are
added where they meet no base span, so the base spans always stay.

The weights are trained here, by the likelihood of the field: forward and backward sums over all
segmentations give the expected features of an island, and ``EPOCHS`` passes of gradient steps bring them
to those of the truth, with a small quadratic penalty. The truth is the base spans, and rewritten forms of
them, of a bounded sample: at most ``max_islands`` different islands, those with the smallest hashes. The
work of a text is linear in its length.

Defined cases: a null or empty text has no spans; repeated rows each get a result; words of any length
are read whole; among segmentations of equal score that with the earlier end of its last segment is taken,
and no segment that adds nothing; an empty table gives an empty result; only the two named columns are
read, and the result has doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_model_spans, so
other columns may have any name. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 12
#: Passes over the sample, first step, and the penalty of a squared weight.
EPOCHS, RATE, PENALTY = 30, 0.5, 1e-4
Span = tuple[int, int]

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd = [ord(c) - 48 for c in digits[::-1]]
    return sum(odd[::2]) % 10 == sum(d * 2 - 9 * (d > 4) for d in odd[1::2]) * -1 % 10


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost matches of each kind that don't overlap; what fails a kind's check is dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            done = m.end()
            out["email"].append((start, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 37 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def island_spans(text: str) -> Iterator[Span]:
    """Runs of words that hold a digit or an ``@``, with single blanks between them; every character is read once."""
    lo, hi = -1, -1
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start > hi + 1 and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, m.end())
        end = space.start() if space else len(text)
        if start == hi + 1 and lo >= 0 and text[hi] == " ":
            hi = end
        else:
            if lo >= 0:
                yield lo, hi
            lo, hi = start, end
        m = _MARK.search(text, end)
    if lo >= 0:
        yield lo, hi


# --- the semi-Markov model -------------------------------------------------------------------------


def features(text: str, start: int, end: int, kind: str, digits: str) -> list[str] | None:
    """Features of a whole span as one kind; None if it can't be of the kind at all."""
    span = text[start:end]
    n = len(digits)
    out = [kind]
    if kind == "email":
        local, _, domain = span.partition("@")
        parts = domain.split(".")
        if not local or len(parts) < 2 or not all(parts) or not parts[-1].isalpha():
            return None
        out += [f"email:parts{min(4, len(parts))}", f"email:tld{min(6, len(parts[-1]))}"]
    elif kind == "ip":
        parts = span.split(".")
        if len(parts) != 4 or not all(p.isdigit() and len(p) <= 3 for p in parts):
            return None
        out += ["ip:octets" if max(map(int, parts)) <= 255 else "ip:large"]
        out += ["ip:longer"] * (text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit() or text[start - 1 : start] == "." and text[start - 2 : start - 1].isdigit())
    elif kind == "card":
        if not 13 <= n <= 19 or not span[0].isdigit() or not span[-1].isdigit() or set(span) - set("0123456789 -"):
            return None
        seps = {c for c in span if not c.isdigit()}
        groups = [len(g) for g in re.split("[ -]", span)]
        out += ["card:luhn" if luhn(digits) else "card:noluhn", "card:lead" if digits[0] in "3456" else "card:otherlead", f"card:seps{len(seps)}"]
        out += ["card:even" if not seps or set(groups[:-1]) == {4} else "card:uneven", "card:16" if n == 16 else "card:not16"]
    else:
        if not 8 <= n <= 15 or not span[-1].isdigit() or span[0] not in "+(0123456789" or set(span) - set("0123456789 ().-+"):
            return None
        groups = re.findall("[0-9]+", span)
        out += ["phone:plus" if span[0] == "+" else "phone:noplus", f"phone:groups{min(6, len(groups))}", "phone:tail4" if len(groups[-1]) == 4 else "phone:tail"]
        out += [f"phone:paren{span.count('(')}{span.count(')')}", "phone:double" if re.search(r"[ .-]{2}", span) else "phone:single"]
        out += ["phone:innerplus"] * ("+" in span[1:])
    before, after = text[start - 1 : start], text[end : end + 1]
    out.append(f"{kind}:joined" if before.isalnum() or after.isalnum() else f"{kind}:apart")
    if before == "+" or kind != "email" and before in ("-", "(") or after in ("@", "-"):
        out.append(f"{kind}:cut")
    return out


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """Atom borders of an island and all segments (first atom, end atom, kind, features)."""
    borders = [lo]
    kinds = []
    for m in _ATOM.finditer(text, lo, hi):
        borders.append(m.end())
        kinds.append("d" if "0" <= m[0][0] <= "9" else "m" if m[0] in " ().-+" else "o")
    out = []
    for i, k in enumerate(kinds):
        if k == "o":
            continue
        digits = ""
        for j in range(i, min(len(kinds), i + MAX_ATOMS)):
            if kinds[j] == "o":
                break
            if kinds[j] != "d":
                continue
            digits += text[borders[j] : borders[j + 1]]
            if len(digits) > 19:
                break
            if len(digits) < 4:
                continue
            for kind in ("ip", "card", "phone"):
                f = features(text, borders[i], borders[j + 1], kind, digits)
                if f:
                    out.append((i, j + 1, kind, f))
    at = text.find("@", lo, hi)
    index = {b: n for n, b in enumerate(borders)} if at >= 0 else {}
    while at >= 0:
        m = _AT.match(text, at, hi)
        start = at
        while start > lo and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            if start in index and m.end() in index:
                f = features(text, start, m.end(), "email", "")
                if f:
                    out.append((index[start], index[m.end()], "email", f))
        at = text.find("@", at + 1, hi)
    return borders, out


def best_segments(n: int, cands: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> list[int]:
    """Indexes of the best segments that don't overlap: Viterbi over atom borders, other text scores 0."""
    ending = defaultdict(list)
    for c, (_, j, _, f) in enumerate(cands):
        s = sum(weights.get(x, 0.0) for x in f)
        if s > 0:
            ending[j].append((s, c))
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for s, c in ending[j]:
            if best[cands[c][0]] + s > best[j]:
                best[j], back[j] = best[cands[c][0]] + s, c
    out, j = [], n
    while j > 0:
        if back[j] >= 0:
            out.append(back[j])
            j = cands[back[j]][0]
        else:
            j -= 1
    return out[::-1]


def rewritten(text: str) -> list[tuple[str, dict[str, list[Span]]]]:
    """The island with its base spans, and forms of it that no rule finds but which hold the same data."""
    base = base_spans(text)
    out = [(text, base)]
    for s, e in base["phone"]:
        m = re.match(r"\+[0-9]{1,3} (?=[(0-9])", text[s:e])
        if m and len(_NOT_DIGIT.sub("", text[s + m.end() : e])) >= 8:
            short = text[:s] + text[s + m.end() : e] + text[e:]
            out.append((short, {"phone": [(s, e - m.end())]}))
        elif m:
            out.append((text[:s] + "1" + text[s + m.end() - 1 : e] + text[e:], {"phone": [(s, e - m.end() + 2)]}))
    for s, e in base["card"]:
        digits = _NOT_DIGIT.sub("", text[s:e])
        out.append((text[:s] + digits + " 12" + text[e:], {"card": [(s, s + len(digits))]}))
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        out.append((text[:s] + wrong + text[e:], {}))
    for s, e in base["ip"]:
        out.append((text[:s] + text[s:e] + ".7" + text[e:], {}))
    return out


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def segment_chances(n: int, cands: list[tuple[int, int, str, tuple[str, ...]]], scores: list[float]) -> tuple[float, list[float]]:
    """Log of the sum over all segmentations, and the chance of each segment: forward and backward sums over atom borders."""
    ending, starting = defaultdict(list), defaultdict(list)
    for c, (i, j, *_) in enumerate(cands):
        ending[j].append(c)
        starting[i].append(c)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = log_sum([ahead[j - 1], *[ahead[cands[c][0]] + scores[c] for c in ending[j]]]) if j in ending else ahead[j - 1]
    for i in range(n - 1, -1, -1):
        behind[i] = log_sum([behind[i + 1], *[behind[cands[c][1]] + scores[c] for c in starting[i]]]) if i in starting else behind[i + 1]
    return ahead[n], [math.exp(ahead[i] + s + behind[j] - ahead[n]) for (i, j, *_), s in zip(cands, scores, strict=True)]


def train(islands: list[str], epochs: int = EPOCHS) -> dict[str, float]:
    """Weights of the greatest penalised likelihood over islands and their rewritten forms, by adaptive gradient steps."""
    counts: Counter = Counter()
    for island in islands:
        for text, truth in rewritten(island):
            borders, cands = candidates(text, 0, len(text))
            gold = {(k, s, e) for k, spans in truth.items() for s, e in spans}
            right = tuple(c for c, (i, j, k, _) in enumerate(cands) if (k, borders[i], borders[j]) in gold)
            if cands:
                counts[len(borders) - 1, tuple((i, j, k, tuple(f)) for i, j, k, f in cands), right] += 1
    w: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(epochs):
        for (n, cands, right), times in counts.items():
            _, chance = segment_chances(n, cands, [sum(w[x] for x in f) for *_, f in cands])
            slope: dict[str, float] = defaultdict(float)
            for c, (*_, f) in enumerate(cands):
                d = (c in right) - chance[c]
                if abs(d) > 1e-9:
                    for x in f:
                        slope[x] += d
            for x, d in slope.items():
                d = times * (d - PENALTY * w[x])
                seen[x] += d * d
                w[x] += RATE * d / math.sqrt(seen[x])
    return dict(w)


def find_spans(text: str, weights: dict[str, float]) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and, apart from them, the model's spans."""
    base = base_spans(text)
    extra: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text or _DIGIT.search(text):
        taken: list[list[int]] = []
        for a, b in sorted(s for spans in base.values() for s in spans):
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(b, taken[-1][1])
            else:
                taken.append([a, b])
        starts = [a for a, _ in taken]
        for lo, hi in island_spans(text):
            if hi - lo < 7:
                continue
            borders, cands = candidates(text, lo, hi)
            for c in best_segments(len(borders) - 1, cands, weights) if cands else ():
                i, j, kind, _ = cands[c]
                s, e = borders[i], borders[j]
                at = bisect_right(starts, e - 1) - 1
                if at < 0 or taken[at][1] <= s:
                    extra[kind].append((s, e))
    return base, extra


def span_list(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def islands(docs: DataFrame, text_col: str) -> DataFrame:
    """(island): every run of words with a digit or an ``@`` that is long enough to hold personal data."""

    def rows(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                if t and ("@" in t or _DIGIT.search(t)):
                    out += [t[a:b] for a, b in island_spans(t) if 7 <= b - a <= 200]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["island"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(rows, "island string")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_islands: int = 4000, seed: int = 3) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (base and model) and n_model_spans of every document."""
    found = islands(docs, text_col).distinct().orderBy(F.xxhash64("island", F.lit(seed)), "island").limit(max_islands)
    weights = train([r["island"] for r in found.collect()])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rows(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column(1).to_pylist():
                base, extra = find_spans(t or "", shared.value)
                for c, k in zip(cols, KINDS, strict=False):
                    c.append(len(base[k]))
                cols[4].append(hashlib.sha256(span_list(base).encode()).hexdigest())
                cols[5].append(span_list({k: base[k] + extra[k] for k in KINDS}))
                cols[6].append(sum(map(len, extra.values())))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_model_spans"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_model_spans long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, schema)
