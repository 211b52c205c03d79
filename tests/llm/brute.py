"""Plain versions of the operators for small tables, and a corpus with planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TOXIC = ["idiot", "moron", "scum", "trash", "loser"]


def words(text, lower=False):
    b = (text or "").encode()
    return (b.translate(LOWER) if lower else b).split()


def corpus(seed=1, n=160):
    """(doc_id, text, lang, source, n_chars), labels (doc_id, quality, toxic) and benchmark (item_id, text)."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(900)]
    common = ["the", "of", "and", "to", "in"]

    def line(k):
        return " ".join(rnd.choice(common) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(k))

    def doc():
        return "\n".join(line(rnd.randint(5, 40)) for _ in range(rnd.randint(2, 8)))

    items = [(i, line(rnd.randint(14, 40))) for i in range(12)] + [(50, "Short Item Here"), (51, None), (52, "")]
    passage = line(60)
    texts, labels = [], []
    for i in range(n):
        t, toxic, quality = doc(), 0, 1
        if i % 10 == 1:
            k = rnd.randrange(len(texts))
            t, (_, quality, toxic) = texts[k], labels[k]  # a copy has the labels of what it copies
        elif i % 10 == 2:
            k = rnd.randrange(len(texts))
            w, (_, quality, toxic) = texts[k].split(" "), labels[k]
            for _ in range(max(1, len(w) // 60)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            t = " ".join(w)
        elif i % 10 == 3:
            w = t.split(" ")
            for _ in range(max(4, len(w) // 8)):
                w.insert(rnd.randrange(len(w)), rnd.choice(TOXIC))
            t, toxic = " ".join(w), 1
        elif i % 10 == 4:
            t, quality = " ".join(w + rnd.choice(["###", "$$$"]) for w in t.split()), 0
        elif i % 20 == 5:
            t += "\n" + passage
        elif i % 20 == 6:
            w = items[rnd.randrange(12)][1].split()
            w[len(w) // 2] = "zzz"
            t += "\n" + " ".join(w).upper()
        elif i % 40 == 7:
            t = line(3000)
        elif i % 40 == 27:
            t, quality = " ".join(["again and again"] * 50), 0
        elif i % 40 == 17:
            t += " mail me.now@host.example.com or +1 (743) 555-3824 from 10.2.3.4 with 4111 1111 1111 1111."
        texts.append(t)
        labels.append((i, quality, toxic))
    texts[8], texts[18], texts[28], texts[29] = None, "", " \n\t", "tiny text"
    docs = [(i, t, "en", f"src{min(3, i % 7)}" if i % 50 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return docs, labels, items


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rules(text):
    w = words(text)
    t = text or ""
    lines = [x for x in t.split("\n") if words(x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    n = len(w)
    return n, len(b"".join(w).decode()), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def lm_base(docs):
    counts = Counter()
    for i, t, *_ in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(t, True))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t, *_ in docs:
        tokens = [*words(t, True), None]
        out[i] = len(tokens), sum(counts[x] > 0 for x in tokens), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
    return out, n


def lm_scores(docs, mixed=0.25):
    """Smoothed two-word model over counts rounded to the middle of their powers of two, without a filter."""
    one, two = Counter(), Counter()
    tokens = {}
    for i, t, *_ in docs:
        w = [None, *words(t, True), None]
        tokens[i] = w
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(w[1:])
            two.update(zip(w, w[1:]))
    n, v = sum(one.values()), len(one)
    middle = lambda c: c if c <= 1 else 1.5 * 2 ** (c.bit_length() - 1) - 0.5

    def log_p(a, b):
        alone = (middle(one[b]) + 1) / (n + v + 1)
        before = middle(one[a])
        return math.log10(mixed * min(middle(two[a, b]), before) / before + (1 - mixed) * alone if before else alone)

    return {i: (len(w) - 1, sum(log_p(a, b) for a, b in zip(w, w[1:]))) for i, w in tokens.items()}


def log_weights(docs, target_ids, n_buckets, alpha, margin, prior, temperature):
    """Mean log ratio of one- and two-word grams, target over all documents, without hashing."""
    grams = {i: [*((x,) for x in w), *zip(w, w[1:])] for i, t, *_ in docs for w in [words(t, True)]}
    raw = Counter(g for x in grams.values() for g in x)
    target = Counter(g for i in target_ids for g in grams[i])
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def ratio(g):
        t, r = target[g] + alpha, raw[g] * n_target / n_raw + alpha
        x = math.log(t / (n_target + alpha * n_buckets)) - math.log(r / (n_target + alpha * n_buckets))
        return math.copysign(max(abs(x) - margin, 0), x)

    return {i: (len(x), sum(map(ratio, x)) / (len(x) + prior) / temperature) for i, x in grams.items()}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            s = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1])))
            return 16 <= len(digits) <= 19 and s % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PII.items()}


def contaminated(docs, items, overlap=13, percent=80):
    out = {}
    its = {i: words((t or "").lower()) for i, t in items}
    for d, t, *_ in docs:
        w, found = words((t or "").lower()), []
        for i, x in its.items():
            size = min(overlap, len(x))
            need = size if len(x) < 7 else -(-percent * size // 100)
            hit = size and any(
                sum(w[p + k] == x[q + k] for k in range(size)) >= need for p in range(len(w) - size + 1) for q in range(len(x) - size + 1) if w[p] == x[q] or need < size
            )
            if hit:
                found.append(i)
        if found:
            out[d] = ",".join(map(str, sorted(found)))
    return out


def removed_lines(docs, percent=80):
    lines = [(d, i, frozenset(words(x))) for d, t, *_ in sorted(docs, key=lambda r: r[0]) for i, x in enumerate((t or "").split("\n")) if words(x)]
    gone = defaultdict(list)
    for k, (d, i, s) in enumerate(lines):
        if any(100 * len(s & t) >= percent * len(s | t) for *_, t in lines[:k] if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t))):
            gone[d].append(i)
    return gone


def without_repeats(docs, window):
    counts = Counter(tuple(w[i : i + window]) for _, t, *_ in docs for w in [words(t)] for i in range(len(w) - window + 1))
    out = {}
    for d, t, *_ in docs:
        w = words(t)
        stay = [True] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                stay[i : i + window] = [False] * window
        kept = b" ".join(x for x, s in zip(w, stay) if s)
        out[d] = len(w), len(w) - sum(stay), hashlib.sha256(kept).hexdigest()
    return out


def groups(docs, k, percent=80):
    sets = {}
    for d, t, *_ in docs:
        w = words(t, True)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in ids}


def targets(sizes, most=3):
    """{source: target} by sharing again and again, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.discard(s)
    return out
