"""DuckDB SQL for the registered queries.

The test texts hold Latin letters only and NFKC leaves them as they are, so look-alike letters, other
scripts and NFKC don't appear here; unit tests cover them.
"""

from __future__ import annotations

import json
import re

from plumbline.functions.text import STOP_WORDS, VIETNAMESE
from plumbline.functions.verdict import ACTIONS, CATEGORIES
from plumbline.operators.batches import BATCH, LABEL_CATEGORIES, LABEL_PROBS
from plumbline.operators.grading import RUBRIC_VERSION
from plumbline.operators.lexicon import builtin_lists
from plumbline.operators.policy import PRESETS, Policy
from plumbline.plans.samples import HOUSE_POLICY, KEYS, QUOTA_S, TENANTS, VIEWERS, WORD_LIST

__all__ = ["BATCH", "ORACLES"]
ORACLES: dict[str, str] = {}


def q(x: object) -> str:
    return "NULL" if x is None else ("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x))


NORM = r"""
t0 AS (SELECT doc_id, doc_id AS id, text, lang, source, n_chars, string_split(lower(text), '') AS l FROM documents WHERE text IS NOT NULL),
n0 AS (SELECT * EXCLUDE (l), trim(regexp_replace(array_to_string(list_filter(l, lambda c, i: NOT (i > 3 AND c = l[i - 1] AND c = l[i - 2] AND c = l[i - 3])), ''), '[\t-\r ]+', ' ', 'g')) AS norm FROM t0),
n AS (SELECT *, regexp_replace(norm, '[^\p{L}\p{N}]', '', 'g') AS compact, substr(sha256(norm), 1, 16) AS text_hash FROM n0)"""
# --- texts
ORACLES["normalize_documents"] = f"WITH {NORM} SELECT doc_id, length(norm) AS norm_chars, sha256(norm) AS norm_sha256 FROM n"
ORACLES["compact_form"] = f"WITH {NORM} SELECT doc_id, length(compact) AS compact_chars, sha256(compact) AS compact_sha256 FROM n"
ORACLES["text_hash"] = f"WITH {NORM} SELECT doc_id, text_hash, 'lexicon|{RUBRIC_VERSION}|' || text_hash AS cache_key FROM n"
count = lambda cls: f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"
ORACLES["script_profile"] = rf"""
SELECT doc_id, {count(r'\p{Latin}')} AS latin, {count(r'\p{Cyrillic}')} AS cyrillic, {count(r'\p{Han}')} AS han,
       {count(r'\p{L}')} - {count(r'\p{Latin}\p{Cyrillic}\p{Han}')} AS other FROM documents"""
hits = ", ".join(f"len(list_filter(ws, lambda w: list_contains([{', '.join(q(x) for x in s.split())}], w))) AS h_{k}" for k, s in STOP_WORDS.items())
best = " ".join(f"WHEN h_{k} = most THEN '{k}'" for k in STOP_WORDS)
DETECT = rf"""
d0 AS (SELECT *, {count(r'\p{L}')}::DOUBLE AS letters, {count(r'\p{Latin}')} AS latin, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS ws FROM documents),
d1 AS (SELECT *, {hits} FROM d0),
d2 AS (SELECT *, greatest({', '.join(f'h_{k}' for k in STOP_WORDS)}) AS most FROM d1),
det AS (SELECT * EXCLUDE (ws),
  CASE WHEN letters = 0 THEN 'und' WHEN latin / letters < 0.5 THEN 'und' WHEN regexp_matches(lower(text), '{VIETNAMESE}') THEN 'vi'
       WHEN len(ws) = 0 THEN 'und' WHEN most = 0 THEN 'en' {best} END AS detected,
  CASE WHEN letters = 0 OR latin / letters < 0.5 THEN 0.0 WHEN regexp_matches(lower(text), '{VIETNAMESE}') THEN 0.9
       WHEN len(ws) = 0 THEN 0.0 WHEN most = 0 THEN 0.2 ELSE least(1.0, 0.4 + most::DOUBLE / len(ws)) END::DOUBLE AS confidence FROM d2)"""
ORACLES["detect_language"] = f"WITH {DETECT} SELECT doc_id, detected, round(confidence, 6) AS confidence FROM det"
ORACLES["resolve_language"] = f"""WITH {DETECT}, g AS (SELECT doc_id, detected, CASE WHEN doc_id % 3 = 0 THEN nullif(lang, '') END AS given FROM det)
SELECT doc_id, coalesce(given, detected) AS resolved, coalesce(given, 'und') AS undetected FROM g"""
ORACLES["display_clean"] = r"""SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace('+' || turn || '  ' || text || ' ' || chr(10), '[\t-\r ]+', ' ', 'g'), '^\+[0-9]+ ', ''))) AS clean_sha256 FROM conversations"""
ORACLES["client_key"] = r"SELECT conv_id, turn, sha256(trim(regexp_replace(lower(text), '[\t-\r ]+', ' ', 'g'))) AS key_sha256 FROM conversations"
ORACLES["text_preview"] = "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'first' ELSE turn::VARCHAR END AS id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS preview FROM conversations WHERE length(text) >= 3"
# --- word list
W = [r | {"i": i, "norm": r["term"].lower(), "compact": re.sub(r"[^\w]|_", "", r["term"].lower()), "lang": r.get("lang", "any"), "cat": r.get("category"), "t": r.get("targeted", False)} for i, r in enumerate(WORD_LIST)]


def match(r: dict) -> str:
    if not re.fullmatch(r"[a-z0-9 '._-]+", r["norm"]):
        return f"contains(compact, {q(r['compact'])})"
    p = "(^|[^a-z0-9])" + r["norm"] + "([^a-z0-9]|$)"
    return f"(regexp_matches(norm, {q(p)}) OR regexp_matches(compact, {q(p)}))"


own = lambda r: f"(m{r['i']} AND (coalesce(lang, '') IN ('', 'und') OR {q(r['lang'])} = lang OR {q(r['lang'])} = 'any'))"
MATCH = NORM + ",\nm0 AS (SELECT *, " + ", ".join(f"{match(r)} AS m{r['i']}" for r in W) + " FROM n),\n"
MATCH += "m AS (SELECT *, " + ", ".join(f"{own(r)} AS o{r['i']}" for r in W) + " FROM m0)"
any_of = lambda p, rows: "(" + (" OR ".join(f"{p}{r['i']}" for r in rows) or "false") + ")"
level_of = lambda p: "greatest(" + ", ".join(f"CASE WHEN {p}{r['i']} THEN {r['level']} ELSE -1 END" for r in W) + ")"
REASONS = "concat_ws(',', " + ", ".join(f"CASE WHEN o{r['i']} THEN {q('lexicon:' + r['lang'] + ':' + r['norm'])} END" for r in W) + ")"
ORACLES["lexicon_matches"] = f"WITH {MATCH} " + " UNION ALL ".join(
    f"SELECT id, {q(r['norm'])} AS term, {r['level']}::BIGINT AS level, coalesce({q(r['lang'])} IN ('any', lang), false) AS own_language FROM m WHERE m{r['i']}" for r in W
)
NONE_P = (0.7, 0.2, 0.07, 0.02, 0.01)
cat_raw = ", ".join(f"CASE WHEN {any_of('m', [r for r in W if r['cat'] == c])} THEN 0.9 ELSE 0.05 END::DOUBLE AS rcat_{c}" for c in CATEGORIES)
raw_p = ", ".join(f"CASE WHEN mx < 0 THEN {NONE_P[i]} WHEN mx = {i} THEN 0.88 ELSE 0.03 END::DOUBLE AS p{i}" for i in range(5))
L1 = f"""{MATCH},
r0 AS (SELECT *, {level_of('m')} AS mx, {level_of('o')} AS floor FROM m),
raw AS (SELECT *, {raw_p}, {cat_raw}, CASE WHEN mx < 0 THEN 0.05 WHEN {any_of('m', [r for r in W if r['t']])} THEN 0.85 ELSE 0.1 END::DOUBLE AS rtargeted,
        CASE WHEN mx < 0 THEN 0.3 ELSE 0.6 END::DOUBLE AS confidence FROM r0)"""


def argmax(p: str) -> str:
    top = f"greatest({', '.join(f'{p}{i}' for i in range(5))})"
    return "CASE " + " ".join(f"WHEN {p}{i} = {top} THEN {i}" for i in range(5)) + " END"


LEVEL = lambda p: f"({p}0 * 0 + {p}1 * 1 + {p}2 * 2 + {p}3 * 3 + {p}4 * 4)"
ORACLES["lexicon_verdict"] = f"""WITH {L1} SELECT id, round({LEVEL('p')}, 6) AS level, ({argmax('p')})::BIGINT AS level_argmax,
{', '.join(f'rcat_{c} AS cat_{c}' for c in CATEGORIES)}, rtargeted AS targeted, confidence FROM raw"""


def fused(raw: str = "raw") -> str:
    """CTEs that fuse, round and find the top category."""
    f = ", ".join(f"CASE WHEN {argmax('p')} < floor THEN p{i} * 0.5 + CASE WHEN floor = {i} THEN 0.5 ELSE 0 END ELSE p{i} END AS f{i}" for i in range(5))
    c = ", ".join(f"round(CASE WHEN {any_of('o', [r for r in W if r['cat'] == c])} THEN greatest(rcat_{c}, 0.9) ELSE rcat_{c} END, 4) AS cat_{c}" for c in CATEGORIES)
    t = f"round(CASE WHEN {any_of('o', [r for r in W if r['t']])} THEN greatest(rtargeted, 0.8) ELSE rtargeted END, 4) AS targeted"
    ranked = ", ".join(f"{{'p': -cat_{c}, 'i': {i}, 'c': '{c}'}}" for i, c in enumerate(CATEGORIES))
    return f"""f0 AS (SELECT *, {f}, {c}, {t} FROM {raw}),
f1 AS (SELECT *, round({LEVEL('f')}, 4) AS level, ({argmax('f')})::BIGINT AS level_argmax, list_transform(list_sort(list_filter([{ranked}], lambda x: x.p <= -0.5)), lambda x: x.c) AS present FROM f0),
g AS (SELECT *, coalesce(list_filter(present, lambda c: c IN ('self_harm', 'violence'))[1], present[1]) AS top_category, {REASONS} AS reasons FROM f1)"""


def decide(p, level: str = "level", conf: str = "confidence", cat=lambda c: f"cat_{c}") -> str:
    rank = f"CASE WHEN {level} >= {p.block_level} THEN CASE WHEN {conf} >= {p.min_confidence} THEN 2 ELSE 1 END WHEN {level} >= {p.review_level} THEN 1 ELSE 0 END"
    lows = [f"CASE WHEN {cat(c)} >= {p.category_threshold} THEN {ACTIONS.index(a)} ELSE 0 END" for c, a in p.category_min_action.items()]
    highs = [f"CASE WHEN {cat(c)} >= {p.category_threshold} THEN {ACTIONS.index(a)} ELSE 2 END" for c, a in p.category_max_action.items()]
    return f"['pass', 'review', 'block'][1 + least({', '.join([f'greatest({chr(44).join([rank, *lows])})', *highs])})]"


G = f"{L1},\n{fused()}"
graded = lambda p="balanced": f"{G},\nv AS (SELECT *, {decide(PRESETS[p])} AS action FROM g)"
VERDICT = "id, lang, text_hash, round(level, 6) AS level, level_argmax, targeted, confidence, top_category, action, reasons"
ORACLES["grade_documents"] = ORACLES["stream_grade"] = f"WITH {graded()} SELECT {VERDICT} FROM v"
# --- guard model
SIZE = "length(coalesce(text, ''))"
names = f"['None', 'Violent, Unethical Acts', 'Suicide & Self-Harm', 'Sexual Content or Sexual Acts , Other', 'Non-violent Illegal Acts,'][{SIZE} % 5 + 1]"
lab = f"['safe', 'unsafe', 'controversial', 'safe'][{SIZE} % 4 + 1]"
cat_guard = ", ".join(
    f"CASE WHEN chars % 7 <> 0 AND ({' OR '.join(f'list_contains(ns, {q(k)})' for k, v in LABEL_CATEGORIES.items() if v == c) or 'false'}) THEN 0.9 ELSE 0.05 END::DOUBLE AS rcat_{c}" for c in CATEGORIES
)
prob_guard = ", ".join(f"CASE label {' '.join(f'WHEN {q(k)} THEN {v[i]}' for k, v in LABEL_PROBS.items())} END::DOUBLE AS p{i}" for i in range(5))
GUARD = f"""gd0 AS (SELECT doc_id AS gid, {SIZE} AS chars, {lab} AS label, list_transform(string_split({names}, ','), lambda x: lower(trim(x))) AS ns FROM documents),
gd AS (SELECT gid, label, {prob_guard}, {cat_guard}, CASE WHEN label = 'safe' THEN 0.05 ELSE 0.5 END::DOUBLE AS rtargeted, 0.7::DOUBLE AS confidence FROM gd0)"""
ORACLES["parse_guard_output"] = f"WITH {GUARD} SELECT gid AS doc_id, label, round({LEVEL('p')}, 6) AS level, {', '.join(f'rcat_{c} AS cat_{c}' for c in CATEGORIES)}, rtargeted AS targeted, confidence FROM gd"
ORACLES["fuse_with_language"] = f"""WITH {MATCH}, {GUARD}, raw AS (SELECT m.*, {level_of('o')} AS floor, gd.* EXCLUDE (gid) FROM m JOIN gd ON gid = id),
{fused()} SELECT id, round(level, 6) AS level, level_argmax, {', '.join(f'round(cat_{c}, 6) AS cat_{c}' for c in CATEGORIES)}, targeted, {decide(PRESETS['strict'])} AS action, reasons FROM g"""
# --- decisions
ORACLES["top_category"] = f"WITH {G} SELECT source, coalesce(top_category, 'none') AS top, count(*) AS n FROM g GROUP BY 1, 2"
ORACLES["policy_matrix"] = f"WITH {G}, a AS (" + " UNION ALL ".join(f"SELECT lang, '{p.name}' AS policy, {decide(p)} AS action FROM g" for p in PRESETS.values()) + ") SELECT lang, policy, action, count(*) AS n FROM a GROUP BY ALL"
tenants = "(VALUES " + ", ".join(f"({q(a)}, {q(b)}::VARCHAR, {q(c)}::INT)" for a, b, c in TENANTS) + ") AS te(name, tpolicy, rate_limit)"
ORACLES["tenant_policy_actions"] = f"""WITH {G}, e AS (SELECT g.*, coalesce(CASE WHEN id % 10 = 0 THEN 'relaxed' END, nullif(tpolicy, ''), 'balanced') AS effective_policy FROM g LEFT JOIN {tenants} ON name = source),
a AS (SELECT source AS tenant, effective_policy, CASE effective_policy {' '.join(f"WHEN '{p.name}' THEN {decide(p)}" for p in PRESETS.values())} ELSE 'refused' END AS action FROM e)
SELECT tenant, effective_policy, action, count(*) AS n FROM a GROUP BY ALL"""
shown = []
for name, enabled, hide, blur, allow in VIEWERS:
    h = min(5, max(1, hide or 2))
    ok = [c for c, yes in allow.items() if yes]
    allowed = f"(top_category IN ({', '.join(map(q, ok))}) AND level_argmax < 4)" if ok else "false"
    shown.append(f"""SELECT id, '{name}' AS viewer, CASE WHEN NOT {q(enabled)} OR coalesce({allowed}, false) THEN 'show' WHEN {h} <= 4 AND level_argmax >= {h} THEN 'hide'
 WHEN {q(blur)} AND {h} <= 4 AND level_argmax >= 1 AND level_argmax = {h - 1} THEN 'blur' ELSE 'show' END AS shown FROM g""")
SHOWN = f"{G}, s AS ({' UNION ALL '.join(shown)})"
ORACLES["viewer_actions"] = f"WITH {SHOWN} SELECT id, viewer, shown FROM s"
ORACLES["display_stats"] = f"WITH {SHOWN} SELECT viewer, count(*) AS graded, count(*) FILTER (id % 2 = 0) AS cached, count(*) FILTER (shown = 'hide') AS hidden, count(*) FILTER (shown = 'blur') AS blurred FROM s GROUP BY viewer"
# --- sources, sinks and what callers bring
ORACLES["text_lines"] = r"""WITH l AS (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS t FROM documents WHERE text IS NOT NULL)
SELECT sha256(t) AS sha, count(*) AS n, max(length(t)) AS chars, count(*) AS ids FROM l WHERE regexp_matches(t, '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') GROUP BY t"""
ORACLES["text_line_order"] = """SELECT (row_number() OVER (ORDER BY floor(sqrt(doc_id % 49)), doc_id) - 1)::VARCHAR AS id, 'doc ' || doc_id AS line FROM documents"""
ORACLES["golden_files"] = r"""SELECT 'en-labels-' || doc_id AS id, coalesce(lang, 'und') AS lang, sha256(regexp_replace(text, '^[\t-\r ]+|[\t-\r ]+$', '', 'g')) AS text_sha256,
toxic::BIGINT * 2 AS level, CASE WHEN toxic = 1 THEN 'harassment' ELSE '' END AS categories, false AS targeted, 'from labels.parquet, label ' || toxic AS note FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)"""
ORACLES["labelled_files"] = """SELECT doc_id, form, sha256(text) AS text_sha256, toxic::BIGINT AS toxic FROM documents JOIN labels USING (doc_id), (VALUES ('csv'), ('jsonl')) AS f(form)"""
B = [r | {"lang": doc["lang"]} for doc in (json.loads(p.read_text(encoding="utf-8")) for p in builtin_lists()) for r in doc["entries"]]
B = [r | {"norm": r["term"].lower(), "compact": re.sub(r"[^\w]|_", "", r["term"].lower())} for r in B]
ORACLES["builtin_matches"] = f"WITH {NORM} " + " UNION ALL ".join(f"SELECT id, {q(r['norm'])} AS term, {q(r['lang'])} AS lang, {r['level']}::BIGINT AS level FROM n WHERE {match(r)}" for r in B)
ORACLES["long_list_matches"] = f"""WITH {NORM}, t AS (SELECT DISTINCT unnest(regexp_extract_all(norm, '[a-z]{{7,}}')) AS term FROM n),
w AS (SELECT id, unnest(regexp_split_to_array(norm, '[^a-z0-9]+')) AS term FROM n UNION SELECT id, unnest(regexp_split_to_array(compact, '[^a-z0-9]+')) FROM n),
h AS (SELECT id, count(*) AS n_terms, sum(length(term) % 5)::BIGINT AS levels, sha256(string_agg(term, ',' ORDER BY term)) AS terms_sha256 FROM w JOIN t USING (term) GROUP BY id)
SELECT id, coalesce(n_terms, 0) AS n_terms, coalesce(levels, 0) AS levels, coalesce(terms_sha256, sha256('')) AS terms_sha256 FROM n LEFT JOIN h USING (id)"""
ORACLES["feedback_appended"] = f"""WITH {NORM} SELECT doc_id, 'tenant-' || source AS tenant, text_hash, CASE WHEN toxic = 1 THEN 'block' ELSE 'pass' END AS human_action,
CASE WHEN toxic = 1 THEN 3 END::BIGINT AS expected_level, '2026-01-01 00:00:00' AS ts FROM n JOIN labels USING (doc_id) WHERE quality IN (0, 1)"""
by_length = ", ".join(f"CASE WHEN chars % 5 = {i} THEN 0.88 ELSE 0.03 END::DOUBLE AS p{i}" for i in range(5))
cat_length = ", ".join(f"{'CASE WHEN chars % 7 = 0 THEN 0.75 ELSE 0.05 END' if c == 'spam' else '0.0'}::DOUBLE AS rcat_{c}" for c in CATEGORIES)


def by_scorer(first: str) -> str:
    """CTEs of grading by the scorer that reads lengths; ``first`` orders the items that share a hash."""
    return f"""{MATCH}, s0 AS (SELECT *, first_value(length(text)) OVER (PARTITION BY text_hash ORDER BY {first}) AS chars, {level_of('o')} AS floor FROM m),
raw AS (SELECT *, {by_length}, {cat_length}, 0.3::DOUBLE AS rtargeted, 0.7::DOUBLE AS confidence FROM s0), {fused()}, v AS (SELECT *, {decide(PRESETS['balanced'])} AS action FROM g)"""


ORACLES["scored_in_batches"] = ORACLES["scored_resumable"] = f"""WITH {by_scorer('id')} SELECT id, round(level, 6) AS level, level_argmax, round(cat_spam, 6) AS cat_spam, targeted, action, false AS cached, 'length' AS backend, 10.0::DOUBLE AS input_tokens FROM v"""
ORACLES["stream_scored_once"] = f"""WITH {by_scorer('id % 2, id')}, c AS (SELECT *, id % 2 = 1 AND min(id % 2) OVER (PARTITION BY text_hash) = 0 AS cached FROM v)
SELECT id, cached, round(level, 6) AS level, level_argmax, action, CASE WHEN cached THEN 0.0 ELSE 10.0 END::DOUBLE AS input_tokens FROM c"""
ORACLES["custom_entries"] = f"WITH {MATCH} " + " UNION ALL ".join(f"SELECT id, {q(r['norm'])} AS term, {r['level']}::BIGINT AS level FROM m WHERE m{r['i']}" for r in W)
ORACLES["custom_policy"] = f"WITH {G}, a AS (SELECT source, {decide(Policy(**HOUSE_POLICY))} AS action FROM g) SELECT source, action, count(*) AS n FROM a GROUP BY ALL"
in_script = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS script, length(regexp_replace(t, '[^{cls}]', '', 'g')) AS n FROM x" for name, cls in (("LATIN", r"\p{Latin}"), ("ARMENIAN", r"\p{Armenian}"), ("TAMIL", r"அதமழ"), ("RUNIC", r"\p{Runic}"), ("CYRILLIC", r"\p{Cyrillic}"), ("ETHIOPIC", r"\p{Ethiopic}"), ("HAN", r"\p{Han}"), ("HIRAGANA", r"\p{Hiragana}")))
ORACLES["all_scripts"] = f"""WITH x AS (SELECT doc_id, text || ['', 'ԱԲԳ', 'தமிழ் அ', 'ᚠᚢ Ж', 'ጀ漢か'][length(text) % 5 + 1] AS t FROM documents), c AS ({in_script}) SELECT doc_id, script, n FROM c WHERE n > 0"""
keys = "(VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in KEYS) + ") AS ke(api_key, tenant)"
ORACLES["tenants_by_key"] = f"""WITH c AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'key' || user_id % 7 END AS api_key, 'c' || event_id % 4 AS client FROM events)
SELECT event_id, CASE WHEN c.api_key IS NULL THEN 'anonymous:' || client ELSE ke.tenant END AS tenant, CASE WHEN c.api_key IS NOT NULL AND ke.tenant IS NULL THEN 'unknown key' END AS reason FROM c LEFT JOIN {keys} ON ke.api_key = c.api_key"""
# --- dedupe and cache
ORACLES["dedupe_texts"] = f"WITH {NORM} SELECT text_hash, min(id) AS first_id, count(*) AS n_items FROM n GROUP BY text_hash"
OLD = f"""y0 AS (SELECT CASE WHEN id % 4 < 2 THEN '{RUBRIC_VERSION}' ELSE 'old' END AS rubric_version, text_hash, id AS created, id * 7 % 1000 AS last_used FROM n),
old AS (SELECT rubric_version, text_hash, max(created) AS created, arg_max(last_used, created) AS last_used FROM y0 GROUP BY rubric_version, text_hash)"""
ORACLES["cache_misses"] = f"WITH {NORM}, {OLD} SELECT id, o.text_hash IS NOT NULL AS cached, o.text_hash IS NULL AS missed FROM n LEFT JOIN (SELECT text_hash FROM old WHERE rubric_version = '{RUBRIC_VERSION}') o USING (text_hash)"
ORACLES["cache_upsert"] = f"""WITH {NORM}, {OLD}, b AS (SELECT rubric_version, text_hash, created, last_used, 0 AS new FROM old UNION ALL SELECT '{RUBRIC_VERSION}', text_hash, id + k, id + k, 1 FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 10 ELSE -10 END AS k FROM n))
SELECT 'lexicon' AS backend, rubric_version, text_hash, max(created) AS created, arg_max(last_used, created * 2 + new) AS last_used FROM b GROUP BY rubric_version, text_hash"""
ORACLES["cache_size"] = f"WITH {NORM}, {OLD} SELECT 'lexicon' AS backend, rubric_version, count(*) AS entries FROM old GROUP BY rubric_version"
ORACLES["fan_out"] = f"WITH {graded()} SELECT id, text_hash, round(level, 6) AS level, action, false AS cached FROM v"
ORACLES["lru_retention"] = f"""WITH {NORM}, {OLD}, u AS (SELECT text_hash, max(id * 13 % 1500) AS used FROM n GROUP BY text_hash)
SELECT text_hash, greatest(last_used, coalesce(used, last_used)) AS last_used FROM old LEFT JOIN u USING (text_hash) WHERE rubric_version = '{RUBRIC_VERSION}' ORDER BY 2 DESC, 1 LIMIT 100"""
ORACLES["client_retention"] = "SELECT source AS viewer, doc_id AS seq FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 20"
# --- evaluation
ORACLES["labels_to_golden"] = r"""SELECT 'en-labels-' || doc_id AS id, length(regexp_replace(text, '^[\t-\r ]+|[\t-\r ]+$', '', 'g')) AS chars, 2::BIGINT AS level, 'harassment' AS categories, false AS targeted,
'from labels.parquet, label 1' AS note, 'en' AS lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"""
ORACLES["golden_first"] = """SELECT 'xx-q-' || doc_id AS id, CASE quality WHEN 0 THEN 3 ELSE 0 END::BIGINT AS level, CASE quality WHEN 0 THEN 'spam' ELSE '' END AS categories
FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1) ORDER BY doc_id LIMIT 50"""


def evaluated(policy: str) -> str:
    p = PRESETS[policy]
    want = decide(p, "e", "1.0", lambda c: "(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END)" if c == "harassment" else "0.0")
    return f"""{graded()}, e0 AS (SELECT v.*, toxic, CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS e FROM v JOIN labels l ON l.doc_id = v.id),
j AS (SELECT *, {want} AS want, level_argmax = e AS exact, abs(level_argmax - e) <= 1 AS within1, CASE WHEN toxic = 1 THEN list_contains(present, 'harassment') ELSE len(present) = 0 END AS cat_ok,
 (targeted >= 0.5) = (toxic = 1) AS targeted_ok, level >= 1.5 AS p FROM e0)"""


MEASURES = """count(*) AS n, round(avg(exact::INT), 6) AS exact, round(avg(within1::INT), 6) AS within1, {f1} AS f1_l2, round(avg(cat_ok::INT), 6) AS cat, round(avg(targeted_ok::INT), 6) AS targeted,
 count(*) FILTER (want = 'pass' AND action = 'block') AS false_blocks, count(*) FILTER (want = 'block' AND action = 'pass') AS misses, {tok} AS tokens_per_item"""
COUNTS = "count(*) FILTER (e >= 2 AND p)", "count(*) FILTER (e < 2 AND p)", "count(*) FILTER (e >= 2 AND NOT p)"
F1 = f"round(CASE WHEN 2 * {COUNTS[0]} + {COUNTS[1]} + {COUNTS[2]} = 0 THEN 'nan'::DOUBLE ELSE 2.0 * {COUNTS[0]} / (2 * {COUNTS[0]} + {COUNTS[1]} + {COUNTS[2]}) END, 6)"
rank = lambda c: f"rank() OVER (PARTITION BY lang ORDER BY {c}) + (count(*) OVER (PARTITION BY lang, {c}) - 1) / 2.0"
RHO = f"""rk AS (SELECT lang, {rank('e')} AS rx, {rank('level')} AS ry FROM j),
s AS (SELECT lang, count(*) AS n, avg(rx * ry) - avg(rx) * avg(ry) AS cov, avg(rx * rx) - avg(rx) ** 2 AS vx, avg(ry * ry) - avg(ry) ** 2 AS vy FROM rk GROUP BY lang),
rho AS (SELECT lang, n, round(CASE WHEN n < 2 OR vx < 1e-9 OR vy < 1e-9 THEN 'nan'::DOUBLE ELSE cov / sqrt(vx * vy) END, 6) AS spearman FROM s)"""
EACH = f"SELECT j.lang AS lang, {MEASURES.format(f1=F1, tok='0.0::DOUBLE')}, max(spearman) AS spearman FROM j LEFT JOIN (SELECT lang, spearman FROM rho) r ON r.lang = j.lang GROUP BY j.lang"
ORACLES["eval_by_language"] = f"WITH {evaluated('balanced')}, {RHO} {EACH}"
ORACLES["eval_overall"] = f"""WITH {evaluated('strict')}, {RHO} {EACH}
UNION ALL SELECT NULL, {MEASURES.format(f1='NULL::DOUBLE', tok='NULL::DOUBLE')}, NULL::DOUBLE FROM j"""
ORACLES["gross_errors"] = f"WITH {evaluated('balanced')} SELECT id, lang, e::BIGINT AS expected_level, round(level, 6) AS level, level_argmax, top_category, substr(text, 1, 60) AS text_60 FROM j WHERE abs(level_argmax - e) >= 2"
ORACLES["spearman_by_language"] = f"WITH {evaluated('balanced')}, {RHO} SELECT lang, n, spearman FROM rho"
ORACLES["binary_eval"] = f"WITH {evaluated('balanced')} SELECT source, count(*) AS n, {COUNTS[0]} AS tp, {COUNTS[1]} AS fp, {COUNTS[2]} AS fn, {F1} AS f1 FROM j GROUP BY source"
# --- requests
ORACLES["invalid_requests"] = """SELECT * FROM (SELECT conv_id AS request_id, count(*) AS n_items, CASE WHEN count(*) > 6 THEN 'too many items' WHEN max(length(coalesce(text, ''))) > 1200 THEN 'text too long'
WHEN min(length(coalesce(text, ''))) = 0 THEN 'empty text' END AS reason FROM conversations GROUP BY conv_id) WHERE reason IS NOT NULL"""
ORACLES["validate_nested"] = ORACLES["invalid_requests"].replace("conv_id AS request_id, count(*) AS n_items,", "conv_id,").replace(" WHERE reason IS NOT NULL", "")
ORACLES["usage_by_request"] = """WITH c AS (SELECT conv_id, turn % 2 = 1 AS cached, CASE WHEN turn % 2 = 1 THEN 0.0 ELSE length(text) / 4.0 END::DOUBLE AS t FROM conversations)
SELECT conv_id, count(*) AS items, count(*) FILTER (cached) AS cached, round(sum(t), 1) AS backend_input_tokens, round(sum(t) * 0.042 / 1e6, 9) AS cost_usd FROM c GROUP BY conv_id"""
pos = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"
ORACLES["batch_numbers"] = f"SELECT conv_id, turn, {pos} AS pos, (({pos}) // 4)::BIGINT AS chunk FROM conversations"
ORACLES["batch_requests"] = f"""WITH b AS (SELECT conv_id, (({pos}) // 4)::BIGINT AS chunk FROM conversations)
SELECT conv_id, chunk, count(*) AS n_items, 9 * count(*) AS n_questions, count(*) + 1 AS n_state FROM b GROUP BY conv_id, chunk"""
ABOUT = ",".join(sorted([*(f"cat_{c}" for c in CATEGORIES), "risk", "targeted"]))
ORACLES["batch_content"] = f"""WITH b AS (SELECT conv_id, text, {pos} AS pos FROM conversations)
SELECT conv_id, (pos // 4)::BIGINT AS chunk, 'c' || pos % 4 AS key, '{ABOUT}' AS about, true AS named, sha256(text) AS text_sha256 FROM b"""
ORACLES["parse_model_response"] = f"""WITH x AS (SELECT doc_id, {SIZE} AS n_chars, {SIZE} % 10 / 10.0::DOUBLE AS x FROM documents),
i AS (SELECT doc_id, n_chars, x, 0 AS item, [x, 0.2, 0.1, 0.1, 0.1] AS p FROM x UNION ALL SELECT doc_id, n_chars, x, 1, [0.0, x, 0.0, x, 0.0] FROM x),
s AS (SELECT *, CASE WHEN list_sum(p) = 0 THEN 1 ELSE list_sum(p) END AS t FROM i)
SELECT doc_id, item::BIGINT AS item, round((p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5]) / t, 6) AS level, (list_position(p, list_max(p)) - 1)::BIGINT AS level_argmax,
round(0.1 * (2 + item), 6)::DOUBLE AS cat_hate, round(0.1 * (6 + item), 6)::DOUBLE AS cat_illegal, x AS targeted, 0.9::DOUBLE AS confidence, n_chars / 2.0::DOUBLE AS input_tokens FROM s"""
ORACLES["results_by_batch"] = "SELECT conv_id AS batch_id, turn AS id, sha256(text) AS answer FROM conversations WHERE (conv_id + turn) % 4 <> 0"
ORACLES["tenant_limits"] = f"SELECT doc_id AS call_id, source AS tenant, coalesce(nullif(rate_limit, 0), 600)::BIGINT AS quota FROM documents LEFT JOIN {tenants} ON name = source"
ORACLES["quota_replay"] = ORACLES["stream_quota"] = f"""WITH RECURSIVE c AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS ts, user_id % 4 AS quota, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, rn, true AS ok, CASE WHEN quota > 0 THEN [ts] ELSE [] END AS w FROM c WHERE rn = 1
 UNION ALL
 SELECT c.event_id, c.user_id, c.rn, c.quota <= 0 OR len(list_filter(r.w, lambda t: c.ts - t <= {QUOTA_S})) < c.quota,
  CASE WHEN c.quota <= 0 THEN [] WHEN len(list_filter(r.w, lambda t: c.ts - t <= {QUOTA_S})) < c.quota THEN list_append(list_filter(r.w, lambda t: c.ts - t <= {QUOTA_S}), c.ts) ELSE list_filter(r.w, lambda t: c.ts - t <= {QUOTA_S}) END
 FROM r JOIN c ON c.user_id = r.user_id AND c.rn = r.rn + 1)
SELECT event_id AS call_id, user_id AS tenant, ok AS admitted FROM r"""
ORACLES["feedback_misjudgments"] = f"""WITH {graded()}, u AS (SELECT DISTINCT text_hash, action, level FROM v)
SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'block' ELSE 'pass' END AS human_action, u.action, round(u.level, 6) AS level FROM v JOIN labels l ON l.doc_id = v.id JOIN u USING (text_hash)
WHERE u.action <> CASE WHEN toxic = 1 THEN 'block' ELSE 'pass' END"""
# --- nodes
NODES = "e AS (SELECT event_id, user_id AS node_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS text FROM events)"
ORACLES["text_changes"] = f"""WITH {NODES}, l AS (SELECT *, lag(text) OVER (PARTITION BY node_id ORDER BY ts, event_id) AS before FROM e)
SELECT event_id, node_id, text FROM l WHERE text IS NOT NULL AND text IS DISTINCT FROM before"""
ORACLES["stale_verdicts"] = ORACLES["stream_stale_verdicts"] = f"""WITH {NODES}, v AS (SELECT event_id, node_id, ts + INTERVAL 12 HOUR AS ts, text FROM e WHERE text IS NOT NULL)
SELECT v.event_id, v.node_id, v.text FROM v ASOF JOIN e ON v.node_id = e.node_id AND v.ts >= e.ts WHERE e.text = v.text"""
ORACLES["stream_text_changes"] = """WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, role AS text FROM l WHERE role IS DISTINCT FROM before"""
