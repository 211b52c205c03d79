"""Settings that the registered queries use: a word list, a policy table, tenants and viewers of our own."""

from __future__ import annotations

from collections.abc import Sequence

#: Terms found in the test documents, with mixed languages, levels and categories.
WORD_LIST = [
    {"term": "idiot", "level": 2, "lang": "en", "category": "harassment", "targeted": True},
    {"term": "moron", "level": 2, "lang": "en", "category": "harassment", "targeted": True},
    {"term": "clown", "level": 1, "lang": "en", "category": "harassment"},
    {"term": "scum", "level": 3, "lang": "en", "category": "hate"},
    {"term": "trash", "level": 1, "lang": "any"},
    {"term": "worthless", "level": 2, "lang": "fr", "category": "harassment", "targeted": True},
    {"term": "pathetic", "level": 1, "lang": "en"},
    {"term": "loser", "level": 4, "lang": "en", "category": "violence", "targeted": True},
    {"term": "stupid", "level": 1, "lang": "en"},
    {"term": "disgusting", "level": 3, "lang": "en", "category": "self_harm"},
    {"term": "general public", "level": 1, "lang": "any", "category": "spam"},
    {"term": "ción de la", "level": 2, "lang": "es", "category": "sexual"},
    {"term": "token =", "level": 1, "lang": "any", "category": "illegal"},
]
VIEWERS = [
    ("calm", True, 2, True, {"harassment": False}),
    ("open", True, 4, True, {"harassment": True, "hate": True}),
    ("off", False, 1, True, {}),
    ("plain", True, 3, False, {}),
    ("unset", True, 0, True, {"spam": True}),
]
VIEWER_SCHEMA = "viewer string, enabled boolean, hide_level int, blur boolean, allow map<string,boolean>"
TENANTS = [(f"src{i}", ("strict", "relaxed", "", None, "unknown")[i % 5], (3, 0, None, 5, 2)[i % 5]) for i in range(20)]
TENANT_SCHEMA = "name string, policy string, rate_limit int"
QUOTA_S = 6 * 3600.0
#: Keys of some tenants; other keys are unknown.
KEYS = [(f"key{i}", f"src{i}") for i in range(5)]
HOUSE_POLICY = {
    "name": "house", "block_level": 2.5, "review_level": 1.0, "min_confidence": 0.5, "category_threshold": 0.6,
    "category_min_action": {"hate": "block"}, "category_max_action": {"harassment": "review"},
}


class LengthScorer:
    """A batch scorer whose verdict follows from the length of the text."""

    name = "length"

    def grade(self, texts: Sequence[str]) -> list[dict]:
        return [{"level_probs": [0.88 if i == len(t) % 5 else 0.03 for i in range(5)], "cat_spam": 0.75 if len(t) % 7 == 0 else 0.05, "targeted": 0.3, "confidence": 0.7, "input_tokens": 10.0} for t in texts]
