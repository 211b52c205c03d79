"""Policies: presets (S5), the decision (L5), policy tables (J5), tenants (J4, S6) and unknown names (V6)."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.verdict import ACTIONS, CATEGORIES, action_name, action_rank, cats

#: A policy or tenant table may have at most this many rows to be broadcast.
MAX_SMALL_ROWS = 100_000
#: Each text meets each row of a table only if the table has at most this many rows.
MAX_COMBINED_ROWS = 1_000


@dataclass(frozen=True)
class Policy:
    name: str
    description: str = ""
    block_level: float = 3.0
    review_level: float = 2.0
    min_confidence: float = 0.6
    category_threshold: float = 0.7
    category_min_action: Mapping[str, str] = field(default_factory=dict)
    category_max_action: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for m in (self.category_min_action, self.category_max_action):
            for c, a in m.items():
                if c not in CATEGORIES or a not in ACTIONS:
                    raise ValueError(f"{self.name}: no category {c!r} or action {a!r}")


#: The presets.
PRESETS = {
    p.name: p
    for p in (
        Policy("balanced", "Severe content is blocked; moderate content and unsure calls are reviewed.", 3.0, 2.0, 0.6, 0.7, {"spam": "block"}, {"self_harm": "review"}),
        Policy("strict", "For families and schools: beyond mild is blocked, mild is reviewed.", 2.0, 1.0, 0.5, 0.6, {"spam": "block", "sexual": "block"}, {"self_harm": "review"}),
        Policy("relaxed", "For adults: only dangerous content is blocked.", 4.0, 3.0, 0.7, 0.8, {"spam": "review"}, {"self_harm": "review"}),
    )
}


def builtin_policies() -> list[str]:
    return sorted(PRESETS)


def load_policy(spec: str | Path | dict | Policy) -> Policy:
    """S5. A preset's name, a JSON or YAML file, a dict, or a Policy. Unknown names are an error that lists the presets."""
    if isinstance(spec, Policy):
        return spec
    if isinstance(spec, dict):
        return Policy(**spec)
    path = Path(spec)
    if not path.suffix:
        if str(spec) not in PRESETS:
            raise FileNotFoundError(f"no policy {str(spec)!r}; presets are {', '.join(builtin_policies())}")
        return PRESETS[str(spec)]
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        import yaml

        return Policy(**yaml.safe_load(text))
    return Policy(**json.loads(text))


def policy_frame(spark: SparkSession, policies: list[Policy] | None = None) -> DataFrame:
    """Policies as a table, for runs of many policies."""
    rows = [tuple(asdict(p).values()) for p in (policies if policies is not None else PRESETS.values())]
    schema = "policy string, description string, block_level double, review_level double, min_confidence double, category_threshold double, category_min_action map<string,string>, category_max_action map<string,string>"
    return spark.createDataFrame(rows, schema)


def _rank_of(action: Column, default: int) -> Column:
    return F.coalesce(action_rank(action), F.lit(default))


def decide(level: Column, confidence: Column, categories: Mapping[str, Column], policy: Policy | None = None) -> Column:
    """L5. The action's name. Without ``policy`` its values are read from the columns of a policy table."""
    num = (lambda n: F.lit(float(getattr(policy, n)))) if policy else F.col
    rank = F.when(level >= num("block_level"), F.when(confidence >= num("min_confidence"), 2).otherwise(1))
    rank = rank.when(level >= num("review_level"), 1).otherwise(0)
    lows, highs = [], []
    for c, p in categories.items():
        here = p >= num("category_threshold")
        for out, side, none in ((lows, "category_min_action", 0), (highs, "category_max_action", 2)):
            if policy is None:
                out.append(F.when(here, _rank_of(F.col(side)[c], none)).otherwise(none))
            elif c in getattr(policy, side):
                out.append(F.when(here, ACTIONS.index(getattr(policy, side)[c])).otherwise(none))
    if lows:
        rank = F.greatest(rank, *lows)
    if highs:
        rank = F.least(rank, *highs)
    return action_name(rank)


def apply_policy(verdicts: DataFrame, policy: str | Policy | dict) -> DataFrame:
    return verdicts.withColumn("action", decide(F.col("level"), F.col("confidence"), cats(), load_policy(policy)))


def small(df: DataFrame, limit: int = MAX_SMALL_ROWS, most_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast a table after counting its rows and characters; a larger one is left to Spark's own choice of join."""
    size = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    seen = df.limit(limit + 1).agg(F.count("*").alias("n"), size.alias("size")).first()
    return F.broadcast(df) if seen["n"] <= limit and (seen["size"] or 0) <= most_bytes else df


def policy_matrix(verdicts: DataFrame, policies: DataFrame) -> DataFrame:
    """J5. Each verdict under each policy of a small table: policy and action are added."""
    if policies.limit(MAX_COMBINED_ROWS + 1).count() > MAX_COMBINED_ROWS:
        raise ValueError(f"a table of policies for all texts may have at most {MAX_COMBINED_ROWS} rows; join by tenant instead")
    both = verdicts.crossJoin(F.broadcast(policies))
    out = both.withColumn("action", decide(F.col("level"), F.col("confidence"), cats()))
    return out.select(*verdicts.columns, "policy", "action")


def effective_policy(requests: DataFrame, tenants: DataFrame, default: str) -> DataFrame:
    """J4. Adds effective_policy: the request's, else its tenant's, else the default; empty counts as none.

    ``requests`` has tenant and policy, ``tenants`` name and policy.
    """
    t = small(tenants.select(F.col("name").alias("__name"), F.col("policy").alias("__policy")))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    out = requests.join(t, requests["tenant"] == F.col("__name"), "left")
    return out.withColumn("effective_policy", F.coalesce(blank("policy"), blank("__policy"), F.lit(default))).drop("__name", "__policy")


def split_known_policies(requests: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V6. (requests with a known effective_policy, rejected ones with reason)."""
    names = small(policies.select(F.col("policy").alias("__name")).distinct())
    known = requests.join(names, requests["effective_policy"] == F.col("__name"), "left_semi")
    unknown = requests.join(names, requests["effective_policy"] == F.col("__name"), "left_anti")
    return known, unknown.withColumn("reason", F.concat(F.lit("no policy "), F.col("effective_policy")))
