"""Operator 7: minimum-cost repair of the roles of a conversation, then rendering.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the
assistant. Dynamic programming over the automaton of legal turns picks, for each turn, its role
(another one costs ``RELABEL``), whether it is merged into the turn before (``MERGE``) and which empty
turns are put in (``INSERT`` each), at the least total cost.

Turns are dealt out by ranges of (conversation, turn), so a conversation of any length is cut in blocks.
Each block gives the cost from every state at its start to every state at its end; these small matrices
are chained for the conversations with several blocks, which gives every block the true costs of its
first states. With these each block tells which first state each last state comes from; the last states
are chained backwards, and every block follows its own best path. The result has one row a turn; the
pieces in order give the rendered text.

Defined cases: turns are ordered by turn (null first), role, text; a null role counts as a wrong one,
a null text as empty; unknown roles are relabelled; rows with a null conversation form one; repeated
rows are turns of their own; of repairs that cost the same, read from the last turn, the step that comes
first in ``STEPS`` is taken (a turn that ends with the assistant before others), wherever the blocks are
cut; long texts are only copied; an empty table gives an empty result; other columns are not read, so they
may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import keep

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1000, 2001, 3000
FAR = 1 << 50
START = 3
#: Step costs and the empty turns put in before, for (state before, role): states are the last role, START at first.
STEPS: dict[tuple[int, int], tuple[int, tuple[int, ...], bool]] = {
    (START, 0): (0, (), False), (0, 0): (MERGE, (), True),
    (START, 1): (0, (), False), (0, 1): (0, (), False), (2, 1): (0, (), False), (1, 1): (MERGE, (), True),
    (1, 2): (0, (), False), (2, 2): (MERGE, (), True), (START, 2): (INSERT, (1,), False), (0, 2): (INSERT, (1,), False),
}
#: What must be put in at the end after each state.
CLOSING = {0: (1, 2), 1: (2,), 2: (), START: ()}


AT_START = [FAR] * START + [0]


def best_paths(roles: list[str | None], cost: list[int]) -> tuple[list[int], list[list[int]]]:
    """Least cost of each state after all turns, from the costs before them, and each turn's best state before."""
    back = []
    for r in roles:
        now, came = [FAR] * 4, [-1] * 4
        for (p, q), (c, _, _) in STEPS.items():
            x = cost[p] + c + (0 if r == ROLES[q] else RELABEL)
            if x < now[q]:
                now[q], came[q] = x, p
        cost = now
        back.append(came)
    return cost, back


def best_end(cost: list[int]) -> int:
    """The last state of least cost, closing turns counted."""
    return min(range(3), key=lambda q: (cost[q] + INSERT * len(CLOSING[q]), -q))


def path(roles: list[str | None], cost: list[int], end: int | None) -> list[tuple[int, int]]:
    """(state before, state after) of each turn; the best closing decides if ``end`` is None."""
    cost, back = best_paths(roles, cost)
    if end is None:
        end = best_end(cost)
    out = []
    for came in reversed(back):
        out.append((came[end], end))
        end = came[end]
    return out[::-1]


def escaped(text: str | None) -> str:
    """Text in which the marks of a turn can't appear; undone by ``unescaped``."""
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return text.replace("<\\|", "<|").replace("\\\\", "\\")


def opened(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSED = "<|end|>\n"


def runs(values: list) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cut = [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]] + [len(values)]
    return list(zip(cut, cut[1:], strict=False))


def repair_roles(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = 20_000) -> DataFrame:
    """conv_id, turn, role, new_role, action, n_inserted, rendered of every turn."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    n_blocks = max(1, -(-t.count() // block_rows), int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "text"]
    t = t.repartitionByRange(n_blocks, *order).sortWithinPartitions(*order)
    t = keep(t.withColumn("block", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "turns")
    conv, turn = (t.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def costs(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        convs, roles = table.column("conv_id"), table.column("role").to_pylist()
        spans = runs(convs.to_pylist())
        unit = [[0 if s == x else FAR for x in range(4)] for s in range(4)]
        rows = [[c for s in range(4) for c in best_paths(roles[a:b], unit[s])[0]] for a, b in spans]
        return pa.table({"conv_id": convs.take(pa.array([a for a, _ in spans], pa.int64())), "block": pa.array([table.column("block")[0].as_py()] * len(spans), pa.int32()), "cost": pa.array(rows, pa.list_(pa.int64()))})

    def before(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        cost, at_start = AT_START, []
        for m in table.column("cost").to_pylist():
            at_start.append(cost)
            cost = [min(FAR, *[cost[p] + m[4 * p + q] for p in range(4)]) for q in range(4)]
        last = [best_end(cost)] * len(at_start)
        return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), "cost": pa.array(at_start, pa.list_(pa.int64())), "end": pa.array(last, pa.int32())})

    def origins(key: tuple, table: pa.Table, plan: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        convs, roles = table.column("conv_id").to_pylist(), table.column("role").to_pylist()
        plans = {r["conv_id"]: r["cost"] for r in plan.to_pylist()}
        came = {}
        for a, b in runs(convs):
            if convs[a] in plans:
                _, back = best_paths(roles[a:b], plans[convs[a]])
                came[convs[a]] = list(range(4))
                for q in range(4):
                    s = q
                    for x in reversed(back):
                        s = x[s] if s >= 0 else s
                    came[convs[a]][q] = s
        return plan.append_column("came", pa.array([came[c] for c in plan.column("conv_id").to_pylist()], pa.list_(pa.int32())))

    def after(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        end, ends = table.column("end")[0].as_py(), []
        for came in reversed(table.column("came").to_pylist()):
            ends.append(end)
            end = came[end]
        k = table.num_rows
        return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), "cost": table.column("cost"), "last": pa.array(ends[::-1], pa.int32()), "tail": [i == k - 1 for i in range(k)]})

    def render(key: tuple, table: pa.Table, plan: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        convs, roles, texts = (table.column(c).to_pylist() for c in ("conv_id", "role", "text"))
        plans = {r["conv_id"]: r for r in plan.to_pylist()}
        new, actions, inserted, rendered = [], [], [], []
        for a, b in runs(convs):
            p = plans.get(convs[a])
            start, end, tail = (p["cost"], p["last"], p["tail"]) if p else (AT_START, None, True)
            for i, (s, q) in zip(range(a, b), path(roles[a:b], start, end), strict=True):
                _, extra, merged = STEPS[s, q]
                closing = CLOSING[q] if tail and i == b - 1 else ()
                piece = "\n" if merged else ("" if s == START else CLOSED) + "".join(opened(x) + CLOSED for x in extra) + opened(q)
                piece += escaped(texts[i])
                if tail and i == b - 1:
                    piece += CLOSED + "".join(opened(x) + CLOSED for x in closing)
                new.append(ROLES[q])
                actions.append("+".join(["relabel"] * (roles[i] != ROLES[q]) + ["merge"] * merged) or "keep")
                inserted.append(len(extra) + len(closing))
                rendered.append(piece)
        return pa.table({"conv_id": table.column("conv_id"), "turn": table.column("turn"), "role": table.column("role"), "new_role": pa.array(new, pa.string()), "action": pa.array(actions, pa.string()), "n_inserted": pa.array(inserted, pa.int64()), "rendered": pa.array(rendered, pa.string())})

    blocks = keep(t.select("conv_id", "role", "block", "seq").groupBy("block").applyInArrow(costs, f"conv_id {conv}, block int, cost array<long>"), "costs")
    many = blocks.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").alias("m")
    longer = blocks.alias("b").join(many, F.col("b.conv_id").eqNullSafe(F.col("m.conv_id")), "left_semi")
    starts = keep(longer.groupBy("conv_id").applyInArrow(before, f"conv_id {conv}, block int, cost array<long>, end int"), "starts")
    long_blocks = t.select("conv_id", "role", "block", "seq").join(starts.select("block").distinct(), "block", "left_semi")
    came = long_blocks.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(origins, f"conv_id {conv}, block int, cost array<long>, end int, came array<int>")
    plans = came.groupBy("conv_id").applyInArrow(after, f"conv_id {conv}, block int, cost array<long>, last int, tail boolean")
    schema = f"conv_id {conv}, turn {turn}, role string, new_role string, action string, n_inserted long, rendered string"
    return t.groupBy("block").cogroup(plans.groupBy("block")).applyInArrow(render, schema)
