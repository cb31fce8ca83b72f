"""Role repair of conversations at least cost, and their rendering.

The legal sequences are those of an automaton: an optional system turn first, then
user and assistant in turn, the assistant last. A turn may keep its role, take another
(``RELABEL``), go on in the turn before it (``MERGE``), or follow empty turns that are
put in (``INSERT`` each). Dynamic programming finds the cheapest repair.

What a turn does to the costs of the four states depends on its role alone and is a
4 x 4 matrix; a stretch of turns is their (min, +) product. Turns are dealt out and
sorted by (conversation, turn), each task sums up the stretches at its two ends in one
matrix each, and those few matrices tell in which state every stretch begins and
ends. So a conversation may be spread over any number of tasks and is repaired as a
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur.llm.common import bounded_batches, cut_lineage

MERGE, RELABEL, INSERT = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Other names of the roles, taken as the role itself.
ALIASES = {"human": USER, "prompter": USER, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT, "developer": SYSTEM}
_FAR = 1 << 60
_LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns that lead from a state to a role, for pairs that can be led."""
    found = {}
    for s in _LEGAL:
        ways = [(s, ())]
        while ways:
            ways = [(n, (*put, n)) for at, put in ways for n in _LEGAL[at] if len(put) < 3]
            for n, put in ways:
                found.setdefault((s, n), put[:-1])
    return found


_PUT = _paths()


def _steps() -> list[list[list[tuple[int, bool, tuple[int, ...]]]]]:
    """[role][state before][role after]: (cost, merged, roles put in); role 0 is none of the three."""
    table = []
    for role in range(4):
        rows = []
        for s in range(4):
            row = []
            for o in range(4):
                named = 0 if role == o else RELABEL
                ways = []
                if o and o == s:
                    ways.append((named + MERGE, True, ()))
                if o and (s, o) in _PUT:
                    ways.append((named + INSERT * len(_PUT[s, o]), False, _PUT[s, o]))
                row.append(min(ways, key=lambda w: (w[0], not w[1]), default=(_FAR, False, ())))
            rows.append(row)
        table.append(rows)
    return table


STEP = _steps()
#: Empty turns that end a conversation from each state.
END = ((), (USER, ASSISTANT), (ASSISTANT,), ())


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else ALIASES.get(name, 0)


def path(roles: list[int], entry: int, leave: int | None) -> tuple[int, list[int]]:
    """Least cost and states of a stretch from a state before it to a state after it (None: the end of the conversation)."""
    cost = [_FAR] * 4
    cost[entry] = 0
    back: list[list[int]] = []
    for role in roles:
        step = STEP[role]
        now, origin = [_FAR] * 4, [0] * 4
        for o in (1, 2, 3):
            best, s_ = _FAR, 0
            for s in range(4):
                c = cost[s] + step[s][o][0]
                if c < best:
                    best, s_ = c, s
            now[o], origin[o] = best, s_
        cost = now
        back.append(origin)
    if leave is None:
        total = [c + INSERT * len(END[s]) for s, c in enumerate(cost)]
        leave = total.index(min(total))
        cost = total
    states, at = [], leave
    for origin in reversed(back):
        states.append(at)
        at = origin[at]
    return cost[leave], states[::-1]


def _opened(roles: list[int], states: list[int], entry: int) -> int:
    """Turns that a stretch begins, with those put in."""
    n, s = 0, entry
    for role, o in zip(roles, states, strict=True):
        _, merged, put = STEP[role][s][o]
        n += len(put) + (not merged)
        s = o
    return n


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, own in groupby(rows, key=lambda r: r["conv_id"]):
        yield key, list(own)


_SUMMARY = pa.schema([("part", pa.int32()), ("side", pa.int32()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.int64())), ("opened", pa.list_(pa.int64()))])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last stretch of a task: costs and turns begun for each state before and after."""
    part = TaskContext.get().partitionId()
    first = last = None
    for key, rows in _stretches(batches):
        last = (key, [role_number(r["role"]) for r in rows])
        first = first or last
    found = [] if first is None else [(0, *first)] if first is last else [(0, *first), (1, *last)]
    out = []
    for side, key, roles in found:
        costs, opened = [], []
        for s in range(4):
            for o in range(4):
                c, states = path(roles, s, o)
                costs.append(min(c, _FAR))
                opened.append(_opened(roles, states, s) if c < _FAR else 0)
        out.append({"part": part, "side": side, "conv_id": key, "costs": costs, "opened": opened})
    yield pa.RecordBatch.from_pylist(out, _SUMMARY)


def joined(summary: list[tuple]) -> dict[tuple[int, int], tuple[int, int | None, int]]:
    """For each end stretch of each task: state before it, state after it (None: the conversation ends), turns begun before it."""
    plan = {}
    chains: list[list[tuple]] = []
    for row in sorted(summary, key=lambda r: (r[0], r[1])):
        # Only the first stretch of a task can go on from the task before.
        if row[1] == 0 and chains and chains[-1][-1][2] == row[2] and chains[-1][-1][0] != row[0]:
            chains[-1].append(row)
        else:
            chains.append([row])
    for chain in chains:
        cost = [0, _FAR, _FAR, _FAR]
        back = []
        for _, _, _, costs, _ in chain:
            ways = [min((cost[s] + costs[4 * s + o], s) for s in range(4)) for o in range(4)]
            back.append([s for _, s in ways])
            cost = [c for c, _ in ways]
        total = [c + INSERT * len(END[s]) for s, c in enumerate(cost)]
        at = total.index(min(total))
        states = [at]
        for origin in reversed(back):
            at = origin[at]
            states.append(at)
        states.reverse()
        begun = 0
        for k, (part, side, _, _, opened) in enumerate(chain):
            plan[part, side] = (states[k], None if k == len(chain) - 1 else states[k + 1], begun)
            begun += opened[4 * states[k] + states[k + 1]]
    return plan


_REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role_in", pa.string()), ("role_out", pa.string()), ("action", pa.string()), ("put_before", pa.string()), ("put_after", pa.string()), ("out_turn", pa.int64()), ("cost", pa.int64()), ("rendered", pa.string())]
)


def _open(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


_CLOSE = "<|end|>\n"


def rendered(text: str | None, role: int, merged: bool, put: tuple[int, ...], after_one: bool, last: bool) -> str:
    """What a turn adds to the rendered conversation; a turn is closed by the one that begins after it, or at the end.

    A text's own ``<|`` is written ``< |``, so that no text can open or close a turn.
    """
    own = (text or "").replace("<|", "< |")
    out = "\n" + own if merged else (_CLOSE if after_one else "") + "".join(_open(p) + _CLOSE for p in put) + _open(role) + own
    return out + (_CLOSE + "".join(_open(p) + _CLOSE for p in END[role]) if last else "")


def repaired(rows: list[dict], entry: int, leave: int | None, begun: int) -> list[dict]:
    roles = [role_number(r["role"]) for r in rows]
    _, states = path(roles, entry, leave)
    out, s = [], entry
    for k, (row, role, o) in enumerate(zip(rows, roles, states, strict=True)):
        cost, merged, put = STEP[role][s][o]
        last = leave is None and k == len(rows) - 1
        action = "+".join([*["relabel"] * (role != o), *["merge"] * merged]) or "keep"
        out.append(
            {
                "conv_id": row["conv_id"], "turn": row["turn"], "role_in": row["role"], "role_out": ROLES[o], "action": action,
                "put_before": ",".join(ROLES[p] for p in put), "put_after": ",".join(ROLES[p] for p in END[o]) if last else "",
                "out_turn": begun + len(put) - merged, "cost": cost + (INSERT * len(END[o]) if last else 0),
                "rendered": rendered(row["text"], o, merged, put, s != START, last),
            }
        )
        begun += len(put) + (not merged)
        s = o
    return out


def _repairer(plan: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ends = {side: plan[part, side] for side in (0, 1) if (part, side) in plan}
        held, at, waiting = [], 0, None
        for _, rows in _stretches(batches):
            if waiting is not None:
                held += repaired(waiting, *(ends[0] if at == 1 else (START, None, 0)))
            waiting, at = rows, at + 1
            while len(held) >= 2000:
                yield pa.RecordBatch.from_pylist(held[:2000], _REPAIRED)
                held = held[2000:]
        if waiting is not None:
            held += repaired(waiting, *ends[0 if at == 1 else 1])
        for k in range(0, len(held), 2000):
            yield pa.RecordBatch.from_pylist(held[k : k + 2000], _REPAIRED)

    return run


def repair(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: its role before and after, what was done, its place and its part of the rendering.

    ``out_turn`` counts the turns of the repaired conversation from 0, with those put in;
    turns that merge share one. The rendering of a conversation is its rows' ``rendered``
    in the order of their turns. Rows without a conversation form one of their own; rows
    without a turn number come first; rows of one turn come in the order of a hash of
    role and text, and each counts. Unknown and missing roles are relabelled; a null
    text is an empty one.
    """
    bounded_batches(turns.sparkSession)
    rows = turns.select(
        F.col(conversation).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"), F.xxhash64(role, text).alias("tie"),
    )
    order = ["conv_id", "turn", "tie", "role", "text"]
    dealt = cut_lineage(rows.repartitionByRange("conv_id", "turn", "tie").sortWithinPartitions(*order).drop("tie"))
    summary = dealt.select("conv_id", "role").mapInArrow(_summed, "part int, side int, conv_id bigint, costs array<bigint>, opened array<bigint>")
    plan = joined([tuple(r) for r in summary.collect()])  # two rows a task
    kinds = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in _REPAIRED)
    return dealt.mapInArrow(_repairer(plan), kinds)
