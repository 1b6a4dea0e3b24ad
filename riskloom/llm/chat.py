"""Chat formatting by minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant turns in alternation, ending with the
assistant.  A turn may be kept, relabelled, merged into the turn before it (which must have its final role), or
preceded by empty turns; an empty assistant turn may close the conversation.  Each turn is thus a small table of
costs between the automaton's states, and the cheapest repair a chain of such tables.

A conversation may hold a third of all turns, so it is cut into segments of at most SEGMENT turns: tables are
multiplied (least sums) within segments, the products of conversations with several segments are chained, which fixes
the states at the segments' borders, and each segment is decoded between them.  Segments come from one sort of the
turns, in batches; repairs of short runs of roles are remembered.

Costs are in COST; ties go to the earlier action in the order keep, relabel, merge, insertion.

Defined results: turns are ordered by turn (null first), then role and text; a null or unknown role must be
relabelled; a null text renders as empty; turns of a null conv_id are one conversation; repeated rows are turns of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_side

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, STATES, SEGMENT = 3, 4, 4096
#: Turns of the longest run of roles whose repair is remembered, and how many are.
MEMO, REMEMBERED = 32, 1 << 14
SEGMENT_TYPES = {"conv_id": pa.string(), "seg": pa.int64(), "costs": pa.list_(pa.int64()), "place": pa.list_(pa.int64()), "turn": pa.list_(pa.int64()), "role": pa.list_(pa.string()), "text": pa.list_(pa.string())}
OUT_TYPES = {"conv_id": pa.string(), "turn": pa.int64(), "place": pa.int64(), "role": pa.string(), "role_out": pa.string(), "action": pa.string(), "cost": pa.int64(), "rendered": pa.string()}
#: What each action costs.
COST = {"relabel": 3, "merge": 1, "insert": 2, "unknown": 1}
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
FAR = 1 << 40

#: Empty turns to pass from a state to one from which a turn of the role may follow, as the shortest lists.
_NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}


def _bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    out = {}
    for state in range(STATES):
        level, seen = [(state, ())], {state}
        while level:
            after = []
            for s, path in level:
                for role in _NEXT[s]:
                    if (state, role) not in out:
                        out[state, role] = path
                    if role not in seen:
                        seen.add(role)
                        after.append((role, (*path, role)))
            level = after
    return out


BRIDGE = _bridges()


def moves(role: str | None) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(state before, state after, cost, action, inserted roles) for a turn of the given role."""
    own = ROLES.index(role) if role in ROLES else None
    out = []
    for before in range(STATES):
        for after in range(3):
            change = 0 if after == own else COST["unknown"] if own is None else COST["relabel"]
            label = "keep" if after == own else "relabel"
            if before == after:
                out.append((before, after, change + COST["merge"], "merge" if label == "keep" else "relabel+merge", ()))
            if (before, after) in BRIDGE:
                path = BRIDGE[before, after]
                out.append((before, after, change + COST["insert"] * len(path), label if not path else f"{label}+insert", path))
    return sorted(out, key=lambda m: (m[2], ("keep", "relabel", "merge", "relabel+merge").index(m[3]) if not m[4] else 4))


MOVES = {r: moves(r) for r in (*ROLES, None)}
_TABLE = {}
for _r, _ms in MOVES.items():
    _TABLE[_r] = np.full((STATES, STATES), FAR, dtype=np.int64)
    for _b, _a, _c, _, _ in _ms:
        _TABLE[_r][_b, _a] = min(_TABLE[_r][_b, _a], _c)
#: Cost of ending in each state.
END = np.array([COST["insert"] * 2, COST["insert"], 0, 0], dtype=np.int64)


def known(role: str | None) -> str | None:
    role = role.strip().lower() if isinstance(role, str) else None
    return role if role in ROLES else None


def product(roles: Sequence[str | None]) -> np.ndarray:
    """Least costs between states over a run of turns."""
    total = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    for r in roles:
        total = np.minimum((total[:, :, None] + _TABLE[r][None]).min(axis=1), FAR)
    return total


def decode(roles: Sequence[str | None], before: int, after: int | None = None) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(role, cost, action, inserted roles) of each turn on a cheapest way from one state to another, or to any end."""
    best, back = [FAR] * STATES, []
    best[before] = 0
    for r in roles:
        new, came = [FAR] * STATES, [None] * STATES
        for m in MOVES[r]:
            if best[m[0]] + m[2] < new[m[1]]:
                new[m[1]], came[m[1]] = best[m[0]] + m[2], m
        best = new
        back.append(came)
    at = after if after is not None else int(np.argmin(np.array(best) + END))
    out = []
    for came in reversed(back):
        m = came[at]
        out.append((m[1], m[2], m[3], m[4]))
        at = m[0]
    return out[::-1]


def memo(f: Callable) -> Callable:
    """f, which remembers its results for short runs of roles, within a task."""
    found: dict = {}

    def asked(roles: tuple[str | None, ...], *more):
        if len(roles) > MEMO or (len(found) >= REMEMBERED and (roles, *more) not in found):
            return f(roles, *more)
        if (roles, *more) not in found:
            found[roles, *more] = f(roles, *more)
        return found[roles, *more]

    return asked


def borders(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states before and after each segment on a cheapest way."""
    reach, back = np.full(STATES, FAR, dtype=np.int64), []
    reach[START] = 0
    for t in tables:
        cost = reach[:, None] + t
        back.append(cost.argmin(axis=0))
        reach = cost.min(axis=0)
    at, out = int((reach + END).argmin()), []
    for came in reversed(back):
        out.append((int(came[at]), at))
        at = int(came[at])
    return out[::-1]


def render(texts: list, steps: list, first: bool, last: bool) -> list[str]:
    """What each turn adds to the rendered conversation; a turn is closed by the one after it, or at the end."""
    out = []
    for i, (text, (role, _, action, path)) in enumerate(zip(texts, steps, strict=True)):
        text = text if isinstance(text, str) else ""
        if "merge" in action:
            out.append(f"\n\n{text}")
        else:
            close = "" if first and i == 0 else CLOSE
            out.append(close + "".join(OPEN.format(role=ROLES[p]) + CLOSE for p in path) + OPEN.format(role=ROLES[role]) + text)
    if last and out:
        out[-1] += CLOSE
        role = steps[-1][0]
        tail = (2,) if role == 1 else (1, 2) if role == 0 else ()
        out[-1] += "".join(OPEN.format(role=ROLES[p]) + CLOSE for p in tail)
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each segment, with its table of costs, from turns in order of conversation and place."""
    key, run, done, costs = None, [], [], memo(lambda roles: product(roles).ravel().tolist())

    def close() -> None:
        if run:
            done.append((*key, costs(tuple(known(r[2]) for r in run)), *(list(c) for c in zip(*run, strict=True))))
            run.clear()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), SEGMENT_TYPES.values(), strict=True)], names=list(SEGMENT_TYPES))
        done.clear()
        return out

    for batch in batches:
        for conv, seg, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "place", "turn", "role", "text")), strict=True):
            if (conv, seg) != key:
                close()
                key = (conv, seg)
            run.append(turn)
        if done:
            yield rows()
    close()
    if done:
        yield rows()


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    way = memo(decode)
    for batch in batches:
        out: list[list] = [[] for _ in OUT_TYPES]
        for one in batch.to_pylist():
            alone = one["before"] is None
            roles = tuple(known(r) for r in one["role"])
            steps = way(roles, START if alone else one["before"], one["after"])
            said = render(one["text"], steps, alone or one["first"], alone or one["last"])
            for column, values in zip(out, ([one["conv_id"]] * len(steps), one["turn"], one["place"], one["role"], [ROLES[s[0]] for s in steps], [s[2] for s in steps], [s[1] for s in steps], said), strict=True):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, OUT_TYPES.values(), strict=True)], names=list(OUT_TYPES))


def _chained(key: tuple, segs: pd.DataFrame) -> pd.DataFrame:
    segs = segs.sort_values("seg")
    ways = borders([np.array(c, dtype=np.int64).reshape(STATES, STATES) for c in segs["costs"]])
    n = len(segs)
    return pd.DataFrame({"c": [key[0]] * n, "s": segs["seg"].tolist(), "before": [b for b, _ in ways], "after": [a for _, a in ways], "first": [i == 0 for i in range(n)], "last": [i == n - 1 for i in range(n)]})


def repaired(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per turn: conv_id, turn, place (in order), role, role_out, action, cost and rendered; joined by place the pieces are the conversation."""
    cast = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    parts = cast.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = cast.repartitionByRange(int(parts), "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = placed.withColumn("place", F.monotonically_increasing_id()).withColumn("seg", F.expr(f"place div {segment}"))
    segments = saved(rows.mapInArrow(_segments, "conv_id string, seg long, costs array<long>, place array<long>, turn array<long>, role array<string>, text array<string>"))
    # only conversations of several segments are chained; they are few, or long
    several = saved(segments.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c")))
    chains = segments.select("conv_id", "seg", "costs").join(small_side(several), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    ways = saved(chains.groupBy("conv_id").applyInPandas(_chained, "c string, s long, before int, after int, first boolean, last boolean"))
    ends = segments.drop("costs").join(small_side(ways), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")), "left").drop("c", "s", "seg")
    return ends.mapInArrow(_decoded, "conv_id string, turn long, place long, role string, role_out string, action string, cost long, rendered string")
