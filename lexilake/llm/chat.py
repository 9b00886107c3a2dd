"""Chat formatting with minimum-cost role repair.

A legal conversation is START [system] user assistant user assistant ..., and may end after any turn but system. Each
given turn is kept, relabelled, or merged into the turn before it (relabelled if need be), and empty turns may be
inserted before it. The cheapest repair is a shortest path over the automaton's states; ties go to keeping, then
merging, then relabelling, then inserting.

Plan. Turns are dealt by ranges of their order, cut at bounds from a sample, so a long conversation spreads over tasks,
and a task reads its turns in spans of at most SPAN rows. A conversation within one span is repaired by itself. Each
span of the others makes one min-plus matrix over the states; the driver chains these (128 bytes a span, at most a
span in SPAN rows and two a range) to find the state at each span's ends, and each span is then traced by itself.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm.common import bounded_batches, partitions

SPAN = 1024
TASK_ROWS = 200_000
STATES = ("start", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = (0, 2, 3)
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
_BIG = 1e18


def _ways() -> list[tuple[int, int, str, tuple[int, ...], float]]:
    """(from, to, how, roles of the empty turns inserted before, cost without relabelling) of one given turn."""
    out = []
    for s in range(4):
        paths = {(): s}
        for _ in range(2):
            paths |= {(*p, t): t for p, at in list(paths.items()) for t in NEXT[at] if len(p) < 2}
        for p, at in paths.items():
            out += [(s, t, "keep", p, INSERT * len(p)) for t in NEXT[at]]
        if s:
            out.append((s, s, "merge", (), MERGE))
    return out


def _table() -> dict[str, tuple[np.ndarray, list]]:
    """For each given role: costs[from, to], and the best way of each."""
    tables = {}
    for role in (*STATES[1:], ""):
        cost, best = np.full((4, 4), _BIG), [[None] * 4 for _ in range(4)]
        rank = {"keep": 0, "merge": 1, "relabel": 2}
        for s, t, how, ins, c in _ways():
            c += RELABEL * (STATES[t] != role)
            name = "relabel" if how == "keep" and STATES[t] != role else how
            key = (c, len(ins), rank[name], ins)
            if best[s][t] is None or key < best[s][t][0]:
                best[s][t], cost[s, t] = (key, name, ins), c
        tables[role] = cost, best
    return tables


TABLE = _table()


def _costs(role: str | None) -> tuple[np.ndarray, list]:
    return TABLE.get((role or "").strip().lower(), TABLE[""])


def trace(roles: list[str | None], first: int, last: int | None) -> list[tuple[str, int, tuple[int, ...], float]]:
    """(how, state after, inserted states, cost) of each turn on the cheapest path from one state to another.

    Without a last state, the path ends in the cheapest final one.
    """
    here = np.full(4, _BIG)
    here[first] = 0
    back = np.zeros((len(roles), 4), np.int8)
    for i, r in enumerate(roles):
        total = here[:, None] + _costs(r)[0]
        back[i] = total.argmin(0)
        here = total.min(0)
    out, at = [], _final(here) if last is None else last
    for i in range(len(roles) - 1, -1, -1):
        s = int(back[i, at])
        key, how, ins = _costs(roles[i])[1][s][at]
        out.append((how, at, ins, float(key[0])))
        at = s
    return out[::-1]


def _final(here: np.ndarray) -> int:
    return min(FINAL, key=lambda s: (here[s], s))


def _key(conv: int | None, turn: int | None, role: str | None, start: str | None) -> tuple:
    """Spark's order of turns: bytes, nulls first but for turn; start is how the text begins."""
    return conv is not None, conv or 0, turn is None, turn or 0, role is not None, (role or "").encode(), start is not None, (start or "").encode()


def _dealer(bounds: list[tuple]):
    """part: the place of a turn's key (its first four columns) among the bounds."""

    def dealt(batches):
        for b in batches:
            part = [bisect.bisect_right(bounds, _key(*k)) for k in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in (0, 1, 2, *range(4, b.num_columns))), pa.array(part, pa.int32())], ["conv_id", "turn", "role", *b.schema.names[4:], "part"])

    return dealt


def _spans(batches, size: int):
    """((part, conversation), number of the span in these, whether it can be all of the conversation, rows) of sorted
    rows that begin with part and conv_id; a span may lie in more than one batch."""

    def cut():
        now, n, rows = None, 0, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != now or len(rows) == size:
                    if rows:
                        yield now, n, rows
                    now, n, rows = row[:2], n + 1 if row[:2] == now else 0, []
                rows.append(row)
        if rows:
            yield now, n, rows

    before, now = None, None
    for after in itertools.chain(cut(), [None]):
        if now:
            # a part's first and last conversation may go on in another part
            whole = before and after and before[0] == after[0][0] == now[0][0] and before != now[0] != after[0]
            yield now[0], now[1], bool(whole), now[2]
            before = now[0]
        now = after


def _matrices(size: int):
    def found(batches):
        out = []
        types, names = (pa.int32(), pa.int64(), pa.int64(), pa.binary()), "part conv_id span matrix"
        for (part, conv), span, whole, rows in _spans(batches, size):
            if whole:
                continue
            m = np.where(np.eye(4, dtype=bool), 0.0, _BIG)
            for row in rows:
                m = (m[:, :, None] + _costs(row[2])[0][None, :, :]).min(1)
            out.append((part, conv, span, np.minimum(m, _BIG).tobytes()))
            if len(out) == 1000:
                yield _rows(out, names, types)
                out = []
        yield _rows(out, names, types)

    return found


def _chain(spans: list) -> dict[tuple, tuple[int, int, bool]]:
    """(state before, state after, whether it is its conversation's last) of each (part, conversation, span)."""
    out = {}
    order = sorted(spans, key=lambda x: (x["conv_id"] is not None, x["conv_id"] or 0, x["part"], x["span"]))
    for conv, group in itertools.groupby(order, key=lambda x: x["conv_id"]):
        here, back = np.array([0, _BIG, _BIG, _BIG]), []
        for x in group:
            total = here[:, None] + np.frombuffer(x["matrix"]).reshape(4, 4)
            back.append((x["part"], x["span"], total.argmin(0).astype(np.int8)))
            here = total.min(0)
        at = _final(here)
        for k in range(len(back) - 1, -1, -1):
            part, span, came = back[k]
            s = int(came[at])
            out[part, conv, span] = s, at, k == len(back) - 1
            at = s
    return out


def _rows(rows: list, names: str, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names.split())


def repair(turns: DataFrame) -> DataFrame:
    """One row per row of turns(conv_id, turn, role, text): conv_id, turn, role, action, new_role, inserted, cost, piece.

    Turns stand in order of turn (nulls last), then role and text. A null conv_id is one conversation. Roles are read without case and
    outer spaces; others, and null, must be relabelled. inserted: roles of the empty turns put before, with spaces
    between. The pieces of a conversation, in order, are its rendering: each turn as a line with its role, its text
    and an end mark; a merged text follows a line break. A null text is empty.
    """
    spark = turns.sparkSession
    size = SPAN
    bounded_batches(spark)
    text = F.col("text").cast("string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.substring(text, 1, 64).alias("start"), text.alias("text"))
    n = rows.count()
    tasks = max(partitions(spark), -(-n // TASK_ROWS))
    keys = rows.drop("text")
    sample = sorted(_key(*r) for r in keys.sample(min(1.0, 400.0 * tasks / max(1, n)), 42).collect())
    dealt = _dealer(sorted({sample[len(sample) * j // (4 * tasks)] for j in range(1, 4 * tasks)} if sample else ()))
    order = ["part", "conv_id", F.col("turn").asc_nulls_last(), "role"]

    found = keys.mapInArrow(dealt, "conv_id long, turn long, role string, part int").repartition(tasks, "part").sortWithinPartitions(*order)
    ends = _chain(found.select("part", "conv_id", "role").mapInArrow(_matrices(size), "part int, conv_id long, span long, matrix binary").collect())

    def traced(batches):
        out = []
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
        names = "conv_id turn role action new_role inserted cost piece"
        for (part, conv), span, whole, group in _spans(batches, size):
            first, last, final = (0, None, True) if whole else ends[part, conv, span]
            at = first
            for i, (row, (how, state, ins, cost)) in enumerate(zip(group, trace([r[2] for r in group], first, last), strict=True)):
                text = row[4] or ""
                if how == "merge":
                    piece = "\n" + text
                else:
                    piece = "<|end|>\n" if at else ""
                    piece += "".join(f"<|{STATES[x]}|>\n<|end|>\n" for x in ins) + f"<|{STATES[state]}|>\n" + text
                at = state
                if final and i == len(group) - 1:
                    piece += "<|end|>\n"
                out.append((conv, row[3], row[2], how, STATES[state], " ".join(STATES[x] for x in ins), cost, piece))
            if len(out) > 1000:
                yield _rows(out, names, types)
                out = []
        yield _rows(out, names, types)

    return (
        rows.mapInArrow(dealt, "conv_id long, turn long, role string, text string, part int")
        .repartition(tasks, "part")
        .sortWithinPartitions(*order, "text")
        .select("part", "conv_id", "role", "turn", "text")
        .mapInArrow(traced, "conv_id long, turn long, role string, action string, new_role string, inserted string, cost double, piece string")
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
