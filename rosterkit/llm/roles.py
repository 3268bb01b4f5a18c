"""Operator 2: chat formatting by minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant
messages in turn, ending with the assistant.  Every turn either starts a message
(under its own role, or relabelled), or is merged into the message before;
empty messages may be inserted anywhere.  Dynamic programming over the states of
this automaton (the role of the last message) finds the cheapest repair, which
is then rendered.

Scale: rows are numbered over range partitions (``ordered``), so a conversation
of any number of rows is cut into segments of SEGMENT rows, whatever their turn
numbers and ids.  A segment is summarised by its (min, +) matrix: the least cost from each state before it
to each state after it.  Matrices are combined over super segments and over the
conversation, which fixes the states at every segment's edges; then each segment
is repaired by itself.  So a conversation with a third of all rows is many
tasks.  Rows stream through tasks sorted by segment; a segment is all that is
held.  The result is one row per turn, with the piece of rendered text it adds:
a conversation's pieces, joined in order of (segment, place), are its rendering.

Defined cases: roles are trimmed and lower-cased; a null or unknown role costs a
relabel under any role; null text is empty; turns with equal numbers are ordered
by role, then text; null turns come last; rows with a null conv_id form one
conversation; an input without rows gives none (a conversation has at least one
turn); extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

MERGE, INSERT, RELABEL = 1.0, 2.0, 3.0
SEGMENT = 256          # rows in a segment
SUPER = 1024           # segments in a super segment
ROLES = ("", "system", "user", "assistant")   # states; 0 is the start
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
N = len(ROLES)
CLOSE = "<|end|>\n"


def _paths() -> list[list[tuple[int, ...] | None]]:
    """Shortest runs of inserted messages from state to state."""
    out: list[list[tuple[int, ...] | None]] = [[None] * N for _ in range(N)]
    for s in range(N):
        out[s][s], reach = (), [s]
        for x in reach:
            for y in LEGAL[x]:
                if out[s][y] is None:
                    out[s][y] = (*out[s][x], y)
                    reach.append(y)
    return out


PATHS = _paths()


def options(role: int) -> dict[tuple[int, int], tuple[float, str, tuple[int, ...]]]:
    """(state, next state) -> cost, action and inserted messages of the cheapest way to place a turn (0: unknown role)."""
    best: dict[tuple[int, int], tuple[float, str, tuple[int, ...]]] = {}
    for s in range(N):
        for q in range(1, N):
            renamed = q != role
            ways = []
            if s == q:
                ways.append((MERGE + RELABEL * renamed, "relabel_merge" if renamed else "merge", ()))
            for p in range(N):
                if q in LEGAL[p] and PATHS[s][p] is not None:
                    ways.append((INSERT * len(PATHS[s][p]) + RELABEL * renamed, "relabel" if renamed else "keep", PATHS[s][p]))
            if ways:
                best[s, q] = min(ways, key=lambda w: (w[0], len(w[2]), w[1]))
    return best


OPTIONS = {r: options(r) for r in range(N)}
COST = {r: np.array([[OPTIONS[r].get((s, q), (np.inf,))[0] for q in range(N)] for s in range(N)]) for r in range(N)}
END = np.array([INSERT * len(PATHS[s][3]) if s else np.inf for s in range(N)])


def combine(matrices) -> np.ndarray:
    """(min, +) product."""
    m = np.full((N, N), np.inf)
    np.fill_diagonal(m, 0.0)
    for x in matrices:
        m = (m[:, :, None] + x[None]).min(1)
    return m


def edges(matrices: list[np.ndarray], entry: int, leave: int | None) -> list[tuple[int, int]]:
    """States before and after each step of a cheapest way from ``entry`` to ``leave`` (None: to a legal end)."""
    v = [np.where(np.arange(N) == entry, 0.0, np.inf)]
    for m in matrices:
        v.append((v[-1][:, None] + m).min(0))
    at = int(np.argmin(v[-1] + END)) if leave is None else leave
    out = []
    for m, before in zip(reversed(matrices), reversed(v[:-1])):
        s = int(np.argmin(before + m[:, at]))
        out.append((s, at))
        at = s
    return out[::-1]


def role_state(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) if r in ROLES else 0


def _groups(batches, keys: list[str]):
    """Rows of one key at a time from batches sorted by key."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            k = tuple(r[c] for c in keys)
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(r)
    if rows:
        yield key, rows


def _stream(df: DataFrame, keys: list[str], order: list, fn, schema: str) -> DataFrame:
    """Apply ``fn(key, rows)`` -> rows (dicts) to every group, streaming through partitions sorted by key and ``order``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        out: list[dict] = []
        for key, rows in _groups(batches, keys):
            out += fn(key, rows)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)

    kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    types = pa.schema([(n, kind[c.strip().split(" ")[1]]) for n, c in zip(names, schema.split(","))])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _matrix(rows: list[dict]) -> list[np.ndarray]:
    return [np.array(r["m"]).reshape(N, N) for r in rows]


def repair(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action, n_inserted, cost, text, piece, segment, place."""
    d = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("_c", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    d = numbered(d.withColumn("_last", F.col("turn").isNull()), ["_c", "_last", "turn", "role", "text"], "_row", "turns").drop("_last")
    first_row = d.groupBy("_c").agg(F.min("_row").alias("_first"))
    d = d.join(first_row, "_c").withColumn("_pos", F.col("_row") - F.col("_first")).drop("_row", "_first")
    d = d.withColumn("segment", F.floor(F.col("_pos") / SEGMENT)).withColumn("_super", F.floor(F.col("_pos") / (SEGMENT * SUPER)))

    def summarise(key, rows):
        m = combine(COST[role_state(r["role"])] for r in rows)
        return [{"_c": key[0], "_super": key[1], "segment": key[2], "m": m.ravel().tolist()}]

    order = ["_pos"]
    first = _stream(d.select("_c", "_super", "segment", "_pos", "role"), ["_c", "_super", "segment"], order, summarise,
                    "_c string, _super long, segment long, m array<double>")
    second = _stream(first, ["_c", "_super"], ["segment"],
                     lambda k, rows: [{"_c": k[0], "_super": k[1], "m": combine(_matrix(rows)).ravel().tolist()}],
                     "_c string, _super long, m array<double>")

    def top(key, rows):
        found = edges(_matrix(rows), 0, None)
        return [{"_c": key[0], "_super": r["_super"], "enter": s, "leave": q, "last": int(i == len(rows) - 1)}
                for i, (r, (s, q)) in enumerate(zip(rows, found))]

    supers = _stream(second, ["_c"], ["_super"], top, "_c string, _super long, enter int, leave int, last int")

    def inside(key, rows):
        found = edges(_matrix(rows), rows[0]["enter"], rows[0]["leave"])
        return [{"_c": key[0], "_super": key[1], "segment": r["segment"], "enter": s, "leave": q,
                 "last": int(r["last"] and i == len(rows) - 1)} for i, (r, (s, q)) in enumerate(zip(rows, found))]

    segments = _stream(first.join(supers, ["_c", "_super"]), ["_c", "_super"], ["segment"], inside,
                       "_c string, _super long, segment long, enter int, leave int, last int")

    def place(key, rows):
        found = edges([COST[role_state(r["role"])] for r in rows], rows[0]["enter"], rows[0]["leave"])
        out = []
        for i, (r, (s, q)) in enumerate(zip(rows, found)):
            cost, action, inserted = OPTIONS[role_state(r["role"])][s, q]
            empty = lambda states: "".join(f"<|{ROLES[x]}|>\n{CLOSE}" for x in states)
            piece = "\n" + r["text"] if "merge" in action else (CLOSE if s else "") + empty(inserted) + f"<|{ROLES[q]}|>\n" + r["text"]
            end = PATHS[q][3] if r["last"] and i == len(rows) - 1 else None
            if end is not None:
                piece += CLOSE + empty(end)
                cost += INSERT * len(end)
            out.append({"conv_id": r["conv_id"], "turn": r["turn"], "role": r["role"], "new_role": ROLES[q], "action": action,
                        "n_inserted": len(inserted) + len(end or ()), "cost": cost, "text": r["text"], "piece": piece,
                        "segment": key[1], "place": i})
        return out

    return _stream(d.join(segments.drop("_super"), ["_c", "segment"]), ["_c", "segment"], order, place,
                   "conv_id long, turn long, role string, new_role string, action string, n_inserted int, cost double, "
                   "text string, piece string, segment long, place long")
