"""Operator 13: generalised LR repair of a conversation's structure.

Role initials have to read ``(s?(ua)+)?``: an optional system row, then pairs of
user and assistant, or nothing.  The grammar is

    S -> (nothing) | s P | P        P -> P u a | u a

Every row is kept, reroled or deleted, and rows without text may be inserted;
``COST`` weighs the edits.  All readings of a conversation are parsed at once on
a graph-structured stack: one node per LR state on top (``SHIFT``, ``REDUCE``), equal tops merge
and keep the reading of least (cost, audit).  The audit, the edits' initials in
order, is not carried along: of two readings of the same rows none is a prefix
of the other, so their order is settled once and kept as a rank.  Each row adds
a bounded number of links to the stack, and the best reading is read back from them.

Long conversations are cut into segments of ``SEGMENT`` rows.  A segment is parsed
from every top that can enter it, which gives costs and ranks for each pair of
tops; those few numbers are chained over a conversation's segments, and each
segment is then parsed again between the two tops that the best reading has there.

Scale: rows are numbered over range partitions (``ordered``), so a conversation
of any length is parsed in many tasks.  Repeats are found by counting (conversation,
role, text) hashes.  A conversation's audit and the hash of its repaired rows are
one value each and sequential, so one task streams its rows in order at the end,
with one segment in memory.

Defined cases: a null conv_id or turn reads as one space in the hashed string, a
null role or text as one space; rows with a null conv_id are one conversation; null
turns come first, equal turns are ordered by role, then text (as they were before the
damage), and a repeated row follows its original; a role without a first letter
fits no rule and can only be reroled or deleted; extra columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .ordered import numbered, runs

COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_KEPT = 5
SEGMENT = 1024
NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
SPACE = " \t\n\v\f\r"
ROLE = {"u": "user", "a": "assistant"}

# LR states by what stands on the stack: 0 (nothing), 1 s, 2 u, 3 u a, 4 P, 5 s P, 6 P u, 7 P u a
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (4, "u"): 6, (5, "u"): 6, (6, "a"): 7}
REDUCE = {3: 2, 7: 3}                # P -> u a pops two, P -> P u a pops three
GOTO = {0: 4, 1: 5}                  # after a reduction to P, by the state below
ACCEPT = (0, 4, 5)
TOPS = (0, 1, 2, 4, 5, 6)            # the states that can wait for a row; 3 and 7 are reduced at once


class Stack:
    """A reading's stack: a top state over a shared rest; equal tops merge, so there is one for each top."""

    __slots__ = ("state", "below")

    def __init__(self, state: int, below: Stack | None = None):
        self.state, self.below = state, below

    def shift(self, symbol: str) -> Stack | None:
        """The stack after a symbol and the reduction that it completes; None: no such action."""
        state = SHIFT.get((self.state, symbol))
        if state is None:
            return None
        top = Stack(state, self)
        if state in REDUCE:
            rest = top
            for _ in range(REDUCE[state]):
                rest = rest.below
            top = Stack(GOTO[rest.state], rest)
        return top


def stack_of(top: int) -> Stack:
    """A stack with this top.  What lies below matters by kind only: with or without a system row."""
    s = Stack(0)
    return {0: s, 1: Stack(1, s), 2: Stack(2, s), 4: Stack(4, s), 5: Stack(5, Stack(1, s)), 6: Stack(6, Stack(4, s))}[top]


def _inserted(stack: Stack) -> list[tuple[str, Stack]]:
    """The stacks that up to two inserted rows lead to (a third would undo the first)."""
    out = [("", stack)]
    for _ in range(2):
        edits, s = out[-1]
        out.append((edits + "I", s.shift("u") or s.shift("a")))
    return out


class Parse:
    """Rows (initial, fault) parsed from one top on, row by row."""

    def __init__(self, top: int):
        # per top: (cost, rank of its audit among all tops, stack)
        self.live: dict[int, tuple[int, int, Stack]] = {top: (0, 0, stack_of(top))}
        self.links: list[dict[int, tuple[int, str]]] = []    # per row, for each top: the top before and the edits

    def row(self, initial: str, fault: int) -> None:
        best: dict[int, tuple[int, int, str, int, Stack]] = {}
        stays = TRUNCATED_KEPT if fault == TRUNCATED else 0
        for top, (cost, rank, stack) in self.live.items():
            for edits, s in _inserted(stack):
                spent = cost + COST["I"] * len(edits)
                ways = [(COST["D"], "D", s)]
                if fault not in (BLANK, DUPLICATE):
                    ways.append((COST["K"] + stays, "K", s.shift(initial)))
                    ways += [(COST["R"] + stays, "R", s.shift(x)) for x in ROLE]
                for price, edit, to in ways:
                    if to is not None:
                        new = (spent + price, rank, edits + edit, top, to)
                        if to.state not in best or new[:3] < best[to.state][:3]:
                            best[to.state] = new
        order = sorted(best, key=lambda x: best[x][1:3])
        self.links.append({x: (best[x][3], best[x][2]) for x in order})
        self.live = {x: (best[x][0], k, best[x][4]) for k, x in enumerate(order)}

    def audit(self, top: int) -> list[str]:
        """The edits of each row, of the best reading that ends with ``top``."""
        out = []
        for links in reversed(self.links):
            top, edits = links[top]
            out.append(edits)
        return out[::-1]


def finish(live: dict[int, tuple]) -> tuple[int, str, int]:
    """(cost, rows inserted at the end, top) of the best complete reading; ``live``: top -> (cost, rank, ...)."""
    ends = [(cost + COST["I"] * len(edits), rank, edits, top) for top, (cost, rank, *_) in live.items()
            for edits, s in _inserted(stack_of(top)) if s.state in ACCEPT]
    cost, _, edits, top = min(ends)
    return cost, edits, top


def repaired_rows(rows: list[tuple[str, str]], edits: list[str], stack: Stack):
    """The repaired (role, text) rows, and the stack after them."""
    out = []
    for (role, text), e in zip(rows, edits):
        for x in e:
            if x == "D":
                continue
            symbol = role[:1] if x == "K" else next(s for s in ROLE if stack.shift(s) is not None)
            out.append((role if x == "K" else ROLE[symbol], "" if x == "I" else text))
            stack = stack.shift(symbol)
    return out, stack


# -- rows -----------------------------------------------------------------------------

def damage(conversations: DataFrame, classes: int = 20) -> DataFrame:
    """Rows (c, turn, role, text, role0, text0, copy) after the damage; c is the id as text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select(blank("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role0"), blank("text").alias("text0"),
                             (F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % classes).alias("harm"))
    d = d.where("harm <> 0")
    d = d.withColumn("role", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role0")))
    d = d.withColumn("text", F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text0", ".!?", "")).otherwise(F.col("text0")))
    return d.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("harm")


def _hashes() -> list[Column]:
    return [F.xxhash64(F.lit(1), "role", "text"), F.xxhash64(F.lit(2), "role", "text")]


def faults(rows: DataFrame) -> DataFrame:
    """Rows (c, pos, turn, role, text, fault): numbered per conversation, each with its first fault."""
    d = numbered(rows, ["c", "turn", "role0", "text0", "copy"], "row", "rows").drop("role0", "text0", "copy")
    first = d.groupBy("c").agg(F.min("row").alias("first"))
    d = d.join(first, "c").withColumn("pos", F.col("row") - F.col("first")).drop("row", "first")
    h1, h2 = _hashes()
    d = d.withColumn("h1", h1).withColumn("h2", h2)
    seen = d.groupBy("c", "h1", "h2").agg(F.min("pos").alias("seen"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    d = d.join(seen, ["c", "h1", "h2"], "left")
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(stripped == "", BLANK).when(F.col("pos") > F.col("seen"), DUPLICATE)
             .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NONE))
    return cut(d.select("c", "pos", "turn", "role", "text", fault.alias("fault")), "faults")


def _sorted(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    # a fixed number of partitions: parsing costs far more than the few bytes of a row, by which partitions would be merged
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by).sortWithinPartitions(*by, *within)


SUMMARY = ("c string, seg long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, head string, tail string, "
           "tops array<int>, ends array<array<int>>, costs array<array<long>>, ranks array<array<int>>")


def summaries(rows: DataFrame, segment: int) -> DataFrame:
    """One row per segment: counts, its first and last initial, and (end, cost, rank) for each top it can start from."""

    def run(batches):
        key = lambda r: (r["c"], r["seg"])
        for (c, seg), group in groupby(runs(batches, key), lambda x: x[0]):
            parses = {top: Parse(top) for top in (TOPS if seg else (0,))}
            count, illegal, head, tail = [0, 0, 0, 0], 0, None, ""
            for _, r in group:
                x, fault = r["initial"], r["fault"]
                count[fault] += 1
                illegal += head is not None and tail + x not in ("su", "ua", "au")
                head, tail = x if head is None else head, x
                for p in parses.values():
                    p.row(x, fault)
                    p.links.clear()      # a summary needs no links
            live = [p.live for p in parses.values()]
            yield pa.RecordBatch.from_pylist([{
                "c": c, "seg": seg, "n_blank": count[BLANK], "n_duplicate": count[DUPLICATE], "n_truncated": count[TRUNCATED], "n_illegal": int(illegal),
                "head": head, "tail": tail, "tops": list(parses), "ends": [list(x) for x in live],
                "costs": [[v[0] for v in x.values()] for x in live], "ranks": [[v[1] for v in x.values()] for x in live]}], schema=schema)

    d = rows.select("c", F.floor(F.col("pos") / segment).alias("seg"), "pos", F.left("role", F.lit(1)).alias("initial"), "fault")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(SUMMARY))
    return _sorted(d, ["c", "seg"], ["pos"]).mapInArrow(run, SUMMARY)


PLAN = "c string, seg long, top int, end int, last boolean, tail string, cost long, blank long, duplicate long, truncated long, illegal long"


def plan(segments: DataFrame) -> DataFrame:
    """For every segment the tops between which the best reading passes it; a conversation's totals stand with its last."""

    def run(batches):
        for c, group in groupby(runs(batches, lambda r: r["c"]), lambda x: x[0]):
            live, back, totals, tail = {0: (0, 0)}, [], [0, 0, 0, 0], None
            for _, r in group:
                for k, name in enumerate(("n_blank", "n_duplicate", "n_truncated", "n_illegal")):
                    totals[k] += r[name]
                totals[3] += tail is not None and tail + r["head"] not in ("su", "ua", "au")
                tail, best = r["tail"], {}
                for top, ends, costs, ranks in zip(r["tops"], r["ends"], r["costs"], r["ranks"]):
                    if top in live:
                        cost, rank = live[top]
                        for end, more, own in zip(ends, costs, ranks):
                            new = (cost + more, rank, own, top)
                            if end not in best or new < best[end]:
                                best[end] = new
                order = sorted(best, key=lambda x: best[x][1:3])
                back.append({x: best[x][3] for x in order})
                live = {x: (best[x][0], k) for k, x in enumerate(order)}
            cost, inserted, end = finish(live)
            rows = []
            for seg in range(len(back) - 1, -1, -1):
                is_last = seg == len(back) - 1
                rows.append((c, seg, back[seg][end], end, is_last, inserted if is_last else None, *((cost, *totals) if is_last else [None] * 5)))
                end = back[seg][end]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(PLAN))
    return _sorted(segments, ["c"], ["seg"]).mapInArrow(run, PLAN)


REPAIRED = "c string, cost long, blank long, duplicate long, truncated long, illegal long, audit string, repaired_sha256 string"


def _repair(rows: DataFrame, planned: DataFrame, segment: int) -> DataFrame:
    """Every conversation's audit and the hash of its repaired rows, streamed in order."""

    def run(batches):
        for c, group in groupby(runs(batches, lambda r: r["c"]), lambda x: x[0]):
            sha, audit, first, last, stack = hashlib.sha256(), [], True, None, stack_of(0)
            for _, part in groupby((r for _, r in group), lambda r: r["seg"]):
                own = []
                for r in part:
                    if not own:
                        last, parse = r, Parse(r["top"])
                    parse.row(r["role"][:1], r["fault"])
                    own.append((r["role"], r["text"]))
                edits = parse.audit(last["end"])
                if last["last"]:
                    edits.append(last["tail"])
                    own.append(("", ""))
                done, stack = repaired_rows(own, edits, stack)
                stack = _flat(stack)
                audit += edits
                for role, text in done:
                    sha.update((("" if first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    first = False
            yield pa.RecordBatch.from_arrays(
                [pa.array([c]), *[pa.array([last[k]], pa.int64()) for k in ("cost", "blank", "duplicate", "truncated", "illegal")],
                 pa.array(["".join(audit)]), pa.array([sha.hexdigest()])],
                names=["c", "cost", "blank", "duplicate", "truncated", "illegal", "audit", "repaired_sha256"])

    d = rows.select("c", F.floor(F.col("pos") / segment).alias("seg"), "pos", "role", "text", "fault").join(planned, ["c", "seg"])
    return _sorted(d, ["c"], ["pos"]).mapInArrow(run, REPAIRED)


def _flat(stack: Stack) -> Stack:
    """An equal stack without what earlier segments left below (with or without a system row is all that counts)."""
    return stack_of(stack.state)


def repair(conversations: DataFrame, segment: int = SEGMENT, classes: int = 20) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = faults(damage(conversations, classes))
    planned = cut(plan(summaries(rows, segment)), "plan")
    done = _repair(rows, planned, segment)
    span = rows.groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    ids = conversations.select(F.col("conv_id")).distinct().withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero, nothing = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    out = ids.join(done, "c", "left").join(span, "c", "left")
    return out.select("conv_id", *[F.coalesce(k, zero).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
