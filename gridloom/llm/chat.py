"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turn, ended by
either. A turn may be kept, merged into the message before it, relabelled, or preceded by an empty
message; dynamic programming over the automaton's states finds the cheapest repair, and the
repaired sequence is rendered.

Rows are sorted by conversation and turn over all tasks, so a conversation of any length lies in
neighbouring partitions. The cost of a run of turns from each state to each state is a small
matrix, and runs compose by (min, +) products: a first pass makes the matrices of each partition's
outermost runs, the driver joins them (two a partition, whatever the data), and a second pass
repairs each run between the states found for its ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: Other names of the roles, and the costs of the repairs.
ALIASES = {"developer": "system", "human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "agent": "assistant"}
MERGE, RELABEL, INSERT = 1, 2, 3
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (USER, ASSISTANT)
FAR = 1 << 50
MARK, ESCAPED = re.compile(r"<(~*)\|"), re.compile(r"<(~*)~\|")
#: Bytes of text in a partition, about: a partition's longest conversation is held as a whole.
PART = 64 << 20


def role_of(name: str | None) -> int | None:
    name = (name or "").strip().lower()
    return ROLES.get(ALIASES.get(name, name))


def moves(role: int | None) -> list[tuple[int, int, int, bool, int | None]]:
    """(from, to, cost, merged, role inserted before) for a turn of this role, cheapest kinds first."""
    out = []
    for s in LEGAL:
        for t in (SYSTEM, USER, ASSISTANT):
            label = 0 if t == role else RELABEL
            if t in LEGAL[s]:
                out.append((s, t, label, False, None))
            if s == t:
                out.append((s, t, MERGE + label, True, None))
            for q in LEGAL[s]:
                if t in LEGAL[q]:
                    out.append((s, t, INSERT + label, False, q))
    return sorted(out, key=lambda m: (m[2], m[4] is not None, m[0], m[1]))


MOVES = {r: moves(r) for r in (None, SYSTEM, USER, ASSISTANT)}
STATES = range(4)


def step(costs: list[int], role: int | None) -> tuple[list[int], list]:
    """The costs after a turn, and the move that gives each state its cost."""
    new, how = [FAR] * 4, [None] * 4
    for m in MOVES[role]:
        if (c := costs[m[0]] + m[2]) < new[m[1]]:
            new[m[1]], how[m[1]] = c, m
    return new, how


def matrix(roles: list[int | None]) -> list[list[int]]:
    """Costs from each state to each state over a run of turns."""
    out = []
    for s in STATES:
        costs = [0 if k == s else FAR for k in STATES]
        for r in roles:
            costs, _ = step(costs, r)
        out.append(costs)
    return out


def best_end(costs: list[int]) -> int:
    return min(ENDS, key=lambda s: (costs[s], s))


def repair(roles: list[int | None], enter: int = START, leave: int | None = None) -> list[tuple]:
    """The moves of a cheapest repair between two states; without `leave`, to a legal end."""
    costs, back = [0 if k == enter else FAR for k in STATES], []
    for r in roles:
        costs, how = step(costs, r)
        back.append(how)
    at, out = best_end(costs) if leave is None else leave, []
    for how in reversed(back):
        out.append(how[at])
        at = how[at][0]
    return out[::-1]


def chain(runs: list[dict]) -> dict[tuple[int, str], tuple[int, int, bool]]:
    """For each outermost run (part, place): its states at entry and exit, and whether its
    conversation ends with it. Runs come in order; equal keys in a row are one conversation."""
    out, k = {}, 0
    while k < len(runs):
        end = k + 1
        while end < len(runs) and runs[end]["part"] > runs[end - 1]["part"] and (runs[end]["key"], runs[end]["null"]) == (runs[k]["key"], runs[k]["null"]) and runs[end]["place"] != "last" and runs[end - 1]["place"] != "first":
            end += 1
        before, costs = [], [0, FAR, FAR, FAR]
        for r in runs[k:end]:
            before.append(costs)
            m = r["costs"]
            costs = [min(min(costs[s] + m[4 * s + t] for s in STATES), FAR) for t in STATES]
        at = best_end(costs)
        for r, c in zip(reversed(runs[k:end]), reversed(before), strict=True):
            enter = min(STATES, key=lambda s, c=c, r=r, at=at: (c[s] + r["costs"][4 * s + at], s))
            out[r["part"], r["place"]] = (enter, at, r is runs[end - 1])
            at = enter
        k = end
    return out


def _runs(batches: Iterator[pa.RecordBatch], text: bool) -> Iterator[tuple]:
    """(part, key, rows) for each run of equal keys in this partition's order."""
    key, rows, part, begun = None, [], None, False
    for batch in batches:
        keys, parts = batch.column("key").to_pylist(), batch.column("part").to_pylist()
        values = list(zip(*(batch.column(c).to_pylist() for c in (("role", "turn", "text") if text else ("role",))), strict=True))
        for k, p, v in zip(keys, parts, values, strict=True):
            if begun and k != key:
                yield part, key, rows
                rows = []
            key, part, begun = k, p, True
            rows.append(v)
    if begun:
        yield part, key, rows


def _outermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, last, n = None, None, 0
    for part, key, rows in _runs(batches, False):
        last, n = (part, key, rows), n + 1
        first = first or last
    for place, run in (("only", first),) if n == 1 else (("first", first), ("last", last)) if n else ():
        part, key, rows = run
        costs = [c for row in matrix([role_of(r[0]) for r in rows]) for c in row]
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "place": [place], "key": pa.array([None if key is None else str(key)], pa.string()), "null": [key is None], "costs": pa.array([costs], pa.list_(pa.int64()))})


def escaped(text: str | None) -> str:
    """A text that spells no marker: between < and | goes one tilde more than there was. Only `<`,
    tildes and `|` in a row change, and unescaped() gives the text back."""
    return MARK.sub(r"<\1~|", text or "")


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def rendered(moved: list[tuple], texts: list[str | None], enter: int, ends: bool) -> list[str]:
    """One piece a turn; a conversation's pieces in order are its rendered sequence."""
    out, opened = [], enter != START
    for (_, t, _, merged, inserted), text in zip(moved, texts, strict=True):
        piece = "\n" if merged else ("<|end|>\n" if opened else "") + (f"<|{NAMES[inserted]}|>\n<|end|>\n" if inserted is not None else "") + f"<|{NAMES[t]}|>\n"
        out.append(piece + escaped(text))
        opened = True
    if ends and out:
        out[-1] += "<|end|>\n"
    return out


def format_chats(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: int | None = None) -> DataFrame:
    """(key, turn, role, new_role, action, inserted, cost, rendered), a row per turn.

    action is keep, merge, relabel or merge+relabel; inserted is the role of an empty message put
    before the turn, or null. Roles match without case, common other names are known, and a null or
    unknown role is relabelled. Turns of one number come in an order fixed by their content. Null
    keys are one conversation, null turns come first, null texts are empty. The names of other
    columns do not matter: they are left out. An empty df gives an empty result. Which of several
    cheapest repairs is taken may depend on where partitions begin, the cost never does. Texts are
    rendered escaped(), so that they spell no marker and can be had back. `parts` is the number of
    partitions, by default the session's, or more for more than 64 MB of text in each.
    """
    spark = df.sparkSession
    small_batches(spark)
    held = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // PART))
    rows = df.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text")).withColumn("uid", F.monotonically_increasing_id())
    order = ["key", "turn", "tie", "uid"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie", "uid")
    rows = checkpointed(rows.withColumn("part", F.spark_partition_id()))
    found = rows.select("key", "part", "role").mapInArrow(_outermost, "part int, place string, key string, null boolean, costs array<long>").collect()  # two rows a partition at most
    rank = {"first": 0, "only": 0, "last": 1}
    sent = spark.sparkContext.broadcast(chain(sorted((r.asDict() for r in found), key=lambda r: (r["part"], rank[r["place"]]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "turn", "role", "new_role", "action", "inserted", "cost", "rendered"]

        def done(part: int, own: object, rows: list, place: str | None) -> pa.RecordBatch:
            enter, leave, ends = sent.value[part, place] if place else (START, None, True)
            moved = repair([role_of(r[0]) for r in rows], enter, leave)
            pieces = rendered(moved, [r[2] for r in rows], enter, ends)
            action = ["+".join(["merge"] * m[3] + ["relabel"] * (m[1] != role_of(r[0]))) or "keep" for m, r in zip(moved, rows, strict=True)]
            cols = [[own] * len(rows), [r[1] for r in rows], [r[0] for r in rows], [NAMES[m[1]] for m in moved], action, [NAMES.get(m[4]) for m in moved], [m[2] for m in moved], pieces]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names)

        held, first, kind = None, True, None

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in source:
                kind = batch.schema.field("key").type
                yield batch

        for item in _runs(typed(batches), True):
            if held is not None:
                yield done(*held, "first" if first else None)
                first = False
            held = item
        if held is not None:
            yield done(*held, "only" if first else "last")

    schema = rows.select("key", "turn", "role", *(F.lit("").alias(c) for c in ("new_role", "action", "inserted")), F.lit(0).alias("cost"), F.lit("").alias("rendered")).schema
    for field in schema:
        field.nullable = True
    out = rows.mapInArrow(run, schema)
    return out.withColumnRenamed("key", key).withColumnRenamed("turn", turn)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
