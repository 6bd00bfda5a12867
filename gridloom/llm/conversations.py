"""Conversation structure repair: minimum-cost edits that make the roles an optional system message and then
user and assistant in turn.

A forward Viterbi DP runs over each conversation. Its states are the four of the grammar: nothing yet, a
system message, a user's, an assistant's. Each state carries its minimum (cost, audit string), the audit
being the edits' initials, and each row's layer is closed with the insertions that lead on from it, three at
most, since more would only return to a state at a higher cost.

Audits are not copied from layer to layer. Of two of them over the same rows neither can begin the other
before the layer is closed (it would have to go on with insertions only, and ends with a row's edit), so
their order, once settled, stays: a state carries its cost and its audit's rank, and a byte for each row
and state says where it came from.

What a row needs for that is a letter, so only letters are brought together, in the conversation's order.
Texts follow in a second pass with the audit before them, a batch at a time. A conversation is one row
of the result, with a digest that is sequential, so its rows go through one task; what is held of it is
the audit and those bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, forget, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits, and what a truncated row that stays adds.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Where a message of a role leads, by the initial of the role.
LEADS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ENDS = (START, ASSISTANT)
LETTERS = "DKR"
EDITS = {"D": "delete", "K": "keep", "R": "rerole", "I": "insert"}


def moves(letter: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edit) of a row. Its letter is its role's initial, upper case if it is truncated,
    a dot for a role that nothing keeps (a colon if truncated), and x if it has to go."""
    out = [(s, s, DELETE, "D") for s in range(4)]
    if letter != "x":
        more = TRUNCATED if letter in "SUA:" else 0
        out += [(s, t, more, "K") for s, t in LEADS.get(letter.lower(), {}).items()]
        out += [(s, t, RELABEL + more, "R") for role in "ua" for s, t in LEADS[role].items()]
    return out


MOVES = {c: moves(c) for c in "suaSUA.:x"}


def closed(layer: list[tuple | None]) -> list[tuple | None]:
    """The layer with insertions: per state (cost, rank, insertions, state before them)."""
    out = [x and (x[0], x[1], "", s) for s, x in enumerate(layer)]
    for _ in range(3):
        for s in range(4):
            if (x := out[s]) and len(x[2]) < 3:
                (t,) = (LEADS[NEXT[s]][s],)
                new = (x[0] + INSERT, x[1], x[2] + "I", x[3])
                if out[t] is None or new < out[t]:
                    out[t] = new
    return out


class Viterbi:
    """The DP of one conversation, a row at a time."""

    def __init__(self) -> None:
        self.layer, self.back = closed([(0, 0), None, None, None]), bytearray()

    def row(self, letter: str) -> None:
        new: list[tuple | None] = [None] * 4
        layer = self.layer
        for s, t, cost, edit in MOVES[letter]:
            if (x := layer[s]) is not None:
                own = (x[0] + cost, x[1], x[2] + edit, x[3])
                if new[t] is None or own < new[t]:
                    new[t] = own
        order = sorted((x[1], x[2]) for x in new if x)
        self.layer = closed([x and (x[0], order.index((x[1], x[2]))) for x in new])
        self.back += bytes(255 if x is None else x[3] | len(x[2]) - 1 << 2 | LETTERS.index(x[2][-1]) << 4 for x in new)

    def end(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair, the least audit of those."""
        cost, _, inserted, at = min(self.layer[s] for s in ENDS if self.layer[s])
        out = [inserted]
        for k in range(len(self.back) - 4, -1, -4):
            b = self.back[k + at]
            out.append("I" * (b >> 2 & 3) + LETTERS[b >> 4])
            at = b & 3
        return cost, "".join(reversed(out))


def repaired(letters: str) -> tuple[int, str]:
    """(cost, audit) for the rows of a conversation, a letter each."""
    dp = Viterbi()
    for c in letters:
        dp.row(c)
    return dp.end()


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cost, audit) for each run of equal keys."""
    forget()
    key, dp, kind = None, None, None

    def done() -> pa.RecordBatch:
        cost, audit = dp.end()
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([cost], pa.int64()), pa.array([audit], pa.string())], ["key", "cost", "audit"])

    for batch in batches:
        kind = batch.schema.field("key").type
        for k, c in zip(batch.column("key").to_pylist(), batch.column("letter").to_pylist(), strict=True):
            if dp is None or k != key:
                if dp is not None:
                    yield done()
                key, dp = k, Viterbi()
            dp.row(c)
    if dp is not None:
        yield done()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edit, from rows that follow their conversation's audit."""
    forget()
    audit, at, state = "", 0, START
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("key", "place", "turn", "role", "text", "fault", "edit", "new_role", "cost")}

        def put(*values, out=out) -> None:
            for c, v in zip(out, values, strict=True):
                out[c].append(v)

        def insertions(key) -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                new = NEXT[state]
                put(key, at, None, None, "", None, "insert", NAMES[new], INSERT)
                at, state = at + 1, LEADS[new][state]

        for r in batch.to_pylist():
            if r["audit"] is not None:
                audit, at, state = r["audit"], 0, START
            else:
                edit = audit[at]
                new, cost = None, DELETE
                if edit != "D":
                    initial = r["role"][:1] if edit == "K" else NEXT[state]
                    new = r["role"] if edit == "K" else NAMES[initial]
                    cost = (edit == "R") * RELABEL + (r["fault"] == "truncated") * TRUNCATED
                    state = LEADS[initial][state]
                put(r["key"], at, r["turn"], r["role"], r["text"], r["fault"], EDITS[edit], new, cost)
                at += 1
            insertions(r["key"])
        kinds = (batch.schema.field("key").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        if out["key"]:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


#: White space as the contracts define words, and the ends of a sentence.
SPACE = " \t\n\x0b\f\r"


def _fault(text: Column, again: Column) -> Column:
    rest = F.rtrim(text, F.lit(SPACE))
    return F.when(rest == "", "blank").when(again, "duplicate").when(~F.substring(rest, -1, 1).isin(".", "!", "?"), "truncated")


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, place, turn, role, text, fault, edit, new_role, cost), a row per edit.

    The rows of a conversation come by turn (nulls first), then by role and by the digest of the text, and so do
    those of the result: a conversation lies together in one partition, in the order of `place`, which is the
    edit's place in the audit. edit is keep, rerole, delete or insert; new_role is the role that the row
    has in the repaired conversation, null where it is deleted; insertions have no turn, role or fault.
    fault is the first of blank, duplicate (role and text of an earlier row) and truncated, or null.
    Null roles and texts count as one space. Null keys are one conversation. Repeated rows are
    duplicates. The names of other columns do not matter: they are left out. An empty df gives an
    empty result.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "sha", "uid"]
    with Scratch(spark) as scratch:
        rows = scratch.table(rows.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("uid", F.monotonically_increasing_id()), "rows")
        same = rows.groupBy("key", "role", "sha").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "uid")).alias("first"), F.count("*").alias("n"))
        same = scratch.table(same.where("n > 1").select(F.col("key").alias("k"), F.col("role").alias("r"), F.col("sha").alias("s"), F.col("first.uid").alias("first")), "same")
        met = rows.join(same, F.col("key").eqNullSafe(F.col("k")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")), "left")
        fault = _fault(F.col("text"), F.coalesce(F.col("uid") != F.col("first"), F.lit(False)))
        initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(".")
        letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.translate(initial, "sua.", "SUA:")).otherwise(initial)
        judged = scratch.table(met.select("key", "turn", "role", "text", "sha", "uid", fault.alias("fault")).withColumn("letter", letter), "judged")
        sorted_letters = judged.select("key", "turn", "role", "sha", "uid", "letter").repartition("key").sortWithinPartitions(*order)
        schema = judged.select("key", F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")).schema
        audits = sorted_letters.select("key", "letter").mapInArrow(_audits, schema)
        none = {"turn": "long", "role": "string", "text": "string", "sha": "binary", "uid": "long", "fault": "string"}
        heads = audits.select("key", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "audit")
        both = heads.union(judged.select("key", *none, F.lit(None).cast("string").alias("audit")))
        both = both.repartition("key").sortWithinPartitions("key", F.col("audit").isNull(), *order[1:])
        schema = judged.select("key", F.lit(0).cast("long").alias("place"), "turn", "role", "text", "fault", F.lit("").alias("edit"), F.lit("").alias("new_role"), F.lit(0).cast("long").alias("cost")).schema
        for field in schema:
            field.nullable = True
        return checkpointed(both.select("key", "turn", "role", "text", "fault", "audit").mapInArrow(_edited, schema))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a conversation's edits add up to, for each run of equal keys."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind, now = None, None

    def done() -> pa.RecordBatch:
        gaps = min(now["last"] - now["low"] + 1 - now["turns"], 2**63 - 1) if now["turns"] else 0
        cols = [pa.array([now["key"]], kind), pa.array([gaps], pa.int64()), *(pa.array([now[c]], pa.int64()) for c in names[1:]), pa.array(["".join(now["audit"])]), pa.array([now["sha"].hexdigest()])]
        return pa.RecordBatch.from_arrays(cols, ["key", *names, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("key").type
        for r in batch.to_pylist():
            if now is None or r["key"] != now["key"]:
                if now is not None:
                    yield done()
                now = dict.fromkeys(names, 0) | {"key": r["key"], "low": None, "last": None, "turns": 0, "before": None, "audit": [], "sha": hashlib.sha256(), "any": False}
            now["cost"] += r["cost"]
            now["audit"].append(r["edit"][0].upper())
            if r["fault"]:
                now[r["fault"]] += 1
            if r["edit"] != "insert":
                initial = r["role"][:1]
                now["illegal"] += now["before"] is not None and now["before"] + initial not in ("su", "ua", "au")
                now["before"] = initial
                if r["turn"] is not None and r["turn"] != now["last"]:
                    now["low"] = r["turn"] if now["low"] is None else now["low"]
                    now["last"], now["turns"] = r["turn"], now["turns"] + 1
            if r["new_role"] is not None:
                now["sha"].update((("\n" if now["any"] else "") + f"{r['new_role']}:{r['text']}").encode())
                now["any"] = True
    if now is not None:
        yield done()


def damaged(df: DataFrame) -> DataFrame:
    """conversations with the damage that their key and turn decide: rows are dropped, emptied, cut, repeated or given another role."""
    own = df.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = own.withColumn("kind", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    edits = repair(damaged(given))
    schema = edits.select("key", *(F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.lit("").alias("audit"), F.lit("").alias("repaired_sha256")).schema
    found = edits.mapInArrow(_digests, schema)
    ids = given.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("key")), "left")
    rest = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select("conv_id", *(F.coalesce(c, F.lit(rest.get(c, 0))).alias(c) for c in schema.names[1:]))


SQL = f"""
WITH RECURSIVE steps(i, n, v) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, n + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE n < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM steps WHERE n = 8),
own AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, tab),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM own WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, rtrim(text, E' \\t\\n\\x0b\\f\\r') AS rest FROM hurt),
judged AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS b,
  CASE WHEN rest = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM placed),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
  count(*) FILTER (b IS NOT NULL AND b || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM judged GROUP BY conv_id),
dp(conv_id, k, st, c, a, t) AS (
  SELECT conv_id, 0::BIGINT, unnest([0, 2, 3]), unnest([0, {INSERT}, {2 * INSERT}]), unnest(['', 'I', 'II']), unnest([[], ['user:'], ['user:', 'assistant:']]::VARCHAR[][]) FROM (SELECT DISTINCT conv_id FROM judged)
  UNION ALL
  (WITH edits AS (SELECT dp.conv_id, dp.k + 1 AS k, dp.st, dp.c, dp.a, dp.t, j.i, j.f, j.role, j.text FROM dp JOIN judged j ON j.conv_id IS NOT DISTINCT FROM dp.conv_id AND j.k = dp.k + 1),
  made AS (SELECT conv_id, k, st, c + {DELETE} AS c, a || 'D' AS a, t FROM edits
    UNION ALL SELECT conv_id, k, CASE i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, c + CASE f WHEN 3 THEN {TRUNCATED} ELSE 0 END, a || 'K', t || [role || ':' || text] FROM edits WHERE f IN (0, 3) AND (i = 's' AND st = 0 OR i = 'u' AND st <> 2 OR i = 'a' AND st = 2)
    UNION ALL SELECT conv_id, k, CASE st WHEN 2 THEN 3 ELSE 2 END, c + {RELABEL} + CASE f WHEN 3 THEN {TRUNCATED} ELSE 0 END, a || 'R', t || [CASE st WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text] FROM edits WHERE f IN (0, 3)),
  longer AS (SELECT *, unnest(range(3)) AS n FROM made),
  ended AS (SELECT conv_id, k, CASE n WHEN 0 THEN st WHEN 1 THEN CASE st WHEN 2 THEN 3 ELSE 2 END ELSE CASE st WHEN 2 THEN 2 ELSE 3 END END AS st, c + {INSERT} * n AS c, a || repeat('I', n) AS a,
    t || CASE n WHEN 0 THEN [] WHEN 1 THEN [CASE st WHEN 2 THEN 'assistant:' ELSE 'user:' END] ELSE CASE st WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END AS t FROM longer)
  SELECT conv_id, k, st, (m).c, (m).a, (m).t FROM (SELECT conv_id, k, st, min(struct_pack(c := c, a := a, t := t)) AS m FROM ended GROUP BY conv_id, k, st))),
best AS (SELECT s.conv_id, min(struct_pack(c := dp.c, a := dp.a, t := dp.t)) AS m FROM sums s JOIN dp ON dp.conv_id IS NOT DISTINCT FROM s.conv_id AND dp.k = s.n WHERE st IN (0, 3) GROUP BY s.conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce((m).c, 0) AS BIGINT) AS cost, coalesce((m).a, '') AS audit, sha256(coalesce(array_to_string((m).t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM g.conv_id
"""
