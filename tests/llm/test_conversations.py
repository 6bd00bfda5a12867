import hashlib
import itertools
import random
import re

import pytest

from gridloom.llm import conversations as c


def plain(rows):
    """(cost, audit, repaired) of (initial, role, text, fault) rows, trying all edits with at most two insertions at a place."""
    best = None
    put = [[], *([x] for x in ("u", "a")), *(list(x) for x in ("ua", "au"))]
    options = []
    for initial, role, text, fault in rows:
        own = [("D", 2, [])]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            own += [("K", more, [(initial, f"{role}:{text}")])] + [("R", 1 + more, [(n[0], f"{n}:{text}")]) for n in ("user", "assistant")]
        options.append(own)
    for picked in itertools.product(*options):
        for gaps in itertools.product(put, repeat=len(rows) + 1):
            initials, cost, audit, texts = "", 0, "", []
            for k, gap in enumerate(gaps):
                cost += 5 * len(gap)
                audit += "I" * len(gap)
                initials += "".join(gap)
                texts += [f"{c.NAMES[g]}:" for g in gap]
                if k < len(picked):
                    audit += picked[k][0]
                    cost += picked[k][1]
                    initials += "".join(i for i, _ in picked[k][2])
                    texts += [t for _, t in picked[k][2]]
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(texts)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        rest = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def letter(role, fault):
    i = role[:1] if role[:1] in ("s", "u", "a") else "."
    return "x" if fault in ("blank", "duplicate") else {"s": "S", "u": "U", "a": "A", ".": ":"}[i] if fault else i


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_costs_and_audits_equal_an_enumeration(n):
    for roles in itertools.product("suaSUA.:x", repeat=n):
        rows = [(r.lower() if r.lower() in "sua" else ".", r, "t", "blank" if r == "x" else "truncated" if r in "SUA:" else None) for r in roles]
        if n < 3 or random.Random("".join(roles)).random() < 0.05:
            assert c.repaired("".join(roles)) == plain(rows)[:2], roles


def test_audits_equal_a_dp_that_carries_strings():
    """The order that ranks keep is that of the audits themselves, for long conversations too."""
    rng = random.Random(5)
    for _ in range(150):
        letters = "".join(rng.choice(rng.choice(["ua", "u", "suaSUA.:x", "uUa"])) for _ in range(rng.randint(0, 60)))
        now = {0: (0, ""), 2: (5, "I"), 3: (10, "II")}
        for x in letters:
            new = {}
            for s, t, cost, edit in c.MOVES[x]:
                if s in now:
                    for k in range(4):
                        own = (now[s][0] + cost + 5 * k, now[s][1] + edit + "I" * k)
                        new[t] = min(new.get(t, own), own)
                        t = c.LEADS[c.NEXT[t]][t]
            now = new
        assert c.repaired(letters) == min(now[s] for s in c.ENDS if s in now), letters


def test_rows_and_digests_equal_an_enumeration(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(40):
        own = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No!", "cut off", " \t", "What? "])) for _ in range(rng.randint(1, 3))]
        rows += [(k, t, r, x) for t, (r, x) in enumerate(own)]
        want[k] = plain([(r[:1] or "-", r, x, f) for (r, x), f in zip(own, faults(own), strict=True)])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {}
    for r in c.repair(df).collect():
        got.setdefault(r.key, []).append(r)
    assert set(got) == set(want)
    for k, edits in got.items():
        edits.sort(key=lambda r: r.place)
        cost, audit, texts = want[k]
        assert "".join(r.edit[0].upper() for r in edits) == audit and sum(r.cost for r in edits) == cost
        assert "\n".join(f"{r.new_role}:{r.text}" for r in edits if r.new_role is not None) == texts


def test_odd_rows(spark):
    rows = [
        (None, None, "user", "No key."), (None, 2, "assistant", "Nor here."), (1, None, None, None), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 1, "assistant", "Yes."),
        (2, 1, "user", "long. " * 200_000), (2, 2, "assistant", "é!"), (3, 1, "User", "Upper."), (4, -(2**63), "user", "a."), (4, 2**63 - 1, "assistant", "b."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS edit", "1 AS key", "2 AS place", "'y' AS audit")
    edits = c.repair(df)
    found = {}
    for r in edits.collect():
        found.setdefault(r.key, []).append((r.place, r.edit, r.fault, r.new_role))
    assert [x[1:] for x in sorted(found[None])] == [("keep", None, "user"), ("keep", None, "assistant")]
    assert sorted(x[2] or "" for x in found[1]) == ["", "", "blank", "duplicate"]
    assert [x[1] for x in sorted(found[3])] == ["delete"] and [x[1] for x in sorted(found[2])] == ["keep", "keep"]
    digests = {r.key: r for r in edits.mapInArrow(c._digests, "key long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").collect()}
    assert digests[4].gaps == 2**63 - 1 and digests[None].gaps == 0 and digests[1].blank == 1
    assert digests[3].repaired_sha256 == hashlib.sha256().hexdigest() and digests[3].cost == 2
    assert c.repair(df.where("false")).collect() == []


def test_one_hot_conversation(spark):
    """A conversation that spans batches, with copies, and all of it one role, so that paths never merge."""
    n = 6000
    rows = [(1, t, "user", f"Row {t % 5000}.") for t in range(n)] + [(k, t, "ua"[t] and ("user", "assistant")[t], "Fine.") for k in range(2, 40) for t in range(2)]
    edits = c.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    own = sorted((r.place, r.edit, r.cost) for r in edits.where("key = 1").collect())
    cost, audit = c.repaired("u" * 5000 + "x" * 1000)
    assert "".join(e[0].upper() for _, e, _ in own) == audit and sum(x for _, _, x in own) == cost == 2500 + 2000
    assert edits.where("key <> 1 AND edit <> 'keep'").isEmpty()


def test_query_reads_nulls_and_dropped_conversations(spark, tmp_path, duck):
    rows = [(k, t, ("user", "assistant", "system", None)[(k + t) % 4], None if (k * t) % 7 == 3 else f"Text {k % 3} {t % 2}{'.!? '[(k + t) % 4]}") for k in range(60) for t in range(k % 6)]
    rows += [(None, t, "user", "Say it.") for t in range(3)] + [(k, None, "assistant", "Null turn.") for k in range(0, 60, 9)] + [(k, 1, "user", "Alone.") for k in range(100, 160)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in c.query(spark, str(tmp_path)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == set(con.execute(c.SQL).fetchall()) and any(r[7] == "" for r in got) and any(r[1] for r in got)
