"""Audits and costs equal those of trying every edit, and of a plain table of costs on long conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from skeinmill.llm import repair

_SHAPE = re.compile(r"(s?(ua)+)?")
_EMPTY = hashlib.sha256(b"").hexdigest()
_BLANKS = " \t\n\x0b\f\r"


def _ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return sorted(((t, " " if role is None else role, " " if text is None else text) for t, role, text in rows), key=key)


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(_BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _counts(rows, faults):
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))


def _digest(out):
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in out).encode()).hexdigest()


def exhaustive(rows):
    """Every edit of each row with every insertion of up to two rows around it; the cheapest whose roles have the shape."""
    rows = _ordered(rows)
    faults = _faults(rows)
    best = None
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product(*([("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", None), ("R", "user"), ("R", "assistant")] for f in faults)):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                cost, audit = cost + 2 * len(inserted[k]), audit + "I" * len(inserted[k])
                out += [(role, "") for role in inserted[k]]
                if k < len(rows):
                    (edit, role), audit = edits[k], audit + edits[k][0]
                    cost += {"D": 3, "K": 0, "R": 2}[edit] + (edit != "D" and faults[k] == "truncated")
                    out += [(role or rows[k][1], rows[k][2])] if edit != "D" else []
            if _SHAPE.fullmatch("".join(role[:1] for role, _ in out)) and all(role for role, _ in out) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, _digest(out))
    return (*_counts(rows, faults), best[0], best[1], best[2])


def by_table(rows):
    """The least (cost, audit, rows) from each place and state on, without a bound on a conversation's length."""
    rows = _ordered(rows)
    faults = _faults(rows)
    after = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def closed(best):
        for _ in range(3):
            for state, (then, role) in after.items():
                cost, audit, out = best[then]
                best[state] = min(best[state], (cost + 2, "I" + audit, ((role, ""), out)), key=lambda x: x[:2])
        return best

    worst = (10**9, "", ())
    best = closed({0: (0, "", ()), 1: worst, 2: worst, 3: (0, "", ())})
    for (_, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        now = {}
        for state in range(4):
            options = [(best[state][0] + 3, "D" + best[state][1], best[state][2])]
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if (state, role[:1]) in kept:
                    cost, audit, out = best[kept[state, role[:1]]]
                    options.append((cost + more, "K" + audit, ((role, text), out)))
                then, new = after[state]
                cost, audit, out = best[then]
                options.append((cost + 2 + more, "R" + audit, ((new, text), out)))
            now[state] = min(options, key=lambda x: x[:2])
        best = closed(now)
    cost, audit, chain = best[0]
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return (*_counts(rows, faults), cost, audit, _digest(out))


_COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_SCHEMA = "conv_id long, turn long, role string, text string"


def _got(spark, table, **more):
    rows = [(conv, *row) for conv, own in table.items() for row in own]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, _SCHEMA).withColumn("place", repair.F.lit("x")).withColumn("cost", repair.F.lit(1)).repartition(3)
    return {r["conv_id"]: tuple(r[c] for c in _COLUMNS) for r in repair.report(frame, **more).collect()}


def _conversation(draw, n, roles=("system", "user", "assistant", "user", "assistant", None, "tool", "", "ux")):
    texts = ["Yes.", "No!  \n", "so", "", " \t", None, "Why?", "end.x", "Ü。"]
    return [(draw.choice([None, 0, 1, 2, 3, 4, 9]), draw.choice(roles), draw.choice(texts)) for _ in range(n)]


def test_small_conversations_equal_trying_every_edit(spark):
    draw = random.Random(11)
    table = {k: _conversation(draw, draw.randint(1, 3)) for k in range(60)} | {None: _conversation(draw, 2)}
    assert _got(spark, table) == {k: exhaustive(rows) for k, rows in table.items()}


@pytest.mark.parametrize("segment", [1, repair.SEGMENT])
def test_long_conversations_and_segments(spark, segment):
    """One conversation holds most rows; segments of two rows cross the ranges' borders, and give what whole ones give."""
    draw = random.Random(segment)
    table = {k: _conversation(draw, draw.randint(1, 12)) for k in range(40)}
    table[7] = [(t, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["Yes.", "so", "", f"text {t // 2}.", f"text {t}"])) for t in range(700)]
    table[8] = [(3, "user", "same.")] * 300 + [(4, "user", "same.")] * 5
    assert _got(spark, table, segment=segment) == {k: by_table(rows) for k, rows in table.items()}


def test_both_restatements_agree():
    draw = random.Random(2)
    for _ in range(40):
        rows = _conversation(draw, draw.randint(0, 3))
        assert by_table(rows) == exhaustive(rows)


def test_repaired_rows_have_the_shape_and_digest(spark):
    draw = random.Random(4)
    table = {k: _conversation(draw, draw.randint(1, 8)) for k in range(30)}
    rows = spark.createDataFrame([(c, *r) for c, own in table.items() for r in own], _SCHEMA)
    full = repair.with_texts(repair.edits(rows), rows)
    out = {}
    for r in repair.repaired(full).orderBy("conv_id", "place", "at").collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv, own in table.items():
        assert _SHAPE.fullmatch("".join(role[:1] for role, _ in out.get(conv, [])))
        assert _digest(out.get(conv, [])) == by_table(own)[-1]


def test_conversations_without_rows_and_damage(spark):
    every = spark.createDataFrame([(c, t, "assistant", "A. B!") for c in [*range(30), None] for t in [*range(4), None]] + [(99, 0, None, None)], _SCHEMA)
    import zlib

    want = []
    for c, t in [(c, t) for c in [*range(30), None] for t in [*range(4), None]]:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if fault == 4 else "assistant", {1: "", 2: "A B"}.get(fault, "A. B!"))
        want += [row] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(tuple, repair.damaged(every.where("conv_id is null or conv_id < 99")).collect()), key=repr) == sorted(want, key=repr)
    got = {r["conv_id"]: r for r in repair.report(every.where("conv_id = 1"), every).collect()}
    assert len(got) == 32 and got[2]["audit"] == "" and got[2]["repaired_sha256"] == _EMPTY and got[2]["cost"] == 0 and got[1]["audit"]
    assert repair.report(every.limit(0)).count() == 0
    only = repair.report(every.where("conv_id = 1").limit(0), every).collect()
    assert len(only) == 32 and {tuple(r[c] for c in _COLUMNS) for r in only} == {(0,) * 6 + ("", _EMPTY)}
