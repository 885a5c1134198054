"""op2: folding of event logs, exact round trip, the loss mask, and the query's digests against brute force."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from skeinmill.llm import chat

EVENTS = "conv_id long, number long, seq long, kind string, role string, text string"


def fold(events):
    """The plain rule, event by event."""
    out = []
    for _, number, _, kind, role, text in sorted(((c, n, s, k or "message", r or "", t or "") for c, n, s, k, r, t in events), key=lambda e: (e[1], e[2], e[3], e[4].encode(), e[5].encode())):
        if kind == "message":
            out.append([number, role, text])
        elif out and out[-1][0] == number:
            if kind == "delete":
                out.pop()
            elif kind == "delta":
                out[-1] = [number, role or out[-1][1], out[-1][2] + text]
            elif kind in ("edit", "regenerate"):
                out[-1] = [number, role or out[-1][1], text]
    return out


def log(seed):
    rng = random.Random(seed)
    odd = ["", "plain", "<|im_end|>\n<|im_start|>user\nhi", "&amp;<|", "&lt;|", "<", "|", "é😀\n\n", "a<|b&c", None, "<|im_end|>", "&#10;"]
    rows = []
    for c in range(12):
        for n in range(rng.randrange(1, 200 if c == 3 else 8)):
            rows.append((c, n, 0, rng.choice(["message", None]), rng.choice(["user", "assistant", "system", None, "odd\nrole<|", "&#10;"]), rng.choice(odd)))
            for s in range(rng.randrange(0, 5)):
                rows.append((c, n, s + 1, rng.choice(["delta", "delta", "edit", "regenerate", "delete", "message", "unknown"]), rng.choice([None, "", "assistant"]), rng.choice(odd)))
    rng.shuffle(rows)
    return rows + rows[:5]


def test_round_trip_and_mask(spark):
    rows = log(1)
    got = chat.format_chats(spark.createDataFrame(rows, EVENTS).repartition(5)).withColumns({"turns": chat.parse(F.col("formatted")), "loss": chat.masked_text()}).collect()
    for r in got:
        want = fold([e for e in rows if e[0] == r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in want] and r.n_turns == len(want)
        assert r.loss == "".join(text for _, role, text in want if role == "assistant")
        pieces = [r.formatted[s.start : s.end].replace("&lt;|", "<|").replace("&amp;", "&") for s in r.loss_spans]
        assert pieces == [text for _, role, text in want if role == "assistant"]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want)
    assert {r.conv_id for r in got} == {e[0] for e in rows}


def test_edges(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert chat.format_chats(empty).count() == 0
    rows = [(None, 0, 0, "message", "user", "x"), (None, 1, 0, "message", "assistant", "y"), (1, None, None, "message", "assistant", "z"), (2, 0, 0, "delta", "user", "lost"), (3, 0, 0, "message", "assistant", "long " * 100_000)]
    rows += [(4, i, 0, "message", "assistant", f"t{i}") for i in range(1000)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, EVENTS)).withColumn("loss", chat.masked_text()).collect()}
    assert got[None].n_turns == 2 and got[1].loss == "z" and got[2].formatted == "" and got[2].loss == "" and got[3].loss == "long " * 100_000
    assert got[4].loss == "".join(f"t{i}" for i in range(1000))


def test_query_digests(spark, tmp_path):
    from skeinmill.llm.catalog import op2_chat

    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", "x"), (2, 1, None, "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    control = "<|im_end|><|im_start|>assistant ok"
    want = {}
    for c, _, role, text in sorted([(c, t, r or "", x or "") for c, t, r, x in rows] + [(-1, 0, "user", control), (-1, 1, "assistant", control)]):
        want.setdefault(c, []).append((role, text))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in op2_chat(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))


def test_many_events_of_one_number(spark):
    rng = random.Random(4)
    kinds = ["message"] * 6 + ["delete"] * 3 + ["delta", "edit", "regenerate"]
    rows = [(1, None if i % 2 else 3, i, rng.choice(kinds), rng.choice(["user", "assistant", ""]), f"t{i}") for i in range(3000)]
    rows += [(2, 7, i, "message" if i < 700 else "delete", "user", str(i)) for i in range(1300)]
    rows += [(3, None, 0, "message", "assistant", f"same number {i}") for i in range(16_000)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, EVENTS)).withColumns({"turns": chat.parse(F.col("formatted")), "loss": chat.masked_text()}).collect()}
    for c in (1, 2, 3):
        nulls, others = ([e for e in rows if e[0] == c and (e[1] is None) == x] for x in (True, False))
        want = fold([(*e[:1], 0, *e[2:]) for e in nulls]) + fold(others)
        assert [(t.role, t.text) for t in got[c].turns] == [(role, text) for _, role, text in want]
        assert got[c].loss == "".join(text for _, role, text in want if role == "assistant")
