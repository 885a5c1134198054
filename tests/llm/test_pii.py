"""op4: base spans against a brute-force reading of the contract, added spans on a made corpus, redaction."""

from __future__ import annotations

import hashlib
import random
import re

from skeinmill.llm.pii import bootstrap, find_pii, redact

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def texts():
    rng = random.Random(4)
    parts = [
        "a@b.c", "x.y+z@mail.example.com", "a@b", "@", "a@b.cc_x@y.zz", "q@-a.b.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "10.0.0.1.", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111",
        "+1 (017) 555-7713", "+44 20", "+1234567890123456", "++1 555 000 1111", "é", "😀", " ", "\n", "word", ",", "token 12", "999999999999999999999.1.1.1", "1234567812345670 12", "-", ".", "%", "00",
    ]
    out = [None, "", "9" * 5000, "a" * 5000 + "@", "1." * 3000, "+" * 3000 + "1", "a@b.c " * 700 + "1.2.3.4"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(300)]


def test_base_spans_equal_brute_force(spark):
    rows = [(None if i == 8 else i % 300, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string").repartition(3)
    want = sorted((str(i), *(sum(s[0] == k for s in b) for k in ("email", "ip", "card", "phone")), hashlib.sha256(joined(b).encode()).hexdigest()) for i, t, _ in rows for b in [brute(t)])
    got = find_pii(docs).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        base = [x for x in r.spans.split(",") if x]
        assert len(base) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def corpus():
    rows = [(i, f"please reach office at user{i}@mail{i}.example.com today") for i in range(30)]
    rows += [(100 + i, f"lines before phone: +1 (0{i:02d}) 555-77{i:02d} after") for i in range(30)]
    rows += [(200, "please reach office at user77(at)example and more"), (201, "lines before phone: 555-1234x567 after"), (202, "clean words with 12345 in them"), (203, None)]
    return rows


def test_contexts_find_unseen_identifiers(spark):
    rows = {r.doc_id: r for r in find_pii(spark.createDataFrame(corpus(), "doc_id long, text string")).collect()}
    assert rows[200].spans == "email:23:40" and rows[200].n_email == 0 and rows[200].n_added == 1
    assert rows[201].spans == "phone:20:32"
    assert rows[202].spans == "" and rows[203].spans == ""
    assert all(rows[i].n_added == 0 for i in range(30))


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(i, t, "s", len(t or ""), "keep") for i, t in corpus()] + [(300, "ip 1.2.3.4 and a@b.co!", "s", 22, "keep"), (301, "😀 +1 (017) 555-7713 end", "s", 23, "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, spans string")
    out = {r.doc_id: r for r in redact(docs).collect()}
    assert redact(docs).columns == docs.columns and len(out) == len(rows)
    assert out[300].text == "ip [IP] and [EMAIL]!" and out[300].n_chars == 20
    assert out[301].text == "😀 [PHONE] end" and out[301].spans == "keep"
    assert out[200].text == "please reach office at [EMAIL] and more"
    assert out[202].text == "clean words with 12345 in them" and out[203].text is None
    assert redact(docs.limit(0)).count() == 0


def test_contexts_chain_over_many_rounds(spark):
    rows = [(f"t0{j}", "email", "p1") for j in (1, 2) for _ in range(20)]
    for i in range(1, 8):
        rows += [(f"t{i}{j}", None, f"p{i}") for j in (1, 2)] + [(f"t{i}{j}", None, f"p{i + 1}") for j in (1, 2) for _ in range(20)]
    got = bootstrap(spark.createDataFrame(rows, "token string, kind string, pattern string"), support=2, confidence=0.5).collect()
    assert {(r.pattern, r.kind) for r in got} == {(f"p{i}", "email") for i in range(1, 9)}


def brute_bootstrap(rows, support, confidence):
    """The plain rule over (token, kind or None, pattern) rows."""
    total, count = {}, {}
    for token, kind, pattern in rows:
        total[pattern] = total.get(pattern, 0) + 1
        count[pattern, token] = count.get((pattern, token), 0) + 1
    known = {(token, kind): 1.0 for token, kind, _ in rows if kind}
    while True:
        best = {}
        for pattern in total:
            for kind in {k for _, k in known}:
                own = [(t, n) for (p, t), n in count.items() if p == pattern and (t, kind) in known]
                share = sum(n * known[t, kind] for t, n in own) / total[pattern]
                if len(own) >= support and share >= confidence:
                    best[pattern, kind] = share
        doubt = {}
        for token, kind, pattern in {r for r in rows if r[1] is None}:
            for (p, k), share in best.items():
                if p == pattern:
                    doubt[token, k] = doubt.get((token, k), 1.0) * (1 - share)
        fresh = {tk: 1 - x for tk, x in doubt.items() if 1 - x >= confidence and tk[0] not in {t for t, _ in known}}
        if not fresh:
            top = {}
            for (p, k), share in best.items():
                top[p] = max(top.get(p, (0.0, "")), (share, k))
            return {p: k for p, (_, k) in top.items()}
        known |= fresh


def test_bootstrap_equals_brute_force(spark):
    found = 0
    for seed in range(6):
        rng = random.Random(seed)
        kinds = {f"t{i}": rng.choice([None, None, None, "email", "phone"]) for i in range(24)}
        liked = {f"p{i}": rng.choice(["email", "phone", None]) for i in range(7)}
        rows = []
        for p, k in liked.items():
            pool = [t for t, kind in kinds.items() if kind == k or rng.random() < 0.12]
            rows += [(t, kinds[t], p) for t in rng.choices(pool, k=rng.randrange(4, 30))]
        got = {r.pattern: r.kind for r in bootstrap(spark.createDataFrame(rows, "token string, kind string, pattern string"), 2, 0.6).collect()}
        assert got == brute_bootstrap(rows, 2, 0.6)
        found += len(got)
    assert found > 10


def test_precision_and_recall_of_added_spans(spark):
    """Identifiers that the base patterns don't know, in contexts that base entities teach, among decoys in other contexts."""
    rng, rows, want = random.Random(3), [], {}
    prose = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    contexts = {"email": ("write to", lambda: f"u{rng.randrange(10**6)}@mail{rng.randrange(9)}.example.com", lambda: f"u{rng.randrange(10**6)}(at)example"), "phone": ("telephone no", lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: f"555-{rng.randrange(1000, 9999)}x{rng.randrange(10, 99)}")}
    for i in range(400):
        words = [rng.choice(prose) for _ in range(rng.randrange(5, 40))] + [str(rng.randrange(10**5))] + [rng.choice(prose)]
        kind = rng.choice(["email", "phone"])
        before, seen, unseen = contexts[kind]
        new = i % 8 == 0
        value = (unseen if new else seen)()
        head = " ".join(words) + f" {before} "
        rows.append((i, head + value + " " + rng.choice(prose)))
        if new:
            want[i] = f"{kind}:{len(head)}:{len(head) + len(value)}"
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {d: r.spans for d, r in got.items() if r.n_added}
    right = sum(added.get(d) == s for d, s in want.items())
    assert right >= 0.9 * len(want) and right >= 0.9 * len(added)


def test_a_long_text_of_identifiers(spark):
    rng = random.Random(9)
    parts = [f"user{i}@m{rng.randrange(9)}.example.com" if i % 3 else f"code x{i}yz" for i in range(45_000)]
    text = " at ".join(parts)
    assert len(text) > 10**6
    docs = spark.createDataFrame([(1, text), (2, "short +1 (017) 555-7713")], "doc_id long, text string")
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    assert got[1].n_email == sum(i % 3 > 0 for i in range(45_000)) and got[2].n_phone == 1
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[2] == "short [PHONE]" and clean[1].count("[EMAIL]") >= got[1].n_email and "@" not in clean[1]
