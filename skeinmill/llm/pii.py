"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Base entities come from four patterns with checks. They are the seeds: tokens that look like
identifiers, because they hold a digit or an @, are known where they are such entities, and the one or
two words before each token are lexical patterns. Tokens and patterns form a graph, which is scored in
rounds: a pattern's confidence is the share of its tokens that are known for one kind; tokens that
confident patterns precede become known in turn, and may support further patterns. At the end, tokens that
are not base entities but follow a confident pattern are spans of its kind too.

Patterns are written so that they take linear time: a match is tried only where a run of its first
class begins, or where the match before ended, and what cannot be given back is possessive.

Whether a token touches a base span is found where both are, by binary search among the text's spans, so
that rows of tokens carry no lists. Long lists are folded by blocks, so that work grows with the text.

Defined results: a null or empty text has no spans; added spans that touch a base span are left out;
rows with equal texts get equal spans, and a null doc_id is no exception. Counts of tokens and
support cover all rows; rounds go on until one finds no token more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinmill.llm.spans import find_spans, let
from skeinmill.llm.store import keep, named

KINDS = ["email", "ip", "card", "phone"]
#: Distinct known tokens that a pattern needs, and the share of its tokens that they make.
SUPPORT, CONFIDENCE = 10, 0.8
#: Added spans that are sent to every task at most, which is counted; more are joined by a shuffle.
SENT_SPANS = 50_000

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
_BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: What looks like an identifier: a phone number, or a token from its first character on.
_TOKEN = _PHONE + r"|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike(_BYTE))
    if kind == "card":
        digits = F.regexp_replace(x, "[^0-9]", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(x, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _gate(kind: str) -> Column:
    text = F.col("text")
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}[kind]


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["found"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _ranked(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _by_start(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))


def _touches(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of these spans, which ascend and don't overlap, shares a character with start..end."""
    mid = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    bounds = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def step(a: Column, _: Column) -> Column:
        before = F.get(spans, mid(a))["start"] < end
        return F.when(a["lo"] >= a["hi"], a).when(before, bounds(mid(a) + 1, a["hi"])).otherwise(bounds(a["lo"], mid(a)))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    begun = F.aggregate(steps, bounds(F.lit(0), F.size(spans)), step, lambda a: a["lo"])
    return F.when(F.size(spans) > 0, F.coalesce(F.get(spans, begun - 1)["end"] > start, F.lit(False))).otherwise(F.lit(False))


def base_spans(frame: DataFrame) -> DataFrame:
    """Adds a column for each kind: the checked matches of its pattern, as (start, end, found)."""
    for kind in KINDS:
        frame = find_spans(frame, f"{kind}_spans", _PATTERNS[kind], _gate(kind), near=0)
        frame = frame.withColumn(f"{kind}_spans", F.filter(f"{kind}_spans", _checked(kind)))
    return frame


def _token_kind(token: Column) -> Column:
    """The kind of a token that is, or begins, a base entity."""
    out = F.when(token.rlike(_EMAIL), "email").when(token.rlike("^" + _PHONE + "$") & _valid("phone", token), "phone")
    bare = F.regexp_extract(token, _IP, 0)
    out = out.when((bare != "") & _valid("ip", bare), "ip")
    return out.when(token.rlike("^[^0-9]?[0-9-]+[^0-9]*$") & _valid("card", token), "card")


def _occurrences(frame: DataFrame) -> DataFrame:
    """Adds (start, end, token, kind, patterns, apart) of identifier-like tokens that follow a word; apart: touches no base span."""
    frame = find_spans(frame, "tokens", _TOKEN, F.col("text").rlike("[0-9@]"))

    def occurrence(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["found"], r"^[(\[{<\"']*", 0))
        bare = F.regexp_replace(F.regexp_replace(s["found"], r"^[(\[{<\"']+", ""), r"[^A-Za-z0-9\x80-\x{10FFFF}]++$", "")
        words = F.filter(F.split(F.lower(s["before"]), r"[\x20\x09-\x0D]+"), lambda w: w.rlike("[^0-9]") & (w != ""))
        last, two = F.element_at(words, -1), F.concat_ws(" ", F.slice(words, -2, 2))
        patterns = F.when(F.size(words) > 1, F.array(last, two)).when(F.size(words) == 1, F.array(last)).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(bare)).alias("end"), F.lower(bare).alias("token"), _token_kind(bare).alias("kind"), patterns.alias("patterns"))

    frame = frame.withColumn("tokens", F.transform("tokens", occurrence))
    frame = frame.withColumn("tokens", F.filter("tokens", lambda t: (F.size(t["patterns"]) > 0) & (t["token"] != "")))
    places = F.struct(*(F.transform(f"{k}_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS))

    def placed(t: Column, spans: Column) -> Column:
        touched = _touches(spans[KINDS[0]], t["start"], t["end"])
        for kind in KINDS[1:]:
            touched = touched | _touches(spans[kind], t["start"], t["end"])
        return t.withField("apart", t["kind"].isNull() & ~touched)

    return frame.withColumn("tokens", let(places, lambda spans: F.transform("tokens", lambda t: placed(t, spans))))


def bootstrap(tokens: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind): confident patterns, from a table of (token, kind or null, pattern).

    Rounds end with the first that finds no token, which has scored the patterns with all that are known.
    """
    edges = keep(tokens.groupBy("pattern", "token", "kind").agg(F.count("*").alias("n")), "pii-edges")
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    known = edges.where("kind is not null").groupBy("token", "kind").agg(F.lit(1.0).alias("trust"))
    while True:
        scored = (
            edges.drop("kind").join(known, "token").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("trust")).alias("hits"), F.count_distinct("token").alias("tokens"))
            .where(F.col("tokens") >= support).join(totals, "pattern").withColumn("confidence", F.col("hits") / F.col("total")).where(F.col("confidence") >= confidence)
        )
        best = keep(scored.select("pattern", "kind", "confidence"), "pii-patterns")
        fresh = edges.where("kind is null").drop("kind").join(best, "pattern").groupBy("token", "kind").agg((1 - F.product(1 - F.col("confidence"))).alias("trust"))
        fresh = keep(fresh.where(F.col("trust") >= confidence).join(known.select("token"), "token", "left_anti"), "pii-known")
        if fresh.isEmpty():
            break
        known = known.union(fresh)
    return best.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("top")).select("pattern", "top.kind")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _with_spans(docs: DataFrame, support: int, confidence: float, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(a row of base spans for each row of docs, with that row if it is asked for; a row of added spans for each text that has some)"""
    rows = [F.struct(*named(docs.columns)).alias("row")] if whole else []
    own = docs.select(*rows, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("cls", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    found = _occurrences(base_spans(own))
    by_kind = [F.transform(f"{k}_spans", _ranked(k)) for k in KINDS]
    found = keep(found.select(*(["row"] if whole else []), "doc_id", "cls", F.concat(*by_kind).alias("base"), "tokens"), "pii-found")
    tokens = found.select("cls", F.explode("tokens").alias("t")).select("cls", "t.start", "t.end", "t.token", "t.kind", "t.apart", F.explode("t.patterns").alias("pattern"))
    patterns = bootstrap(tokens.select("token", "kind", "pattern"), support, confidence)
    added = tokens.where("apart").select("cls", "start", "end", "pattern").join(patterns.withColumnRenamed("kind", "as_kind"), "pattern")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("as_kind")).cast("int") - 1
    added = added.groupBy("cls", "start", "end").agg(F.min(F.struct(rank.alias("rank"), F.col("as_kind").alias("kind"))).alias("k"))
    added = keep(added.groupBy("cls").agg(F.collect_list(F.struct("k.rank", "k.kind", "start", "end")).alias("added")), "pii-added")
    few = (added.agg(F.sum(F.size("added"))).first()[0] or 0) <= SENT_SPANS
    return found.drop("tokens"), F.broadcast(added) if few else added


def find_pii(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of docs."""
    found, added = _with_spans(docs, support, confidence, False)
    rows = found.join(added, "cls", "left").withColumn("added", F.coalesce("added", F.expr("filter(base, b -> false)")))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


#: Spans that are replaced at once, within a piece of the text that holds them.
_FOLD = 256


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, replaced by the kind of the first; spans ascend."""

    def block(acc: Column, i: Column) -> Column:
        own = F.slice(spans, i * _FOLD + 1, _FOLD)

        def folded(own: Column) -> Column:
            last = F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["end"])))

            def within(piece: Column) -> Column:
                def one(a: Column, s: Column) -> Column:
                    new = F.concat(a["out"], F.substr(piece, a["at"] - acc["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                    return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

                return F.aggregate(own, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), one, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

            return let(F.substr(text, acc["at"] + 1, last - acc["at"]), within)

        return let(own, folded)

    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _FOLD).cast("int"))
    return F.aggregate(blocks, first, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))


def redact(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """The documents, all columns, with each span, or run of overlapping ones, replaced by its kind; n_chars follows."""
    found, added = _with_spans(docs, support, confidence, True)
    spans = F.concat("base", F.coalesce("added", F.expr("filter(base, b -> false)")))
    plain = found.select("row", "cls", "base").join(added, "cls", "left").select("row", F.sort_array(F.transform(spans, _by_start)).alias("spans"))
    text = F.col("row.text").cast("string")
    plain = plain.withColumn("clean", F.when(F.size("spans") > 0, let(text, lambda t: let(F.col("spans"), lambda s: _replaced(t, s)))).otherwise(text))
    out = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return plain.select(*(out[c].alias(c) for c in docs.columns))
