"""What models are asked: requests for queries and for judgments, and the judging of answers by them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinmill.functions.text import CANONICAL_REFUSAL, chunk_block, claim_block
from skeinmill.operators import judging

#: Queries for a chunk are the same at every run; those for a topic differ between its repetitions.
CHUNK_TEMPERATURE, TOPIC_TEMPERATURE = 0.0, 0.7
#: What each kind of question asks for.
KINDS = {
    "procedural": "Ask how something is done, beginning with How.",
    "comparison": "Ask in what way two things of the passage differ.",
    "best_practice": "Ask what is recommended, or what the best way is.",
    "pointer": "Ask where to find or to begin with something.",
}
QUERY_REQUEST = "Write one question that a developer could ask and that the passage below answers. {kind}\nDo not mention the passage.\nReply with JSON only: {{\"query\": \"...\"}}\n\nSource: {doc_id}\nPassage:\n{text}"
TOPIC_REQUEST = "Write one question about the topic below. It will be put to documentation that doesn't cover the topic.\nReply with JSON only: {{\"query\": \"...\"}}\n\nTopic: {topic}"

#: For each judgment what the judge is told, and what it is given.
JUDGMENTS = {
    "claims": ("Split the answer into claims that can be checked one by one. Leave out citations, advice to the reader and code. Reply with JSON only: {\"claims\": [\"...\"]}", "Question: {question}\n\nAnswer:\n{answer}"),
    "attribution": (
        "For each numbered claim name the one numbered chunk that supports it, or null if none does. "
        "Reply with JSON only: {\"attributions\": [{\"claim_idx\": 1, \"supporting_chunk_idx\": 1, \"rationale\": \"...\"}]}", "Chunks:\n{chunks}\n\nClaims:\n{claims}",
    ),
    "relevance": ("Score how far the answer answers the question: 0, 0.25, 0.5, 0.75 or 1. Reply with JSON only: {\"score\": 0.5, \"rationale\": \"...\"}", "Question: {question}\n\nAnswer:\n{answer}"),
    "refusal": ("Decide whether the answer says that the context lacks what was asked. Reply with JSON only: {\"refused\": false, \"rationale\": \"...\"}", "Question: {question}\n\nAnswer:\n{answer}"),
}
#: What a judge is told whose reply could not be read.
REMINDER = "That was not the JSON object that was asked for. Reply with the JSON object alone."


def filled(template: str, **values: Column) -> Column:
    """A template with columns in its places; null if one of them is."""
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("{{", "\x00").replace("}}", "\x01").replace("{", "\x02{").replace("}", "\x02").split("\x02")):
        if piece.startswith("{"):
            parts.append(values[piece[1:]])
        elif piece or not i:
            parts.append(F.lit(piece.replace("\x00", "{").replace("\x01", "}")))
    return F.concat(*parts)


def chunk_requests(tasks: DataFrame) -> DataFrame:
    """Adds prompt and temperature to tasks (question_type, doc_id, text); kinds that no chunk can be asked for have no prompt."""
    kind = F.lit(None).cast("string")
    for name, wish in KINDS.items():
        kind = F.when(F.col("question_type") == name, F.lit(wish)).otherwise(kind)
    prompt = filled(QUERY_REQUEST, kind=kind, doc_id=F.col("doc_id").cast("string"), text=F.col("text"))
    return tasks.withColumns({"prompt": prompt, "temperature": F.lit(CHUNK_TEMPERATURE)})


def topic_requests(tasks: DataFrame) -> DataFrame:
    """Adds prompt, temperature and question_type to tasks (topic)."""
    return tasks.withColumns({"prompt": filled(TOPIC_REQUEST, topic=F.col("topic")), "temperature": F.lit(TOPIC_TEMPERATURE), "question_type": F.lit("refusal")})


def request(judgment: str, **values: Column) -> Column:
    """System and user message of a judgment; the user's is null if a value is."""
    told, given = JUDGMENTS[judgment]
    turns = (("system", F.lit(told)), ("user", filled(given, **values)))
    return F.array(*(F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns))


def _asked(rows: DataFrame, judge: Callable[[str], str], messages: Column, readable: Callable[[Column], Column], out: str) -> DataFrame:
    """Adds a judge's reply to messages, sent as JSON; an unreadable one goes back to it once, with a reminder."""
    again = lambda reply: F.array(*(F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("assistant", reply), ("user", F.lit(REMINDER)))))
    rows = rows.withColumn("_prompt", F.to_json(messages))
    valid = F.coalesce(readable(F.col(out)), F.lit(False))
    rows = judging.ask(rows, judge, valid, "_prompt", out, attempts=1)
    rows = rows.withColumn("_messages", messages).withColumn("_prompt", F.when(~valid, F.to_json(F.concat("_messages", again(F.coalesce(F.col(out), F.lit("")))))))
    rows = judging.ask(rows, judge, valid, "_prompt", "_second", attempts=1)
    return rows.withColumn(out, F.when(valid, F.col(out)).otherwise(F.col("_second"))).drop("_prompt", "_messages", "_second")


def judged(rows: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """Adds faithfulness, relevance and refusal to answers (question, answer, chunks).

    faithfulness is (score, rationale, attributions): the share of the answer's claims that a chunk supports. The
    judge isn't asked for attributions without claims; the score is 0 then, and the rationale says so. A null question,
    answer or list of chunks counts as empty. The judge gets the messages as JSON and replies with text.
    """
    texts = {n: F.coalesce(F.col(n), F.lit("")) for n in ("question", "answer")}
    no_claims = F.expr("cast(array() as array<string>)")
    found = lambda field, kind: lambda reply: judging.json_field(judging.parsed(reply), field, kind).isNotNull()
    rows = _asked(rows, judge, request("claims", **texts), found("claims", "array<string>"), "_claims_reply").withColumn("_claims", F.coalesce(judging.claims("_claims_reply"), no_claims))
    some = F.size("_claims") > 0
    asked = F.when(some, request("attribution", chunks=F.coalesce(chunk_block("chunks", with_source=False), F.lit("")), claims=claim_block("_claims")))
    rows = _asked(rows, judge, asked, lambda reply: ~some | found("attributions", judging.ATTRIBUTIONS)(reply), "_given_reply")
    n_chunks = F.coalesce(F.when(F.col("chunks").isNotNull(), F.size("chunks")), F.lit(0))
    rows = rows.withColumn("_given", judging.attributions("_given_reply")).withColumn("_attributed", judging.attribute("_given", "_claims", n_chunks))
    supported = F.size(F.filter("_attributed", lambda a: a["supporting_chunk_idx"].isNotNull()))
    why = F.when(some, F.concat(supported.cast("string"), F.lit(" of "), F.size("_claims").cast("string"), F.lit(" claims supported"))).otherwise("NO_CLAIMS_EXTRACTED: nothing to check in the answer, or an unreadable reply")
    rows = rows.withColumn("faithfulness", F.struct(judging.supported_share("_attributed").alias("score"), why.alias("rationale"), F.col("_attributed").alias("attributions")))
    rows = _asked(rows, judge, request("relevance", **texts), lambda r: found("score", "double")(r) & found("rationale", "string")(r), "_relevance").withColumn("relevance", judging.relevance("_relevance"))
    rows = _asked(rows, judge, request("refusal", **texts), lambda r: found("refused", "boolean")(r) & found("rationale", "string")(r), "_refusal").withColumn("refusal", judging.refusal("_refusal"))
    return rows.drop("_claims_reply", "_claims", "_given_reply", "_given", "_attributed", "_relevance", "_refusal")


def _sentences(text: str) -> list[str]:
    return [x for x in (y.strip() for y in re.split(r"\. |\n", text)) if x]


def overlap_judge(prompt: str) -> str:
    """A stand-in for a judge: sentences are claims, supported by the first chunk that has them; relevance is the share of the question's words."""
    turns = json.loads(prompt)
    judgment = next((n for n, (told, _) in JUDGMENTS.items() if told == turns[0]["content"]), None)
    given = turns[1]["content"]
    if judgment == "attribution":
        chunks, _, claims = given.removeprefix("Chunks:\n").rpartition("\n\nClaims:\n")
        have = [set(_sentences(x)) for x in re.split(r"(?m)^\[\d+\] ", chunks)[1:]]
        asked = [x.strip() for x in re.split(r"(?m)^\d+\. ", claims)[1:]]
        first = [next((j for j, sentences in enumerate(have, 1) if claim in sentences), None) for claim in asked]
        return json.dumps({"attributions": [{"claim_idx": i, "supporting_chunk_idx": j, "rationale": "overlap"} for i, j in enumerate(first, 1)]})
    question, _, answer = given.removeprefix("Question: ").partition("\n\nAnswer:\n")
    if judgment == "claims":
        return json.dumps({"claims": _sentences(answer)})
    if judgment == "refusal":
        return json.dumps({"refused": CANONICAL_REFUSAL in answer, "rationale": "canonical or not"})
    words = set(question.lower().split())
    return json.dumps({"score": len(words & set(answer.lower().split())) / len(words) if words else 0.0, "rationale": "overlap"})
