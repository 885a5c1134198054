"""Column expressions over text: stripping, words, patterns, JSON blocks, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings too common to tell documents apart.
GENERIC_HEADINGS = [
    "overview", "introduction", "usage", "setup", "installation", "examples", "example", "resources", "references", "license", "notes", "note", "see also", "citation", "citations", "further reading", "quickstart",
    "quick start", "background", "configuration", "config", "arguments", "parameters", "api", "api reference", "supported models", "tips", "warnings", "limitations", "summary", "conclusion", "appendix",
]
#: Beginnings of headings that are annotations.
ANNOTATIONS = ["note:", "tip:", "warning:", "todo:", "fixme:"]

#: What a chunk's text says about the kinds of question it can seed.
COMPARISON_TEXT = r"(?i)\btwo (?:general )?types\b|\bvs\.?(?:\s|$)|\bversus\b|\binstead of\b|\bcompared (?:to|with)\b|\bdiffer(?:s|ence|ent)\b|\bdistinct(?:ion)?\b|\bunlike\b|\bwhereas\b"
ADVICE_TEXT = r"(?i)\bwe (?:advise|recommend)\b|\brecommended\b|\bbest practice\b|\byou should\b|\bshould be (?:set|used|called|configured|applied)\b|\bmake sure (?:to|that)\b|\bprefer(?:red)?\b|\bleads to (?:more|better)\b"
ADVICE_HEADING = r"(?im)(?:^|\n)\s*#*\s*(?:usage )?tips?\s*$|(?:^|\n)\s*#*\s*best practices?\s*$"
POINTER_TEXT = (
    r"(?i)\b(?:a )?good (?:starting point|place to start)\b|\bstarting point\b|\brefer to (?:the )?|\bsee (?:the )?(?:[\w\-]+ )?(?:repository|repo|script|notebook|guide|docs?)\b"
    r"|\bfor more (?:details|information|context)\b|\blook at (?:the )?|\bcopy(?:,)? adapt(?:,)? and reuse\b|\bconversion script\b"
)
#: Signs of code in a chunk.
CODE_HINT = r"(?i)```(?:py|python|bash|sh|json|yaml|toml)\b"
REPL_LINE = r"(?m)^>>> "
#: The shape that a query of each kind has; other kinds may have any.
SHAPES = {
    "procedural": r"(?i)^\s*how\b",
    "comparison": r"(?i)\b(differ(s|ence|ent)?|vs\.?|versus|compared\s+(to|with)|instead\s+of)\b|^\s*should\s+i\s+use\b|^\s*when\s+(should|do)\s+i\s+use\b",
    "best_practice": r"(?i)\b(recommend(ed)?|best\s+(way|practice|approach)|should\s+i|how\s+should\s+i|preferred?|advise[sd]?)\b",
    "pointer": r"(?i)\bwhere\b|\b(starting\s+point|good\s+place\s+to\s+start|find\s+(the|an?)|locate\s+the)\b",
}
#: Names and patterns of refusals, in the order in which they are tried on lower-cased text.
REFUSALS = [
    ("no_information", r"\b(?:no|not enough|insufficient)\s+(?:information|context|details?)\b"),
    ("dont_have_context", r"\b(?:do\s+not|don'?t|doesn'?t|does\s+not)\s+have\s+(?:enough|the|sufficient|adequate|any|relevant)?\s*(?:context|information|details?)\b"),
    ("cannot_action", r"\b(?:i'?m\s+|i\s+am\s+|i\s+)?(?:do\s+not|don'?t|cannot|can'?t|am\s+unable\s+to|unable\s+to)\s+(?:know|determine|tell|say|answer|provide|find|help|locate)\b"),
    ("not_in_context", r"\b(?:not|isn'?t)\s+(?:in|covered|mentioned|addressed|found)\s+(?:in\s+)?(?:the\s+)?(?:provided\s+)?context\b"),
    ("context_doesnt", r"\bcontext\s+(?:does\s+not|doesn'?t)\s+(?:contain|cover|mention|provide|include|address)\b"),
    ("no_relevant", r"\bno\s+relevant\s+(?:information|context|content|details?)\b"),
    ("apologize_unable", r"\b(?:i\s+)?apologi[sz]e\b.{0,40}\b(?:unable|cannot|can'?t)\b"),
]
#: Fixed value: the answer that a refusal gives.
CANONICAL_REFUSAL = "I don't have enough context to answer that."


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(F.regexp_replace(col(x), r"^\s+", ""), r"\s+$", "")


def words(x: Column | str, lower: bool = False) -> Column:
    """Runs of non-whitespace."""
    x = F.lower(col(x)) if lower else col(x)
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def meaningful_heading(x: Column) -> Column:
    """Not generic, no annotation, two words and 12 characters at least."""
    text, low = strip(x), F.lower(strip(x))
    return ~low.isin(GENERIC_HEADINGS) & ~low.rlike("^(?:" + "|".join(ANNOTATIONS) + ")") & (F.size(words(text)) >= 2) & (F.length(text) >= 12)


def headings(content: Column | str) -> Column:
    """Second-level headings of a markdown text, anchors left out, that are meaningful."""
    found = F.regexp_extract_all(col(content), F.lit(r"(?md)^##\s+(.+?)(?:\s*\[\[[^\]]+\]\])?\s*$"), F.lit(1))
    return F.filter(found, meaningful_heading)


def is_procedural(x: Column | str) -> Column:
    return (F.regexp_count(col(x), F.lit("```")) >= 2) | col(x).rlike(CODE_HINT) | col(x).rlike(REPL_LINE)


def is_comparison(x: Column | str) -> Column:
    return col(x).rlike(COMPARISON_TEXT)


def is_best_practice(x: Column | str) -> Column:
    return col(x).rlike(ADVICE_TEXT) | col(x).rlike(ADVICE_HEADING)


def is_pointer(x: Column | str) -> Column:
    return col(x).rlike(POINTER_TEXT)


def question_types(x: Column | str) -> Column:
    """All kinds of question that a chunk's text has affinity for, never refusal."""
    kinds = [("procedural", is_procedural(x)), ("comparison", is_comparison(x)), ("best_practice", is_best_practice(x)), ("pointer", is_pointer(x))]
    return F.array_compact(F.array(*(F.when(test, F.lit(kind)) for kind, test in kinds)))


def has_shape(query: Column | str, kind: Column | str) -> Column:
    """Whether a query is worded as one of its kind is; kinds without a shape always are."""
    out = F.lit(True)
    for name, pattern in SHAPES.items():
        out = F.when(col(kind) == name, col(query).rlike(pattern)).otherwise(out)
    return out


def refusal_pattern(answer: Column | str) -> Column:
    """Name of the first refusal pattern in an answer, else null."""
    low = F.lower(col(answer))
    return F.coalesce(*(F.when(low.rlike(pattern), F.lit(name)) for name, pattern in REFUSALS))


def markers(text: Column | str) -> Column:
    """Numbers of all [N] markers; null for those too large to be one."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.try_cast("int"))


def json_block(text: Column | str, greedy: bool = True) -> Column:
    """What looks like JSON in a model's answer: inside a fence, else from brace to brace, else all.

    The generator's answers take the shortest braces and a fence with line breaks; others the longest
    braces and any fence.
    """
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```" if greedy else r"(?s)```(?:json)?\s*\n(.*?)\n```"
    braces = r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}"

    def block(x: Column) -> Column:
        return F.when(x.rlike(fence), strip(F.regexp_extract(x, fence, 1))).when(x.rlike(braces), F.regexp_extract(x, braces, 0)).otherwise(x)

    return let(strip(text), block)


def json_string(block: Column, field: str) -> Column:
    """A field of a JSON object if it is a string, stripped and not empty, else null."""


    def value(v: Column) -> Column:
        text = strip(F.try_variant_get(v, f"$.{field}", "string"))
        return F.when((F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) == "STRING") & (text != ""), text)

    return let(F.try_parse_json(block), value)


def query_of(answer: Column | str) -> Column:
    """The query in a generator's answer, else null."""
    return json_string(json_block(answer, greedy=False), "query")


def distilled_answer(answer: Column | str) -> Column:
    """The answer in a teacher's output; the bare or quoted canonical refusal counts as one."""
    bare = strip(answer)
    bare = F.when(bare.startswith('"') & bare.endswith('"') & (F.length(bare) >= 2), F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.when(bare == CANONICAL_REFUSAL, F.lit(CANONICAL_REFUSAL)).otherwise(json_string(json_block(answer), "answer"))


def family(doc_id: Column | str) -> Column:
    return F.substring_index(col(doc_id), "/", 1)


def chunk_id(doc_id: Column | str, index: Column | str) -> Column:
    return F.concat(col(doc_id).cast("string"), F.lit("::chunk_"), col(index).cast("string"))


def chunk_block(chunks: Column | str, with_source: bool = True, empty: str = "") -> Column:
    """Numbered chunks, with their source or without, parted by blank lines."""

    def one(c: Column, i: Column) -> Column:
        head = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
        return F.concat(head, F.lit("(source: "), c["doc_id"], F.lit(")\n"), c["text"]) if with_source else F.concat(head, c["text"])

    return F.when(F.size(col(chunks)) > 0, F.array_join(F.transform(col(chunks), one), "\n\n")).otherwise(F.lit(empty))


def claim_block(claims: Column | str) -> Column:
    return F.array_join(F.transform(col(claims), lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")


def hash_order(seed: int, key: Column | str) -> Column:
    """A place in a shuffled order that any engine with md5 finds too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def utc_stamps(at: Column | str) -> dict[str, Column]:
    """What reports are stamped with, in UTC whatever the session's zone: ISO seconds, a run's id, a day."""
    utc = F.to_utc_timestamp(col(at), F.current_timezone())
    return {"captured_at": F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), "run_id": F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'"), "run_day": F.date_format(utc, "yyyyMMdd")}
