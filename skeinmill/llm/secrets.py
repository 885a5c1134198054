"""Secret scans whose false positives a random forest removes; scanning uses built-in functions only.

Candidates are runs of key characters with a letter and a digit, cut at equals signs inside. Their features are expressions over the
candidate, the words around it and the path: length, transitions between character classes and between
letters, dictionary coverage, neighbouring words. The forest is grown in numpy on the driver from a
bounded table of labelled findings (`sample_rows`, those least by a hash of their text), which are candidates
that the scan itself found in labelled texts, and compiled to
one SQL expression over arrays of nodes, so that scoring is a projection in the scan's own stage, without a shuffle.

Defined results: a null or empty text has no candidates and no row; repeated rows give repeated findings;
a missing path column or null path has no path features; a table of findings of one label only gives
that label as every score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.llm.spans import find_spans, let

#: Labelled findings that the forest is grown from, at most.
SAMPLE_ROWS = 20_000
N_TREES, DEPTH, LEAF, SEED = 15, 7, 5, 3
CUT = 0.5
MIN_CHARS = 12
#: Characters around a candidate that are looked at.
NEAR = 40

#: A stretch of key characters between equals signs, those at the end of the run included, so that a name is apart
#: from its value; a run without a stretch of 12 is taken whole.
_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+(?:=++(?![A-Za-z0-9+/_-]))?|(?<![A-Za-z0-9+/_=-])(?![A-Za-z0-9+/_=-]*?[A-Za-z0-9+/_-]{12})[A-Za-z0-9+/_=-]{12,}+"

#: Words that names, paths and prose in candidates are made of.
DICTIONARY = (
    "access account action admin algorithm alpha api array auth author backup base batch beta block branch buffer build bundle byte cache change chapter check class client cluster code color column commit common "
    "config connect content context control copy core count create data date debug default delete demo dev digest document download draft error event example export feature field file filter final first font form "
    "format function general global group handle hash header height hidden host image import index info input install item january february march april june july august september october november december key label "
    "language last layer layout level library license line link list local lock login main manager map master media memory message method migration minor mobile model module monday name native network node number "
    "object option order output package page parser partition password patch path pattern placeholder plugin point policy port post preview primary private process product profile project property public query "
    "queue random range record region release remote report request reset resource response result revision root route sample schema screen script search secret section select server service session setting shape "
    "shared simple size snapshot source stage start state static status storage store stream string style summary support system table target task template test text theme thread time title token tool track type "
    "unit update upload user value variable vendor version video view volume warning web week width window word worker your"
).split()
#: Frequent letter pairs of English.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
_SECRET_WORDS = r"(?:secret|token|passw|pwd|credential|api.?key|access.?key|private.?key|auth|bearer|signing|client.?secret)"
_BENIGN_WORDS = r"(?:sha|md5|hash|commit|checksum|integrity|digest|uuid|guid|etag|revision|example|sample|placeholder|dummy|fixture|build|version|file|page|section|isbn|order|invoice)"
_ASSIGNS = r"^[\"'`]?[\x20\t]*[=:]+>?[\x20\t]*[\"'`]?$"
_BENIGN_PATH = r"(?:test|example|sample|fixture|mock|lock|doc|demo)"

FEATURES = ["length", "switches", "pairs", "distinct", "digits", "upper", "hex", "dictionary", "triples", "runs", "marks", "secret_before", "benign_before", "assigned", "benign_path", "secret_after", "benign_after", "digest_name"]


def features(found: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Numbers for a candidate, by name; built-in expressions only."""
    n, low = F.length(found).cast("double"), F.lower(found)
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w)))
    flag = lambda c: c.cast("double")
    return {
        "length": n,
        "switches": count(found, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])") / n,
        "pairs": count(low, "(?=" + "|".join(PAIRS) + ")") / n,
        "distinct": F.size(F.array_distinct(F.split(low, ""))).cast("double"),
        "digits": count(found, "[0-9]") / n,
        "upper": count(found, "[A-Z]") / n,
        "hex": flag(low.rlike("^[0-9a-f]+$")),
        "dictionary": (n - F.length(F.regexp_replace(low, words, ""))) / n,
        "triples": count(low, r"(.)\1\1"),
        "runs": count(low, "(?=012|123|234|345|456|567|678|789|abc|bcd|cde|def|efg|xyz)"),
        "marks": count(found, "[_/+=-]") / n,
        "secret_before": flag(F.lower(before).rlike(_SECRET_WORDS)),
        "benign_before": flag(F.lower(before).rlike(_BENIGN_WORDS)),
        "assigned": flag(before.rlike(r"[=:][\x20\t]*[\"'`]?$")),
        "benign_path": flag(F.coalesce(F.lower(path).rlike(_BENIGN_PATH), F.lit(False))),
        "secret_after": flag(F.lower(after).rlike(_SECRET_WORDS)),
        "benign_after": flag(F.lower(after).rlike(_BENIGN_WORDS)),
        "digest_name": flag(low.rlike("^(?:sha[0-9]{1,3}|md5|crc32|blake2[bs]?)[-_=]")),
    }


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, tried: int) -> tuple:
    """A tree as nested (feature, cut, low, high), a leaf as its share of secrets."""
    share = float(y.mean())
    if not depth or len(y) < 2 * LEAF or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in rng.choice(x.shape[1], tried, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAF) & (at <= len(y) - LEAF)]
        if not len(at):
            continue
        left, right = hits[at - 1] / at, (hits[-1] - hits[at - 1]) / (len(y) - at)
        impurity = (at * left * (1 - left) + (len(y) - at) * right * (1 - right)) / len(y)
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0]:
            best = (float(impurity[i]), int(f), float((v[at[i] - 1] + v[at[i]]) / 2))
    if best is None:
        return (share,)
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, _grow(x[low], y[low], depth - 1, rng, tried), _grow(x[~low], y[~low], depth - 1, rng, tried)


def _flat(tree: tuple) -> tuple[list[int], list[float], list[int]]:
    """(feature or -1, cut or share, place of the low child, which the high one follows) of each node."""
    feature, value, low, todo = [-1], [0.0], [0], [(0, tree)]
    while todo:
        node, own = todo.pop()
        if len(own) == 1:
            value[node] = own[0]
            continue
        feature[node], value[node], low[node] = own[0], own[1], len(feature)
        for child in own[2:]:
            todo.append((len(feature), child))
            feature.append(-1)
            value.append(0.0)
            low.append(0)
    return feature, value, low


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        tried = max(1, int(np.sqrt(x.shape[1])) + 1)
        self.trees = []
        for _ in range(N_TREES):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(_grow(x[rows], y[rows], DEPTH, rng, tried))

    def expression(self) -> str:
        """SQL for the mean vote over _f, an array of the features: each tree is walked down from its first node."""
        array = lambda xs, end="": "array(" + ", ".join(f"{x!r}{end}" for x in xs) + ")"
        trees = ", ".join(f"named_struct('f', {array(f)}, 'v', {array(v, 'D')}, 'l', {array(low)})" for f, v, low in map(_flat, self.trees))
        walk = f"aggregate(sequence(1, {DEPTH}), 0, (n, d) -> if(t.f[n] < 0, n, if(x[t.f[n]] <= t.v[n], t.l[n], t.l[n] + 1)))"
        return f"transform(array(_f), x -> aggregate(array({trees}), 0D, (a, t) -> a + t.v[{walk}]) / {len(self.trees)}D)[0]"


def _with_features(frame: DataFrame) -> DataFrame:
    got = features(F.col("found"), F.col("before"), F.col("after"), F.col("path"))
    return frame.withColumn("_f", F.array(*(got[k] for k in FEATURES)))


def train(findings: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> Forest:
    """A forest from labelled findings: found, before, after, path, label (1: a secret)."""
    rows = findings.where("label in (0, 1) and found is not null").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("found", "before", "after", "path")), F.col("label").cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "found", "before", "after", "path"), "found", "before", "label").limit(sample_rows)
    data = [tuple(r._f) + (r.label,) for r in _with_features(rows).select("_f", "label").collect()]
    if not data:
        raise ValueError("no labelled findings")
    table = np.array(sorted(data), np.float64)
    return Forest(table[:, :-1], table[:, -1], seed)


def _named(c: Column) -> Column:
    """Spans whose text before goes on with the candidate before it where only an assignment is between: a long name."""
    own = lambda s, i: F.when((i > 0) & s["before"].rlike(_ASSIGNS), F.right(F.concat(F.get(c, i - 1)["found"], s["before"]), F.lit(NEAR))).otherwise(s["before"])
    return F.transform(c, lambda s, i: s.withField("before", own(s, i)))


def candidates(docs: DataFrame, path: str = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each candidate: doc_id, path, the extra columns, start, end, found, before, after."""
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    own = find_spans(own, "c", _RUN, F.col("text").rlike(r"[A-Za-z0-9+/_=-]{12}") & F.col("text").rlike("[0-9]"), near=NEAR)
    own = own.withColumn("c", let(F.col("c"), _named))
    # An outer explode, because a plain one would have the column worked out once more to leave out empty ones.
    rows = own.select("doc_id", "path", *extra, F.explode_outer("c").alias("c")).where("c.found rlike '[0-9]' and c.found rlike '[A-Za-z]'")
    return rows.select("doc_id", "path", *extra, "c.*")


def scan(docs: DataFrame, forest: Forest, cut: float = CUT, path: str = "source") -> DataFrame:
    """A row for each candidate: doc_id, start_pos, end_pos, candidate_sha256, score, is_secret."""
    scored = _with_features(candidates(docs, path)).withColumn("score", F.expr(forest.expression()))
    return scored.select("doc_id", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), F.sha2("found", 256).alias("candidate_sha256"), "score", (F.col("score") >= cut).alias("is_secret"))


#: Names and lead-ins of the made-up findings: of secrets, and of values that look like them.
_KEYS = "token secret api_key apikey password passwd auth_token client_secret access_key private_key credential signing_secret session_key db_password webhook_key".split()
_PLAIN = "commit sha256 md5 checksum integrity digest uuid etag revision build version file page order invoice section trace id image tag label name url path".split()
_PROSE = "the of and see with at for la der que in von les una zu on".split()
_SAMPLES = "your_token_here_1234 xxxxxxxxxxxxxxxx1234 abcdefgh12345678 0123456789abcdef example_secret_key_1 aaaaaaaaaaaaaaaa0000 changeme1234changeme deadbeefdeadbeefdead0 replace_with_real_key2 INSERT_TOKEN_HERE_001 test1234test1234".split()
_HEX, _B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def labelled_texts(n: int = 3000, seed: int = 5) -> list[tuple[int, str, str, str]]:
    """(id, path, text, the secret in it or ""): made-up texts of fixed number, by rule; a stand-in for reviewed ones."""
    rng = np.random.default_rng(seed)
    draw = lambda chars, k: "".join(rng.choice(list(chars), k))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda k: [pick(DICTIONARY) for _ in range(k)]
    hexes = lambda: draw(_HEX, pick([16, 20, 24, 32, 40, 64]))
    coded = lambda: draw(_B64, int(rng.integers(18, 60))) + pick(["", "", "=", "=="])
    plain = lambda: draw(_B64[:-2], int(rng.integers(16, 44)))
    uuid = lambda: "-".join(draw(_HEX, k) for k in (8, 4, 4, 4, 12))
    out = []
    for i in range(n):
        path, value, key = pick(["src/app.py", "deploy/prod.env", "src3", "src11", "", "conf/service.yaml"]), "", pick(_KEYS)
        if i % 2:
            value = pick([hexes, coded, plain, plain])()
            named = pick([key, key.upper(), f"{pick(DICTIONARY)}_{key}", f"{pick(DICTIONARY)}_{key}".upper()])
            text = pick([f'{named} = "{value}"', f"{named}={value}", f"export {named}={value}", f"--{named.replace('_', '-')}={value}", f'"{named}": "{value}"', f"{named}: {value}", f"{named}: '{value}'", f"Authorization: Bearer {value}", f"{key} {value}", f"{named} := `{value}`"])
            if i % 10 == 1:
                path, value = pick(["tests/test_auth.py", "docs/example.md", "fixtures/sample.json", "mock/data.json"]), ""
        else:
            word = "_".join(some(int(rng.integers(2, 5))))
            text = pick([
                f"{pick(_PLAIN)} {hexes()}", f"{pick(_PLAIN)}: {hexes()}", f"{pick(_PLAIN)}={hexes()}", f"commit {draw(_HEX, 40)} by", f"sha256:{draw(_HEX, 64)}", f'"integrity": "sha512-{coded()}"', f"{pick(['request', 'session', 'trace'])} id {uuid()}", f"{pick(_PLAIN)}={uuid()}",
                f"/usr/lib/{'/'.join(some(2))}/{word}{int(rng.integers(100))}", f"https://example.org/{'/'.join(some(3))}/{int(rng.integers(10**6))}", f"{word}_{int(rng.integers(3000))}", f"{word.upper()}_{int(rng.integers(100))}", f"{''.join(w.title() for w in some(3))}{int(rng.integers(10))}",
                f'{key} = "{pick(_SAMPLES)}"', f"{key}={pick(_SAMPLES)}", f'{key} = "{word}_{int(rng.integers(100))}"', f"{pick(['v', 'build-', 'release-'])}{int(rng.integers(2000, 2030))}{pick(['-', '_'])}{draw(_HEX, 12)}", f"data:image/png;base64,{draw(_B64, int(rng.integers(60, 200)))}",
            ])
        out.append((i, path, f"{pick(_PROSE)} {pick(_PROSE)} {text}{pick([' ', ', ', '. '])}{pick(_PROSE)} {pick(_PROSE)}", value))
    return out


def labelled_findings(spark: SparkSession, n: int = 3000, seed: int = 5) -> DataFrame:
    """The candidates that the scan finds in labelled texts, with label 1 where one is the text's secret."""
    texts = spark.createDataFrame(labelled_texts(n, seed), "doc_id long, source string, text string, secret string")
    return candidates(texts, extra=("secret",)).select("found", "before", "after", "path", (F.col("found") == F.col("secret")).cast("int").alias("label"))
