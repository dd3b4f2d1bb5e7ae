"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers. Beside them,
generators of high recall propose spans that the rules miss or that overlap theirs (bracketed "(at)",
numbers without "+", other separators), and secrets: runs of letters and digits that may be keys, tokens
or passwords. Each candidate gets a few small integers on its format and context. Labels come from other
evidence than these: candidates of the four kinds are positive if the base rule, with its checksum or
range, holds on them; secrets if their issuer's prefix or the name of a credential right before them says
so, and what the trees see of them is the bare format. Boosted trees of depth two are grown on the counts
of each combination of integers, a threshold for each kind is calibrated on the documents that are held
out from the growth (expected precision, with one success and one failure added), and the trees become
one SQL expression. Candidates over their kind's threshold that don't overlap a base span are added, and
so are secrets that a name or prefix tells, whatever the trees could learn: a few documents are enough.

The table of counts has a proven bound whatever the corpus: the product of the features' ranges, some
55,000 combinations over all kinds and as many for held-out documents.

The texts are read once. What the patterns match goes, with lengths and a few characters of the pieces
between matches, into a small table in the shared folder; from there on no text is touched. Offsets are
in code points and come from the lengths of matches and pieces. Everything is done row by row but for
the one aggregation of counts, so no key or group can grow hot.

Patterns hold no nested repetition of varying length: Java's matcher recurses there and long runs of
digits would overflow its stack. Each is equal to the plain form in its comment.

Defined results: null text is empty; rows of equal doc_id are judged each on its own; documents without
any match have no spans; a kind without candidates that reach the precision adds nothing but what names and prefixes tell; only doc_id and
text are read; very long texts and runs are read whole.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ["email", "ip", "card", "phone"]
#: Those that the method adds have no base rule.
EVERY = [*KINDS, "secret"]
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?=[A-Za-z0-9-]|\.[A-Za-z0-9-])[A-Za-z0-9.-])*",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:(?=[0-9]|[\x20-][0-9])[0-9\x20-])+",
    # as given
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\.|\[\.\]| \. )[0-9]{1,3}){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{0,2}[0-9]{4}){2}[ ./_-]{0,2}[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_-])(?:(?=[A-Za-z_-]{0,63}[0-9])(?=[0-9_-]{0,63}[A-Za-z])[A-Za-z0-9_-]{12,64}+|[A-Z]{16,64}+)(?![A-Za-z0-9_-])",
}
#: A text that lacks this has no match of BASE that is valid, and none of CANDIDATE: each is implied by the pattern of its own table.
BASE_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{4}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}
CANDIDATE_NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9](?:\.|\[\.\]| \. )[0-9]", "card": r"[0-9]{4}", "phone": r"[0-9]{2}\)?[\x20.-]", "secret": r"[0-9][_-]*[A-Za-z]|[A-Za-z][_-]*[0-9]|[A-Z]{16}"}
CUES = [("phone", r"(?i)\b(?:tel|phone|call|mobile|fax|whatsapp)\b"), ("email", r"(?i)\b(?:e-?mail|contact|write)\b"), ("card", r"(?i)\b(?:card|visa|credit|payment|account)\b"), ("ip", r"(?i)\b(?:ip|address|server|host)\b"), ("other", r"(?i)\b(?:version|v|isbn|issn|order|id|no|ref|page|pp|date)\b")]
#: What says that a secret is one: a credential's name and a sign of assignment before it, or the prefix of an issuer.
NAMED = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?$"
ISSUED = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_\w{20,}|sk[-_][A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})$"
#: Features of each kind; each has at most the number of values in RANGES.
FEATURES = {
    "email": ["groups", "cue", "before", "after", "tld"],
    "ip": ["varied", "cue", "before", "after"],
    "card": ["digits", "groups", "varied", "cue", "before", "after"],
    "phone": ["digits", "groups", "varied", "cue", "before", "after"],
    "secret": ["size", "varied", "case", "share", "turns"],
}
RANGES = {"digits": 6, "groups": 6, "varied": 5, "cue": 6, "before": 4, "after": 4, "tld": 8, "size": 6, "case": 4, "share": 4, "turns": 4}
TREES, RATE, PRECISION = 20, 0.4, 0.9
#: Documents with spans that are broadcast to be joined back.
MOST_JOINED = 100_000
SPAN = "array<struct<s:int,e:int,m:string,b:string,a:string>>"


def _with(f, value):
    """f with its first argument set; the functions that take lambdas count their parameters."""
    return lambda x: f(value, x)


def _pieces(text: Column, pattern: str, needs: str) -> tuple[Column, Column]:
    """Matches, and length and ends of what stands before, between and after them."""
    has = text.rlike(needs)
    parts = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(24)).alias("b"), F.left(p, F.lit(8)).alias("a")))
    return F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(has, parts)


def _spans(matches: Column, pieces: Column) -> Column:
    """Start, end, match and its surroundings."""
    step = lambda acc, i: F.struct(
        (acc["p"] + pieces[i]["n"] + F.length(matches[i])).alias("p"),
        F.array_append(acc["o"], F.struct((acc["p"] + pieces[i]["n"]).alias("s"), (acc["p"] + pieces[i]["n"] + F.length(matches[i])).alias("e"), matches[i].alias("m"), pieces[i]["b"].alias("b"), pieces[i + 1]["a"].alias("a"))).alias("o"),
    )
    start = F.struct(F.lit(0).alias("p"), F.array().cast(SPAN).alias("o"))
    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step)["o"]).otherwise(F.array().cast(SPAN))


def _luhn(digits: Column) -> Column:
    """Digits that pass Luhn's test."""
    digit = lambda i: F.ascii(F.substr(digits, F.length(digits) - i + 1, F.lit(1))) - 48
    twice = lambda i: F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda n, i: n + F.when(i % 2 == 0, twice(i)).otherwise(digit(i))) % 10 == 0)


def _octets(match: Column) -> Column:
    return F.forall(F.split(F.regexp_replace(match, r"[^0-9.]", ""), r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(x, "^0+", "").try_cast("int"), F.lit(0)) <= 255))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    return {"email": F.lit(True), "ip": _octets(match), "phone": F.length(digits).between(9, 15)}[kind]


def _class(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"[\s]"), 1).when(char.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def _features(kind: str, x: Column) -> list[Column]:
    m = x["m"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    size, turns = F.length(m), F.size(F.regexp_extract_all(m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0)))
    distinct = F.size(F.array_distinct(F.split(m if kind == "secret" else digits, "")))
    made = {
        "digits": F.when(n < 9, 0).when(n < 10, 1).when(n < 13, 2).when(n < 14, 3).when(n < 17, 4).otherwise(5),
        "groups": F.least(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), F.lit(5)),
        "varied": F.least(F.floor(distinct / 3) if kind == "secret" else distinct, F.lit(4)),
        "cue": F.coalesce(*(F.when(x["b"].rlike(p), k + 1) for k, (_, p) in enumerate(CUES)), F.lit(0)),
        "before": _class(F.right(x["b"], F.lit(1))),
        "after": _class(F.left(x["a"], F.lit(1))),
        "tld": F.least(F.length(F.regexp_extract(m, r"([A-Za-z0-9-]*)$", 1)), F.lit(7)),
        "size": F.when(size < 16, 0).when(size < 20, 1).when(size < 24, 2).when(size < 32, 3).when(size < 41, 4).otherwise(5),
        "case": F.when(m.rlike("^[0-9a-f]+$"), 0).when(m.rlike("^[0-9A-Z]+$"), 1).when(m.rlike("^[0-9a-z_-]+$"), 2).otherwise(3),
        "share": F.least(F.floor(4 * n / size), F.lit(3)),
        "turns": F.least(F.floor(turns / 2), F.lit(3)),
    }
    return [made[f].cast("int").alias(f) for f in FEATURES[kind]]


def _overlaps(x: Column, y: Column) -> Column:
    return (x["s"] < y["e"]) & (y["s"] < x["e"])


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id; text_key: hash of the text; base_<kind>: valid base spans; cand_<kind>: candidates with features, `same` (evidence for the kind) and `base` (overlaps a base span of any)."""
    text = F.coalesce("text", F.lit(""))
    made, sides = [], [("r", k, BASE[k], BASE_NEEDS[k]) for k in KINDS] + [("g", k, CANDIDATE[k], CANDIDATE_NEEDS[k]) for k in EVERY]
    for name, kind, pattern, needs in sides:
        m, p = _pieces(text, pattern, needs)
        made += [m.alias(f"{name}m_{kind}"), p.alias(f"{name}p_{kind}")]
    seen = written(documents.select("doc_id", F.xxhash64("text").alias("text_key"), *made), "pii-pieces")
    for name, kind, *_ in sides:
        seen = seen.withColumn(f"{name}_{kind}", _spans(F.col(f"{name}m_{kind}"), F.col(f"{name}p_{kind}")))
    seen = seen.select("doc_id", "text_key", *(F.filter(f"r_{k}", _with(lambda k, x: _valid(k, x["m"]), k)).alias(f"base_{k}") for k in KINDS), *(f"g_{k}" for k in EVERY))
    same = lambda k, x: F.exists(f"base_{k}", lambda y: _overlaps(x, y)) if k in KINDS else x["b"].rlike(NAMED) | x["m"].rlike(ISSUED)
    every = F.concat(*(F.col(f"base_{k}") for k in KINDS))
    return seen.select(
        "doc_id",
        "text_key",
        *(f"base_{k}" for k in KINDS),
        *(
            F.transform(
                f"g_{k}",
                _with(lambda k, x: F.struct(x["s"].alias("s"), x["e"].alias("e"), same(k, x).alias("same"), F.exists(every, lambda y: _overlaps(x, y)).alias("base"), *_features(k, x)), k),
            ).alias(f"cand_{k}")
            for k in EVERY
        ),
    )


Tree = tuple  # (feature, cut, (feature, cut, leaf, leaf), (feature, cut, leaf, leaf))


def _split(rows: list[tuple[tuple[int, ...], float, float]]) -> tuple[int, int]:
    """Feature and cut (x <= cut goes left) of the greatest gain. rows: features, gradient, curvature."""
    best, at = -1.0, (0, 1 << 30)
    total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    for f in range(len(rows[0][0])):
        by: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for x, g, h in rows:
            by[x[f]][0] += g
            by[x[f]][1] += h
        g = h = 0.0
        for cut in sorted(by)[:-1]:
            g, h = g + by[cut][0], h + by[cut][1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1)
            if gain > best:
                best, at = gain, (f, cut)
    return at


def _leaf(rows: list) -> float:
    return RATE * sum(r[1] for r in rows) / (sum(r[2] for r in rows) + 1)


def _grown(rows: list) -> Tree:
    f, cut = _split(rows)
    sides = []
    for side in ([r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]):
        g, c = _split(side) if side else (0, 0)
        sides.append((g, c, _leaf([r for r in side if r[0][g] <= c]), _leaf([r for r in side if r[0][g] > c])))
    return f, cut, *sides


def _value(tree: Tree, x: tuple[int, ...]) -> float:
    f, cut, left, right = tree
    g, c, a, b = left if x[f] <= cut else right
    return a if x[g] <= c else b


def boost(counts: dict[tuple[int, ...], tuple[int, int]], trees: int = TREES) -> list[Tree]:
    """Trees for the log-odds of positives. counts: features -> candidates, positives."""
    at = {x: 0.0 for x in counts}
    grown: list[Tree] = []
    for _ in range(trees if counts else 0):
        rows = []
        for x, (n, good) in counts.items():
            p = 1 / (1 + math.exp(-at[x]))
            rows.append((x, good - n * p, n * p * (1 - p)))
        grown.append(_grown(rows))
        for x in at:
            at[x] += _value(grown[-1], x)
    return grown


def threshold(counts: dict[tuple[int, ...], tuple[int, int]], trees: list[Tree], precision: float = PRECISION) -> float:
    """The lowest score from which on held-out candidates are positive at the wanted expected precision; infinite if none is."""
    scored = sorted(((sum(_value(t, x) for t in trees), n, good) for x, (n, good) in counts.items()), reverse=True)
    best, n, good = math.inf, 0, 0
    for k, (s, more, right) in enumerate(scored):
        n, good = n + more, good + right
        if (k + 1 == len(scored) or scored[k + 1][0] < s) and good + 1 >= precision * (n + 2):
            best = s
    return best


def fit(found: DataFrame) -> dict[str, tuple[list[Tree], float]]:
    """Kind -> trees and threshold, from counts by kind, fold and features; their number is bounded by RANGES.

    Candidates on a base span of another kind are never added, so they don't count.
    """
    rows = None
    for k in EVERY:
        part = found.select(F.lit(k).alias("kind"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("fold"), F.explode(f"cand_{k}").alias("x"))
        part = part.where("x.same or not x.base").select("kind", "fold", "x.same", F.array(*(f"x.{f}" for f in FEATURES[k])).alias("x"))
        rows = part if rows is None else rows.unionAll(part)
    taken = rows.groupBy("kind", "fold", "x").agg(F.count("*").alias("n"), F.sum(F.col("same").cast("int")).alias("good")).collect()
    out = {}
    for k in EVERY:
        grow, hold = ({tuple(r["x"]): (r["n"], r["good"]) for r in sorted(taken) if r["kind"] == k and r["fold"] is fold} for fold in (False, True))
        trees = boost(grow)
        out[k] = trees, threshold(hold, trees)
    return out


def _score(kind: str, trees: list[Tree], x: Column) -> Column:
    total = F.lit(0.0)
    for f, cut, left, right in trees:
        a, b = (F.when(x[FEATURES[kind][g]] <= c, F.lit(p)).otherwise(F.lit(q)) for g, c, p, q in (left, right))
        total = total + F.when(x[FEATURES[kind][f]] <= cut, a).otherwise(b)
    return total


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id; text_key; base and spans: array<struct<kind, s, e>> by kind as listed, then start."""
    found = written(candidates(documents), "pii-candidates")
    models = fit(found)
    kind = "struct<o:int,s:int,e:int>"
    base = F.concat(*(F.transform(f"base_{k}", _with(lambda o, x: F.struct(F.lit(o).alias("o"), x["s"].alias("s"), x["e"].alias("e")).cast(kind), o)) for o, k in enumerate(KINDS)))
    new = []
    for o, k in enumerate(EVERY):
        trees, least = models[k]
        learned = bool(trees) and least < math.inf
        if learned or k not in KINDS:
            likely = lambda m, x: _score(m[0], m[1], x) >= F.lit(m[2] - 1e-9) if learned else F.lit(False)  # noqa: E731, B023
            told = lambda m, x: F.lit(False) if m[0] in KINDS else x["same"]
            ok = F.filter(f"cand_{k}", _with(lambda m, x: ~x["base"] & (told(m, x) | likely(m, x)), (k, trees, least)))
            new.append(F.transform(ok, _with(lambda o, x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), x["e"].alias("e")).cast("struct<s:int,o:int,e:int>"), o)))
    added = F.array().cast(f"array<{kind}>")
    if new:  # of added spans that overlap, the first stays
        keep = lambda acc, x: F.when(x["s"] >= acc["p"], F.struct(x["e"].alias("p"), F.array_append(acc["o"], F.struct(x["o"].alias("o"), x["s"].alias("s"), x["e"].alias("e")).cast(kind)).alias("o"))).otherwise(acc)
        added = F.aggregate(F.array_sort(F.concat(*new)), F.struct(F.lit(0).alias("p"), added.alias("o")), keep)["o"]
    named = lambda spans: F.transform(F.array_sort(spans), lambda x: F.struct(F.element_at(F.array(*map(F.lit, EVERY)), x["o"] + 1).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return found.select("doc_id", "text_key", named(base).alias("base"), named(F.concat(base, added)).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *(F.size(F.filter("base", _with(lambda k, x: x["kind"] == k, k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(F.filter("spans", lambda x: x["kind"] == "secret")).cast("long").alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_pii(table(spark, sf_dir, "documents")))


def redact(documents: DataFrame) -> DataFrame:
    """The documents, all their columns, with every span of the text replaced by its kind in angle brackets.

    Overlapping spans become one mark, named for the first; n_chars, where there is one, follows the text.
    Only documents with spans are joined back, by id and text, and broadcast if they are at most MOST_JOINED.
    """
    spans = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    found = find_pii(documents).where(F.size("spans") > 0).select(F.col("doc_id").alias("pii_doc"), F.col("text_key").alias("pii_key"), spans.alias("pii_spans")).dropDuplicates(["pii_doc", "pii_key"])
    found = written(found, "pii-spans")
    met = F.broadcast(found) if found.count() <= MOST_JOINED else found
    joined_ = documents.join(met, F.col("doc_id").eqNullSafe(F.col("pii_doc")) & (F.xxhash64("text") == F.col("pii_key")), "left")
    piece = lambda acc, x: F.when(
        x["s"] >= acc["p"],
        F.struct(F.concat(acc["t"], F.substring("text", acc["p"] + 1, x["s"] - acc["p"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("t"), x["e"].alias("p")),
    ).otherwise(F.struct(acc["t"].alias("t"), F.greatest(acc["p"], x["e"]).alias("p")))
    whole = F.aggregate("pii_spans", F.struct(F.lit("").alias("t"), F.lit(0).alias("p")), piece, lambda acc: F.concat(acc["t"], F.substring("text", acc["p"] + 1, F.length("text"))))
    text = F.when(F.col("pii_spans").isNotNull(), whole).otherwise(F.col("text"))
    out = joined_.withColumn("text", text)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
