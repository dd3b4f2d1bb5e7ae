"""Neighbouring pages that repeat each other, and other checks of cleaned text."""

from __future__ import annotations

import re
from collections.abc import Container, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines
from ..sources.scratch import written
from . import matching
from .sizes import MOST_BYTES, bytes_of


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, for pairs that something else has already made few."""

    @F.pandas_udf("double")
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([matching.ratio(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return each(a, b)


def distinct_lines(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(lines(text), F.trim), lambda x: x != ""))


def containment(a: Column, b: Column) -> Column:
    """Distinct lines in common, of those of the page that has fewer; null if that has none."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def word_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k words; a text of fewer words is one run."""
    words = F.split(F.trim(F.regexp_replace(text, "[ \t\n]+", " ")), " ")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " ")))))[0]


def page_pairs(pages: DataFrame, method: str = "shingle", k: int = 3, threshold: float = 0.75) -> DataFrame:
    """doc_key, prev_order, page_ord, similarity, containment, duplicate. method: 'shingle' (Jaccard of word shingles, in the JVM) or 'ratio' (exact, in Python).

    What is compared is worked out once a page, before the window that brings neighbours together.
    """
    w = Window.partitionBy("doc_key").orderBy("page_ord")
    what = word_shingles(F.col("body"), k) if method == "shingle" else F.trim(F.regexp_replace("body", "[ \t\n]+", " "))
    near = pages.select("doc_key", "page_ord", what.alias("x"), distinct_lines(F.col("body")).alias("ls"))
    near = near.select("*", F.lag("page_ord").over(w).alias("prev_order"), F.lag("x").over(w).alias("y"), F.lag("ls").over(w).alias("ks")).where("prev_order is not null")
    like = jaccard(F.col("x"), F.col("y")) if method == "shingle" else ratio(F.col("x"), F.col("y"))
    out = near.select("doc_key", "prev_order", "page_ord", F.round(like, 6).alias("similarity"), F.round(containment(F.col("ls"), F.col("ks")), 6).alias("containment"))
    return out.withColumn("duplicate", F.col("similarity") > threshold)


def keep_cleanest(pages: DataFrame, pairs: DataFrame, edits: Column) -> DataFrame:
    """doc_key, page_ord, kept, twin: runs of pages that repeat their neighbour are one group; its page of the fewest edits, then the longest, stays."""
    marked = pages.join(pairs.where("duplicate").select("doc_key", "page_ord", F.lit(0).alias("starts")), ["doc_key", "page_ord"], "left")
    run = F.sum(F.coalesce("starts", F.lit(1))).over(Window.partitionBy("doc_key").orderBy("page_ord"))
    best = Window.partitionBy("doc_key", "run").orderBy("edits", F.desc("n"), "page_ord")
    ranked = marked.withColumn("edits", edits).withColumn("n", F.length("body")).withColumn("run", run)
    ranked = ranked.withColumn("twin", F.first("page_ord").over(best))
    return ranked.select("doc_key", "page_ord", (F.col("twin") == F.col("page_ord")).alias("kept"), "twin")


def page_offsets(pages: DataFrame, kept: DataFrame, gap: int = 1) -> DataFrame:
    """doc_key, page_ord, char_offset, twin: where each page starts once dropped pages are gone; a dropped one has its twin's."""
    body = pages.join(kept, ["doc_key", "page_ord"])
    at = F.coalesce(F.sum(F.length("body") + gap).over(Window.partitionBy("doc_key").orderBy("page_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = body.where("kept").select("doc_key", F.col("page_ord").alias("twin"), at.alias("char_offset"))
    return body.select("doc_key", "page_ord", "twin").join(starts, ["doc_key", "twin"]).select("doc_key", "page_ord", F.col("char_offset").cast("long").alias("char_offset"), "twin")


def salvage(pages: DataFrame, kept: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_key, twin, page_ord, line_no, line: lines of dropped pages that no line of the kept twin is like."""
    line = lambda df: df.select("doc_key", "page_ord", "twin", F.posexplode(lines(F.col("body"))).alias("line_no", "line")).where("trim(line) <> ''")
    body = pages.join(kept, ["doc_key", "page_ord"])
    stays = line(body.where("kept"))
    equal = stays.select("doc_key", "twin", "line").distinct()
    gone = line(body.where("not kept")).join(equal, ["doc_key", "twin", "line"], "left_anti")  # most lines end here
    pairs = gone.alias("g").join(stays.select("doc_key", "twin", F.col("line").alias("other")), ["doc_key", "twin"], "left")
    best = pairs.withColumn("r", ratio(F.col("line"), F.col("other"))).groupBy("doc_key", "twin", "page_ord", "line_no", "line").agg(F.max("r").alias("r"))
    return best.where(F.coalesce("r", F.lit(0.0)) < least).drop("r")


def corrected(clauses: DataFrame, corrections: DataFrame, strict: bool = True) -> DataFrame:
    """clauses (n, text, flags) with each correction's `find` replaced, which must occur exactly once in its clause.

    strict: fail on any other number of occurrences; else such clauses stay as they are. Adds `occurrences` (null: no correction).
    """
    met = clauses.join(corrections, "n", "left")
    times = ((F.length("text") - F.length(F.replace("text", "find"))) / F.length("find")).cast("int")
    met = met.withColumn("occurrences", times)
    if strict:
        met = met.where(F.assert_true(F.col("find").isNull() | (F.col("occurrences") == 1), F.lit("a correction must match once")).isNull())
    once = F.col("occurrences") == 1
    return met.select("n", F.when(once, F.replace("text", "find", "repl")).otherwise(F.col("text")).alias("text"), F.when(once, F.array_append("flags", F.lit("CORRECTED"))).otherwise(F.col("flags")).alias("flags"), "occurrences")


LEAST_LETTERS = 6
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
_PART = re.compile("PART([IVX]+)")
_TOKEN = re.compile("[A-Za-z]{%d,}" % LEAST_LETTERS)


def _words(piece: str, allowed: Container[str], longest: int) -> list[str] | None:
    """The piece as allowed words of two letters or more, the last as long as can be, and so on; in the piece's case."""
    low, came_from = piece.lower(), {0: 0}
    for end in range(2, len(low) + 1):
        for start in range(max(0, end - longest), end - 1):
            if start in came_from and low[start:end] in allowed:
                came_from[end] = start
                break
    at, found = len(low), []
    if at not in came_from:
        return None
    while at:
        found.append(low[came_from[at] : at])
        at = came_from[at]
    found.reverse()
    if len(found) == 1:
        return [piece]
    if piece.isupper():
        return [w.upper() for w in found]
    return [found[0].capitalize() if piece[0].isupper() else found[0], *found[1:]]


def fixed_token(token: str, allowed: Container[str], longest: int) -> str | None:
    """What a token of joined words stands for, or None: it stays.

    PART and a Roman numeral part. Else each camel piece must be made of allowed words entirely; if the
    token as it is can't be, a leading A before a small letter may be the article. Nothing is guessed.
    """
    if m := _PART.fullmatch(token):
        return f"PART {m[1]}"

    def whole(text: str) -> str | None:
        pieces = [_words(p, allowed, longest) for p in _CAMEL.split(text)]
        return None if None in pieces else " ".join(w for p in pieces for w in p)

    found = whole(token)
    if found and " " in found:
        return found
    if len(token) > LEAST_LETTERS and token[0] == "A" and token[1].islower() and (found := whole(token[1:])):
        return f"A {found}"
    return None


def segment_words(words: DataFrame, allowed: DataFrame | set[str], least: int = LEAST_LETTERS) -> DataFrame:
    """token, fixed: distinct tokens of at least `least` letters that fixed_token() parts; others aren't listed.

    allowed: a table of word, or a set of them. Words are looked up once each, whatever their number of
    occurrences. A list whose bytes pass the check is a set in every task; beyond, each token's parts are
    looked up in the table, up to the longest listed word, and the token meets those that it has.
    """
    if isinstance(allowed, set):
        allowed = words.sparkSession.createDataFrame([(w,) for w in sorted(allowed)], "word string")
    known = written(allowed.select(F.lower("word").alias("part")).where("length(part) > 1").distinct(), "allowed")
    tokens = words.select("token").where(F.length("token") >= least).distinct()
    longest = known.agg(F.max(F.length("part"))).first()[0] or 0
    few = bytes_of(known) <= MOST_BYTES // 4  # a Python set takes some four times the bytes
    if few:
        listed = words.sparkSession.sparkContext.broadcast(frozenset(r["part"] for r in known.collect()))
        own = tokens.withColumn("parts", F.lit(None).cast("array<string>"))
    else:
        low = F.lower("token")
        spans = tokens.select("token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("at")).select("token", "at", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), F.length("token") - F.col("at") + 1))).alias("n"))
        met = spans.select("token", F.substr(low, F.col("at"), F.col("n")).alias("part")).join(known, "part", "left_semi")
        own = tokens.where(F.col("token").rlike("^PART[IVX]+$")).withColumn("parts", F.array().cast("array<string>")).unionByName(met.groupBy("token").agg(F.collect_set("part").alias("parts")))  # a token's own parts: bounded by its letters
        own = own.groupBy("token").agg(F.flatten(F.collect_list("parts")).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            parts = [listed.value] * len(x) if few else map(frozenset, x["parts"])
            x = x.assign(fixed=[None if w.lower() in have else fixed_token(w, have, longest) for w, have in zip(x["token"], parts, strict=True)])
            yield x.loc[x["fixed"].notna(), ["token", "fixed"]]

    return own.mapInPandas(run, "token string, fixed string")


def repair_joins(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_key, page_ord, body with each changed token replaced, and `edits`, the number of replacements.

    Replaced where the page lies: by all changes, if their bytes pass the check, and no page is shuffled;
    else by the page's own, which its distinct tokens find, and pages are shuffled once, whole.
    """
    pages = pages.select("doc_key", "page_ord", "body")
    changes = written(changes, "changes")
    few = bytes_of(changes) <= MOST_BYTES // 4
    if few:
        all_ = pages.sparkSession.sparkContext.broadcast({r["token"]: r["fixed"] for r in changes.select("token", "fixed").collect()})
        met = pages.withColumn("own", F.lit(None).cast("array<struct<token:string,fixed:string>>"))
    else:
        tokens = pages.select("doc_key", "page_ord", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(_TOKEN.pattern), F.lit(0)))).alias("token"))
        own = tokens.join(changes, "token").groupBy("doc_key", "page_ord").agg(F.collect_list(F.struct("token", "fixed")).alias("own"))
        met = pages.join(own, ["doc_key", "page_ord"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            bodies, edits = [], []
            for body, own in zip(x["body"], x["own"], strict=True):
                change = all_.value if few else {r["token"]: r["fixed"] for r in (own if own is not None else ())}
                made = 0

                def put(m: re.Match, change: dict = change) -> str:
                    nonlocal made
                    made += m[0] in change
                    return change.get(m[0], m[0])

                bodies.append(body if body is None else _TOKEN.sub(put, body))
                edits.append(made)
            yield x.assign(body=bodies, edits=edits)[["doc_key", "page_ord", "body", "edits"]]

    kinds = dict(pages.dtypes)
    return met.mapInPandas(run, f"doc_key {kinds['doc_key']}, page_ord {kinds['page_ord']}, body string, edits long")
