"""Routing of a table of queries by weighted cues, slots, greetings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

GREETINGS = ["hi", "hello", "hey", "good", "morning", "afternoon", "evening"]
DAY_PARTS = ["morning", "afternoon", "evening"]
NO_CUES = {"legal": [], "intent": [], "entity": []}


def cue_score(text: Column, cues: list[str]) -> Column:
    """Sum of the weights of the cues (regular expressions) that occur: 2 with a space, else 1.

    Presence counts, not frequency. A cue with a space blanks its first match before the single-word cues are tried.
    """
    masked, total = text, F.lit(0)
    for cue in (c for c in cues if " " in c):
        at = F.regexp_instr(masked, F.lit(f"(?i){cue}"))
        hit = F.regexp_extract(masked, f"(?i)({cue})", 1)
        total = total + F.when(at > 0, 2).otherwise(0)
        masked = F.when(at > 0, F.overlay(masked, F.repeat(F.lit(" "), F.length(hit)), at, F.length(hit))).otherwise(masked)
    for cue in (c for c in cues if " " not in c):
        total = total + masked.rlike(f"(?i){cue}").cast("int")
    return total


def scores(queries: DataFrame, cues: dict[str, list[str]], text: str = "text") -> DataFrame:
    """queries with legal, help (0 without an intent cue) and help_raw."""
    intent, entity = cue_score(F.col(text), cues["intent"]), cue_score(F.col(text), cues["entity"])
    scored = queries.withColumn("legal", cue_score(F.col(text), cues["legal"])).withColumn("intent", intent).withColumn("help_raw", F.col("intent") + entity)
    return scored.withColumn("help", F.when(F.col("intent") > 0, F.col("help_raw")).otherwise(0)).drop("intent")


def routed(scored: DataFrame, singletons: list[str] = (), text: str = "text") -> DataFrame:
    """scored with primary (legal, help, clarify) and secondary: ties, no signal and lone content-free words clarify."""
    words = tokens(F.col(text))
    clarify = ((F.size(words) == 1) & words[0].isin(*singletons) if singletons else F.lit(False)) | (F.col("legal") == F.col("help"))
    first = F.when(clarify, "clarify").when(F.col("legal") > F.col("help"), "legal").otherwise("help")
    other = F.when(~clarify & (F.col("legal") > 0) & (F.col("help") > 0), F.when(F.col("legal") > F.col("help"), "help").otherwise("legal"))
    return scored.withColumn("primary", first).withColumn("secondary", other)


def is_greeting(text: Column, words: list[str] = GREETINGS, day_parts: list[str] = DAY_PARTS) -> Column:
    """Only greeting words, and 'good' only with a part of the day."""
    got = tokens(text)
    whole = (F.size(got) > 0) & F.forall(got, lambda w: w.isin(*words))
    return whole & (~F.array_contains(got, "good") | F.exists(got, lambda w: w.isin(*day_parts)))


def first_slot(text: Column, scan: list[tuple[str, str]], whole_words: bool = False) -> Column:
    """The value of the first entry (key, value) of the list that occurs in the lower-cased text; '' if none does."""
    low = F.lower(text)
    hits = [F.when(low.rlike(rf"\b{key}\b") if whole_words else low.contains(key), value) for key, value in scan]
    return F.coalesce(*hits, F.lit(""))


def effective_mode(routed_: DataFrame, override: str | None = None, text: str = "text") -> DataFrame:
    """routed with mode: greeting, else the override where there is one, else the route."""
    own = F.coalesce(F.col(override), F.col("primary")) if override else F.col("primary")
    return routed_.withColumn("mode", F.when(is_greeting(F.col(text)), "greeting").otherwise(own))


def dispatch(routed_: DataFrame, key: str = "query_id") -> DataFrame:
    """key, branch: the work that each row needs; rows with two routes go both ways."""
    pairs = F.explode(F.array_compact(F.array(F.when(F.col("primary") != "clarify", F.col("primary")), F.col("secondary"))))
    return routed_.select(key, pairs.alias("branch"))
