"""Tables around an external answering service: prompts, cache keys, citations, outcomes, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG = r"\[([A-Za-z_]+) ([^\]\[]+)\]"


def prompts(queries: DataFrame, excerpts: DataFrame, instruction: str) -> DataFrame:
    """query_id, prompt: instruction, tagged excerpts by rank, question. excerpts: query_id, rank, tag, text."""
    by = excerpts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "tag", "text").alias("x")))).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["x"]), "\n")
    return queries.join(by, "query_id").select("query_id", F.concat_ws("\n\n", F.lit(instruction), body, F.concat(F.lit("Question: "), F.col("text"))).alias("prompt"))


def prompt_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\0"), prompt), 256)


def pending(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts (key) without a stored answer that isn't blank."""
    return wanted.join(answers.where("trim(answer) <> ''").select("key").distinct(), "key", "left_anti")


def replayed(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """wanted with the latest stored answer, and `cached`."""
    last = answers.where("trim(answer) <> ''").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at")))).where("r = 1").select("key", "answer")
    return wanted.join(last, "key", "left").withColumn("cached", F.col("answer").isNotNull())


def citations(answer: Column) -> Column:
    """Tags in order of their place."""
    return F.regexp_extract_all(answer, F.lit(TAG), F.lit(0))


def verified(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """query_id, tag, ok: every number of a tag stands in a retrieved reference of its collection; 'general' passes. refs: query_id, collection, num."""
    tags = answers.select("query_id", F.explode(F.array_distinct(citations(F.col("answer")))).alias("tag"))
    parts = tags.select("query_id", "tag", F.lower(F.regexp_extract("tag", TAG, 1)).alias("collection"), F.regexp_extract("tag", TAG, 2).alias("ref"))
    nums = parts.select("query_id", "tag", "collection", F.explode_outer(F.transform(F.regexp_extract_all("ref", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))).alias("num"))
    met = nums.join(refs.select("query_id", "collection", "num").distinct().withColumn("hit", F.lit(True)), ["query_id", "collection", "num"], "left")
    return met.groupBy("query_id", "tag").agg(F.bool_and(F.col("num").isNull() | F.col("hit").isNotNull()).alias("ok"))


def outcome(top: Column, answer: Column, error: Column, floor: float = 0.1, sentinel: str = "NO ANSWER") -> Column:
    """gate-refused, pending, no-answer-refused or answered."""
    return F.when(F.coalesce(top, F.lit(0.0)) < floor, "gate-refused").when(error.isNotNull() | answer.isNull(), "pending").when(answer.contains(sentinel), "no-answer-refused").otherwise("answered")


def retry_delay(error: Column, attempt: Column) -> Column:
    """struct(kind, delay): per-minute limits wait the hinted seconds and 3 more, or 8 * 2^attempt up to 60; daily ones don't wait."""
    hint = F.regexp_extract(error, r"(?i)retry in ([0-9]+)", 1).try_cast("double")
    kind = F.when(error.rlike("(?i)per ?day|daily"), "daily").when(error.rlike("(?i)per ?minute|rate"), "per-minute").otherwise("other")
    return F.struct(kind.alias("kind"), F.when(kind == "per-minute", F.coalesce(hint + 3, F.least(F.lit(60.0), 8 * F.pow(F.lit(2.0), attempt)))).alias("delay"))


def verdict(raw: Column, schema: str = "verdict string, score int") -> Column:
    """The JSON object of a reply, with or without a code fence; null fields if it isn't one."""
    return F.from_json(F.regexp_extract(F.regexp_replace(raw, "```[a-z]*", ""), r"(?s)(\{.*\})", 1), schema)


def claims(answers: DataFrame) -> DataFrame:
    """query_id, ix, claim, tag: the text before each tag."""
    pieces = F.split("answer", TAG.replace("(", "(?:"), -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(citations(F.col("answer")))), citations(F.col("answer")), lambda c, g: F.struct(F.trim(c).alias("claim"), g.alias("tag")))
    return answers.where(F.size(citations(F.col("answer"))) > 0).select("query_id", F.posexplode(pairs).alias("ix", "x")).select("query_id", "ix", "x.claim", "x.tag")


def word_coverage(question: Column, answer: Column) -> Column:
    """struct(share, missed): distinct words (arrays) of the question that the answer has; null share for no words."""
    return F.struct(F.when(F.size(question) > 0, F.round(F.size(F.array_intersect(question, answer)) / F.size(question), 6)).alias("share"), F.array_except(question, answer).alias("missed"))
