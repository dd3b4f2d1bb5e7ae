"""Comparison of arms: the same queries asked in several ways."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expand import expanded


def expansion_arms(queries: DataFrame, terms: dict[str, DataFrame | None]) -> DataFrame:
    """arm, query_id, text: each query under each arm, with that arm's terms (query_id, terms) behind it; None adds none."""
    each = (queries.select(F.lit(arm).alias("arm"), "query_id", "text") if t is None else expanded(queries, t).select(F.lit(arm).alias("arm"), "query_id", "text") for arm, t in terms.items())
    return reduce(DataFrame.unionByName, each)


def asked(arms: DataFrame) -> DataFrame:
    """query_id, text, for one batch of retrieval over all arms; ids are arm/query_id."""
    return arms.select(F.concat_ws("/", "arm", "query_id").alias("query_id"), "text")


def profiles(arms: DataFrame, hits: DataFrame, floor: float) -> DataFrame:
    """arm, query_id, n, top (0 without a hit), refused. hits: of asked()."""
    by = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    named = arms.select("arm", F.col("query_id").alias("of"), F.concat_ws("/", "arm", "query_id").alias("query_id"))
    top = F.coalesce("top", F.lit(0.0))
    return named.join(by, "query_id", "left").select("arm", F.col("of").alias("query_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), top.alias("top"), (top < floor).alias("refused"))


def flips(profile: DataFrame, base: str) -> DataFrame:
    """arm, n, kept (same verdict as under base), opened (refused under base alone), closed (refused under arm alone), mean_delta of tops."""
    b = profile.where(F.col("arm") == base).select("query_id", F.col("top").alias("b_top"), F.col("refused").alias("b_refused"))
    met = profile.where(F.col("arm") != base).join(b, "query_id")
    count = lambda c: F.sum(c.cast("long"))
    return met.groupBy("arm").agg(
        F.count("*").alias("n"),
        count(F.col("refused") == F.col("b_refused")).alias("kept"),
        count(F.col("b_refused") & ~F.col("refused")).alias("opened"),
        count(~F.col("b_refused") & F.col("refused")).alias("closed"),
        F.round(F.avg(F.col("top") - F.col("b_top")), 6).alias("mean_delta"),
    )


def compared(queries: DataFrame, hits: DataFrame, expected: DataFrame, terms: DataFrame, base: str, other: str) -> DataFrame:
    """One row: queries whose recall went up, down or stayed from one arm to the other, the mean difference, queries that got terms (fired), those terms, and queries whose set of hits changed.

    hits: of asked() for both arms; expected: query_id, collection, num; terms: query_id, terms of the other arm.
    """
    of = hits.select(F.split_part("query_id", F.lit("/"), F.lit(1)).alias("arm"), F.split_part("query_id", F.lit("/"), F.lit(2)).cast("long").alias("query_id"), "collection", "chunk_ord")
    pairs = of.select("arm", "query_id", "collection", F.expr("chunk_ord div 100000").alias("num")).distinct().join(expected, ["query_id", "collection", "num"], "left_semi")
    found = pairs.groupBy("query_id").agg(*(F.count_if(F.col("arm") == arm).alias(c) for arm, c in ((base, "b"), (other, "o"))))
    wanted = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    # a set is told by the sum of its members' hashes, which is the same in any order and needs no list
    sets = of.groupBy("query_id").agg(*(F.sum(F.when(F.col("arm") == arm, F.xxhash64("collection", "chunk_ord").cast("decimal(38,0)"))).alias(c) for arm, c in ((base, "bs"), (other, "os"))))
    met = queries.select("query_id").join(wanted, "query_id", "left").join(found, "query_id", "left").join(sets, "query_id", "left").join(terms.select("query_id", F.size("terms").alias("k")), "query_id", "left").na.fill(0, ["b", "o", "k"])
    share = lambda c: F.coalesce(F.round(F.col(c) / F.col("n"), 6), F.lit(0.0))
    d = share("o") - share("b")
    return met.agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("tie"), F.round(F.avg(d), 6).alias("delta"), F.count_if(F.col("k") > 0).alias("fired"), F.sum("k").cast("long").alias("n_terms"), F.count_if(~F.col("bs").eqNullSafe(F.col("os"))).alias("changed"))


def top_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, before, after, delta of the best score (0 without a hit). Both: query_id, score."""
    best = lambda hits, name: hits.groupBy("query_id").agg(F.max("score").alias(name))
    zero = F.lit(0.0)
    both = best(before, "b").join(best(after, "a"), "query_id", "full")
    return both.select("query_id", F.coalesce("b", zero).alias("before"), F.coalesce("a", zero).alias("after"), F.round(F.coalesce("a", zero) - F.coalesce("b", zero), 6).alias("delta"))


def induced_refusals(tops: DataFrame, base: str, other: str, floor: float) -> DataFrame:
    """turn_id, base, other: turns that the base arm answers and the other refuses, with the best scores of both (0 without a hit). tops: turn_id, arm, top."""
    by = tops.groupBy("turn_id").agg(*(F.coalesce(F.max(F.when(F.col("arm") == arm, F.col("top"))), F.lit(0.0)).alias(c) for arm, c in ((base, "base"), (other, "other"))))
    return by.where((F.col("base") >= floor) & (F.col("other") < floor))


def slot_accuracy(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """arm, n, right, accuracy: turns whose slot is the wanted one. slots: arm, conv_id, turn, what; wanted: conv_id, turn, want."""
    met = slots.join(wanted, ["conv_id", "turn"])
    ok = F.sum((F.col("what") == F.col("want")).cast("long"))
    return met.groupBy("arm").agg(F.count("*").alias("n"), ok.alias("right"), F.round(ok / F.count("*"), 6).alias("accuracy"))
