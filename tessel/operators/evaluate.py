"""Evaluation of retrieval: recall, strict recall, ranks, refusals, comparison of arms, gates."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import small


def unverifiable(expected: DataFrame, refs: DataFrame) -> DataFrame:
    """Expected (query_id, collection, num) that no chunk's reference has."""
    return expected.join(refs.select("collection", "num").distinct(), ["collection", "num"], "left_anti")


def recall(expected: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n_expected, n_found, recall (null where nothing is expected). hits: query_id, collection, num."""
    found = hits.select("query_id", "collection", "num").distinct().withColumn("hit", F.lit(1))
    by = expected.distinct().join(found, ["query_id", "collection", "num"], "left").groupBy("query_id").agg(F.count("*").alias("n_expected"), F.count("hit").alias("n_found"))
    zero = F.lit(0).cast("long")
    return queries.select("query_id").join(by, "query_id", "left").select("query_id", F.coalesce("n_expected", zero).alias("n_expected"), F.coalesce("n_found", zero).alias("n_found"), F.round(F.col("n_found") / F.col("n_expected"), 6).alias("recall"))


def recall_curve(expected: DataFrame, hits: DataFrame, depths: list[int]) -> DataFrame:
    """query_id and r<depth> for each depth: recall on prefixes of one ranking (hits with rank)."""
    pairs = expected.distinct().join(hits.groupBy("query_id", "collection", "num").agg(F.min("rank").alias("rank")), ["query_id", "collection", "num"], "left")
    return pairs.groupBy("query_id").agg(*(F.round(F.avg(F.coalesce((F.col("rank") <= d).cast("double"), F.lit(0.0))), 6).alias(f"r{d}") for d in depths))


def _covered(group: pd.DataFrame) -> pd.DataFrame:
    """Rank of each hit that lets one more pair be covered, in order of rank.

    Hits come one at a time. A new hit covers a free pair, or takes a pair whose hit can move on to another,
    and so on: a search by breadth from the hit, over pairs that it hasn't seen. If none is free now, the
    pairs seen are covered by hits that no later one can move, and the hit counts for nothing.
    """
    of_pair: dict[int, int] = {}
    grew: list[int] = []
    ranked = group.dropna(subset=["rank"]).sort_values(["rank", "pair"])
    reach = {int(r): x["pair"].tolist() for r, x in ranked.groupby("rank", sort=True)}
    for rank in reach:
        came_from: dict[int, int] = {}  # pair -> the hit that reached it
        turn, free = deque([rank]), None
        while turn and free is None:
            hit = turn.popleft()
            for pair in reach[hit]:
                if pair not in came_from:
                    came_from[pair] = hit
                    if pair not in of_pair:
                        free = pair
                        break
                    turn.append(of_pair[pair])
        if free is None:
            continue
        grew.append(rank)
        while free is not None:  # each hit on the way moves to the pair that it reached
            hit = came_from[free]
            left = next((p for p, h in of_pair.items() if h == hit), None)
            of_pair[free] = hit
            free = left
    return pd.DataFrame({"query_id": [group["query_id"].iloc[0]] * len(grew), "rank": pd.Series(grew, dtype="int64")})


def strict_growth(covers: DataFrame) -> DataFrame:
    """query_id, rank: the hits that raise the number of expected pairs with a hit of their own; up to any depth, their count is the strict value.

    covers: query_id, pair, rank (null: no hit covers the pair), one row for each hit of the ranking and pair that it covers.
    """
    kind = dict(covers.dtypes)["query_id"]
    return covers.select("query_id", F.col("pair").cast("long").alias("pair"), F.col("rank").cast("long").alias("rank")).groupBy("query_id").applyInPandas(_covered, f"query_id {kind}, rank long")


def strict_matched(covers: DataFrame) -> DataFrame:
    """query_id, matched: the most expected pairs that can each have a hit of their own. covers: query_id, pair, hit (null: none)."""
    grown = strict_growth(covers.withColumnRenamed("hit", "rank")).groupBy("query_id").agg(F.count("*").alias("matched"))
    return covers.select("query_id").distinct().join(grown, "query_id", "left").na.fill(0, ["matched"])


def strict_curve(covers: DataFrame, depths: list[int]) -> DataFrame:
    """query_id and s<depth>: the share of a query's expected pairs that can each have a hit of their own among the first hits."""
    pairs = covers.groupBy("query_id").agg(F.count_distinct("pair").alias("n_pairs"))
    counts = strict_growth(covers).groupBy("query_id").agg(*(F.count_if(F.col("rank") <= d).alias(f"s{d}") for d in depths))
    met = pairs.join(counts, "query_id", "left")
    return met.select("query_id", *(F.round(F.coalesce(F.col(f"s{d}"), F.lit(0)) / F.col("n_pairs"), 6).alias(f"s{d}") for d in depths))


def first_ranks(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, first_rank (null: not found), rr, found."""
    met = hits.join(expected.distinct(), ["query_id", "collection", "num"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id").distinct().join(met, "query_id", "left").select("query_id", "first_rank", F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr"), F.col("first_rank").isNotNull().alias("found"))


def shown_metrics(shown: DataFrame, first: DataFrame, expected: DataFrame, strict: DataFrame) -> DataFrame:
    """query_id, shown, few (2 or less), rr_shown, hit3, strict3 of what is shown (query_id, collection, num, rank); first: of first_ranks."""
    by = shown.join(first.select("query_id", "first_rank"), "query_id", "left").groupBy("query_id").agg(F.count("*").alias("shown"), (F.count("*") <= 2).alias("few"), F.round(F.coalesce(F.max(F.when(F.col("first_rank") == F.col("rank"), 1 / F.col("rank"))), F.lit(0.0)), 6).alias("rr_shown"))
    met = shown.where("rank <= 3").join(expected, ["query_id", "collection", "num"], "left_semi").select("query_id").distinct().withColumn("hit3", F.lit(True))
    out = by.join(met, "query_id", "left").join(strict.select("query_id", F.col("s3").alias("strict3")), "query_id", "left")
    return out.withColumn("hit3", F.coalesce("hit3", F.lit(False)))


def upper_median(values: str) -> Column:
    """The upper middle element of the values that aren't null."""
    return F.expr(f"percentile_disc(0.5) within group (order by {values} desc)").cast("int")  # counts by value, no list of all


def grouped_means(metrics: DataFrame, sets: list[str], columns: list[str]) -> DataFrame:
    """Means by set and by (set, class), nulls left out; `class` is null on the rows for a whole set."""
    aggs = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in columns]
    return metrics.rollup(*sets).agg(*aggs, F.count("*").alias("n")).where(F.col(sets[0]).isNotNull())


def refusal_errors(refusals: DataFrame, gates: DataFrame) -> DataFrame:
    """gate, n, n_wrong, rate, offenders: answers that should be refused and refusals that should be answers."""
    wrong = F.col("refused") != (F.col("gate") == "refuse")
    return refusals.join(gates, "query_id").groupBy("gate").agg(F.count("*").alias("n"), F.sum(wrong.cast("long")).alias("n_wrong"), F.round(F.avg(wrong.cast("double")), 6).alias("rate"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wrong, F.col("query_id")))), lambda x: x.cast("string")), ",").alias("offenders"))


def compared(arms: DataFrame, base: str, other: str, metric: str) -> DataFrame:
    """One row: queries that went up, down or stayed from one arm to the other, and the mean difference. arms: arm, query_id, metric."""
    both = arms.groupBy("query_id").pivot("arm", [base, other]).agg(F.first(metric))
    d = F.coalesce(F.col(f"`{other}`"), F.lit(0.0)) - F.coalesce(F.col(f"`{base}`"), F.lit(0.0))
    return both.agg(F.sum((d > 0).cast("long")).alias("up"), F.sum((d < 0).cast("long")).alias("down"), F.sum((d == 0).cast("long")).alias("tie"), F.round(F.avg(d), 6).alias("delta"))


def signatures(hits: DataFrame) -> DataFrame:
    """arm, query_id, signature of the set of hits, whatever their order."""
    return hits.groupBy("arm", "query_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("chunk_ord")), lambda x: x.cast("string")), ","), 256).alias("signature"))


def invariance_breaks(shown: DataFrame, pool: DataFrame, floor: float) -> DataFrame:
    """query_id where some shown hit reaches the floor but the best of the pool doesn't, or the reverse."""
    a = shown.groupBy("query_id").agg((F.max("score") >= floor).alias("shown_ok"))
    b = pool.groupBy("query_id").agg((F.max("score") >= floor).alias("pool_ok"))
    return a.join(b, "query_id", "full").where(F.coalesce("shown_ok", F.lit(False)) != F.coalesce("pool_ok", F.lit(False)))


def version_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, n_lost, n_gained, n_kept: references (query_id, collection, num) that only the one, only the other, or both versions show."""
    key = ["query_id", "collection", "num"]
    both = before.select(*key).distinct().withColumn("b", F.lit(1)).join(after.select(*key).distinct().withColumn("a", F.lit(1)), key, "full")
    b, a = F.col("b").isNotNull(), F.col("a").isNotNull()
    return both.groupBy("query_id").agg(F.count_if(b & ~a).alias("n_lost"), F.count_if(a & ~b).alias("n_gained"), F.count_if(a & b).alias("n_kept"))


def calibration(tops: DataFrame) -> DataFrame:
    """One row: the weakest top score of queries within the corpus, the strongest without, and whether the band is inverted."""
    inside, outside = F.when(F.col("gate") == "answer", F.col("top")), F.when(F.col("gate") == "refuse", F.col("top"))
    return tops.agg(F.min(inside).alias("weakest_in"), F.max(outside).alias("strongest_off")).withColumn("inverted", F.col("weakest_in") < F.col("strongest_off"))


def guard(metrics: DataFrame, baselines: DataFrame, epsilon: float = 0.005, strict: bool = True) -> DataFrame:
    """name, value, baseline, ok: strict fails on the first metric under its baseline or without one."""
    out = metrics.join(baselines, "name", "left").withColumn("ok", F.coalesce(F.col("value") >= F.col("baseline") - epsilon, F.lit(False)))
    return out.where(F.assert_true(F.col("ok"), F.concat(F.lit("under its baseline: "), F.col("name"))).isNull()) if strict else out


def shape(chunks: DataFrame, by: str, ref: str, cap: int) -> DataFrame:
    """Chunks, share uncitable and packed, least, upper median and greatest length, number over the cap."""
    n = F.length("text")
    nums = F.size(F.regexp_extract_all(ref, F.lit("[0-9]+"), F.lit(0)))
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    sized = chunks.withColumn("len", n)
    return sized.groupBy(by).agg(F.count("*").alias("n"), pct(nums == 0).alias("uncitable_pct"), pct(nums > 1).alias("packed_pct"), F.min("len").alias("min_len"), upper_median("len").alias("median_len"), F.max("len").alias("max_len"), F.sum((F.col("len") > cap).cast("long")).alias("over_cap"))


def length_histogram(chunks: DataFrame, by: str, cap: int, bins: int = 5) -> DataFrame:
    """by, bucket (0 to bins - 1 up to the cap, `bins` beyond), n."""
    b = F.when(F.length("text") > cap, bins).otherwise(F.least(F.floor((F.length("text") - 1) * bins / cap), F.lit(bins - 1))).cast("int")
    return chunks.groupBy(by, b.alias("bucket")).agg(F.count("*").alias("n"))


def coverage(texts: DataFrame, sources: DataFrame, shingle: Column, agree: float = 0.85, large: float = 0.55) -> DataFrame:
    """id, share of the text's shingles that stand in another source, verdict. sources: shingles as `sh`."""
    own = texts.select("id", F.explode(shingle).alias("sh"))
    wanted = sources.select("sh").join(own.select("sh").distinct(), "sh", "left_semi")  # before anything is shuffled, where the texts are few
    met = own.join(wanted.distinct().withColumn("there", F.lit(1)), "sh", "left").groupBy("id").agg(F.round(F.count("there") / F.count("*"), 6).alias("share"))
    return met.withColumn("verdict", F.when(F.col("share") >= agree, "agree").when(F.col("share") < large, "large").otherwise("partial"))


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """name, collection, value, most, gated, ok: a gated metric over its limit isn't."""
    return metrics.join(small(limits), ["name", "collection"]).withColumn("ok", ~F.col("gated") | (F.col("value") <= F.col("most")))


def pin_differences(metrics: DataFrame, pins: DataFrame) -> DataFrame:
    """Metrics that differ from their pins, or stand on one side only."""
    return metrics.join(pins.withColumnRenamed("value", "pinned"), "name", "full").where(~F.col("value").eqNullSafe(F.col("pinned")))
