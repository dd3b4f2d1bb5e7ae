"""Pairs of similar strings by an equi-join: prefix filter on character grams, bounds on lengths, exact similarity of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .dedupe import ratio


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


#: Similarity by name: exact measure, least common grams and least partner's length of a string of n characters at a limit t.
#: levenshtein: at most (1 - t) * m edits on the longer one's m characters, each of which takes two padded
#: bigrams away. ratio: 2 * matched / (n + m) >= t, and what is matched is common to both as letters.
METHODS = {
    "levenshtein": (levenshtein_ratio, lambda n, t: 1 + (2 * t - 1) * n, lambda n, t: t * n),
    "ratio": (ratio, lambda n, t: t / (2 - t) * n, lambda n, t: t / (2 - t) * n),
}
_SLACK = 1e-4  # the limit is held against a similarity rounded to six digits


def grams(word: Column, method: str) -> Column:
    """Padded bigrams, or letters; an n-th occurrence is a gram of its own, so that sets count as multisets do."""
    padded = F.concat(F.lit("\x01"), word, F.lit("\x02"))
    one = F.split(word, "") if method == "ratio" else F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(2)))
    return F.transform(one, lambda g, i: F.concat(g, F.size(F.filter(F.slice(one, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def similar_pairs(left: DataFrame, right: DataFrame, least: float, method: str = "ratio") -> DataFrame:
    """a, b, score (six digits) of all pairs of score `least` or more. left: a, right: b, distinct strings that aren't empty.

    Grams are ordered from rare to common, and a string keeps those before its last c - 1, c being the
    least number it shares with any partner; so two similar strings meet under a gram that is rare for
    both. Needs least > 0.5 for 'levenshtein'.
    """
    measure, common, shortest = METHODS[method]
    if method == "levenshtein" and least <= 0.5:
        raise ValueError("the filter needs a limit over 0.5")
    both = left.select(F.col("a").alias("w"), F.lit(True).alias("is_left")).unionByName(right.select(F.col("b").alias("w"), F.lit(False).alias("is_left")))
    each = both.select("w", "is_left", F.length("w").alias("n"), F.posexplode(grams(F.col("w"), method)).alias("i", "g"))
    spread = each.groupBy("g").agg(F.count("*").alias("spread"))
    rarity = Window.partitionBy("w", "is_left")
    ranked = each.join(spread, "g").withColumn("place", F.row_number().over(rarity.orderBy("spread", "g"))).withColumn("m", F.count("*").over(rarity))
    prefix = F.col("m") - F.greatest(F.ceil(common(F.col("n"), least) - _SLACK), F.lit(1)) + 1
    kept = written(ranked.where(F.col("place") <= prefix).select("w", "is_left", "n", "g"), "grams")
    side = lambda is_left, w, n: kept.where(F.col("is_left") == is_left).select("g", F.col("w").alias(w), F.col("n").alias(n))
    near = F.least("na", "nb") >= shortest(F.greatest("na", "nb"), least) - _SLACK
    met = side(True, "a", "na").join(side(False, "b", "nb"), "g").where(near).select("a", "b").distinct()
    return written(met.withColumn("score", F.round(measure(F.col("a"), F.col("b")), 6)).where(F.col("score") >= least), "similar")
