"""Query expansion by synonyms and by a bridge from words that the corpus lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem, tokens
from ..sources.scratch import written
from . import vectors
from .sizes import small

MOST_TERMS, NEAREST, LEAST_COSINE = 4, 2, 0.55


def surface_forms(text: Column) -> Column:
    """Distinct raw tokens, stems, singulars in -es after a sibilant, and singulars in -s."""
    raw = tokens(text)
    sibilant = F.filter(raw, lambda w: w.rlike("(s|x|z|ch|sh)es$"))
    es = F.transform(sibilant, lambda w: F.substr(w, F.lit(1), F.length(w) - 2))
    s = F.transform(F.filter(raw, lambda w: w.endswith("s") & (F.length(w) > 2)), lambda w: F.substr(w, F.lit(1), F.length(w) - 1))
    return F.array_distinct(F.concat(raw, F.transform(raw, stem), es, s))


def synonym_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query_id, terms: of keys that a query has (phrases as substrings, words by a form), in order of keys, each once.

    synonyms: key, is_phrase, terms (array), key_ord; the small side.
    """
    low = F.array_join(tokens(F.col("text")), " ")
    q = queries.select("query_id", low.alias("low"))
    phrases = q.join(small(synonyms.where("is_phrase")), F.col("low").contains(F.col("key"))).select("query_id", "key_ord", "terms")
    forms = queries.select("query_id", F.explode(surface_forms(F.col("text"))).alias("form"))
    words = forms.join(small(synonyms.where("not is_phrase")), (F.col("form") == F.col("key")) | (F.col("form") == stem(F.col("key")))).select("query_id", "key_ord", "terms").distinct()
    both = phrases.withColumn("part", F.lit(0)).unionByName(words.withColumn("part", F.lit(1)))
    by = both.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", "key_ord", "terms"))).alias("xs"))
    return by.select("query_id", F.array_distinct(F.flatten(F.transform("xs", lambda x: x["terms"]))).alias("terms"))


def expanded(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, text: the query and its terms behind it."""
    met = queries.select("query_id", "text").join(terms, "query_id", "left")
    return met.select("query_id", F.when(F.size(F.coalesce("terms", F.array().cast("array<string>"))) > 0, F.concat_ws(" ", "text", F.array_join("terms", " "))).otherwise(F.col("text")).alias("text"))


def bridged(queries: DataFrame, bridge: DataFrame, owned: list[str] = ()) -> DataFrame:
    """query_id, text, ns: neighbours of tokens (or of their form without -s), in order, each once.

    bridge: word, neighbours (array); of its words, which grow with a corpus, only those that a query names are broadcast.
    owned: words that the synonyms have, which are skipped in any form.
    """
    own = lambda w: w.isin(*owned) | stem(w).isin(*owned) | F.substr(w, F.lit(1), F.length(w) - 1).isin(*owned) if owned else F.lit(False)
    tok = queries.select("query_id", "text", F.posexplode(tokens(F.col("text"))).alias("i", "tok")).where(~own(F.col("tok")))
    single = F.when(F.col("tok").endswith("s"), F.substr(F.col("tok"), F.lit(1), F.length("tok") - 1))
    asked = tok.select(F.explode(F.array_compact(F.array("tok", single))).alias("word")).distinct()
    own = small(written(bridge.join(small(asked), "word", "left_semi"), "bridge-asked"))
    plain = own.select(F.col("word").alias("tok"), F.col("neighbours").alias("a"))
    short = own.select(F.concat("word", F.lit("s")).alias("tok"), F.col("neighbours").alias("b"))
    met = tok.join(plain, "tok", "left").join(short, "tok", "left").select("query_id", "text", "i", F.coalesce("a", "b").alias("ns")).where("ns is not null")
    by = met.groupBy("query_id", "text").agg(F.array_sort(F.collect_list(F.struct("i", "ns"))).alias("xs"))
    return by.select("query_id", "text", F.array_distinct(F.flatten(F.transform("xs", lambda x: x["ns"]))).alias("ns"))


def capped(terms: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """query_id, terms: the first `most` of bridged(), without words that the query has."""
    return terms.select("query_id", F.array_except(F.slice("ns", 1, most), F.split(F.lower("text"), r"\s+")).alias("terms"))


def bridge_terms(queries: DataFrame, bridge: DataFrame, owned: list[str] = (), most: int = MOST_TERMS) -> DataFrame:
    """query_id, terms: capped() of bridged()."""
    return capped(bridged(queries, bridge, owned), most)


def key_collisions(synonyms: DataFrame) -> DataFrame:
    """stem, n of word keys with one stem."""
    return synonyms.where("not is_phrase").groupBy(stem(F.col("key")).alias("stem")).agg(F.count("*").alias("n")).where("n > 1")


def nearest(keys: DataFrame, targets: DataFrame, k: int = NEAREST, least: float = LEAST_COSINE) -> DataFrame:
    """word, target, cosine, rank: the k nearest targets of each key. Both: word, v (array)."""
    return vectors.nearest(keys, targets, k, least)


def unreached(queries: DataFrame, vocab: DataFrame, bridge: DataFrame) -> DataFrame:
    """query_id, n_absent, n_unbridged: distinct tokens that the vocabulary lacks, and those of them without a bridge."""
    tok = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("tok"))
    absent = tok.join(vocab.select(F.col("term").alias("tok")).distinct(), "tok", "left_anti").join(bridge.select(F.col("word").alias("tok"), F.lit(1).alias("has")), "tok", "left")
    by = absent.groupBy("query_id").agg(F.count("*").alias("n_absent"), F.sum(F.col("has").isNull().cast("long")).alias("n_unbridged"))
    return queries.select("query_id").join(by, "query_id", "left").na.fill(0)
