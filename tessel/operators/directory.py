"""Ranked lookup of (category, place) queries in a directory. Strings meet by equi-joins, each distinct one once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .contain import containing
from .order import numbered
from .similar import similar_pairs
from .sizes import small

FUZZY = 0.6


def words(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def violations(directory: DataFrame, placeholders: list[str]) -> DataFrame:
    """pos, name, phone of rows whose phone is empty or a placeholder."""
    bad = F.trim(F.coalesce("phone", F.lit(""))) == ""
    for pattern in placeholders:
        bad = bad | F.col("phone").rlike(pattern)
    return directory.where(bad).select("pos", "name", "phone")


def with_head(head: DataFrame, rows: DataFrame) -> DataFrame:
    """head rows, then the others, numbered by line; of equal (name, phone) the first stays. Both: query_id, ord, name, phone."""
    both = head.withColumn("part", F.lit(0)).unionByName(rows.withColumn("part", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("query_id", "name", "phone").orderBy("part", "ord"))
    return both.withColumn("r", first).where("r = 1").withColumn("line", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "ord"))).drop("r", "part", "ord")


def substring_hits(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """query_id, pos, score, single: focus contains the query; 1.0 for a single focus or its first part, else 0.9."""
    parts = F.filter(F.transform(F.split(F.lower("focus"), "[;/]"), F.trim), lambda x: x != "")
    rows = directory.select("pos", F.lower("focus").alias("low"), (F.size(parts) <= 1).alias("single"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("first"))
    asked = queries.where("trim(category) <> ''").select("query_id", F.lower(F.trim("category")).alias("q"))
    met = contained(asked.select("q").distinct(), rows.select("low").distinct())
    hit = asked.join(small(met), "q").join(rows, "low")
    return hit.select("query_id", "pos", F.when(F.col("single") | F.col("first").contains(F.col("q")), 1.0).otherwise(0.9).alias("score"), "single")


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """q, low: needles (q) and the texts (low) that they stand in."""
    found = containing(needles.select(F.col("q").alias("needle"), F.col("q").alias("what")), texts.select(F.col("low").alias("id"), F.col("low").alias("text")))
    return found.select(F.col("needle").alias("q"), F.col("id").alias("low"))


def fuzzy_hits(queries: DataFrame, directory: DataFrame, stop: list[str] = (), least: float = FUZZY, method: str = "ratio") -> DataFrame:
    """query_id, pos, score, single: the best similarity of a query token and a focus token, from `least` on.

    Each pair of distinct tokens is compared once, if they can be similar at all (see similar_pairs).
    method: 'ratio' (exact, in Python) or 'levenshtein' (in the JVM).
    """
    qt = queries.select("query_id", F.explode(words(F.col("category"))).alias("a"))
    parts = F.filter(F.transform(F.split("focus", "[;/]"), F.trim), lambda x: x != "")
    dt = directory.select("pos", (F.size(parts) <= 1).alias("single"), F.explode(words(F.col("focus"))).alias("b"))
    if stop:
        qt, dt = qt.where(~F.col("a").isin(*stop)), dt.where(~F.col("b").isin(*stop))
    close = small(similar_pairs(qt.select("a").distinct(), dt.select("b").distinct(), least, method))
    return qt.join(close, "a").join(dt, "b").groupBy("query_id", "pos", "single").agg(F.max("score").alias("score")).select("query_id", "pos", "score", "single")


def ranked(queries: DataFrame, directory: DataFrame, stop: list[str] = (), method: str = "ratio") -> DataFrame:
    """query_id, pos, score, single, how, rank: substring hits, or fuzzy ones for queries without any; then score, specialists, place in the file."""
    subs = written(substring_hits(queries, directory).withColumn("how", F.lit("substring")), "substring-hits")
    left = queries.join(subs.select("query_id").distinct(), "query_id", "left_anti")
    both = subs.unionByName(fuzzy_hits(left, directory, stop, method=method).withColumn("how", F.lit("fuzzy")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 3)), F.desc(F.col("single").cast("int")), "pos")
    return both.withColumn("rank", F.row_number().over(w))


def located(queries: DataFrame, directory: DataFrame, method: str = "ratio", least: float = FUZZY) -> DataFrame:
    """query_id, pos, how: rows whose place has the query's as a substring, or is similar ('fuzzy') as a whole or by a pair of tokens."""
    places = queries.select("query_id", F.lower(F.trim("place")).alias("q")).where("q <> ''")
    rows = directory.select("pos", F.lower("location").alias("low"))
    asked, there = places.select("q").distinct(), rows.where("low <> ''").select("low").distinct()
    whole = similar_pairs(asked.withColumnRenamed("q", "a"), there.withColumnRenamed("low", "b"), least, method).select(F.col("a").alias("q"), F.col("b").alias("low"))
    each = lambda df, c, w: df.select(c, F.explode(words(F.col(c))).alias(w))
    qt, lt = each(asked, "q", "a"), each(there, "low", "b")
    close = small(similar_pairs(qt.select("a").distinct(), lt.select("b").distinct(), least, method))
    by_token = qt.join(close, "a").join(lt, "b").select("q", "low")
    met = contained(asked, there).withColumn("way", F.lit(0)).unionByName(whole.unionByName(by_token).withColumn("way", F.lit(1)))
    best = small(written(met.groupBy("q", "low").agg(F.min("way").alias("way")), "places"))
    return places.join(best, "q").join(rows, "low").select("query_id", "pos", F.when(F.col("way") == 0, "substring").otherwise("fuzzy").alias("how"))


def lookup(queries: DataFrame, directory: DataFrame, fallback: int, k: int = 5, stop: list[str] = (), method: str = "ratio") -> DataFrame:
    """query_id, pos, rank, note: the k best rows for a category and a place.

    A place that matches nothing keeps the ranking by category; a query that matches no row gets the fallback row.
    A query without a category takes the rows of its place in order of the file, or the first k.
    """
    place = written(located(queries, directory, method).select("query_id", "pos"), "located").withColumn("there", F.lit(1))
    by_category = written(ranked(queries, directory, stop, method).select("query_id", "pos", "rank"), "ranked")
    free = queries.where("trim(category) = ''")
    of_place = place.join(free, "query_id", "left_semi").select("query_id", "pos", F.col("pos").cast("int").alias("rank"))
    first = [r["pos"] for r in directory.select("pos").orderBy("pos").limit(k).collect()]  # k numbers
    anywhere = free.where("trim(place) = ''").select("query_id", F.explode(F.array(*map(F.lit, first)).cast("array<bigint>")).alias("pos")).withColumn("rank", F.col("pos").cast("int"))
    found = by_category.unionByName(of_place).unionByName(anywhere)
    met = found.join(place, ["query_id", "pos"], "left")
    w = Window.partitionBy("query_id")
    met = met.withColumn("any", F.max("there").over(w)).join(queries.select("query_id", "category", "place"), "query_id")
    filtered = met.where("trim(place) = '' or there = 1 or (any is null and trim(category) <> '')")
    note = F.when(F.trim("place") == "", "no place").when(F.col("any") == 1, "place matched").otherwise("place ignored")
    out = filtered.withColumn("rank", F.row_number().over(w.orderBy("rank", "pos"))).where(F.col("rank") <= k).select("query_id", "pos", "rank", note.alias("note"))
    out = written(out, "lookup")
    none = queries.join(out.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(fallback).cast("long").alias("pos"), F.lit(1).alias("rank"), F.lit("fallback").alias("note"))
    return out.unionByName(none)


def labels_of(text: Column, table: dict[str, list[str]], wildcard: str | None = None, whole_words: bool = False) -> Column:
    """Labels of which a key occurs in the text, in the table's order; ['*'] if the wildcard does."""
    low = F.lower(text)
    has = lambda k: low.rlike(rf"\b{k}\b") if whole_words else low.contains(k)
    found = F.array_compact(F.array(*(F.when(F.array_contains(F.array(*map(has, keys)), True), label) for label, keys in table.items())))
    return F.when(low.contains(wildcard), F.array(F.lit("*"))).otherwise(found) if wildcard else found


def faceted(directory: DataFrame, kind: str = "", place: str = "") -> DataFrame:
    """Rows whose types and places (arrays) have the wanted ones or '*', exact ones first: with `rank`."""
    fits = lambda c, v: F.array_contains(c, v) | F.array_contains(c, "*") if v else F.lit(True)
    miss = lambda c, v: (~F.array_contains(c, v)).cast("int") if v else F.lit(0)
    kept = directory.where(fits("types", kind) & fits("places", place)).withColumn("miss", miss("types", kind) + miss("places", place))
    return numbered(kept, "miss", "pos")


def full_list(ranking: DataFrame, queries: DataFrame, directory: DataFrame) -> DataFrame:
    """query_id, pos, line: ranked rows, then all others in order of the file."""
    rest = queries.select("query_id").join(small(directory.select("pos")), F.lit(True)).join(ranking.select("query_id", "pos"), ["query_id", "pos"], "left_anti")
    both = ranking.select("query_id", "pos", F.lit(0).alias("part"), F.col("rank").cast("long").alias("o")).unionAll(rest.select("query_id", "pos", F.lit(1), F.col("pos").cast("long")))
    return both.select("query_id", "pos", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "o")).alias("line"))


def verified(directory: DataFrame, crawled: DataFrame) -> DataFrame:
    """pos, ok: the phone's last ten digits stand among the digits of the crawled page of the row's url."""
    digits = F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10))
    met = directory.withColumn("want", digits).join(crawled.select("url", F.regexp_replace("html", "[^0-9]", "").alias("have")), "url", "left")
    return met.groupBy("pos").agg(F.max(F.coalesce(F.col("have").contains(F.col("want")), F.lit(False))).alias("ok"))
