"""N-gram Jaccard join: a size-aware join of documents by their word shingles, small sets and large ones apart.

Sets. A document is the set of 64-bit hashes of its distinct `shingle`-word shingles. Documents with
equal sets are one class from here on, so groups of exact copies cost one row each.

Keys. With a threshold of num/den, sets of sizes a and b link only if they share at least
ceil(num * (a + b) / (num + den)) elements.
- Large sets: inverted lists. Elements are ordered, rare ones first, and a set stands in the lists of its
  first n - ceil(num * n / den) + 1 elements; two sets that link meet in one of these lists, at places
  that leave enough elements behind them. The order comes from counts over all documents: each task
  reports the elements that it met often, and the HEAVY most frequent go last. Any order gives the same
  links; this one keeps elements of passages that many documents share out of the lists.
- Small sets: fixed-size subsets. A set lists all its subsets of each size that a link to another small
  set could need, and two sets meet under an equal subset.
- Boundary. The work of scanning lists is the sum of their lengths over a size's sets, that of
  enumerating the number of subsets; the boundary between small and large is where the total is least.

Links. Lists aren't turned into all their pairs, for a group of near copies would give the square of its
size. First each member of a list is compared with one hub per list and size band, drawn by a hash, so
that a near copy meets as many hubs as it has keys. Components of the links so found are formed. Then,
for lists that still hold more than one component, the pairs across components are compared, all of
them. A pair inside a component can't change the components, so none of it matters to the result.
Comparing: a pair is dropped if the parity sketches of its sets prove too small an overlap; what is left
is decided by the exact intersection of the sets, which are read from the texts again.

Broadcasts are of bounded size: the HEAVY elements, and the ids of classes to compare where these are at
most IDS (beyond, they are joined by a shuffle).

Defined results: null text and texts without words have the empty set, which links with nothing; a text
of fewer words than a shingle is one element; equal rows link; rows that share a doc_id are sets of their
own; a row of null doc_id links like any other and gets its component's least doc_id (null if all are
null); an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, map_rows, table, written
from .groups import near_enough, need, parity, similar_groups

SHINGLE, NUM, DEN = 3, 90, 100
HEAVY, OFTEN, LOT = 1 << 18, 8, 1_000_000
#: Sets up to this size may be small; beyond, the number of subsets explodes.
SMALL, IDS, KEPT_WORDS = 30, 2_000_000, 150_000
#: Sets from this size on also have a sketch of so many 64-bit words.
BIG, WIDE = 600, 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles; keeps the hashes of words."""

    def __init__(self, k: int):
        self.k, self.words = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
        if len(words) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64).view(np.int64)
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
        try:
            code = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            code = np.array([known[w] for w in words], np.uint64)
        n = len(words) - self.k + 1
        mixed = np.zeros(n, np.uint64)
        for j in range(self.k):
            mixed += code[j : j + n]
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        mixed = mixed.view(np.int64)
        mixed.sort()
        return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def set_id(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def subset_sizes(n: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a link of a set of n elements may need."""
    return sorted({need(n, m, num, den) for m in range(-(-num * n // den), den * n // num + 1)} & set(range(1, n + 1)))


def subset_count(n: int, num: int, den: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, num, den))


def heavy_elements(documents: DataFrame, shingle: int, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements, sorted, and their counts, from what each task met OFTEN or more among LOT elements."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        sets, size, shingler = {}, 0, Shingler(shingle)

        def often() -> Iterator[tuple]:
            if sets:
                found, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                yield from zip(found[count >= OFTEN].tolist(), count[count >= OFTEN].tolist(), strict=True)

        for (text,) in it:
            s = shingler(text)
            if sets.setdefault(set_id(s), s) is s:
                size += len(s)
            if size >= LOT:
                yield from often()
                sets.clear()
                size = 0
        yield from often()

    met = map_rows(documents, ["text"], "element long, n long", rows).groupBy("element").agg(F.sum("n").alias("n"))
    top = met.orderBy(F.desc("n"), "element").limit(most).toArrow()
    element, n = top["element"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(element)
    return element[order], n[order]


def first_elements(s: np.ndarray, size: int, heavy: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first elements in the order: those that aren't heavy by value, then heavy ones by count and value."""
    if not len(heavy):
        return s[:size]
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    is_heavy = heavy[at] == s
    light = s[~is_heavy]
    if len(light) >= size:
        return light[:size]
    rest, n = s[is_heavy], counts[at[is_heavy]]
    return np.concatenate([light, rest[np.lexsort((rest, n))]])[:size]


def fetch_key():
    """What a row is found by when its text is read again: its id, or its text's hash where it has none."""
    return F.coalesce("doc_id", F.xxhash64("text")).alias("fetch_key")


def sketched(documents: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """doc_id, fetch_key, set_id, n, first (elements in order), bits (parity sketch), wide (a wider one from BIG elements on), whole (the set, if at most SMALL)."""
    held = documents.sparkSession.sparkContext.broadcast(heavy_elements(documents, shingle))

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        shingler, (heavy, counts) = Shingler(shingle), held.value
        for doc, key, text in it:
            s = shingler(text)
            n = len(s)
            yield doc, key, set_id(s), n, first_elements(s, prefix_size(n, num, den) if n else 0, heavy, counts), parity(s), parity(s, WIDE) if n >= BIG else None, s if n <= SMALL else None

    keyed = documents.select("doc_id", fetch_key(), "text")
    return map_rows(keyed, ["doc_id", "fetch_key", "text"], "doc_id long, fetch_key long, set_id long, n int, first array<long>, bits array<long>, wide array<long>, whole array<long>", rows)


def _subset_keys(classes: DataFrame, below: int, num: int, den: int) -> DataFrame:
    """key, set_id, n, place 0: all subsets of the sizes that a link may need, of the sets of fewer than `below` elements."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for sid, n, whole in it:
            for c in subset_sizes(n, num, den):
                for part in itertools.combinations(whole, c):
                    yield xxhash.xxh3_64_intdigest(np.array(part, np.int64).tobytes(), seed=1) - (1 << 63), sid, n, 0

    small = classes.where((F.col("n") > 0) & (F.col("n") < below))
    return map_rows(small, ["set_id", "n", "whole"], "key long, set_id long, n int, place int", rows)


def _boundary(lists: DataFrame, num: int, den: int) -> int:
    """The least total of subsets (below) and list entries scanned (from there on)."""
    by = {r["n"]: (r["sets"], r["scan"]) for r in lists.where(F.col("n") < SMALL).groupBy("n").agg(F.count_distinct("set_id").alias("sets"), F.sum("length").alias("scan")).collect()}  # SMALL rows
    total = lambda x: sum(by[n][0] * subset_count(n, num, den) if n < x else by[n][1] for n in by)
    return min(range(1, SMALL + 1), key=total)


def semi(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(F.broadcast(ids) if ids.count() <= IDS else ids, column, "left_semi")


def fetched(documents: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """set_id, elements: the sets of the documents of these fetch keys, read from their texts again."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        shingler = Shingler(shingle)
        for (text,) in it:
            s = shingler(text)
            yield set_id(s), s

    taken = semi(documents.select(fetch_key(), "text"), keys, "fetch_key")
    return map_rows(taken, ["text"], "set_id long, elements array<long>", rows).dropDuplicates(["set_id"])


def decided(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets (set_id, elements) have the wanted similarity."""
    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("elements").alias(f"e{x}"))
    shared = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(den * shared >= num * (F.size("ea") + F.size("eb") - shared)).select("a", "b")


def join_groups(documents: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), class_id (the least of equal sets)."""
    documents = documents.select("doc_id", "text")
    full = written(sketched(documents, shingle, num, den), "sketched")
    docs = written(full.select("doc_id", "set_id", "n"), "documents")
    firsts = [F.min("doc_id").alias("rep"), F.min("fetch_key").alias("fetch_key"), *(F.first(c).alias(c) for c in ("first", "bits", "wide", "whole"))]
    every = written(full.where("n > 0").groupBy("set_id", "n").agg(*firsts), "classes")
    dropped(full)
    entries = every.select("set_id", "n", F.posexplode("first").alias("place", "key"))
    lengths = entries.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    lists = written(entries.join(lengths, "key").select("key", F.lit(False).alias("kind"), "set_id", "n", "place", "length"), "lists")
    below = _boundary(lists, num, den)
    subsets = _subset_keys(every, below, num, den)
    often = subsets.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    small = written(subsets.join(often, "key", "left_semi").select("key", F.lit(True).alias("kind"), "set_id", "n", "place"), "subsets")
    classes = written(every.select("set_id", "n", "rep", "fetch_key", "bits", "wide"), "classes")
    dropped(every)
    # sets that are both small meet under their subsets alone
    meet = F.col("x.kind") | (F.greatest("x.n", "y.n") >= below)

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"), F.col("wide").alias(f"w{x}"), F.col("fetch_key").alias(f"k{x}"))
        n, m = F.col("na"), F.col("nb")
        met = pairs.join(side("a"), "a").join(side("b"), "b").where(near_enough("ba", "bb", n, m, num, den) & near_enough("wa", "wb", n, m, num, den, WIDE))
        met = written(met.select("a", "b", "ka", "kb"), "pairs")
        keys = written(met.select(F.explode(F.array("ka", "kb")).alias("fetch_key")).distinct(), "fetch")
        sets = written(fetched(documents, keys, shingle), "sets")
        out = written(decided(met.select("a", "b"), sets, num, den), "linked")
        dropped(met, keys, sets)
        return out

    groups = similar_groups(lists.drop("length").unionAll(small), lambda: classes.select("set_id", "bits"), num, den, linked, meet)
    dropped(lists, small)
    of = classes.select("set_id", "n", "rep").join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = of.groupBy("component").agg(F.min("rep").alias("least"))
    of = of.join(least, "component").select("set_id", "n", "rep", F.col("least").alias("component"))
    out = docs.select("doc_id", "set_id", "n").join(of, ["set_id", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def keep_first(documents: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """The documents, all their columns, that are the first of their group by doc_id; of rows of one doc_id, one stays."""
    groups = written(join_groups(documents, shingle, num, den).select("doc_id", "component_id"), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    left = documents.join(F.broadcast(gone) if gone.count() <= IDS else gone, "doc_id", "left_anti").select(*documents.columns)
    twice = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.limit(1).count():
        left = left.join(twice, "doc_id", "left_anti").unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*documents.columns)
    return left


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"))
