"""Groups of similar sets from keys that similar sets share, without all pairs of a group.

A table of keys (key, kind, set_id, n, place) says under which keys a set can be met. Turning every key
into all its pairs would give the square of a group's size, so comparison takes two rounds.
1. Each set under a key is compared with one hub for the key and size band, drawn by a hash of set and
   key: a member of a group of near copies meets as many different hubs as it has keys. The links found
   are closed to components.
2. Keys under which sets of more than one component are left give all pairs across components. Pairs
   inside a component can't change the components and are never made.
Sets carry a parity sketch, which bounds what two of them can share from above; in the second round it
settles pairs before they become rows. The result is exact for every pair that shares a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .components import components

KEYS = ["key", "kind"]
#: 64-bit words of a parity sketch.
LANES = 4


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def need(a, b, num: int, den: int):
    """Elements that sets of sizes a and b must share for a similarity of num / den; for numbers and columns."""
    if isinstance(a, Column) or isinstance(b, Column):
        return F.floor((num * (a + b) + num + den - 1) / (num + den)).cast("int")
    return -(-num * (a + b) // (num + den))


def parity(elements: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The set's sketch: 64 * lanes bits, each the parity of the number of elements that hash to it."""
    place = elements.view(np.uint64) >> np.uint64(64 - (64 * lanes).bit_length() + 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=64 * lanes) & 1).astype(np.uint8)).view(np.int64)


def near_enough(a: str, b: str, n: Column, m: Column, num: int, den: int, lanes: int = LANES) -> Column:
    """Sets of n and m elements with the sketches a and b may share enough for a link; true where a sketch is null.

    An element that only one of them has turns one bit; so they differ in as many elements as bits at
    least. The bound is tight as long as they differ in much fewer elements than there are bits, which
    holds for the near copies that fall short of the threshold.
    """
    turned = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(lanes)), F.lit(0))
    return F.coalesce(n + m - turned >= 2 * need(n, m, num, den), F.lit(True))


def fits_places(num: int, den: int) -> Column:
    """Sizes and places of x and y leave enough elements for a link."""
    x, y = (F.col(f"{s}.n") - F.col(f"{s}.place") for s in "xy")
    return need(F.col("x.n"), F.col("y.n"), num, den) <= F.least(x, y)


def similar_groups(keys: DataFrame, sketches: Callable[[], DataFrame], num: int, den: int, linked: Callable[[DataFrame], DataFrame], meet: Column | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """set_id, component (the least set_id that links reach), of the sets that have a link.

    keys: key, kind, set_id, n, place (elements of the set that stand before the key); a table that is cheap to reread.
    sketches: gives set_id, bits (by parity()) of the sets that the second round compares.
    linked: pairs (a, b) -> those that link, by a similarity of num / den, as a written table.
    meet: a condition on x and y (kind, set_id, n, place) of pairs that are to be met under a key.
    narrow: for the second round, of keys that many sets share without linking: sets (set_id, component) ->
        a table of other keys (key, kind, set_id, n, place, component), under one of which any two of
        these sets that link still meet.
    """
    fits = fits_places(num, den) if meet is None else meet & fits_places(num, den)
    band = lambda n: F.floor(F.log(n) / math.log(den / num))
    banded = keys.withColumn("band", band(F.col("n")).cast("int"))
    hubs = banded.groupBy(*KEYS, "band").agg(F.min_by(F.struct("set_id", "n", "place"), F.struct(F.xxhash64("set_id", "key"), "set_id")).alias("h"))
    hubs = hubs.select(*KEYS, F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "h.*")
    tried = written(_ordered(banded.alias("x").join(hubs.alias("y"), [*KEYS, "band"]).where((F.col("x.set_id") != F.col("y.set_id")) & fits)), "tried")
    links = linked(tried)
    groups = components(links)

    own = keys.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    every = written(own, "placed")
    mixed = every.groupBy(*KEYS).agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select(*KEYS)
    left = every.join(mixed, KEYS, "left_semi")
    if narrow:
        left = narrow(left.select("set_id", "component").distinct())
        mixed = left.groupBy(*KEYS).agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select(*KEYS)
        left = left.join(mixed, KEYS, "left_semi")
    placed = written(left.join(sketches(), "set_id"), "mixed")
    dropped(every)
    # a pair of components can hold a pair that fits only if their least sizes and most room would
    parts = placed.groupBy(*KEYS, "component").agg(F.min("n").alias("n"), F.max(F.col("n") - F.col("place")).alias("room"), F.count("*").alias("sets"), F.first("bits").alias("bits"))
    may = need(F.col("p.n"), F.col("q.n"), num, den) <= F.least("p.room", "q.room")
    # of two components of one set each, the sketches are compared here: a crowd of sets without links makes no rows
    may = may & ((F.col("p.sets") > 1) | (F.col("q.sets") > 1) | near_enough("p.bits", "q.bits", F.col("p.n"), F.col("q.n"), num, den))
    across = parts.alias("p").join(parts.alias("q"), KEYS).where((F.col("p.component") < F.col("q.component")) & may)
    few = F.col("p.sets") <= F.col("q.sets")  # the sets of the smaller one become rows first
    across = across.select(*KEYS, F.when(few, F.col("p.component")).otherwise(F.col("q.component")).alias("p"), F.when(few, F.col("q.component")).otherwise(F.col("p.component")).alias("q"))
    parts_of = ["set_id", "n", "place", "kind", "bits"]
    fits = fits & near_enough("x.bits", "y.bits", F.col("x.n"), F.col("y.n"), num, den)  # before a pair becomes a row
    left = across.join(placed.withColumnRenamed("component", "p"), [*KEYS, "p"]).select(*KEYS, "q", F.struct(*parts_of).alias("x"))
    right = placed.select(*KEYS, F.col("component").alias("q"), F.struct(*parts_of).alias("y"))
    found = written(_ordered(left.join(right, [*KEYS, "q"]).where(fits)).join(tried, ["a", "b"], "left_anti"), "across")
    dropped(placed, tried)
    if found.limit(1).count():
        late = linked(found)
        if late.limit(1).count():
            before, groups = groups, components(links.unionAll(late))
            dropped(before)
        dropped(late)
    dropped(found, links)
    return groups.select(F.col("node").alias("set_id"), "component")
