"""Nearest vectors by cosine, all keys against all targets: blocks of products in Arrow batches, a task holds one block of either side.

Products of unit vectors only say which pairs can be among the nearest; the cosines of these are summed in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .sizes import small

#: Bytes of one side of a block, vectors of a side from which on small tables are cut for more tasks, cells of products worked on at once, groups of columns whose greatest products bound a row's best.
SIDE_BYTES, LEAST_SIDE, CELLS, GROUPS = 16 << 20, 512, 1 << 21, 64
#: Digits of a cosine, and the room for their rounding and that of products.
DIGITS, SLACK = 6, 2e-6


def _matrix(v: pa.ChunkedArray, d: int) -> np.ndarray:
    return v.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _norms(x: np.ndarray) -> np.ndarray:
    """Square roots of sums in the order of the components, as a loop gives them."""
    total = np.zeros(len(x))
    for c in x.T:
        total += c * c
    return np.sqrt(total)


def candidates(a: np.ndarray, b: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b (rows of length 1) of all pairs whose product can be among a row's k best, or tie with them, and reach least."""
    step, groups, found = max(1, CELLS // max(1, len(b))), min(GROUPS, len(b)), []
    width = len(b) // groups if groups else 0
    for at in range(0, len(a), step):
        p = a[at : at + step] @ b.T
        floor = np.full(len(p), least)
        if groups >= k:
            tops = p[:, : groups * width].reshape(len(p), groups, width).max(axis=2)
            floor = np.maximum(floor, np.partition(tops, groups - k, axis=1)[:, groups - k])
        r, c = np.nonzero(p >= (floor - SLACK)[:, None])
        found.append((r + at, c))
    r, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return r, c


def block(keys: pa.Table, targets: pa.Table, d: int, k: int, least: float) -> pa.Table:
    """id, target, cosine of the pairs of a block that can be among the k best. keys: id, v; targets: target, v; all vectors have d components.

    A vector of no length, or with a component that isn't finite, has no cosine (NaN) with any other, which
    ranks first: of these pairs the first k targets are enough.
    """
    targets = targets.sort_by("target")
    a, b = _matrix(keys["v"], d), _matrix(targets["v"], d)
    with np.errstate(all="ignore"):
        n, m = _norms(a), _norms(b)
        odd_a, odd_b = ~(np.isfinite(n) & (n > 0)), ~(np.isfinite(m) & (m > 0))
        ia, ib = np.flatnonzero(~odd_a), np.flatnonzero(~odd_b)
        r, c = candidates(a[ia] / n[ia, None], b[ib] / m[ib, None], k, least)
        odd, first, both = np.flatnonzero(odd_a), np.flatnonzero(odd_b)[:k], np.arange(min(k, len(b)))
        r = np.concatenate([ia[r], np.repeat(ia, len(first)), np.repeat(odd, len(both))])
        c = np.concatenate([ib[c], np.tile(first, len(ia)), np.tile(both, len(odd))])
        dot = np.zeros(len(r))
        for j in range(d):
            dot += a[r, j] * b[c, j]
        cosine = dot / (n[r] * m[c])
    return pa.table({"id": keys["id"].combine_chunks().take(pa.array(r)), "target": targets["target"].combine_chunks().take(pa.array(c)), "cosine": pa.array(cosine, pa.float64(), from_pandas=False)})


def whole(v: Column) -> Column:
    """Whether a vector is there with all its components."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull())


def nearest(keys: DataFrame, targets: DataFrame, k: int, least: float) -> DataFrame:
    """word, target, cosine, rank: the k nearest targets of each key, from the cosine `least` on; ties go by target. Both: word (its own in each table), v (array).

    All pairs are met. Equal vectors are met once: of a target's copies the first k + 1 can rank (one of them
    may be the key itself), and all keys of one vector have its cosines. Vectors of different lengths have none.
    """
    spark = keys.sparkSession
    of = lambda df, *more: df.select("word", F.col("v").cast("array<double>").alias("v"), *more).where(whole(F.col("v")))
    own, wanted = of(keys), of(targets)
    a = written(own.groupBy("v").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("id"), "v"), "key-vectors")
    first = F.row_number().over(Window.partitionBy("v").orderBy("word"))
    b = written(wanted.withColumn("r", first).where(F.col("r") <= k + 1).select(F.col("word").alias("target"), "v"), "target-vectors")
    (na, da), (nb, db) = ((x["n"], x["d"] or 0) for x in (t.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first() for t in (a, b)))
    side = max(1, SIDE_BYTES // (8 * max(1, da, db)))
    rows, columns = -(-max(na, 1) // side), -(-max(nb, 1) // side)
    rows = max(rows, min(2 * spark.sparkContext.defaultParallelism // columns, -(-na // LEAST_SIDE)))

    dealt = lambda t, mine, n, other, m: t.select("*", F.pmod(F.xxhash64("v"), F.lit(n)).alias(mine), F.size("v").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other)).groupBy("i", "j", "d")

    def met(group: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return block(left, right, group[2].as_py(), k + 1, least)

    pairs = dealt(a, "i", rows, "j", columns).cogroup(dealt(b, "j", columns, "i", rows)).applyInArrow(met, "id long, target string, cosine double")
    scored = pairs.select("id", "target", F.round("cosine", DIGITS).alias("cosine")).where(F.col("cosine") >= least)
    ranked = lambda df, key, most: df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cosine"), "target"))).where(F.col("rank") <= most)
    best = small(written(ranked(scored, "id", k + 1).drop("rank"), "nearest"))
    members = own.join(a, "v").select("word", "id")
    return ranked(members.join(best, "id").where(F.col("word") != F.col("target")).select("word", "target", "cosine"), "word", k)
