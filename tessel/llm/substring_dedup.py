"""Substring de-duplication: paragraphs that repeat across or within documents, by MinHash banding.

A paragraph is a line of at least LEAST words. Its set is that of its distinct 5-word shingles; MinHash
values are banded, with the number of bands and rows tuned for the recall at the threshold. Equal
paragraphs are one class from the start. Classes that collide in a band are compared by exact Jaccard,
links are closed to components, and of each component the first paragraph in order of document and
place stays, all others are removals.

A passage may also repeat inside paragraphs that differ otherwise, or across their ends. So each text has
windows of WINDOW words besides, chosen by winnowing (the least hash of every GUARANTEE - WINDOW + 1 in a
row): two texts that share a run of GUARANTEE words or more share a window in it, wherever its lines
end. Windows repeat by equality.

Comparison (hubs first, then pairs across components only) is shared with the n-gram join. Many copies of
a paragraph that were edited apart collide in bands without linking, and would give all their pairs in
the second round; there the classes meet again under their rarest shingles, of which two that link
share one, and such copies share none.

LEAST is a parameter of what counts: shorter lines (license lines, greetings, headings) repeat in
documents that copy nothing else, and quality rules judge them by how often they do.

Defined results: null text has no paragraphs; a document of none is kept whole with empty lists; equal
rows repeat each other, the first by row stays; rows that share a doc_id, or have none, are documents of
their own; lines are parted by \\n alone; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import ROWS_AT_ONCE, dropped, map_rows, table, written
from .groups import parity, similar_groups
from .ngram_join import LOWER, decided, fetch_key, semi

SHINGLE, LEAST, WINDOW, GUARANTEE = 5, 20, 20, 50
NUM, DEN, RECALL, LOOSE, MOST_LOOSE = 80, 100, 0.999, 0.25, 0.15
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def tune_bands(threshold: float = NUM / DEN, recall: float = RECALL, loose: float = LOOSE, most: float = MOST_LOOSE) -> tuple[int, int]:
    """The fewest (bands, rows) that find pairs at the threshold with the wanted recall, and of pairs at `loose` no more than `most`."""
    for bands in range(1, 200):
        for rows in range(12, 0, -1):
            if 1 - (1 - threshold**rows) ** bands >= recall and 1 - (1 - loose**rows) ** bands <= most:
                return bands, rows
    raise ValueError("no such bands")


BANDS, ROWS = tune_bands()
_draw = np.random.default_rng(20240229)
FACTORS = _draw.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """64-bit hashes of words, kept from text to text."""

    def __init__(self, most: int = 150_000):
        self.known, self.most = {}, most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) if w not in known)
            return np.array([known[w] for w in words], np.uint64)


def shingles(code: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(code) - k + 1
    mixed = np.zeros(max(0, n), np.uint64)
    for j in range(k if n > 0 else 0):
        mixed += code[j : j + n]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return mixed


def _hash(codes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(codes.tobytes()) - (1 << 63)


def winnowed(grams: np.ndarray, span: int = GUARANTEE - WINDOW + 1, apart: int = WINDOW) -> list[int]:
    """Places of the least of every `span` hashes in a row; equal ones that overlap count once."""
    if len(grams) < span:
        return []
    picks = np.unique(np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1))
    if len(np.unique(grams[picks])) == len(picks):
        return picks.tolist()
    out: list[int] = []
    for k in picks.tolist():
        if not out or grams[k] != grams[out[-1]] or k - out[-1] >= apart:
            out.append(k)
    return out


class Units:
    """What may repeat in a text."""

    def __init__(self, text: str | None, codes: Words):
        data = (text or "").encode("utf-8", "replace")
        raw = np.frombuffer(data, np.uint8)
        edge = np.diff(BLANK[raw].astype(np.int8), prepend=1, append=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # of words, in bytes
        chars = np.cumsum((raw & 0xC0) != 0x80)
        self.start, self.end = chars[first] - 1, chars[last - 1]  # in code points
        self.code = codes(data.translate(LOWER).split())
        self.grams = shingles(self.code)
        ends = np.searchsorted(first, np.flatnonzero(raw == 10)).tolist()
        #: First and last word (exclusive) of the paragraphs.
        self.lines = [(a, b) for a, b in zip([0, *ends], [*ends, len(first)], strict=True) if b - a >= LEAST]

        self.alone = len(np.unique(self.grams)) == len(self.grams)

    def paragraphs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Id, hashes of shingles."""
        for a, b in self.lines:
            yield _hash(self.code[a:b]), self.grams[a : b - SHINGLE + 1]

    def windows(self) -> tuple[list[int], np.ndarray]:
        """First words, ids."""
        n = max(0, len(self.code) - WINDOW + 1)
        mixed = np.zeros(n, np.uint64)
        for k in range(0, WINDOW if n else 0, SHINGLE):
            mixed = (mixed + self.grams[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        at = winnowed(mixed)
        return at, mixed[at].view(np.int64)


def band_keys(parts: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS keys for each array of shingle hashes, none of them empty."""
    flat, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
    keys = np.zeros((len(parts), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        mixed = flat * FACTORS[k]
        mixed ^= mixed >> np.uint64(32)
        band = k // ROWS
        keys[:, band] = (keys[:, band] + np.minimum.reduceat(mixed, starts)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(band)
    return keys.view(np.int64)


UNITS = "doc_id long, row long, fetch_key long, inner boolean, start int, end int, set_id long, n int, keys array<long>"


def units(documents: DataFrame) -> DataFrame:
    """A row for each unit: of which row, inner (a window), start, end, set_id; n (shingles) and keys of paragraphs. A row without units has one of nulls."""
    schema = to_arrow_schema(StructType.fromDDL(UNITS))

    def of(part: pa.RecordBatch, codes: Words) -> pa.RecordBatch:
        owner, inner, start, end, ids, n, grams = ([] for _ in range(7))
        for k, text in enumerate(part.column("text").to_pylist()):
            u = Units(text, codes)
            at, window_ids = u.windows()
            whole = list(u.paragraphs())
            a, b = np.array(u.lines, np.int64).reshape(-1, 2).T
            at = np.array(at, np.int64)
            owner.append(np.full(len(a) + len(at), k))
            inner.append(np.arange(len(a) + len(at)) >= len(a))
            start.append(u.start[np.concatenate([a, at])])
            end.append(u.end[np.concatenate([b - 1, at + WINDOW - 1])])
            ids += [np.array([i for i, _ in whole], np.int64), window_ids]
            n += [len(g) if u.alone else len(np.unique(g)) for _, g in whole]
            n += [0] * len(at)
            grams += [g for _, g in whole]
        owner, inner = np.concatenate(owner), np.concatenate(inner)
        outer = ~inner
        banded = band_keys(grams) if grams else np.empty((0, BANDS), np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(outer * BANDS)]).astype(np.int32), pa.int32()), pa.array(banded.ravel(), pa.int64()))
        bare = np.setdiff1d(np.arange(part.num_rows), owner)
        held = [part.column(c).take(pa.array(np.concatenate([owner, bare]))) for c in ("doc_id", "row", "fetch_key")]
        found = [pa.array(inner), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (start, end)), pa.array(np.concatenate(ids)), pa.array(np.array(n, np.int32)), keys]
        return pa.RecordBatch.from_arrays([*held, *(pa.concat_arrays([x.cast(f.type), pa.nulls(len(bare), f.type)]) for x, f in zip(found, list(schema)[3:], strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield of(batch.slice(at, ROWS_AT_ONCE), codes)

    return documents.select("doc_id", F.monotonically_increasing_id().alias("row"), fetch_key(), "text").mapInArrow(run, UNITS)


def repeated(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows: doc_id and row, a number of its own. Units that occur twice or more: doc_id, row, start, end, inner, component, first (the doc_id where the component stands first), keep."""
    documents = documents.select("doc_id", "text")
    every = written(units(documents), "units")
    rows = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    outer = every.where("not inner")
    classes = written(outer.groupBy("set_id").agg(F.first("n").alias("n"), F.min("fetch_key").alias("fetch_key"), F.first("keys").alias("keys")), "classes")
    entries = classes.select("set_id", "n", F.explode("keys").alias("key"))
    often = entries.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    keys = written(entries.join(often, "key", "left_semi").select("key", F.lit(False).alias("kind"), "set_id", "n", F.lit(0).alias("place")), "keys")

    def fetch(it: Iterator[tuple]) -> Iterator[tuple]:
        codes = Words()
        for (text,) in it:
            for i, grams in Units(text, codes).paragraphs():
                found = np.unique(grams)
                yield i, found.view(np.int64), parity(found)

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = written(classes.join(wanted, "set_id", "left_semi").select("fetch_key").distinct(), "fetch")
        read = map_rows(semi(documents.select(fetch_key(), "text"), ids, "fetch_key"), ["text"], "set_id long, elements array<long>, bits array<long>", fetch)
        out = written(semi(read, wanted, "set_id").dropDuplicates(["set_id"]), "sets")
        dropped(ids)
        return out

    def linked(pairs: DataFrame) -> DataFrame:
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "ids")
        sets = sets_of(ids)
        out = written(decided(pairs, sets, NUM, DEN), "linked")
        dropped(ids, sets)
        return out

    again: list[DataFrame] = []

    def narrow(left: DataFrame) -> DataFrame:
        """The first of each set's shingles, rare ones first: paragraphs that were edited apart fill them with their own."""
        ids = written(left.select("set_id"), "ids")
        sets = sets_of(ids)
        dropped(ids)
        again.append(sets)
        each = sets.select("set_id", F.size("elements").alias("n"), F.explode("elements").alias("key"))
        df = each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        shared = each.join(df, "key").groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("xs"))
        own = F.col("n") - F.size("xs")  # these stand before all shared ones
        place = shared.select("set_id", "n", own.alias("own"), F.posexplode("xs").alias("at", "x")).withColumn("place", (F.col("own") + F.col("at")).cast("int"))
        kept = place.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * NUM / DEN))
        return kept.select(F.col("x.key").alias("key"), F.lit(False).alias("kind"), "set_id", "n", "place").join(left, "set_id")

    groups = similar_groups(keys, lambda: again[0].select("set_id", "bits"), NUM, DEN, linked, narrow=narrow)
    dropped(keys, classes, *again)
    # a component that has one class repeats if the class does; windows repeat by equality alone
    spots = every.select("doc_id", "row", "start", "end", "inner", "set_id")
    placed = spots.where("not inner").join(groups, "set_id", "left").select(*spots.columns, F.coalesce("component", "set_id").alias("component")).unionAll(spots.where("inner").withColumn("component", F.col("set_id")))
    twice = placed.groupBy("component", "inner").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "row", "start")).alias("f")).where("times > 1")
    met = twice.join(placed, ["component", "inner"])
    found = met.select("doc_id", "row", "start", "end", "inner", "component", F.col("f.doc_id").alias("first"), ((F.col("row") == F.col("f.row")) & (F.col("start") == F.col("f.start"))).alias("keep"))
    return rows, written(found, "repeated")


def dedup_documents(documents: DataFrame) -> DataFrame:
    """One row per document: its repeated and removed units, and the documents where these stand first.

    doc_id, n_repeated, n_removed, removed_chars, removed (spans start:end, comma-joined), repeats_of (array of doc_id).
    """
    rows, found = repeated(documents)
    gone = ~F.col("keep")
    span = F.struct("start", "end")
    by = found.groupBy("row").agg(
        F.count("*").alias("n_repeated"),
        F.sum(gone.cast("long")).alias("n_removed"),
        F.array_sort(F.collect_list(F.when(gone, span))).alias("spans"),
        F.array_sort(F.collect_set("first")).alias("repeats_of"),
    )
    merge = lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.array_append(acc, s))
    by = by.withColumn("spans", F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), merge))
    return rows.join(by, "row", "left").select(
        "doc_id",
        F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])), F.lit(0).cast("long")).alias("removed_chars"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","), F.lit("")).alias("removed"),
        F.coalesce("repeats_of", F.array().cast("array<bigint>")).alias("repeats_of"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_documents(table(spark, sf_dir, "documents"))
