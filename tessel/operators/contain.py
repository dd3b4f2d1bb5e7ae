"""Which needles stand in which texts, whole and as they are, by equi-joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .scoring import Batches, lots
from .sizes import small

#: Words of a shingle.
K = 3
_OTHER = r"[^\p{L}\p{N}]+"
#: Bytes of texts that are worked on at once, and odd factors that a shingle's words are hashed together with.
_LOT, _MIX = 4 << 20, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _shingled(texts: DataFrame, key: str, inner: bool = False) -> DataFrame:
    """key, gram: a hash for each run of K words of a text (second column), or of its words but the first and last. Texts of one hash needn't be the same."""

    def shingles(batches: Batches) -> Batches:
        for lot in lots(batches, _LOT):
            text = lot.column(1).chunk(0)
            words = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(pc.fill_null(text, ""), _OTHER, " "), " "), " ")
            flat = words.flatten().dictionary_encode()
            own = pd.util.hash_array(flat.dictionary.to_numpy(zero_copy_only=False), categorize=False)[flat.indices.to_numpy()]
            many = pc.list_value_length(words).to_numpy().astype(np.int64)
            row, place = np.repeat(np.arange(len(many)), many), np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            at = np.flatnonzero((place >= inner) & (place + K + inner <= many[row]))
            gram = sum((own[at + j] * np.uint64(m) for j, m in enumerate(_MIX)), np.zeros(len(at), np.uint64))
            gram = (gram ^ (gram >> np.uint64(29))).view(np.int64)
            for s in (slice(x, x + 100_000) for x in range(0, len(at), 100_000)):
                yield pa.RecordBatch.from_arrays([lot.column(0).chunk(0).take(pa.array(row[at[s]])), pa.array(gram[s])], [key, "gram"])

    return texts.mapInArrow(shingles, f"{key} {texts.schema[key].dataType.simpleString()}, gram long")


def containing(needles: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """needle, id of every text that contains a needle as a substring. needles: needle (id), what; texts: id, text.

    The words of a needle but its first and last are whole words of any text that contains it. So a
    needle of K + 2 words or more meets texts under the one of its inner shingles that fewest texts have,
    and what meets is verified; a common phrase costs nothing while the needle has a rarer one. Shorter
    needles meet the texts' substrings of their own length: a row for each place of a text and each such
    length, taken only where the first word's or needle's letters are there. Empty and null needles stand nowhere.
    """
    own = needles.where("what <> ''").select("needle", "what")
    grams = written(_shingled(own, "needle", inner=True).distinct(), "grams")
    long, short = (own.join(small(grams.select("needle").distinct()), "needle", how) for how in ("left_semi", "left_anti"))
    whole = texts.select(F.col(key).alias("id"), F.col("text")).where("text is not null")

    met = written(_shingled(whole, "id").join(small(grams.select("gram").distinct()), "gram").distinct(), "shingles")
    spread = met.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(spread, "gram").groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    found = written(met.join(rarest, "gram").select("needle", "id").distinct(), "met")
    by_words = whole.join(small(found.join(small(long.select("needle", "what")), "needle")), "id").where(F.contains("text", F.col("what"))).select("needle", "id")

    lengths = [r[0] for r in short.select(F.length("what")).distinct().sort(F.length("what")).collect()]  # under K + 2 words: a few lengths
    if not lengths:
        return written(by_words.distinct(), "contained")
    cut = lambda n: F.when(F.length("text") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substr("text", i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    places = reduce(DataFrame.unionByName, (whole.select("id", F.explode(cut(n)).alias("what")) for n in lengths))
    return written(by_words.unionByName(places.join(small(short), "what").select("needle", "id")).distinct(), "contained")
