"""Tables of an index: terms, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, analyse


def term_counts(chunks: DataFrame, keys: list[str], text: str = "text", stop: list[str] = STOP_WORDS) -> DataFrame:
    """keys, term, tf. Terms are counted where they arise, before any shuffle, by partial aggregation."""
    terms = chunks.select(*keys, F.explode_outer(analyse(F.col(text), stop)).alias("term"))  # explode() would have a filter inferred that analyses each text again
    return terms.where("term is not null").groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, chunks: DataFrame, collection: str = "collection") -> DataFrame:
    """collection, term, df, idf (smoothed: ln((1 + n) / (1 + df)) + 1). counts: collection, term, df of some chunks at a time."""
    size = chunks.groupBy(collection).agg(F.count("*").alias("n"))
    df = counts.groupBy(collection, "term").agg(F.sum("df").alias("df"))
    return df.join(F.broadcast(size), collection).select(collection, "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def corpus_digest(chunks: DataFrame, order: list[str], fields: list[str], block: Column) -> DataFrame:
    """One row: sha256 over the digests of blocks, in order of block; a block's is over its rows' digests, in their order.

    Only one digest per block meets in the last step.
    """
    row = F.sha2(F.concat_ws("\0", *fields), 256)
    blocks = chunks.select(block.alias("block"), F.struct(*order, row.alias("h")).alias("x")).groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    blocks = blocks.select("block", F.sha2(F.array_join(F.col("xs.h"), ""), 256).alias("h"))
    return blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ""), 256).alias("digest"), F.count("*").alias("blocks"))
