"""Session, scratch and text helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import dropped, shared_dir, written  # noqa: F401

#: White space that parts words: space and \\x09-\\x0D, which is what bytes.split() takes.
SPACE = "\\x20\\x09-\\x0D"
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """mapInArrow over the named columns alone; rows() turns an iterator of tuples into one of tuples of schema."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(at, ROWS_AT_ONCE)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        for row in rows(tuples()):
            held.append(row)
            if len(held) >= ROWS_AT_ONCE:
                yield _batch(held, kinds)
                held = []
        if held:
            yield _batch(held, kinds)

    return df.select(*columns).mapInArrow(run, schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows, with all their columns, whose text passes. make() is called once a task and gives the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield part.filter(pa.array([passes(t) for t in part.column("text").to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def lower_ascii(c):
    """A-Z to lower case, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
