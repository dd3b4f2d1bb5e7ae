"""How queries are registered, and the views of the given tables that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STEM_PASSES, STEM_RULES, STOP_WORDS, lines, stem_text
from ..operators.search import Index
from ..operators.sizes import small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader (name -> DataFrame) under a name, with the SQL of the same rows."""

    def take(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return take


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where it has fewer files (a row group is never split); larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def line_chunks(t, documents: DataFrame | None = None) -> DataFrame:
    """collection, chunk_ord, doc_id, ix, text: the lines of documents that aren't empty. documents: some of them, else all."""
    d = (spread(t("documents").select("lang", "doc_id", "text")) if documents is None else documents).select(F.col("lang").alias("collection"), "doc_id", F.posexplode_outer(lines(F.col("text"))).alias("ix", "text"))  # posexplode() would have a filter inferred that cuts each text twice
    return d.where("text <> ''").withColumn("chunk_ord", F.col("doc_id") * 100000 + F.col("ix"))


def lines_of(t, hits: DataFrame) -> DataFrame:
    """line_chunks() of the documents of some hits (chunk_ord): no other text is cut. A document of 100,000 lines or more is always cut, as its numbers run into the next one's."""
    own = small(hits.select(F.expr("chunk_ord div 100000").alias("doc_id"), F.lit(True).alias("hit")).distinct())
    return line_chunks(t, t("documents").select("lang", "doc_id", "text").join(own, "doc_id", "left").where("hit or length(text) >= 99999"))


_indexes: dict[tuple, Index] = {}


def index_of(t, kind: str = "lines", chunks: Callable[..., DataFrame] = line_chunks) -> Index:
    """The index of chunks(t), written once for a session and an unchanged table of documents, then opened by each query."""
    source = t("documents")
    context = source.sparkSession.sparkContext
    path = lambda f: context._jvm.org.apache.hadoop.fs.Path(f)
    stamp = tuple((f, path(f).getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path(f)).getModificationTime()) for f in sorted(source.inputFiles()))
    key = (context.applicationId, kind, stamp)
    if key not in _indexes:
        _indexes[key] = Index(chunks(t))
    return _indexes[key]


LINE_CHUNKS = """line_chunks AS (
  SELECT lang AS collection, doc_id, ix - 1 AS ix, text, doc_id * 100000 + ix - 1 AS chunk_ord
  FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS ix FROM documents) WHERE text <> '')"""


def pages(t) -> DataFrame:
    """doc_key, page_ord, body: ten documents in a row are the pages of one."""
    return spread(t("documents").select("doc_id", "text")).select(F.expr("doc_id div 10").alias("doc_key"), (F.col("doc_id") % 10).cast("int").alias("page_ord"), F.col("text").alias("body"))


PAGES = "pages_ AS (SELECT doc_id // 10 AS doc_key, CAST(doc_id % 10 AS INT) AS page_ord, text AS body FROM documents)"


def stem_case(w: str) -> str:
    """One pass of the stemmer in SQL."""
    rules = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {least}{f" AND {w} NOT LIKE '%ss'" if s == 's' else ''} THEN left({w}, length({w}) - {drop}) || '{add}'" for s, least, drop, add in STEM_RULES)
    return f"CASE WHEN length({w}) <= 3 THEN {w} {rules} ELSE {w} END"


def stemmed(source: str, word: str = "tok") -> str:
    """SELECT of source with `word` stemmed as `stem`."""
    inner = f"SELECT *, {word} AS stem FROM {source}"
    for _ in range(STEM_PASSES):
        inner = f"SELECT * REPLACE ({stem_case('stem')} AS stem) FROM ({inner})"
    return inner


STOP_STEMS = ", ".join(f"'{w}'" for w in sorted({stem_text(s) for s in STOP_WORDS}))


def terms_sql(name: str, source: str, keys: str) -> str:
    """CTEs that give `name`(keys, term): unigrams and bigrams of source.text."""
    return f"""{name}_tok AS (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM {source}),
  {name}_kept AS (SELECT {keys}, stem, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS p FROM ({stemmed(f'{name}_tok')}) WHERE length(stem) > 1 AND stem NOT IN ({STOP_STEMS})),
  {name} AS (SELECT {keys}, stem AS term FROM {name}_kept UNION ALL SELECT {', '.join(f'a.{k.strip()}' for k in keys.split(','))}, a.stem || ' ' || b.stem FROM {name}_kept a JOIN {name}_kept b ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND b.p = a.p + 1)"""
