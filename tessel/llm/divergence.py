"""Source divergence audit: how far the word frequencies of each source of a language lie from the other sources' and the language's.

Partial counts are Arrow compute from end to end: ascii_lower, split_pattern_regex, dictionary_encode
and hash group_by over lots of LOT_BYTES of text, merged in the task and emitted when HELD rows have
come together. A row is a (lang, source, term) with its occurrences and its documents, so a hot source
costs a task's vocabulary, not its rows, before anything is dealt. Spark then adds them up by (lang,
term), keeps the terms of enough documents and writes the counts once.

With p of a group without the term being p0, the value of a pair of groups g, h is
  sum over terms of both of f(pg, ph) - f(pg, p0h) - f(p0g, ph) + f(p0g, p0h)
  + A(g, h) + A(h, g) + (V - terms of g - terms of h) * f(p0g, p0h),
where A(g, h) sums f(pg, p0h) over the terms of g. The first line is summed over columnar shards, dealt
by (lang, term): a shard takes blocks of whole terms and pairs each row with the d-th next one of its
term, for d = 1, 2, ...; so only terms that two groups share are paired, and a block's memory is a few
times its rows. A needs only how often each p occurs in g. All sums are of integers, and exact.

Defined results: null text has no terms, null language or source counts as ''; every (lang, source) that
occurs has its pairs, with value 0 where the language keeps no term, and a source that is alone in its
language has none; repeated rows are documents of their own; ties rank by the item's bytes; only lang,
source and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table, written

LEAST_DOCUMENTS, TOP, UNIT = 10, 10, 1_000_000_000
#: What parts terms: ASCII that isn't a letter.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOT_BYTES, HELD, BLOCK = 4 << 20, 250_000, 200_000
#: Groups up to which their totals are broadcast (some 100 bytes each); beyond, they are shuffled.
MOST_GROUPS = 100_000
COUNTS = "lang string, source string, term string, n long, docs long"


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most LOT_BYTES of text, or one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + LOT_BYTES, "right")))
            # copies, with offsets from 0: casting a slice to large_string gives an array that ascii_lower misreads
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(at, end - at).columns], schema=batch.schema)
            at = end


def _counted(lot: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, docs of a lot. The term '' stands for the group itself, with counts of 0."""
    lang, source = lot.column("lang"), lot.column("source")
    words = pc.split_pattern_regex(pc.ascii_lower(lot.column("text").cast(pa.large_string())), NO_TERM)
    row, term = pc.list_parent_indices(words), pc.list_flatten(words)
    real = pc.not_equal(term, "")
    codes = pc.dictionary_encode(term.filter(real))
    each = pa.table({"row": row.filter(real), "term": codes.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    row = each["row"].combine_chunks()
    full = pa.table({"lang": lang.take(row), "source": source.take(row), "term": codes.dictionary.take(each["term"].combine_chunks()).cast(pa.string()), "n": each["count_all"].combine_chunks(), "docs": pa.array(np.ones(len(row), np.int64))})
    zero = pa.array(np.zeros(lot.num_rows, np.int64))
    groups = pa.table({"lang": lang, "source": source, "term": pa.array([""] * lot.num_rows, pa.string()), "n": zero, "docs": zero})
    return _merged([full, groups])


def _merged(tables: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return added.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: a few rows for each of them that a task meets."""
    kinds = to_arrow_schema(StructType.fromDDL(COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for lot in _lots(batches):
            held.append(_counted(lot))
            if sum(t.num_rows for t in held) > HELD:
                held = [_merged(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held[0].cast(kinds).to_batches(max_chunksize=HELD // 10)
                    held = []
        if held:
            yield from _merged(held).cast(kinds).to_batches(max_chunksize=HELD // 10)

    named = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return named.mapInArrow(run, COUNTS)


def kept_counts(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, lang_n, leads: terms in at least `least` documents of the language, and each group itself as term ''.

    leads marks one row of each (lang, term). Dealt once, by (lang, term), for the grouping and the
    window alike; a term has a row for each group at most.
    """
    by = partial_counts(documents).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    of_lang = by.select("*", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("lang_docs"), (F.min("source").over(w) == F.col("source")).alias("leads"))
    return of_lang.where((F.col("term") == "") | (F.col("lang_docs") >= least)).select("lang", "source", "term", "n", "lang_n", "leads")


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)) of columns or numbers; decimals, as products may pass a long."""
    return F.expr(f"1 + ({UNIT} * (cast({count} as decimal(20,0)) + 2)) div (cast({total} as decimal(20,0)) + 2 * cast({kept} as decimal(20,0)))")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are up to UNIT + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def group_totals(kept: DataFrame) -> DataFrame:
    """lang, source, total, terms, lang_total, v (kept terms of the language), p0 (share without an occurrence; null if v is 0)."""
    real = F.col("term") != ""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(real).alias("terms"), F.count_if(real & F.col("leads")).alias("led"))
    langs = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("led").alias("v"))
    return own.drop("led").join(langs, "lang").withColumn("p0", F.when(F.col("v") > 0, share("0", "total", "nullif(v, 0)")))


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pairs(block: pa.Table) -> pa.Table:
    """lang, source, item, value of the pairs that share terms, of whole terms in order of (lang, term, source)."""
    lang, source = (pc.dictionary_encode(block[c].combine_chunks()) for c in ("lang", "source"))
    at, tongue, many = source.indices.to_numpy().astype(np.int64), lang.indices.to_numpy().astype(np.int64), len(source.dictionary)
    term = pc.dictionary_encode(block["term"].combine_chunks()).indices.to_numpy().astype(np.int64)
    key = tongue * (term.max() + 1) + term
    p, p0 = block["p"].to_numpy(), block["p0"].to_numpy()
    codes, sums, left, step = [], [], np.arange(len(key)), 1
    while True:
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        a, b = left, left + step
        value = _gaps(p[a], p[b]) - _gaps(p[a], p0[b]) - _gaps(p0[a], p[b]) + _gaps(p0[a], p0[b])
        code, place = np.unique((tongue[a] * many + at[a]) * many + at[b], return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, place, value)
        codes.append(code)
        sums.append(total)
        step += 1
    code, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, sums))
    names = [lang.dictionary.take(pa.array(code // many // many)), source.dictionary.take(pa.array(code // many % many)), source.dictionary.take(pa.array(code % many))]
    return pa.table([*names, pa.array(total)], ["lang", "source", "item", "value"])


PAIRS = "lang string, source string, item string, value long"


def shared_terms(rows: DataFrame) -> DataFrame:
    """PAIRS, source before item, a few rows for each pair: what terms of both add. rows: lang, term, source, p, p0."""
    kinds = to_arrow_schema(StructType.fromDDL(PAIRS))

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "source", "item"], use_threads=False).aggregate([("value", "sum")]).rename_columns(["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for block in _whole_terms(batches):
            held.append(_pairs(block))
            if sum(t.num_rows for t in held) > HELD:
                held = [added(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held[0].cast(kinds).to_batches(max_chunksize=HELD // 10)
                    held = []
        if held:
            yield from added(held).cast(kinds).to_batches(max_chunksize=HELD // 10)

    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(run, PAIRS)


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Blocks of BLOCK rows or more, cut between terms."""
    held: pa.Table | None = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.num_rows >= BLOCK:
            last = held.slice(held.num_rows - 1)
            same = pc.and_(pc.equal(held["term"], last["term"][0]), pc.equal(held["lang"], last["lang"][0]))
            cut = held.num_rows - pc.sum(same).as_py()
            if cut:
                yield held.slice(0, cut)
                held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = written(kept_counts(documents, least), "divergence-counts")
    groups = written(group_totals(kept), "divergence-groups")
    few = F.broadcast if groups.count() <= MOST_GROUPS else lambda df: df
    real = kept.where("term <> ''").join(few(groups), ["lang", "source"])
    rows = real.select("lang", "source", "term", share("n", "total", "v").alias("p"), "p0", share("lang_n", "lang_total", "v").alias("q"))
    own = groups.select("lang", "source", "v", "terms", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("p0").alias("item_p0"))

    # all pairs of a language are the result; each part has a row for a pair or fewer, but for A's: as many as a source has different p
    base = own.join(few(other), "lang").where("source <> item").select("lang", "source", "item", F.coalesce((F.col("v") - F.col("terms") - F.col("item_terms")) * gap("p0", "item_p0"), F.lit(0)).alias("value"))
    spread = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    alone = spread.join(few(other), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * gap("p", "item_p0")).alias("value"))
    shared = shared_terms(rows.select("lang", "term", "source", "p", "p0"))
    turned = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = base.unionByName(turned(alone)).unionByName(turned(shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    terms = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
words AS MATERIALIZED (SELECT r, lang, source, unnest(ts) AS term FROM d),
terms AS MATERIALIZED (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN terms USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM terms GROUP BY 1),
sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2),
groups_ AS MATERIALIZED (SELECT lang, source, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source) LEFT JOIN sizes USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + CAST({UNIT} AS BIGINT) * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS p FROM groups_ g JOIN terms t USING (lang) LEFT JOIN counts c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + CAST({UNIT} AS BIGINT) * (CAST(sum(n) AS BIGINT) + 2) // (CAST(sum(sum(n)) OVER (PARTITION BY lang) AS BIGINT) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM counts GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
tops AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
