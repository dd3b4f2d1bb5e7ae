"""Retrieval queries: benchmark passages against the lines of documents, one collection for each language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..operators.index import term_counts
from .base import LINE_CHUNKS, index_of, line_chunks, lines_of, query, stemmed, terms_sql

K, TOP_N, FLOOR = 4, 12, 0.1


def queries_(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def orders(t):
    """Collections in alphabetical order, a row for each."""
    langs = t("documents").select(F.col("lang").alias("collection")).distinct()
    return langs.join(langs.select(F.col("collection").alias("other")), F.col("other") <= F.col("collection")).groupBy("collection").agg(F.count("*").alias("collection_ord"))


def hits(t, k=K):
    return search.top_k(queries_(t), index_of(t), k)


def merged(t, k=K, found=None):
    """found: hits(t, k), from a caller that reads them too."""
    return search.merge_ranked(hits(t, k) if found is None else found, orders(t))


SPACE = f"""WITH {LINE_CHUNKS},
  {terms_sql('terms', 'line_chunks', 'collection, chunk_ord')},
  counts AS (SELECT collection, chunk_ord, term, count(*) AS tf FROM terms GROUP BY ALL),
  sizes AS (SELECT collection, count(*) AS n FROM line_chunks GROUP BY 1),
  vocab AS (SELECT collection, term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM counts JOIN sizes USING (collection) GROUP BY 1, 2),
  raw AS (SELECT collection, chunk_ord, term, tf * idf AS w FROM counts JOIN vocab USING (collection, term)),
  postings AS (SELECT collection, chunk_ord, term, w / sqrt(sum(w * w) OVER (PARTITION BY collection, chunk_ord)) AS weight FROM raw)"""
HITS = f"""{SPACE},
  bench AS (SELECT item_id AS query_id, text FROM benchmark),
  {terms_sql('qt', 'bench', 'query_id')},
  qraw AS (SELECT query_id, collection, term, tf * idf AS w FROM (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY ALL) JOIN vocab USING (term)),
  qw AS (SELECT query_id, collection, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, collection)) AS qw FROM qraw),
  scored AS (SELECT query_id, collection, chunk_ord, round(sum(qw * weight), 6) AS score FROM qw JOIN postings USING (collection, term) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, chunk_ord) AS rank FROM scored WHERE score > 0),
  hits AS (SELECT * FROM ranked WHERE rank <= {K}),
  orders AS (SELECT lang AS collection, dense_rank() OVER (ORDER BY lang) AS collection_ord FROM (SELECT DISTINCT lang FROM documents)),
  merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, collection_ord, rank) AS pos FROM hits JOIN orders USING (collection)),
  held AS (SELECT *, (row_number() OVER (PARTITION BY query_id, collection ORDER BY pos) <= 1 AND score >= {FLOOR}) AS reserved FROM merged),
  turns AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, pos) AS turn FROM held),
  chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS final_rank FROM turns WHERE turn <= {TOP_N})"""


@query("r1_stem", f"""WITH {LINE_CHUNKS}, toks AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM line_chunks) SELECT tok AS word, stem FROM ({stemmed('toks')})""")
def r1(t):
    from ..functions.text import stem, tokens

    return line_chunks(t).select(F.explode(tokens(F.col("text"))).alias("word")).distinct().select("word", stem(F.col("word")).alias("stem"))


@query("r2_terms", f"WITH {LINE_CHUNKS}, {terms_sql('terms', 'line_chunks', 'collection, chunk_ord')} SELECT collection, chunk_ord, term, count(*) AS tf FROM terms GROUP BY ALL")
def r2(t):
    return term_counts(line_chunks(t), ["collection", "chunk_ord"])


@query("r3_postings", f"{SPACE} SELECT collection, chunk_ord, term, round(weight, 6) AS weight FROM postings")
def r3(t):
    return index_of(t).postings.select("collection", "chunk_ord", "term", F.round("weight", 6).alias("weight"))


@query("r3_vocabulary", f"{SPACE} SELECT collection, term, df, round(idf, 6) AS idf FROM vocab")
def r3v(t):
    return index_of(t).vocab.withColumn("idf", F.round("idf", 6))


@query("r4_query_vectors", f"{HITS} SELECT query_id, collection, term, round(qw, 6) AS qw FROM qw")
def r4(t):
    return search.query_terms(queries_(t), index_of(t).vocab).select("query_id", "collection", "term", F.round("qw", 6).alias("qw"))


@query("r5_top_k", f"{HITS} SELECT query_id, collection, chunk_ord, score, rank FROM hits")
def r5(t):
    return hits(t).select("query_id", "collection", "chunk_ord", "score", "rank")


def joint_chunks(t):
    """All lines as one collection."""
    return line_chunks(t).withColumn("collection", F.lit("all"))


JOINT = HITS.replace("lang AS collection, doc_id, ix - 1", "'all' AS collection, doc_id, ix - 1")


@query("r6_joint_index", f"{JOINT} SELECT query_id, chunk_ord, score, rank FROM hits")
def r6(t):
    return search.top_k(queries_(t), index_of(t, "joint", joint_chunks), K).select("query_id", "chunk_ord", "score", "rank")


@query("r7_merged", f"{HITS} SELECT query_id, collection, chunk_ord, score, pos FROM merged")
def r7(t):
    return merged(t).select("query_id", "collection", "chunk_ord", "score", "pos")


@query("r8_refusals", f"{HITS} SELECT b.query_id, max(score) AS top, CAST(coalesce(sum(CAST(score >= {FLOOR} AS INT)), 0) AS BIGINT) AS n_above, coalesce(max(score), 0) < {FLOOR} AS refused FROM bench b LEFT JOIN hits USING (query_id) GROUP BY 1")
def r8(t):
    return search.refusals(queries_(t), hits(t), FLOOR)


@query("r9_select_top", f"{HITS} SELECT query_id, collection, chunk_ord, score, reserved, final_rank FROM chosen")
def r9(t):
    return search.select_top(merged(t), TOP_N, 1, FLOOR).select("query_id", "collection", "chunk_ord", "score", "reserved", "final_rank")


@query("r17_payload", f"""{HITS} SELECT query_id, string_agg('[' || c.collection || ' cl. ' || l.doc_id || ']', ' ' ORDER BY final_rank) AS citations, string_agg(left(l.text, 80), ' | ' ORDER BY final_rank) AS excerpts
FROM chosen c JOIN line_chunks l USING (collection, chunk_ord) WHERE score >= {FLOOR} GROUP BY 1""")
def r17(t):
    top = search.select_top(merged(t), TOP_N, 1, FLOOR)
    return search.payloads(top, lines_of(t, top), FLOOR)


@query("r18_collection_tops", f"{HITS} SELECT query_id, max(score) FILTER (collection = 'de') AS de, max(score) FILTER (collection = 'en') AS en, max(score) FILTER (collection = 'es') AS es, max(score) FILTER (collection = 'fr') AS fr FROM hits GROUP BY 1")
def r18(t):
    return hits(t).groupBy("query_id").pivot("collection", ["de", "en", "es", "fr"]).agg(F.max("score"))
