"""Sources and sinks on files that Spark writes from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import layout
from ..sources import scans
from ..sources.scratch import folder
from ..streaming import signal
from .base import LINE_CHUNKS, line_chunks, query
from .q_more import led
from .q_signal import TURNS, turns


@query("s1_text_scan", "SELECT 'lang=' || lang AS collection, line, count(*) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY 1, 2")
def s1(t):
    """Documents as text files of up to 1,000 documents in a folder for each language, read back file by file."""
    docs = t("documents").select("lang", "text")
    path = folder(docs.sparkSession, "texts")
    docs.write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(path)
    read = scans.texts(docs.sparkSession, path)
    return read.select("collection", F.explode(lines(F.col("text"))).alias("line")).where("line <> ''").groupBy("collection", "line").agg(F.count("*").alias("n"))


DIRECTORY = ["s_suppkey", "s_name", "phone"]


@query("s3_directory_scan", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '0' || s_nationkey END AS phone, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier")
def s3(t):
    """Suppliers as a CSV file with columns that nobody asked for and empty cells."""
    rows = t("supplier").select("s_acctbal", "s_name", "s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("0"), "s_nationkey")).alias("phone"))
    path = folder(rows.sparkSession, "directory")
    rows.orderBy("s_suppkey").write.option("header", True).csv(path)
    return scans.directory(rows.sparkSession, path, DIRECTORY)


@query("s9_vectors", "SELECT translate(CAST(vec_id AS VARCHAR), '0123456789', 'abcdefghij') AS word, len(embedding) AS dims, CAST(embedding[1] AS FLOAT) AS head, CAST(embedding[-1] AS FLOAT) AS tail, rank FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings) WHERE vec_id NOT IN (1, 12)")
def s9(t):
    """Embeddings as lines 'word f1 f2 ...', their words the ids in letters; two words are stop words."""
    word = F.translate(F.col("vec_id").cast("string"), "0123456789", "abcdefghij")
    rows = t("embeddings").orderBy("vec_id").select(F.concat_ws(" ", word, F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    path = folder(rows.sparkSession, "vectors")
    rows.write.text(path)
    return scans.vectors(rows.sparkSession, path, stop=("b", "bc")).select("word", F.size("v").cast("long").alias("dims"), F.element_at("v", 1).alias("head"), F.element_at("v", -1).alias("tail"), "rank")


@query("s10_transcripts", """SELECT conv_id || '.' || turn AS id, role AS outcome, text AS claim, '[' || role || ']' AS tag, CASE WHEN turn % 2 = 0 THEN 'supported' END AS verdict FROM conversations WHERE turn % 7 <> 6""")
def s10(t):
    """Turns as transcript records with one claim each; every seventh line isn't JSON."""
    claim = F.struct(F.col("text").alias("claim"), F.concat(F.lit("["), "role", F.lit("]")).alias("tag"), F.when(F.col("turn") % 2 == 0, "supported").alias("verdict"))
    record = F.to_json(F.struct(F.concat_ws(".", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.col("role").alias("outcome"), F.array(claim).alias("claims")))
    rows = t("conversations").select(F.when(F.col("turn") % 7 == 6, "{cut").otherwise(record).alias("value"))
    path = folder(rows.sparkSession, "transcripts")
    rows.write.text(path)
    return scans.claims(scans.transcripts(rows.sparkSession, path).where("ok")).select("id", "outcome", "claim", "tag", "verdict")


@query("s11_saved_corpus", f"WITH {LINE_CHUNKS} SELECT 'v' || doc_id % 2 AS corpus_version, collection, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM line_chunks GROUP BY 1, 2")
def s11(t):
    chunks = line_chunks(t).withColumn("corpus_version", F.concat(F.lit("v"), F.col("doc_id") % 2))
    path = folder(chunks.sparkSession, "corpus")
    scans.save_corpus(chunks, path, chunks.where("text is null"))
    saved = chunks.sparkSession.read.parquet(path)
    return saved.groupBy("corpus_version", "collection").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("t3_encoded_lines", f"{TURNS} SELECT id, route, refused, top, shown, q FROM sig")
def t3(t):
    """Turn signals written as lines and read back."""
    rows = signal.turn_signals(turns(t))
    path = folder(rows.sparkSession, "signals")
    signal.encoded(rows).write.text(path)
    return signal.parsed(rows.sparkSession.read.text(path)).where("ok").select("id", "route", "refused", "top", "shown", "q")


@query("l6_titles")
def l6(t):
    """Titles of the contents tables against the rows around the anchors, twenty units apart."""
    rows = led(t)
    placed = rows.select("doc", "ord", (F.col("ord") * 20.0).alias("y"), "text")
    titles = layout.contents(rows).select("doc", "num", "title").join(layout.anchors(rows), ["doc", "num"]).select("doc", "num", (F.col("ord") * 20.0).alias("y"), "title")
    return layout.title_match(placed, titles)
