"""Cleaning, neighbouring pages and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunk, dedupe, index
from .base import LINE_CHUNKS, PAGES, line_chunks, pages, query

DROP = [r".*555-[0-9]{4}.*"]


@query("c1_clean_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^.*555-[0-9]{4}.*$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '') AS clean FROM documents""")
def c1(t):
    return t("documents").select("doc_id", X.clean_text(F.col("text"), DROP).alias("clean"))


def allowed(t, least_docs=20):
    """word: the frequent words of the corpus, all of them, as the allow-list."""
    toks = t("documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w")).where("length(w) >= 3")
    return toks.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("word")


def changes(t):
    words = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token"))
    return dedupe.segment_words(words, allowed(t))


@query("c2_repair_joins")
def c2(t):
    return dedupe.repair_joins(pages(t), changes(t)).select("doc_key", "page_ord", "body")


@query("c3_repair_edits")
def c3(t):
    return dedupe.repair_joins(pages(t), changes(t)).select("doc_key", "page_ord", "edits")


@query("c4_changed_tokens")
def c4(t):
    return changes(t).withColumn("camel", F.col("token").rlike("[a-z][A-Z]"))


@query("c4_camel_tokens", "SELECT DISTINCT tok AS token FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS tok FROM documents) WHERE regexp_matches(tok, '[a-z][A-Z]')")
def c4b(t):
    return t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).where(F.col("token").rlike("[a-z][A-Z]")).distinct()


PAIRS = rf"""WITH {PAGES}, flat AS (SELECT doc_key, page_ord, body, trim(regexp_replace(body, '[ \t\n]+', ' ', 'g')) AS f FROM pages_),
  near AS (SELECT doc_key, page_ord, body, f, lag(page_ord) OVER w AS prev_order, lag(f) OVER w AS g, lag(body) OVER w AS prev_body FROM flat WINDOW w AS (PARTITION BY doc_key ORDER BY page_ord)),
  pairs_ AS (SELECT doc_key, prev_order, page_ord,
    CASE WHEN len(fw) < 3 THEN [f] ELSE list_distinct([fw[i] || ' ' || fw[i + 1] || ' ' || fw[i + 2] for i in range(1, len(fw) - 1)]) END AS a, CASE WHEN len(gw) < 3 THEN [g] ELSE list_distinct([gw[i] || ' ' || gw[i + 1] || ' ' || gw[i + 2] for i in range(1, len(gw) - 1)]) END AS b,
    list_distinct([trim(x) for x in string_split(body, chr(10)) if trim(x) <> '']) AS la, list_distinct([trim(x) for x in string_split(prev_body, chr(10)) if trim(x) <> '']) AS lb FROM (SELECT *, string_split(f, ' ') AS fw, string_split(g, ' ') AS gw FROM near) WHERE prev_order IS NOT NULL),
  scored AS (SELECT doc_key, prev_order, page_ord, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity,
    CASE WHEN least(len(la), len(lb)) > 0 THEN round(len(list_intersect(la, lb)) / least(len(la), len(lb)), 6) END AS containment FROM pairs_),
  judged AS (SELECT *, similarity > 0.75 AS duplicate FROM scored)"""


@query("c5_page_similarity", f"{PAIRS} SELECT doc_key, prev_order, page_ord, similarity FROM judged")
def c5(t):
    return dedupe.page_pairs(pages(t)).select("doc_key", "prev_order", "page_ord", "similarity")


@query("c5_page_similarity_exact")
def c5x(t):
    return dedupe.page_pairs(pages(t), "ratio").select("doc_key", "prev_order", "page_ord", "similarity")


@query("c6_line_containment", f"{PAIRS} SELECT doc_key, prev_order, page_ord, containment FROM judged")
def c6(t):
    return dedupe.page_pairs(pages(t)).select("doc_key", "prev_order", "page_ord", "containment")


@query("c7_duplicate_pairs", f"{PAIRS} SELECT doc_key, prev_order, page_ord, similarity, containment FROM judged WHERE duplicate")
def c7(t):
    return dedupe.page_pairs(pages(t)).where("duplicate").drop("duplicate")


def kept(t):
    edits = F.regexp_count(F.col("body"), F.lit("[a-z][A-Z]"))
    return dedupe.keep_cleanest(pages(t), dedupe.page_pairs(pages(t), threshold=0.2), edits)


KEPT = PAIRS.replace("similarity > 0.75", "similarity > 0.2") + """,
  marked AS (SELECT p.*, sum(CASE WHEN j.duplicate THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_key ORDER BY p.page_ord) AS run, len(regexp_extract_all(body, '[a-z][A-Z]')) AS edits FROM pages_ p LEFT JOIN judged j USING (doc_key, page_ord)),
  kept_ AS (SELECT doc_key, page_ord, body, first_value(page_ord) OVER (PARTITION BY doc_key, run ORDER BY edits, length(body) DESC, page_ord) AS twin FROM marked)"""


@query("c8_dedupe_pages", f"{KEPT} SELECT doc_key, page_ord, twin = page_ord AS kept, twin FROM kept_")
def c8(t):
    return kept(t)


@query("c9_salvaged_lines")
def c9(t):
    return dedupe.salvage(pages(t), kept(t))


@query("c10_page_offsets", f"""{KEPT}, starts AS (SELECT doc_key, page_ord AS twin, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_key ORDER BY page_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_offset FROM kept_ WHERE twin = page_ord)
SELECT doc_key, page_ord, CAST(char_offset AS BIGINT) AS char_offset, twin FROM kept_ JOIN starts USING (doc_key, twin)""")
def c10(t):
    return dedupe.page_offsets(pages(t), kept(t))


@query("c11_number_coverage", "SELECT CAST(n AS INT) AS num, n IN (SELECT DISTINCT TRY_CAST(x AS BIGINT) FROM (SELECT unnest(regexp_extract_all(text, '([0-9]{1,3})[.)]', 1)) AS x FROM documents)) AS present FROM range(1, 301) r(n)")
def c11(t):
    seen = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("([0-9]{1,3})[.)]"), F.lit(1))).alias("x")).select(F.col("x").cast("int").alias("num")).distinct().withColumn("hit", F.lit(True))
    wanted = t("documents").sparkSession.range(1, 301).select(F.col("id").cast("int").alias("num"))
    return wanted.join(seen, "num", "left").select("num", F.coalesce("hit", F.lit(False)).alias("present"))


@query("c12_corrections", """SELECT d.doc_id AS n, CASE WHEN k = 1 THEN replace(text, find, 'the the') ELSE text END AS text, CASE WHEN k = 1 THEN 1 ELSE 0 END AS n_flags, k AS occurrences
FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN split_part(text, ' ', 2) END AS find, CASE WHEN doc_id % 3 = 0 AND split_part(text, ' ', 2) <> '' THEN CAST((length(text) - length(replace(text, split_part(text, ' ', 2), ''))) / length(split_part(text, ' ', 2)) AS INT) END AS k FROM documents) d""")
def c12(t):
    clauses = t("documents").select(F.col("doc_id").alias("n"), "text", F.array().cast("array<string>").alias("flags"))
    fixes = t("documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("n"), F.split_part("text", F.lit(" "), F.lit(2)).alias("find"), F.lit("the the").alias("repl")).where("find <> ''")
    return dedupe.corrected(clauses, fixes, strict=False).select("n", "text", F.size("flags").alias("n_flags"), "occurrences")


FURNITURE = r"^[^ ]*$|\|"


@query("c13_furniture_rows", rf"WITH {LINE_CHUNKS} SELECT chunk_ord, text FROM line_chunks WHERE NOT regexp_matches(text, '{FURNITURE}')")
def c13(t):
    return line_chunks(t).where(~F.col("text").rlike(FURNITURE)).select("chunk_ord", "text")


@query("c14_duplicate_excerpts", f"WITH {LINE_CHUNKS} SELECT collection, chunk_ord, text FROM (SELECT *, row_number() OVER (PARTITION BY collection, text ORDER BY chunk_ord) AS r FROM line_chunks) WHERE r = 1")
def c14(t):
    w = Window.partitionBy("collection", F.xxhash64("text"), "text").orderBy("chunk_ord")
    return line_chunks(t).withColumn("r", F.row_number().over(w)).where("r = 1").select("collection", "chunk_ord", "text")


# Boxes: an order is a page, a line of it a box; quantity stands for height, discount and tax for places on it.
def boxes(t):
    return t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), (F.col("l_discount") * 1000 + F.col("l_tax") * 100).alias("x0"), (F.col("l_discount") * 1000 + F.col("l_tax") * 100 + 60).alias("x1"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 8).alias("y1"), (1 - F.col("l_tax") * 8).alias("conf"), F.concat_ws(" ", "l_linenumber", "l_returnflag", "l_linestatus").alias("text"))


BOXES = "boxes AS (SELECT l_orderkey AS page, l_linenumber AS box, l_discount * 1000 + l_tax * 100 AS x0, l_discount * 1000 + l_tax * 100 + 60 AS x1, l_quantity AS y0, l_quantity + 8 AS y1, 1 - l_tax * 8 AS conf, concat_ws(' ', l_linenumber, l_returnflag, l_linestatus) AS text FROM lineitem)"


@query("c15_low_confidence", f"WITH {BOXES} SELECT page, count(*) AS n_low, round(avg(conf), 6) AS avg_conf FROM boxes WHERE conf < 0.6 GROUP BY 1")
def c15(t):
    return boxes(t).where("conf < 0.6").groupBy("page").agg(F.count("*").alias("n_low"), F.round(F.avg("conf"), 6).alias("avg_conf"))


SECTIONED = "sectioned AS (SELECT doc_id, string_agg(CASE WHEN ix % 3 = 1 THEN 'Section ' || (ix + 1) || chr(10) || line ELSE line END, chr(10) ORDER BY ix) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ix FROM documents) GROUP BY 1)"


def sectioned(t):
    """Documents with a heading line before every third line."""
    made = F.transform(X.lines(F.col("text")), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit("\n"), x)).otherwise(x))
    return t("documents").select("doc_id", F.array_join(made, "\n").alias("text"))


def packing(name: str, source: str, keys: str, size: str = "500", overlap: int = 50, separator: str = "chr(10)") -> str:
    """CTEs (for WITH RECURSIVE) that give `name`(keys, parts): source.text packed as operators.chunk.packed packs it."""
    own = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"p.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    cuts = f"CAST(greatest(ceil((length(p) - size) / CAST(size - {overlap} AS DOUBLE)), 0) AS BIGINT)"
    return rf"""{name}_paras AS (SELECT {keys}, size, p, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM (SELECT {keys}, {size} AS size, regexp_replace(regexp_replace(unnest(string_split(text, {separator})), '^\s+', ''), '\s+$', '') AS p, generate_subscripts(string_split(text, {separator}), 1) AS i FROM {source}) WHERE p <> ''),
  {name}_fold AS (SELECT {keys}, CAST(0 AS BIGINT) AS r, n, CAST([] AS VARCHAR[]) AS done, '' AS cur FROM {name}_paras WHERE r = 1
    UNION ALL SELECT {own("f")}, p.r, p.n,
      CASE WHEN length(cur) + length(p) + 2 <= size THEN done ELSE list_concat(CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END, [p[i * (size - {overlap}) + 1 : i * (size - {overlap}) + size] for i in range(0, {cuts})]) END,
      CASE WHEN length(cur) + length(p) + 2 <= size THEN (CASE WHEN cur = '' THEN p ELSE cur || {separator} || p END) ELSE p[{cuts} * (size - {overlap}) + 1 :] END
    FROM {name}_fold f JOIN {name}_paras p ON {same} AND p.r = f.r + 1),
  {name} AS (SELECT {keys}, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS parts FROM {name}_fold WHERE r = n)"""


PIECES = "CAST(generate_subscripts(parts, 1) - 1 AS INT) AS ix, unnest(parts) AS piece"


@query("k1_recursive_split", f"WITH RECURSIVE {packing('packed', 'documents', 'doc_id')} SELECT doc_id, {PIECES} FROM packed")
def k1(t):
    return chunk.recursive_split(t("documents"), ["doc_id"], separator="\n")


UNITS = rf"""WITH {SECTIONED}, each AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM sectioned),
  heads AS (SELECT *, sum(CASE WHEN regexp_matches(line, '(?i)^Section [0-9]+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS unit FROM each),
  units AS (SELECT doc_id, unit, min(line) FILTER (regexp_matches(line, '(?i)^Section [0-9]+')) AS heading, trim(string_agg(line, chr(10) ORDER BY ln)) AS body FROM heads GROUP BY 1, 2 HAVING trim(string_agg(line, chr(10) ORDER BY ln)) <> '')"""


@query("k2_heading_units", f"{UNITS} SELECT doc_id, CAST(unit AS BIGINT) AS unit, heading, body FROM units")
def k2(t):
    return chunk.heading_units(sectioned(t), ["doc_id"], r"(?i)^Section [0-9]+")


@query("k2_section_split", f"""{UNITS.replace('WITH', 'WITH RECURSIVE', 1)}, {packing('packed', '(SELECT doc_id, unit, body AS text FROM units WHERE length(body) > 800)', 'doc_id, unit', '800', 50, 'chr(10) || chr(10)')}
SELECT doc_id, CAST(unit AS BIGINT) AS unit, {PIECES} FROM packed UNION ALL SELECT doc_id, CAST(unit AS BIGINT), 0, body FROM units WHERE length(body) <= 800""")
def k2b(t):
    return chunk.section_split(sectioned(t), ["doc_id"])


@query("k3_chapter_pack", f"""WITH RECURSIVE {LINE_CHUNKS}, s AS (SELECT doc_id AS chapter, ix AS num, min(text) AS body, length(min(text)) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS r FROM line_chunks GROUP BY 1, 2),
  f AS (SELECT chapter, num, r, 1 AS pack, n AS used, num IN (1, 2) AS closed FROM s WHERE r = 1
    UNION ALL SELECT s.chapter, s.num, s.r, CASE WHEN s.num IN (1, 2) OR closed OR used + n + 2 > 600 THEN pack + 1 ELSE pack END, CASE WHEN s.num IN (1, 2) OR closed OR used + n + 2 > 600 THEN n ELSE used + n + 2 END, s.num IN (1, 2) FROM f JOIN s ON s.chapter = f.chapter AND s.r = f.r + 1),
  g AS (SELECT chapter, pack, string_agg(CAST(num AS VARCHAR), ',' ORDER BY num) AS members, string_agg(body, chr(10) || chr(10) ORDER BY num) AS text FROM f JOIN s USING (chapter, num) GROUP BY 1, 2)
SELECT chapter, pack, members, 'Chapter ' || chapter || ' §' || members || ': ' AS label, text FROM g""")
def k3(t):
    sections = line_chunks(t).groupBy(F.col("doc_id").alias("chapter"), F.col("ix").alias("num")).agg(F.min("text").alias("body"))
    return chunk.chapter_pack(sections, 600, (1, 2))


@query("k4_titled_pieces", f"""WITH RECURSIVE {packing('packed', 'documents', 'doc_id', "greatest(500 - length('clause ' || doc_id) - 1, 100)", 0)}
SELECT doc_id, ix, 'clause ' || doc_id || chr(10) || piece AS piece FROM (SELECT doc_id, {PIECES} FROM packed)""")
def k4(t):
    return chunk.titled_pieces(t("documents").withColumn("header", F.concat(F.lit("clause "), F.col("doc_id").cast("string"))), ["doc_id"], "header", "text")


@query("k7_marker_region", r"SELECT doc_id, CAST(len(regexp_extract_all(text, 'licen[sc]e[d ]|Licensed')) AS INT) AS marker_count, CASE WHEN len(regexp_extract_all(text, 'licen[sc]e[d ]|Licensed')) = 1 THEN regexp_extract(text, '(?s)(licen[sc]e[d ]|Licensed).*') END AS region FROM documents")
def k7(t):
    return chunk.marker_region(t("documents").select("doc_id", "text"), r"licen[sc]e[d ]|Licensed", strict=False).select("doc_id", "marker_count", "region")


@query("k10_range_refs", """WITH s AS (SELECT item_id, 'see Sections ' || item_id || '-' || (item_id + item_id % 7) || ' and Section ' || (item_id * 3) || ' or section ' || item_id AS text FROM benchmark),
  f AS (SELECT item_id, list_distinct(CASE WHEN item_id % 7 <= 5 THEN list_concat(range(item_id, item_id + item_id % 7 + 1), [item_id * 3, item_id]) ELSE [item_id * 3, item_id] END) AS r, CASE WHEN item_id % 7 <= 5 THEN list_concat(range(item_id, item_id + item_id % 7 + 1), CASE WHEN item_id * 3 BETWEEN item_id AND item_id + item_id % 7 THEN [] ELSE [item_id * 3] END) ELSE CASE WHEN item_id = 0 THEN [0] ELSE [item_id * 3, item_id] END END AS o FROM s)
SELECT item_id, CASE WHEN len(r) BETWEEN 1 AND 4 THEN array_to_string(o, ',') ELSE 'general' END AS ref FROM f""")
def k10(t):
    text = F.expr("'see Sections ' || item_id || '-' || (item_id + item_id % 7) || ' and Section ' || (item_id * 3) || ' or section ' || item_id")
    return t("benchmark").select("item_id", X.range_refs(text).alias("ref"))


@query("k11_ref_nums", "SELECT doc_id, unnest([CAST(x AS INT) for x in regexp_extract_all('cl. ' || doc_id || ',' || (doc_id + 1), '[0-9]+')]) AS num FROM documents")
def k11(t):
    return t("documents").select("doc_id", F.explode(X.ref_nums(F.expr("'cl. ' || doc_id || ',' || (doc_id + 1)"))).alias("num"))


@query("k12_cite_tags", f"WITH {LINE_CHUNKS} SELECT chunk_ord, '[' || CASE collection WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE collection END || ' cl. ' || doc_id || ']' AS tag FROM line_chunks")
def k12(t):
    labels = t("documents").select(F.col("lang").alias("collection")).distinct().select("collection", F.when(F.col("collection") == "en", "English").when(F.col("collection") == "fr", "French").alias("label"))
    return chunk.cite_tag(line_chunks(t).withColumn("ref", F.expr("'cl. ' || doc_id")), labels).select("chunk_ord", "tag")


@query("k13_corpus", f"WITH {LINE_CHUNKS} SELECT collection, chunk_ord, 'cl. ' || doc_id AS ref, text FROM line_chunks UNION ALL SELECT 'bench', item_id, 'item ' || item_id, text FROM benchmark")
def k13(t):
    own = line_chunks(t).select("collection", "chunk_ord", F.expr("'cl. ' || doc_id").alias("ref"), "text")
    return own.unionByName(t("benchmark").select(F.lit("bench").alias("collection"), F.col("item_id").alias("chunk_ord"), F.expr("'item ' || item_id").alias("ref"), "text"))


@query("k14_corpus_digest", f"""WITH {LINE_CHUNKS}, b AS (SELECT doc_id // 100 AS block, sha256(string_agg(sha256(collection || chr(0) || text), '' ORDER BY chunk_ord)) AS h FROM line_chunks GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY block)) AS digest, count(*) AS blocks FROM b""")
def k14(t):
    return index.corpus_digest(line_chunks(t), ["chunk_ord"], ["collection", "text"], F.expr("doc_id div 100"))
