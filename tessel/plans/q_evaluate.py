"""Evaluation and audit queries. A document that contains a benchmark passage, whole, is expected for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import shingles
from ..operators import contain, evaluate, order, search
from ..operators.sizes import small
from ..sources.scratch import written
from .base import LINE_CHUNKS, line_chunks, query
from .q_search import FLOOR, HITS, K, hits, merged, orders, queries_


def expected(t):
    """query_id, collection, num: documents that hold a whole passage; written, as most queries read them several times."""
    documents = t("documents")
    passages = t("benchmark").select(F.col("item_id").alias("needle"), F.col("text").alias("what"))
    met = contain.containing(passages, documents.select(F.col("doc_id").alias("id"), "text"))
    pairs = small(met.select(F.col("needle").alias("query_id"), F.col("id").alias("num"))).join(documents.select(F.col("doc_id").alias("num"), F.col("lang").alias("collection")), "num")
    return written(pairs.select("query_id", "collection", "num").distinct(), "expected")


EXPECTED = f"""{HITS}, expected AS (SELECT DISTINCT item_id AS query_id, lang AS collection, doc_id AS num FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
  found AS (SELECT query_id, collection, chunk_ord // 100000 AS num, chunk_ord, score, pos AS rank FROM merged)"""


def found(t, k=K, ranked=None):
    """ranked: merged(t, k), from a caller that reads it too."""
    return (merged(t, k) if ranked is None else ranked).select("query_id", "collection", F.expr("chunk_ord div 100000").alias("num"), "chunk_ord", "score", F.col("pos").alias("rank"))


def gates_of(t):
    some = expected(t).select("query_id").distinct().withColumn("gate", F.lit("answer"))
    return queries_(t).select("query_id").join(some, "query_id", "left").withColumn("gate", F.coalesce("gate", F.lit("refuse")))


GATES = "gates_ AS (SELECT item_id AS query_id, CASE WHEN item_id IN (SELECT query_id FROM expected) THEN 'answer' ELSE 'refuse' END AS gate FROM benchmark)"
TOPS = f"{GATES}, tops AS (SELECT query_id, gate, (SELECT max(score) FROM hits h WHERE h.query_id = g.query_id) AS top FROM gates_ g)"


@query("e1_unverifiable", f"{EXPECTED} SELECT query_id, collection, num + 1 AS num FROM expected WHERE (collection, num + 1) NOT IN (SELECT (collection, doc_id) FROM line_chunks)")
def e1(t):
    return evaluate.unverifiable(expected(t).withColumn("num", F.col("num") + 1), line_chunks(t).withColumnRenamed("doc_id", "num")).select("query_id", "collection", "num")


RECALL = f"{EXPECTED}, r AS (SELECT e.query_id, count(*) AS n_expected, count(f.num) AS n_found FROM expected e LEFT JOIN (SELECT DISTINCT query_id, collection, num FROM found) f USING (query_id, collection, num) GROUP BY 1), rec AS (SELECT item_id AS query_id, coalesce(n_expected, 0) AS n_expected, coalesce(n_found, 0) AS n_found, round(n_found / n_expected, 6) AS recall FROM benchmark LEFT JOIN r ON r.query_id = item_id)"


@query("e2_recall", f"{RECALL} SELECT * FROM rec")
def e2(t):
    return evaluate.recall(expected(t), found(t), queries_(t))


def covers(wanted, hits_):
    """Which hits (query_id, num, rank) cover which expected pairs (wanted): by number modulo 7, so that hits cover several."""
    pair = wanted.select("query_id", F.col("num").alias("pair"), (F.col("num") % 7).alias("m"))
    return pair.join(hits_.select("query_id", "rank", (F.col("num") % 7).alias("m")), ["query_id", "m"], "left").select("query_id", "pair", "rank")


def strict_sql(hits_: str, depths: list[int]) -> str:
    """CTE strict(query_id, depth, n, matched): by Hall's theorem over all subsets of a query's pairs."""
    return f"""cov AS (SELECT e.query_id, e.num AS pair, f.rank FROM expected e LEFT JOIN {hits_} f ON e.query_id = f.query_id AND e.num % 7 = f.num % 7), depths AS (SELECT unnest({depths}) AS depth),
  bits AS (SELECT query_id, pair, row_number() OVER (PARTITION BY query_id ORDER BY pair) - 1 AS bit FROM (SELECT DISTINCT query_id, pair FROM cov)), n AS (SELECT query_id, count(*) AS n FROM bits GROUP BY 1),
  masks AS (SELECT query_id, depth, rank, sum(1 << CAST(bit AS INT)) AS mask FROM cov JOIN bits USING (query_id, pair), depths WHERE rank <= depth GROUP BY ALL), subsets AS (SELECT query_id, n, unnest(range(0, 1 << CAST(n AS INT))) AS s FROM n),
  lacks AS (SELECT x.query_id, n, depth, bit_count(s) - (SELECT count(*) FROM masks m WHERE m.query_id = x.query_id AND m.depth = d.depth AND (CAST(m.mask AS BIGINT) & s) <> 0) AS lack FROM subsets x, depths d),
  strict AS (SELECT query_id, depth, n, CAST(n - max(lack) AS BIGINT) AS matched FROM lacks GROUP BY query_id, depth, n)"""


@query("e3_strict_recall", f"{EXPECTED}, {strict_sql('found', [1000])} SELECT query_id, matched FROM strict")
def e3(t):
    return evaluate.strict_matched(covers(expected(t), found(t)).withColumnRenamed("rank", "hit"))


@query("e4_precision", f"{EXPECTED} SELECT query_id, round(avg(CASE WHEN (query_id, collection, num) IN (SELECT (query_id, collection, num) FROM expected) THEN 1.0 ELSE 0.0 END), 6) AS precision_ FROM found WHERE query_id IN (SELECT query_id FROM expected) GROUP BY 1")
def e4(t):
    e = expected(t)
    h = found(t).join(e.select("query_id").distinct(), "query_id", "left_semi").join(e.withColumn("hit", F.lit(1.0)), ["query_id", "collection", "num"], "left")
    return h.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("precision_"))


DEPTHS = [3, 6, 10, 20, 60]
WIDE = EXPECTED.replace(f"rank <= {K})", "rank <= 15)")


@query("e5_recall_curve", f"""{WIDE}, m AS (SELECT e.query_id, f.rank FROM expected e LEFT JOIN (SELECT query_id, collection, num, min(rank) AS rank FROM found GROUP BY 1, 2, 3) f USING (query_id, collection, num)), {strict_sql('found', DEPTHS)},
  plain AS (SELECT query_id, {', '.join(f'round(avg(CASE WHEN rank <= {d} THEN 1.0 ELSE 0 END), 6) AS r{d}' for d in DEPTHS)} FROM m GROUP BY 1)
SELECT p.*, {', '.join(f'max(round(matched / n, 6)) FILTER (depth = {d}) AS s{d}' for d in DEPTHS)} FROM plain p JOIN strict USING (query_id) GROUP BY ALL""")
def e5(t):
    """Plain and strict recall at five depths of one ranking."""
    wide, wanted = found(t, 15), expected(t)
    return evaluate.recall_curve(wanted, wide, DEPTHS).join(evaluate.strict_curve(covers(wanted, wide), DEPTHS), "query_id")


FIRST = f"{EXPECTED}, fr AS (SELECT e.query_id, min(f.rank) AS first_rank FROM (SELECT DISTINCT * FROM expected) e LEFT JOIN found f USING (query_id, collection, num) GROUP BY 1)"


@query("e6_first_ranks", f"{FIRST} SELECT query_id, first_rank, round(coalesce(1.0 / first_rank, 0), 6) AS rr, first_rank IS NOT NULL AS found FROM fr")
def e6(t):
    return evaluate.first_ranks(expected(t), found(t))


@query("e6_median_rank", f"{FIRST} SELECT list_sort(list(first_rank))[len(list(first_rank)) // 2 + 1] AS median_rank FROM fr WHERE first_rank IS NOT NULL")
def e6b(t):
    return evaluate.first_ranks(expected(t), found(t)).where("found").agg(evaluate.upper_median("first_rank").alias("median_rank"))


@query("e7_shown", f"""{FIRST}, shown AS (SELECT query_id, collection, chunk_ord // 100000 AS num, final_rank AS rank, score FROM chosen WHERE score >= {FLOOR}), {strict_sql('shown', [3])},
  base AS (SELECT query_id, count(*) AS shown, count(*) <= 2 AS few, round(coalesce(max(CASE WHEN first_rank = rank THEN 1.0 / rank END), 0), 6) AS rr_shown FROM shown LEFT JOIN fr USING (query_id) GROUP BY 1),
  h AS (SELECT DISTINCT query_id, true AS hit3 FROM shown JOIN expected USING (query_id, collection, num) WHERE rank <= 3)
SELECT query_id, shown, few, rr_shown, coalesce(hit3, false) AS hit3, round(matched / n, 6) AS strict3 FROM base LEFT JOIN h USING (query_id) LEFT JOIN strict USING (query_id)""")
def e7(t):
    """Metrics of what is shown: the list cut at the floor."""
    ranked, wanted = merged(t), expected(t)
    shown = search.select_top(ranked, 12, 1, FLOOR).where(F.col("score") >= FLOOR).select("query_id", "collection", F.expr("chunk_ord div 100000").alias("num"), F.col("final_rank").alias("rank"))
    return evaluate.shown_metrics(shown, evaluate.first_ranks(wanted, found(t, ranked=ranked)), wanted, evaluate.strict_curve(covers(wanted, shown), [3]))


@query("e8_grouped_means", "SELECT quality, toxic, round(avg(n_chars), 6) AS mean_n_chars, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((quality), (quality, toxic))")
def e8(t):
    return evaluate.grouped_means(t("documents").join(t("labels"), "doc_id"), ["quality", "toxic"], ["n_chars"])


@query("e9_refusal_errors", f"{EXPECTED}, {TOPS}, w AS (SELECT *, (coalesce(top, 0) < {FLOOR}) <> (gate = 'refuse') AS wrong FROM tops) SELECT gate, count(*) AS n, CAST(sum(wrong::INT) AS BIGINT) AS n_wrong, round(avg(wrong::INT), 6) AS rate, coalesce(string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) FILTER (wrong), '') AS offenders FROM w GROUP BY 1")
def e9(t):
    return evaluate.refusal_errors(search.refusals(queries_(t), hits(t), FLOOR), gates_of(t))


@query("e18_width_ladder", f"{HITS} SELECT k, collection, count(*) AS shown, round(count(*) / sum(count(*)) OVER (PARTITION BY k), 6) AS share FROM hits, (SELECT unnest([1, 2, 4]) AS k) WHERE rank <= k GROUP BY 1, 2")
def e18(t):
    grid = F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("k")
    by = hits(t).select("collection", "rank", grid).where("rank <= k").groupBy("k", "collection").agg(F.count("*").alias("shown"))
    total = by.groupBy("k").agg(F.sum("shown").alias("total"))
    return by.join(total, "k").select("k", "collection", "shown", F.round(F.col("shown") / F.col("total"), 6).alias("share"))


@query("e19_expected_mix", f"{EXPECTED} SELECT collection, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM expected GROUP BY 1")
def e19(t):
    by = expected(t).groupBy("collection").agg(F.count("*").alias("n"))
    return by.join(by.agg(F.sum("n").alias("total")), F.lit(True)).select("collection", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("e20_invariance", f"{HITS}, s AS (SELECT query_id, max(score) >= {FLOOR} AS shown_ok FROM chosen GROUP BY 1), p AS (SELECT query_id, max(score) >= {FLOOR} AS pool_ok FROM scored GROUP BY 1) SELECT query_id, shown_ok, pool_ok FROM s FULL JOIN p USING (query_id) WHERE coalesce(shown_ok, false) <> coalesce(pool_ok, false)")
def e20(t):
    h = hits(t)
    return evaluate.invariance_breaks(search.select_top(merged(t, found=h), 12, 1, FLOOR), h, FLOOR)


@query("e22_calibration", f"{EXPECTED}, {TOPS} SELECT min(top) FILTER (gate = 'answer') AS weakest_in, max(top) FILTER (gate = 'refuse') AS strongest_off, min(top) FILTER (gate = 'answer') < max(top) FILTER (gate = 'refuse') AS inverted FROM tops")
def e22(t):
    return evaluate.calibration(search.refusals(queries_(t), hits(t), FLOOR).join(gates_of(t), "query_id"))


@query("e23_version_flips", f"{HITS}, v1 AS (SELECT query_id, max(score) AS a FROM hits WHERE collection = 'en' GROUP BY 1), v2 AS (SELECT query_id, max(score) AS b FROM hits GROUP BY 1) SELECT query_id, coalesce(a, 0) >= {FLOOR} AS before, coalesce(b, 0) >= {FLOOR} AS after_ FROM v1 FULL JOIN v2 USING (query_id) WHERE (coalesce(a, 0) >= {FLOOR}) <> (coalesce(b, 0) >= {FLOOR})")
def e23(t):
    h = hits(t)
    top = lambda df, c: df.groupBy("query_id").agg((F.max("score") >= FLOOR).alias(c))
    both = top(h.where("collection = 'en'"), "before").join(top(h, "after_"), "query_id", "full").na.fill(False)
    return both.where("before <> after_")


@query("e23_version_refs", f"""{HITS}, lists AS (SELECT v, query_id, collection, chunk_ord // 100000 AS num, row_number() OVER (PARTITION BY v, query_id ORDER BY score DESC, collection_ord, rank) AS p FROM hits JOIN orders USING (collection), (VALUES ('before'), ('after')) x(v) WHERE v = 'after' OR collection <> 'de'),
  refs AS (SELECT query_id, collection, num, max((v = 'before')::INT) AS b, max((v = 'after')::INT) AS a FROM lists WHERE p <= 6 GROUP BY 1, 2, 3)
SELECT query_id, count(*) FILTER (a = 0) AS n_lost, count(*) FILTER (b = 0) AS n_gained, count(*) FILTER (a = 1 AND b = 1) AS n_kept FROM refs GROUP BY 1""")
def e23r(t):
    """References in the first six places, before the corpus had its German texts and after."""
    h, o = hits(t), orders(t)
    six = lambda df: search.merge_ranked(df, o).where("pos <= 6").select("query_id", "collection", F.expr("chunk_ord div 100000").alias("num"))
    return evaluate.version_changes(six(h.where("collection <> 'de'")), six(h))


@query("e27_regression_guard", "SELECT lang AS name, CAST(count(*) AS DOUBLE) AS value, CAST(150 AS DOUBLE) AS baseline, count(*) >= 149.995 AS ok FROM documents GROUP BY 1")
def e27(t):
    m = t("documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").cast("double").alias("value"))
    return evaluate.guard(m, m.select("name", F.lit(150.0).alias("baseline")), strict=False)


@query("e28_set_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ROLLUP (quality, toxic)")
def e28(t):
    return t("labels").rollup("quality", "toxic").agg(F.count("*").alias("n"))


@query("e30_work_selection", f"{RECALL} SELECT query_id, r FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) AS r FROM rec WHERE recall = 1) WHERE r <= 5")
def e30(t):
    full = evaluate.recall(expected(t), found(t), queries_(t)).where("recall = 1")
    return order.numbered(full.select("query_id").orderBy("query_id").limit(5), "query_id", name="r")  # each task cuts to five first


# Audit of the chunk table.
REFS = "(SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'general' WHEN doc_id % 10 = 1 THEN 'cl. ' || doc_id || ',' || (doc_id + 1) ELSE 'cl. ' || doc_id END AS ref FROM line_chunks)"


def reffed(t):
    return line_chunks(t).withColumn("ref", F.expr("CASE WHEN doc_id % 10 = 0 THEN 'general' WHEN doc_id % 10 = 1 THEN 'cl. ' || doc_id || ',' || (doc_id + 1) ELSE 'cl. ' || doc_id END"))


SHAPE = f"WITH {LINE_CHUNKS}, z AS (SELECT collection, length(text) AS n, len(regexp_extract_all(ref, '[0-9]+')) AS k FROM {REFS}), sh AS (SELECT collection, count(*) AS n, round(100 * avg((k = 0)::INT), 6) AS uncitable_pct, round(100 * avg((k > 1)::INT), 6) AS packed_pct, CAST(min(n) AS INT) AS min_len, CAST(list_sort(list(n))[len(list(n)) // 2 + 1] AS INT) AS median_len, CAST(max(n) AS INT) AS max_len, CAST(sum((n > 500)::INT) AS BIGINT) AS over_cap FROM z GROUP BY 1)"


@query("a1_shape", f"{SHAPE} SELECT * FROM sh")
def a1(t):
    return evaluate.shape(reffed(t), "collection", "ref", 500)


@query("a2_histogram", f"WITH {LINE_CHUNKS} SELECT collection, CAST(CASE WHEN length(text) > 500 THEN 5 ELSE least(floor((length(text) - 1) * 5 / 500), 4) END AS INT) AS bucket, count(*) AS n FROM line_chunks GROUP BY 1, 2")
def a2(t):
    return evaluate.length_histogram(line_chunks(t), "collection", 500)


@query("a3_missing_refs", f"WITH {LINE_CHUNKS}, h AS (SELECT DISTINCT unnest([CAST(x AS BIGINT) for x in regexp_extract_all(ref, '[0-9]+')]) AS num FROM {REFS}) SELECT r.n AS num FROM range(0, 1000) r(n) WHERE r.n NOT IN (SELECT num FROM h)")
def a3(t):
    have = reffed(t).select(F.explode(F.regexp_extract_all("ref", F.lit("[0-9]+"), F.lit(0))).alias("num")).select(F.col("num").cast("long"))
    return t("documents").sparkSession.range(1000).select(F.col("id").alias("num")).join(have.distinct(), "num", "left_anti")


@query("a6_row_spans", f"WITH {LINE_CHUNKS} SELECT collection, CAST(sum(regexp_matches(text, '^[0-9+]')::INT) AS BIGINT) AS n FROM line_chunks GROUP BY 1")
def a6(t):
    return line_chunks(t).groupBy("collection").agg(F.sum(F.col("text").rlike("^[0-9+]").cast("long")).alias("n"))


@query("a8_gates", f"{SHAPE} SELECT 'over_cap' AS name, collection, CAST(over_cap AS DOUBLE) AS value, CAST(100 AS DOUBLE) AS most, collection <> 'fr' AS gated, collection = 'fr' OR over_cap <= 100 AS ok FROM sh")
def a8(t):
    m = evaluate.shape(reffed(t), "collection", "ref", 500).select(F.lit("over_cap").alias("name"), "collection", F.col("over_cap").cast("double").alias("value"))
    return evaluate.gates(m, m.select("name", "collection", F.lit(100.0).alias("most"), (F.col("collection") != "fr").alias("gated")))


@query("a9_pins", "SELECT lang AS name, count(*) AS value, CASE WHEN lang = 'en' THEN count(*) ELSE 1 END AS pinned FROM documents GROUP BY 1 HAVING lang <> 'en'")
def a9(t):
    m = t("documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("value"))
    return evaluate.pin_differences(m, m.select("name", F.when(F.col("name") == "en", F.col("value")).otherwise(F.lit(1).cast("long")).alias("value")))


@query("a10_coverage", """WITH s AS (SELECT item_id AS id, unnest(CASE WHEN length(text) <= 10 THEN [text] ELSE list_distinct([text[i:i+9] for i in range(1, length(text) - 8, 2)]) END) AS sh FROM benchmark),
  d AS (SELECT DISTINCT unnest(CASE WHEN length(text) <= 10 THEN [text] ELSE list_distinct([text[i:i+9] for i in range(1, length(text) - 8)]) END) AS sh FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents WHERE doc_id % 2 = 0) WHERE text <> ''),
  m AS (SELECT id, round(count(d.sh) / count(*), 6) AS share FROM s LEFT JOIN d USING (sh) GROUP BY 1) SELECT id, share, CASE WHEN share >= 0.85 THEN 'agree' WHEN share < 0.55 THEN 'large' ELSE 'partial' END AS verdict FROM m""")
def a10(t):
    other = line_chunks(t).where("doc_id % 2 = 0").select(F.explode(shingles(F.col("text"), 10, 1)).alias("sh"))
    return evaluate.coverage(t("benchmark").select(F.col("item_id").alias("id"), "text"), other, shingles(F.col("text"), 10, 2))


@query("a11_stage_stats", f"WITH {LINE_CHUNKS} SELECT 'raw' AS stage, lang AS collection, count(*) AS n, round(avg(length(text)), 6) AS mean_len, CAST(max(length(text)) AS INT) AS max_len FROM documents GROUP BY 2 UNION ALL SELECT 'lines', collection, count(*), round(avg(length(text)), 6), CAST(max(length(text)) AS INT) FROM line_chunks GROUP BY 2")
def a11(t):
    both = t("documents").select(F.lit("raw").alias("stage"), F.col("lang").alias("collection"), F.length("text").alias("n")).unionByName(line_chunks(t).select(F.lit("lines").alias("stage"), "collection", F.length("text").alias("n")))
    return both.groupBy("stage", "collection").agg(F.count("*").alias("c"), F.round(F.avg("n"), 6).alias("mean_len"), F.max("n").alias("max_len")).withColumnRenamed("c", "n")
