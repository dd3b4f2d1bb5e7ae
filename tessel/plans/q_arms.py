"""Arms: queries with and without expansion, turns with and without context, corpora before and after a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arms, converse, expand, route, search
from ..sources.scratch import written
from .base import index_of, query
from .q_evaluate import expected
from .q_more import LOW, bridge
from .q_search import FLOOR, HITS, JOINT, K, joint_chunks, queries_
from .q_turns import turns

CAPS = {"bridge1": 1, "bridge4": 4}
BRIDGED = f"""bridge AS (SELECT DISTINCT word, [left(word, 3), word[2:4]] AS ns FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) = 5), {LOW},
  btk AS (SELECT query_id, text, unnest(raw) AS tok, generate_subscripts(raw, 1) AS i FROM low), bm AS (SELECT query_id, text, i, coalesce(a.ns, b.ns) AS ns FROM btk LEFT JOIN bridge a ON a.word = tok LEFT JOIN bridge b ON b.word || 's' = tok WHERE a.ns IS NOT NULL OR b.ns IS NOT NULL),
  bf AS (SELECT query_id, text, i, unnest(ns) AS x, generate_subscripts(ns, 1) AS j FROM bm), bd AS (SELECT query_id, text, x, min(i * 10 + j) AS p FROM bf GROUP BY 1, 2, 3), bc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS r FROM bd),
  bt AS (SELECT query_id, 'bridge' || cap AS arm, string_agg(x, ' ' ORDER BY p) FILTER (r <= cap AND NOT list_contains(regexp_split_to_array(lower(text), '\\s+'), x)) AS terms FROM bc, (VALUES (1), (4)) v(cap) GROUP BY 1, 2),
  armed AS (SELECT 'none' AS arm, item_id AS id, text FROM benchmark UNION ALL SELECT v.arm, b.item_id, CASE WHEN coalesce(terms, '') <> '' THEN text || ' ' || terms ELSE text END FROM benchmark b CROSS JOIN (VALUES ('bridge1'), ('bridge4')) v(arm) LEFT JOIN bt ON bt.query_id = b.item_id AND bt.arm = v.arm),
  bench AS (SELECT arm || '/' || id AS query_id, text FROM armed)"""
BENCH = "bench AS (SELECT item_id AS query_id, text FROM benchmark)"
ARMED = HITS.replace(BENCH, BRIDGED) + f""", profile AS (SELECT arm, id AS query_id, count(h.score) AS n, coalesce(max(h.score), 0.0) AS top, coalesce(max(h.score), 0.0) < {FLOOR} AS refused FROM armed a LEFT JOIN hits h ON h.query_id = a.arm || '/' || a.id GROUP BY 1, 2)"""


def armed(t):
    terms = written(expand.bridged(queries_(t), bridge(t("documents"))), "bridged")
    return written(arms.expansion_arms(queries_(t), {"none": None, **{arm: expand.capped(terms, most) for arm, most in CAPS.items()}}), "armed")


def hits_of(t, asked):
    return search.top_k(arms.asked(asked), index_of(t), K)


@query("e17_expansion_arms", f"{ARMED} SELECT * FROM profile")
def e17(t):
    a = armed(t)
    return arms.profiles(a, hits_of(t, a), FLOOR)


@query("e24_score_profile", f"""{ARMED} SELECT p.arm, count(*) AS n, CAST(sum(CAST(p.refused = b.refused AS INT)) AS BIGINT) AS kept, CAST(sum(CAST(b.refused AND NOT p.refused AS INT)) AS BIGINT) AS opened, CAST(sum(CAST(p.refused AND NOT b.refused AS INT)) AS BIGINT) AS closed, round(avg(p.top - b.top), 6) AS mean_delta
FROM profile p JOIN profile b ON b.arm = 'none' AND b.query_id = p.query_id WHERE p.arm <> 'none' GROUP BY 1""")
def e24(t):
    a = armed(t)
    return arms.flips(arms.profiles(a, hits_of(t, a), FLOOR), "none")


@query("e16_arms", f"""{ARMED}, expected AS (SELECT DISTINCT item_id AS query_id, lang AS collection, doc_id AS num FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
  fa AS (SELECT DISTINCT split_part(query_id, '/', 1) AS arm, CAST(split_part(query_id, '/', 2) AS BIGINT) AS query_id, collection, chunk_ord, chunk_ord // 100000 AS num FROM hits),
  recs AS (SELECT a.id AS query_id, a.arm, coalesce(r.recall, 0) AS recall FROM armed a LEFT JOIN (SELECT e.query_id, x.arm, round(count(f.num) / count(*), 6) AS recall FROM expected e CROSS JOIN (VALUES ('none'), ('bridge4')) x(arm) LEFT JOIN (SELECT DISTINCT arm, query_id, collection, num FROM fa) f ON f.arm = x.arm AND f.query_id = e.query_id AND f.collection = e.collection AND f.num = e.num GROUP BY 1, 2) r ON r.query_id = a.id AND r.arm = a.arm),
  d AS (SELECT b.query_id, o.recall - b.recall AS d FROM recs b JOIN recs o USING (query_id) WHERE b.arm = 'none' AND o.arm = 'bridge4'),
  sets AS (SELECT arm, id AS query_id, coalesce((SELECT list(collection || chunk_ord ORDER BY collection, chunk_ord) FROM fa WHERE fa.arm = armed.arm AND fa.query_id = armed.id), []) AS s FROM armed),
  texts AS (SELECT b.id AS query_id, len(regexp_split_to_array(o.text, '\\s+')) - len(regexp_split_to_array(b.text, '\\s+')) AS more FROM armed b JOIN armed o USING (id) WHERE b.arm = 'none' AND o.arm = 'bridge4')
SELECT count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, count(*) FILTER (d = 0) AS tie, round(avg(d), 6) AS delta, (SELECT count(*) FROM texts WHERE more > 0) AS fired, CAST((SELECT sum(more) FROM texts) AS BIGINT) AS n_terms,
  (SELECT count(*) FROM sets b JOIN sets o USING (query_id) WHERE b.arm = 'none' AND o.arm = 'bridge4' AND b.s <> o.s) AS changed FROM d""")
def e16(t):
    """Queries as they stand against the same with up to four bridge terms."""
    terms = written(expand.bridge_terms(queries_(t), bridge(t("documents"))), "terms")
    a = arms.expansion_arms(queries_(t), {"none": None, "bridge4": terms})
    return arms.compared(queries_(t), hits_of(t, a), expected(t), terms, "none", "bridge4")


OK = f"ok AS (SELECT p.query_id FROM profile p JOIN profile b ON b.arm = 'none' AND b.query_id = p.query_id WHERE p.arm = 'bridge4' AND NOT p.refused AND NOT b.refused)"


@query("r14_gated_expansion", f"""{ARMED}, {OK} SELECT CAST(split_part(h.query_id, '/', 2) AS BIGINT) AS query_id, collection, chunk_ord, score, CASE WHEN o.query_id IS NULL THEN 'base' ELSE 'expanded' END AS arm
FROM hits h LEFT JOIN ok o ON o.query_id = CAST(split_part(h.query_id, '/', 2) AS BIGINT) WHERE split_part(h.query_id, '/', 1) = CASE WHEN o.query_id IS NULL THEN 'none' ELSE 'bridge4' END""")
def r14(t):
    index = index_of(t)
    more = search.top_k(expand.expanded(queries_(t), expand.bridge_terms(queries_(t), bridge(t("documents")))), index, K)
    return search.gate_expansion(search.top_k(queries_(t), index, K), more, FLOOR).select("query_id", "collection", "chunk_ord", "score", "arm")


@query("r19_effective_query", f"{ARMED}, {OK} SELECT id AS query_id, text, o.query_id IS NOT NULL AS expanded FROM armed a LEFT JOIN ok o ON o.query_id = a.id WHERE arm = CASE WHEN o.query_id IS NULL THEN 'none' ELSE 'bridge4' END")
def r19(t):
    """The text that is scored: the expanded one where both gates hold, else the query itself."""
    index, wide = index_of(t), written(expand.expanded(queries_(t), expand.bridge_terms(queries_(t), bridge(t("documents")))), "wide")
    ok = search.gate_expansion(search.top_k(queries_(t), index, K), search.top_k(wide, index, K), FLOOR).where("arm = 'expanded'").select("query_id").distinct().withColumn("expanded", F.lit(True))
    both = queries_(t).join(wide.withColumnRenamed("text", "wide"), "query_id").join(ok, "query_id", "left").withColumn("expanded", F.coalesce("expanded", F.lit(False)))
    return both.select("query_id", F.when(F.col("expanded"), F.col("wide")).otherwise(F.col("text")).alias("text"), "expanded")


LONG = JOINT.replace("AS ix FROM documents) WHERE text <> '')", "AS ix FROM documents) WHERE length(text) >= 60)")


@query("a13_top_changes", f"SELECT query_id, coalesce(b, 0.0) AS before, coalesce(a, 0.0) AS after, round(coalesce(a, 0.0) - coalesce(b, 0.0), 6) AS delta FROM ({JOINT} SELECT query_id, max(score) AS b FROM hits GROUP BY 1) FULL JOIN ({LONG} SELECT query_id, max(score) AS a FROM hits GROUP BY 1) USING (query_id)")
def a13(t):
    """The best score before and after lines of under 60 characters leave the corpus."""
    long = index_of(t, "joint-long", lambda t: joint_chunks(t).where("length(text) >= 60"))
    return arms.top_changes(*(search.top_k(queries_(t), index, 1) for index in (index_of(t, "joint", joint_chunks), long)))


SLOT = "CASE WHEN contains(lower({0}), 'tion') THEN 'tion' WHEN contains(lower({0}), 'que') THEN 'que' ELSE '' END"


@query("e26_slot_accuracy", f"""WITH s AS (SELECT conv_id, turn, nullif({SLOT.format('text')}, '') AS own FROM conversations), a AS (SELECT conv_id, turn, 'naive' AS arm, coalesce(own, '') AS what FROM s UNION ALL SELECT conv_id, turn, 'remembered', coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') FROM s),
  w AS (SELECT conv_id, turn, {SLOT.format("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' ' || text")} AS want FROM conversations) SELECT arm, count(*) AS n, count(*) FILTER (what = want) AS "right", round(count(*) FILTER (what = want) / count(*), 6) AS accuracy FROM a JOIN w USING (conv_id, turn) GROUP BY 1""")
def e26(t):
    """Slots of turns alone and with memory, against the slot of the turn and the one before it taken together."""
    from pyspark.sql import Window

    kinds = [("tion", "tion"), ("que", "que")]
    own = t("conversations").select("conv_id", "turn", route.first_slot(F.col("text"), kinds).alias("what"))
    both = own.select(F.lit("naive").alias("arm"), "conv_id", "turn", F.coalesce("what", F.lit("")).alias("what")).unionByName(converse.remembered(own, ["what"]).select(F.lit("remembered").alias("arm"), "conv_id", "turn", "what"))
    two = F.concat_ws(" ", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")), "text")
    want = t("conversations").select("conv_id", "turn", two.alias("two")).select("conv_id", "turn", F.coalesce(route.first_slot(F.col("two"), kinds), F.lit("")).alias("want"))
    return arms.slot_accuracy(both, want)
