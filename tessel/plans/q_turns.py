"""Routing, directory and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..operators import converse, directory, route
from .base import LINE_CHUNKS, STOP_STEMS, line_chunks, query, stemmed  # noqa: F401

CUES = {"legal": ["than the", r"\bthe\b", r"\bof\b", r"\bley?\b"], "intent": ["in the", r"\bthat\b", r"\bque\b"], "entity": [r"\bder\b", r"\bwas\b", "de la"]}
SCORED = r"""WITH base AS (SELECT item_id AS query_id, regexp_replace(text, '[^ -~]', 'x', 'g') AS text FROM benchmark),
  m1 AS (SELECT *, regexp_matches(text, '(?i)than the') AS l0, regexp_replace(text, '(?i)than the', '        ') AS lt, regexp_matches(text, '(?i)in the') AS i0, regexp_replace(text, '(?i)in the', '      ') AS it, regexp_matches(text, '(?i)de la') AS e0, regexp_replace(text, '(?i)de la', '     ') AS et FROM base),
  scored AS (SELECT query_id, text, l0::INT * 2 + regexp_matches(lt, '(?i)\bthe\b')::INT + regexp_matches(lt, '(?i)\bof\b')::INT + regexp_matches(lt, '(?i)\bley?\b')::INT AS legal,
    i0::INT * 2 + regexp_matches(it, '(?i)\bthat\b')::INT + regexp_matches(it, '(?i)\bque\b')::INT AS intent, e0::INT * 2 + regexp_matches(et, '(?i)\bder\b')::INT + regexp_matches(et, '(?i)\bwas\b')::INT AS entity FROM m1),
  helped AS (SELECT query_id, text, legal, intent + entity AS help_raw, CASE WHEN intent > 0 THEN intent + entity ELSE 0 END AS help FROM scored),
  routed AS (SELECT *, CASE WHEN legal = help THEN 'clarify' WHEN legal > help THEN 'legal' ELSE 'help' END AS "primary", CASE WHEN legal <> help AND legal > 0 AND help > 0 THEN CASE WHEN legal > help THEN 'help' ELSE 'legal' END END AS secondary FROM helped)"""


def asked(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace("text", "[^ -~]", "x").alias("text"))


def routed(t):
    return route.routed(route.scores(asked(t), CUES))


@query("q1_cue_scores", f"{SCORED} SELECT query_id, legal, help_raw, help FROM helped")
def q1(t):
    return route.scores(asked(t), CUES).select("query_id", "legal", "help_raw", "help")


@query("q2_masked_scores", rf"""WITH {LINE_CHUNKS} SELECT chunk_ord, regexp_matches(text, '(?i)of the')::INT * 2 + regexp_matches(regexp_replace(text, '(?i)of the', '      '), '(?i)\bthe\b')::INT AS score FROM line_chunks""")
def q2(t):
    return line_chunks(t).select("chunk_ord", route.cue_score(F.col("text"), ["of the", r"\bthe\b"]).alias("score"))


@query("q3_routes", f'{SCORED} SELECT query_id, "primary", secondary FROM routed')
def q3(t):
    return routed(t).select("query_id", "primary", "secondary")


GREETED = "CASE WHEN item_id % 4 = 0 THEN 'Good Morning' WHEN item_id % 4 = 1 THEN 'good' WHEN item_id % 4 = 2 THEN 'hi, hello' ELSE text END"


@query("q4_greetings", f"""WITH g AS (SELECT item_id AS query_id, regexp_extract_all(lower({GREETED}), '[a-z]+') AS w FROM benchmark)
SELECT query_id, len(w) > 0 AND len(list_intersect(list_distinct(w), ['hi', 'hello', 'hey', 'good', 'morning', 'afternoon', 'evening'])) = len(list_distinct(w)) AND (NOT list_contains(w, 'good') OR list_has_any(w, ['morning', 'afternoon', 'evening'])) AS greeting FROM g""")
def q4(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), route.is_greeting(F.expr(GREETED)).alias("greeting"))


SLOTS = [("disgusting", "a"), ("idiot", "b"), ("moron", "c"), ("clown", "d")]
PLACES = [("stupid", "s"), ("loser", "l")]


@query("q5_slots", r"""SELECT doc_id, CASE WHEN contains(lower(text), 'disgusting') THEN 'a' WHEN contains(lower(text), 'idiot') THEN 'b' WHEN contains(lower(text), 'moron') THEN 'c' WHEN contains(lower(text), 'clown') THEN 'd' ELSE '' END AS what,
  CASE WHEN regexp_matches(lower(text), '\bstupid\b') THEN 's' WHEN regexp_matches(lower(text), '\bloser\b') THEN 'l' ELSE '' END AS place FROM documents""")
def q5(t):
    return t("documents").select("doc_id", route.first_slot(F.col("text"), SLOTS).alias("what"), route.first_slot(F.col("text"), PLACES, True).alias("place"))


@query("q6_modes", f"""{SCORED} SELECT query_id, coalesce(CASE WHEN query_id % 5 = 0 THEN 'help' END, "primary") AS mode FROM routed""")
def q6(t):
    return route.effective_mode(routed(t).withColumn("forced", F.when(F.col("query_id") % 5 == 0, "help")), "forced").select("query_id", "mode")


@query("q7_dispatch", f"""{SCORED} SELECT query_id, "primary" AS branch FROM routed WHERE "primary" <> 'clarify' UNION ALL SELECT query_id, secondary FROM routed WHERE secondary IS NOT NULL""")
def q7(t):
    return route.dispatch(routed(t))


# The directory: parts, with the type as focus, the brand as place and a made phone.
def listing(t):
    return t("part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.regexp_replace("p_type", " ", ";").alias("focus"), F.col("p_brand").alias("location"), F.when(F.col("p_size") % 17 == 0, "").otherwise(F.expr("'0803 ' || (1000000 + p_partkey * 7919 % 9000000)")).alias("phone"))


LISTING = "listing AS (SELECT p_partkey AS pos, p_name AS name, replace(p_type, ' ', ';') AS focus, p_brand AS location, CASE WHEN p_size % 17 = 0 THEN '' ELSE '0803 ' || (1000000 + p_partkey * 7919 % 9000000) END AS phone FROM part)"
WANTED = "wanted AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN 'standard' WHEN 1 THEN 'economy' WHEN 2 THEN 'econmy' WHEN 3 THEN '' ELSE 'zzzz' END AS category, CASE n_nationkey % 3 WHEN 0 THEN 'Brand#1' WHEN 1 THEN '' ELSE 'Nowhere' END AS place FROM nation)"


def wanted(t):
    return t("nation").select(F.col("n_nationkey").alias("query_id"), F.expr("CASE n_nationkey % 5 WHEN 0 THEN 'standard' WHEN 1 THEN 'economy' WHEN 2 THEN 'econmy' WHEN 3 THEN '' ELSE 'zzzz' END").alias("category"), F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'Brand#1' WHEN 1 THEN '' ELSE 'Nowhere' END").alias("place"))


SUBS = f"""WITH {LISTING}, {WANTED}, low AS (SELECT pos, lower(focus) AS f, string_split(lower(focus), ';') AS parts FROM listing),
  subs AS (SELECT query_id, pos, CASE WHEN len(parts) <= 1 OR contains(parts[1], lower(category)) THEN 1.0 ELSE 0.9 END::DOUBLE AS score, len(parts) <= 1 AS single FROM wanted JOIN low ON contains(f, lower(category)) WHERE category <> ''),
  tok AS (SELECT pos, len(string_split(focus, ';')) <= 1 AS single, unnest(list_distinct(regexp_extract_all(lower(focus), '[a-z0-9]+'))) AS dt FROM listing),
  fuzzy AS (SELECT query_id, pos, max(round(1 - levenshtein(category, dt) / greatest(length(category), length(dt)), 6)) AS score, any_value(single) AS single FROM wanted, tok WHERE category <> '' AND round(1 - levenshtein(category, dt) / greatest(length(category), length(dt)), 6) >= 0.6 GROUP BY ALL),
  both_ AS (SELECT *, 'substring' AS how FROM subs UNION ALL SELECT *, 'fuzzy' FROM fuzzy WHERE query_id NOT IN (SELECT query_id FROM subs)),
  ranking AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 3) DESC, single DESC, pos) AS rank FROM both_)"""


@query("d1_contact_violations", f"WITH {LISTING} SELECT pos, name, phone FROM listing WHERE trim(phone) = '' OR regexp_matches(phone, '0{{3,}}')")
def d1(t):
    return directory.violations(listing(t), ["0{3,}"])


@query("d2_head_rows", f"""WITH {LISTING}, h AS (SELECT query_id, 0 AS part, pos AS ord, name, phone FROM (SELECT n_nationkey AS query_id FROM nation), listing WHERE pos <= 2 UNION ALL SELECT n_nationkey, 1, pos, name, phone FROM nation JOIN listing ON pos % 25 = n_nationkey),
  f AS (SELECT *, row_number() OVER (PARTITION BY query_id, name, phone ORDER BY part, ord) AS r FROM h) SELECT query_id, name, phone, row_number() OVER (PARTITION BY query_id ORDER BY part, ord) AS line FROM f WHERE r = 1""")
def d2(t):
    rows = listing(t).select(F.expr("cast(pos % 25 as int)").alias("query_id"), F.col("pos").alias("ord"), "name", "phone")
    head = t("nation").select(F.col("n_nationkey").alias("query_id")).join(F.broadcast(listing(t).where("pos <= 2").select(F.col("pos").alias("ord"), "name", "phone")), F.lit(True))
    return directory.with_head(head, rows.join(t("nation").select(F.col("n_nationkey").alias("query_id")), "query_id", "left_semi"))


@query("d3_substring_hits", f"{SUBS} SELECT query_id, pos, score, single FROM subs")
def d3(t):
    return directory.substring_hits(wanted(t), listing(t))


@query("d4_fuzzy_hits", f"{SUBS} SELECT query_id, pos, score, single FROM fuzzy")
def d4(t):
    return directory.fuzzy_hits(wanted(t), listing(t), method="levenshtein")


@query("d4_fuzzy_hits_exact")
def d4x(t):
    return directory.fuzzy_hits(wanted(t), listing(t))


@query("d5_aliases", f"WITH {LISTING} SELECT pos, name || CASE WHEN contains(lower(name), 'red') THEN ' crimson scarlet' ELSE '' END AS enriched FROM listing")
def d5(t):
    return listing(t).select("pos", F.concat("name", F.when(F.lower("name").contains("red"), " crimson scarlet").otherwise("")).alias("enriched"))


LOCATED = f"""{LISTING}, {WANTED}, lt AS (SELECT DISTINCT lower(location) AS low, unnest(regexp_extract_all(lower(location), '[a-z0-9]+')) AS w FROM listing), pt AS (SELECT DISTINCT lower(place) AS q, unnest(regexp_extract_all(lower(place), '[a-z0-9]+')) AS w FROM wanted),
  near AS (SELECT DISTINCT q, low FROM pt, lt WHERE round(1 - levenshtein(pt.w, lt.w) / greatest(length(pt.w), length(lt.w)), 6) >= 0.6),
  located AS (SELECT query_id, pos, how FROM (SELECT query_id, pos, CASE WHEN contains(lower(location), lower(place)) THEN 'substring' WHEN round(1 - levenshtein(lower(place), lower(location)) / greatest(length(place), length(location)), 6) >= 0.6 OR (lower(place), lower(location)) IN (SELECT (q, low) FROM near) THEN 'fuzzy' END AS how FROM wanted, listing WHERE place <> '') WHERE how IS NOT NULL)"""


@query("d6_located", f"WITH {LOCATED} SELECT query_id, pos, how FROM located")
def d6(t):
    return directory.located(wanted(t), listing(t), "levenshtein")


@query("d7_ranking", f"{SUBS} SELECT query_id, pos, score, how, rank FROM ranking")
def d7(t):
    return directory.ranked(wanted(t), listing(t), method="levenshtein").select("query_id", "pos", "score", "how", "rank")


@query("d8_lookup", f"""{SUBS.replace(f'{LISTING}, {WANTED}', LOCATED)}, cand AS (SELECT query_id, pos, rank FROM ranking UNION ALL SELECT query_id, pos, pos FROM wanted, listing WHERE category = ''),
  met AS (SELECT c.query_id, c.pos, c.rank, l.pos IS NOT NULL AS there, bool_or(l.pos IS NOT NULL) OVER (PARTITION BY c.query_id) AS any_, w.category, w.place FROM cand c JOIN wanted w USING (query_id) LEFT JOIN located l ON l.query_id = c.query_id AND l.pos = c.pos),
  best AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS rank, CASE WHEN place = '' THEN 'no place' WHEN any_ THEN 'place matched' ELSE 'place ignored' END AS note FROM met WHERE place = '' OR there OR (NOT any_ AND category <> ''))
SELECT query_id, pos, rank, note FROM best WHERE rank <= 5 UNION ALL SELECT query_id, 1, 1, 'fallback' FROM wanted WHERE query_id NOT IN (SELECT query_id FROM best)""")
def d8(t):
    return directory.lookup(wanted(t), listing(t), fallback=1, method="levenshtein")


TYPES = {"metal": ["steel", "copper", "brass", "tin", "nickel"], "small": ["small", "economy"], "shiny": ["polished", "burnished", "anodized", "plated"]}
TYPED = """list_filter([CASE WHEN regexp_matches(lower(focus), 'steel|copper|brass|tin|nickel') THEN 'metal' END, CASE WHEN regexp_matches(lower(focus), 'small|economy') THEN 'small' END, CASE WHEN regexp_matches(lower(focus), 'polished|burnished|anodized|plated') THEN 'shiny' END], lambda x: x IS NOT NULL)"""


def typed(t):
    places = F.when(F.col("location").endswith("1"), F.array(F.lit("*"))).otherwise(F.array("location"))
    return listing(t).withColumn("types", directory.labels_of(F.col("focus"), TYPES, "standard")).withColumn("places", places)


@query("d9_types", f"WITH {LISTING} SELECT pos, array_to_string(CASE WHEN contains(lower(focus), 'standard') THEN ['*'] ELSE {TYPED} END, ',') AS types FROM listing")
def d9(t):
    return typed(t).select("pos", F.array_join("types", ",").alias("types"))


@query("d10_places", rf"WITH {LISTING} SELECT pos, array_to_string(list_filter([CASE WHEN regexp_matches(lower(location), '\bbrand\b') THEN 'Brand' END, CASE WHEN regexp_matches(lower(location), '\b1[0-9]\b') THEN 'Ten' END], lambda x: x IS NOT NULL), ',') AS places FROM listing")
def d10(t):
    return listing(t).select("pos", F.array_join(directory.labels_of(F.col("location"), {"Brand": ["brand"], "Ten": ["1[0-9]"]}, whole_words=True), ",").alias("places"))


@query("d11_facets", f"WITH {LISTING} SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN contains(lower(focus), 'standard') THEN ['*'] ELSE {TYPED} END) AS kind FROM listing) GROUP BY 1")
def d11(t):
    return typed(t).select(F.explode("types").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("d12_faceted", f"""WITH {LISTING}, ty AS (SELECT pos, location, CASE WHEN contains(lower(focus), 'standard') THEN ['*'] ELSE {TYPED} END AS types FROM listing)
SELECT pos, row_number() OVER (ORDER BY CASE WHEN list_contains(types, 'shiny') THEN 0 ELSE 1 END, pos) AS rank FROM ty WHERE list_contains(types, 'shiny') OR list_contains(types, '*')""")
def d12(t):
    return directory.faceted(typed(t), "shiny").select("pos", "rank")


@query("d13_full_list", f"""{SUBS}, rest AS (SELECT query_id, pos FROM wanted, listing EXCEPT SELECT query_id, pos FROM ranking)
SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY part, o) AS line FROM (SELECT query_id, pos, 0 AS part, rank AS o FROM ranking UNION ALL SELECT query_id, pos, 1, pos FROM rest)""")
def d13(t):
    return directory.full_list(directory.ranked(wanted(t), listing(t), method="levenshtein"), wanted(t), listing(t))


@query("d14_confirmations", f"{SUBS} SELECT query_id, 'Did you mean ' || name || '?' AS prompt FROM ranking JOIN listing USING (pos) WHERE how = 'fuzzy' AND rank = 1")
def d14(t):
    top = directory.ranked(wanted(t), listing(t), method="levenshtein").where("how = 'fuzzy' and rank = 1")
    return top.join(listing(t), "pos").select("query_id", F.format_string("Did you mean %s?", "name").alias("prompt"))


@query("d15_coverage", f"WITH {LISTING} SELECT location, count(DISTINCT focus) AS n_types, count(DISTINCT focus) >= 5 AS enough FROM listing GROUP BY 1")
def d15(t):
    return listing(t).groupBy("location").agg(F.count_distinct("focus").alias("n_types")).withColumn("enough", F.col("n_types") >= 5)


@query("d16_verified_contacts", """WITH d AS (SELECT page_id AS pos, url, regexp_extract(html, '\\+1 \\([0-9]{3}\\) 555-[0-9]{4}') AS phone, html FROM pages)
SELECT pos, contains(regexp_replace(html, '[^0-9]', '', 'g'), right(regexp_replace(phone, '[^0-9]', '', 'g'), 10)) AS ok FROM d WHERE phone <> ''""")
def d16(t):
    d = t("pages").select(F.col("page_id").alias("pos"), "url", F.regexp_extract("html", r"(\+1 \([0-9]{3}\) 555-[0-9]{4})", 1).alias("phone")).where("phone <> ''")
    return directory.verified(d, t("pages"))


def turns(t):
    return t("conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.concat(F.lit("and what about "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" that is"))).otherwise(F.col("text")).alias("text"), "role")


TURNS = "turns AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN 'and what about ' || split_part(text, ' ', 1) || ' that is' ELSE text END AS text FROM conversations)"
STOPS = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *converse.PRONOUNS}))
STEMS = f"""WITH {TURNS}, tk AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM turns), ct AS (SELECT DISTINCT conv_id, turn, stem FROM ({stemmed('tk')}) WHERE length(tok) > 1 AND tok NOT IN ({STOPS})),
  nc AS (SELECT conv_id, turn, count(ct.stem) AS n FROM turns LEFT JOIN ct USING (conv_id, turn) GROUP BY 1, 2)"""


@query("v1_content_stems", f"{STEMS} SELECT conv_id, turn, CAST(n AS INT) AS n_content FROM nc")
def v1(t):
    return turns(t).select("conv_id", "turn", F.size(converse.content_stems(F.col("text"))).alias("n_content"))


MARKER = "CASE " + " ".join(rf"WHEN regexp_matches(lower(trim(text)), '^{m}\b') THEN '{m}'" for m in sorted(converse.MARKERS, key=lambda m: (-len(m), m))) + " ELSE '' END"


@query("v2_markers", f"WITH {TURNS} SELECT conv_id, turn, {MARKER} AS marker FROM turns")
def v2(t):
    return turns(t).select("conv_id", "turn", converse.leading_marker(F.col("text")).alias("marker"))


AUX = ", ".join(f"'{w}'" for w in converse.AUXILIARIES)
PRO = ", ".join(f"'{w}'" for w in converse.PRONOUNS)
UNBOUND = f"""pt AS (SELECT *, lag(tok) OVER w AS prev, lead(tok) OVER w AS nxt FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM turns) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
  pf AS (SELECT conv_id, turn, tok, min(i) AS i FROM pt WHERE tok IN ({PRO}) AND NOT (tok = 'that' AND coalesce(prev NOT IN ({STOPS}) AND length(prev) > 1, false) AND coalesce(nxt IN ({AUX}), false)) GROUP BY 1, 2, 3),
  up AS (SELECT conv_id, turn, string_agg(tok, ',' ORDER BY i) AS pronouns FROM pf GROUP BY 1, 2)"""


@query("v3_pronouns", f"WITH {TURNS}, {UNBOUND} SELECT conv_id, turn, coalesce(pronouns, '') AS pronouns FROM turns LEFT JOIN up USING (conv_id, turn)")
def v3(t):
    return turns(t).select("conv_id", "turn", F.array_join(converse.unbound_pronouns(F.col("text")), ",").alias("pronouns"))


CARRIED = f"""{STEMS}, {UNBOUND}, hist AS (SELECT *, list_filter(list(CASE WHEN trim(text) <> '' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS said FROM turns),
  decided AS (SELECT conv_id, turn, text, CASE WHEN coalesce(len(said), 0) > 2 THEN said[-2:] ELSE coalesce(said, []) END AS win, CASE WHEN coalesce(len(said), 0) = 0 THEN 'no-history' WHEN pronouns IS NOT NULL THEN 'pronoun' WHEN n <= 3 THEN 'thin' WHEN {MARKER} <> '' AND n <= 4 THEN 'marker' ELSE 'self-sufficient' END AS reason FROM hist LEFT JOIN up USING (conv_id, turn) JOIN nc USING (conv_id, turn))"""


@query("v4_carry", f"{CARRIED} SELECT conv_id, turn, reason IN ('pronoun', 'thin', 'marker') AS carried, reason FROM decided")
def v4(t):
    return converse.contextualised(turns(t)).select("conv_id", "turn", "carried", "reason")


@query("v5_contextualised", f"{CARRIED} SELECT conv_id, turn, CASE WHEN reason IN ('pronoun', 'thin', 'marker') THEN text || ' ' || text || ' ' || array_to_string(win, ' ') ELSE text END AS query FROM decided")
def v5(t):
    return converse.contextualised(turns(t)).select("conv_id", "turn", "query")


@query("v6_slot_memory", r"""WITH s AS (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'tion') THEN 'tion' WHEN contains(lower(text), 'que') THEN 'que' ELSE NULL END AS what FROM conversations) SELECT conv_id, turn, coalesce(last_value(what IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS what FROM s""")
def v6(t):
    return converse.remembered(t("conversations").select("conv_id", "turn", route.first_slot(F.col("text"), [("tion", "tion"), ("que", "que")]).alias("what")), ["what"])


@query("v7_prompt_history", r"""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '' ELSE left(text, 20) END AS q FROM conversations), h AS (SELECT conv_id, turn, list_filter(list(CASE WHEN trim(q) <> '' THEN q END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS l FROM p)
SELECT conv_id, turn, array_to_string(CASE WHEN coalesce(len(l), 0) > 2 THEN l[-2:] ELSE coalesce(l, []) END, '|') AS asked FROM h""")
def v7(t):
    p = t("conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 1, "").otherwise(F.substring("text", 1, 20)).alias("question"), F.lit("a").alias("answer"))
    return converse.prompt_history(p).select("conv_id", "turn", F.array_join(F.col("history.question"), "|").alias("asked"))


def tagged(t):
    words = F.array_distinct(tokens(F.col("text")))
    return t("conversations").select("conv_id", "turn", F.filter(words, lambda w: F.length(w) == 3).alias("cited"), F.filter(words, lambda w: F.length(w) <= 3).alias("retrieved0")).select("conv_id", "turn", "cited", F.filter("retrieved0", lambda w: w.endswith("e")).alias("retrieved"))


@query("v8_drift", r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM conversations), x AS (SELECT conv_id, turn, list_filter(ws, lambda v: length(v) = 3) AS cited, list_filter(ws, lambda v: length(v) <= 3 AND v LIKE '%e') AS got FROM w),
  h AS (SELECT *, flatten(list(got) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before FROM x) SELECT conv_id, turn, len(list_filter(cited, lambda v: NOT list_contains(got, v) AND list_contains(coalesce(before, []), v)))::INT AS n_drift FROM h""")
def v8(t):
    return converse.drift(tagged(t)).select("conv_id", "turn", F.size("drift").alias("n_drift"))


@query("v9_past_turns", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM conversations")
def v9(t):
    return t("conversations").select("conv_id", "turn", F.count("*").over(converse.past()).alias("n_before"))


@query("v10_retired_turns", "SELECT role, count(*) AS n, round(avg(CASE WHEN turn % 5 <> 4 THEN length(text) END), 6) AS mean_chars FROM conversations GROUP BY 1")
def v10(t):
    live = F.when(F.col("turn") % 5 != 4, F.length("text"))
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(live), 6).alias("mean_chars"))
