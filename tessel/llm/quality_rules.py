"""Quality rules: document rules, and how many documents of a host share each line.

Each document is read once. Its own rules (number of words, share of words in repeated 5-word windows)
come from its text; its lines, normalised and hashed, go into a table of (host, line, document). For each
host and line the number of distinct documents is counted. Exact copies count as one document: copies are
for de-duplication to judge, and would else make all their lines look like boilerplate. A line is over
the limit if it is on at least MIN_DOCS documents of its host and on over HOST_SHARE of them; up to 300
documents a host the first decides, beyond it the second, and there is no other switch by size. Lines
over the limit are removed, and a document that keeps under LEAST_LEFT of its words is rejected as
depleted.

A host may hold a third of all rows: counts are keyed by host and line and pre-aggregated before each
shuffle, and the limits per host are one row a host. Host here is the documents' `source`.

Defined results: null text has no words, fails the base rules and isn't kept; rows of equal doc_id are
judged each on its own; a null host is a host; a document without words has nothing to lose and isn't
depleted; an empty table gives an empty result; only doc_id, text and the host column are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, written

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
MIN_DOCS, HOST_SHARE, LEAST_LEFT = 3, 0.01, 0.3
SYMBOLS, BLANKS = "#*$%&|<>", "\x20\x09\x0a\x0b\x0c\x0d"
DIGITS, GAPS = re.compile(r"[0-9]+"), re.compile(r"[\x20\x09-\x0D]+")
FACTS = "row_key string, doc_id long, host string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"


def line_key(line: str) -> int:
    """Hash of a line without case, outer and repeated white space, and with digits as one."""
    return xxhash.xxh3_64_intdigest(GAPS.sub(" ", DIGITS.sub("0", line.lower())).strip(" ")) - (1 << 63)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    code = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed + code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, inverse, counts = np.unique(mixed, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    at = np.flatnonzero(counts[inverse] > 1)  # equal hashes; the words themselves decide
    met: dict[tuple, int] = {}
    for k in at.tolist():
        key = tuple(words[k : k + window])
        met[key] = met.get(key, 0) + 1
    inside = np.zeros(len(words) + 1, np.int64)
    for k in at.tolist():
        if met[tuple(words[k : k + window])] > 1:
            inside[k] += 1
            inside[k + window] -= 1
    return int((np.cumsum(inside) > 0).sum())


def facts(text: str | None) -> tuple[int, int, int, int, int, list[dict]]:
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        [{"line": line_key(x), "words": len(x.encode("utf-8", "replace").split())} for x in lines],
    )


def quality_rules(documents: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, the base rules' counts and verdict, n_lines, n_removed_lines, words_left, depleted, kept."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for key, doc, where, text in it:
            n_words, chars, symbols, dups, repeats, lines = facts(text)
            content = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "replace")) - (1 << 63)
            yield key, doc, where, content, n_words, chars, symbols, dups, repeats, lines

    keyed = documents.select(F.expr("uuid()").alias("row_key"), "doc_id", F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), "text")
    base = written(map_rows(keyed, ["row_key", "doc_id", "host", "text"], FACTS, rows), "quality-facts")
    lines = base.select("row_key", "host", "content", F.explode("lines").alias("x")).select("row_key", "host", "content", "x.line", "x.words")
    docs = base.groupBy("host", "content").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("host_docs"))
    shared = lines.groupBy("host", "line", "content").agg(F.lit(1)).groupBy("host", "line").agg(F.count("*").alias("line_docs")).where(F.col("line_docs") >= min_docs)
    over = shared.join(docs, "host").where(F.col("line_docs") > host_share * F.col("host_docs")).select("host", "line", "line_docs")
    removed = lines.join(over, ["host", "line"]).groupBy("row_key").agg(F.sum("words").alias("gone"), F.count("*").alias("n_removed_lines"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = left < least_left * F.col("n_words")
    return base.join(removed, "row_key", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_removed_lines", F.lit(0)).alias("n_removed_lines"), left.alias("words_left"), depleted.alias("depleted"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


#: The base counts of each row, its lines with the number of documents (distinct texts) of the host that have them, and the verdict.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(source AS VARCHAR), '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
wins AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM wins) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
lines AS (
  SELECT r, host, t, x, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
over AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT t) AS c FROM lines GROUP BY host, k) JOIN hosts USING (host) WHERE c >= 3 AND c > 0.01 * docs),
by_row AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dups, count(*) FILTER (WHERE o.k IS NOT NULL) AS removed, coalesce(sum(n) FILTER (WHERE o.k IS NOT NULL), 0) AS gone
  FROM lines l LEFT JOIN over o ON l.host = o.host AND l.k = o.k GROUP BY r),
facts AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed_lines, CAST(len(ws) - coalesce(gone, 0) AS BIGINT) AS words_left
  FROM d JOIN w USING (r) LEFT JOIN covered c USING (r) LEFT JOIN by_row USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, words_left < 0.3 * n_words AS depleted,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (words_left < 0.3 * n_words) AS kept
FROM facts
"""
