"""Benchmark decontamination: one Aho-Corasick automaton over normalised test passages.

Benchmark texts and documents are normalised the same way (A-Z lowered, words are runs of letters,
digits and anything beyond ASCII). Each run of `window` consecutive words of an item is a pattern of
one automaton; every document is scanned once, and each occurrence is mapped back to the words, and
from there to the characters, of the original text.

The automaton is broadcast. Its size is checked first: a benchmark of more than `shard_bytes` is dealt
into as many shards by item id, and the documents pass through one automaton after another, each pass
adding to the spans and items that the passes before it have found. No shuffle is needed for either.

Defined results: null text has no words; an item without words matches nothing; an item of fewer words
than a window is one pattern; equal items all count; rows of equal doc_id are judged each on its own;
an empty benchmark leaves every document clean; other columns of the input aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_texts, map_rows, table

WINDOW = 10
#: Benchmark bytes in one automaton (some 40 times as many in memory).
SHARD_BYTES = 4 << 20
#: In the original text, words keep their capitals. Word characters are 0-9, a-z after lowering, and every byte of a character beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = "doc_id long, n_words long, spans array<struct<word_start:int,word_end:int,char_start:int,char_end:int>>, item_ids array<string>"


def words_of(text: str | None) -> list[str]:
    """The normalised words of a text."""
    folded = b" ".join((text or "").encode("utf-8", "replace").translate(FOLD).split())
    return folded.decode("utf-8").split(" ") if folded else []


def patterns(items: list[tuple], window: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Pattern (words between single spaces, a space at either end) -> its number of words, the items that hold it."""
    out: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if words else 0):
            held = out.setdefault(f" {' '.join(words[at : at + size])} ", (size, []))[1]
            if str(item) not in held[-1:]:
                held.append(str(item))
    return out


def automaton(items: list[tuple], window: int = WINDOW) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for pattern, (size, held) in patterns(items, window).items():
        made.add_word(pattern, (size, tuple(sorted(set(held)))))
    if not len(made):
        return None
    made.make_automaton()
    return made


def scan(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words; merged word ranges (end exclusive) that occurrences cover; items with an occurrence."""
    words = words_of(text)
    if not words or machine is None:
        return len(words), [], set()
    line = f" {' '.join(words)} "
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    seen = spaces = 0  # an occurrence ends with the space after its last word
    for end, (size, held) in machine.iter(line):
        spaces += line.count(" ", seen, end + 1)
        seen = end + 1
        spans.append((spaces - 1 - size, spaces - 1))
        items.update(held)
    return len(words), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards_of(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> list:
    """The items (item_id, text) as broadcasts of about shard_bytes of text each."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // shard_bytes) or 1
    parts = [items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k) for k in range(shards)] if shards > 1 else [items]
    return [benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()]) for part in parts]


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents, all their columns, without those that hold a window of the benchmark."""
    for held in shards_of(benchmark, shard_bytes):

        def keep(held=held) -> Callable[[str | None], bool]:
            machine = automaton(held.value, window)
            return lambda text: not scan(text, machine)[1]

        documents = filter_texts(documents, keep)
    return documents


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, spans (word and character ranges of the original text that benchmark windows cover), item_ids (as strings, sorted)."""
    shards = shards_of(benchmark, shard_bytes)
    state = "ranges array<struct<a:int,b:int>>, item_ids array<string>"
    found = documents.select("doc_id", "text", *(F.array().cast(x.split(" ", 1)[1]).alias(x.split(" ", 1)[0]) for x in state.split(", ")))
    for k, held in enumerate(shards):
        last = k == len(shards) - 1

        def rows(it: Iterator[tuple], held=held, last=last) -> Iterator[tuple]:
            machine = automaton(held.value, window)
            for doc, text, ranges, ids in it:
                n, spans, hits = scan(text, machine)
                spans = merged([(r["a"], r["b"]) for r in ranges] + spans)
                ids = sorted({*ids, *hits})
                yield (doc, n, placed(text, spans), ids) if last else (doc, text, [{"a": a, "b": b} for a, b in spans], ids)

        found = map_rows(found, ["doc_id", "text", "ranges", "item_ids"], FOUND if last else f"doc_id long, text string, {state}", rows)
    return found


def placed(text: str | None, spans: list[tuple[int, int]]) -> list[dict]:
    """Word ranges with the character ranges of the original text that they stand for."""
    at = [m.span() for m in WORD.finditer(text or "")] if spans else []
    return [{"word_start": a, "word_end": b, "char_start": at[a][0], "char_end": at[b - 1][1]} for a, b in spans]


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of decontaminate() over all documents, and where in the text the passages lie."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["word_end"] - s["word_start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


#: Items' windows by their length; each document's windows of those lengths; the words that matches cover.
ORACLE = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS pat
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS pat
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT s.doc_id, s.k, s.i, v.item_id FROM spots s JOIN windows v ON s.k = v.k AND s.pat = v.pat),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
