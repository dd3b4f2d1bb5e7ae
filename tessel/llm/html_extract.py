"""Main text of web pages, with a suffix array over each host's pages.

Pages are parsed into blocks of text in page order. Markup decides first: scripts, styles, menus,
headers, footers, sidebars, forms, hidden parts, and elements that are named for adverts, notices,
comments and the like are no main text; if a page has an <article> or <main>, the rest of its body
isn't either. Then the host decides: the pages of a host are concatenated as token streams, suffixes
are sorted as deep as the shortest run that counts (RUN tokens), and every interval of suffixes that
begin alike on enough distinct pages marks its tokens as covered. Blocks that are mostly covered are
boilerplate; what is left are the unique runs. Inside an article a run must be on over half of the
host's pages, since articles may quote the same passage.

No task holds more than about BLOCK_PAGES distinct pages of a host. Those of a larger host are dealt by
content into groups, and a run on some share of the host's distinct pages is on that share of at least one
group's: each group's suffix order names such runs, all groups count the runs that any of them named, and
the sums decide, so that every host is judged by all its pages, whatever its size. Pages with the same
blocks count as one page; the rows themselves are spread by page_id and url.

Defined results: null or empty html gives the empty text; a null url is a host of its own; a page alone
on its host keeps all that markup leaves; equal rows give equal rows; only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, map_rows, table, written

RUN, BLOCK_PAGES, MOST_BIG_HOSTS = 8, 1000, 100_000
#: Contents that a task remembers, so that it passes on each of them once.
MOST_SEEN = 100_000
#: Least share of a group's distinct pages and least number of pages, for runs in an article and elsewhere.
INSIDE, OUTSIDE, MOSTLY = (0.5, 5), (0.1, 3), 0.8
#: Leaves room for rounding where a group names runs by a share.
ROOM = 1 - 1e-9
# Fixed values of HTML: elements without an end tag, elements inside a line, elements that show no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style head title template noscript iframe object svg canvas audio video map nav footer aside form button select option textarea fieldset dialog menu".split())
#: Words of class, id and role that name parts beside the main text.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottom sidebar side rail aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies respond disqus discussion related recommended recommendations pagination pager toolbar search form skip complementary contentinfo disclaimer".split()
)
#: Names that are also used on wrappers of a whole page, so they don't count on these elements.
WRAPPERS = frozenset("html body main article".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[A-Za-z]+")


def _beside(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """The element isn't main text."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if tag in WRAPPERS:
        return False
    for key, value in attrs:
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and HIDDEN.search(value)):
            return True
        if key in ("class", "id", "role") and value and not NAMED.isdisjoint(WORDS.findall(value.lower())):
            return not (in_article and tag == "header" and "header" in value.lower())
    return False


class Blocks(HTMLParser):
    """blocks: (text, inside an article or main), in page order, of what markup leaves."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool]] = []
        self.held: list[str] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, beside, in an article

    def part(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append((text, bool(self.open) and self.open[-1][2]))
            self.held = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag not in INLINE and tag != "br":
            self.part()
            if tag == "li":
                self.close_to("li", {"ul", "ol"})
            elif tag not in VOID:
                self.close_to("p", {"div", "section", "article", "main", "body", "td", "li", "blockquote"})
        if tag not in VOID:
            beside, inside = self.open[-1][1:] if self.open else (False, False)
            inside = inside or tag in ("article", "main")
            self.open.append((tag, beside or _beside(tag, attrs, inside), inside))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag not in NEVER:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def close_to(self, tag: str, until: set[str]) -> None:
        """Closes the nearest open tag and what is in it, unless one of until is nearer."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in until:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.part()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.held.append(data)


def blocks_of(html: str | None) -> list[tuple[str, bool]]:
    """Blocks that markup leaves: those of articles if the page has any, else all."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.part()
    inside = [b for b in parser.blocks if b[1]]
    return inside or parser.blocks


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the tokens, sorted by their first tokens, by prefix doubling up to a depth; and each suffix's rank there."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1].astype(np.int64)
        have += step
    return np.argsort(rank, kind="stable"), rank


def run_pages(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each token, the distinct pages that have the run of `run` tokens that begins there (0: it reaches into the next page)."""
    n = len(tokens)
    if n < run:
        return np.zeros(n, np.int64)
    order, rank = suffix_order(tokens, run)
    whole = np.zeros(n, bool)
    whole[: n - run + 1] = page[: n - run + 1] == page[run - 1 :]
    held = order[whole[order]]
    distinct = np.unique(np.stack([rank[held], page[held]]), axis=1)
    return np.where(whole, np.bincount(distinct[0], minlength=int(rank.max()) + 1)[rank], 0)


def spread_over(begins: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each token, the greatest value of the runs that cover it; begins: the values of the runs that begin at each token."""
    out = begins.copy()
    for k in range(1, min(run, len(begins))):
        out[k:] = np.maximum(out[k:], begins[: len(begins) - k])
    return out


def covered(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each token, the most distinct pages that share a run of `run` tokens that covers it (0: none but its own)."""
    pages = run_pages(tokens, page, run)
    return spread_over(np.where(pages > 1, pages, 0), run)


def stream(pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of pages of (text, inside): numbers of all words, the page of each, and the words."""
    ids: dict[str, int] = {}
    words = [[w for text, _ in blocks for w in text.split(" ")] for blocks in pages]
    tokens = np.array([ids.setdefault(w, len(ids)) for own in words for w in own], np.int64)
    return tokens, np.repeat(np.arange(len(pages)), np.array([len(own) for own in words], np.int64)), [w for own in words for w in own]


def named_runs(pages: list[tuple]) -> dict[str, int]:
    """Runs on the least share that counts, or more, of these distinct pages, and how many have each."""
    tokens, page, words = stream(pages)
    many = run_pages(tokens, page)
    return {" ".join(words[k : k + RUN]): int(many[k]) for k in np.flatnonzero(many >= max(1, OUTSIDE[0] * ROOM * len(pages)))}


def runs_of(words: list[str]) -> list[str]:
    return [" ".join(words[k : k + RUN]) for k in range(len(words) - RUN + 1)]


def main_texts(pages: list[list[tuple[str, bool]]], runs: dict[str, int] | None = None, n: int | None = None) -> list[str]:
    """The pages' blocks without those that the host's other pages show to be boilerplate, joined by spaces.

    Pages are all of a host; or some, with runs: its frequent runs and the distinct pages that have each, of n in all.
    """
    kinds: dict[tuple, int] = {}
    kind = [kinds.setdefault(tuple(p), len(kinds)) for p in pages]
    distinct = list(kinds)
    n = len(distinct) if runs is None else n
    tokens, page, words = stream(distinct)
    if runs is None:
        pages_of = covered(tokens, page)
    else:
        whole = np.zeros(len(words), bool)
        whole[: max(0, len(words) - RUN + 1)] = page[: max(0, len(words) - RUN + 1)] == page[RUN - 1 :]
        begins = [runs.get(r, 0) for r in runs_of(words)]
        pages_of = spread_over(np.where(whole, np.array(begins + [0] * (len(words) - len(begins)), np.int64), 0))
    texts, at = [], 0
    for blocks in distinct:
        left = []
        for text, inside in blocks:
            size = text.count(" ") + 1
            share, least = INSIDE if inside else OUTSIDE
            shared = pages_of[at : at + size] >= max(least, share * n)
            if shared.sum() < MOSTLY * size:
                left.append(text)
            at += size
        texts.append(" ".join(left))
    return [texts[k] for k in kind]


def pages_in(group: pd.DataFrame) -> list[tuple]:
    return [tuple((t, inside) for t in blocks) for blocks, inside in zip(group["blocks"], group["inside"], strict=True)]


def contents(pages: DataFrame) -> DataFrame:
    """host, part, blocks, inside: contents of pages (host, groups, html); copies of one are in the same part, and a task passes most of them on once."""

    def parse(it: Iterator[tuple]) -> Iterator[tuple]:
        seen: set[bytes] = set()
        for host, groups, html in it:
            found = blocks_of(html)
            blocks, inside = [t for t, _ in found], bool(found) and found[0][1]
            digest = blake2b("\n".join([host, str(inside), *blocks]).encode(), digest_size=16).digest()
            if digest not in seen:
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(digest)
                yield host, int.from_bytes(digest[:8]) % groups, blocks, inside

    return map_rows(pages, ["host", "groups", "html"], "host string, part int, blocks array<string>, inside boolean", parse)


def in_parts(rows: DataFrame, big: DataFrame, groups: str) -> DataFrame:
    """rows once for each part of their host."""
    return rows.join(big.select("host", F.col(groups).alias("of_host")), "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("of_host") - 1))).drop("of_host")


def frequent_runs(pages: DataFrame, big: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """host, run, pages, n: runs on enough of the n distinct pages of a host to count. pages: host, groups, html; big: host, groups."""

    def name(group: pd.DataFrame) -> pd.DataFrame:
        distinct = list(dict.fromkeys(pages_in(group)))
        runs, outside = named_runs(distinct), sum(bool(p) and not p[0][1] for p in distinct)
        n = len(distinct)
        return pd.DataFrame({"host": group["host"].iloc[0], "run": [None, *runs], "pages": [outside, *runs.values()], "of": [n] * (1 + len(runs))})

    named = written(contents(pages).groupBy("host", "part").applyInPandas(name, "host string, run string, pages long, of long"), "named-runs")
    # where every page has an article, only the greater share counts
    limit = lambda k: F.when(F.col("outside") > 0, float(OUTSIDE[k])).otherwise(float(INSIDE[k]))
    hosts = named.where("run is null").groupBy("host").agg(F.sum("of").alias("n"), F.sum("pages").alias("outside")).select("host", "n", limit(0).alias("share"), limit(1).alias("least"))
    hosts = written(hosts, "host-limits")
    asked = written(named.where("run is not null").join(few(hosts), "host").where(F.col("pages") >= F.col("share") * F.col("of") * ROOM).select("host", "run").distinct(), "asked-runs")
    again = contents(pages.join(few(asked.select("host").distinct()), "host", "left_semi"))

    def count(group: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        known, by = set(wanted["run"]), Counter()
        for page in set(pages_in(group)) if known else ():
            by.update(known.intersection(runs_of([w for text, _ in page for w in text.split(" ")])))
        return pd.DataFrame({"host": wanted["host"].iloc[0] if by else "", "run": list(by.keys()), "pages": list(by.values())})

    counted = again.groupBy("host", "part").cogroup(in_parts(asked, few(big), "groups").groupBy("host", "part")).applyInPandas(count, "host string, run string, pages long")
    runs = counted.groupBy("host", "run").agg(F.sum("pages").alias("pages")).join(few(hosts), "host")
    runs = written(runs.where(F.col("pages") >= F.greatest("least", F.col("share") * F.col("n"))).select("host", "run", "pages", "n"), "runs")
    dropped(named, hosts, asked)
    return runs


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("\0"))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("rows"), F.count_distinct(F.xxhash64("html")).alias("kinds")).where(F.col("rows") > BLOCK_PAGES)
    groups = lambda c: F.ceil(F.col(c) / BLOCK_PAGES).cast("int")
    big = written(sizes.select("host", groups("rows").alias("parts"), groups("kinds").alias("groups")), "big-hosts")
    n_big = big.count()
    few = F.broadcast if n_big <= MOST_BIG_HOSTS else lambda df: df
    runs = frequent_runs(pages.join(few(big), "host"), big, few) if n_big else None
    has_runs = runs.select("host").distinct().withColumn("has_runs", F.lit(True)) if n_big else big.select("host", F.lit(True).alias("has_runs"))
    big = written(big.join(few(has_runs), "host", "left").select("host", "parts", F.coalesce("has_runs", F.lit(False)).alias("has_runs")), "hosts")
    dealt = pages.withColumn("deal", F.xxhash64("page_id", "url")).join(few(big), "host", "left")
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod("deal", "parts")).otherwise(F.lit(0)).cast("int"))

    def parse(it: Iterator[tuple]) -> Iterator[tuple]:
        for page, url, where, part, html in it:
            found = blocks_of(html)
            yield page, url, where, part, [t for t, _ in found], bool(found) and found[0][1]

    def whole(it: Iterator[tuple]) -> Iterator[tuple]:
        for page, url, html in it:
            yield page, url, " ".join(t for t, _ in blocks_of(html))

    def judged(group: pd.DataFrame, *known) -> pd.DataFrame:
        return pd.DataFrame({"page_id": group["page_id"].astype("Int64"), "url": group["url"], "text": main_texts(pages_in(group), *known)})

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        return judged(group)

    def judge_by(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return judged(group, dict(zip(found["run"], found["pages"], strict=True)), int(found["n"].iloc[0]))

    to, out = "page_id long, url string, host string, part int, blocks array<string>, inside boolean", "page_id long, url string, text string"
    columns = ["page_id", "url", "host", "part", "html"]
    small = map_rows(dealt.where("parts is null"), columns, to, parse).groupBy("host", "part").applyInPandas(judge, out)
    if runs is None:
        return small
    rest = map_rows(dealt.where("not has_runs"), ["page_id", "url", "html"], out, whole)
    held = map_rows(dealt.where("has_runs"), columns, to, parse).groupBy("host", "part").cogroup(in_parts(runs, few(big), "parts").groupBy("host", "part")).applyInPandas(judge_by, out)
    return small.unionByName(rest).unionByName(held)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
