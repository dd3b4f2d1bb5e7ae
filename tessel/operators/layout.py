"""Boxes of recognised text: rows, margin notes, contents tables, anchors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import ratio


def visual_rows(boxes: DataFrame, overlap: float = 0.5) -> DataFrame:
    """page, box, row, col: boxes that overlap by over half of the lower one share a row, left to right.

    Each page's boxes are gathered as one array (a page is small), and many pages go to Python at once.
    """

    def rows(page: list[dict]) -> list[dict]:
        found: list[list] = []
        for b in page:  # by height, then place
            for r in found:
                if min(r[1], b["y1"]) - max(r[0], b["y0"]) > overlap * min(r[1] - r[0], b["y1"] - b["y0"]):
                    r[0], r[1] = min(r[0], b["y0"]), max(r[1], b["y1"])
                    r[2].append((b["x0"], b["box"]))
                    break
            else:
                found.append([b["y0"], b["y1"], [(b["x0"], b["box"])]])
        return [{"box": box, "row": i, "col": j} for i, r in enumerate(sorted(found, key=lambda r: r[0])) for j, (_, box) in enumerate(sorted(r[2]))]

    @F.pandas_udf("array<struct<box:int,row:int,col:int>>")
    def each(pages: pd.Series) -> pd.Series:
        return pages.map(rows)

    by = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "box", "y1"))).alias("xs"))
    return by.select("page", F.explode(each("xs")).alias("x")).select("page", "x.*")


def margin_side(boxes: DataFrame, share: float = 0.25) -> DataFrame:
    """page, n_left, n_right, side: narrow boxes in the outer quarters; the side that has more."""
    w = Window.partitionBy("page")
    each = boxes.withColumn("lo", F.min("x0").over(w)).withColumn("hi", F.max("x1").over(w)).withColumn("wide", F.col("hi") - F.col("lo"))
    left = (F.col("x1") - F.col("lo") <= share * F.col("wide")).cast("long")
    right = (F.col("hi") - F.col("x0") <= share * F.col("wide")).cast("long")
    by = each.groupBy("page").agg(F.sum(left).alias("n_left"), F.sum(right).alias("n_right"))
    return by.withColumn("side", F.when(F.col("n_left") > F.col("n_right"), "left").when(F.col("n_right") > 0, "right"))


def column_split(boxes: DataFrame, x: float) -> DataFrame:
    return boxes.withColumn("part", F.when(F.col("x0") < x, "body").otherwise("note"))


def contents(rows: DataFrame, head: str = r"^([0-9]+)\. (.*)$", ends: str = r"^PART ") -> DataFrame:
    """doc, num, title, n_titles: rows 'n. title', continued by rows without a number up to the next or a part heading. rows: doc, ord, text."""
    w = Window.partitionBy("doc").orderBy("ord")
    num = F.regexp_extract("text", head, 1).try_cast("int")
    stop = F.col("text").rlike(ends)
    marked = rows.withColumn("num", num).withColumn("event", F.when(num.isNotNull() | stop, F.col("ord"))).withColumn("start", F.last("event", ignorenulls=True).over(w))
    title = F.when(F.col("num").isNotNull(), F.regexp_extract("text", head, 2)).otherwise(F.col("text"))
    by = marked.where(~stop & F.col("start").isNotNull()).groupBy("doc", "start").agg(F.max("num").alias("num"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", title.alias("x")))), lambda x: x["x"]), " ").alias("title"))
    return by.where("num is not null").groupBy("doc", "num").agg(F.min_by("title", "start").alias("title"), F.count_distinct("title").alias("n_titles"))


def contents_gate(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """doc, missing, extra, duplicates, clean. expected: doc, num."""
    met = entries.select("doc", "num", "n_titles", F.lit(1).alias("have")).join(expected.withColumn("want", F.lit(1)), ["doc", "num"], "full")
    by = met.groupBy("doc").agg(*(F.sum(c.cast("long")).alias(n) for n, c in (("missing", F.col("have").isNull()), ("extra", F.col("want").isNull()), ("duplicates", F.coalesce(F.col("n_titles") > 1, F.lit(False))))))
    return by.withColumn("clean", (F.col("missing") + F.col("extra") + F.col("duplicates")) == 0)


def anchors(rows: DataFrame) -> DataFrame:
    """doc, num, ord: number n is the first row after that of n - 1 whose leading numeral is n. Only rows with a numeral are gathered, a document a group."""

    def walk(doc: pd.DataFrame) -> pd.DataFrame:
        want, out = 1, []
        for r in doc.sort_values("ord").itertuples():
            if r.num == want:
                out.append((r.doc, want, r.ord))
                want += 1
        return pd.DataFrame(out, columns=["doc", "num", "ord"])

    led = rows.select("doc", "ord", F.regexp_extract("text", r"^\s*([0-9]{1,6})\b", 1).try_cast("int").alias("num")).where("num is not null")
    return led.groupBy("doc").applyInPandas(walk, "doc long, num int, ord long")


def aligned_anchors(rows: DataFrame, expected: DataFrame, least: float = 0.6) -> DataFrame:
    """doc, num, ord, flag: the best monotone placing of expected numbers (doc, num, title) on rows (doc, ord, text).

    A row may stand for a number if its leading numeral is the number (1 point), if its text is like the
    title (the similarity, from `least` on), or both. Of all placings in which numbers and rows both rise,
    that of the most points is taken; of equal ones that with the earlier rows. So a lost numeral falls
    back to its title, and a numeral out of place, such as one cited from elsewhere, loses to what fits.
    flag: TITLE_WEAK for a numeral alone, NUMERAL_MISSING for a title alone. Only candidates are gathered,
    a document a group: rows with an expected numeral, and rows that share a word with a title.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))
    numeral = F.regexp_extract("text", r"^\s*([0-9]{1,6})\b", 1).try_cast("int")
    body = F.trim(F.regexp_replace("text", r"^\s*[0-9]{1,6}\b[.)]?\s*", ""))
    told = rows.select("doc", "ord", numeral.alias("led"), body.alias("body"))
    by_numeral = told.withColumnRenamed("led", "num").join(expected, ["doc", "num"]).select("doc", "num", "ord", "body", "title", F.lit(True).alias("led"))
    spoken = told.select("doc", "ord", "led", "body", F.explode(words(F.col("body"))).alias("word"))
    asked = expected.select("doc", "num", "title", F.explode(words(F.col("title"))).alias("word"))
    by_title = spoken.join(asked, ["doc", "word"]).select("doc", "num", "ord", "body", "title", F.coalesce(F.col("led") == F.col("num"), F.lit(False)).alias("led"))
    pairs = by_numeral.unionByName(by_title).distinct().withColumn("like", F.round(ratio(F.lower("body"), F.lower("title")), 6))
    placed = pairs.withColumn("like", F.when(F.col("like") >= least, F.col("like")).otherwise(0.0)).where("led or like > 0")

    def walk(doc: pd.DataFrame) -> pd.DataFrame:
        # points in millionths, so that sums are exact; a Fenwick tree over numbers has the best placing of those up to each
        tree: list[tuple[int, int] | None] = [None] * (int(doc["num"].max()) + 2)
        items = sorted(zip(doc["ord"], -doc["num"], doc["led"], doc["like"], strict=True))
        came_from: list[int] = []
        for i, (_, minus, led, like) in enumerate(items):
            at, before = -minus, (0, -1)
            k = at
            while k > 0:  # numbers under `at` stand at 1 .. at in the tree
                if tree[k] and tree[k][0] > before[0]:
                    before = tree[k]
                k -= k & -k
            points = before[0] + 1_000_000 * bool(led) + round(1e6 * like)
            came_from.append(before[1])
            k = at + 1
            while k < len(tree):
                if tree[k] is None or points > tree[k][0]:
                    tree[k] = points, i
                k += k & -k
        last, k = (0, -1), len(tree) - 1
        while k > 0:
            if tree[k] and tree[k][0] > last[0]:
                last = tree[k]
            k -= k & -k
        out, i = [], last[1]
        while i >= 0:
            order, minus, led, like = items[i]
            out.append((doc["doc"].iloc[0], -minus, order, None if led and like > 0 else "TITLE_WEAK" if led else "NUMERAL_MISSING"))
            i = came_from[i]
        return pd.DataFrame(out, columns=["doc", "num", "ord", "flag"])

    return placed.select("doc", "num", "ord", "led", "like").groupBy("doc").applyInPandas(walk, "doc long, num int, ord long, flag string")


def title_match(notes: DataFrame, titles: DataFrame, most: int = 6, near: float = 300.0, least: float = 0.6) -> DataFrame:
    """doc, num, ord, n_lines, similarity: the run of up to `most` lines that is likest to a title, starting within `near` of its anchor.

    notes: doc, ord, y, text. titles: doc, num, y, title. A line starts the run of one title only, that which it is
    likest to; ties go to the lower number, then the earlier and the shorter run. Bands of height `near` make the
    search an equi-join; pairs without a common word never reach the string similarity.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(0, most - 1)
    runs = notes.select("doc", "ord", "y", F.collect_list("text").over(w).alias("texts"), F.floor(F.col("y") / near).alias("band"))
    asked = titles.select("doc", "num", F.col("y").alias("at"), "title", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("y") / near) + k)).alias("band"))
    met = runs.join(asked, ["doc", "band"]).where(F.abs(F.col("y") - F.col("at")) <= near)
    each = met.select("doc", "num", "ord", "title", F.explode(F.sequence(F.lit(1), F.size("texts"))).alias("n_lines"), "texts")
    each = each.withColumn("run", F.array_join(F.slice("texts", F.lit(1), F.col("n_lines")), " ")).where(F.arrays_overlap(words(F.col("run")), words(F.col("title"))))
    scored = each.select("doc", "num", "ord", "n_lines", F.round(ratio(F.lower("run"), F.lower("title")), 6).alias("similarity")).where(F.col("similarity") >= least)
    likest = [F.desc("similarity"), "num", "ord", "n_lines"]
    first = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*likest))).where("place = 1").drop("place")
    return first(first(scored, "doc", "ord"), "doc", "num")


def spans(rows: DataFrame, anchors_: DataFrame) -> DataFrame:
    """doc, num, n_rows, body: rows from an anchor to the next."""
    w = Window.partitionBy("doc").orderBy("ord")
    met = rows.join(anchors_, ["doc", "ord"], "left").withColumn("num", F.last("num", ignorenulls=True).over(w)).where("num is not null")
    return met.groupBy("doc", "num").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("body"))
