"""Cutting texts into citable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines

PARTS = "array<string>"


def packed(text: Column, size: Column | int = 500, overlap: int = 50, separator: str = "\n\n") -> Column:
    """Paragraphs packed to `size` characters; a longer one is cut every size - overlap, its tail staying open.

    The test for one more paragraph allows two characters for the joint, whatever the separator.
    """
    size = F.lit(size) if isinstance(size, int) else size
    step = F.greatest(size - overlap, F.lit(1))
    paras = F.filter(F.transform(F.split(text, separator.replace("\\", "\\\\"), -1), lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+", ""), r"\s+$", "")), lambda p: p != "")

    def add(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(p) + 2 <= size
        cuts = F.when(F.length(p) > size, F.ceil((F.length(p) - size) / step).cast("int")).otherwise(0)
        done = F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        hard = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))), lambda i: F.substr(p, (i * step + 1).cast("int"), size.cast("int")))).otherwise(F.array().cast(PARTS))
        tail = F.substr(p, (cuts * step + 1).cast("int"), F.length(p))
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(separator), p))
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.concat(done, hard).alias("done"), tail.alias("open")))

    start = F.struct(F.array().cast(PARTS).alias("done"), F.lit("").alias("open"))
    return F.aggregate(paras, start, add, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def recursive_split(docs: DataFrame, keys: list[str], text: str = "text", size: int = 500, overlap: int = 50, separator: str = "\n\n") -> DataFrame:
    """keys, ix, piece."""
    return docs.select(*keys, F.posexplode(packed(F.col(text), size, overlap, separator)).alias("ix", "piece"))


def heading_units(docs: DataFrame, keys: list[str], heading: str, text: str = "text") -> DataFrame:
    """keys, unit, heading (null for what stands before the first), body: lines from one heading line to the next, the heading kept first."""
    each = docs.select(*keys, F.posexplode(lines(F.col(text))).alias("ln", "line"))
    head = F.col("line").rlike(heading)
    unit = F.sum(head.cast("int")).over(Window.partitionBy(*keys).orderBy("ln"))
    grouped = each.withColumn("is_head", head).withColumn("unit", unit).groupBy(*keys, "unit")
    out = grouped.agg(F.min(F.when(F.col("is_head"), F.col("line"))).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return out.withColumn("body", F.trim("body")).where("body <> ''")


def section_split(docs: DataFrame, keys: list[str], heading: str = r"(?i)^Section [0-9]+", text: str = "text", size: int = 800) -> DataFrame:
    """keys, unit, ix, piece: one piece per heading, cut further only over size."""
    units = heading_units(docs, keys, heading, text)
    parts = F.when(F.length("body") > size, packed(F.col("body"), size)).otherwise(F.array("body"))
    return units.select(*keys, "unit", F.posexplode(parts).alias("ix", "piece"))


def titled_pieces(clauses: DataFrame, keys: list[str], header: str, text: str, size: int = 500, least: int = 100) -> DataFrame:
    """keys, ix, piece: the header repeated on every piece, within the size (what is left for text is never under `least`)."""
    room = F.greatest(F.lit(size) - F.length(header) - 1, F.lit(least))
    return clauses.select(*keys, header, F.posexplode(packed(F.col(text), room, 0, "\n")).alias("ix", "body")).select(*keys, "ix", F.concat_ws("\n", header, "body").alias("piece"))


def chapter_pack(sections: DataFrame, size: int = 600, priority: tuple[int, ...] = ()) -> DataFrame:
    """chapter, pack, label, members, text: neighbouring sections of a chapter packed to `size`; priority sections stand alone.

    sections: chapter, num, body. A label lists its members, never a span.
    """
    alone = F.col("num").isin(*priority) if priority else F.lit(False)
    by = sections.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("num", F.length("body").alias("n"), alone.alias("alone")))).alias("xs"))
    kind = "array<struct<num:bigint,pack:int>>"

    def add(acc: Column, x: Column) -> Column:
        new = x["alone"] | acc["closed"] | (acc["used"] + x["n"] + 2 > size)
        pack = F.when(new, acc["pack"] + 1).otherwise(acc["pack"])
        used = F.when(new, x["n"]).otherwise(acc["used"] + x["n"] + 2)
        return F.struct(F.array_append(acc["out"], F.struct(x["num"].cast("bigint").alias("num"), pack.alias("pack"))).alias("out"), pack.alias("pack"), used.alias("used"), x["alone"].alias("closed"))

    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("pack"), F.lit(0).alias("used"), F.lit(True).alias("closed"))
    where = by.select("chapter", F.explode(F.aggregate("xs", start, add)["out"]).alias("x")).select("chapter", "x.num", "x.pack")
    xs = F.array_sort(F.collect_list(F.struct("num", "body")))
    packs = sections.join(where, ["chapter", "num"]).groupBy("chapter", "pack").agg(xs.alias("xs"))
    members = F.array_join(F.transform("xs", lambda x: x["num"].cast("string")), ",")
    return packs.select("chapter", "pack", members.alias("members"), F.concat(F.lit("Chapter "), F.col("chapter").cast("string"), F.lit(" §"), members, F.lit(": ")).alias("label"), F.array_join(F.transform("xs", lambda x: x["body"]), "\n\n").alias("text"))


def marker_region(docs: DataFrame, marker: str, text: str = "text", strict: bool = True) -> DataFrame:
    """docs with `region`, the text from the only occurrence of marker on; strict fails on any other number, else region is null."""
    times = F.regexp_count(F.col(text), F.lit(marker))
    if strict:
        docs = docs.where(F.assert_true(times == 1, F.lit("the marker must occur once")).isNull())
    at = F.regexp_instr(F.col(text), F.lit(marker))
    return docs.withColumn("marker_count", times).withColumn("region", F.when(times == 1, F.substr(F.col(text), at, F.length(text))))


def cite_tag(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """chunks with `tag`, from the collection's label and the ref."""
    return chunks.join(F.broadcast(labels), "collection", "left").withColumn("tag", F.format_string("[%s %s]", F.coalesce("label", "collection"), "ref")).drop("label")
