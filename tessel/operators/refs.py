"""References from running text: act-like headings, constitution-like prefixes, tables of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 4


def listed(nums: Column, most: int = MOST) -> Column:
    """'cl. a,b' for one to `most` numbers, else 'general'."""
    return F.when(F.size(nums).between(1, most), F.concat(F.lit("cl. "), F.array_join(F.transform(nums, lambda x: x.cast("string")), ","))).otherwise(F.lit("general"))


def heading_ref(text: Column, heading: str = r"(?m)(?:^|[.;:])\s*([0-9]{1,3})\.\s*(?=[A-Z(])", inline: str = r"(?i)\bsection ([0-9]{1,3})") -> Column:
    """Numbers of headings at line starts or glued to a sentence's end, in order of place; inline mentions if there are none."""
    numbers = lambda p: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: x.cast("int")))
    heads = numbers(heading)
    return F.when(F.size(heads) > 0, listed(heads)).otherwise(listed(numbers(inline)))


def prefix_ref(text: Column, within: int = 160, words: int = 40, head: str = r"(?m)^\s*([0-9]{1,3})\.\s") -> Column:
    """The number after '§' near the start; 'general' for fragments of a contents list (short, two headings or more)."""
    number = F.regexp_extract(F.substring(text, 1, within), "§([0-9]+)", 1)
    short = F.size(F.split(F.trim(text), r"\s+")) < words
    heads = F.size(F.regexp_extract_all(text, F.lit(head), F.lit(1)))
    return F.when((number == "") | (short & (heads >= 2)), F.lit("general")).otherwise(F.concat(F.lit("cl. "), number))


def table_rows(lines: DataFrame, anchor: str = r"^[0-9]+\.? Section ([0-9]+)", furniture: str = r"^\s*(?:Page )?[0-9]*\s*$", title_chars: int = 40) -> DataFrame:
    """doc, num, title, body, xrefs: rows that open with an anchor line; short first lines without a full stop are the title.

    lines: doc, ln, line. xrefs: other numbers that the body mentions, ascending.
    """
    w = Window.partitionBy("doc").orderBy("ln")
    held = lines.where(~F.col("line").rlike(furniture)).withColumn("n", F.regexp_extract("line", anchor, 1).try_cast("int"))
    held = held.withColumn("row", F.count("n").over(w)).where("row > 0")
    own = Window.partitionBy("doc", "row").orderBy("ln")
    long = (F.col("n").isNull() & ((F.length("line") > title_chars) | F.col("line").endswith("."))).cast("int")
    held = held.withColumn("is_body", F.max(long).over(own) == 1)
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ln", "line")))), lambda x: x["line"]), " ")
    by = held.groupBy("doc", "row").agg(F.max("n").alias("num"), part(F.col("n").isNull() & ~F.col("is_body")).alias("title"), part(F.col("n").isNull() & F.col("is_body")).alias("body"))
    mentioned = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"(?i)section ([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))))
    return by.select("doc", "num", "title", "body", F.array_except(mentioned, F.array("num")).alias("xrefs"))
