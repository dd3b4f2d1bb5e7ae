"""Reading the engine's inputs, with their contracts, and writing its outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.order import line_numbers

MARKER = r"===== PAGE (\S+) ====="


def texts(spark: SparkSession, path: str) -> DataFrame:
    """collection (the folder), doc_key (the file), text: one row a file."""
    name = F.input_file_name()
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("collection"), F.regexp_extract(name, r"([^/]+)$", 1).alias("doc_key"), F.col("value").alias("text"))


def split_pages(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, page_ord, page_no, body: text before the first marker goes; a text without markers is page '0'."""
    numbers = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    bodies = F.slice(F.split(text, MARKER, -1), 2, 1 << 30)
    pages = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit("0").alias("page_no"), F.col(text).alias("body")))).otherwise(F.zip_with(numbers, bodies, lambda n, b: F.struct(n.alias("page_no"), b.alias("body"))))
    return docs.select(*keys, F.posexplode(pages).alias("page_ord", "x")).select(*keys, "page_ord", "x.page_no", "x.body")


def contract(rows: DataFrame, rules: dict[str, Column], key: str = "id", groups: dict[str, tuple[list[str], Column]] | None = None) -> DataFrame:
    """key, problem: a row for each rule that a row breaks, and one for each group that breaks a rule of groups.

    Row rules are all told in one pass. A rule of groups has its columns, of which the first stands for the
    group as its key, and an aggregate that is true where the group is wrong; rules over the same columns
    share a pass, whose groups are counted where they arise.
    """
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items())))
    found = [rows.select(F.col(key).cast("string").alias(key), F.explode(broken).alias("problem"))] if rules else []
    by: dict[tuple[str, ...], dict[str, Column]] = {}
    for name, (columns, bad) in (groups or {}).items():
        by.setdefault(tuple(columns), {})[name] = bad
    for columns, bads in by.items():
        told = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f"_{i}"), F.lit(False)), name) for i, name in enumerate(bads))))
        each = rows.groupBy(*columns).agg(*(bad.alias(f"_{i}") for i, bad in enumerate(bads.values())))
        found.append(each.select(F.col(columns[0]).cast("string").alias(key), F.explode(told).alias("problem")))
    return reduce(DataFrame.unionAll, found)


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def eval_contract(rows: DataFrame, sets: list[str], gates: list[str], collections: list[str]) -> DataFrame:
    """id, problem of evaluation rows: id, set, gate, text, note, expected (collection -> numbers)."""
    none = F.size(F.coalesce("expected", F.create_map().cast("map<string,array<int>>"))) < 1
    rules = {
        "bad set": ~F.coalesce(F.col("set").isin(*sets), F.lit(False)),
        "bad gate": ~F.coalesce(F.col("gate").isin(*gates), F.lit(False)),
        "empty text": blank("text"),
        "empty note": blank("note"),
        "unknown collection": F.exists(F.map_keys("expected"), lambda c: ~c.isin(*collections)),
        "empty numbers": F.exists(F.map_values("expected"), lambda n: F.size(n) < 1),
        "refusal expects something": (F.col("gate") == "refuse") & ~none,
        "answer expects nothing": (F.col("gate") != "refuse") & none,
    }
    return contract(rows, rules, "id", {"repeated id": (["id"], F.count("*") > 1)})


def chat_contract(turns: DataFrame, classes: list[str], history: list[str], gates: list[str], statuses: list[str]) -> DataFrame:
    """turn_id, problem of turns: conv_id, turn_id, turn_index, class, gate, text, expected, slots (map or null), status, reason. history: classes that need earlier turns."""
    none = F.size(F.coalesce("expected", F.create_map().cast("map<string,array<int>>"))) < 1
    rules = {
        "bad class": ~F.coalesce(F.col("class").isin(*classes), F.lit(False)),
        "bad gate": ~F.coalesce(F.col("gate").isin(*gates), F.lit(False)),
        "empty text": blank("text"),
        "opening needs history": (F.col("turn_index") == 0) & F.col("class").isin(*history),
        "answer expects nothing": (F.col("gate") == "answer") & none,
        "other than an answer expects something": (F.col("gate") != "answer") & ~none,
        "help without slots": (F.col("gate") == "help") & F.col("slots").isNull(),
        "slots without help": (F.col("gate") != "help") & F.col("slots").isNotNull(),
        "unknown status": F.col("status").isNotNull() & ~F.col("status").isin(*statuses),
        "retired without a reason": F.col("status").isNotNull() & blank("reason"),
    }
    return contract(turns, rules, "turn_id", {"repeated turn": (["turn_id"], F.count("*") > 1)}).unionAll(
        contract(turns, {}, "conv_id", {"no opening turn": (["conv_id"], F.min("turn_index") > 0), "gap in turns": (["conv_id"], F.count_distinct("turn_index") <= F.max("turn_index") - F.min("turn_index"))})
    )


def directory(spark: SparkSession, path: str, columns: list[str], phone: str | None = None, placeholders: tuple[str, ...] = ()) -> DataFrame:
    """All-text CSV; empty cells for nulls, `pos` by the line (the files of a folder in order of their names); a missing column fails.

    phone: the column that no row may leave empty or fill with a placeholder; the scan fails at such a row.
    """
    read = spark.read.csv(path, header=True)
    gone = [c for c in columns if c not in read.columns]
    if gone:
        raise ValueError(f"the directory lacks {', '.join(gone)}")
    got = line_numbers(read, "pos", first=0, through=True).select(*columns, "pos").na.fill("")
    if phone:
        bad = reduce(Column.__or__, (F.col(phone).rlike(p) for p in placeholders), F.trim(phone) == "")
        got = got.where(F.assert_true(~bad, F.concat(F.lit("no contact in row "), F.col("pos").cast("string"))).isNull())
    return got


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_index, turn_id, text, from nested turns."""
    return conversations.select("conv_id", F.posexplode("turns").alias("turn_index", "x")).select("conv_id", "turn_index", F.concat(F.col("conv_id").cast("string"), F.lit(".t"), (F.col("turn_index") + 1).cast("string")).alias("turn_id"), "x.text")


def box_extents(boxes: DataFrame, box: str = "box") -> DataFrame:
    """boxes with x_left, x_right, y_top, y_bottom of their corner points."""
    xs, ys = F.transform(box, lambda p: p["x"]), F.transform(box, lambda p: p["y"])
    return boxes.withColumns({"x_left": F.array_min(xs), "x_right": F.array_max(xs), "y_top": F.array_min(ys), "y_bottom": F.array_max(ys)})


def vectors(spark: SparkSession, path: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """word, v, rank (the line, from 1, the files of a folder in order of their names): lines 'word f1 f2 ...'; a header of two numbers, odd words and stop words are left out, but count as lines."""
    parts = F.split(F.trim("value"), " ")
    lines_ = line_numbers(spark.read.text(path), "rank", through=True)
    got = lines_.where(~F.col("value").rlike(r"^\d+ \d+$")).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, 1 << 30), lambda x: x.cast("float")).alias("v"), "rank").where(F.col("word").rlike("^[a-z]+$"))
    return got.where(~F.col("word").isin(*stop)) if stop else got


TRANSCRIPT = "id string, question string, answer string, outcome string, claims array<struct<claim:string,tag:string,verdict:string>>"


def transcripts(spark: SparkSession, path: str, schema: str = TRANSCRIPT, multi_line: bool = False) -> DataFrame:
    """ok, and the fields of the schema: a JSON record a line, or files that hold a list each; what doesn't parse isn't ok."""
    lines_ = spark.read.text(path, wholetext=multi_line)
    if multi_line:
        return lines_.select(F.explode_outer(F.from_json("value", ArrayType(StructType.fromDDL(schema)))).alias("x")).select(F.col("x").isNotNull().alias("ok"), "x.*")
    x = F.from_json("value", f"{schema}, broken string", {"columnNameOfCorruptRecord": "broken"})
    return lines_.where(F.trim("value") != "").select(x.alias("x")).select(F.col("x.broken").isNull().alias("ok"), "x.*").drop("broken")


def claims(records: DataFrame) -> DataFrame:
    """id, outcome, ix, claim, tag, verdict: a row for each claim of a transcript."""
    return records.select("id", "outcome", F.posexplode("claims").alias("ix", "x")).select("id", "outcome", "ix", "x.*")


def save_corpus(chunks: DataFrame, path: str, problems: DataFrame | None = None) -> None:
    """Parquet by corpus_version and collection; a corpus with problems never replaces what is there."""
    if problems is not None and problems.limit(1).count():
        raise ValueError("the corpus has problems and isn't written")
    chunks.write.mode("overwrite").partitionBy("corpus_version", "collection").parquet(path)
