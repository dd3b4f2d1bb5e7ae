"""Usage signals: counts-only JSON lines; batch and streaming share each transform."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PREFIX = "SIGNAL "
SCHEMA = "v int, kind string, id long, route string, refused boolean, top string, shown int, q string, helpful string, ts timestamp"
SHARED_CHARS = 300


def turn_signals(turns: DataFrame, share: str = "share") -> DataFrame:
    """Only the listed fields: scores as bands, the question only with consent and cut short."""
    band = F.when(F.col("score") < 10, "low").when(F.col("score") < 50, "mid").otherwise("high")
    return turns.select(F.lit(1).alias("v"), F.lit("turn").alias("kind"), "id", "route", (F.col("score") < 1).alias("refused"), band.alias("top"), "shown", F.when(F.col(share), F.substring("question", 1, SHARED_CHARS)).alias("q"), "ts")


def encoded(signals: DataFrame) -> DataFrame:
    """value: one text line a signal."""
    return signals.select(F.concat(F.lit(PREFIX), F.to_json(F.struct("*"))).alias("value"))


def saved(lines: DataFrame, path: str, state: str) -> StreamingQuery:
    """Appends a stream's lines to text files, each once; ends when all that is there has been read."""
    return lines.writeStream.format("text").option("checkpointLocation", state).trigger(availableNow=True).start(path)


def parsed(lines: DataFrame) -> DataFrame:
    """ok, and the fields: the JSON after the prefix, wherever in the line it stands; other lines aren't signals."""
    at = F.instr("value", PREFIX)
    tail = F.substr(F.col("value"), at + len(PREFIX), F.length("value"))
    x = lines.where(at > 0).select(F.from_json(tail, SCHEMA).alias("x"))
    return x.select(F.col("x.kind").isNotNull().alias("ok"), "x.*")


def with_feedback(turns: DataFrame, feedback: DataFrame) -> DataFrame:
    """turns with `helpful`: the last feedback of the same id, 'none' without any."""
    last = feedback.groupBy("id").agg(F.max_by("helpful", "line").alias("helpful"))
    return turns.drop("helpful").join(last, "id", "left").withColumn("helpful", F.coalesce("helpful", F.lit("none")))


def hourly(signals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """start, route, n, refused, shown: per hour; late lines count up to the watermark."""
    by = signals.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "route")
    return by.agg(F.count("*").alias("n"), F.sum(F.col("refused").cast("long")).alias("refused"), F.sum("shown").alias("shown")).select(F.col("w.start").alias("start"), "route", "n", "refused", "shown")


def once(signals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first signal of each id; a stream keeps ids as long as the watermark allows."""
    if signals.isStreaming:
        return signals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return signals.dropDuplicates(["id"])


def joined_stream(turns: DataFrame, feedback: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Stream-stream left join: each turn with feedback that came within `wait`, or none once the watermark has passed."""
    a = turns.withWatermark("ts", "10 minutes").alias("t")
    b = feedback.select(F.col("id").alias("fid"), F.col("ts").alias("fts"), "helpful").withWatermark("fts", "10 minutes")
    return a.join(b, F.expr(f"id = fid and fts >= ts and fts <= ts + interval {wait}"), "left")


#: What the summary needs of a turn; sign is 1 for what holds now and -1 for what held before.
FACTS = "route string, refused boolean, top string, shown int, opted boolean, helpful string"
SIGNED = f"id long, {FACTS}, sign int"
_HELD = f"{FACTS}, has_turn boolean, turn_at long, feedback_at long"


def facts(turns: DataFrame) -> DataFrame:
    """id, FACTS, sign 1 of turns with feedback (see with_feedback)."""
    return turns.select("id", "route", "refused", "top", "shown", F.col("q").isNotNull().alias("opted"), F.lower("helpful").alias("helpful"), F.lit(1).alias("sign"))


def signed(signals: DataFrame, keep: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """SIGNED rows of a stream of parsed signals: a turn when it comes, and when a later line changes it, what held before with sign -1 and what holds now.

    The last turn line of an id and its last feedback (by ts, by whichever comes first in a trigger) count,
    in whatever order they come. An id's state is a row of fixed size, and goes when the watermark is
    `keep` past its last line; feedback after that has no turn any more. summary() of all rows is at any
    time the summary of the lines so far.
    """
    span = pd.Timedelta(keep) // pd.Timedelta("1ms")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get) if state.exists else [None] * 5 + ["none", False, -1, -1]
        before = tuple(held[:6]) if held[6] else None
        latest = 0
        for lines in batches:
            for r in lines.itertuples(index=False):
                latest = max(latest, r.at)
                if r.kind == "turn" and r.at >= held[7]:
                    held[:5], held[6], held[7] = [r.route, bool(r.refused), r.top, None if pd.isna(r.shown) else int(r.shown), r.q is not None], True, int(r.at)
                elif r.kind == "helpful" and r.at >= held[8]:
                    held[5], held[8] = (r.helpful or "none").lower(), int(r.at)
        state.update(tuple(held))
        state.setTimeoutTimestamp(max(latest // 1000, state.getCurrentWatermarkMs()) + span)
        now = tuple(held[:6]) if held[6] else None
        if now != before:
            rows = [(key[0], *x, sign) for x, sign in ((before, -1), (now, 1)) if x]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNED.split(", ")])

    lines = signals.withWatermark("ts", late).select("id", "kind", "route", "refused", "top", "shown", "q", "helpful", F.unix_micros("ts").alias("at"), "ts").where("id is not null and ts is not null and kind in ('turn', 'helpful')")
    return lines.groupBy("id").applyInPandasWithState(step, SIGNED, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def summary(rows: DataFrame) -> DataFrame:
    """route, n, refused, low, mid, high, yes, no, unanswered, opted_in, mean_shown (of answered turns; null without any), from SIGNED rows or facts()."""
    count = lambda c: F.sum(F.when(c, F.col("sign")).otherwise(0)).cast("long")
    answered = ~F.col("refused")
    by = rows.groupBy("route").agg(
        F.sum("sign").cast("long").alias("n"),
        count(F.col("refused")).alias("refused"),
        *(count(F.col("top") == band).alias(band) for band in ("low", "mid", "high")),
        *(count(F.col("helpful") == said).alias(said) for said in ("yes", "no")),
        count(F.col("opted")).alias("opted_in"),
        F.sum(F.when(answered, F.col("sign") * F.col("shown"))).alias("_shown"),
        count(answered & F.col("shown").isNotNull()).alias("_of"),
    )
    mean = F.when(F.col("_of") > 0, F.round(F.col("_shown") / F.col("_of"), 6))
    return by.where("n <> 0").select("route", "n", "refused", "low", "mid", "high", "yes", "no", (F.col("n") - F.col("yes") - F.col("no")).alias("unanswered"), "opted_in", mean.alias("mean_shown"))
