import json
import random

from pyspark.sql import functions as F

from tessel.streaming import signal

LINES = "id long, route string, score double, shown int, question string, share boolean, ts timestamp"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(k, "ab"[k % 2], float(k), k, "secret" * 100, k % 3 == 0, f"2024-01-01 0{k % 3}:00:00") for k in range(9)]
    turns = spark.createDataFrame(rows, LINES.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    signal.encoded(signal.turn_signals(turns)).write.text(str(tmp_path / "log"))
    batch = signal.hourly(signal.parsed(spark.read.text(str(tmp_path / "log"))).where("ok"))
    stream = signal.hourly(signal.parsed(spark.readStream.schema("value string").text(str(tmp_path / "log"))).where("ok"))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch.collect()))


def test_text_only_with_consent(spark):
    turns = spark.createDataFrame([(1, "a", 5.0, 1, "x" * 400, True, None), (2, "a", 0.5, 0, "y", False, None)], LINES)
    got = {r["id"]: r for r in signal.turn_signals(turns).collect()}
    assert len(got[1]["q"]) == 300 and got[2]["q"] is None and got[2]["refused"]


def test_malformed_lines(spark):
    lines = spark.createDataFrame([("noise",), ("x SIGNAL {broken",), ('12:00 SIGNAL {"kind":"turn","id":3}',)], "value string")
    assert sorted((r["ok"], r["id"]) for r in signal.parsed(lines).collect() if r["ok"]) == [(True, 3)]
    assert signal.parsed(lines).where("not ok").count() == 1


def test_summary_of_a_stream_corrects_itself(spark, tmp_path):
    """Turns and feedback in any order, feedback repeated and changed, over several triggers: the stream's rows sum up to the batch's."""
    rng = random.Random(4)
    lines = []
    for k in range(60):
        lines.append({"kind": "turn", "id": k, "route": "abc"[k % 3], "refused": k % 7 == 0, "top": "low mid high".split()[k % 3 - 1], "shown": k % 5, "ts": f"2024-01-01 0{k % 5}:00:00", **({"q": "x"} if k % 4 == 0 else {})})
        lines += [{"kind": "helpful", "id": k, "helpful": rng.choice(["yes", "no", "none"]), "ts": f"2024-01-01 0{k % 5}:0{1 + n}:00"} for n in range(rng.randrange(4))]
    lines.append({"kind": "helpful", "id": 999, "helpful": "yes", "ts": "2024-01-01 01:00:00"})
    rng.shuffle(lines)
    source, sink, state = (str(tmp_path / x) for x in ("log", "rows", "state"))
    (tmp_path / "log").mkdir()
    stream = signal.signed(signal.parsed(spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(source)).where("ok"), late="6 hours")

    def run(n, part):
        (tmp_path / "log" / f"{n}.txt").write_text("".join(f"{signal.PREFIX}{json.dumps(x)}\n" for x in part))
        q = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink)
        q.awaitTermination()
        parsed = signal.parsed(spark.read.text(source)).where("ok")
        feedback = parsed.where("kind = 'helpful'").select("id", "helpful", F.col("ts").alias("line"))
        want = signal.summary(signal.facts(signal.with_feedback(parsed.where("kind = 'turn'"), feedback)))
        got = signal.summary(spark.read.parquet(sink))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    for n in range(3):  # each is a start of its own: state and rows carry over
        run(n, lines[n::3])
    signs = {r["sign"]: r["count"] for r in spark.read.parquet(sink).groupBy("sign").count().collect()}
    assert signs[1] - signs[-1] == 60 and signs[-1] > 0
