"""Readers, the corpus sink, title search and streams on small files of our own."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from tessel.operators import layout
from tessel.sources import scans
from tessel.streaming import signal


def test_transcripts_and_claims(spark, tmp_path):
    good = {"id": "a", "question": "q", "answer": "x", "outcome": "ok", "claims": [{"claim": "c", "tag": "[t]"}, {"claim": "d", "verdict": "yes"}], "more": 1}
    (tmp_path / "lines.json").write_text(json.dumps(good) + "\n{cut\n" + json.dumps({"id": "b"}) + "\n")
    rows = scans.transcripts(spark, str(tmp_path / "lines.json"))
    assert sorted((r["ok"], r["id"]) for r in rows.collect() if r["ok"]) == [(True, "a"), (True, "b")]
    assert rows.where("not ok").count() == 1
    assert [tuple(r) for r in scans.claims(rows).orderBy("ix").collect()] == [("a", "ok", 0, "c", "[t]", None), ("a", "ok", 1, "d", None, "yes")]
    (tmp_path / "list.json").write_text(json.dumps([good, good], indent=1))
    assert scans.transcripts(spark, str(tmp_path / "list.json"), multi_line=True).where("ok").count() == 2


def test_vectors_without_header_and_stop_words(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 2\nsun 1 2\nthe 0 1\nx9 1 1\nmoon -1.5 0\n")
    got = {r["word"]: list(r["v"]) for r in scans.vectors(spark, str(tmp_path / "v.txt"), stop=("the",)).collect()}
    assert got == {"sun": [1.0, 2.0], "moon": [-1.5, 0.0]}
    assert {r["word"]: r["rank"] for r in scans.vectors(spark, str(tmp_path / "v.txt")).collect()} == {"sun": 2, "the": 3, "moon": 5}


def test_directory_and_its_missing_columns(spark, tmp_path):
    (tmp_path / "d.csv").write_text("name,phone,more\nA,,1\n,2,\n")
    assert sorted(map(tuple, scans.directory(spark, str(tmp_path / "d.csv"), ["name", "phone"]).collect())) == [("", "2", 1), ("A", "", 0)]
    with pytest.raises(ValueError, match="site"):
        scans.directory(spark, str(tmp_path / "d.csv"), ["name", "site"])
    with pytest.raises(Exception, match="no contact in row 0"):
        scans.directory(spark, str(tmp_path / "d.csv"), ["name", "phone"], phone="phone").collect()


def test_a_corpus_with_problems_is_not_written(spark, tmp_path):
    chunks = spark.createDataFrame([("v1", "a", "x")], "corpus_version string, collection string, text string")
    scans.save_corpus(chunks, str(tmp_path / "c"), chunks.where("text is null"))
    with pytest.raises(ValueError):
        scans.save_corpus(chunks.withColumn("text", F.lit("y")), str(tmp_path / "c"), chunks)
    assert spark.read.parquet(str(tmp_path / "c")).first()["text"] == "x"


def test_title_match_against_all_runs(spark):
    notes = [(1, k, k * 100.0, x) for k, x in enumerate(["Powers of", "the council", "Fees", "and charges due", "Short title", "Powers of the board", None, "9 9 9"])] + [(2, 0, 0.0, "Fees")]
    titles = [(1, 1, 100.0, "Powers of the council"), (1, 2, 250.0, "Fees and charges due"), (1, 3, 400.0, "short title"), (1, 4, 500.0, "nothing alike"), (2, 1, 900.0, "Fees")]
    got = {(r["doc"], r["num"]): (r["ord"], r["n_lines"], r["similarity"]) for r in layout.title_match(spark.createDataFrame(notes, "doc int, ord int, y double, text string"), spark.createDataFrame(titles, "doc int, num int, y double, title string")).collect()}
    scored = []
    for doc, num, at, title in titles:
        for d, k, y, _ in notes:
            if d == doc and abs(y - at) <= 300:
                rest = [x for dd, kk, _, x in notes if dd == d and kk >= k and x is not None and kk < k + 6]
                for n in range(1, len(rest) + 1):
                    run = " ".join(rest[:n]).lower()
                    alike = round(difflib.SequenceMatcher(None, run, title.lower()).ratio(), 6)
                    if alike >= 0.6 and set(run.split()) & set(title.lower().split()):
                        scored.append((-alike, num, k, n, doc))
    best, taken = {}, {}
    for row in sorted(scored):
        taken.setdefault((row[4], row[2]), row)
    for row in sorted(taken.values()):
        best.setdefault((row[4], row[1]), (row[2], row[3], -row[0]))
    assert got == best and got[1, 1][:2] == (0, 2) and got[1, 2][:2] == (2, 2) and (2, 1) not in got
    assert layout.title_match(spark.createDataFrame([], "doc int, ord int, y double, text string"), spark.createDataFrame(titles, "doc int, num int, y double, title string")).count() == 0


def test_lines_sink_and_joined_streams(spark, tmp_path):
    turns = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00"), (3, "2024-01-01 09:00:00")], "id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    turns.write.parquet(str(tmp_path / "turns"))
    feedback = spark.createDataFrame([(1, "2024-01-01 00:30:00", "Yes"), (2, "2024-01-01 05:00:00", "No"), (9, "2024-01-01 09:30:00", "No")], "id long, ts string, helpful string").withColumn("ts", F.to_timestamp("ts"))
    feedback.write.parquet(str(tmp_path / "feedback"))
    stream = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    q = signal.joined_stream(stream("turns"), stream("feedback")).writeStream.format("memory").queryName("met").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    met = {r["id"]: r["helpful"] for r in spark.table("met").collect()}
    assert met[1] == "Yes" and met.get(2) is None
    q = signal.saved(signal.encoded(stream("turns").withColumn("kind", F.lit("turn"))), str(tmp_path / "log"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert sorted(r["id"] for r in signal.parsed(spark.read.text(str(tmp_path / "log"))).where("ok").collect()) == [1, 2, 3]
