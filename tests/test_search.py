"""The written index, pruned top-k, containment, similar pairs, numbers in a global order and strict curves, each against brute force."""

import collections
import difflib
import functools
import itertools
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.functions.text import terms_of
from tessel.operators import contain, directory, evaluate, layout, order, scoring, search, similar, sizes
from tessel.sources import scratch

RNG = random.Random(31)


@pytest.fixture(scope="module")
def chunks(spark):
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    texts = [" ".join(RNG.choices(words, weights=[1 + k * k for k in range(64)], k=RNG.randrange(1, 25))) for _ in range(700)]
    return spark.createDataFrame([("a" if k % 3 else "b", k, t) for k, t in enumerate(texts)] + [("b", 9000, ""), ("c", 9001, "wak")], "collection string, chunk_ord long, text string").repartition(3)


def plain_top(queries, index, k):
    """All postings, no limit."""
    q = search.query_terms(queries, index.vocab)
    scored = q.join(index.postings, ["collection", "term"]).groupBy("query_id", "collection", "chunk_ord").agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))
    rows = sorted(((r["query_id"], r["collection"], -r["score"], r["chunk_ord"]) for r in scored.collect() if r["score"] > 0))
    return {(q, c): [(o, -s) for _, _, s, o in list(g)[:k]] for (q, c), g in itertools.groupby(rows, key=lambda r: r[:2])}


@pytest.mark.parametrize("block,hot,k", [(16, 5, 3), (64, 40, 10), (1024, 256, 4), (8, 0, 2)])
def test_blocks_and_limits_lose_no_hit(spark, chunks, block, hot, k):
    index = search.Index(chunks, block=block, hot=hot)
    asked = [r["text"] for r in chunks.where("chunk_ord < 40").collect()] + ["wak", "whr whq whp", "nothing known", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {}
    for r in search.top_k(queries, index, k).orderBy("query_id", "collection", "rank").collect():
        got.setdefault((r["query_id"], r["collection"]), []).append((r["chunk_ord"], r["score"]))
    assert got == plain_top(queries, index, k)


def test_index_outlives_its_object(spark, chunks):
    index = search.Index(chunks, at=scratch.folder(spark, "kept"), hot=20)
    queries = spark.createDataFrame([(1, "wak whr whq")], "query_id long, text string")
    again = search.Index.opened(spark, index.at, hot=20)
    assert search.top_k(queries, again, 5).collect() == search.top_k(queries, index, 5).collect() != []
    assert index.postings.groupBy("collection", "chunk_ord").agg(F.sum(F.col("weight") ** 2).alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_containing(spark):
    texts = ["the quick brown fox jumps over the lazy dog tonight", "a quick brown fox", "x the quick brown fox jumps over the lazy dog tonight y", "", None, "fox-trot,the (quick) brown", "ab" * 40, "over the lazy dog tonight over the lazy dog tonight"]
    needles = ["quick brown fox jumps over the lazy", "uick brown fox jumps over the laz", "fox", "o", "", None, "over the lazy dog tonight", "(quick)", "bab", "the  quick brown fox jumps", "tonight over the lazy dog t", "no such words are in any text here", "dog tonight y"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "needle long, what string")
    want = {(i, j) for i, w in enumerate(needles) for j, x in enumerate(texts) if w and x is not None and w in x}
    found = contain.containing(n, t)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert contain.containing(n.where("false"), t).count() == contain.containing(n, t.where("false")).count() == 0


def words_(n, letters="abcde1"):
    return sorted({"".join(RNG.choices(letters, k=RNG.randrange(1, 9))) for _ in range(n)})


@pytest.mark.parametrize("method,least", [("ratio", 0.6), ("ratio", 0.8), ("levenshtein", 0.6), ("levenshtein", 0.75)])
def test_similar_pairs_are_all_found(spark, method, least):
    a, b = words_(90) + ["aaaaaaa", "bababa"], words_(90) + ["aaaaaab", "ababab"]
    left, right = (spark.createDataFrame([(w,) for w in dict.fromkeys(ws)], f"{c} string") for ws, c in ((a, "a"), (b, "b")))
    got = {(r["a"], r["b"]): r["score"] for r in similar.similar_pairs(left, right, least, method).collect()}
    if method == "ratio":
        want = {(x, y): round(difflib.SequenceMatcher(None, x, y).ratio(), 6) for x in a for y in b}
    else:
        rows = left.join(right, F.lit(True)).withColumn("s", F.round(similar.levenshtein_ratio(F.col("a"), F.col("b")), 6)).collect()
        want = {(r["a"], r["b"]): r["s"] for r in rows}
    assert got == {p: s for p, s in want.items() if s >= least} and got


def test_lookups_have_no_nested_loop(spark):
    rows = [(1, "Hearing;Speech", "Lagos, Ikeja"), (2, "Visual", "Abuja"), (3, "visual / hearing", "Port Harbour"), (4, "All", "")]
    listing = spark.createDataFrame(rows, "pos long, focus string, location string")
    asked = spark.createDataFrame([(1, "visual", "lagoz"), (2, "hearin", "harbor"), (3, "", "Abuja"), (4, "", ""), (5, "zzz", "zzz"), (6, "speech", "nowhere")], "query_id long, category string, place string")
    place = {(r["query_id"], r["pos"]): r["how"] for r in directory.located(asked, listing).collect()}
    assert place == {(1, 1): "fuzzy", (2, 3): "fuzzy", (3, 2): "substring"}  # one token of each place is near
    found = directory.lookup(asked, listing, fallback=4, k=2)
    got = sorted((r["query_id"], r["rank"], r["pos"], r["note"]) for r in found.collect())
    assert got == [(1, 1, 2, "place ignored"), (1, 2, 3, "place ignored"), (2, 1, 3, "place matched"), (3, 1, 2, "place matched"), (4, 1, 1, "no place"), (4, 2, 2, "no place"), (5, 1, 4, "fallback"), (6, 1, 1, "place ignored")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_in_a_global_order(spark):
    df = spark.createDataFrame([(RNG.randrange(50), k) for k in range(500)], "a int, k long").repartition(7)
    got = [(r["a"], r["k"]) for r in order.numbered(df, F.desc("a"), "k", name="n", first=0).orderBy("n").collect()]
    assert got == sorted(((r["a"], r["k"]) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert [r["rank"] for r in order.numbered(df, "a", "k").orderBy("rank").collect()] == list(range(1, 501))
    assert order.numbered(df.where("false"), "k").count() == 0
    assert "SinglePartition" not in order.numbered(df, "a", "k")._jdf.queryExecution().executedPlan().toString()


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3), ("c", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k} {'x' * RNG.randrange(30)}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = order.line_numbers(spark.read.text(str(tmp_path)), first=0).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(rows) == 403 and all(r["value"].split()[0][1:] == str(r["line"]) for r in rows)


def brute_matching(pairs, hits):
    best = 0
    for n in range(len(pairs), 0, -1):
        for chosen in itertools.combinations(pairs, n):
            if all(len({h for h, ps in hits.items() if ps & set(sub)}) >= len(sub) for k in range(1, n + 1) for sub in itertools.combinations(chosen, k)):
                return n
    return best


def test_strict_curve_equals_a_matching_of_each_prefix(spark):
    rows, want, depths = [], {}, [1, 2, 3, 5, 8]
    for q in range(40):
        pairs = list(range(RNG.randrange(1, 5)))
        hits = {r: {p for p in pairs if RNG.random() < 0.35} for r in range(1, 9)}
        rows += [(q, p, r) for r, ps in hits.items() for p in ps] + [(q, p, None) for p in pairs if not any(p in ps for ps in hits.values())]
        want[q] = tuple(round(brute_matching(pairs, {r: ps for r, ps in hits.items() if r <= d}) / len(pairs), 6) for d in depths)
    covers = spark.createDataFrame(rows, "query_id long, pair long, rank long").repartition(5)
    got = {r["query_id"]: tuple(r[f"s{d}"] for d in depths) for r in evaluate.strict_curve(covers, depths).collect()}
    assert got == want


def test_small_counts_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array_repeat(F.lit(1.0), 10).alias("v"), F.create_map(F.lit("k"), F.col("id")).alias("m"), F.struct("id").alias("z"))
    assert 100_000 < sizes.bytes_of(df) < 140_000 and sizes.bytes_of(df.where("false")) == 0
    assert "hint" in sizes.small(df, 200_000)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in sizes.small(df, 50_000)._jdf.queryExecution().logical().toString().lower()


def brute_alignment(rows, expected, least):
    """The most points of all placings in which numbers and rows rise, by recursion over numbers and rows."""
    def points(num, title, text):
        head = re.match(r"\s*([0-9]{1,6})\b[.)]?\s*", text)
        led = bool(head) and int(head[1]) == num
        body = text[head.end() :].strip() if head else text.strip()
        shared = set(re.findall(r"\w+", body.lower())) & set(re.findall(r"\w+", title.lower()))
        like = round(difflib.SequenceMatcher(None, body.lower(), title.lower()).ratio(), 6) if led or shared else 0
        return led, like if like >= least else 0

    @functools.cache
    def best(i, j):
        if i == len(expected) or j == len(rows):
            return 0
        led, like = points(*expected[i], rows[j])
        here = 10**6 * led + round(1e6 * like)
        return max(best(i + 1, j), best(i, j + 1), here + best(i + 1, j + 1) if here else 0)

    return best(0, 0), points


def test_aligned_anchors_are_the_best_placing(spark):
    titles = ["Short title", "Opening hours", "Duties of bakers", "Kettles and lids", "Repeal"]
    rng, rows, want = random.Random(8), [], []
    for doc in range(25):
        lines = []
        for n, title in enumerate(titles, 1):
            lines += rng.choice([[f"{n}. {title}"], [title], [f"{n} {title.upper()}x"], [f"{n}. quite other"], [f"{rng.randrange(1, 6)} see elsewhere", f"{n}. {title}"], []])
        rows += [(doc, k, text) for k, text in enumerate(lines)]
    expected = [(doc, n, title) for doc in range(25) for n, title in enumerate(titles, 1)]
    got = layout.aligned_anchors(spark.createDataFrame(rows, "doc long, ord long, text string"), spark.createDataFrame(expected, "doc long, num int, title string")).collect()
    for doc in range(25):
        lines = [text for d, _, text in rows if d == doc]
        most, points = brute_alignment(tuple(lines), tuple(enumerate(titles, 1)), 0.6)
        mine = sorted((r["num"], r["ord"], r["flag"]) for r in got if r["doc"] == doc)
        assert [o for _, o, _ in mine] == sorted({o for _, o, _ in mine}) and [n for n, _, _ in mine] == sorted({n for n, _, _ in mine})
        told = [points(n, titles[n - 1], lines[o]) for n, o, _ in mine]
        assert sum(10**6 * led + round(1e6 * like) for led, like in told) == most
        assert [f for _, _, f in mine] == [None if led and like else "TITLE_WEAK" if led else "NUMERAL_MISSING" for led, like in told]
    assert {r["flag"] for r in got} == {None, "TITLE_WEAK", "NUMERAL_MISSING"}


def test_index_holds_no_postings_and_passes_are_bounded(spark, chunks, monkeypatch):
    index = search.Index(chunks, block=50, hot=3)
    assert {f.name for f in pathlib.Path(index.at).iterdir() if not f.name.startswith(".")} == {"stems", "vocab"}
    asked = [r["text"] for r in chunks.where("chunk_ord < 12").collect()]
    queries = spark.createDataFrame([(f"q/{i}", x) for i, x in enumerate(asked)], "query_id string, text string")
    monkeypatch.setattr(search, "MOST_ASKED", 150)  # several passes
    monkeypatch.setattr(search, "MOST_COMMON", 60)  # most idfs are known by bounds alone
    got = {}
    for r in search.top_k(queries, index, 3).orderBy("query_id", "collection", "rank").collect():
        got.setdefault((r["query_id"], r["collection"]), []).append((r["chunk_ord"], r["score"]))
    assert got == plain_top(queries, index, 3) and index.limit > 3


def test_scorer_keeps_all_that_can_be_among_the_best(monkeypatch):
    monkeypatch.setattr(scoring, "MOST_KEPT", 5)
    texts = [" ".join(RNG.choices("abcdefghij", k=6)) for _ in range(200)]
    idf = {x: 1 + RNG.random() for t in texts for x in terms_of(t)}
    known = list("abc") + ["a b"]
    space = scoring.Scorer(known, np.array([idf.get(x, 1.5) for x in known]), 1.0, 2.0, np.array([0, 1, 3]), np.array([7, 9, 7]), np.array([0.5, 1.0, 0.5]), 4)
    for at in range(0, 200, 30):
        space.add(texts[at : at + 30], np.arange(at, min(at + 30, 200)))
    kept, query = space.left()[:2]
    for place, weights in enumerate([{"a": 0.5, "a b": 0.5}, {"b": 1.0}]):
        tfs = [collections.Counter(terms_of(t)) for t in texts]
        score = [sum(w * tf[x] * idf.get(x, 1.5) for x, w in weights.items()) / sum((n * idf[x]) ** 2 for x, n in tf.items()) ** 0.5 for tf in tfs]
        assert set(sorted(range(200), key=lambda i: -score[i])[:4]) <= set(kept[query == place].tolist())
    assert space.queries.tolist() == [7, 9] and len(kept) < 200


@pytest.mark.parametrize("most", [1, 300, 1 << 22])
def test_terms_of_lots_are_those_of_lines(most):
    """In lots of one row or many: terms, their counts, and the numbers of known ones."""
    texts = [" ".join(RNG.choices(["aa", "ab", "b", "ba", "cc"], k=RNG.randrange(0, 9))) for _ in range(120)] + [None, "aa", "ba ba ba"]
    names = [RNG.choice(["x", "y"]) for _ in texts]
    batches = [pa.RecordBatch.from_arrays([pa.array(names[at : at + 50]), pa.array(range(at, min(at + 50, len(texts)))), pa.array(texts[at : at + 50], pa.string())], ["collection", "n", "stems"]) for at in range(0, len(texts), 50)]
    known, got = scoring.Known(["ab", "aa ab", "cc cc", "ba", "zz", "zz aa"]), {}
    for lot in scoring.lots(iter(batches), most):
        for name, own in scoring.by_collection(lot):
            words, row, key, tf = scoring.occurring(lot["stems"].chunk(0).take(pa.array(own)))
            for r, term, n, number in zip(row, scoring.named(words, key).to_pylist(), tf, known.find(words, key), strict=True):
                got.setdefault((name, lot["n"][own[r]].as_py()), {})[term] = n
                assert number == {"ab": 0, "aa ab": 1, "cc cc": 2, "ba": 3}.get(term, -1)
    assert got == {(c, i): collections.Counter(terms_of(t)) for i, (c, t) in enumerate(zip(names, texts, strict=True)) if t}


@pytest.mark.parametrize("lot", [1, 1 << 22])
def test_containing_takes_any_letters_and_lots(spark, monkeypatch, lot):
    monkeypatch.setattr(contain, "_LOT", lot)
    letters = ["Straße", "naïve", "кот", "東京", "42", "x", "don't", "a_b", "  ", "\n", "…"]
    texts = [" ".join(RNG.choices(letters, k=RNG.randrange(0, 30))) for _ in range(60)]
    needles = [t[i : i + RNG.randrange(1, 60)] for t in texts[:30] for i in [RNG.randrange(0, len(t) + 1)]]
    t, n = (spark.createDataFrame(list(enumerate(x)), schema) for x, schema in ((texts, "id long, text string"), (needles, "needle long, what string")))
    found = contain.containing(n, t)
    assert {tuple(r) for r in found.collect()} == {(i, j) for i, w in enumerate(needles) for j, x in enumerate(texts) if w and w in x}
    assert not {"transform", "regexp_extract_all"} & set(contain._shingled(t, "id")._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").split())


@pytest.mark.parametrize("share,heads", [(0.0, 256), (0.01, 5), (2.0, 0)])
def test_scorer_of_many_queries(monkeypatch, share, heads):
    """Terms in the matrix product or not: kept hits have their exact products, and the k best of each query are among them."""
    monkeypatch.setattr(scoring, "HEAD_SHARE", share)
    monkeypatch.setattr(scoring, "MOST_HEADS", heads)
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmn"]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 12), p=np.arange(1, 33) / 528)) for _ in range(500)]
    terms = sorted({x for t in texts for x in terms_of(t)})
    place, idf = {x: i for i, x in enumerate(terms)}, 1 + 4 * rng.random(len(terms))
    weights = np.zeros((300, len(terms)))
    for q in range(300):
        for x in terms_of(texts[q]):
            weights[q, place[x]] += idf[place[x]]
    weights /= np.sqrt((weights**2).sum(axis=1))[:, None]
    query, number = np.nonzero(weights)
    space = scoring.Scorer(terms, idf, 1.0, 5.0, number, query + 1000, weights[query, number], 3)
    assert space.heads.shape[1] <= heads and (space.heads.shape[1] > 0) == (heads > 0)
    for at in range(0, 500, 90):
        space.add(texts[at : at + 90], np.arange(at, min(at + 90, 500)), block=40)
    chunk, q, dot, least, most = space.left()
    tf = np.array([[c[x] for x in terms] for c in (collections.Counter(terms_of(t)) for t in texts)])
    want, length = (tf * idf) @ weights.T, np.sqrt(((tf * idf) ** 2).sum(axis=1))
    assert np.allclose(dot, want[chunk, q], rtol=1e-12) and np.all(space.queries == np.arange(300) + 1000)
    assert np.allclose(least, dot / length[chunk]) and np.allclose(most, least)
    assert len(set(zip(chunk.tolist(), q.tolist(), strict=True))) == len(chunk) < 500 * 300 / 20
    score = want / length[:, None]
    for k in range(300):
        assert set(np.argsort(-score[:, k], kind="stable")[:3].tolist()) <= set(chunk[q == k].tolist()) or np.sum(score[:, k] >= np.sort(score[:, k])[-3] - 1e-12) > 3
    for n in (0, 1, 7, 8, 9, 100):
        flags = rng.random(n) < 0.2
        assert scoring.set_places(flags).tolist() == np.flatnonzero(flags).tolist()


@pytest.mark.parametrize("k", [1, 4])
def test_first_chunks_limit_the_others(spark, chunks, monkeypatch, k):
    """With a part of the chunks first, the same hits; what tasks keep is less than by their own limits alone."""
    index = search.Index(chunks, hot=5)
    queries = spark.createDataFrame(list(enumerate(r["text"] for r in chunks.where("chunk_ord < 60").collect())), "query_id long, text string")
    rows, got = [], []
    monkeypatch.setattr(search, "written", lambda df, label, whole=search.written: rows.append((label, out := whole(df, label))) or out)
    monkeypatch.setattr(search, "dropped", lambda *tables: None)
    for most in (1 << 20, 0):
        monkeypatch.setattr(search, "MOST_MET", most)
        hits = search.top_k(queries, index, k).orderBy("query_id", "collection", "rank").collect()
        got.append(([tuple(r) for r in hits], [x.count() for label, x in rows if label == "bounded"]))
        rows.clear()
    assert got[0][0] == got[1][0] != [] and [len(n) for _, n in got] == [1, 2]
    want = plain_top(queries, index, k)
    assert sum(map(len, want.values())) == len(got[0][0]) and got[1][1][1] < got[0][1][0]
