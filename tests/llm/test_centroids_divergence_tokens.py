"""Centroids, divergence and token files against brute force, the library, and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter as Counts

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessel.llm import centroids, divergence, token_files

RNG = random.Random(23)


def brute_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda: [min(range(len(middle)), key=lambda c: (far(v, middle[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = place()
        for c in set(at):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            middle[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = place()
    out = [(i, a, far(v, middle[a])) for (i, v), a in zip(kept, at, strict=True)]
    spread = Counts()
    for _, a, d in out:
        spread[a] += d
    return sorted(((i, a, d, spread[a], sum(spread.values()), middle[a]) for i, a, d in out), key=str)


def vectors(n, dims, step):
    return [[RNG.randrange(-8, 9) / step for _ in range(dims)] for _ in range(n)]


@pytest.mark.parametrize("dims,k,step", [(3, 4, 8), (2, 8, 4), (5, 3, 1)])
def test_centroids(spark, dims, k, step):
    rows = list(enumerate(vectors(120, dims, step)))
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, [0.5] * dims), (200, None), (201, [1.0] * (dims - 1)), (202, [float("nan")] * dims), (203, [float("-inf")] + [0.0] * (dims - 1)), (204, [None] + [0.0] * (dims - 1)), (205, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "id long, v array<double>, cluster string").repartition(5)
    got = [tuple(r[c] for c in ("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")) for r in centroids.cluster(df, k, 6, dims, 16, "s").collect()]
    assert sorted(got, key=str) == brute_clusters(rows, k, 6, dims, 16, "s")


def test_centroids_of_few_none_and_far(spark):
    df = spark.createDataFrame([(1, [0.25, 4.0]), (2, [0.25, 4.0]), (3, [-7.0, 1.0])], "id long, v array<float>")
    assert sorted(r["distance"] for r in centroids.cluster(df, dims=2).collect()) == [0, 0, 0]
    assert centroids.cluster(df.where("false"), dims=2).collect() == []
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "id long, v array<float>"), dims=2).collect()
    with pytest.raises(ValueError):
        centroids.fit(df, 0)


def test_bisectors_in_doubles_and_integers_agree():
    rng = np.random.default_rng(5)
    for most in (3, 2000, centroids.REACH):
        middle, x = rng.integers(-most, most + 1, (6, 64)), rng.integers(-most, most + 1, (300, 64))
        middle[4] = middle[1]  # equal centroids: the smaller number
        b = centroids.Bisectors(middle)
        best = b.nearest(x)
        exact = [[sum((int(p) - int(q)) ** 2 for p, q in zip(v, c, strict=True)) for c in middle] for v in x]
        assert best.tolist() == [d.index(min(d)) for d in exact]
        assert b.distances(x, best).tolist() == [min(d) for d in exact]


def brute_audit(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", Counts(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low)))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counts(t for x, _, c in docs if x == lang for t in c)
        kept = [t for t in seen if seen[t] >= least]
        groups = {}
        for x, source, c in docs:
            if x == lang:
                groups.setdefault(source, Counts()).update({t: n for t, n in c.items() if t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counts()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


AUDIT_WORDS = [f"{a}{b}" for a in ("La", "mi", "é", "Σo", "trü", "xx") for b in ("r", "Na", "", "ß")]


def audit_rows():
    rows = [(RNG.choice(["en", "de", None]), RNG.choice(["a", "b", "B", "ü", None]), " ".join(RNG.choices(AUDIT_WORDS, weights=range(1, 25), k=RNG.randrange(0, 60)))) for _ in range(150)]
    rows += [("en", "a", None), ("xx", "lonely", "one two"), ("yy", "u", ""), ("yy", "v", "rare words"), ("en", "only-empty", " 12 \x00 "), ("en", "a", "mi,mi{mi}MI[mi]" * 4000)]
    return rows + rows[:9]


def test_divergence(spark):
    rows = audit_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(4)
    for least, top in ((10, 10), (1, 3)):
        got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df, least, top).collect())
        assert got == brute_audit(rows, least, top)
    assert divergence.audit(df.where("false")).collect() == []


def test_lots_and_blocks_change_nothing(monkeypatch):
    rows = [(lang or "", source or "", text) for lang, source, text in audit_rows()]
    batch = pa.RecordBatch.from_pydict(dict(zip(("lang", "source", "text"), zip(*rows, strict=True), strict=True)))
    plain = lambda t: sorted(map(tuple, (r.values() for r in t.to_pylist())))
    whole = divergence._merged([divergence._counted(batch)])
    shares = pa.table({"lang": whole["lang"], "term": whole["term"], "source": whole["source"], "p": whole["n"], "p0": whole["docs"]}).filter(pa.compute.greater(whole["n"], 0)).sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
    add = lambda tables: plain(pa.concat_tables(tables).group_by(["lang", "source", "item"]).aggregate([("value", "sum")]))
    pairs = add([divergence._pairs(shares)])
    monkeypatch.setattr(divergence, "LOT_BYTES", 200)
    lots = list(divergence._lots(iter([batch, batch.slice(0, 0)])))
    assert len(lots) > 20 and sum(x.num_rows for x in lots) == len(rows)
    assert plain(divergence._merged([divergence._counted(x) for x in lots])) == plain(whole)
    monkeypatch.setattr(divergence, "BLOCK", 16)
    blocks = list(divergence._whole_terms(iter(shares.to_batches(max_chunksize=7))))
    assert len(blocks) > 3 and add([divergence._pairs(b) for b in blocks]) == pairs


def test_divergence_beyond_the_broadcast_and_at_huge_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_GROUPS", 0)
    rows = audit_rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())) == brute_audit(rows, 10, 10)
    n = 7 * 10**17
    assert spark.range(1).select(divergence.share(str(n), str(n), "3")).first()[0] == 1 + 10**9 * (n + 2) // (n + 6)


TEXTS = [(7, "Two words, and a third."), (3, None), (3, "repeated id"), (3, "repeated id"), (None, "no id"), (-4, ""), (11, "<|endoftext|> inside<|startoftext|>x ΟΔΟΣ é ́a\tb\r\n\x1c '"), (9, "a#b " * 9000), (8, "y" * 5000), (2, "naïve 12345 don't WE'LL 😀")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(*r, 5, "clash") for r in TEXTS], "doc_id long, text string, n_tokens int, path string").repartition(3)


def library_rows(rows, end=2):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = [], 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("length,parts", [(2048, None), (16, 1), (5, 7)])
def test_token_files(spark, tmp_path, texts, length, parts):
    files = token_files.write_files(texts, f"file://{tmp_path}/ab", length=length, parts=parts)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_documents(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d or 0))
    assert [b[1] - a[1] for a, b in itertools.pairwise(got)] == [a[2] for a in got[:-1]] and got[0][1] == 0
    text_of = {d: t for d, t in TEXTS if d != 3}
    assert {(d, n, c) for d, _, n, c in got} == {(d, n, c) for d, _, n, c in library_rows([*text_of.items(), (3, None), (3, "repeated id")])}
    streamed = token_files.read_sequences(files).orderBy("sequence").collect()
    assert [r["sequence"] for r in streamed] == list(range(len(streamed)))
    assert all(len(r["ids"]) == len(r["mask"]) == length for r in streamed)
    assert sum(map(sum, (r["mask"] for r in streamed))) == got[-1][1] + got[-1][2]


def test_token_files_of_none(texts, tmp_path):
    assert token_files.read_documents(token_files.write_files(texts.where("false"), str(tmp_path))).collect() == []


def test_sequences_are_views_and_damage_is_found(spark, tmp_path):
    path, ids = f"{tmp_path}/x.arrow", np.arange(1, 1000, dtype=np.uint16)
    file = token_files.SequenceFile(path, np.uint16, 4)
    for at in range(0, len(ids), 123):
        file.add(ids[at : at + 123])
    file.close()
    read = token_files.Sequences(path)
    assert len(read) == 250
    before = pa.total_allocated_bytes()
    views = [read[i] for i in (0, 63, 64, 200, 249)]
    assert pa.total_allocated_bytes() == before
    assert [v.tolist() for v, _ in views[:4]] == [list(range(4 * i + 1, 4 * i + 5)) for i in (0, 63, 64, 200)]
    assert views[4][1].to_pylist() == [True, True, True, False]
    assert np.concatenate(read.span(250, 300)).tolist() == list(range(251, 551))
    with pytest.raises(IndexError):
        read[250]
    files = spark.createDataFrame([(path, path, 998, 0)], "path string, docs_path string, n_tokens long, start long")
    with pytest.raises(Exception, match="has 999 ids"):
        token_files.read_documents(files).collect()
