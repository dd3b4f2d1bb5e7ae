"""The corpus operators against brute force, round trips and odd inputs."""

import hashlib
import itertools
import math
import random
import re
import time

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from tessel.llm.common import written
from tessel.llm import bpe, components, decontaminate, groups, html_extract, ngram_join, pii, quality_classifier, quality_rules, registry, substring_dedup, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
random.seed(7)
WORDS = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "sta", "é") for b in ("rn", "t", "se", "lo")]


def prose(n, words=WORDS):
    return " ".join(random.choice(words) for _ in range(n))


BASE = prose(60)
EDITED = BASE.replace(BASE.split()[30], "zzz", 1)
ODD = [
    (1, BASE), (2, BASE), (3, EDITED), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, prose(3000)), (10, "x" * 20000), (11, BASE.upper()), (12, "\n".join([BASE, prose(40), BASE])), (12, prose(5)), (None, BASE),
    (13, "mail a.b@c.de or +1 (743) 555-3824, 10.0.0.1 and 4111 1111 1111 1111"), (14, "1 2-3 " * 2000), (15, "😀 é <|endoftext|> ʼn\x1c" * 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string, n int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def brute_sets(k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t in ODD:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    return out


def test_ngram_join(docs, none):
    sets, ids = brute_sets(3), [i for i, _ in ODD]
    owner = list(range(len(sets)))

    def top(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            owner[max(top(a), top(b))] = min(top(a), top(b))
    want = []
    for k, i in enumerate(ids):
        mates = [ids[j] for j in range(len(ids)) if top(j) == top(k) and ids[j] is not None]
        want.append((i, len(sets[k]), min(mates) if mates else None))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_groups(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ngram_join.join_groups(none).count() == 0


def test_pipeline_keeps_one_of_each_group_at_five_words(spark):
    """Chains of edited texts of all sizes, most with pairs of 0.8 or more on five words and under 0.9 on three."""
    rng, texts = random.Random(11), []
    for n in [*range(3, 40, 4), 50, 50, 50, 60, 90, 150]:
        words = [rng.choice(WORDS) for _ in range(n)]
        for _ in range(4):
            texts.append(" ".join(words))
            words = [*words]
            words[rng.randrange(n)] = f"new{len(texts)}"
    texts += [BASE, BASE, "", " ".join(BASE.split()[:50]), " ".join(BASE.split()[:49])]

    def kept(k, num, den):
        sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)} - {()} for w in map(str.split, texts)]
        owner = list(range(len(sets)))

        def top(x):
            while owner[x] != x:
                x = owner[x]
            return x

        for a, b in itertools.combinations(range(len(sets)), 2):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                owner[max(top(a), top(b))] = min(top(a), top(b))
        return [i for i in range(len(sets)) if top(i) == i]

    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.one_of_each_group(spark, d, DATA)
    assert got.columns == d.columns
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == kept(5, 80, 100) != kept(3, 90, 100)


def test_rows_without_an_id_link(spark):
    """A row of null id links to a near copy, and rows that share an id are sets of their own."""
    words = [f"w{k}" for k in range(200)]
    near = " ".join([*words[:100], "other", *words[101:]])
    rows = [(5, " ".join(words)), (None, near), (8, prose(40)), (8, near), (None, "alone is this one"), (9, None)]
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_join.join_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", "5"), ("8", "5"), ("8", "8"), ("9", "9"), ("None", "5"), ("None", "None")]


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(1)
    for n, m, both in ((50, 52, 45), (400, 380, 350), (5000, 5100, 4900), (1, 1, 1), (3, 2, 0)):
        x = rng.integers(-(2**63), 2**63, n + m - both)
        a, b = groups.parity(x[:n]), groups.parity(x[n - both :])
        turned = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64))
        assert turned <= n + m - 2 * both and (n + m - 2 * both > 100 or turned >= 0.7 * (n + m - 2 * both))


def test_small_sets_meet_under_subsets():
    for n, m in itertools.product(range(1, 28), repeat=2):
        if 90 * max(n, m) <= 100 * min(n, m):
            c = groups.need(n, m, 90, 100)
            assert c in ngram_join.subset_sizes(n, 90, 100) and c in ngram_join.subset_sizes(m, 90, 100)


def test_keep_first_keeps_columns(docs):
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    assert ids.count(12) == 1 and 2 not in ids and 8 not in ids and {1, 4, 5, 6, 7, None} <= set(ids)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_quality_rules(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs.where("doc_id <> 12")).collect()}
    for i, t in ODD:
        if i in (None, 12):
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        hit, seen = set(), {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                hit.update(k + j for k in at for j in range(5))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t or ""), sum(x in lines[:k] for k, x in enumerate(lines)))
    assert quality_rules.quality_rules(none).count() == 0


def test_line_limits_against_brute_force(spark):
    """Every verdict on small and hot hosts, with copies, cases and digits that fold, null hosts and repeated ids."""
    rng = random.Random(4)
    common = ["Page 1 of 9 of this fine site", "all rights are reserved here", "read more | next"]
    rows = []
    for k in range(900):
        own = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(4))]
        if rng.random() < 0.3:
            own += [rng.choice(common).replace("1", str(k)), *([rng.choice(common).upper()] if rng.random() < 0.5 else [])]
        rows.append((k // 2, "\n".join(own), "hot" if k < 700 else None if k < 800 else f"h{k % 7}"))
    rows += rows[:50] * 3
    fold = lambda x: " ".join(re.sub("[0-9]+", "0", x.lower()).split())
    docs, have = {}, {}
    for _, t, h in rows:
        docs.setdefault(h, set()).add(t)
        for x in t.split("\n"):
            have.setdefault((h, fold(x)), set()).add(t)
    want = []
    for i, t, h in rows:
        n, left = len(t.split()), 0
        for x in t.split("\n"):
            c = len(have[h, fold(x)])
            left += 0 if c >= 3 and c > 0.01 * len(docs[h]) else len(x.split())
        want.append((i, n, left, left < 0.3 * n))
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["words_left"], r["depleted"]) for r in got) == sorted(want)
    assert all(r["kept"] == (not r["base_failed"] and not r["depleted"]) for r in got) and 10 < sum(r["depleted"] and not r["base_failed"] for r in got)


def test_shared_lines_deplete(spark):
    line = "all rights reserved by the owners of this site"
    rows = [(k, f"{line}\n{prose(20)}", "h") for k in range(30)] + [(100 + k, f"{line} {k}\n{prose(2)}", "h") for k in range(30)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3]["n_removed_lines"] == 1 and got[3]["kept"] and got[100]["depleted"] and not got[100]["kept"]


def jaccard_parts(lines, k=5, num=80, den=100):
    """Groups (sets of places) of lines (place, words) that exact Jaccard of k-word shingles links, of two lines or more."""
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for _, w in lines]
    owner = list(range(len(lines)))

    def top(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a, b in itertools.combinations(range(len(lines)), 2):
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            owner[max(top(a), top(b))] = min(top(a), top(b))
    out = {}
    for k in range(len(lines)):
        out.setdefault(top(k), []).append(lines[k][0])
    return sorted((sorted(x) for x in out.values() if len(x) > 1), key=str)


def test_paragraphs_against_all_pairs(spark, none):
    """Chains of edited lines under ids of their own, a shared id and no id; the groups are those of all pairs."""
    rng, rows = random.Random(3), []
    for n in (20, 24, 30, 45, 80, 200):
        words = [rng.choice(WORDS) for _ in range(n)]
        for step in range(6):
            other = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 60)))
            rows.append((7 if step == 2 else None if step == 3 else len(rows) * 10, f"{other}\nshort line\n {' '.join(words)} \n{other if step == 4 else ''}"))
            words = [*words]
            words[rng.randrange(n)] = f"new{len(rows)}"
    rows += [(900, None), (901, ""), (902, "\n\n"), (7, rows[0][1]), (7, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lines = []
    for i, t in rows:
        at = 0
        for line in (t or "").split("\n"):
            lead = len(line) - len(line.lstrip(" "))
            if len(line.split()) >= substring_dedup.LEAST:
                lines.append((((-1 if i is None else i), at + lead, at + len(line.rstrip(" "))), line.split()))
            at += len(line) + 1
    named, found = substring_dedup.repeated(d)
    got = {}
    for r in found.where("not inner").collect():
        got.setdefault(r["component"], []).append((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["end"]))
    assert sorted((sorted(x) for x in got.values()), key=str) == jaccard_parts(lines)
    assert named.count() == len(rows) and found.where("keep").count() == found.select("component", "inner").distinct().count()
    by = substring_dedup.dedup_documents(d).collect()
    assert sorted(str(r["doc_id"]) for r in by) == sorted(str(i) for i, _ in rows)
    assert sum(r["n_repeated"] for r in by) == found.count() and substring_dedup.dedup_documents(none).count() == 0


def test_spans_of_shared_ids_stay_apart(spark):
    line = prose(30)
    rows = [(7, line + "\n" + prose(25)), (7, prose(40) + "\n" + line), (None, line), (3, prose(22))]
    got = sorted((str(r["doc_id"]), r["removed"]) for r in substring_dedup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    at = len(rows[1][1]) - len(line)
    assert [x for x in got if x[1]] in ([("7", f"0:{len(line)}"), ("7", f"{at}:{at + len(line)}")], [("7", f"0:{len(line)}"), ("None", f"0:{len(line)}")], [("7", f"{at}:{at + len(line)}"), ("None", f"0:{len(line)}")])


def test_runs_inside_other_text_share_a_window(spark):
    """A run of GUARANTEE words is found wherever it stands, with other lines and no sentences; a shorter one needn't be."""
    rng = random.Random(5)
    free = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(30):
        run = free(substring_dedup.GUARANTEE)
        rows += [(2 * k, f"{free(30)} {run} {free(40)}"), (2 * k + 1, f"{free(17)} é😀 " + run.replace(" ", "\n", 3) + f" {free(9)}")]
    rows += [(100, "x " * 5000), (101, free(300))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated(d)[1].where("inner").collect()
    text = dict(rows)
    assert {r["doc_id"] for r in found} == {*range(60), 100}
    for r in found:
        assert len(text[r["doc_id"]][r["start"] : r["end"]].split()) == substring_dedup.WINDOW
        assert r["doc_id"] == 100 or text[r["doc_id"]][r["start"] : r["end"]].split() == text[r["first"]][text[r["first"]].index(text[r["doc_id"]][r["start"] : r["end"]].split()[0]) :].split()[: substring_dedup.WINDOW]


def test_bands_reach_their_recall():
    b, r = substring_dedup.tune_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999


def test_toxicity(spark, none):
    rows = [(k, prose(30) + (" scum idiot loser"[: 5 + 6 * (k % 3)] + " scum" if k % 4 == 0 else "")) for k in range(400)]
    d = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(5, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.severity(d, model).collect()}
    assert sum(got[k]["rejected"] == (k % 4 == 0) for k in range(300, 400)) >= 95
    assert not got[1000]["rejected"] and not got[1001]["rejected"] and list(model.cuts) == sorted(model.cuts)
    kept = toxicity.keep_clean(d, model)
    assert kept.count() == sum(not r["rejected"] for r in got.values()) and kept.columns == d.columns
    untrained = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.severity(d, untrained).where("rejected").count() == 0 and toxicity.severity(none, model).count() == 0


def test_quality_classifier_on_held_out_rows(spark, none):
    rows = [(k, prose(30) if k % 2 else " | ".join(prose(30).split())) for k in range(600)] + [(9000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    weights, bias = quality_classifier.fit(d, spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, quality int"))
    got = quality_classifier.score(d, weights, bias).withColumn("held", quality_classifier.held_out("doc_id")).collect()
    tested = [r for r in got if r["held"] and r["doc_id"] < 9000]
    assert tested and sum((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in got) and quality_classifier.score(none, weights, bias).count() == 0


@pytest.mark.parametrize("shard", [1 << 20, 200])
def test_decontaminate(spark, docs, none, shard):
    items = [(1, BASE), (2, "Zzz"), (10, "one TWO"), (3, None), (4, "?!"), (5, " ".join(BASE.split()[5:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(low))
    windows = {(i, tuple(w[k : k + min(10, len(w))])) for i, t in items for w in [split(t)] for k in range(max(0, len(w) - 9) or bool(w))}
    want = []
    for i, t in ODD:
        w, hit, found = split(t), set(), set()
        for k, (item, win) in itertools.product(range(len(w)), windows):
            if tuple(w[k : k + len(win)]) == win:
                hit.update(range(k, k + len(win)))
                found.add(str(item))
        want.append((i, len(w), len(hit), tuple(sorted(found))))
    rows = decontaminate.decontaminate(docs, bench, shard_bytes=shard).collect()
    assert sorted(((r["doc_id"], r["n_words"], sum(s["word_end"] - s["word_start"] for s in r["spans"]), tuple(r["item_ids"])) for r in rows), key=str) == sorted(want, key=str)
    for r in rows:
        text = next(t for i, t in ODD if i == r["doc_id"])
        if r["doc_id"] in (1, 3, 11):
            assert all(len(split(text[s["char_start"] : s["char_end"]])) == s["word_end"] - s["word_start"] for s in r["spans"])
    kept = decontaminate.keep_clean(docs, bench, shard_bytes=shard)
    assert kept.count() == sum(not h for _, _, h, _ in want) and kept.columns == docs.columns
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.where("false")).where("size(spans) > 0").count() == 0


def test_token_counts(docs, none):
    library = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY)).library
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    for chunk, overlap in ((16384, 256), (200, 20)):
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, chunk=chunk, overlap=overlap).collect()) == want
    assert token_counts.count_tokens(none).count() == 0


def test_token_counts_without_white_space():
    """As the library counts them, at any chunk size, and in time that grows with the text."""
    c = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    rng = random.Random(8)
    signs = ["ab", "don't", "'s", "!'s", "İ", "e\u0301", "e", "9", "42", ",", "''", "日本", "，", "ß", "\u0301", "😀", "K", "ŉ"]
    for _ in range(150):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(200)))
        for chunk, overlap in ((40, 5), (17, 16), (90, 30)):
            assert c.long(t, chunk, overlap) == len(c.starts(t))
    began = time.time()
    for t in ("x" * 400_000, "語" * 400_000, "一二三，" * 100_000, "ab1" * 130_000):
        assert c.long(t) == len(c.starts(t))
    assert time.time() - began < 60


def test_token_counts_of_another_vocabulary():
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert not c.proven
    texts = ["a b  c", "don't", ""]
    assert c.short(texts) == [len(c.starts(t)) for t in texts] == [c.long(t, 2, 1) for t in texts]


def test_byte_bpe(docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    codec = bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = [t or "" for _, t in ODD] + ["ab" * 2000, "日本語 " * 50, "".join(chr(random.randrange(32, 0x2FFF)) for _ in range(2000))]
    assert codec.encode(texts) == [other.encode_ordinary(t) for t in texts]
    got = sorted(((r["doc_id"], r["decoded_sha256"]) for r in bpe.digests(docs).collect()), key=str)
    assert got == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD), key=str)
    assert bpe.digests(none).count() == 0
    assert {bytes(r["decoded"]) for r in bpe.encode(docs).collect()} == {(t or "").encode() for _, t in ODD}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, none):
    alphabet = "0123456789" * 3 + "  --..@+()ab,\n😀é"
    rows = [(100 + k, "".join(random.choice(alphabet) for _ in range(random.randrange(300)))) for k in range(150)] + [(i, t) for i, t in ODD if i]
    got = pii.digests(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = sorted((i, hashlib.sha256(",".join(brute_pii(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((r["doc_id"], r["base_sha256"]) for r in got) == want
    for r in got:
        text = next((t for i, t in rows if i == r["doc_id"]), None)
        if r["doc_id"] != 12:
            assert set(brute_pii(text)) <= set(r["spans"].split(",") if r["spans"] else [])
    assert pii.find_pii(none).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ODD)
    assert clean.where("doc_id = 13").first()["text"] == "mail <EMAIL> or <PHONE>, <IP> and <CARD>"


COMPACT = ["Call +14155550123, please", "my number: +14155550123", "+14155550123\nnext line", "+1 4 1 5 5 5 5 0 1 2 3", "(+14155550123)", "+1", "+1415", "a+14155550123b", "no number"]


def test_pii_without_separators(spark):
    rows = list(enumerate(COMPACT))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_phone"], r["base_sha256"], r["spans"]) for r in pii.digests(pii.find_pii(d)).collect()}
    for i, t in rows:
        spans = brute_pii(t)
        assert got[i] == (sum(x.startswith("phone") for x in spans), hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans))
    assert [got[i][0] for i, _ in rows] == [1, 1, 1, 1, 1, 0, 0, 1, 0]
    assert {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}[0] == "Call <PHONE>, please"


def test_pii_gates_are_implied(spark):
    """What a pattern finds in a text of its own is found whatever the gate."""
    forms = {"email": "a (at) b (dot) de", "ip": "10[.]0[.]0[.]1", "card": "4111111111111111", "phone": "415-555-0123"}
    d = spark.createDataFrame([(k, t) for k, t in enumerate(forms.values())], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.candidates(d).collect()}
    assert all([(x["s"], x["e"]) for x in got[k][f"cand_{kind}"]] == [(0, len(t))] for k, (kind, t) in enumerate(forms.items()))


def test_added_spans_on_planted_forms(spark):
    """Forms that no base rule knows, in documents of their own: recall and precision of what the trees add."""
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    rows, planted = [], {}
    for k in range(1500):
        kind = k % 10
        plain = {0: f"a{k}@host{k % 9}.com", 1: f"+1 743 555 {1000 + k}", 2: "", 3: f"password={hexes(18)}", 4: f'token = "{hexes(40)}"', 5: f"AKIA{upper(16)}"}.get(kind, "")
        odd, span = {6: ("email", f"b{k} (at) host{k % 9} (dot) com"), 7: ("phone", f"743 555 {1000 + k}"), 8: ("secret", hexes(40)), 9: ("secret", hexes(18))}.get(kind, ("", "")) if k % 210 < 10 else ("", "")
        text = f"{prose(8)} {plain or span} {prose(8)}"
        rows.append((k, text))
        if odd:
            planted[k] = f"{odd}:{text.index(span)}:{text.index(span) + len(span)}"
    rows += [(5000 + k, f"{prose(5)} chapter 12 of item-7 version 3.2 {prose(5)}") for k in range(200)]
    got = {r["doc_id"]: r for r in pii.digests(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    found = {k: set(filter(None, r["spans"].split(","))) for k, r in got.items()}
    by = {}
    for k, span in planted.items():
        by.setdefault(span.split(":")[0], []).append(span in found[k])
    assert set(by) == {"email", "phone", "secret"} and all(sum(x) >= 0.9 * len(x) for x in by.values()), by
    assert all(got[k]["n_secret"] == 1 for k in range(1500) if k % 10 in (3, 4, 5))
    assert not any(found[k] for k in found if k >= 5000 or k % 10 == 2 or (k % 10 > 5 and k not in planted))
    assert {r["text"].split()[8] for r in pii.redact(spark.createDataFrame([(k, t) for k, t in rows if k < 1500 and k % 10 == 5], "doc_id long, text string")).collect()} == {"<SECRET>"}


def test_counts_of_patterns_are_bounded():
    assert sum(math.prod(pii.RANGES[f] for f in fs) for fs in pii.FEATURES.values()) < 55_000


def test_trees_and_threshold():
    counts = {tuple(int(k == f) for f in range(6)): (100, 100 if k == 2 else 0) for k in range(4)}
    trees = pii.boost(counts)
    least = pii.threshold(counts, trees)
    assert [x for x in counts if sum(pii._value(t, x) for t in trees) >= least] == [x for x in counts if x[2]]


PAGE = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a>Home</a></nav><div class='ad'>Buy now</div><article><h1>Head</h1><p><b>One &amp; two</b><br>three<p>four <i>fi</i>ve</p><div class=\"comments\">Nice!</div></article><footer>(c)</footer></body></html>"


def test_html(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "http://a.example/2", ""), (1, "http://a.example/1", PAGE), (4, "x", "<p>plain<aside>side</aside>")]
    got = sorted((r["page_id"], r["url"] or "", r["text"]) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    article = "Head One & two three four five"
    assert got == [(1, "http://a.example/1", article)] * 2 + [(2, "", ""), (3, "http://a.example/2", ""), (4, "x", "plain")]


def test_host_boilerplate_goes():
    frame = "share this page with all of your friends today and subscribe"
    pages = [[(f"{frame}", False), (prose(40), False)] for _ in range(12)]
    assert all(t == p[1][0] for t, p in zip(html_extract.main_texts(pages), pages, strict=True))


def test_covered_runs_against_brute_force():
    """The suffix order finds, for each token, the most pages that share a run over it."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, run = int(rng.integers(1, 90)), int(rng.integers(2, 9))
        tokens, page = rng.integers(0, 3, n), np.sort(rng.integers(0, 6, n))
        pages: dict = {}
        for k in range(n - run + 1):
            if page[k] == page[k + run - 1]:
                pages.setdefault(tuple(tokens[k : k + run]), set()).add(page[k])
        want = np.zeros(n, int)
        for k in range(n - run + 1):
            m = len(pages.get(tuple(tokens[k : k + run]), ())) if page[k] == page[k + run - 1] else 0
            want[k : k + run] = np.maximum(want[k : k + run], m if m > 1 else 0)
        assert html_extract.covered(tokens, page, run).tolist() == want.tolist()


def test_html_of_neutral_names_copies_and_odd_rows(spark, monkeypatch):
    """Boilerplate that only repetition shows goes on a host of several groups; copies are spread; odd rows are defined."""
    monkeypatch.setattr(html_extract, "BLOCK_PAGES", 40)
    frame = "<div class='x1'>Read all of our best stories each day right here with us</div>"
    bodies = [prose(40, [f"{a}{b}" for a in WORDS for b in "xyz"]) for _ in range(120)]
    rows = [(k, f"http://h.example/{k}", f"<body>{frame}<div class='x2'><p>{b}</p></div></body>") for k, b in enumerate(bodies)]
    rows += [(1000 + k, f"http://h.example/copy{k}", rows[0][2]) for k in range(200)]
    rows += [(None, None, None), (7, "http://o.example/", "<p>" + "long words here " * 50_000), (8, "", "   ")]
    d = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, host string, part int").repartition(3)
    got = {(r["page_id"], r["url"]): r["text"] for r in html_extract.extract(d).collect()}
    assert all(got[k, f"http://h.example/{k}"] == b for k, b in enumerate(bodies)) and all(got[1000 + k, f"http://h.example/copy{k}"] == bodies[0] for k in range(200))
    assert got[None, None] == got[8, ""] == "" and len(got[7, "http://o.example/"].split()) == 150_000
    assert html_extract.extract(d.where("false")).count() == 0


def test_html_of_a_large_host_is_judged_by_all_its_pages(spark, monkeypatch):
    """Runs at and near the limits fall as they do where all pages of the host are one group."""
    words = [f"{a}{b}" for a in WORDS for b in "xyz"]
    frames = [prose(11, words) for _ in range(14)]
    rows = []
    for k in range(121):  # frame j is on 6 + j pages; the limit for 120 distinct ones, two alike, is 12
        own = "".join(f"<div>{f}</div>" for j, f in enumerate(frames) if (k * 7 + j * 13) % 120 < 6 + j)
        rows.append((k, f"http://h.example/{k}", f"<body>{own}<div>{prose(30, words)}</div></body>" if k < 120 else rows[0][2]))
    share, half = prose(12, words), prose(12, words)
    rows += [(1000 + k, f"http://a.example/{k}", f"<article><p>{share if k % 2 else ''}</p><p>{half if k % 40 < 19 else ''}</p><p>{prose(30, words)}</p></article>") for k in range(120)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    texts = lambda: sorted((r["page_id"], r["text"]) for r in html_extract.extract(d).collect())
    want = texts()
    monkeypatch.setattr(html_extract, "BLOCK_PAGES", 30)
    assert texts() == want
    left = [sum(f in t for _, t in want) for f in frames]
    assert left[0] > 0 and left[-1] == 0 and not any(share in t for _, t in want) and any(half in t for _, t in want)


def test_registered_queries_run_on_the_smallest_tables(spark):
    for name in ("op2_quality_rules", "op6_decontaminate", "op8_html_extract"):
        assert registry.QUERIES[name](spark, DATA).count() > 0


def test_pipeline_on_odd_rows_and_none(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, extra columns: each stage against a plain version of itself."""
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in ODD] + [(200 + k, prose(12) + (" scum scum idiot" if k % 3 == 0 else ""), "en", "s", 1, "", 2) for k in range(60)]
    rows += [(500, "before it " + BASE.replace("t", "tt") + " and after", "en", "s", 1, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rep string, n int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int((k - 200) % 3 == 0)) for k in range(200, 260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(BASE.replace("t", "tt").split()[5:25])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.where("false"), at)
        assert empty.columns == docs.columns and empty.count() == 0
        docs = written(stage(spark, docs, at), f"test-{name}")
        assert docs.schema.simpleString() == spark.read.parquet(f"{at}/documents.parquet").schema.simpleString()
        left.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect()))
    toxic, near, clean, redacted = left
    gone = {(False, 200 + k) for k in range(0, 60, 3)}
    assert len(set(toxic) & gone) <= 2 and len(toxic) >= len(rows) - len(gone) - 2
    assert (False, 2) not in near and (False, 8) not in near and {(False, 1), (False, 4), (False, 5), (False, 500), (True, 0)} <= set(near)
    assert (False, 500) not in clean and len(clean) == len(near) - 1 and redacted == clean
    assert "<EMAIL>" in docs.where("doc_id = 13").first()["text"]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    want = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect()}
    assert {(r["doc_id"], r["decoded_sha256"]) for r in out} == want and len(out) == len(redacted)


def test_told_secrets_need_no_large_corpus(spark):
    """Three documents: the trees can learn nothing, the name of a credential is enough; a bare run isn't."""
    key = "9f" * 20
    d = spark.createDataFrame([(1, f'token = "{key}"'), (2, f"see {key} there"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find_pii(d)).collect()}
    assert got == {1: "secret:9:49", 2: "", 3: ""}
    kept = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert kept == {1: 'token = "<SECRET>"', 2: f"see {key} there", 3: None}


def test_odd_rows_of_the_classifiers(spark):
    """Clashing columns, repeated rows, a long text and contradicting labels."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["fine", "calm", "good"] if k % 2 else ["vile", "foul", "bad"]) for _ in range(30)), 7, "x", 0.5) for k in range(60)]
    rows += [rows[1], rows[2], (100, "good " * 200_000, 7, "x", 0.5), (101, None, 7, "x", 0.5), (102, "", 7, "x", 0.5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label int, severity string, score double").repartition(3)
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(60)] + [(1, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.score(d, *quality_classifier.fit(d, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({round(r["score"], 9) for r in scored if r["doc_id"] == 1}) == 1
    kept = toxicity.keep_clean(d, toxicity.fit(d, labels))
    assert kept.columns == d.columns and 100 in {r["doc_id"] for r in kept.select("doc_id").collect()}
