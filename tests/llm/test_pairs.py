"""Near-duplicates, decontamination, the pipeline and the queries."""

import glob
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.conftest import EDGE, SCHEMA
from tidemark.llm import decontam, graph, neardup, queries

SF = "/root/testdata/sf0.001"


def runs(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def brute_classes(texts):
    """Smallest id of each class, by comparing all pairs."""
    sets, parent = {i: runs(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and similarity(sets[a], sets[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def family(rng, base, edits, n):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        out.append(" ".join(w))
    return out


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(4)
    base = [f"b{i % 40}" if i % 3 else f"c{i}" for i in range(200)]
    texts = family(rng, base, 25, 80)
    parts = [(g, r, j - i) for i, j, g, r in neardup.grouped(pa.array(texts))]
    sig = np.concatenate([neardup.darts(*neardup.cells(g, r), n) for g, r, n in parts])
    sets = [runs(t) for t in texts]
    gaps = [(sig[a] == sig[b]).mean() - similarity(sets[a], sets[b]) for a in range(80) for b in range(a)]
    # texts of one family share most darts, so their gaps agree: the bounds are those of one estimate
    assert abs(np.mean(gaps)) < 0.08 and np.std(gaps) < 0.06


def test_classes_equal_brute_force_on_families(spark):
    rng = random.Random(9)
    texts = []
    for f in range(6):
        base = [f"{f}w{rng.randrange(300)}" for _ in range(120)]
        texts += family(rng, base, 14, 40)
        texts += [" ".join(base[: 120 - k]) for k in range(0, 60, 7)]
        second = texts[-45].split()
        texts += family(rng, second, 3, 6)
    texts += texts[:20]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got, links = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    want = brute_classes(dict(enumerate(texts)))
    assert {r.doc_id: r.class_id for r in got.collect()} == want
    assert all(r.similarity >= 0.8 for r in links.collect())


def test_near_duplicate_edges(spark, edge, empty, clashing):
    rows, _ = neardup.near_duplicates(clashing)
    got = rows.collect()
    assert len(got) == len(EDGE)
    assert Counter(r.class_id for r in got)[5] == 4, "repeated rows, another id and a missing id with one text"
    assert {r.class_id for r in got if r.doc_id in (1, 2)} == {1, 2}
    kept = neardup.one_per_class(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([None, 1, 2, 3, 4, 5, 7, 8], key=str)
    assert neardup.near_duplicates(empty)[0].count() == 0 and neardup.one_per_class(empty).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 99), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 99


def brute_align(x, y):
    h = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if a == b else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_equals_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(60):
        x, y = rng.integers(0, 6, rng.integers(0, 25)), rng.integers(0, 6, rng.integers(0, 25))
        assert decontam.align(x, y) == brute_align(x, y)


ITEM = " ".join(f"item{i} of" for i in range(25))


def test_copies_are_found_and_others_left(spark):
    rng = random.Random(2)
    w = ITEM.split()
    edited = [x if i % 5 else f"new{i}" for i, x in enumerate(w)]
    shorter = [x for i, x in enumerate(w) if i % 9]
    filler = [f"f{rng.randrange(500)}" for _ in range(200)]
    hit = {1: w, 2: filler[:80] + edited + filler[80:], 3: shorter, 4: [x.upper() + "!" for x in w]}
    miss = {5: filler, 6: rng.sample(w, len(w)), 7: w[:9] + filler, 8: []}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in (hit | miss).items()], SCHEMA)
    tests = spark.createDataFrame([(0, ITEM), (1, "two words"), (2, None), (3, ""), (None, "a b c d e f g h")], "item_id long, text string")
    got = decontam.contaminated(docs, tests).collect()
    assert {r.doc_id for r in got} == set(hit)
    assert {r.doc_id: r.score for r in got}[1] == 50
    assert sorted(r.doc_id for r in decontam.without_tests(docs, tests).collect()) == sorted(miss)


def test_decontamination_edges(spark, edge, empty, clashing):
    tests = spark.createDataFrame([(1, EDGE[5][1])], "item_id long, text string")
    got = decontam.contaminated(clashing, tests).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([5, 5, 6, None], key=str)
    left = decontam.without_tests(clashing, tests)
    assert left.columns == clashing.columns and left.count() == len(EDGE) - 4
    assert decontam.without_tests(edge, tests.limit(0)).count() == len(EDGE)
    assert decontam.contaminated(empty, tests).count() == 0


def test_pipeline_stages_are_whole(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(rows) <= {r.doc_id for r in docs.select("doc_id").collect()} and len(rows) == len(set(rows))
        docs = spark.createDataFrame(out.collect(), docs.schema)
    # what the stages promise of the rows that are left
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(brute_classes(text).values())) == len(text)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert mixed.filter("taken > 0").count() == mixed.count() > 0


def test_pipeline_on_edges_and_nothing(spark, edge, empty, clashing):
    for docs in (edge, empty, clashing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= len(EDGE)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want.select(*cols).fetchall(), key=repr)


def test_queries_cover_their_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op4_toxicity", "op5_katz_scores", "op6_language_id", "op9_token_counts", "op10_near_duplicates"):
        assert queries.queries()[name](spark, SF).count() == n


def test_found_items_equal_brute_force(spark):
    docs, tests = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    marks = str.maketrans({c: " " for c in map(chr, range(33, 127)) if not c.isalnum()} | {chr(c): chr(c + 32) for c in range(65, 91)})
    names = {}
    read = {i: np.array([names.setdefault(w, len(names)) for w in (t or "").translate(marks).encode().split()]) for i, t in [((0, r.doc_id), r.text) for r in docs] + [((1, r.item_id), r.text) for r in tests]}
    want = set()
    for (kind, item), q in read.items():
        for (other, doc), x in read.items():
            if kind == 1 and other == 0 and len(q) > 2 and len(x) and np.isin(q, x).mean() > 0.3:
                score = decontam.align(x, q)
                if score >= (len(q) if len(q) < 8 else min(25, 0.4 * len(q))):
                    want.add((doc, item, score))
    got = queries.queries()["op8_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == want


def test_frequent_partial_copies_and_copies_without_long_runs_are_found(spark):
    rng = random.Random(6)
    w = [f"q{i}" for i in range(60)]
    apart = [x for i in range(0, 60, 2) for x in (w[i], w[i + 1], f"gap{i}")]
    filler = [f"f{k}" for k in range(300)]
    texts = [[*rng.sample(filler, 20), *w[:27], *rng.sample(filler, 20)] for _ in range(300)] + [w, apart, [*filler[:30], *w[5:28]]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = decontam.contaminated(docs, spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")).collect()
    assert {r.doc_id: r.score for r in got} == {i: 27 for i in range(300)} | {300: 60, 301: 31}


def test_found_items_equal_brute_force_on_random_edits(spark):
    rng = random.Random(12)
    common = [f"c{k}" for k in range(30)]
    tests = [[rng.choice([*common, f"i{i}w{k}"]) for k in range(rng.choice([5, 18, 30, 70]))] for i in range(12)]
    texts = []
    for n in range(240):
        q = tests[n % 12]
        part = q[rng.randrange(len(q) // 3 + 1) :]
        part = [x for y in part for x in rng.choice([(y,), (y,), (y,), (y,), (), (y, "new"), ("other",)])]
        texts.append([*rng.choices(common, k=8), *part, *rng.choices(common, k=8)])
    texts += texts[:60]
    names = {}
    read = [[np.array([names.setdefault(x, len(names)) for x in t]) for t in group] for group in (texts, tests)]
    want = set()
    for i, x in enumerate(read[0]):
        for j, q in enumerate(read[1]):
            if (score := decontam.align(x, q)) >= (len(q) if len(q) < 8 else min(25, 0.4 * len(q))):
                want.add((i, j, score))
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = decontam.contaminated(docs, spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(tests)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == want and len(want) > 40


def test_no_item_is_easier_to_match_than_a_shorter_one(spark):
    tests = spark.createDataFrame([(n, " ".join(f"n{n}w{k}" for k in range(n))) for n in range(3, 30)], "item_id long, text string")
    texts = {(n, k): f"some {' '.join(f'n{n}w{i}' for i in range(k))} more" for n in range(3, 30) for k in range(3, n + 1)}
    docs = spark.createDataFrame([(100 * n + k, t, "en", "s", 0) for (n, k), t in texts.items()], SCHEMA)
    least = {}
    for r in decontam.contaminated(docs, tests).collect():
        least[r.item_id] = min(r.score, least.get(r.item_id, r.score))
    assert [least[n] for n in range(3, 30)] == [3, 4, 5, 6, *[7] * 11, *[-(-n * 2 // 5) for n in range(18, 30)]]


def test_sketches_lose_far_fewer_similar_pairs_than_bands():
    from math import comb

    p = (1 - neardup.SIMILAR) * 15 / 16
    bands = (1 - neardup.SIMILAR**neardup.ROWS) ** neardup.BANDS
    for most in (neardup.MOST_PAIR, neardup.MOST_HUB):
        lost = sum(comb(neardup.K, k) * p**k * (1 - p) ** (neardup.K - k) for k in range(most + 1, neardup.K + 1))
        assert lost < bands / 100


def test_runs_within_a_span_equal_brute_force():
    rng = random.Random(21)
    for _ in range(400):
        n, k = rng.randrange(0, 40), rng.randrange(1, 6)
        places = sorted(rng.sample(range(80), n))
        which, times = [rng.randrange(k) for _ in places], [rng.randrange(1, 4) for _ in range(k)]
        width, enough = rng.randrange(1, 50), rng.randrange(1, 12)
        best = max((sum(min(times[j], sum(1 for p, w in zip(places, which) if w == j and s <= p < s + width)) for j in range(k)) for s in range(80)), default=0)
        assert decontam.most_within(np.array(places, np.int64), np.array(which, np.int64), np.array(times), width, enough) == (best >= enough)


def test_few_texts_of_common_words_are_aligned_and_none_is_lost(spark):
    """400 texts and 50 items over 60 common words: nearly all pairs share runs, few hold enough of them close together."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    tests = [rng.choices(common, k=rng.randrange(20, 50)) for _ in range(50)]
    texts = [rng.choices(common, k=200) for _ in range(396)] + [[*rng.choices(common, k=80), *tests[i], *rng.choices(common, k=80)] for i in range(4)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(tests)], "item_id long, text string")
    own = decontam.items(bench).cache()
    pairs = decontam.candidates(decontam.suspects(docs, decontam.seeds(docs, own).select("gram")), decontam.seeds(docs, own))
    runs = {r.key: r for r in own.collect()}
    nodes = {r.node: np.array(r.words).view(np.uint64) for r in decontam.worded(docs, pairs.select("node")).collect()}
    aligned = 0
    for r in pairs.collect():
        h = nodes[r.node]
        g, _ = decontam.shingles(h, np.array([0, len(h)]), decontam.WIDTH, whole=False)
        item = runs[r.key]
        aligned += decontam.close(g, np.array(item.grams).view(np.uint64), item.width, item.need)
    assert 4 <= aligned <= 600
    read = {}
    x, q = ([np.array([read.setdefault(w, len(read)) for w in t]) for t in group] for group in (texts, tests))
    want = {(i, j, s) for i, a in enumerate(x) for j, b in enumerate(q) if (s := decontam.align(a, b)) >= min(25, 0.4 * len(b))}
    assert {(r.doc_id, r.item_id, r.score) for r in decontam.contaminated(docs, bench).collect()} == want
    print("looked at", pairs.count(), "aligned", aligned, "found", len(want))


def test_rows_of_one_item_id_are_items_of_their_own(spark):
    one, two = " ".join(f"one{k}" for k in range(20)), " ".join(f"two{k}" for k in range(30))
    tests = spark.createDataFrame([(7, one), (7, two), (7, two)], "item_id long, text string")
    docs = spark.createDataFrame([(1, one, "en", "s", 0), (2, two, "en", "s", 0), (3, f"{one} {two}", "en", "s", 0)], SCHEMA)
    got = sorted((r.doc_id, r.item_id, r.n_item_words, r.score) for r in decontam.contaminated(docs, tests).collect())
    assert got == [(1, 7, 20, 20), (2, 7, 30, 30), (2, 7, 30, 30), (3, 7, 20, 20), (3, 7, 30, 30), (3, 7, 30, 30)]
