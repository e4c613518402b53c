"""Token counts, language, toxicity and language-model scores against libraries, gradients and brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.conftest import EDGE, SCHEMA
from tidemark.llm import katz, langid, tokens, toxicity, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_library(spark, edge):
    rng = random.Random(1)
    parts = ["'s", "'t", "'re", "'ll", "'", "''s", " ", "  ", "\n", "\t", "a", "Bc", "é", "1", "٣", "!", "_", "中", "🙂", " ", "​", "<|endoftext|>", "don't", "I'll", "\x85", "²", "́", "\U000e0001", "￾"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    texts += [t or "" for _, t, *_ in EDGE]
    lib = tokens.load(PATH)
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    counter = tokens.Counter(PATH, *tokens.proofs(PATH))
    assert counter.count(texts).tolist() == want
    counter.forget()
    assert counter.count(texts[::-1]).tolist() == want[::-1]


def test_tokens_of_edges(edge, empty, clashing):
    got = tokens.token_counts(clashing, PATH).collect()
    assert len(got) == len(EDGE)
    assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in got if not r.n_bytes} == {(0, 0, False)}
    assert any(r.over_limit for r in got)
    assert tokens.token_counts(empty, PATH).count() == 0


def test_words_equal_split():
    texts = ["", None, "a", " a b\tc\n", "ä ö x", "x " * 300_000, "The the THE"]
    rows = []
    for i, j, h, first in words.pieces(pa.array(texts), lower=True):
        rows += [h[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
    names = {}
    for t, r in zip(texts, rows, strict=True):
        want = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (t or "").encode().split()]
        assert len(want) == len(r)
        for w, h in zip(want, r, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_shingles_stay_within_texts():
    (piece,) = words.pieces(pa.array(["a b c d e f", "a b", "", "a b c d e"]))
    g, first = words.shingles(piece[2], piece[3], 5)
    assert np.diff(first).tolist() == [2, 1, 0, 1] and g[0] == g[3]


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.start(3, rng).items()}
    x, y, live = rng.integers(0, 256, (6, 4)).astype(np.uint8), rng.integers(0, 3, 4), np.ones((6, 4))
    live[4:, 1] = 0
    _, grad = langid.loss_and_grad(p, x, y, live)
    for k, w in p.items():
        i = tuple(rng.integers(0, s) for s in w.shape)
        i = (i[0], int(x[2, 0])) if k[0] == "E" else i
        at, d = w[i], 1e-3
        w[i] = at + d
        up = langid.loss_and_grad(p, x, y, live)[0]
        w[i] = at - d
        down = langid.loss_and_grad(p, x, y, live)[0]
        w[i] = at
        assert grad[k][i] == pytest.approx((up - down) / 2 / d, abs=2e-4)


def test_language_is_held_out_and_pools_all_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    got = langid.identify(docs.withColumn("held", langid.held_out(docs.doc_id)), model, ("doc_id", "lang", "held")).filter("held").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    text = ["nur ein deutscher Satz " * 40, "nur ein deutscher Satz " * 40 + "the only thing that is with this of and " * 200]
    (_, one), (_, two) = (langid.predict(pa.array([t]), model) for t in text)
    names, p = langid.predict(pa.array(text), model)
    assert p.tolist() == pytest.approx([one[0], two[0]], abs=1e-4) and abs(p[0] - p[1]) > 1e-3


def test_prediction_equals_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    p = langid.start(3, rng)
    texts = ["", "a", "x" * 63, "abc " * 16, "y" * 65, "ünïcode 中文 🙂 " * 20, "the end"]

    def soft(x):
        return x / (1 + abs(x))

    def states(d, window):
        h, out, n = np.zeros(langid.HIDDEN), [], langid.HIDDEN
        for byte in window:
            e, u = p[f"E{d}"][:, byte].astype(float), p[f"U{d}"].astype(float)
            z, r = (0.5 * (soft(e[k * n : k * n + n] + u[k * n : k * n + n] @ h) + 1) for k in (0, 1))
            new = soft(e[2 * n :] + r * (u[2 * n :] @ h + p[f"b{d}"][:, 0]))
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    names, got = langid.predict(pa.array(texts), (["x", "y", "z"], p))
    for text, name, score in zip(texts, names, got, strict=True):
        raw, total = text.encode(), np.zeros(3)
        for i in range(0, len(raw), langid.SPAN):
            window = raw[i : i + langid.SPAN]
            for f, b in zip(states("f", window), reversed(states("b", window[::-1])), strict=True):
                q = np.exp(p["W"].astype(float) @ np.concatenate([f, b]) + p["c"][:, 0])
                total += q / q.sum()
        if raw:
            assert score == pytest.approx(total.max() / len(raw), abs=1e-4) and name == "xyz"[total.argmax()]


def test_language_sample_is_bounded_and_the_same_however_rows_lie(spark):
    rows = [(f"text {i} of en", "en") for i in range(300)] + [("one copied text", "en")] * 700 + [(f"texte {i}", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    one, two = langid.sample(docs.repartition(7), 20), langid.sample(docs.coalesce(1), 20)
    assert one == two and set(one[1]) == {"en", "fr"} and max(Counter(one[1]).values()) <= 40 and len(set(one[0])) == len(one[0])


def test_language_edges(spark, edge, empty, clashing):
    model = langid.fit(edge)
    got = langid.identify(clashing, model, tuple(clashing.columns[:1])).collect()
    assert len(got) == len(EDGE)
    none = [r for r in got if r.lang_pred == "und"]
    assert len(none) == 4 and all(r.score == 0 for r in none)
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.fit(empty) == ([], {}) and {r.lang_pred for r in langid.identify(edge, ([], {})).collect()} == {"und"}
    kept = langid.keep_known(clashing)
    assert kept.columns == clashing.columns
    assert langid.keep_known(empty).count() == 0


def test_toxicity_finds_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("toxic is not null")
    held = "doc_id % 4 = 0"
    model = toxicity.fit(docs, labels.filter(f"not ({held})"))
    got = toxicity.severity(docs, model).join(labels.filter(held), "doc_id").collect()
    hit = [r.p_toxic >= 0.5 for r in got if r.toxic]
    false = [r.p_toxic >= 0.5 for r in got if not r.toxic]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.01
    assert np.mean([r.severity for r in got if r.toxic]) > 1 > 0.2 > np.mean([r.severity for r in got if not r.toxic])
    assert (np.diff(model[2]) >= 0).all(), "thresholds are ordered"


def test_ordinal_fit_equals_a_plain_optimum():
    rng = np.random.default_rng(4)
    x = rng.random((120, 4)) < 0.4
    x[:, 3] = rng.random(120) < 0.5
    y = np.clip((x @ np.array([2.0, 1.0, -1.5, 0.0]) + rng.logistic(0, 1, 120)).round().astype(int), 0, 3)
    row, column = np.nonzero(x)
    penalty = 0.01
    w, t = toxicity.ordinal(row, column, 4, y, penalty, 4000)

    def value(v):
        s = x @ v[:4]
        total = sum(math.log1p(math.exp(-(1 if y[i] > k else -1) * (s[i] - v[4 + k]))) for i in range(120) for k in range(3))
        return total / 120 + penalty * np.abs(v[:4]).sum()

    at = np.concatenate([w, t])
    best = value(at)
    assert best == pytest.approx(toxicity.loss(w, t, row, column, y, penalty))
    # the function is convex: no step along an axis, and no search by shrinking steps from elsewhere, gets below it
    found, step = np.zeros(7), 1.0
    found[4:] = [0, 0.1, 0.2]
    low = value(found)
    while step > 1e-5:
        moved = False
        for k in range(7):
            for d in (step, -step):
                new = found.copy()
                new[k] += d
                if (v := value(new)) < low - 1e-12:
                    found, low, moved = new, v, True
        step = step if moved else step / 2
    assert best <= low + 1e-6 and np.allclose(found, at, atol=0.02)
    assert abs(w[3]) < 0.3 and w[0] > w[1] > 0 > w[2] and (np.diff(t) > 0).all()


def test_features_are_chosen_by_their_counts(spark):
    rows = [(i, int(i % 4 == 0), [1, 2] if i % 4 == 0 else [2, 3 + i % 5]) for i in range(80)] + [(100, 1, [77])]
    sample = spark.createDataFrame(rows, "node long, toxic int, features array<long>")
    names, tell = toxicity.chosen(sample)
    n, bad = 81, 21
    want = {}
    for f in {x for r in rows for x in r[2]}:
        df, b = sum(f in r[2] for r in rows), sum(f in r[2] and r[1] for r in rows)
        z = abs(b - df * bad / n) / math.sqrt(df * bad / n * (1 - bad / n))
        if df >= toxicity.LEAST_TEXTS and z >= toxicity.LEAST_Z:
            want[f] = b >= toxicity.TELL_SHARE * df
    assert dict(zip(names.tolist(), tell.tolist(), strict=True)) == want and 1 in want
    assert len(toxicity.chosen(sample, 1)[0]) == 1
    texts, toxic = toxicity.held(sample, names)
    assert [[int(names[k]) for k in x] for x in texts] == [[f for f in sorted(r[2]) if f in want] for r in rows] and toxic.sum() == bad


def test_toxicity_edges(spark, edge, empty, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.severity(clashing, toxicity.fit(edge, labels)).collect()
    assert len(got) == len(EDGE) and all(0 <= r.severity <= toxicity.GRADES for r in got)
    nothing = toxicity.fit(edge, labels.limit(0))
    assert {r.severity for r in toxicity.severity(edge, nothing).collect()} == {0.0}
    assert toxicity.severity(empty, nothing).count() == 0


def brute_katz(texts, order):
    """Scores by dictionaries; texts: id -> (words and end, whether it trains). Checks that every history's probabilities sum to one."""

    def grams(ws, n):
        padded = ["<s>"] * (n - 1) + ws
        return [tuple(padded[i : i + n]) for i in range(len(ws))]

    train = [w for w, t in texts.values() if t]
    count = {n: Counter(g for ws in train for g in grams(ws, n)) for n in range(1, order + 1)}
    d = {n: katz.discounts([sum(1 for c in count[n].values() if c == r) for r in range(1, katz.MOST + 2)]) for n in count}
    total = sum(count[1].values())
    past, seen = Counter(), defaultdict(list)
    for n in range(2, order + 1):
        for g, c in count[n].items():
            past[g[:-1]] += c
            seen[g[:-1]].append((g[-1], c))
    left = 1 - sum(d[1][min(c, katz.MOST + 1)] * c for c in count[1].values()) / total
    unknown = max(left, 0.5 / (total + 1))

    def kept(h):
        f1 = sum(d[len(h) + 1][min(c, katz.MOST + 1)] * c for _, c in seen[h])
        whole = past[h] + (past[h] > 0 and 1 - f1 / past[h] < 1e-9)
        return f1, whole

    def p(g):
        n, c = len(g), count[len(g)][g]
        if n == 1:
            return d[1][min(c, katz.MOST + 1)] * c / total * (1 - unknown) / (1 - left) if c else unknown
        f1, whole = kept(g[:-1])
        if c:
            return d[n][min(c, katz.MOST + 1)] * c / whole
        return (1 - f1 / whole) / (1 - sum(p((*g[1:-1], w)) for w, _ in seen[g[:-1]])) * p(g[1:]) if past[g[:-1]] else p(g[1:])

    vocabulary = [*(w for (w,) in count[1]), "never seen"]
    assert sum(p((w,)) for w in vocabulary) == pytest.approx(1, abs=1e-9)
    for n in range(2, order + 1):
        histories = [h for h in seen if len(h) == n - 1]
        for h in [*histories[:6], max(histories, key=lambda h: past[h]), ("<s>",) * (n - 1)]:
            assert sum(p((*h, w)) for w in vocabulary) == pytest.approx(1, abs=1e-9)
    base = {w: math.log10((count[1][w,] + 0.1) / (total + 0.1 * (len(count[1]) + 1))) for ws, _ in texts.values() for w in ws}
    return {i: (len(ws), sum(count[1][w,] > 0 for w in ws), sum(base[w] for w in ws), sum(math.log10(p(g)) for g in grams(ws, order)), total) for i, (ws, _) in texts.items()}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_equals_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "BLOCK", 400)
    monkeypatch.setattr(katz, "BUCKET", 300)
    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) ** 1.3 for k in range(40)], k=rng.randint(0, 40))), i % 7 > 0) for i in range(150)]
    rows += [(200 + i, "always the same words", i < 8) for i in range(9)]
    texts = {i: ([w.lower() for w in t.split()] + ["</s>"], train) for i, t, train in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    out, model = katz.score_texts(docs, order)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in out.collect()}
    want = brute_katz(texts, order)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w, rel=1e-9, abs=1e-9)
    stored = katz.read_model(model).groupBy("kind").agg({"value": "sum", "key": "count"}).collect()
    assert {r.kind for r in stored} == {*range(1, order + 1), *range(-1, -order, -1)}
    assert {r["sum(value)"] for r in stored if r.kind > 0} == {want[0][4]}
    assert katz.score_texts(docs, order, keep=False)[1].count() == 0


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([0, 255, 256, 2**64 - 1], np.uint64), rng.integers(0, 2**40, 999).astype(np.uint64)):
        assert katz.unpack(katz.pack(x), len(x)).tolist() == x.tolist()
        keys = np.unique(x)
        assert np.cumsum(katz.unpack(katz.pack(katz.steps(keys)), len(keys)), dtype=np.uint64).tolist() == keys.tolist()
        parts = list(katz.cut(keys, 7))
        assert [i for b, s in parts for i in range(s.start, s.stop)] == list(range(len(keys))) and len({b for b, _ in parts}) == len(parts)


def test_katz_edges(spark, edge, empty, clashing):
    from pyspark.sql import functions as F

    got = katz.score_texts(clashing.withColumn("train", F.lit(True)))[0].collect()
    assert len(got) == len(EDGE) and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    none = katz.score_texts(edge.withColumn("train", F.lit(False)))[0].collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in none} == {(0, 0, 0.0)}
    assert katz.score_texts(empty.withColumn("train", F.lit(True)))[0].count() == 0


def test_severity_equals_a_plain_sum_over_features(spark):
    """Features by name: lower-case words, and the first 5, 6 and 7 letters of longer ones; each counts once a text."""

    def named(text):
        found = set()
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            found |= {("word", w)} | {("head", w[:k]) for k in toxicity.HEADS if len(w) > k}
        return found

    rng = random.Random(5)
    stock = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts = [" ".join(rng.choice([w, w.upper(), w + "!", f"({w})"]) for w in rng.choices(stock, k=rng.randrange(0, 40))) for _ in range(150)]
    every = sorted(set().union(*map(named, texts)))
    weight = {f: rng.gauss(0, 1) for f in rng.sample(every, len(every) // 3)}

    def code(kind, name):
        got = next(toxicity._present(pa.array([name if kind == "word" else name + "qz"])))[2]
        return got[0] if kind == "word" else got[1 + sum(k < len(name) for k in toxicity.HEADS)]

    pairs = sorted((int(code(*f)), w) for f, w in weight.items())
    cuts = np.array([-1.0, 0.5, 2.0])
    model = (np.array([p for p, _ in pairs], np.uint64), np.array([w for _, w in pairs]), cuts)
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    for i, text in enumerate([*texts, "", ""]):
        score = sum(weight.get(f, 0.0) for f in named(text))
        p = [1 / (1 + math.exp(c - score)) for c in cuts]
        assert got[i].p_toxic == pytest.approx(p[0]) and got[i].severity == pytest.approx(sum(p)) and got[i].grade == sum(x >= 0.5 for x in p)


def test_grades_are_quantiles_of_tell_tales_among_toxic_texts():
    rng = np.random.default_rng(7)
    tell = rng.random(30) < 0.5
    texts = [rng.choice(30, rng.integers(0, 20), replace=False) for _ in range(200)]
    toxic = rng.random(200) < 0.4
    counts = [sum(bool(tell[k]) for k in x) for x in texts]
    own = sorted(c for c, t in zip(counts, toxic) if t)
    cuts = sorted({float(np.interp(q * (len(own) - 1), range(len(own)), own)) for q in (1 / 3, 2 / 3)})
    want = [1 + sum(c > k for k in cuts) if t else 0 for c, t in zip(counts, toxic)]
    assert toxicity.grades(texts, toxic, tell).tolist() == want and set(want) == {0, 1, 2, 3}
