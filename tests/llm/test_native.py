"""Quality rules, archive, mixing, chat: edge cases and brute force. The SQL oracles run in test_queries."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE, PROSE, SCHEMA
from tidemark.functions.scratch import new_path
from tidemark.llm import archive, chat, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark, edge):
    more = [(100 + i, t, "en", "s", 0) for i, t in enumerate(["a b c a b c", "x\nx\n\n \nx", "a a a a", "|| ## <a> 5% & $", "a b c d a b c e a b"])]
    got = quality.base_counts(edge.union(spark.createDataFrame(more, SCHEMA))).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)


def test_sketches_merge_in_any_order(spark):
    df = quality.measures(quality.base_counts(spark.createDataFrame([(i, f"{'#' * (i % 7)}a b " * (i + 1), "en", f"s{i % 2}", 0) for i in range(60)], SCHEMA)))
    whole = quality.sketches(df)
    parts = quality.sketches(df.filter("doc_id % 3 = 0")).union(quality.sketches(df.filter("doc_id % 3 > 0")))
    key = ["lang", "source", "measure", "bucket"]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.groupBy(*key).agg(F.sum("n").alias("n")).collect()))
    values = sorted(r.word_length for r in df.collect())
    q = quality.quartiles(whole, ()).filter("measure = 'word_length'").first()
    assert (q.q1, q.q3, q.n) == (values[14], values[44], 60)


def test_windows_that_share_a_hash_are_told_apart(spark, edge, monkeypatch):
    more = [(100 + i, t, "en", "s", 0) for i, t in enumerate(["a b c a b c", "a b c d e f", "a a a a", "a b c d a b c e a b"])]
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(3).cast("long"))
    for r in quality.base_counts(edge.filter("doc_id <> 4").union(spark.createDataFrame(more, SCHEMA))).collect():
        assert r.n_repeat_words == brute_counts(r.text)[4]


def test_a_long_text_of_equal_hashes_takes_no_square_of_time(spark, edge, monkeypatch):
    """20,000 sentences, every window under one hash: sorted once, within seconds."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(3).cast("long"))
    began = time.time()
    long = edge.filter("doc_id = 4")
    repeated = spark.createDataFrame([(1, "a b c " * 30_000, "en", "s", 0)], SCHEMA)
    for r in quality.base_counts(long.union(repeated)).collect():
        assert r.n_repeat_words == brute_counts(r.text)[4]
    assert time.time() - began < 60


@pytest.mark.parametrize("bad", ["symbols_per_word", "dup_line_share", "repeat_share", "word_length"])
def test_each_measure_rejects_its_own_outlier_among_varied_lengths(spark, bad):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(5000)]

    def text(n):
        words = rng.choices(vocabulary, k=n)
        return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))

    rows = [(i, text(int(50 * 1.02**i)), "en", "s", 0) for i in range(200)] + [(200 + i, text(60 + 7 * i), "en", "s", 0) for i in range(200)]
    lines = text(1200).split("\n")
    sentence = " ".join(rng.choices(vocabulary, k=12))
    outlier = {
        "symbols_per_word": " ".join(f"{w}#" if i % 2 else w for i, w in enumerate(text(300).split())),
        "dup_line_share": "\n".join(["one short line"] * 40 + lines[:70]),  # a third of the lines, an eighth of the words
        "repeat_share": text(168) + " " + " ".join([sentence] * 12),  # 46 % of the words
        "word_length": " ".join(w * 4 for w in text(200).split()),
    }[bad]
    docs = spark.createDataFrame([*rows, (999, outlier, "en", "s", 0)], SCHEMA)
    measured = quality.measures(quality.base_counts(docs))
    fence = quality.fences(quality.sketches(measured))
    got = {r.doc_id: r for r in quality.judge(measured, fence).collect()}
    f = fence.first()
    broken = [m for m in quality.MEASURES if got[999][m] > f[f"{m}_high"]]
    assert not got[999].base_failed and bad in broken and not got[999].kept
    assert sum(r.kept for r in got.values()) == 400
    assert all(f[f"{m}_high"] < quality.END for m in quality.SHARES)


def test_groups_with_shifted_values_get_fences_of_their_own(spark):
    def text(i, n, k):
        return " ".join(f"w{(i * 37 + j * 11) % 1999}" + ("#" if j < k else "") for j in range(n))

    rows = [(i, text(i, 60 + i % 40, 0), "en", "prose", 0) for i in range(300)] + [(1000 + i, text(i, 60 + i % 40, 20 + i % 15), "en", "code", 0) for i in range(300)]
    rows += [(900, text(900, 80, 30), "en", "prose", 0), (1900, text(900, 80, 30), "en", "code", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert got[900].symbols_per_word == got[1900].symbols_per_word
    assert not got[900].kept and got[1900].kept and sum(r.kept for r in got.values()) == 601
    fence = {r.source: r.symbols_per_word_high for r in quality.fences(quality.sketches(quality.measures(quality.base_counts(docs)))).collect()}
    assert fence["code"] > fence["prose"] + 20


def test_small_groups_are_drawn_to_their_language(spark):
    def level(n, bucket):
        return [("en", f"s{n}", "word_length", bucket, n)]

    sketch = spark.createDataFrame([*level(10_000, 80), *level(1, 20), *level(50, 40)], "lang string, source string, measure string, bucket int, n long")
    high = {r.source: r.word_length_high for r in quality.fences(sketch).collect()}
    assert high["s10000"] == pytest.approx(84, abs=0.01)
    # a source of one document has nearly its language's quartile, one of as many as PRIOR the mean of both
    assert high["s1"] == pytest.approx(80 - 60 / 51 + 4, abs=0.1) and high["s50"] == pytest.approx(60 + 4, abs=0.1)


def test_quality_keeps_clean_and_drops_outliers(spark):
    clean = [(i, " ".join(f"word{(i * 31 + k * 7) % 1999} and{k}" for k in range(60)), "en", "s", 0) for i in range(80)]
    junk = [(900, " ".join(f"word{k}### and{k}***" for k in range(60)), "en", "s", 0), (901, "same line again here\n" * 30, "en", "s", 0)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(got[i] for i, *_ in clean) and not got[900] and not got[901]


def test_quality_edges(edge, empty, clashing):
    got = quality.quality_rules(edge).collect()
    assert len(got) == len(EDGE)
    assert all(not r.kept for r in got if r.n_words < 50)
    assert quality.quality_rules(empty).count() == 0 and quality.keep_good(empty).count() == 0
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns and kept.filter("n_words <> 'own n_words'").count() == 0
    assert kept.count() == sum(r.kept for r in got)


PAGES = [(i, f"http://x/{i}", "<p>" + "long " * 300) for i in (1, 5, 3)] + [(7, None, "short"), (8, "http://x/8\r\nX: y", "short"), (9, "u", None), (10, "u", ""), (None, "u", "<p>" + "long " * 300), (11, "u", "äöü 🙂\r\n\r\n" * 200), (5, "again", "<p>" + "long " * 300)]


def test_archive_roundtrip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha256", F.lit("own"))
    path = new_path(spark, "archive")
    archive.write_archive(pages, path)
    read = archive.read_archive(spark, path)
    got = sorted(map(tuple, archive.described(read).select("page_id", "record_type", "refers_to", "payload_bytes").collect()), key=str)
    size = len(PAGES[0][2])
    want = [(1, "revisit", 5, size), (3, "revisit", 5, size), (5, "response", None, size), (5, "response", None, size), (None, "revisit", 5, size), (7, "response", None, 5), (8, "response", None, 5), (9, "response", None, 0), (10, "response", None, 0), (11, "response", None, len(PAGES[8][2].encode()))]
    assert got == sorted(want, key=str)
    assert sorted(r.payload.decode() for r in read.collect()) == sorted(p[2] or "" for p in PAGES)
    assert spark.read.parquet(f"{path}/payloads").count() == len({p[2] or "" for p in PAGES})
    files = new_path(spark, "warc")
    archive.write_warc(read, files, per_file=2)
    back = archive.read_warc(spark, files)
    want = sorted((r.head, b"" if r.record_type == "revisit" else bytes(r.payload)) for r in read.collect())
    assert sorted((r.head, bytes(r.payload)) for r in back.collect()) == want


def test_archive_sees_damage(spark):
    path = new_path(spark, "archive")
    archive.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    bad = new_path(spark, "bad")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="does not match"):
        archive.described(archive.read_archive(spark, bad)).collect()


def test_archive_of_nothing(spark):
    path = new_path(spark, "archive")
    archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert archive.described(archive.read_archive(spark, path)).count() == 0


def reshared(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the rounds of the definition: cap, reshare the excess by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > most * sizes[s]}
        if not over:
            return full | t
        full |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return full


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 4, "b": 4, "c": 4}, {"z": 9}, {"a": 0, "b": 3}, {str(i): (i * 37) % 101 for i in range(30)}])
def test_targets_equal_rounds(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_mix_cuts_exactly_and_repeats(spark):
    rows = [(i, "w " * (i % 17), "en", f"s{i % 4}" if i % 5 else "hot", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, mixing.mix(x).select("doc_id", "size", "source", "target", "taken").collect())) for x in (docs, docs.repartition(7)))
    assert a == b
    for s in {r[2] for r in a}:
        own = [r for r in a if r[2] == s]
        assert sum(r[4] for r in own) == int(own[0][3])
        assert all(r[4] <= 2 * r[1] for r in own)
        assert len({-(-r[4] // r[1]) for r in own if r[1]}) <= 2, "epochs differ by one at most"


def test_mix_shares_the_cut_among_equal_rows(spark):
    rows = [(7 if i % 3 else None, "one two three four five", "en", "hot", 0) for i in range(300)] + [(i, "x y", "en", "other", 0) for i in range(1000, 1040)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    for s, n in (("hot", 300), ("other", 1)):
        own = [r for r in got if r.source == s]
        assert 0 <= int(own[0].target) - sum(r.taken for r in own) < n
    assert len({(r.doc_id, r.taken) for r in got if r.source == "hot"}) == 2
    kept = mixing.mixed_documents(docs).collect()
    assert sorted(r.taken for r in kept) == sorted(r.taken for r in got if r.taken) and len(kept) == len([r for r in got if r.taken])


def test_mix_moves_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_mix_edges(edge, empty, clashing):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and all(r.taken == 0 for r in got if not r.size)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    out = mixing.mixed_documents(clashing)
    assert set(clashing.columns) <= set(out.columns) and out.filter("taken > 0").count() == out.count() > 0


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_keeps_maximal_conversations(spark):
    def conv(i, *texts):
        return [(i, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]

    rows = conv(1, "a") + conv(2, "a", "b") + conv(3, "a", "b", "c") + conv(4, "a", "x") + conv(5, "a", "b", "c") + conv(6, None) + conv(7, "") + [(None, 0, "user", "a"), (8, None, "user", "q"), (8, 1, None, "p"), (9, 0, "user", "t"), (9, 0, "user", "t")]
    got = {r.conv_id: (r.n_turns, r.n_logged, r.text) for r in chat.format_chats(spark.createDataFrame(rows, TURNS).withColumn("place", F.lit(0))).collect()}
    assert set(got) == {3, 4, 6, 7, 8, 9}
    assert got[3][:2] == (3, 2)
    assert got[4][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert got[8][2].startswith("<|im_start|>\np<|im_end|>") and got[9][0] == 2
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_prose_is_unlike_the_edges():
    assert brute_counts(PROSE)[0] > 50


def test_long_and_odd_turns(spark):
    long = "very long " * 200_000
    rows = [("a", 0, "user", long), ("a", 1, "", "x"), ("b", 0, "user", long), ("b", 1, "", "x"), ("b", 2, None, ""), ("c", 0, "", ""), ("d", 0, None, None), ("d", 1, "user", "end")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert set(got) == {"b", "c", "d"} and got["b"].n_turns == 3 and len(got["b"].text) > len(long)
