"""Benchmark decontamination: two-word seeds that no copy can lack, then Smith-Waterman alignment.

Words are runs of bytes other than ASCII white space and punctuation, in lower case, so that
edits of case and punctuation don't count. A text is aligned with an item over its whole
length: match 1, mismatch -1, gap -1. It is a copy of the item if the best local score reaches
``SHARE`` of the item's words, or ``LONG`` words in items long enough for that; items under
``SHORT`` words must match in full, and no longer item is matched by less than those need.

Seeding loses no copy. Errors part an alignment's matches into at most one stretch more than
there are errors, so a score of s shares s - 1 or more of the item's two-word runs. Of an item
with g runs a copy thus holds at least c, the least score less 1; whatever their order, it
holds at least k of any g - c + k of them. Those that the fewest training texts hold are the
item's seeds. Which runs are rare decides the cost only, not what is found.

Places count as well. An alignment of an item of n words that scores s has at most n - s errors,
so it spans at most 2 n - s words of the text, and its runs pair off one to one with the item's. A text
is looked at if, within such a span, it holds ``SURE`` of the item's seeds (c if that is less), each at most as often as the item; it is
aligned if a span holds c of all its runs in the same way. The first test needs hashes and places alone; words are shipped for those
that pass it. Where runs meet seeds, both are dealt by run and a salt of the text, so no run lies in one task alone.

Runs are looked up in a bitmap of fixed size, which the tasks get by broadcast, and what
passes it is joined exactly; so the benchmark may grow without bound. Null or empty texts and
items match nothing, and neither do items of fewer than ``FEWEST`` words. Repeated rows are
reported each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize
from tidemark.llm.bits import bitmap, contained
from tidemark.llm.words import pieces, shingles

WIDTH = 2
FEWEST, SURE, SALTS = 3, 4, 16
SHARE, LONG, SHORT = 0.4, 25, 8
_U = np.uint64


def _least(n: Column) -> Column:
    """The least score of a copy of an item of ``n`` words."""
    return F.when(n < SHORT, n.cast("double")).otherwise(F.greatest(F.lit(SHORT - 1.0), F.least(F.lit(float(LONG)), F.lit(SHARE) * n)))


def span(n: np.ndarray | int, least: np.ndarray | int) -> np.ndarray | int:
    """Words of a text that an alignment with an item of ``n`` words covers at most, if it scores ``least`` or more."""
    return 2 * n - least


def most_within(places: np.ndarray, which: np.ndarray, times: np.ndarray, width: int, enough: int) -> bool:
    """Whether some ``width`` neighbouring places hold ``enough`` runs, run k counting ``times[k]`` times at most; ``which`` names the run at each place, in order."""
    if len(places) < enough:
        return False
    if np.minimum(np.bincount(which, minlength=len(times)), times).sum() < enough:
        return False
    count, held, first = [0] * len(times), 0, 0
    places, which, times = places.tolist(), which.tolist(), times.tolist()
    for p, k in zip(places, which, strict=True):
        while places[first] <= p - width:
            k0 = which[first]
            held -= count[k0] <= times[k0]
            count[k0] -= 1
            first += 1
        count[k] += 1
        held += count[k] <= times[k]
        if held >= enough:
            return True
    return False


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, h, first in pieces(batch.column("text"), lower=True, punctuation=True):
        yield i, j, h, first, *shingles(h, first, WIDTH, whole=False)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, grams (hashes) and need (how many of its grams a copy holds at least) and width (the places of a text that a copy's grams lie within) of each test item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, first, g, runs in _runs(batch):
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(i, j - i), _lists(first, h), _lists(runs, g)], names=["item_id", "words", "grams"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, words array<long>, grams array<long>")
    return rows.filter(F.size("words") >= FEWEST).withColumns({"need": F.ceil(_least(F.size("words"))) - 1, "width": (span(F.size("words"), F.ceil(_least(F.size("words")))) - WIDTH + 1).cast("int"), "key": F.monotonically_increasing_id()})


def frequencies(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """gram, df: the number of texts that hold each of ``grams``; counted within tasks first."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(grams, "gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, g, runs in _runs(batch):
                hit = np.flatnonzero(contained(bits.value, g))
                if len(hit):
                    text = np.searchsorted(runs, hit, "right")
                    found = np.unique(np.stack([g[hit], text.astype(_U)]), axis=1)[0]
                    gram, df = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(df)], names=["gram", "df"])

    counts = docs.select("text").mapInArrow(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    return counts.join(grams, "gram", "left_semi")


def seeds(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """gram, key, times, sure, width: each item's rarest runs, how often it has each, how many of them a copy holds, and within how many places."""
    own = tests.select("key", "need", "width", F.size("grams").alias("n"), F.explode("grams").alias("gram")).groupBy("key", "need", "width", "n", "gram").agg(F.count("*").alias("times"))
    own = materialize(own, "own")
    df = frequencies(docs, own.select("gram").distinct()).withColumnRenamed("gram", "_gram")
    counted = own.join(df, F.col("gram") == F.col("_gram"), "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("sure", F.least(F.lit(SURE), "need"))
    rarer = F.sum("times").over(W.partitionBy("key").orderBy("df", "gram").rowsBetween(W.unboundedPreceding, -1))
    return counted.withColumn("_rarer", F.coalesce(rarer, F.lit(0))).filter(F.col("_rarer") < F.col("n") - F.col("need") + F.col("sure")).select("gram", "key", "times", "sure", "width")


def suspects(docs: DataFrame, seed_grams: DataFrame) -> DataFrame:
    """uid, node (hash of the text), grams (seed-like runs found) and places of texts with any."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(seed_grams, "gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, _, _, g, runs in _runs(batch):
                hit = np.flatnonzero(contained(bits.value, g))
                if len(hit):
                    text = np.searchsorted(runs, hit, "right") - 1
                    which, start = np.unique(text, return_index=True)
                    lists = [_lists(np.append(start, len(hit)), x) for x in (g[hit], (hit - runs[text]).astype(_U))]
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(which + i)), *lists], names=["node", "grams", "places"])

    rows = docs.select(F.xxhash64("text").alias("node"), "text").mapInArrow(run, "node long, grams array<long>, places array<long>")
    return rows.withColumn("uid", F.monotonically_increasing_id())


def candidates(found: DataFrame, seed: DataFrame) -> DataFrame:
    """node and key of the texts that hold enough of an item's seeds close enough together."""
    hits = found.select("uid", "node", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.arrays_zip("grams", "places")).alias("h"))
    salted = seed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("gram", "_gram")
    met = hits.join(salted, (F.col("h.grams") == F.col("_gram")) & (F.col("salt") == F.col("_salt")))
    each = met.groupBy("uid", "node", "key", "sure", "width").agg(F.array_sort(F.collect_list(F.struct(F.col("h.places").alias("place"), F.col("_gram").alias("gram"), F.col("times").alias("times")))).alias("at"))
    lists = each.filter(F.size("at") >= F.col("sure")).select("node", "key", "sure", "width", *[F.col(f"at.{c}").alias(c) for c in ("place", "gram", "times")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                place, gram, times = (batch.column(c)[i].values.to_numpy() for c in ("place", "gram", "times"))
                _, at, which = np.unique(gram, return_index=True, return_inverse=True)
                keep.append(most_within(place, which, times[at], batch.column("width")[i].as_py(), batch.column("sure")[i].as_py()))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["node", "key"])

    return lists.mapInArrow(run, "node long, key long").distinct()


def worded(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, node and words of the texts whose node is in ``wanted``; no other text leaves its task."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(contained(bits.value, batch.column("node").to_numpy().view(_U))))
            for i, j, h, first in pieces(part.column("text"), lower=True, punctuation=True):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(i, j - i), part.column("node").slice(i, j - i), _lists(first, h)], names=["doc_id", "node", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), "text").mapInArrow(run, "doc_id long, node long, words array<long>")


def align(text: np.ndarray, item: np.ndarray) -> int:
    """The best local alignment score of two word sequences; a row of the matrix at a time."""
    n = len(text)
    along = np.arange(n + 1, dtype=np.int32)
    row, best = np.zeros(n + 1, np.int32), 0
    for w in item:
        new = np.zeros(n + 1, np.int32)
        new[1:] = row[:-1] + np.where(text == w, 1, -1)
        np.maximum(new, row - 1, out=new)
        np.maximum(new, 0, out=new)
        # gaps in the item: the best of all cells to the left, less their distance
        row = np.maximum.accumulate(new + along) - along
        best = max(best, int(row.max()))
    return best


def close(text: np.ndarray, item: np.ndarray, width: int, need: int) -> bool:
    """Whether the runs of a text hold ``need`` of an item's within ``width`` places."""
    grams, times = np.unique(item, return_counts=True)
    if not len(grams):
        return need <= 0
    at = np.minimum(np.searchsorted(grams, text), len(grams) - 1)
    place = np.flatnonzero(grams[at] == text)
    return most_within(place, at[place], times, width, need)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, node, item_id, n_item_words, score and share of every copy of an item in a text."""
    tests = materialize(items(benchmark), "items")
    seed = materialize(seeds(docs, tests), "seeds")
    found = materialize(suspects(docs, seed.select("gram")), "suspects")
    pairs = materialize(candidates(found, seed), "pairs")
    texts = materialize(worded(docs, pairs.select("node")), "texts")
    some = tests.select(F.col("key").alias("_key"), "item_id", "need", "width", F.col("words").alias("item"), F.col("grams").alias("item_grams"))
    both = texts.join(pairs.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).join(some, F.col("key") == F.col("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tests_, runs, need, width = (batch.column(c) for c in ("words", "item", "item_grams", "need", "width"))
            score = []
            for i in range(batch.num_rows):
                text = words[i].values.to_numpy()
                own, _ = shingles(text.view(_U), np.array([0, len(text)]), WIDTH, whole=False)
                score.append(align(text, tests_[i].values.to_numpy()) if close(own, runs[i].values.to_numpy().view(_U), width[i].as_py(), need[i].as_py()) else 0)
            size = pc.list_value_length(tests_).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), batch.column("item_id"), size, pa.array(score, pa.int64())], names=["doc_id", "node", "item_id", "n_item_words", "score"])

    scored = both.select("doc_id", "node", "item_id", "words", "item", "item_grams", "need", "width").mapInArrow(run, "doc_id long, node long, item_id long, n_item_words long, score long")
    return scored.filter(F.col("score") >= _least(F.col("n_item_words"))).withColumn("share", F.col("score") / F.col("n_item_words"))


def without_tests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item."""
    bad = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct(), "contaminated")
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64("text").alias("_own"))
    return packed.join(bad, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_node")), "left_anti").select("_doc.*")
