"""Near-duplicates by DartMinHash signatures and a banded join.

A text is the weighted set of its runs of five words, weighted by how often each occurs. On
the board of every run lies a fixed random pattern of darts: a unit rate over weight and rank.
A text is hit by the darts within its runs' weights; the earliest hit in rank, per coordinate,
is its signature, and two texts agree in a coordinate with the probability of their weighted
Jaccard similarity. Only darts up to a rank that yields about ``K (ln K + 3)`` of them are
thrown, whatever the text's length; texts with an empty coordinate throw up to twice the rank.

Equal texts are one node. Nodes that share a band are candidates. In each band's bucket the
node that shares most buckets with others is the hub, and all others are compared with it,
which yields the runs that each adds to the hub's and lacks of them. Of the other pairs of a
bucket only those that may join two classes are compared: by their signatures they may be
similar, and they share added runs or have so few added and lacking runs that they need not
(``_undecided``). So copies of one text with edits of their own need no comparison among
each other. Every candidate's similarity is computed exactly from the runs before it counts as
a link; classes are connected components of links.

Runs enter the sets by 44 bits of their hashes: a run that only one of two texts of n runs has
counts as common with a probability of n / 2 ** 44. Texts are known by 64-bit hashes.

Null texts and texts without words are linked to nothing and form classes of their own rows.
Texts of 1 to 4 words are one run. Class ids are the smallest doc_id of a class (null only if
none has one); rows that repeat a doc_id and text are in one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scratch import materialize
from tidemark.llm.bits import bitmap, contained
from tidemark.llm.graph import components
from tidemark.llm.words import mix, pieces, shingles

WIDTH = 5
SIMILAR = 0.8
K, BANDS, ROWS = 128, 25, 5
#: Coordinates enter a sketch by four bits, of which 15/16 of the unequal ones differ: at a
#: similarity of 0.8, 24 +- 4.4 of 128. Most of them for a pair in a bucket, and for a hub's pair;
#: both so loose that the bands alone decide which similar pairs are lost.
MOST_PAIR, MOST_HUB = 66, 66
SKETCH = [f"k{i}" for i in range(K // 16)]
_U = np.uint64


def cells(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of weight: a hash for each run and occurrence, and the text of each."""
    # one sort of numbers: the text in the upper 20 bits, 44 bits of the run below
    key = (np.repeat(np.arange(len(first) - 1, dtype=_U), np.diff(first)) << _U(44)) | (g >> _U(20))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.arange(len(key))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return mix((key & _U((1 << 44) - 1)) + nth.astype(_U) * _U(0x9E3779B97F4A7C15)), (key >> _U(44)).astype(np.int64)


def grouped(texts: pa.Array, most: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of consecutive texts i..j with the first run of each text and the end, about ``most`` at once."""
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def joined() -> tuple[int, int, np.ndarray, np.ndarray]:
        sizes = np.concatenate([np.diff(x[3]) for x in held])
        return held[0][0], held[-1][1], np.concatenate([x[2] for x in held]), np.concatenate([[0], np.cumsum(sizes)])

    for i, j, h, first in pieces(texts):
        held.append((i, j, *shingles(h, first, WIDTH)))
        if sum(len(x[2]) for x in held) >= most:
            yield joined()
            held = []
    if held:
        yield joined()


def darts(cell: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n, K) of n texts out of their cells; zeros for texts without cells."""
    size = np.bincount(text, minlength=n)
    best = np.full((n, K), np.iinfo(_U).max, _U)
    flat = best.reshape(-1)
    one, step = np.float32(1), np.float32(2.0**-24)
    todo, reach = np.flatnonzero(size), K * (np.log(K) + 3)
    while len(todo):
        most = np.zeros(n, np.float32)
        most[todo] = reach / size[todo]
        seed, own = cell, text
        if len(todo) < n:
            keep = most[text] > 0
            seed, own = cell[keep], text[keep]
        rank, limit, nth = np.zeros(len(seed), np.float32), most[own], 0
        while len(seed):
            nth += 1
            with np.errstate(over="ignore"):
                h = mix(seed + _U(nth * 0xD1B54A32D192ED03 & (2**64 - 1)))
            # the upper bits say how far the next dart lies, the lower bits its coordinate
            rank = rank - np.log(((h >> _U(40)).astype(np.float32) + one) * step)
            hit = np.flatnonzero(rank <= limit)
            seed, own, rank, limit, h = seed[hit], own[hit], rank[hit], limit[hit], h[hit]
            with np.errstate(over="ignore"):
                value = (rank.view(np.uint32).astype(_U) << _U(32)) | ((h * _U(0xD6E8FEB86659FD93)) >> _U(32))
            np.minimum.at(flat, own * K + (h & _U(K - 1)).astype(np.int64), value)
        todo = todo[(best[todo] == np.iinfo(_U).max).any(axis=1)]
        reach *= 2
    return np.where(size[:, None] > 0, best & _U(0xFFFFFFFF), _U(0))


def bands(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of runs of ROWS coordinates."""
    out = np.zeros((len(sig), BANDS), _U)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            x = np.full(len(sig), b + 1, _U)
            for r in range(ROWS):
                x = mix(x + sig[:, b * ROWS + r])
            out[:, b] = x
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the text), n_runs, bands and the sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, g, runs in grouped(batch.column("text")):
                sig = darts(*cells(g, runs), j - i)
                four = (sig & _U(15)).astype(np.uint8)
                sketch = np.ascontiguousarray(four[:, ::2] << 4 | four[:, 1::2]).view(np.int64)
                offsets = pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("node").slice(i, j - i), pa.array(np.diff(runs)), pa.ListArray.from_arrays(offsets, pa.array(bands(sig).reshape(-1).view(np.int64))), *[pa.array(x.copy()) for x in sketch.T]],
                    names=["doc_id", "node", "n_runs", "bands", *SKETCH],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("node")).mapInArrow(run, f"doc_id long, node long, n_runs long, bands array<long>, {', '.join(f'{k} long' for k in SKETCH)}")


def run_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its cells as sorted 64-bit hashes, for the texts whose node is in ``wanted``.

    Tasks read all texts and keep those that pass the bitmap, so no text is shuffled.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = contained(bits.value, batch.column("node").to_numpy().view(_U))
            part = batch.filter(pa.array(hit))
            for i, j, g, runs in grouped(part.column("text")):
                cell, text = cells(g, runs)
                cut = np.searchsorted(text, np.arange(j - i + 1))
                sets = [np.unique(cell[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("node").slice(i, j - i), pa.array(sets, pa.binary())], names=["node", "cells"])

    return docs.select("text", F.xxhash64("text").alias("node")).mapInArrow(run, "node long, cells binary").dropDuplicates(["node"])


COMPARED = "a long, b long, similarity double, size long, lacking long, added array<long>"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their similarity, the size of b, what b lacks of a's cells and what it adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            sim, size, lacking, added = [], [], [], []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_py(), _U), np.frombuffer(b[i].as_py(), _U)
                new = np.setdiff1d(y, x, assume_unique=True)
                common = len(y) - len(new)
                sim.append(common / max(1, len(x) + len(new)))
                size.append(len(y))
                lacking.append(len(x) - common)
                added.append(new.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *[pa.array(v, t) for v, t in ((sim, pa.float64()), (size, pa.int64()), (lacking, pa.int64()), (added, pa.list_(pa.int64())))]], names=["a", "b", "similarity", "size", "lacking", "added"])

    left = sets.select(F.col("node").alias("a"), F.col("cells").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("cells").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, COMPARED)


def _unequal(one: str, other: str) -> Column:
    """How many coordinates of two sketches differ in their four bits."""
    total = F.lit(0)
    for k in SKETCH:
        x = F.col(f"{one}{k}").bitwiseXOR(F.col(f"{other}{k}"))
        x = x.bitwiseOR(F.shiftright(x, 2))
        x = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def _undecided(members: DataFrame, hubs: DataFrame, told: DataFrame, labels: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of a bucket, in two classes yet, that may be similar.

    Let two texts add p and q cells to a hub's, s of them in common, and lack u and v of its
    cells. They differ in at least p + q - 2 s + |u - v| cells, and texts that are similar
    enough differ in at most ``(1 / similar - 1)`` times the smaller one's size. Pairs that may
    be so near without a common added cell are joined by hub, pairs that need one by that cell,
    rarest first. Of each pair at least one is outside its hub's class; only those start a join.
    """
    room = F.lit(1 / similar - 1)
    label = labels.select(F.col("node").alias("_n"), "label")
    crowd = members.filter("n > 2").join(hubs.select("_band", "hub"), F.col("band") == F.col("_band")).filter(F.col("node") != F.col("hub"))
    crowd = crowd.join(label, F.col("node") == F.col("_n"), "left").drop("_n").withColumn("class", F.coalesce("label", "node")).drop("label")
    crowd = crowd.join(label, F.col("hub") == F.col("_n"), "left").withColumn("hub_class", F.coalesce("label", "hub")).select("band", "node", "hub", "class", "hub_class", *SKETCH)
    facts = told.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "size", "lacking", F.size("added").alias("adding"))
    crowd = materialize(crowd.join(facts, (F.col("hub") == F.col("_a")) & (F.col("node") == F.col("_b")), "left").drop("_a", "_b"), "crowd")
    # texts that were compared with their bucket's hub meet once under it, others in each band
    hub_rows = crowd.filter("size is not null").drop("band").distinct().withColumn("far", F.col("class") != F.col("hub_class"))
    # |u - v| + q is at least u plus the hub's least (q - v)
    bound = hub_rows.groupBy(F.col("hub").alias("_hub")).agg(F.least(F.lit(0), F.min(F.col("adding") - F.col("lacking"))).alias("least"), F.count_if("far").alias("_far"))
    bound = materialize(bound.filter("_far > 0").drop("_far"), "bound")
    hub_rows = materialize(hub_rows.join(bound, F.col("hub") == F.col("_hub")).drop("_hub").withColumn("excess", F.col("adding") + F.col("lacking") + F.col("least") - room * F.col("size")), "hub_rows")

    def other(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(f"o_{c}") for c in df.columns])

    differ = (F.col("class") != F.col("o_class")) & (_unequal("", "o_") <= MOST_PAIR)
    apart = F.col("adding") + F.col("o_adding") + F.abs(F.col("lacking") - F.col("o_lacking"))
    may = materialize(hub_rows.filter("excess <= 0"), "may")
    once = ~F.col("o_far") | (F.col("node") < F.col("o_node"))
    by_hub = may.filter("far").join(other(may), (F.col("hub") == F.col("o_hub")) & once & differ & (apart <= room * F.least("size", "o_size")))
    loose = materialize(crowd.filter("size is null").select("band", "node", "class", *SKETCH), "loose")
    by_band = loose.join(other(crowd.select("band", "node", "class", *SKETCH)), (F.col("band") == F.col("o_band")) & differ)
    # a text with an excess shares at least half of it in added cells, so one of its rarest others
    adds = told.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.explode("added").alias("cell")).join(hub_rows.select("hub", "node", "class", "far", "adding", "lacking", "size", "excess", *SKETCH), (F.col("_a") == F.col("hub")) & (F.col("_b") == F.col("node"))).drop("_a", "_b")
    adds = materialize(adds, "adds")
    often = materialize(adds.groupBy(F.col("hub").alias("_h"), F.col("cell").alias("_c")).agg(F.count("*").alias("often")).filter("often > 1"), "often")
    adds = adds.join(often, (F.col("hub") == F.col("_h")) & (F.col("cell") == F.col("_c"))).drop("_h", "_c")
    alone = F.col("adding") - F.count("*").over(W.partitionBy("hub", "node"))
    place = F.row_number().over(W.partitionBy("hub", "node").orderBy("often", "cell")) + alone
    adds = materialize(adds.withColumn("place", place), "placed")
    # nodes without an excess may share any number of cells; pairs of two such are joined above or need one
    first = adds.filter("far").filter(F.col("place") <= F.col("adding") - F.greatest(F.lit(1), F.ceil(F.col("excess") / 2)) + 1)
    # the cells that a pair must share, if any, lie among its rarest on either side
    need = F.ceil((apart - room * F.least("size", "o_size")) / 2)
    early = (need > 0) & (F.col("place") <= F.col("adding") - need + 1) & (F.col("o_place") <= F.col("o_adding") - need + 1)
    met = first.join(other(adds), (F.col("hub") == F.col("o_hub")) & (F.col("cell") == F.col("o_cell")) & early & differ)
    both = by_hub.select(F.col("node").alias("x"), F.col("o_node").alias("y"))
    both = both.union(by_band.select("node", "o_node")).union(met.select("node", "o_node"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, node, class_id, class_node of every row; a, b, similarity of every link.

    Classes of rows without words have a null class_node.
    """
    rows = materialize(signed(docs), "signed", "zstd")
    nodes = rows.filter("n_runs > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("bands", *SKETCH)])
    nodes = materialize(nodes, "nodes", "zstd")
    crowded = nodes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("band").alias("_band"), "n")
    crowded = materialize(crowded, "crowded")
    members = nodes.select(F.explode("bands").alias("band"), "node").join(crowded, F.col("band") == F.col("_band")).select("band", "node", "n")
    members = materialize(members, "members")
    fame = materialize(members.groupBy("node").agg(F.sum("n").alias("fame")), "fame")
    sketches = fame.select(F.col("node").alias("_n"), "fame").join(nodes.select("node", *SKETCH), F.col("node") == F.col("_n")).drop("_n")
    sketches = materialize(sketches, "sketches")
    members = materialize(members.join(sketches.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n"), "members")
    hubs = members.groupBy("band").agg(F.max(F.struct("fame", "node", *SKETCH)).alias("h"))
    hubs = materialize(hubs.select(F.col("band").alias("_band"), F.col("h.node").alias("hub"), *[F.col(f"h.{k}").alias(f"h_{k}") for k in SKETCH]), "hubs")
    star = members.join(hubs, F.col("band") == F.col("_band")).filter(F.col("node") != F.col("hub")).filter(_unequal("", "h_") <= MOST_HUB)
    star = materialize(star.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n")), "star")
    wanted = materialize(star.select(F.col("a").alias("node")).union(star.select("b")).union(members.filter("n > 2").select("node")).distinct(), "wanted")
    sets = materialize(run_sets(docs, wanted).join(wanted.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left_semi"), "sets")
    told = materialize(compared(star, sets), "compared")
    links = told.filter(F.col("similarity") >= similar).select("a", "b", "similarity")
    labels = components(links)
    cross = materialize(_undecided(members, hubs, told, labels, similar), "cross")
    more = materialize(compared(cross, sets).filter(F.col("similarity") >= similar).select("a", "b", "similarity"), "more")
    links = links.union(more)
    if not more.isEmpty():
        labels = components(links)
    linked = nodes.select("node", "doc_id").join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "doc_id", F.coalesce("label", "node").alias("class_node"))
    linked = materialize(linked, "linked")
    ids = materialize(linked.groupBy("class_node").agg(F.min("doc_id").alias("class_id")), "ids").withColumnRenamed("class_node", "_c")
    named = materialize(linked.join(ids, F.col("class_node") == F.col("_c")).select(F.col("node").alias("_node"), "class_id", "class_node"), "named")
    out = rows.select("doc_id", "node", F.when(F.col("n_runs") > 0, F.col("node")).alias("_key")).join(named, F.col("_key") == F.col("_node"), "left")
    out = out.select("doc_id", "node", F.when(F.col("class_node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_node")
    return out, links


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each class: the smallest doc_id, once. Rows without words stay."""
    rows, _ = near_duplicates(docs)
    first = rows.filter("class_node is not null").groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m"))
    first = materialize(first.select(F.col("m.doc_id").alias("_id"), F.col("m.node").alias("_node")).union(rows.filter("class_node is null").select("doc_id", "node").distinct()), "first")
    packed = docs.select(F.struct("*").alias("_doc"), "doc_id", F.xxhash64("text").alias("_key"), (F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("_words"))
    kept = packed.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_node")), "left_semi")
    # repeats of a row meet under a key of their own; rows without words are all kept
    again = rows.groupBy("doc_id", "node").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_i"), F.col("node").alias("_n"))
    same = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_n")) & F.col("_words")
    again = materialize(again, "again")
    if again.isEmpty():
        return kept.select("_doc.*")
    return kept.join(again, same, "left_anti").select("_doc.*").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_key"]).select("_doc.*"))
