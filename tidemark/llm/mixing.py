"""Mixing sources to target weights (DataFrame functions only).

Documents get hash-random keys, and a source is read in the order of its keys: after whole
epochs, its budget ends at one place of that order. The place is found by prefix sums over
ranges of the key, over ranges within the range that holds it, and over the sorted rows of the
last range. What a document gives follows from its own key and its source's place, so documents
are never moved: one table of a row per source is joined to them.

Sources may be null (the last one). Rows with null text have size 0 and are never taken. Rows
without id are known by their text. Repeated rows are documents of their own; if a budget ends
among rows alike in key and size, each gives the same share, so the source may be short of its
target by less words than there are such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scratch import materialize

#: Relative weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words; most epochs of a source.
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
#: Hexadecimal digits of the key by which a range is parted, and how often: 65,536 last ranges a source.
DIGITS, LEVELS = 2, 2


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, n_docs, source_size and target, from rows with source and size.

    Capping sources and resharing the excess by weight ends where every source gets
    ``min(cap, level * weight)``; the level follows from prefix sums over the sources in order
    of cap / weight. The windows without partitions hold a row per source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    df = per.withColumn("_at", place).withColumns(
        {"_weight": F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_at", F.lit(len(weights)))), "_cap": F.col("source_size") * float(epochs), "_total": F.sum("source_size").over(W.partitionBy()) * float(share)}
    )
    before = W.orderBy(F.col("_cap") / F.col("_weight"), "_at").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({"_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_rest": F.sum("_weight").over(W.partitionBy()) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))})
    # the level if just the sources before this one are full; the first that it does not fill holds
    df = df.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_rest"))
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_at"), F.col("_level").alias("level")))).over(W.partitionBy())["level"]
    target = F.coalesce(F.least(F.col("_cap"), level * F.col("_weight")), F.col("_cap"))
    return df.select("source", "n_docs", "source_size", target.alias("target"))


def keyed(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with _size and _key: a hash of the seed and the id, or of the text where there is no id."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit(""))))
    return docs.withColumns({"_size": size_of(F.col("text")), "_key": F.md5(F.concat(F.lit(seed), own))})


def cuts(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """One row per source: _src, source_size, target, _whole epochs, and the place where its budget ends.

    ``rows`` have source, size and _key. The place is a _cut_key and _cut_size, of whose rows
    each gives _cut_words. Prefix sums of whole ranges of the key find the range that holds it,
    and so on within that range; only rows of the last ranges are sorted themselves.
    """
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    at = goal.select(F.col("source").alias("_src"), "source_size", "target", whole.alias("_whole"), (F.floor("target").cast("long") - whole * F.col("source_size")).alias("_rest"))
    at = at.withColumns({"_start": F.lit(0).cast("long"), "_range": F.lit("")})
    per_source = [c for c in at.columns if c not in ("_start", "_range")]

    def within(by: list[Column]) -> DataFrame:
        """Sums of ``size`` by ``by`` in the sources' ranges with the words before each, where the rest of the budget ends."""
        part = rows.join(at, F.col("source").eqNullSafe(F.col("_src")) & F.col("_key").startswith(F.col("_range")))
        sums = part.groupBy(*per_source, "_start", *by).agg(F.sum("size").alias("_words"), F.count("*").alias("_n"))
        names = sums.columns[len(per_source) + 1 : -2]
        before = F.sum("_words").over(W.partitionBy("_src").orderBy(*names).rowsBetween(W.unboundedPreceding, -1))
        sums = sums.withColumn("_start", F.col("_start") + F.coalesce(before, F.lit(0)))
        return sums.filter((F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("_words")))

    for level in range(1, LEVELS + 1):
        at = materialize(within([F.substring("_key", 1, level * DIGITS).alias("_range")]).select(*per_source, "_start", "_range"), f"cut{level}")
    each = F.floor((F.col("_rest") - F.col("_start")) / F.col("_n")).cast("long")
    last = within([F.col("_key").alias("_cut_key"), F.col("size").alias("_cut_size")])
    return materialize(last.select(*per_source, "_cut_key", "_cut_size", each.alias("_cut_words")).drop("_rest"), "cuts")


def take(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Add source_size, target and taken to ``rows`` with source, _size and _key; no row leaves its task if ``cut`` is small."""
    df = rows.join(cut, F.col("source").eqNullSafe(F.col("_src")), "left")
    place, end = F.struct("_key", "_size"), F.struct(F.col("_cut_key"), F.col("_cut_size"))
    part = F.when(place < end, F.col("_size")).when(place == end, F.col("_cut_words")).otherwise(0)
    return df.withColumn("taken", F.coalesce(F.col("_whole") * F.col("_size") + part, F.lit(0)).cast("long")).drop("_src", "_whole", "_cut_key", "_cut_size", "_cut_words")


def _planned(docs: DataFrame, seed: str, weights: tuple[int, ...], share: float, epochs: int) -> tuple[DataFrame, DataFrame]:
    """(sizes and keys, cuts) of ``docs``."""
    rows = materialize(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "source", F.col("_size").alias("size"), "_key"), "sizes")
    goal = materialize(targets(rows, weights, share, epochs), "targets")
    found = cuts(rows, goal)
    # sources without words have no place where a budget ends
    rest = goal.select(F.col("source").alias("_src"), "source_size", "target").join(found.select(F.col("_src").alias("_s")), F.col("_src").eqNullSafe(F.col("_s")), "left_anti")
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns[3:]]
    return rows, materialize(found.unionByName(rest.select("*", *none)), "plan")


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Every row of ``docs`` with doc_id, source, size, source_size, target and ``taken`` words.

    The last document within a budget is taken in part, so a source's taken words are its
    whole-number target. An empty table gives an empty result.
    """
    rows, cut = _planned(docs, seed, weights, share, epochs)
    return take(rows.withColumnRenamed("size", "_size"), cut).select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` that the mix takes any words of, with how often each is taken in whole or part.

    ``taken`` and ``epochs`` replace columns of these names. Documents are read twice, for the
    sizes and for the result, and are neither shuffled nor written on the way.
    """
    _, cut = _planned(docs, seed, weights, share, epochs)
    packed = keyed(docs.select("doc_id", "source", "text", F.struct("*").alias("_doc")), seed)
    mixed = take(packed, cut).filter("taken > 0")
    own = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("taken", "epochs")]
    return mixed.select(*own, "taken", F.ceil(F.col("taken") / F.col("_size")).cast("int").alias("epochs"))
