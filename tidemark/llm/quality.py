"""Quality rules with adaptive thresholds (DataFrame functions only).

Each document gets a few measures; each measure is summarised per (language, source) by a
mergeable quantile sketch, and a document is rejected if a measure lies outside its group's
fences. The sketch is a histogram over buckets that grow by ``GAMMA``: counts of equal buckets
add up, so sketches of partitions, sources or languages merge by summing, in any order and
with the same result.

Three measures are shares: of symbols among words and symbols, of repeated lines, of words in
repeated windows. A count c of n is measured by (sqrt(c) - 1) / sqrt(n), not below 0: the root of a share that
the count speaks for beyond its own uncertainty, as that of a root of a count is the same for small and large
counts. So a text without any has the measure 0, however long it is, and a single symbol too; buckets of shares are
``STEP`` wide and 0 is one of its own. Word length is measured in buckets that grow by ``GAMMA``.

A fence lies beyond a quartile by so many times the distance of the quartiles, but a distance below a
measure's least is taken for that. A share's fence nears the end of its scale but never reaches it: of the way
from the quartile to a share of 1 it takes 1 - exp(-distance / way), which is the distance where that is short. Quartiles of small groups are
uncertain, so a group's are the mean of its own, weighted by its documents, and its language's,
weighted like ``PRIOR`` documents; a language's are drawn to those of all rows in the same way.

Null texts count as empty; documents without words have no measures. Null languages and sources are groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scratch import materialize

SPACE = r"\x20\x09-\x0D"
_BLANKS = " \t\n\x0b\x0c\r"
#: Ratio of neighbouring bucket bounds of word lengths: quantiles come within 1 % of the true value.
GAMMA = 1.02
#: Width of a share's bucket, and the last bucket.
STEP, END = 0.01, 100
#: measure -> (what is counted, of how many, distance of a fence in quartile distances, least quartile distance in buckets, whether low values are rejected too)
MEASURES = {
    "symbols_per_word": ("n_symbols", "n_words + n_symbols", 2.5, 10.0, False),
    "dup_line_share": ("n_dup_lines", "_n_lines", 3.0, 10.0, False),
    "repeat_share": ("n_repeat_words", "n_words", 3.5, 20.0, False),
    "word_length": ("word_chars", "n_words", 4.0, 1.0, True),
}
SHARES = tuple(m for m in MEASURES if m != "word_length")
#: Documents that a parent's quartiles count for beside those of a group.
PRIOR = 50
#: Rows of one group are dealt to this many keys where the fences are joined by a shuffle.
SALTS = 16


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for null."""
    body = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.length(body) > 0, F.split(body, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))


def _window(i: Column) -> tuple[Column, Column, Column]:
    """The three words of the window at place i, from 1."""
    return F.get("_w", i.cast("int") - 1), F.get("_w", i.cast("int")), F.get("_w", i.cast("int") + 1)


def _equal(i: Column, k: Column) -> Column:
    a, b, c = (x == y for x, y in zip(_window(i), _window(k), strict=True))
    return a & b & c


def base_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A window's 64-bit hash is shifted to make room for its position and the packed numbers
    are sorted, so equal windows become neighbours: n log n in the length of a text, however
    often a window repeats. Neighbours with one hash are held against each other word by word;
    in a text where any two differ, the windows themselves are sorted instead.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.withColumns({"_w": words(F.col("text")), "_lines": lines})
    df = df.withColumns({"n_words": F.size("_w").cast("long"), "_bits": F.ceil(F.log2(F.size("_w") + F.lit(2))).cast("int")})
    places = F.sequence(F.lit(1), F.size("_w") - 2)
    packed = F.transform(places, lambda i: F.call_function("shiftleft", F.xxhash64(*_window(i)), F.col("_bits")).bitwiseOR(i.cast("long")))
    df = df.withColumn("_p", F.when(F.size("_w") > 2, F.sort_array(packed)).otherwise(F.array().cast("array<long>")))

    def hash_of(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("_bits"))

    def place_of(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)

    # array positions count from 0 in get(); outside the array it is null, which is unequal
    def like(x: Column, y: Column) -> Column:
        return F.coalesce(hash_of(x) == hash_of(y), F.lit(False))

    repeated = F.filter("_p", lambda x, j: like(x, F.get("_p", j - 1)) | like(x, F.get("_p", j + 1)))
    df = df.withColumn("_r", repeated)
    mixed = F.exists(F.transform("_r", lambda x, j: like(x, F.get("_r", j + 1)) & ~_equal(place_of(x), place_of(F.get("_r", j + 1)))), lambda x: x)
    # sorted once, as a column of its own: neighbours are looked up in it, not in an expression that each look would sort again
    whole = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *_window(i)).alias("w"), i.cast("long").alias("i"))))
    df = df.withColumn("_s", F.when(mixed, whole))
    alone = F.filter("_s", lambda x, j: F.coalesce(x["w"] == F.get("_s", j - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get("_s", j + 1)["w"], F.lit(False)))
    df = df.withColumn("_at", F.coalesce(F.transform(alone, lambda x: x["i"]), F.transform("_r", place_of)))
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2))))
    return df.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("_at") > 0, F.size(covered)).otherwise(0).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_w", "_lines", "_bits", "_p", "_r", "_s", "_at")


def measures(counted: DataFrame) -> DataFrame:
    """Add the measures as bucket numbers of the sketch; null for documents without words, which no fence judges."""

    def share(count: str, of: str) -> Column:
        root = F.greatest(F.lit(0.0), F.sqrt(F.col(count)) - 1) / F.sqrt(F.expr(of))
        return F.when(F.col("n_words") > 0, F.ceil(root * END).cast("int"))

    length = F.log(F.col("word_chars").cast("double") / F.col("n_words").cast("double")) / F.log(F.lit(GAMMA))
    shares = {m: share(*MEASURES[m][:2]) for m in SHARES}
    return counted.withColumns(shares | {"word_length": F.when(F.col("n_words") > 0, F.ceil(length).cast("int"))})


def sketches(measured: DataFrame, by: tuple[str, ...] = ("lang", "source"), names: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """One row per group, measure and bucket with its count ``n``; partial counts merge by sum."""
    long = measured.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bucket")) for m in names])).alias("m")).select(*by, "m.*")
    return long.filter("bucket is not null").groupBy(*by, "measure", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Total ``n`` and the buckets q1 and q3 of the outer quartiles of each group and measure of a sketch."""
    group = [*by, "measure"]
    whole = W.partitionBy(*group)
    up_to = whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    df = sketch.groupBy(*group, "bucket").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(up_to), "total": F.sum("n").over(whole)})
    at = {f"q{k}": F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket"))).cast("double") for k in (1, 3)}
    return df.groupBy(*group).agg(F.max("total").alias("n"), *[c.alias(q) for q, c in at.items()])


def fences(sketch: DataFrame, prior: float = PRIOR) -> DataFrame:
    """lang, source and, for each measure m, m_low and m_high: the buckets between which a document is kept.

    The three levels of quartiles hold one row per group; they are joined null-safely.
    """
    fine, mid, top = quartiles(sketch, ("lang", "source")), quartiles(sketch, ("lang",)), quartiles(sketch, ())
    mid = mid.select(F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), *[F.col(c).alias(f"mid_{c}") for c in ("n", "q1", "q3")])
    top = top.select(F.col("measure").alias("_m"), *[F.col(c).alias(f"top_{c}") for c in ("q1", "q3")])
    df = fine.join(mid, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure"))).join(top, F.col("measure") == F.col("_m"))

    def drawn(n: Column, own: Column, parent: Column) -> Column:
        return (n * own + F.lit(float(prior)) * parent) / (n + F.lit(float(prior)))

    q = {c: drawn(F.col("n"), F.col(c), drawn(F.col("mid_n"), F.col(f"mid_{c}"), F.col(f"top_{c}"))) for c in ("q1", "q3")}
    df = df.select("lang", "source", "measure", *[v.alias(k) for k, v in q.items()])
    setting = {k: F.create_map(*[F.lit(x) for m, v in MEASURES.items() for x in (m, v[i])])[F.col("measure")] for i, k in ((2, "spread"), (3, "least"))}
    far = setting["spread"] * F.greatest(F.col("q3") - F.col("q1"), setting["least"])
    way = F.lit(float(END)) - F.col("q3")
    high = F.when(F.col("measure").isin(*SHARES), F.when(way > 0, F.col("q3") + way * (1 - F.exp(-far / way))).otherwise(F.lit(float(END)))).otherwise(F.col("q3") + far)
    df = df.select("lang", "source", "measure", (F.col("q1") - far).alias("low"), high.alias("high"))
    pick = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}") for m, (*_, both) in MEASURES.items() for e in (("low", "high") if both else ("high",))]
    return df.groupBy("lang", "source").agg(*pick)


def judge(measured: DataFrame, fence: DataFrame) -> DataFrame:
    """Add base_failed and kept. A measure that is null breaks no fence."""
    far = fence.select(F.col("lang").alias("_fl"), F.col("source").alias("_fs"), *[c for c in fence.columns if c not in ("lang", "source")], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt2"))
    df = measured.withColumn("_salt1", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    df = df.join(far, F.col("lang").eqNullSafe(F.col("_fl")) & F.col("source").eqNullSafe(F.col("_fs")) & (F.col("_salt1") == F.col("_salt2")), "left")
    broken = F.lit(False)
    for m, (*_, both) in MEASURES.items():
        broken = broken | F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
        if both:
            broken = broken | F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumns({"base_failed": failed, "kept": ~failed & ~broken}).drop("_salt1", "_salt2", "_fl", "_fs", *[c for c in fence.columns if c not in ("lang", "source")])


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Every row of ``docs`` with its counts, measures and verdict.

    ``carry`` names the columns of ``docs`` to return. The counts are made once and written,
    since both the sketches and the verdict read them. An empty table gives an empty result.
    """
    keep = list(dict.fromkeys([*carry, "doc_id", "lang", "source"]))
    plain = docs.select(*dict.fromkeys([*keep, "text"]))
    counted = measures(base_counts(plain))
    measured = materialize(counted.select(*keep, *[c for c in counted.columns if c not in docs.columns]), "quality")
    return judge(measured, fences(sketches(measured)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    packed = docs.select("doc_id", "lang", "source", "text", F.struct("*").alias("_doc"))
    return quality_rules(packed, ("_doc",)).filter("kept").select("_doc.*")
