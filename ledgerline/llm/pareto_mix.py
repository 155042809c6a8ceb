"""Mixing sources to target weights by Pareto order sampling.

DataFrame functions only. A document's expected copies are its source's target over the source's size, times its own weight over the
source's mean one. Their whole part is certain. What is left of them is its inclusion probability in a sample
of fixed size, in words, that brings its source to the target: documents are ranked by the odds of a random number over the odds of their
inclusion probability, least first, and taken in that order while they fit.

Where a source's cut falls is told by sums over ranges of ranks, which narrow down until the range at the cut holds few
documents, so no task sorts or holds a source; only that range is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ordered import dense_sequence
from ledgerline.llm.storage import discard, written

#: Documents that the last range of a source may hold, and the ranges that one holds.
RANGE, WAYS = 4096, 1024
#: A document's rank is a whole number below 2**RANK_BITS.
RANK_BITS = 50
WHITE = "\t\n\x0b\x0c\r "


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D; 0 for null. Each run becomes one letter, and the letters are counted."""
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(F.ltrim(letters, F.lit(WHITE))), F.lit(0)).cast("long")


def with_source(df: DataFrame, of: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``of`` (one row a source); a null source is a source like others."""
    return df.join(of.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size), one row a source.

    Sources in order of their names, by code point and null last, weigh ``weights`` in turn. They share ``share`` times all sizes
    by weight; a target stops at ``most`` times its source's size, and the excess goes to the others by weight until none is
    above. Where all stop, that is all there is.
    """
    # Nulls last, so by a flag first; one row a source.
    ranked = dense_sequence(sizes.select("source", F.col("source_size").cast("long").alias("source_size"), F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__name")), ["__null", "__name"], "__n")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("__n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("top")), "sources")
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, capped = None, -1
    if whole["size"]:
        level = share * whole["size"] / whole["weight"]
        while True:
            above = F.col("top") <= F.lit(level) * F.col("weight")
            row = ranked.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("top")).otherwise(0.0)).alias("top"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
            if row["n"] == capped or not row["weight"]:
                break
            capped, level = row["n"], (share * whole["size"] - row["top"]) / row["weight"]
    return ranked.select("source", "source_size", F.least("top", F.lit(level or 0.0) * F.col("weight")).alias("target"))


def expected_copies(sizes: DataFrame, most: float) -> DataFrame:
    """(source, rate) of sizes (source, weight, size, target), one row for each source and weight of its documents.

    A document's expected copies are ``most`` or its weight times the rate, whichever is less; the rate is such that they make the target.
    """
    sizes = sizes.where("weight > 0 and size > 0")
    rate, capped = sizes.groupBy("source").agg((F.max("target") / F.sum(F.col("weight") * F.col("size"))).alias("rate")), -1
    while True:
        rated = with_source(sizes, rate)
        above = F.col("rate") * F.col("weight") >= most
        again = rated.groupBy("source").agg(
            F.count_if(above).alias("n"), F.max("rate").alias("rate"), F.max("target").alias("target"),
            F.sum(F.when(above, most * F.col("size")).otherwise(0.0)).alias("top"), F.sum(F.when(above, 0.0).otherwise(F.col("weight") * F.col("size"))).alias("below"),
        )
        again = written(again, "rates")
        n = again.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        if n == capped:
            return again.select("source", "rate")
        capped = n
        rate = again.select("source", F.when((F.col("n") > 0) & (F.col("below") > 0), (F.col("target") - F.col("top")) / F.col("below")).otherwise(F.col("rate")).alias("rate"))


def ordered_sample(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, low, ranks) of ranked (source, rank, size) and wanted (source, rest, n): where each source's sample of ``rest`` words ends.

    n is the source's number of documents, and ``rest`` no more than their sizes.

    A sample is all documents of ranks below ``low`` and those of ``ranks``; documents of one rank share their fate. Ranges of ranks are
    summed up, and the one in which the words reach ``rest`` is parted again until it holds RANGE documents at most, or one rank. Its
    documents are taken in order, each that still fits.
    """
    step = (WAYS - 1).bit_length()
    ranges = written(wanted.where("rest > 0").select("source", F.lit(0).cast("long").alias("low"), F.lit(1 << RANK_BITS).alias("width"), "rest", "n"), "ranges")
    bits = RANK_BITS
    while bits and not (wide := ranges.where(F.col("n") > RANGE)).isEmpty():
        bits -= step
        parts = _inside(ranked, wide).groupBy("source", F.shiftright("rank", bits).alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("rest").alias("rest"))
        # WAYS rows a source at most.
        before = F.sum("size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        cut = parts.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest and before + size >= rest")
        narrowed = cut.select("source", F.shiftleft("part", bits).alias("low"), F.lit(1 << bits).alias("width"), (F.col("rest") - F.col("before")).alias("rest"), "n")
        last, ranges = ranges, written(ranges.where(F.col("n") <= RANGE).unionByName(narrowed), "ranges")
        discard(last)
    groups = _inside(ranked, ranges).groupBy("source", "rank").agg(F.sum("size").alias("size"), F.max("low").alias("low"), F.max("rest").alias("rest"))
    # RANGE groups a source at most.
    listed = groups.groupBy("source").agg(F.max("low").alias("low"), F.max("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("rank", "size"))).alias("groups"))
    start = F.struct(F.col("rest").alias("left"), F.array().cast("array<bigint>").alias("ranks"))
    take = lambda s, g: F.when(
        g["size"] <= s["left"], F.struct((s["left"] - g["size"]).alias("left"), F.array_append(s["ranks"], g["rank"]).alias("ranks"))
    ).otherwise(s)
    return listed.select("source", "low", F.aggregate("groups", start, take)["ranks"].alias("ranks"))


def _inside(ranked: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents whose ranks are in their source's range, with it."""
    joined = with_source(ranked, ranges.select("source", "low", "width", "rest"))
    return joined.where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("width")))


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, keep: tuple[str, ...] = ("doc_id",),
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7,
) -> DataFrame:
    """(row, source, size, source_size, target, copies, taken) of every row: how often a mix takes it.

    row holds the columns ``keep``; size is the text's number of words, taken is copies times size. Sources get targets from ``weights`` (see
    source_targets); a document is taken at most ``most`` times, rounded up. ``weight_col`` names documents' own weights, so that some
    are likelier than others; null or below 0 counts as 0, and without it all weigh the same. A source's sample ends
    with the last document that fits, so it misses its target by less than the smallest document left at its cut.

    Random numbers come from a hash of seed, id and text, so reruns agree, and rows that repeat both share their fate. A null or
    empty text has no words and isn't taken; null sources are one source; null ids are ids too. No row is lost. Names that
    clash aren't looked at, except those asked for.
    """
    text = F.col(text_col).cast("string")
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary")), 1, 13)
    own = F.greatest(F.lit(0.0), F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))) if weight_col else F.lit(1.0)
    rows = docs.select(
        F.struct(*keep).alias("row"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), own.alias("weight"), F.conv(digits, 16, 10).cast("long").alias("draw")
    )
    rows = written(rows, "sized")
    sizes = rows.groupBy("source", "weight").agg(F.sum("size").alias("size"))
    targets = written(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    if weight_col:
        rates = expected_copies(with_source(sizes, targets.select("source", "target")), most)
    else:
        rates = targets.where("source_size > 0").select("source", (F.col("target") / F.col("source_size")).alias("rate"))
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("weight") * F.col("rate")))
    rated = with_source(rows, with_source(targets, rates, "left"), "left").withColumn("expected", F.coalesce(expected, F.lit(0.0)))
    rated = rated.withColumn("certain", F.floor("expected").cast("long"))
    part = F.col("expected") - F.col("certain")
    u = (F.col("draw") + 0.5) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (part / (1 - part))
    rank = F.floor(odds / (1 + odds) * F.lit(float(1 << RANK_BITS))).cast("long")
    rated = rated.withColumn("rank", F.when(part > 0, F.least(F.lit((1 << RANK_BITS) - 1), rank)))
    open_size = F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0))
    rest = F.round(F.max("target") - F.sum(F.col("certain") * F.col("size"))).cast("long")
    wanted = written(rated.groupBy("source").agg(F.least(rest, open_size).alias("rest"), F.count("rank").alias("n")), "wanted")
    ends = written(ordered_sample(rated.where("rank is not null").select("source", "rank", "size"), wanted), "ends")
    out = with_source(rated, ends.select("source", "low"), "left")
    taken = ends.select(F.col("source").alias("__source"), F.explode("ranks").alias("__rank"))
    out = out.join(taken, F.col("source").eqNullSafe(F.col("__source")) & (F.col("rank") == F.col("__rank")), "left")
    drawn = F.coalesce((F.col("rank") < F.col("low")) | F.col("__rank").isNotNull(), F.lit(False))
    copies = F.col("certain") + F.when(F.col("rank").isNotNull() & drawn, 1).otherwise(0)
    return out.select("row", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
