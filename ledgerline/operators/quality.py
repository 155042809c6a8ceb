"""Checks of whole datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.scalar import item_size
from ledgerline.operators.access import missing_keys
from ledgerline.sources.items import ITEM_SETS, generate_items


def _must(df: DataFrame, ok, message: str) -> DataFrame:
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def check_cardinality(df: DataFrame, n: int) -> DataFrame:
    """The row count, or an error if it isn't ``n``."""
    return _must(df.agg(F.count("*").alias("n_rows")), F.col("n_rows") == n, f"not {n} rows")


def probe_first_last(df: DataFrame, key: str, first, last) -> DataFrame:
    """How often the first and the last key are found; each must be once, and one that isn't there is an error too."""
    asked = df.sparkSession.createDataFrame([(first,), (last,)], df.select(F.col(key).alias("probe")).schema).distinct()
    found = df.where(F.col(key).isin(first, last)).groupBy(F.col(key).alias("__found")).agg(F.count("*").alias("n"))
    hits = asked.join(found, F.col("probe") == F.col("__found"), "left").select("probe", F.coalesce("n", F.lit(0)).alias("n"))
    return _must(hits, F.col("n") == 1, "a probe isn't there just once")


def needle_counts(df: DataFrame, seq: str, needle, every: int = 10_000) -> DataFrame:
    """Needles found, expected, and misplaced."""
    due = F.col(seq) % every == 0
    return df.agg(F.count_if(needle).alias("found"), F.count_if(due).alias("expected"), F.count_if(needle != due).alias("misplaced"))


def check_needles(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    return missing_keys(expected, df, [key])


def canonical_hash(df: DataFrame, sets: tuple[str, ...] = ()) -> DataFrame:
    """Each row's digest after normalisation: columns by name, sets sorted without repeats."""
    def form(f: T.StructField):
        c = F.col(f.name)
        return F.array_sort(F.array_distinct(c)) if f.name in sets else c

    fields = [form(f).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias("row_hash"))


def semantic_diff(a: DataFrame, b: DataFrame, sets: tuple[str, ...] = ()) -> DataFrame:
    """Row hashes whose number of rows differs: (row_hash, n_a, n_b)."""
    tagged = canonical_hash(a, sets).withColumn("a", F.lit(1)).union(canonical_hash(b, sets).withColumn("a", F.lit(0)))
    counts = tagged.groupBy("row_hash").agg(F.sum("a").alias("n_a"), F.sum(1 - F.col("a")).alias("n_b"))
    return counts.where("n_a <> n_b")


def check_generated(stored: DataFrame, profile: str, n: int, sample: float = 1.0) -> DataFrame:
    """Stored rows against rows made anew: how many differ, and bytes on both sides."""
    made = generate_items(stored.sparkSession, n, profile)
    keep = lambda df: df if sample >= 1 else df.where(F.pmod(F.xxhash64("sk"), F.lit(1_000_000)) < int(sample * 1_000_000))
    stored, made = keep(stored.select(*made.columns)), keep(made)
    sized = lambda df, c: df.select(F.lit(c).alias("side"), item_size(df.schema, sets=ITEM_SETS).alias("bytes"))
    bytes_ = sized(stored, "stored").union(sized(made, "made")).agg(*[F.sum(F.when(F.col("side") == c, F.col("bytes"))).alias(f"{c}_bytes") for c in ("stored", "made")])
    different = semantic_diff(stored, made, ITEM_SETS).agg(F.coalesce(F.sum(F.abs(F.col("n_a") - F.col("n_b"))), F.lit(0)).alias("different"))
    return different.join(F.broadcast(bytes_), F.lit(True))


def segment_disjoint(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows, rows over all segments, and keys in more than one of them."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("segment").alias("segments"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("segments") > 1).alias("shared_keys"))
