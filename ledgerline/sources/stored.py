"""Items laid out for how they are read: a base in buckets of its partition key, an index of keys, files by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.segments import segment_of
from ledgerline.sources.commits import Files

#: Keys that may be listed in a plan, so that only their buckets are read; more are joined bucket by bucket.
LISTED = 1000
#: Open segments that may be listed in a plan; there is one row of each, and the table's folders are listed by the driver too.
MOST_LISTED = 20_000


def write_base(items: DataFrame, name: str, buckets: int, pk: str = "pk", sk: str = "sk") -> DataFrame:
    """Store items as table ``name`` in buckets of ``pk``, each sorted by (pk, sk), so that a join on pk needs no exchange of them."""
    # One task a bucket writes its one file.
    items.repartition(buckets, pk).write.mode("overwrite").format("parquet").bucketBy(buckets, pk).sortBy(pk, sk).saveAsTable(name)
    return items.sparkSession.table(name)


def write_index(items: DataFrame, name: str, by: str, sk: str = "sk", keys: tuple[str, ...] = ("pk", "sk")) -> DataFrame:
    """Store a keys-only index as table ``name``: a folder for each value of ``by``, its files in order of ``sk``.

    A read by value and range of sk touches that folder's files alone, and of these the row groups that hold the range. Null values of
    ``by`` have a folder of their own.
    """
    columns = list(dict.fromkeys([by, sk, *keys]))
    items.select(*columns).repartitionByRange(by, sk).sortWithinPartitions(by, sk).write.mode("overwrite").format("parquet").partitionBy(by).saveAsTable(name)
    return items.sparkSession.table(name)


def query_stored_index(spark: SparkSession, index: str, base: str, by: str, value, sk_range: tuple, keys: tuple[str, ...] = ("pk", "sk"), pk: str = "pk", sk: str = "sk", listed: int = LISTED) -> DataFrame:
    """Items of ``base`` whose ``by`` is ``value`` and whose sk lies in a range, both ends included, found by the index.

    Where the index names at most ``listed`` partition keys, these are listed and only their buckets are read. Otherwise the keys are dealt to
    the base's buckets and joined there, without an exchange of the base. An index entry whose item has gone finds nothing; an item
    that has changed since is found as it is now.
    """
    found = spark.table(index).where((F.col(by) == value) & F.col(sk).between(*sk_range)).select(*keys)
    items = spark.table(base)
    some = [r[0] for r in found.select(pk).distinct().limit(listed + 1).collect()]
    if len(some) <= listed:
        return items.where(F.col(pk).isin(some)).join(F.broadcast(found), list(keys), "left_semi") if some else items.limit(0)
    # Buckets are of pk alone, so the other keys meet as ranges, which ask for no other partitioning.
    named = found.distinct().select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.col(pk) == F.col(f"__{pk}")
    for k in keys:
        if k != pk:
            same = same & (F.col(k) >= F.col(f"__{k}")) & (F.col(k) <= F.col(f"__{k}"))
    return items.join(named.hint("shuffle_merge"), same, "left_semi")


def write_segments(items: DataFrame, path: str, key: str, total: int) -> None:
    """Store items by segment of ``key``, a folder each, in order of the key inside."""
    placed = items.withColumn("segment", segment_of(key, total))
    placed.repartitionByRange("segment", key).sortWithinPartitions("segment", key).write.mode("overwrite").partitionBy("segment").parquet(path)


def resume_segments(spark: SparkSession, path: str, cursors: DataFrame, key: str, schema: str | None = None) -> DataFrame:
    """Rows that are still to be read of stored segments: those after the cursor of each open one.

    cursors: (segment, cursor, completed), one row a segment; a segment without a row is read from its start, a null cursor is the start too. Only
    open segments' files are read, as these are listed in the plan (up to MOST_LISTED of them; beyond, the join leaves the rows of others out).
    """
    stored = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    folders = [n.split("=")[1] for n in Files(spark).names(path) if n.startswith("segment=")]
    # One row a segment.
    there = spark.createDataFrame([(int(n),) for n in folders if n.isdigit()], "__segment int")
    known = cursors.select(F.col("segment").cast("int").alias("__segment"), "cursor", F.coalesce("completed", F.lit(False)).alias("__completed"))
    open_ = there.join(known, "__segment", "left").where(~F.coalesce("__completed", F.lit(False))).select("__segment", "cursor").collect()
    cursor_type = cursors.schema["cursor"].dataType.simpleString()
    left = spark.createDataFrame(open_, f"__segment int, cursor {cursor_type}")
    if len(open_) <= MOST_LISTED:
        stored = stored.where(F.col("segment").isin([r["__segment"] for r in open_]))
    joined = stored.join(F.broadcast(left), F.col("segment") == F.col("__segment"))
    return joined.where(F.col("cursor").isNull() | (F.col(key) > F.col("cursor"))).drop("__segment", "cursor")
