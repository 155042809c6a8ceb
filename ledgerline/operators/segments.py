"""Segments, pages and cursors of a partitioned scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ordered import dense_sequence

MOST_SEGMENTS, MOST_PAGE = 1_000_000, 10_000


def segment_of(key: Column | str, total: int) -> Column:
    """Stable segment of a key: the first 32 bits of its MD5, so any engine can tell it."""
    if not 1 <= total <= MOST_SEGMENTS:
        raise ValueError(f"segments must be 1..{MOST_SEGMENTS}")
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(total))


def with_segment(df: DataFrame, key: str, total: int) -> DataFrame:
    return df.withColumn("segment", segment_of(key, total))


def with_page(df: DataFrame, page_size: int, key: str) -> DataFrame:
    """Page number inside the segment, by key, which must be unique there.

    Rows are numbered over all segments at once, by (segment, key), so a large segment is many tasks' work.
    """
    if not 1 <= page_size <= MOST_PAGE:
        raise ValueError(f"pages must hold 1..{MOST_PAGE} rows")
    numbered = dense_sequence(df, ["segment", key], "__place")
    # One row a segment, MOST_SEGMENTS at most.
    first = numbered.groupBy(F.col("segment").alias("__segment")).agg(F.min("__place").alias("__first"))
    place = numbered.join(first, F.col("segment").eqNullSafe(F.col("__segment")))
    return place.select(*df.columns, F.floor((F.col("__place") - F.col("__first")) / page_size).cast("bigint").alias("page"))


def page_budget(df: DataFrame, max_pages: int) -> DataFrame:
    """Rows of each segment's first pages."""
    return df.where(F.col("page") < max_pages)


def first_rows(df: DataFrame, n: int, key: str, to: str) -> DataFrame:
    """The first ``n`` rows of each segment by key, numbered from 1. Every task passes on no more than these of its own rows."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy("segment").orderBy(key))).where(F.col(to) <= n)


def first_pages(df: DataFrame, max_pages: int, page_size: int, key: str) -> DataFrame:
    """Rows of each segment's first pages, with their page: page_budget() of with_page(), without numbering the rest."""
    if not 1 <= page_size <= MOST_PAGE:
        raise ValueError(f"pages must hold 1..{MOST_PAGE} rows")
    rows = first_rows(df, max_pages * page_size, key, "__place")
    return rows.withColumn("page", F.floor((F.col("__place") - 1) / page_size).cast("bigint")).drop("__place")


def cursors_after(df: DataFrame, max_pages: int, page_size: int, key: str) -> DataFrame:
    """What each segment has done under a page budget: its last key, unless it is complete. segment_cursors() without numbering all rows."""
    n = max_pages * page_size
    rows = first_rows(df.select("segment", key), n + 1, key, "__place")
    done = F.max("__place") <= n
    read = F.col("__place") <= n
    return rows.groupBy("segment").agg(F.when(done, F.lit(None)).otherwise(F.max(F.when(read, F.col(key)))).alias("cursor"), done.alias("completed"), F.count_if(read).alias("examined"))


def segment_cursors(df: DataFrame, max_pages: int, key: str) -> DataFrame:
    """What each segment of paged rows has done under a page budget: its last key, unless it is complete."""
    read = F.col("page") < max_pages
    done = F.max("page") < max_pages
    return df.groupBy("segment").agg(F.when(done, F.lit(None)).otherwise(F.max(F.when(read, F.col(key)))).alias("cursor"), done.alias("completed"), F.count_if(read).alias("examined"))


def resume_after(df: DataFrame, cursors: DataFrame, key: str) -> DataFrame:
    """Rows that are still to be read: none of complete segments, those after the cursor of others. Stored segments are resumed by
    sources.stored.resume_segments(), which doesn't read complete ones."""
    # One row a segment, MOST_SEGMENTS at most.
    known = cursors.select("segment", "cursor", "completed")
    joined = df.join(known, "segment", "left")
    left = ~F.coalesce(F.col("completed"), F.lit(False)) & (F.col("cursor").isNull() | (F.col(key) > F.col("cursor")))
    return joined.where(left).select(*df.columns)


def validate_cursors(cursors: DataFrame, **identity) -> DataFrame:
    """Cursors as they are; one of another geometry or table, or complete yet with a key, is an error."""
    ok = ~(F.col("completed") & F.col("cursor").isNotNull())
    for column, value in identity.items():
        ok = ok & F.col(column).eqNullSafe(F.lit(value))
    return cursors.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a cursor belongs to another scan")).cast("boolean")))


def scan_summary(pages: DataFrame) -> DataFrame:
    """Totals of (pages, examined, returned, capacity, completed) rows; summaries merge by the same sums."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return pages.agg(*[zero(c) for c in ("pages", "examined", "returned", "capacity", "completed")])


def keyset_page(df: DataFrame, order: str, after, limit: int) -> DataFrame:
    """The next rows in order after a key, whether more follow, and the key to go on from."""
    more = df if after is None else df.where(F.col(order) > F.lit(after))
    top = more.orderBy(order).limit(limit + 1)
    # limit + 1 rows: one task.
    place = F.row_number().over(Window.orderBy(order))
    everything = Window.partitionBy()
    numbered = top.withColumn("__n", place).withColumn("has_more", F.max("__n").over(everything) > limit).where(F.col("__n") <= limit)
    return numbered.withColumn("next_after", F.max(order).over(everything)).drop("__n")


def merge_run_state(primary: DataFrame, backup: DataFrame, runs: DataFrame) -> DataFrame:
    """Of two saved states of each run the one that went further: (run, source, attempts, elapsed, history_complete).

    Saved states are (run, attempts, elapsed, valid), one row where a file is there, not valid if it can't be read; ``runs``
    names every run. The primary wins unless the backup is ahead by (attempts, elapsed). source: PRIMARY, BACKUP, NONE
    where nothing was saved, LOST where nothing that was can be read; these two start from 0. History is complete for PRIMARY and NONE.
    """
    state = lambda df, n: df.select(F.col("run").alias(f"__{n}"), F.lit(True).alias(f"{n}_there"), F.when(F.col("valid"), F.struct("attempts", "elapsed")).alias(n))
    both = runs.select("run").join(state(primary, "p"), F.col("run") == F.col("__p"), "left").join(state(backup, "b"), F.col("run") == F.col("__b"), "left")
    p, b = F.col("p"), F.col("b")
    saved = F.col("p_there").isNotNull() | F.col("b_there").isNotNull()
    source = F.when(p.isNull() & b.isNull(), F.when(saved, "LOST").otherwise("NONE")).when(p.isNull(), "BACKUP").when(b.isNull() | (p >= b), "PRIMARY").otherwise("BACKUP")
    out = both.select("run", source.alias("source"), "p", "b")
    pick = F.when(F.col("source") == "PRIMARY", F.col("p")).when(F.col("source") == "BACKUP", F.col("b"))
    zero = lambda c: F.coalesce(pick[c], F.lit(0)).alias(c)
    return out.select("run", "source", zero("attempts"), zero("elapsed"), F.col("source").isin("PRIMARY", "NONE").alias("history_complete"))


def resume_totals(checkpoints: DataFrame, target: int) -> DataFrame:
    """Totals over all attempts; they must reach the target with every segment complete. Elapsed is null where history isn't."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "examined", "returned", "bytes")]
    whole = F.bool_and("history_complete")
    out = checkpoints.agg(*sums, F.bool_and("completed").alias("completed"), F.when(whole, F.sum("elapsed")).alias("elapsed"))
    ok = (F.col("examined") == target) & F.col("completed")
    return out.where(F.when(ok, True).otherwise(F.raise_error(F.lit("the attempts don't make a whole scan")).cast("boolean")))
