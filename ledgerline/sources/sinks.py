"""Reports, chunks, evidence and ledgers as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.scalar import csv_safe
from ledgerline.sources.commits import VERSION, Files, Tables

REPORT_COLUMNS = ("sequence", "record", "state", "outcome")


def select_columns(df: DataFrame, names: str, allowed: tuple[str, ...] = REPORT_COLUMNS) -> DataFrame:
    """Allowlisted columns in the order asked; unknown, repeated or no names are an error."""
    asked = [x.strip() for x in names.split(",") if x.strip()]
    if not asked or len(set(asked)) != len(asked) or set(asked) - set(allowed):
        raise ValueError(f"columns must be distinct and among {', '.join(allowed)}: {names!r}")
    return df.select(*asked)


def report_lines(df: DataFrame) -> DataFrame:
    """Every column as formula-safe text."""
    return df.select(*[csv_safe(F.col(c).cast("string")).alias(c) for c in df.columns])


def write_report_csv(df: DataFrame, path: str, columns: str | None = None, delimiter: str = ",", header: bool = True, compression: str | None = None) -> None:
    """All fields quoted, lines ended by CR LF (also those inside a value), null as an empty field, formulas disarmed."""
    out = report_lines(select_columns(df, columns) if columns else df)
    writer = out.write.mode("overwrite").option("sep", delimiter).option("header", header).option("quoteAll", True).option("escape", '"')
    writer = writer.option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "")
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_chunks(df: DataFrame, path: str, page_size: int, seq: str = "seq") -> None:
    """Pages of the sequence, in order in files of many pages; writing a page again replaces it. Readers see it once commit_chunks() says so.

    A write is a folder, which a record names once it is whole; of two writes of a page the one that began later counts. Files grow with the rows, not
    with the pages. Replaced pages stay in their files and aren't read as rows.
    """
    files, number = Files(df.sparkSession), 0
    while not files.create(f"{path}/_begun/{number:012d}.json", "{}"):
        number = max(number, *(int(n[:12]) for n in files.names(f"{path}/_begun") if n.endswith(".json"))) + 1
    chunk = F.floor((F.col(seq) - 1) / page_size).cast("long")
    df.withColumn("chunk", chunk).repartitionByRange("chunk").sortWithinPartitions("chunk").write.parquet(f"{path}/data/write={number}")
    files.create(f"{path}/_written/{number:012d}.json", "{}")


def committed_cursor(spark: SparkSession, path: str) -> dict:
    """The newest commit record of a folder of chunks; its cursor is 0 before the first."""
    files = Files(spark)
    names = [n for n in files.names(f"{path}/_commits") if n.endswith(".json")]
    return json.loads(files.read(f"{path}/_commits/{max(names)}")) if names else {"cursor": 0, "total": None, "page_size": None}


def commit_chunks(spark: SparkSession, path: str, cursor: int, total: int, page_size: int) -> bool:
    """Make the rows up to ``cursor`` of ``total`` visible, after their chunks were written; False if that was so already.

    The cursor ends a page or the whole, only goes forward, and belongs to the total and page size of the records before; another one is
    an error. Of two that commit the same cursor one writes the record.
    """
    old = committed_cursor(spark, path)
    whole = 0 <= cursor <= total and total >= 1 and page_size >= 1 and (cursor == total or cursor % page_size == 0)
    same = old["total"] in (None, total) and old["page_size"] in (None, page_size)
    if not whole or not same or cursor < old["cursor"]:
        raise ValueError(f"cursor {cursor} of {total} by {page_size} doesn't follow {old}")
    if cursor == old["cursor"]:
        return False
    return Files(spark).create(f"{path}/_commits/{cursor:020d}.json", json.dumps({"cursor": cursor, "total": total, "page_size": page_size}))


def read_chunks(spark: SparkSession, path: str, committed: int | None = None) -> DataFrame:
    """Rows of the pages that are committed, or of the first ``committed`` pages; what was written beyond isn't seen."""
    if committed is None:
        record = committed_cursor(spark, path)
        committed = -(-record["cursor"] // record["page_size"]) if record["page_size"] else 0
    written = [int(n[:12]) for n in Files(spark).names(f"{path}/_written") if n.endswith(".json")]
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/write={n}" for n in written]).where(F.col("chunk") < committed)
    # One row a page: its last write.
    last = rows.groupBy("chunk").agg(F.max("write").alias("write"))
    return rows.join(last, ["chunk", "write"], "left_semi").drop("write")


def write_evidence(df: DataFrame, path: str, batch: str, job: str = "job") -> None:
    """One JSON event for each applied task, by job; a batch that is written again replaces what it wrote."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", job).json(path)


def append_ledger(tables: Tables, effects: DataFrame, batch: str) -> int:
    """Add effects (job, task, step, state, ...) to a ledger, in a version of their own; a batch that is there already changes nothing."""
    return tables.commit(tables.version(), append={"effects": effects.withColumn("changes", F.lit(1).cast("bigint"))}, batch=batch)


def current_effects(tables: Tables, order: tuple[str, ...] = ()) -> DataFrame:
    """The last state of each (job, task, step), and how often it changed. Within a batch the last by ``order`` counts.

    After compact_ledger() that reads the snapshot and what was appended since.
    """
    rows = tables.read("effects")
    keys = ["job", "task", "step"]
    rest = [c for c in rows.columns if c not in (*keys, "changes", VERSION, *order)]
    last = F.max(F.struct(VERSION, *order, *rest)).alias("x")
    return rows.groupBy(*keys).agg(last, F.sum("changes").alias("changes")).select(*keys, "x.*", "changes")


def compact_ledger(tables: Tables, order: tuple[str, ...] = ()) -> int:
    """Put the current state in place of all that was appended so far."""
    newest = tables.version()
    return tables.commit(newest, replace={"effects": current_effects(tables, order)})
