"""The engine's tables as views of the given ones, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream; a table of one file is that file of its folder."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1000)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def _key(c):
    return F.concat(F.lit("payment-"), F.lpad(c.cast("string"), 8, "0"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "SETTLED").otherwise("MATCH")
    return o.select(
        _key(F.col("o_orderkey")).alias("record_key"),
        F.col("o_custkey").alias("pk"),
        F.col("o_orderkey").alias("sk"),
        status.alias("status"),
        (1 + F.col("o_orderkey") % 3).alias("version"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"),
        F.col("o_orderpriority").alias("priority"),
    )


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One confirmation an order with lines; settled when all its lines are."""
    li = table(spark, sf_dir, "lineitem")
    settled = F.bool_and(F.col("l_linestatus") == "F")
    return li.groupBy(_key(F.col("l_orderkey")).alias("reference")).agg(F.when(settled, "SETTLED").otherwise("PENDING").alias("status"), F.count("*").alias("version"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("FAILED", "CONFLICT", "ERROR", "BUSINESS_REJECTED", "FUNCTION_ERROR", "SKIPPED")])
    outcome = F.when(k % 10 >= 8, "").when(k % 13 < 6, F.element_at(kinds, (k % 13 + 1).cast("int"))).otherwise("REPAIRED")
    return o.select(
        F.concat(F.lit("job-"), (F.col("o_custkey") % 7).cast("string")).alias("job"),
        (k + 1).alias("seq"),
        _key(k).alias("record_key"),
        F.col("o_orderpriority").alias("payload"),
        F.when(k % 10 < 8, "DONE").otherwise("PLANNED").alias("state"),
        outcome.alias("outcome"),
    )


def effect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.concat(F.lit("job-"), (F.col("l_suppkey") % 5).cast("string")).alias("job"),
        F.col("l_orderkey").alias("task"),
        F.concat(F.lit("step-"), F.col("l_linenumber").cast("string")).alias("step"),
        F.when(flag == "A", "SUCCEEDED").when(flag == "N", "INTENT").otherwise("UNKNOWN").alias("state"),
        F.unix_timestamp("l_shipdate").alias("seen"),
        F.col("l_partkey").alias("part"),
    )


def messages(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    e = (table_stream if stream else table)(spark, sf_dir, "events")
    at = F.unix_timestamp("ts")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("business_id"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("receipt"),
        F.col("props").alias("body"),
        F.when(F.col("event_id") % 11 == 0, F.lit("bad")).when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.upper(F.md5(F.col("props").cast("binary")))).alias("md5OfBody"),
        (1 + F.col("event_id") % 6).cast("string").alias("receiveCount"),
        at.alias("receivedAt"),
        (at + 30 + F.col("event_id") % 180).alias("leaseUntil"),
        F.col("event_type"),
        F.col("user_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return e.groupBy(F.floor(F.col("event_id") / 50).cast("bigint").alias("page_no")).agg(
        F.concat(F.lit("job-"), (F.max("event_id") % 4).cast("string")).alias("job"), F.count("*").alias("scanned"), F.sum(cents).alias("capacity"), F.count_if(F.col("event_type") == "error").alias("retries")
    )


_KEY = "'payment-' || lpad(CAST({} AS VARCHAR), 8, '0')"
#: The same views as SQL common table expressions.
CTES = {
    "items": f"""SELECT {_KEY.format('o_orderkey')} AS record_key, o_custkey AS pk, o_orderkey AS sk,
      CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'SETTLED' ELSE 'MATCH' END AS status,
      1 + o_orderkey % 3 AS version, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderpriority AS priority FROM orders""",
    "confirmations": f"""SELECT {_KEY.format('l_orderkey')} AS reference,
      CASE WHEN bool_and(l_linestatus = 'F') THEN 'SETTLED' ELSE 'PENDING' END AS status, count(*) AS version FROM lineitem GROUP BY l_orderkey""",
    "tasks": f"""SELECT 'job-' || (o_custkey % 7) AS job, o_orderkey + 1 AS seq, {_KEY.format('o_orderkey')} AS record_key, o_orderpriority AS payload,
      CASE WHEN o_orderkey % 10 < 8 THEN 'DONE' ELSE 'PLANNED' END AS state,
      CASE WHEN o_orderkey % 10 >= 8 THEN '' WHEN o_orderkey % 13 < 6 THEN
        list_extract(['FAILED','CONFLICT','ERROR','BUSINESS_REJECTED','FUNCTION_ERROR','SKIPPED'], o_orderkey % 13 + 1) ELSE 'REPAIRED' END AS outcome FROM orders""",
    "effect_events": """SELECT 'job-' || (l_suppkey % 5) AS job, l_orderkey AS task, 'step-' || l_linenumber AS step,
      CASE l_returnflag WHEN 'A' THEN 'SUCCEEDED' WHEN 'N' THEN 'INTENT' ELSE 'UNKNOWN' END AS state,
      CAST(floor(epoch(l_shipdate)) AS BIGINT) AS seen, l_partkey AS part FROM lineitem""",
    "messages": """SELECT CAST(event_id AS VARCHAR) AS id, user_id || '-' || json_extract_string(props, '$.k') AS business_id, 'r' || event_id AS receipt,
      props AS body, CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN '' ELSE upper(md5(props)) END AS md5OfBody,
      CAST(1 + event_id % 6 AS VARCHAR) AS receiveCount, CAST(floor(epoch(ts)) AS BIGINT) AS receivedAt,
      CAST(floor(epoch(ts)) AS BIGINT) + 30 + event_id % 180 AS leaseUntil, event_type, user_id, ts AS event_time FROM events""",
    "scan_pages": """SELECT event_id // 50 AS page_no, 'job-' || (max(event_id) % 4) AS job, count(*) AS scanned,
      CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS capacity, count(*) FILTER (event_type = 'error') AS retries FROM events GROUP BY 1""",
}


def with_views(*names: str, body: str, more: str = "") -> str:
    """SQL text of a query over some of the views."""
    parts = [f"{n} AS ({CTES[n]})" for n in names] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body
