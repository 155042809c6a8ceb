"""Item tables: reading, typed documents, generated items, object listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.scalar import epoch_to_ts, tenant

#: Payload bytes, whether one tenant is hot, and number of tenants of each profile (fixed values).
PROFILES = {
    "rich-uniform": (512, False, 1000),
    "rich-skewed": (512, True, 1000),
    "medium-uniform": (4096, False, 1000),
    "medium-skewed": (4096, True, 1000),
    "large-uniform": (16384, False, 1000),
    "low-selectivity": (2048, False, 500),
    "high-cardinality": (2048, False, 10000),
    "hot-key": (2048, True, 100),
}


def read_items(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Every item once, with only the asked columns read."""
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


def _wrapped(kind: T.DataType) -> T.DataType:
    """Schema of a typed attribute: one field named by the type's letter."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField("M", T.StructType([T.StructField(f.name, _wrapped(f.dataType)) for f in kind.fields])), T.StructField("NULL", T.BooleanType())])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("SS", "NS")] + [T.StructField("L", T.ArrayType(_wrapped(T.StringType()))), T.StructField("NULL", T.BooleanType())])
    if isinstance(kind, T.ArrayType):
        return T.StructType([T.StructField("L", T.ArrayType(_wrapped(kind.elementType))), T.StructField("NULL", T.BooleanType())])
    letter = "BOOL" if isinstance(kind, T.BooleanType) else "B" if isinstance(kind, T.BinaryType) else "N" if isinstance(kind, T.NumericType) else "S"
    value = T.BooleanType() if letter == "BOOL" else T.StringType()
    return T.StructType([T.StructField(letter, value), T.StructField("NULL", T.BooleanType())])


def _unwrapped(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_unwrapped(c["M"][f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c["M"].isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.coalesce(F.array_sort(F.array_distinct(F.coalesce(c["SS"], c["NS"]))), F.transform(c["L"], lambda x: x["S"]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c["L"], lambda x: _unwrapped(x, kind.elementType))
    if isinstance(kind, T.BooleanType):
        return c["BOOL"]
    if isinstance(kind, T.BinaryType):
        return F.unbase64(c["B"])
    if isinstance(kind, T.NumericType):
        return c["N"].try_cast(kind)
    return c["S"]


def parse_typed_items(df: DataFrame, json_col: str, schema: T.StructType, bad_col: str = "bad_numbers") -> DataFrame:
    """Typed attribute documents as columns of ``schema``.

    Absent and explicit null both give null columns here; attr_state() on the document tells
    them apart. Sets come sorted and without repeats. ``bad_col`` names top-level numbers whose text doesn't fit.
    """
    wrapped = T.StructType([T.StructField(f.name, _wrapped(f.dataType)) for f in schema.fields])
    doc = F.from_json(F.col(json_col), wrapped)
    parsed = df.withColumn("__doc", doc)
    numbers = [f for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    bad = [F.when(F.col("__doc")[f.name]["N"].isNotNull() & F.col("__doc")[f.name]["N"].try_cast(f.dataType).isNull(), F.lit(f.name)) for f in numbers]
    return parsed.select(
        *[df[c] for c in df.columns if c not in schema.fieldNames() and c != bad_col],
        *[_unwrapped(F.col("__doc")[f.name], f.dataType).alias(f.name) for f in schema.fields],
        F.array_compact(F.array(*bad)).alias(bad_col) if bad else F.array().cast("array<string>").alias(bad_col),
    )


def _typed(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(F.struct(*[_typed(c[f.name], f.dataType).alias(f.name) for f in kind.fields]).alias("M"))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.when(c.isNotNull(), F.struct(F.array_sort(F.array_distinct(c)).alias("SS")))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNotNull(), F.struct(F.transform(c, lambda x: _typed(x, kind.elementType)).alias("L")))
    if isinstance(kind, T.BooleanType):
        return F.when(c.isNotNull(), F.struct(c.alias("BOOL")))
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), F.struct(F.base64(c).alias("B")))
    if isinstance(kind, T.NumericType):
        return F.when(c.isNotNull(), F.struct(c.cast("string").alias("N")))
    return F.when(c.isNotNull(), F.struct(c.cast("string").alias("S")))


def to_typed_items(df: DataFrame, to: str = "document") -> DataFrame:
    """Each row as a typed JSON document; null columns are absent from it."""
    return df.select(F.to_json(F.struct(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])).alias(to))


#: Values that an item's sequence number picks in turn, and its fixed ones (fixed values).
CHANNELS = ("API", "BATCH", "MOBILE", "BRANCH")
OPERATIONS = ("PAYMENT", "REVERSAL", "RECONCILIATION")
REGIONS = ("SP", "RJ", "MG", "PR")
FLAGS = ("audited", "replayable")
CURRENCY, ORIGIN, SCHEMA_VERSION, NEEDLE = "BRL", "performance-lab", 3, "incident-needle"
#: Attributes that are sets of texts.
ITEM_SETS = ("tags",)


def item_columns(seq: Column, profile: str) -> list[Column]:
    """The 25 attributes of the item with a sequence number; the same number always gives the same item."""
    payload, skewed, tenants = PROFILES[profile]
    n = seq.cast("bigint")
    numbered = lambda prefix, value, width: F.format_string(f"{prefix}%0{width}d", value)
    hexed = lambda prefix: F.format_string(f"{prefix}%016x", n)
    turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    status = F.when(n % 100 == 0, "MATCH").when(n % 2 == 0, "PENDING").otherwise("SETTLED")
    account = numbered("", n % 100_000_000, 8)
    document = 99_999_999_999
    hour = F.concat(numbered("2026-09-", n % 28 + 1, 2), numbered("T", n % 24, 2))
    return [
        tenant(n, skewed, tenants).alias("pk"),
        numbered("record-", n, 12).alias("sk"),
        status.alias("status"),
        F.concat(F.lit("category-"), (n % 50).cast("string")).alias("category"),
        F.lit(1).cast("bigint").alias("version"),
        hexed("txn-").alias("transactionId"),
        numbered("pay-", n, 14).alias("paymentId"),
        numbered("customer-", n % 10_000_000, 7).alias("customerId"),
        F.concat(F.lit("acct-"), account).alias("accountId"),
        numbered("", n % document, 11).alias("document"),
        (n % 5_000_000 + 100).alias("amount"),
        F.lit(CURRENCY).alias("currency"),
        turn(CHANNELS).alias("channel"),
        numbered("product-", n % 24, 2).alias("productCode"),
        F.concat(hour, F.lit(":00:00Z")).alias("createdAt"),
        F.concat(hour, F.lit(":30:00Z")).alias("updatedAt"),
        (n % 7 != 0).alias("active"),
        (n % 4).alias("retryCount"),
        F.array_sort(F.array(F.concat(F.lit("tag-"), (n % 8).cast("string")), F.concat(F.lit("flow-"), (n % 5).cast("string")))).alias("tags"),
        F.struct(
            F.when(n % 10_000 == 0, NEEDLE).otherwise(hexed("corr-")).alias("correlationId"),
            hexed("trace-").alias("traceId"),
            numbered("system-", n % 12, 2).alias("sourceSystem"),
            turn(OPERATIONS).alias("operation"),
            (n % 5 + 1).alias("priority"),
        ).alias("incident"),
        F.struct(
            numbered("", n % 999, 3).alias("bankCode"), numbered("", n % 10_000, 4).alias("branch"), account.alias("account"), turn(REGIONS).alias("region")
        ).alias("routing"),
        F.struct(
            numbered("counterparty-", n % 100_000, 5).alias("name"), numbered("", n * 17 % document, 11).alias("document"), F.when(n % 3 == 0, "LEGAL").otherwise("PERSON").alias("type")
        ).alias("counterparty"),
        F.array(
            F.struct(F.lit("CREATED").alias("state"), (F.lit(1_700_000_000) + n).alias("at")), F.struct(status.alias("state"), (F.lit(1_700_000_060) + n).alias("at"))
        ).alias("history"),
        F.struct(F.lit(SCHEMA_VERSION).cast("bigint").alias("schemaVersion"), F.lit(ORIGIN).alias("origin"), F.array(*map(F.lit, FLAGS)).alias("flags")).alias("metadata"),
        F.repeat(F.lit("x"), payload).alias("payload"),
    ]


def history_rows(items: DataFrame, key: list[str], history: str = "history") -> DataFrame:
    """(key, place from 0, state, at as a time) of every entry of the items' histories; items without one have no rows."""
    entries = items.select(*key, F.posexplode(history).alias("place", "__entry"))
    return entries.select(*key, "place", F.col("__entry.state").alias("state"), epoch_to_ts("__entry.at").alias("at"))


def generate_items(spark: SparkSession, n: int, profile: str = "rich-uniform") -> DataFrame:
    return spark.range(n).select(*item_columns(F.col("id"), profile))


def object_inventory(spark: SparkSession, path: str, prefix: str = "*", max_bytes: int = 1 << 20) -> DataFrame:
    """Objects under a path with their size, and whether each passes a byte budget; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", prefix).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), "modificationTime", (F.col("length") > max_bytes).alias("over_budget"))


def write_items(df: DataFrame, path: str, version: int) -> str:
    """A new version of an item table; readers go by the newest version that is marked as done."""
    target = f"{path}/v={version:012d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def latest_path(spark: SparkSession, path: str) -> str:
    """The newest version of an item table; Spark's own success mark tells which are whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(hadoop) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(p.toString() for p in done)


def latest_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(latest_path(spark, path))
