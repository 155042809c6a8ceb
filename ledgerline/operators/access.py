"""Filters and access paths of an item table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small side that is sent to every task; the caller's key lists are checked against it.
SMALL_ROWS = 100_000


def project(df: DataFrame, attributes: list[str]) -> DataFrame:
    return df.select(*attributes)


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one value; a name with dots reaches into structs."""
    return df.where(F.col(column) == F.lit(value))


filter_nested = filter_eq


def examined_returned(df: DataFrame, predicate: Column) -> DataFrame:
    """How many rows a filter read and kept."""
    return df.agg(F.count("*").alias("examined"), F.count_if(predicate).alias("returned"))


def attr_state(document: Column | str, name: str) -> Column:
    """ABSENT, NULL or VALUE of an attribute of a JSON document."""
    doc = F.try_parse_json(document if isinstance(document, Column) else F.col(document))
    got = F.variant_get(doc, f"$.{name}", "variant")
    return F.when(got.isNull(), "ABSENT").when(F.is_variant_null(got), "NULL").otherwise("VALUE")


#: Kinds of JSON values behind the letters of typed attributes.
_KINDS = {"S": ["STRING"], "N": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "LONG", "INT", "TINYINT", "SMALLINT"], "BOOL": ["BOOLEAN"]}


def has_type(document: Column | str, name: str, letter: str) -> Column:
    """True where the attribute is absent, null or of the type."""
    doc = F.try_parse_json(document if isinstance(document, Column) else F.col(document))
    got = F.variant_get(doc, f"$.{name}", "variant")
    kind = F.regexp_replace(F.schema_of_variant(got), r"\(.*", "")
    return got.isNull() | F.is_variant_null(got) | kind.isin(_KINDS[letter])


def require_type(df: DataFrame, document: str, name: str, letter: str, strict: bool = True) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Strict: rows as they are, or an error at the first wrong type. Else the right rows and the quarantined ones."""
    ok = has_type(document, name, letter)
    if strict:
        return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"{name} is not of type {letter}")).cast("boolean")))
    return df.where(ok), df.where(~ok)


def require_key(df: DataFrame, key: str) -> DataFrame:
    """Rows as they are; a missing or blank key is an error."""
    ok = F.coalesce(F.length(F.trim(F.col(key).cast("string"))) > 0, F.lit(False))
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"blank {key}")).cast("boolean")))


def select_pending(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "PENDING")


def select_marked(df: DataFrame, source_job: str) -> DataFrame:
    return df.where(F.col("opsMarker").startswith(f"{source_job}:"))


def enforce_limits(df: DataFrame, key: str = "record_key", payload: str = "payload", key_chars: int = 2048, payload_chars: int = 1 << 20) -> DataFrame:
    ok = (F.length(key) <= key_chars) & (F.coalesce(F.length(payload), F.lit(0)) <= payload_chars)
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit("key or payload is too long")).cast("boolean")))


def attribute_exists(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isNotNull()


def attribute_not_exists(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isNull()


def resource_guard(df: DataFrame, allowed: DataFrame, resource: str = "resource", account: str | None = None, region: str | None = None) -> DataFrame:
    """Rows whose resource isn't allowed, isn't a whole ARN though it begins as one, or names another account or region.

    An ARN may leave its account or region blank; a URL names an account if that is the first part of its path.
    """
    name = F.col(resource).cast("string")
    part = lambda n: F.trim(F.split_part(name, F.lit(":"), F.lit(n)))
    arn = name.startswith("arn:")
    known = df.join(allowed.select(F.col(resource).alias("__allowed")).distinct(), F.col(resource) == F.col("__allowed"), "left")
    bad = F.col("__allowed").isNull() | (arn & (F.size(F.split(name, ":")) < 6))
    if account:
        of_url = F.regexp_extract(name, r"^https?://[^/]*/+(\d{12})(?:[/?#]|$)", 1)
        bad = bad | (arn & (part(5) != "") & (part(5) != account)) | ((of_url != "") & (of_url != account))
    if region:
        bad = bad | (arn & (part(4) != "") & (part(4) != region))
    return known.where(bad).drop("__allowed")


def get_item(df: DataFrame, **key) -> DataFrame:
    for column, value in key.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def batch_get(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items of a key list, and the keys that have none. The optimizer sends the list to all tasks if it is small."""
    keys = keys.select(*on).distinct()
    return df.join(keys, on, "left_semi"), keys.join(df, on, "left_anti")


def query_partition(df: DataFrame, pk, sk_range: tuple | None = None, limit: int | None = None, pk_col: str = "pk", sk_col: str = "sk") -> DataFrame:
    """Items of one partition, by sort key; both filters reach the files."""
    out = df.where(F.col(pk_col) == F.lit(pk))
    if sk_range:
        out = out.where(F.col(sk_col).between(*sk_range))
    out = out.orderBy(sk_col)
    return out.limit(limit) if limit else out


def build_index(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    return df.select(*columns, *[k for k in keys if k not in columns])


def query_index(index: DataFrame, base: DataFrame, status: str, sk_range: tuple, keys: list[str], sk_col: str = "sk") -> DataFrame:
    """Keys by the index, then the items they name."""
    found = index.where((F.col("status") == status) & F.col(sk_col).between(*sk_range)).select(*keys)
    return base.join(found, keys, "left_semi")


def select_sql(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A parameterised SELECT over named tables."""
    return spark.sql(sql, args=args or {}, **tables)


def access_parity(a: DataFrame, b: DataFrame, size: Column) -> DataFrame:
    """Rows and bytes by two ways of access, and whether they agree."""
    sums = lambda df, n: df.agg(F.count("*").alias(f"rows_{n}"), F.coalesce(F.sum(size), F.lit(0)).alias(f"bytes_{n}"))
    both = sums(a, "a").join(F.broadcast(sums(b, "b")), F.lit(True))
    return both.withColumn("same", (F.col("rows_a") == F.col("rows_b")) & (F.col("bytes_a") == F.col("bytes_b")))


def missing_keys(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    return expected.select(*on).join(actual, on, "left_anti")
