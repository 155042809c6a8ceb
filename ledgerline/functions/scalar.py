"""Column functions; each is one built-in expression tree, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_hex(c: Column | str) -> Column:
    """Lower hex SHA-256 of a text's UTF-8; null stays null."""
    return F.sha2(_c(c), 256)


def stable_id(c: Column | str) -> Column:
    """'' for a null or blank text, else the first 16 hex digits of its SHA-256."""
    c = _c(c)
    blank = c.isNull() | (F.length(F.trim(c)) == 0)
    return F.when(blank, F.lit("")).otherwise(F.substring(sha256_hex(c), 1, 16))


def md5_ok(body: Column | str, expected: Column | str) -> Column:
    """True where no checksum is given or it matches, whatever its case."""
    body, expected = _c(body), _c(expected)
    blank = expected.isNull() | (F.length(F.trim(expected)) == 0)
    return blank | (F.lower(expected) == F.md5(F.coalesce(body, F.lit("")).cast("binary")))


def csv_safe(c: Column | str) -> Column:
    """Null as '', and a quote before text that a spreadsheet would run as a formula, whatever white space leads it."""
    c = _c(c)
    risky = c.rlike(r"^\p{javaWhitespace}*+[=+\-@]|^[\t\r\n]")
    return F.when(c.isNull(), F.lit("")).when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def name_uuid(c: Column | str) -> Column:
    """Name-based (MD5, version 3) UUID of a text."""
    m = F.md5(_c(c).cast("binary"))
    part = lambda a, n: F.substring(m, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 2), 16, 10).cast("bigint").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def event_id(job: Column | str, key: Column | str) -> Column:
    return F.concat_ws(":", _c(job), _c(key))


def tenant(seq: Column | str, skewed: bool, tenants: int) -> Column:
    """Tenant name of a sequence number; eight of ten go to tenant 0 where skewed."""
    seq = _c(seq)
    bucket = F.pmod(seq, F.lit(tenants))
    if skewed:
        bucket = F.when(F.pmod(seq, F.lit(10)) < 8, F.lit(0)).otherwise(bucket)
    return F.concat(F.lit("tenant-"), F.lpad(bucket.cast("string"), 5, "0"))


def number_len(c: Column | str) -> Column:
    """Encoded bytes of a decimal number's text: one, a byte for each two digits as they stand around the decimal
    point, and one more for a negative number of fewer than 20 such pairs; 1 for zero."""
    text = F.lower(F.trim(_c(c).cast("string")))
    mantissa = F.regexp_replace(F.substring_index(text, "e", 1), r"[+-]", "")
    power = F.when(F.instr(text, "e") > 0, F.substring_index(text, "e", -1).try_cast("int")).otherwise(F.lit(0))
    shown = F.regexp_replace(mantissa, r"[^0-9]", "")
    behind = F.when(F.instr(mantissa, ".") > 0, F.length(F.substring_index(mantissa, ".", -1))).otherwise(0)
    led = F.regexp_replace(shown, r"^0+", "")
    precision = F.length(F.regexp_replace(led, r"0+$", ""))
    # Digits pair up from the decimal point, so an odd distance to it takes half a byte more.
    odd = F.pmod(F.length(led) + power - behind, F.lit(2))
    pairs = F.floor((precision + odd + 1) / 2)
    negative = F.when(text.startswith("-") & (pairs < 20), 1).otherwise(0)
    return F.when(precision == 0, 1).otherwise(pairs + 1 + negative).cast("bigint")


def _summed(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _field_size(c: Column, kind: T.DataType, name: str, numbers, sets: tuple[str, ...]) -> Column:
    if isinstance(kind, (T.BooleanType, T.NullType)):
        size = F.lit(1)
    elif isinstance(kind, T.BinaryType):
        size = F.length(c)
    elif isinstance(kind, T.StringType):
        size = F.octet_length(c)
    elif isinstance(kind, T.NumericType):
        size = numbers(c)
    elif isinstance(kind, T.ArrayType):
        size = _summed(F.transform(c, lambda x: _field_size(x, kind.elementType, f"{name}[]", numbers, sets).cast("bigint")))
        if name not in sets:
            size = size + F.size(c) + 3
    elif isinstance(kind, T.StructType):
        parts = [
            F.when(c[f.name].isNotNull(), _field_size(c[f.name], f.dataType, f"{name}.{f.name}", numbers, sets) + len(f.name.encode()) + 1).otherwise(0)
            for f in kind.fields
        ]
        size = sum(parts, F.lit(0)) + 3
    else:
        size = F.octet_length(c.cast("string"))
    return F.when(c.isNull(), F.lit(1)).otherwise(size).cast("bigint")


def item_size(schema: T.StructType, numbers=number_len, sets: tuple[str, ...] = ()) -> Column:
    """Bytes of an item: names and values of the attributes that are present.

    A list or a structure adds three bytes, and one for each of its members; a set adds nothing. ``sets`` names the arrays
    that are sets, with dots into structures.
    """
    parts = [F.when(F.col(f.name).isNotNull(), _field_size(F.col(f.name), f.dataType, f.name, numbers, sets) + len(f.name.encode())).otherwise(0) for f in schema.fields]
    return sum(parts, F.lit(0)).cast("bigint")


def estimated_bytes(schema: T.StructType, sets: tuple[str, ...] = ()) -> Column:
    """item_size with a number counted as the length of its text."""
    return item_size(schema, lambda c: F.octet_length(c.cast("string")), sets)


def receive_count(c: Column | str) -> Column:
    """Deliveries of a message: 1 where blank, at least 1; text that is no number is an error."""
    c = _c(c)
    blank = c.isNull() | (F.length(F.trim(c)) == 0)
    return F.when(blank, F.lit(1)).otherwise(F.greatest(F.lit(1), F.trim(c).cast("int")))


def lease_valid(receipt: Column | str, until: Column | str, now: Column, reserve: int = 0) -> Column:
    receipt = _c(receipt)
    return F.coalesce((F.length(F.trim(receipt)) > 0) & (_c(until) > now + F.lit(reserve)), F.lit(False))


def normalize_principal(c: Column | str) -> Column:
    """The stable role, with its path, of an assumed-role session name; others stay, and null is ''."""
    role = F.regexp_replace(_c(c), r"(?s)^([^:]*):([^:]*):sts:[^:]*:([^:]*):assumed-role/(.+)/[^/]*$", "$1:$2:iam::$3:role/$4")
    return F.coalesce(role, F.lit(""))


def encode_attributes(c: Column | str) -> Column:
    """Message attributes as map of (type, string, binary in base64)."""
    return F.transform_values(
        _c(c), lambda k, v: F.struct(v["type"].alias("type"), v["string"].alias("string"), F.base64(v["binary"]).alias("binary"))
    )


def decode_attributes(c: Column | str) -> Column:
    return F.transform_values(
        _c(c), lambda k, v: F.struct(v["type"].alias("type"), v["string"].alias("string"), F.unbase64(v["binary"]).alias("binary"))
    )


def json_event(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def epoch_to_ts(c: Column | str) -> Column:
    return F.timestamp_seconds(_c(c))


def last_state(history: Column | str) -> Column:
    """State of the last entry of a history (state, at); null for an empty or null one."""
    return F.try_element_at(_c(history), F.lit(-1))["state"]


def pct_delta(new: Column | str, old: Column | str) -> Column:
    """(new / old - 1) * 100, 0 where old is 0."""
    new, old = _c(new), _c(old)
    return F.when(old == 0, F.lit(0.0)).otherwise((new / old - 1) * 100)


def classify_delta(delta: Column | str, threshold: float = 5.0, higher_is_better: bool | Column = True) -> Column:
    delta = _c(delta)
    better = higher_is_better if isinstance(higher_is_better, Column) else F.lit(higher_is_better)
    gain = F.when(better, delta).otherwise(-delta)
    return F.when(delta.isNull(), F.lit("BASELINE")).when(gain > threshold, F.lit("IMPROVEMENT")).when(gain < -threshold, F.lit("REGRESSION")).otherwise(F.lit("NEUTRAL"))


def rank_percentile(c: str, q: float) -> Column:
    """Nearest-rank percentile (aggregate) of a named column: the value at ceil(q * n).

    It gathers the group's distinct values; metrics.nearest_ranks() doesn't.
    """
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{c}`)")


def rounded_percentile(values: Column, p: float) -> Column:
    """Value at round((n - 1) * p), half to even, of an array of values."""
    s = F.sort_array(values)
    return F.element_at(s, (F.bround((F.size(s) - 1) * F.lit(p)) + 1).cast("int"))
