"""Typed documents without a schema: every attribute as it is, told apart by type, in one normal form.

A document is JSON text, each attribute an object of one type letter: S, N, B, BOOL, NULL, SS, NS, BS, L or M. Single attributes are reached
through VARIANT; the normal form and the size take a walk over the whole tree, which a small helper does for Arrow batches.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from decimal import Context, Decimal, InvalidOperation
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("S", "N", "B", "BOOL", "NULL", "SS", "NS", "BS", "L", "M")
#: Exponent beyond which a number is written with one; digits aren't bounded.
PLAIN_EXPONENT = 130
_EXACT = Context(prec=100_000)
#: Numbers as most are: no exponent, and not so long that they get one.
_PLAIN = re.compile(r"([+-]?)0*([0-9]{0,100})(?:\.([0-9]{0,100}))?", re.ASCII)
_ENCODER = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False)


def normal_number(text: str) -> tuple[str, int]:
    """(text without needless zeros, signs or exponent; encoded bytes) of a decimal number of any length."""
    plain = _PLAIN.fullmatch(text)
    if plain:
        sign, whole, fraction = plain.groups("")
        fraction = fraction.rstrip("0")
        kept = (whole + fraction).strip("0")
        if kept:
            point = len(whole) or len(fraction.lstrip("0")) - len(fraction)
            pairs = (len(kept) + point % 2 + 1) // 2
            minus = "-" if sign == "-" else ""
            shown = f"{whole or '0'}.{fraction}" if fraction else whole
            return minus + shown, pairs + 1 + (1 if minus and pairs < 20 else 0)
    sign, digits, exponent = _EXACT.create_decimal(text).as_tuple()
    if not isinstance(exponent, int):
        raise ValueError(f"not a number: {text!r}")
    figures = "".join(map(str, digits)).lstrip("0")
    kept = figures.rstrip("0")
    if not kept:
        return "0", 1
    exponent += len(figures) - len(kept)
    point = len(kept) + exponent  # digits before the decimal point
    pairs = (len(kept) + point % 2 + 1) // 2
    minus = "-" if sign else ""
    if abs(point) > PLAIN_EXPONENT:
        shown = f"{kept[0]}{'.' + kept[1:] if kept[1:] else ''}E{point - 1:+d}"
    elif exponent >= 0:
        shown = kept + "0" * exponent
    elif point > 0:
        shown = f"{kept[:point]}.{kept[point:]}"
    else:
        shown = f"0.{'0' * -point}{kept}"
    return minus + shown, pairs + 1 + (1 if sign and pairs < 20 else 0)


def _text(value: object) -> tuple[str, int]:
    if not isinstance(value, str):
        raise ValueError(f"not a text: {value!r}")
    return value, len(value.encode())


def _bytes(value: object) -> tuple[str, int]:
    raw = base64.b64decode(_text(value)[0], validate=True)
    return base64.b64encode(raw).decode(), len(raw)


#: Short numbers, which documents share.
_short_number = lru_cache(1 << 14)(normal_number)


def _number(value: object) -> tuple[str, int]:
    text, size = _text(value)
    return _short_number(text) if size <= 64 else normal_number(text)


_SCALARS = {"S": _text, "B": _bytes, "N": _number}


def normal_attribute(attribute: object) -> tuple[dict, int]:
    """(normal form, bytes) of one attribute: sets sorted and without repeats, numbers plain, names of maps sorted."""
    if not isinstance(attribute, dict) or len(attribute) != 1:
        raise ValueError(f"not an object of one type: {attribute!r}"[:200])
    (kind, value), = attribute.items()
    if kind in _SCALARS:
        shown, size = _SCALARS[kind](value)
        return {kind: shown}, size
    if kind in ("BOOL", "NULL"):
        if not isinstance(value, bool) or kind == "NULL" and not value:
            raise ValueError(f"not a {kind}: {value!r}")
        return {kind: value}, 1
    if kind in ("SS", "NS", "BS") and isinstance(value, list):
        members = dict(map(_SCALARS[kind[0]], value))
        order = Decimal if kind == "NS" else base64.b64decode if kind == "BS" else str.encode
        return {kind: sorted(members, key=order)}, sum(members.values())
    if kind == "L" and isinstance(value, list):
        parts = [normal_attribute(x) for x in value]
        return {kind: [p for p, _ in parts]}, sum(n for _, n in parts) + len(parts) + 3
    if kind == "M" and isinstance(value, dict):
        shown, size = normal_item(value)
        return {kind: shown}, size + len(value) + 3
    raise ValueError(f"not a {kind}: {value!r}"[:200])


def normal_item(item: object) -> tuple[dict, int]:
    """(normal form, bytes) of a document: its names and values."""
    if not isinstance(item, dict):
        raise ValueError("not an object")
    parts = {name: normal_attribute(item[name]) for name in sorted(item)}
    return {n: p for n, (p, _) in parts.items()}, sum(len(n.encode()) + size for n, (_, size) in parts.items())


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a name comes twice")
    return found


def _normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shown, sizes, errors = [], [], []
        for text in batch.column("__document").to_pylist():
            row: tuple = (None, None, None)
            if text is not None:
                try:
                    normal, size = normal_item(json.loads(text, object_pairs_hook=_once))
                    row = (_ENCODER.encode(normal), size, None)
                except (ValueError, InvalidOperation, binascii.Error, RecursionError) as e:
                    row = (None, None, f"{type(e).__name__}: {e}"[:300])
            for column, x in zip((shown, sizes, errors), row):
                column.append(x)
        yield pa.record_batch([batch.column("__row"), pa.array(shown, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["row", "document", "bytes", "error"])


def normal_documents(df: DataFrame, json_col: str = "document") -> DataFrame:
    """(row, document, bytes, error) of every row: its document in normal form and its size; row holds all of the row's columns.

    Two documents are equal in meaning just if their normal forms are equal texts, and a normal form is its own. Explicit nulls stay, absent
    attributes stay absent, and numbers keep all their digits. A document that isn't one gives an error and no form; a null one gives nulls.
    """
    rows = df.select(F.struct(*df.columns).alias("__row"), F.col(json_col).cast("string").alias("__document"))
    kind = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(_normalize, f"row {kind}, document string, bytes bigint, error string")


def _path(path: str) -> str:
    """A dotted attribute path as a path into the document."""
    names = path.split(".")
    return "$" + ".M".join(f"['{n}']" for n in names)


def attribute_kind(document: Column | str, path: str) -> Column:
    """Type letter of an attribute (a dotted path goes into maps), ABSENT where there is none; null for what isn't JSON."""
    doc = F.try_parse_json(F.col(document) if isinstance(document, str) else document)
    # The document is read once for all of an attribute's letters.
    letters = F.map_keys(F.try_variant_get(doc, _path(path), "map<string,variant>"))
    known = F.array_intersect(F.array(*[F.lit(t) for t in TYPES]), letters)
    return F.coalesce(F.get(known, F.lit(0)), F.when(doc.isNotNull(), "ABSENT"))


def attribute_value(document: Column | str, path: str, kind: str, to: str = "string") -> Column:
    """An attribute's value of one type, as a column of type ``to``; null if it has another type or isn't there."""
    doc = F.try_parse_json(F.col(document) if isinstance(document, str) else document)
    return F.try_variant_get(doc, f"{_path(path)}.{kind}", "string").try_cast(to)


def attribute_rows(df: DataFrame, keys: list[str], json_col: str = "document") -> DataFrame:
    """(keys, name, kind, value) of every top-level attribute; value is its JSON text. Documents without attributes have no rows."""
    spark = df.sparkSession
    rows = df.select(*keys, F.try_parse_json(F.col(json_col).cast("string")).alias("__v"))
    outer = spark.sql("SELECT d.*, a.key AS name, a.value AS __a FROM {d} d, LATERAL variant_explode(__v) a", d=rows)
    inner = spark.sql("SELECT d.*, t.key AS kind, to_json(t.value) AS value FROM {d} d, LATERAL variant_explode(__a) t", d=outer)
    return inner.select(*keys, "name", "kind", "value")


def assembled(attributes: DataFrame, keys: list[str], to: str = "document") -> DataFrame:
    """Documents of attribute rows, names in order; a document's attributes meet in one task, as a document does."""
    # {"n":"name"} becomes "name": that way JSON escapes it.
    name = F.to_json(F.struct(F.col("name").alias("n")))
    member = F.struct("name", F.concat(name.substr(F.lit(6), F.length(name) - 6), F.lit(':{"'), "kind", F.lit('":'), "value", F.lit("}")).alias("x"))
    named = F.array_sort(F.collect_list(member))["x"]
    return attributes.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(named, ","), F.lit("}")).alias(to))
