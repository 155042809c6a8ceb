"""Documents without a schema: normal forms, sizes, kinds and round trips."""

import json
import random

from pyspark.sql import functions as F

from ledgerline.functions.scalar import number_len
from ledgerline import queries
from ledgerline.sources import documents as dc


def test_numbers():
    cases = {"0": "0", "-0.00": "0", "007": "7", "+1.50": "1.5", "1e3": "1000", "1E-3": "0.001", "-12.340e1": "-123.4", "0.000": "0", "9" * 50: "9" * 50, "1e200": "1E+200", "-2.5e-200": "-2.5E-200", ".5": "0.5"}
    assert {k: dc.normal_number(k)[0] for k in cases} == cases
    for bad in ("", "x", "1.2.3", "NaN", "Infinity", "1 2"):
        try:
            dc.normal_number(bad)
            raise AssertionError(bad)
        except (ValueError, ArithmeticError):
            pass


def test_plain_numbers_are_read_as_others(monkeypatch):
    r = random.Random(5)
    texts = ["0", "-0", "+", ".", "-.", "5.", "-.50", "00.00100", "100", "0100.0100", "-0099.9900", "1_0", " 7", "\u0663", "1" * 101, "0." + "0" * 99 + "1", "0." + "0" * 140 + "1"]
    texts += [f"{r.choice(['', '-', '+'])}{'0' * r.randrange(3)}{r.randrange(10 ** r.randrange(1, 45))}{r.choice(['', '.', '.0', f'.{r.randrange(10**9):09d}00'])}" for _ in range(500)]

    def seen(text):
        try:
            return dc.normal_number(text)
        except (ValueError, ArithmeticError):
            return "error"

    fast = [seen(t) for t in texts]
    monkeypatch.setattr(dc, "_PLAIN", __import__("re").compile("(?!)"))
    assert fast == [seen(t) for t in texts]


def test_a_kind_takes_one_reading(spark):
    """An attribute's letter comes from one look into the document, not from one for every letter."""
    df = spark.createDataFrame([('{"a":{"N":"1","S":"x"},"b":{"Q":1},"c":7,"d":{"NULL":null},"e":{}}',)], "d string")
    out = df.select(*[dc.attribute_kind("d", n).alias(n) for n in "abcde"])
    assert out.first().asDict() == {"a": "S", "b": "ABSENT", "c": "ABSENT", "d": "NULL", "e": "ABSENT"}
    plan = df.select(dc.attribute_kind("d", "a").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get") == 1


def test_number_sizes_equal_the_column_function(spark):
    r = random.Random(2)
    texts = ["0", "-1", "10", "100", "1.5", "-0.05", "1e10", "12345678901234567890", "-" + "9" * 45] + [f"{r.choice(['', '-'])}{r.randrange(10**r.randrange(1, 30))}.{r.randrange(10**r.randrange(1, 9))}" for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", number_len("t").alias("n")).collect()
    assert {x["t"]: x["n"] for x in got} == {t: dc.normal_number(t)[1] for t in texts}


ITEM = {
    "pk": {"S": "é"}, "n": {"N": "1.50"}, "b": {"B": "YWI="}, "t": {"BOOL": True}, "nil": {"NULL": True}, "ss": {"SS": ["b", "a"]}, "ns": {"NS": ["10", "9.0"]}, "bs": {"BS": ["YmI=", "YQ=="]},
    "l": {"L": [{"S": "x"}, {"L": []}, {"M": {}}]}, "m": {"M": {"k": {"M": {"j": {"N": "3"}}}}},
}


def test_sizes():
    normal, size = dc.normal_item(ITEM)
    names = sum(len(n) for n in ITEM)
    values = 2 + 3 + 2 + 1 + 1 + 2 + (2 + 2) + 3 + (1 + 3 + 3 + 3 + 3) + (1 + (1 + 2 + 1 + 3) + 1 + 3)
    assert size == names + values
    assert normal["ns"] == {"NS": ["9", "10"]} and normal["bs"] == {"BS": ["YQ==", "YmI="]} and normal["n"] == {"N": "1.5"} and list(normal) == sorted(ITEM)


def test_rows_and_errors(spark):
    deep = {"L": [{"S": "x"}]}
    for _ in range(3000):
        deep = {"L": [deep]}
    texts = [json.dumps(ITEM), None, "", "[]", "not json", '{"a":{"S":1}}', '{"a":{}}', '{"a":{"S":"x","N":"1"}}', '{"a":{"Q":"x"}}', '{"a":{"NULL":false}}', '{"a":{"B":"***"}}', '{"a":{"S":"x"},"a":{"S":"y"}}', '{"a":{"NS":["1","1.0"]}}', "{}"]
    df = spark.createDataFrame([(i, t, 5, "e") for i, t in enumerate(texts)], "id long, document string, bytes int, error string")
    out = {r["row"]["id"]: r for r in dc.normal_documents(df).collect()}
    assert len(out) == len(texts) and out[0]["row"]["bytes"] == 5
    assert [i for i, r in out.items() if r["error"]] == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert out[1]["document"] is None and out[1]["bytes"] is None and out[12]["document"] == '{"a":{"NS":["1"]}}' and (out[13]["document"], out[13]["bytes"]) == ("{}", 0)
    # A normal form is its own.
    again = dc.normal_documents(spark.createDataFrame([(out[0]["document"],)], "document string")).first()
    assert (again["document"], again["bytes"]) == (out[0]["document"], out[0]["bytes"])


def test_kinds_and_values(spark):
    df = spark.createDataFrame([(json.dumps(ITEM),), ("not json",), (None,)], "d string")
    row = df.select(*[dc.attribute_kind("d", p).alias(p.replace(".", "_")) for p in ("pk", "nil", "ss", "m.k", "m.k.j", "none", "m.none", "pk.x")], dc.attribute_value("d", "n", "N", "decimal(9,2)").alias("v"), dc.attribute_value("d", "n", "S").alias("w")).collect()
    assert [str(x) for x in row[0]] == ["S", "NULL", "SS", "M", "N", "ABSENT", "ABSENT", "ABSENT", "1.50", "None"]
    assert row[1]["pk"] is None and row[2]["nil"] is None


def test_round_trip(spark):
    texts = [json.dumps(ITEM), '{"quote\\"d":{"S":"a\\u0000b\\n"},"ü":{"M":{"x y":{"S":"{}"}}}}', '{"a":{"N":"1"}}']
    df = dc.normal_documents(spark.createDataFrame(list(enumerate(texts)), "id long, document string")).select("row.id", "document")
    attributes = dc.attribute_rows(df, ["id"])
    assert attributes.where("id = 0").count() == len(ITEM)
    back = dc.normal_documents(dc.assembled(attributes, ["id"])).select(F.col("row.id").alias("id"), F.col("document").alias("again"))
    assert all(r["document"] == r["again"] for r in df.join(back, "id").collect()) and back.count() == 3


def test_the_round_trip_makes_a_normal_form_once(spark):
    plan = queries.document_round_trip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan
