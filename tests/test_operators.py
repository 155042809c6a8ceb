"""Operators on small tables: limits, errors, ties and empty inputs."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import ordered, scalar
from ledgerline.operators import access, ledger, metrics, mutate, planning, quality, segments
from ledgerline.plans.rules import Request, process_batches, run_job
from ledgerline.sources import items as src
from ledgerline.sources import sinks

ITEM = "record_key string, status string, version bigint"


@pytest.fixture
def items(spark):
    return spark.createDataFrame([("a", "PENDING", 1), ("b", "PENDING", 2), ("c", "SETTLED", 1), ("d", "PENDING", 5)], ITEM)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_numbering_and_sums_equal_a_global_window(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("k"), (F.col("id") % 7).alias("v")).repartition(9)
    got = ordered.prefix_sums(df, ["k"], s=F.col("v"), n=F.lit(1)).orderBy("k").collect()
    total = 0
    for i, r in enumerate(got, 1):
        total += r["v"]
        assert (r["s"], r["n"]) == (total, i)
    assert ordered.dense_sequence(df.limit(0), ["k"]).collect() == []


def test_masking_and_formulas(spark):
    df = spark.createDataFrame([("x",), (None,), (" ",), ("=1+1",), ("  @a",), ("\tq",), ("-1",), ('a,"b"\n',), (" \t=1",), ("\x0b+1",), ("\xa0=1",)], "t string")
    got = [tuple(r) for r in df.select(scalar.stable_id("t"), scalar.csv_safe("t")).collect()]
    assert got[0] == ("2d711642b726b044", "x") and got[1] == ("", "") and got[2][0] == ""
    assert [g[1] for g in got[3:]] == ["'=1+1", "'  @a", "'\tq", "'-1", 'a,"b"\n', "' \t=1", "'\x0b+1", "\xa0=1"]


def test_message_functions(spark):
    df = spark.createDataFrame([("b", "92EB5FFEE6AE2FEC3AD71C777531578F", "3"), ("b", "", " "), ("b", "00", None), (None, None, "0")], "body string, md5 string, n string")
    assert [tuple(r) for r in df.select(scalar.md5_ok("body", "md5"), scalar.receive_count("n")).collect()] == [(True, 3), (True, 1), (False, 1), (True, 1)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("x",)], "n string").select(scalar.receive_count("n")).collect()


def test_attribute_codec_round_trip(spark):
    df = spark.sql("select map('k', named_struct('type', 'Binary', 'string', cast(null as string), 'binary', cast('hi' as binary))) as m")
    back = df.select(scalar.decode_attributes(scalar.encode_attributes("m")).alias("m")).first()["m"]["k"]
    assert bytes(back["binary"]) == b"hi" and back["type"] == "Binary"


def test_item_sizes(spark):
    df = spark.createDataFrame([("é", 120, True, ["a", "bb"], ("x", None))], "s string, n bigint, b boolean, l array<string>, m struct<p:string,q:string>")
    size = df.select(scalar.estimated_bytes(df.schema)).first()[0]
    assert size == (1 + 2) + (1 + 3) + (1 + 1) + (1 + 3 + 2 + 3) + (1 + 1 + 1 + 1 + 3)
    assert df.select(scalar.estimated_bytes(df.schema, sets=("l",))).first()[0] == size - 5
    numbers = ["0", "120", "-120", "0.00123", "1E+10", "-" + "7" * 38, "-" + "7" * 37, "100", "99"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "n string").select(scalar.number_len("n")).collect()] == [1, 3, 4, 3, 2, 21, 21, 2, 2]


def test_attribute_states_and_types(spark):
    df = spark.createDataFrame([('{"a": null}',), ("{}",), ('{"a": 1}',), ('{"a": "1"}',), ("not json",), (None,)], "doc string")
    assert [r[0] for r in df.select(access.attr_state("doc", "a")).collect()] == ["NULL", "ABSENT", "VALUE", "VALUE", "ABSENT", "ABSENT"]
    right, wrong = access.require_type(df, "doc", "a", "N", strict=False)
    assert rows(wrong) == [('{"a": "1"}',)] and right.count() == 5
    with pytest.raises(Exception, match="is not of type"):
        access.require_type(df, "doc", "a", "N").collect()


def test_keys_and_limits_are_errors(spark, items):
    with pytest.raises(Exception, match="blank record_key"):
        access.require_key(spark.createDataFrame([(" ",)], "record_key string"), "record_key").collect()
    with pytest.raises(Exception, match="too long"):
        access.enforce_limits(spark.createDataFrame([("k" * 2049, "p")], "record_key string, payload string")).collect()
    with pytest.raises(Exception, match="missing or negative"):
        mutate.version_guard(spark.createDataFrame([(None,)], "version bigint")).collect()
    with pytest.raises(ValueError):
        segments.segment_of("k", 0)


def test_typed_items_keep_their_types(spark):
    doc = '{"id": {"S": "x"}, "n": {"N": "12.50"}, "big": {"N": "1e400"}, "tags": {"SS": ["b", "a", "b"]}, "raw": {"B": "aGk="}, "ok": {"BOOL": true}, "gone": {"NULL": true}, "m": {"M": {"p": {"S": "q"}}}}'
    schema = spark.createDataFrame([], "id string, n decimal(10,2), big decimal(38,0), tags array<string>, raw binary, ok boolean, gone string, m struct<p:string>").schema
    r = src.parse_typed_items(spark.createDataFrame([(doc,)], "doc string"), "doc", schema).first()
    assert (r["id"], str(r["n"]), r["big"], r["tags"], bytes(r["raw"]), r["ok"], r["gone"], r["m"]["p"], r["bad_numbers"]) == ("x", "12.50", None, ["a", "b"], b"hi", True, None, "q", ["big"])


def test_generated_items_and_needles(spark):
    df = src.generate_items(spark, 500, "hot-key")
    assert df.where("pk = 'tenant-00000'").count() >= 400
    assert rows(quality.check_generated(df, "hot-key", 500).select("different")) == [(0,)]
    changed = df.withColumn("amount", F.when(F.col("sk") == "record-000000000007", -1).otherwise(F.col("amount")))
    assert quality.check_generated(changed, "hot-key", 500).first()["different"] == 2
    needle = F.col("incident.correlationId") == src.NEEDLE
    counts = quality.needle_counts(df.withColumn("n", F.substring("sk", 8, 12).cast("bigint")), "n", needle)
    assert tuple(counts.first()) == (1, 1, 0)
    with pytest.raises(Exception, match="not 3 rows"):
        quality.check_cardinality(df, 3).collect()


def test_scan_resume_reads_every_row_once(spark):
    df = segments.with_segment(spark.range(1000).select(F.format_string("k%05d", "id").alias("k")), "k", 4)
    paged = segments.with_page(df, 10, "k")
    first, left = segments.page_budget(paged, 20), segments.resume_after(paged, segments.segment_cursors(paged, 20, "k"), "k")
    assert first.count() + left.count() == 1000 and first.join(left, "k").count() == 0
    cursors = spark.createDataFrame([(0, "x", True)], "segment int, cursor string, completed boolean")
    with pytest.raises(Exception, match="another scan"):
        segments.validate_cursors(cursors).collect()


def test_resume_totals(spark):
    c = spark.createDataFrame([(2, 5, 1, 9, True, 1.0, True), (3, 5, 2, 9, True, 2.0, False)], "pages int, examined int, returned int, bytes int, completed boolean, elapsed double, history_complete boolean")
    assert tuple(segments.resume_totals(c, 10).first()) == (5, 10, 3, 18, True, None)
    with pytest.raises(Exception, match="whole scan"):
        segments.resume_totals(c, 11).collect()


def test_keyset_pages_of_the_golden_ledger(spark):
    t = spark.createDataFrame([("j", 1, "k1", "DONE", "FAILED"), ("j", 2, "k2", "DONE", "CONFLICT"), ("j", 3, "k3", "DONE", "OK"), ("j", 4, "k4", "DONE", "ERROR")], "job string, seq bigint, record_key string, state string, outcome string")
    assert rows(ledger.error_conflict_counts(t)) == [("j", 4, 2, 1)]
    one = ledger.error_page(t, 0, 2).orderBy("seq").collect()
    assert [r["seq"] for r in one] == [1, 2] and one[0]["has_more"] and one[0]["next_after"] == 2
    two = ledger.error_page(t, 2, 2).collect()
    assert [r["seq"] for r in two] == [4] and not two[0]["has_more"]


def test_budgets(spark):
    pages = spark.createDataFrame([(i, i // 10) for i in range(45)], "record_key int, page_no int")
    assert planning.record_budget(pages, 25).count() == 20
    assert planning.record_budget(pages.union(pages.limit(0)), 45).count() == 45
    usage = spark.createDataFrame([(i, 10, 1.0) for i in range(5)], "page_no int, scanned bigint, capacity double")
    got = [(r["page_no"], r["committed"]) for r in planning.read_budget(usage, 25, 99.0).orderBy("page_no").collect()]
    assert got == [(0, True), (1, True), (2, False)]
    tasks = spark.createDataFrame([(i, "ERROR" if i in (3, 5) else "OK") for i in range(1, 9)], "seq bigint, outcome string")
    states = [r["state"] for r in planning.apply_error_budget(tasks, 9, 1, 1.0, 99).orderBy("seq").collect()]
    assert states == ["DONE"] * 5 + ["PLANNED"] * 3
    assert {r["state"] for r in planning.apply_error_budget(tasks, 9, 9, 1.0, 99).collect()} == {"DONE"}


def test_seal_binds_every_field(spark):
    df = spark.createDataFrame([("a", "1"), ("b", None)], "record_key string, payload string")
    base = planning.seal_plan(df, "r", "v", "i").first()["hash"]
    others = [planning.seal_plan(df, "r", "v2", "i"), planning.seal_plan(df.where("record_key = 'a'"), "r", "v", "i"), planning.seal_plan(df.withColumn("payload", F.lit("2")), "r", "v", "i")]
    assert base not in {o.first()["hash"] for o in others} and planning.verify_plan(df.orderBy(F.desc("record_key")), base, "r", "v", "i").first()["approved"]


def test_conditional_changes(spark, items):
    ch = spark.createDataFrame([("a", 1, "PENDING", "SETTLED"), ("b", 1, "PENDING", "SETTLED"), ("z", 1, "PENDING", "SETTLED")], "record_key string, expected_version bigint, expected_status string, new_status string")
    new, out = mutate.conditional_update(items, ch)
    assert rows(out) == [("a", "UPDATED"), ("b", "CONFLICT"), ("z", "CONFLICT")] and ("a", "SETTLED", 2) in rows(new) and new.count() == 4
    with pytest.raises(Exception, match="two changes"):
        mutate.unique_changes(ch.union(ch)).collect()
    new, out = mutate.conditional_put(items, spark.createDataFrame([("a", "PENDING", 1), ("n", "PENDING", 1)], ITEM))
    assert rows(out) == [("a", "CONFLICT"), ("n", "CREATED")] and new.count() == 5
    new, out = mutate.conditional_delete(items, spark.createDataFrame([("a", 1), ("b", 9)], "record_key string, expected_version bigint"))
    assert rows(out) == [("a", "DELETED"), ("b", "CONFLICT")] and new.count() == 3


def test_transactions_are_all_or_nothing(spark, items):
    a = spark.createDataFrame([("t1", "a", "update", 1, "MATCH"), ("t1", "n", "put", None, "NEW"), ("t2", "b", "delete", 2, None), ("t2", "c", "check", 9, None), ("t3", "c", "delete", 1, None)], "txn string, record_key string, kind string, expected_version bigint, new_status string")
    new, out = mutate.transact(items, a)
    assert rows(out) == [("t1", "COMMITTED", 2), ("t2", "CANCELLED", 2), ("t3", "COMMITTED", 1)]
    assert rows(new) == [("a", "MATCH", 2), ("b", "PENDING", 2), ("d", "PENDING", 5), ("n", "NEW", 1)]
    with pytest.raises(Exception, match="not a valid group"):
        mutate.transact(items, a.union(a.where("txn = 't1'")))[1].collect()


def test_last_put_wins_and_the_rest_comes_back(spark, items):
    ch = spark.createDataFrame([("a", "put", 1, "X", 7), ("a", "put", 2, "Y", 8), ("b", "delete", 3, None, None), ("q", "put", 26, "Z", 1)], "record_key string, kind string, position int, status string, version bigint")
    new, rest = mutate.batch_put_delete(items, ch)
    assert rows(new) == [("a", "Y", 8), ("c", "SETTLED", 1), ("d", "PENDING", 5)] and rest.count() == 1


def test_repair_then_compensate_restores_the_status(spark, items):
    conf = spark.createDataFrame([("a", "SETTLED", 1), ("b", "PENDING", 1), ("d", "SETTLED", -1)], "reference string, status string, version bigint")
    new, out = mutate.repair(items, conf, "j1")
    assert rows(out.select("record_key", "outcome")) == [("a", "REPAIRED"), ("b", "SKIPPED"), ("d", "REJECTED")]
    planned = new.where("opsMarker is not null").select("record_key", "version", "opsMarker", "opsPreviousStatus")
    back, done = mutate.compensate(new, planned, "j1", "j2")
    assert rows(done) == [("a", "COMPENSATED_DATA_ONLY")] and rows(back.select(*items.columns)) == [("a", "PENDING", 3), ("b", "PENDING", 2), ("c", "SETTLED", 1), ("d", "PENDING", 5)]
    events = mutate.build_outbox(out, "j1")
    assert events.count() == 1 and mutate.build_outbox(out, "j1", events).count() == 0


def test_compensation_guards(spark):
    kind = "record_key string, status string, version bigint, opsMarker string, opsPreviousStatus string"
    items = spark.createDataFrame([("a", "SETTLED", 2, "j1:a", "PENDING"), ("b", "SETTLED", 3, "j1:b", "PENDING")], kind)
    gone = spark.createDataFrame([("z", "SETTLED", 2, "j1:z", "PENDING")], kind)
    # Changed since, gone, and another job's: no candidate.
    planned = items.withColumn("version", F.lit(2)).union(gone).union(spark.createDataFrame([("q", "SETTLED", 2, "j3:q", "MATCH")], kind))
    new, out = mutate.compensate(items, planned, "j1", "j2")
    assert rows(out) == [("a", "COMPENSATED_DATA_ONLY"), ("b", "CONFLICT"), ("z", "CONFLICT")]
    assert rows(new) == [("a", "PENDING", 3, "j2:a", None), ("b", "SETTLED", 3, "j1:b", "PENDING")]
    for bad in ({"opsPreviousStatus": F.lit(None).cast("string")}, {"opsPreviousStatus": F.lit("MATCH")}, {"version": F.lit(0)}, {"version": F.lit(None).cast("bigint")}):
        with pytest.raises(Exception, match="pre-image"):
            mutate.compensate(items, items.withColumns(bad), "j1", "j2")[0].collect()


def test_validation_verdicts_and_planned_versions(spark, items):
    conf = spark.createDataFrame([(k, "SETTLED", 1) for k in "abd"], "reference string, status string, version bigint")
    said = spark.createDataFrame([("a", "FUNCTION_ERROR"), ("b", "BUSINESS_REJECTED"), ("d", "ACCEPTED")], "record_key string, verdict string")
    new, out = mutate.repair(items, conf, "j1", validations=said)
    assert rows(out.select("record_key", "outcome")) == [("a", "FUNCTION_ERROR"), ("b", "BUSINESS_REJECTED"), ("d", "REPAIRED")]
    assert new.where("status = 'SETTLED'").count() == 4
    with pytest.raises(Exception, match="missing or negative"):
        mutate.repair(items.withColumn("version", F.lit(None).cast("bigint")), conf, "j1")[1].collect()


def test_run_states(spark):
    kind = "run string, attempts int, elapsed double, valid boolean"
    primary = spark.createDataFrame([("tie", 2, 5.0, True), ("behind", 1, 9.0, True), ("corrupt", 9, 9.0, False), ("both", 1, 1.0, False), ("alone", 3, 1.0, True)], kind)
    backup = spark.createDataFrame([("tie", 2, 5.0, True), ("behind", 2, 0.0, True), ("corrupt", 1, 2.0, True), ("both", 1, 1.0, False)], kind)
    runs = spark.createDataFrame([(x,) for x in ("tie", "behind", "corrupt", "both", "alone", "new")], "run string")
    got = {r["run"]: tuple(r)[1:] for r in segments.merge_run_state(primary, backup, runs).collect()}
    assert got == {"tie": ("PRIMARY", 2, 5.0, True), "behind": ("BACKUP", 2, 0.0, False), "corrupt": ("BACKUP", 1, 2.0, False), "both": ("LOST", 0, 0.0, False), "alone": ("PRIMARY", 3, 1.0, True), "new": ("NONE", 0, 0.0, True)}


def test_resources(spark):
    names = ["arn:aws:sqs:eu-1:111111111111:q", "arn:aws:sqs:us-1:111111111111:q", "arn:aws:sqs:eu-1:222222222222:q", "arn:aws:s3:::bucket", "arn:aws:s3", "https://sqs.example/111111111111/q", "https://sqs.example/222222222222/q", "table", "unknown"]
    df = spark.createDataFrame([(x,) for x in names], "resource string")
    got = access.resource_guard(df, df.where("resource <> 'unknown'"), account="111111111111", region="eu-1")
    assert sorted(r[0] for r in got.collect()) == sorted([names[1], names[2], names[4], names[6], "unknown"])
    principals = ["arn:aws:sts::1:assumed-role/ops/s", "arn:aws:sts::1:assumed-role/path/ops/s", "arn:aws:iam::1:role/x", "arn:aws:sts::1:assumed-role/s", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in principals], "p string").select(scalar.normalize_principal("p")).collect()]
    assert got == ["arn:aws:iam::1:role/ops", "arn:aws:iam::1:role/path/ops", principals[2], principals[3], ""]


def test_call_attempts(spark):
    log = spark.createDataFrame([("a", i, c, w) for i, (c, w) in enumerate([(503, 0), (429, 5), (503, None)])] + [("b", 1, 429, 99), ("b", 2, 200, None)], "call string, at int, status_code int, retry_after int")
    got = mutate.classify_calls(log, "call", ["at"], 3, 60)
    assert sorted((r["call"], r["attempt"], r["outcome"]) for r in got.collect()) == [("a", 1, "RETRY"), ("a", 2, "RETRY"), ("a", 3, "PAUSED"), ("b", 1, "PAUSED"), ("b", 2, "OK")]


def test_places_of_sorted_groups(spark):
    values = [("a", x % 7, x) for x in range(53)] + [("b", 3, 1), ("b", None, 2), (None, 2, 5), (None, 1, 6)]
    df = spark.createDataFrame(values, "g string, v int, w int")
    got = {r["g"]: r for r in metrics.nearest_ranks(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}).collect()}
    for g in ("a", "b", None):
        s = sorted(v for h, v, _ in values if h == g and v is not None)
        want = [s[max(0, -int(-q * len(s) // 1) - 1)] for q in (0.0, 0.5, 0.99)]
        assert [got[g][c] for c in ("p0", "p50", "p99")] == want and got[g]["n"] == len(s)
    plan = metrics.repeat_summary(df, ["g"], "v", "w")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert metrics.nearest_ranks(df.limit(0), ["g"], "v", {"p": 0.5}).collect() == []


def test_numbering_shuffles_rows_once(spark):
    made = []
    stable, ordered_stable = ordered.stable, lambda df: (made.append(df._jdf.queryExecution().executedPlan().toString()), stable(df))[1]
    ordered.stable = ordered_stable
    try:
        df = spark.range(100).select(F.col("id").alias("k"), F.lit(2).alias("v"))
        last = ordered.prefix_sums(df, ["k"], s=F.col("v"), x=F.col("v") / 4).orderBy(F.desc("k")).first()
        assert (last["s"], last["x"]) == (200, 50.0)
        out = ordered.dense_sequence(df, ["k"])
        assert out.agg(F.max("seq"), F.count_distinct("seq")).first() == (100, 100)
    finally:
        ordered.stable = stable
    assert [p.count("Exchange") for p in made] == [1, 1]
    after = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in after and "LogicalRDD" in after


def test_chunks_and_probes_that_are_wrong(spark):
    chunks = spark.createDataFrame([("j", 10), ("j", 20), ("j", 25)], "job string, cursor bigint")
    assert planning.check_contiguity(chunks, 25, 10).count() == 3
    with pytest.raises(Exception, match="doesn't follow"):
        planning.check_contiguity(chunks.where("cursor <> 20"), 25, 10).collect()
    with pytest.raises(Exception, match="isn't there just once"):
        quality.probe_first_last(chunks, "cursor", 10, 99).collect()


def test_dry_run_shows_samples_and_risks(spark, items):
    row = planning.dry_run_summary(access.select_pending(items), 10, "repair", sample=2, resources=("t",)).first()
    assert (row["located"], row["candidates"], row["ignored"], row["estimated_calls"]) == (10, 3, 7, 27)
    assert [x["action"] for x in row["samples"]] == ["UPDATE"] * 2 and "a" not in {x["record"] for x in row["samples"]}
    assert list(row["risks"]) == list(planning.RISKS["repair"]) and list(row["resources"]) == ["t"]
    none = planning.dry_run_summary(access.select_pending(items).limit(0), 0, "inventory").first()
    assert (none["located"], none["candidates"], list(none["samples"]), list(none["risks"])) == (0, 0, [], [])


def test_batches_of_batches(spark, items):
    ch = spark.createDataFrame([("a", "put", 2, 1, "X", 7), ("a", "put", 1, 9, "Y", 8), ("b", "put", 1, 26, "Z", 1)], "record_key string, kind string, batch int, position int, status string, version bigint")
    new, rest = mutate.batch_put_delete(items, ch)
    assert ("a", "X", 7) in rows(new) and [r["record_key"] for r in rest.collect()] == ["b"]


def test_histories(spark):
    df = src.generate_items(spark, 3).where("sk <> 'record-000000000001'")
    assert rows(src.history_rows(df, ["sk"]).select("sk", "place", "state")) == [("record-000000000000", 0, "CREATED"), ("record-000000000000", 1, "MATCH"), ("record-000000000002", 0, "CREATED"), ("record-000000000002", 1, "PENDING")]
    assert rows(df.select(scalar.last_state("history"))) == [("MATCH",), ("PENDING",)]
    assert spark.sql("select array() as h").select(F.col("h").cast("array<struct<state:string,at:bigint>>").alias("h")).select(scalar.last_state("h")).first()[0] is None


def test_reconciliation(spark):
    e = spark.createDataFrame([("j", 1, "s", "INTENT"), ("j", 2, "s", "UNKNOWN"), ("j", 3, "s", "INTENT"), ("j", 4, "s", "SUCCEEDED")], "job string, task int, step string, state string")
    seen = spark.createDataFrame([("j", 1, "s", True), ("j", 2, "s", False)], "job string, task int, step string, found boolean")
    assert [r["reconciled"] for r in mutate.reconcile_effects(e, seen).orderBy("task").collect()] == ["SUCCEEDED", "NOT_SENT", "RECONCILIATION_REQUIRED", "SUCCEEDED"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\n', None, "=1+1"), (2, "x", "S", "")], "sequence int, record string, state string, outcome string").coalesce(1)
    sinks.write_report_csv(df, str(tmp_path / "r"), columns="record,state,outcome")
    text = next((tmp_path / "r").glob("part-*.csv")).read_bytes()
    assert text == b'"record","state","outcome"\r\n"a,""b""\r\n","","\'=1+1"\r\n"x","S",""\r\n'
    for bad in ("", "record,record", "payload"):
        with pytest.raises(ValueError):
            sinks.select_columns(df, bad)


def test_files_of_chunks_grow_with_rows(spark, tmp_path):
    """A thousand pages don't make a thousand folders; a write that isn't whole isn't seen."""
    df = spark.range(1, 10_001).select(F.col("id").alias("seq"), F.lit("x").alias("v"))
    sinks.write_chunks(df, f"{tmp_path}/c", 10)
    assert len(list((tmp_path / "c").rglob("*.parquet"))) < 100
    again = df.where("(seq - 1) div 10 % 2 = 0").withColumn("v", F.lit("y"))
    again.withColumn("chunk", F.lit(3).cast("long")).write.parquet(f"{tmp_path}/c/data/write=1")  # stopped before its record
    (tmp_path / "c" / "_begun" / "000000000001.json").write_text("{}")
    sinks.write_chunks(again, f"{tmp_path}/c", 10)
    back = sinks.read_chunks(spark, f"{tmp_path}/c", 900)
    assert back.count() == 9000 == back.select("seq").distinct().count()
    assert back.where("(v = 'y') <> (chunk % 2 = 0)").isEmpty()


def test_chunks_are_replaced(spark, tmp_path):
    df = spark.range(1, 26).select(F.col("id").alias("seq"), F.lit("x").alias("v"))
    sinks.write_chunks(df, str(tmp_path), 10)
    sinks.write_chunks(df.where("seq between 11 and 20").withColumn("v", F.lit("y")), str(tmp_path), 10)
    back = sinks.read_chunks(spark, str(tmp_path), 2)
    assert back.count() == 20 and back.where("v = 'y'").count() == 10


def test_versions_of_an_item_table(spark, items, tmp_path):
    src.write_items(items, str(tmp_path / "t"), 1)
    src.write_items(items.limit(2), str(tmp_path / "t"), 2)
    assert src.latest_items(spark, str(tmp_path / "t")).count() == 2
    assert src.object_inventory(spark, str(tmp_path / "t"), "*.parquet", 10).where("over_budget").count() > 0


def test_pair_comparison(spark):
    a, b = spark.createDataFrame([(100.0, 10, "m")], "lat double, rate int, method string"), spark.createDataFrame([(120.0, 0, "m")], "lat double, rate int, method string")
    out = metrics.compare_pair(a, b, {"lat": False, "rate": True}, method=("method",))
    assert rows(out.select("metric", "verdict")) == [("lat", "REGRESSION"), ("rate", "REGRESSION")]
    with pytest.raises(Exception, match="methods differ"):
        metrics.compare_pair(a, b.withColumn("method", F.lit("n")), {"lat": False}, method=("method",)).collect()


def test_batches_capture_failures(spark):
    def work(frame: pd.DataFrame) -> None:
        if (frame["id"] == 7).any():
            raise ValueError("seven")

    out = process_batches(spark.range(30).coalesce(1), work, 10)
    assert tuple(metrics.batch_counters(out).first()) == (3, 30, 1, 10)


class Settle:
    type, version = "settle", "1"

    def validate(self, request):
        assert request["max_records"] > 0

    def plan(self, items):
        return access.select_pending(items).withColumn("payload", F.col("status"))

    def execute(self, tasks):
        return tasks.withColumn("outcome", F.lit("REPAIRED"))


def test_run_job_stops_at_the_canary(spark):
    items = spark.range(200).select(F.format_string("p%05d", "id").alias("record_key"), F.lit("PENDING").alias("status"), F.lit(1).alias("version"))
    out = run_job(Settle(), items, Request(max_records=1000, canary=3))
    assert (out["plan"].count(), out["outcomes"].count(), out["waiting"].count()) == (200, 3, 197)
    assert run_job(Settle(), items, Request(max_records=1000, canary=3, promoted=True))["outcomes"].where("state = 'DONE'").count() == 200


def test_rounded_percentiles_hold_no_group(spark):
    values = [("a", float(x % 7)) for x in range(50)] + [("b", 3.0), ("c", None), (None, 2.0), (None, 1.0)]
    df = spark.createDataFrame(values, "k string, x double")
    out = metrics.rounded_percentiles(df, "k", "x", 0.95, "p")
    want = {}
    for k in ("a", "b", None):
        v = sorted(x for g, x in values if g == k and x is not None)
        want[k] = v[round((len(v) - 1) * 0.95)]
    assert {r["k"]: r["p"] for r in out.collect()} == want
    from ledgerline.queries import QUERIES

    plan = QUERIES["rounded_percentiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def places_by_sorting(rows, places):
    by = {}
    for k, v, o in rows:
        if v is not None and o is not None:
            by.setdefault(k, []).append((v, o))
    nan_last = lambda x: (x[0] != x[0], x[0] if x[0] == x[0] else 0, x[1])
    return {k: (len(x), *[sorted(x, key=nan_last)[p(len(x)) - 1] for p in places]) for k, x in by.items()}


def test_places_by_sketch_equal_sorting(spark, monkeypatch):
    import random

    r = random.Random(4)
    rows = [("hot", round(r.gauss(0, 9), 2), r.randrange(50)) for _ in range(6000)] + [(f"g{i}", float(i * j % 7), j) for i in range(30) for j in range(i)] + [("flat", 1.0, j) for j in range(900)]
    rows += [(None, 2.0, 1), (None, 1.0, 1), ("none", None, 1), ("none", 1.0, None), ("one", -3.5, 2), ("odd", float("nan"), 1), ("odd", 4.0, 2), ("odd", float("inf"), 3), ("nan", float("nan"), 1), ("nan", float("nan"), 2), ("odd", float("-inf"), 9)]
    df = spark.createDataFrame(rows, "k string, v double, o int").repartition(5)
    places = {"low": lambda n: F.lit(1), "mid": lambda n: F.floor(n / 2) + 1, "p99": lambda n: F.ceil(n * F.lit(0.99)), "high": lambda n: n}
    plain = [lambda n: 1, lambda n: n // 2 + 1, lambda n: -(-n * 99 // 100), lambda n: n]
    want = places_by_sorting(rows, plain)
    for margin in (metrics.MARGIN, -0.02):  # brackets that miss: those groups are sorted whole
        monkeypatch.setattr(metrics, "MARGIN", margin)
        got = {x["k"]: (x["n"], *[tuple(x[p]) for p in places]) for x in metrics.at_places(df, ["k"], ["v", "o"], places).collect()}
        assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}


def test_places_put_little_in_order(spark, monkeypatch):
    """Of a large group only what lies in the brackets is counted by value."""
    seen = []
    monkeypatch.setattr(metrics, "_at_sorted", lambda rows, *a, f=metrics._at_sorted: (seen.append(rows.count()), f(rows, *a))[1])
    df = spark.range(40_000).select(F.lit("a").alias("k"), F.xxhash64("id").alias("v"))
    n = metrics.nearest_ranks(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert n["n"] == 40_000 and len(seen) == 1 and seen[0] < 0.05 * 40_000


def test_hot_keys_are_counted_exactly(spark, monkeypatch):
    rows = [("a", 7)] * 60 + [("a", 9)] * 60 + [("a", 1000 + i) for i in range(900)] + [("b", i) for i in range(500)] + [("c", None)] * 50 + [("c", 3)] + [(None, 5)] * 3
    df = spark.createDataFrame(rows, "t string, k long").repartition(6)
    out = {r["t"]: tuple(r)[1:] for r in metrics.hot_keys(df, "t", "k", 0.05, counters=40).collect()}
    assert out == {"a": (1020, 7, 60, 60 / 1020), "b": (500, None, None, None), "c": (51, None, None, None), None: (3, 5, 3, 1.0)}
    # A task passes on no more than its counters, whatever it has read.
    batches = [pa.record_batch([pa.array(["a"] * 500), pa.array([i * 1000 + j if j % 4 else -1 for j in range(500)], pa.int64()), pa.array([1] * 500, pa.int64())], names=["by", "key", "n"]) for i in range(20)]
    left = [x for b in metrics._frequent(16)(iter(batches)) for x in b.to_pylist()]
    assert len(left) <= 32 and -1 in {x["key"] for x in left}
    with pytest.raises(ValueError):
        metrics.hot_keys(df, "t", "k", 0.001, counters=100)
    assert metrics.hot_keys(df.limit(0), "t", "k").collect() == []
