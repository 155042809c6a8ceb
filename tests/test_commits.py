"""Versioned tables, two-table commits, retried ledgers, committed chunks, and runs in waves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import planning
from ledgerline.plans.rules import Request, plan_job, run_job, run_waves
from ledgerline.plans.transactions import commit_repair
from ledgerline.sources import sinks
from ledgerline.sources.commits import CommitConflict, Tables, newest_rows


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/t")


def test_a_version_names_all_tables_at_once(spark, tables, monkeypatch):
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert tables.version() == 0 and tables.read("x", schema="k int").count() == 0
    assert tables.commit(0, replace={"x": one, "y": one}) == 1
    # A stop between the writes: y's part can't be written, and x stays as it was.
    whole, seen = Tables.stage, []

    def stops(self, df, token, table):
        seen.append(table)
        if table == "y":
            raise RuntimeError("stopped")
        return whole(self, df, token, table)

    monkeypatch.setattr(Tables, "stage", stops)
    with pytest.raises(RuntimeError):
        tables.commit(1, replace={"x": one.withColumn("v", F.lit("b")), "y": one})
    monkeypatch.setattr(Tables, "stage", whole)
    assert seen == ["x", "y"] and tables.version() == 1 and rows(tables.read("x"), "v") == [("a",)]
    assert tables.commit(1, replace={"x": one.withColumn("v", F.lit("c"))}) == 2
    assert rows(tables.read("x"), "v") == [("c",)] and rows(tables.read("y"), "v") == [("a",)] and rows(tables.read("x", 1), "v") == [("a",)]
    assert tables.prune(keep=1) == 2 and rows(tables.read("y"), "v") == [("a",)]


def test_a_second_writer_from_the_same_version_fails(spark, tables):
    one = spark.createDataFrame([(1,)], "k int")
    tables.commit(0, replace={"x": one})
    part = tables.stage(one, "mine", "x")
    tables.commit(1, replace={"x": one.union(one)})
    with pytest.raises(CommitConflict):
        tables.publish(1, {"x": [part]})
    with pytest.raises(CommitConflict):
        tables.commit(1, replace={"x": one})
    assert tables.read("x").count() == 2


def test_a_manifest_is_created_once(tables):
    files = tables.files
    assert files.create(f"{tables.path}/commits/a.json", "first") and not files.create(f"{tables.path}/commits/a.json", "second")
    assert files.read(f"{tables.path}/commits/a.json") == "first" and files.names(f"{tables.path}/commits") == ["a.json"]


def test_ledger_is_retried_and_compacted(spark, tables):
    effects = lambda *x: spark.createDataFrame(list(x), "job string, task long, step string, state string, result string")
    assert sinks.append_ledger(tables, effects(("j", 1, "a", "INTENT", None), ("j", 2, "a", "INTENT", None)), "b1") == 1
    assert sinks.append_ledger(tables, effects(("j", 1, "a", "LOST", None)), "b1") == 1  # the batch is there
    sinks.append_ledger(tables, effects(("j", 1, "a", "SUCCEEDED", "r")), "b2")
    want = [("j", 1, "a", "SUCCEEDED", "r", 2), ("j", 2, "a", "INTENT", None, 1)]
    columns = ("job", "task", "step", "state", "result", "changes")
    assert rows(sinks.current_effects(tables), *columns) == want
    sinks.compact_ledger(tables)
    sinks.append_ledger(tables, effects(("j", 1, "a", "LOST", None)), "b2")
    assert rows(sinks.current_effects(tables), *columns) == want and len(tables.manifest()["parts"]["effects"]) == 1
    sinks.append_ledger(tables, effects(("j", 2, "a", "UNKNOWN", "q"), ("k", 1, "a", "INTENT", None)), "b3")
    assert rows(sinks.current_effects(tables), *columns) == [want[0], ("j", 2, "a", "UNKNOWN", "q", 2), ("k", 1, "a", "INTENT", None, 1)]
    read = sinks.current_effects(tables).inputFiles()
    assert {f.split("/data/")[1].split("/")[0] for f in read} == {p.split("/")[1] for p in tables.manifest()["parts"]["effects"]}  # snapshot and tail


def test_newest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 2), ("b", 1, None, 1)], "k string, n int, v string, _version long")
    assert rows(newest_rows(df, ["k"]), "k", "n") == [("a", 2), ("b", 1)]


def test_chunks_are_seen_once_committed(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    df = spark.range(1, 26).select(F.col("id").alias("seq"), F.lit("x").alias("v"))
    sinks.write_chunks(df.where("seq <= 10"), path, 10)
    assert sinks.read_chunks(spark, path).count() == 0
    assert sinks.commit_chunks(spark, path, 10, 25, 10) and not sinks.commit_chunks(spark, path, 10, 25, 10)
    # A run that stops after its chunk and before its record leaves an orphan; its replay replaces it.
    sinks.write_chunks(df.where("seq between 11 and 20").withColumn("v", F.lit("orphan")), path, 10)
    assert rows(sinks.read_chunks(spark, path), "seq")[-1] == (10,)
    sinks.write_chunks(df.where("seq > 10"), path, 10)
    sinks.commit_chunks(spark, path, 25, 25, 10)
    back = sinks.read_chunks(spark, path)
    assert back.count() == 25 and back.where("v = 'orphan'").count() == 0
    for cursor, total, page in ((24, 25, 10), (10, 25, 10), (26, 25, 10), (25, 30, 10), (25, 25, 5), (-10, 25, 10)):
        with pytest.raises(ValueError):
            sinks.commit_chunks(spark, path, cursor, total, page)


def payments(spark):
    return spark.createDataFrame([("p1", "PENDING", 1), ("p2", "PENDING", 1), ("p3", "PENDING", 2), ("p4", "MATCH", 1)], "record_key string, status string, version long")


SETTLED = [("p1", "SETTLED", 1), ("p2", "SETTLED", 1), ("p3", "SETTLED", 1)]


def test_items_and_outbox_change_together(spark, tables, monkeypatch):
    confirmations = spark.createDataFrame(SETTLED, "reference string, status string, version long")
    tables.commit(0, replace={"items": payments(spark)})
    whole = Tables.stage

    def stops(self, df, token, table):
        if table == "outbox":
            raise RuntimeError("stopped")
        return whole(self, df, token, table)

    monkeypatch.setattr(Tables, "stage", stops)
    with pytest.raises(RuntimeError):
        commit_repair(tables, confirmations, "j")
    monkeypatch.setattr(Tables, "stage", whole)
    assert tables.read("items").where("status = 'SETTLED'").count() == 0 and "outbox" not in tables.manifest()["parts"]
    version, outcomes = commit_repair(tables, confirmations, "j")
    assert rows(outcomes, "record_key", "outcome") == [("p1", "REPAIRED"), ("p2", "REPAIRED"), ("p3", "REPAIRED")]
    assert rows(tables.read("outbox"), "eventId", "version") == [("j:p1", 2), ("j:p2", 2), ("j:p3", 3)]
    # The job again: nothing changes, its outcomes are given again.
    again, same = commit_repair(tables, confirmations, "j")
    assert again == version == tables.version() and rows(same, "record_key", "outcome") == rows(outcomes, "record_key", "outcome")
    assert tables.read("outbox").count() == 3


def test_what_changed_after_planning_or_was_published_is_a_conflict(spark, tables):
    confirmations = spark.createDataFrame(SETTLED, "reference string, status string, version long")
    events = spark.createDataFrame([("j:p2", "j", "p2", "{}", "DELIVERED", 2)], "eventId string, operationId string, paymentId string, payload string, deliveryState string, version long")
    planned = tables.commit(0, replace={"items": payments(spark)}, append={"outbox": events})
    tables.commit(planned, replace={"items": payments(spark).withColumn("version", F.when(F.col("record_key") == "p1", 9).otherwise(F.col("version")))})
    _, outcomes = commit_repair(tables, confirmations, "j", planned)
    assert rows(outcomes, "record_key", "outcome") == [("p1", "CONFLICT"), ("p2", "CONFLICT"), ("p3", "REPAIRED")]
    assert rows(tables.read("items").where("opsMarker is not null"), "record_key", "opsMarker") == [("p3", "j:p3")]
    assert rows(tables.read("outbox"), "eventId") == [("j:p2",), ("j:p3",)]


def test_a_commit_in_between_makes_a_repair_fail(spark, tables, monkeypatch):
    confirmations = spark.createDataFrame(SETTLED, "reference string, status string, version long")
    tables.commit(0, replace={"items": payments(spark)})
    whole = Tables.publish

    def second(self, parent, parts, *rest, **named):
        monkeypatch.setattr(Tables, "publish", whole)
        tables.commit(1, replace={"items": payments(spark).where("record_key <> 'p1'")})
        return whole(self, parent, parts, *rest, **named)

    monkeypatch.setattr(Tables, "publish", second)
    with pytest.raises(CommitConflict):
        commit_repair(tables, confirmations, "j")
    assert tables.read("items").where("status = 'SETTLED'").count() == 0 and commit_repair(tables, confirmations, "j")[1].count() == 2


class Writes:
    """A rule whose execution leaves a mark a task, as calls would."""

    type, version = "writes", "v1"

    def __init__(self, folder, fails=lambda n: n % 5 == 0):
        self.folder, self.fails = str(folder), fails

    def validate(self, request):
        assert request["max_records"] > 0

    def plan(self, items):
        return items.withColumn("payload", F.col("status"))

    def proposal(self, candidates):
        return planning.propose(candidates, "repair")

    def execute(self, tasks):
        folder, fails = self.folder, self.fails

        def run(frames):
            for frame in frames:
                for n in frame["seq"]:
                    with open(f"{folder}/calls-{os.getpid()}", "a") as out:
                        out.write(f"{n}\n")
                frame["outcome"] = ["FAILED" if fails(n) else "REPAIRED" for n in frame["seq"]]
                yield frame[["record_key", "seq", "outcome"]]

        return tasks.select("record_key", "seq").mapInPandas(run, "record_key string, seq long, outcome string")

    def risks(self):
        return ["it writes"]

    def calls(self):
        return 2

    def called(self):
        return sorted(int(n) for f in os.listdir(self.folder) for n in open(f"{self.folder}/{f}"))


@pytest.fixture
def many(spark):
    return spark.range(300).select(F.format_string("p%05d", "id").alias("record_key"), F.lit("PENDING").alias("status"), F.lit(1).alias("version"))


@pytest.fixture
def rule(tmp_path):
    (tmp_path / "calls").mkdir()
    return Writes(tmp_path / "calls")


def test_a_run_stops_with_the_wave_that_trips(spark, many, rule, tmp_path):
    request = Request(max_records=1000, canary=300, max_errors=9, max_rate=1.0, first_wave=8)
    out = run_job(rule, many, request, path=f"file://{tmp_path}/job")
    # Waves of 8, 16, 32: the tenth error is task 50, in the third wave, which ends at 56.
    assert rule.called() == list(range(1, 57))
    done = sorted((r["seq"], r["state"], r["after_cut"]) for r in out["outcomes"].collect())
    assert done == [(n, "DONE", n > 50) for n in range(1, 57)]
    assert out["waiting"].count() == 300 - 56 and out["state"].first()["phase"] == "BUDGET_EXCEEDED"
    again = run_job(rule, many, request, path=f"file://{tmp_path}/job")
    assert again["outcomes"].count() == 56 and rule.called() == list(range(1, 57))


def test_a_run_goes_on_and_executes_nothing_twice(spark, many, rule, tables, monkeypatch):
    request = Request(max_records=1000, canary=100, max_errors=10_000, max_rate=1.0, first_wave=10)
    assert plan_job(rule, many, request, tables)["risks"] == ["it writes"]
    assert run_waves(rule, request, tables, most_waves=1)["next"] == 11
    # Stopped after the wave's outcomes were written and before they were published.
    whole = Tables.publish

    def stopped(self, *a, **b):
        raise RuntimeError("stopped")

    monkeypatch.setattr(Tables, "publish", stopped)
    with pytest.raises(RuntimeError):
        run_waves(rule, request, tables)
    monkeypatch.setattr(Tables, "publish", whole)
    assert rule.called() == list(range(1, 31)) and tables.read("outcomes").count() == 10
    assert run_waves(rule, request, tables)["phase"] == "CANARY_COMPLETE" and rule.called() == list(range(1, 101))
    state = run_waves(rule, Request(max_records=1000, canary=100, max_errors=10_000, max_rate=1.0, promoted=True, max_calls=500), tables)
    assert state["phase"] == "CALLS_EXHAUSTED" and state["calls"] == 500 and rule.called() == list(range(1, 251))
    state = run_waves(rule, Request(max_records=1000, canary=100, max_errors=10_000, max_rate=1.0, promoted=True), tables)
    assert (state["phase"], state["done"], state["errors"]) == ("COMPLETED", 300, 60) and rule.called() == list(range(1, 301))
    assert json.loads(json.dumps(state)) == tables.manifest()["state"]


def test_rates_count_from_the_first_task(spark, many, rule, tables):
    """Errors of earlier waves count: by 1 in 5, the rate passes 0.15 only with enough tasks done."""
    request = Request(max_records=1000, canary=300, max_errors=10_000, max_rate=0.15, min_sample=40, first_wave=10)
    plan_job(rule, many, request, tables)
    state = run_waves(rule, request, tables)
    assert (state["phase"], state["cut"], state["next"]) == ("BUDGET_EXCEEDED", 40, 71)


def test_two_runners_publish_a_wave_once(spark, many, rule, tables, monkeypatch):
    request = Request(max_records=1000, canary=300, max_errors=10_000, max_rate=1.0, first_wave=100)
    plan_job(rule, many, request, tables)
    whole = Tables.publish

    def overtaken(self, *a, **b):
        monkeypatch.setattr(Tables, "publish", whole)
        run_waves(rule, request, tables, most_waves=1)
        return whole(self, *a, **b)

    monkeypatch.setattr(Tables, "publish", overtaken)
    with pytest.raises(CommitConflict):
        run_waves(rule, request, tables)
    assert tables.read("outcomes").count() == 100 and rule.called() == list(range(1, 101))
