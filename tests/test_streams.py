"""Streams, run to the end of what is there, twice on one checkpoint."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.sources.commits import CommitConflict
from ledgerline.streaming import message_log, streams
from ledgerline.streaming.message_log import append_log, consumed, log_files, log_length, log_stream


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def message(i, body, at=0, receives="1", md5=""):
    return {"id": i, "receipt": f"r{at}", "body": body, "md5OfBody": md5, "receiveCount": receives, "receivedAt": at}


def test_first_hash_wins_across_triggers(rocks, tmp_path):
    source = tmp_path / "in"

    def go():
        stream = streams.read_messages(rocks, str(source)).withColumn("business_id", F.substring("id", 1, 1))
        return streams.drain(streams.consume_idempotent(stream), "q", str(tmp_path / "check"), str(tmp_path / "out"))

    put(source, "1.json", [message("a1", "x", 1), message("a2", "x", 2), message("b1", "y", 1)])
    assert sorted((r["id"], r["delivery"]) for r in go().collect()) == [("a1", "NEW"), ("a2", "DUPLICATE"), ("b1", "NEW")]
    put(source, "2.json", [message("a3", "z", 3), message("b2", "y", 2)])
    assert sorted((r["id"], r["delivery"]) for r in go().collect())[2:] == [("a3", "CONFLICT"), ("b1", "NEW"), ("b2", "DUPLICATE")]


def test_leases(rocks, tmp_path):
    put(tmp_path / "in", "1.json", [message("a", "x", 10), message("a", "x", 90), message("b", "x", 10)])
    stream = streams.decode_envelopes(streams.read_messages(rocks, str(tmp_path / "in")), 60).withColumn("now", F.lit(100).cast("bigint"))
    seen = []
    streams.lease_state(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["id"], r["receipt"], r["lease"]) for r in seen) == [("a", "r90", "VALID"), ("b", "r10", "NEEDS_RECEIVE")]


def test_leases_end_with_the_watermark(rocks, tmp_path):
    def go(name, rows):
        put(tmp_path / "in", name, rows)
        stream = streams.read_messages(rocks, str(tmp_path / "in")).withColumn("now", F.col("receivedAt"))
        seen = []
        streams.lease_state(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["id"], r["lease"]) for r in seen)

    lease = lambda i, at, until, receipt="r": {"id": i, "receipt": receipt, "receivedAt": at, "leaseUntil": until}
    assert go("1.json", [lease("a", 1000, 1100), lease("b", 1000, 9000), lease("n", None, 5000), lease("z", 1000, 1200, " ")]) == [("a", "VALID"), ("b", "VALID"), ("z", "NEEDS_RECEIVE")]
    # Long after: a's lease has ended and is reported once, b's lasts.
    assert ("a", "NEEDS_RECEIVE") in go("2.json", [lease("c", 5000, 6000)])
    assert go("3.json", [lease("d", 5001, 6000)]) == [("d", "VALID")]


def test_consumed_before_the_state_is_known_by_the_table(rocks, tmp_path):
    put(tmp_path / "in", "1.json", [message("a1", "x", 1), message("a2", "z", 2), message("b1", "y", 1), message("c2", "q", 2), message("c1", "p", 1)])
    stream = streams.read_messages(rocks, str(tmp_path / "in")).withColumn("business_id", F.substring("id", 1, 1))
    processed = rocks.createDataFrame([("a",)], "id string").withColumn("payloadHash", F.sha2(F.lit("x"), 256))
    out = streams.drain(streams.consume_idempotent(stream, processed), "p", str(tmp_path / "c"), str(tmp_path / "o"))
    assert sorted((r["id"], r["delivery"]) for r in out.collect()) == [("a1", "DUPLICATE"), ("a2", "CONFLICT"), ("b1", "NEW"), ("c1", "NEW"), ("c2", "CONFLICT")]


def test_business_ids_are_judged_in_groups(rocks, tmp_path, monkeypatch):
    """State has a row a group, not a row and several calls for every id; ids without a value are one id; an id ends with its time."""
    monkeypatch.setattr(streams, "ID_GROUPS", 8)
    ids = [f"m{i:03d}" for i in range(300)] + ["", None]
    put(tmp_path / "in", "1.json", [{**message(f"a{n}", "x", n), "receipt": i} for n, i in enumerate(ids)])

    def go(remembered, check):
        stream = streams.read_messages(rocks, str(tmp_path / "in")).withColumn("business_id", F.col("receipt"))
        writer = streams.consume_idempotent(stream, remembered=remembered).writeStream.format("parquet").option("path", str(tmp_path / f"o{check}")).option("checkpointLocation", str(tmp_path / check))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query.recentProgress, sorted((r["id"], r["delivery"]) for r in rocks.read.parquet(str(tmp_path / f"o{check}")).collect())

    for check, days in (("c", 14), ("d", 0)):
        progress, rows = go(timedelta(days=days), check)
        assert [d for _, d in rows] == ["NEW"] * 302
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 8
    put(tmp_path / "in", "2.json", [{**message(f"b{n}", "x" if n % 2 else "y", n), "receipt": i} for n, i in enumerate(ids)])
    later = [d for i, d in go(timedelta(days=14), "c")[1] if i[0] == "b"]
    assert sorted(later) == ["CONFLICT"] * 151 + ["DUPLICATE"] * 151
    assert [d for _, d in go(timedelta(0), "d")[1]] == ["NEW"] * 604


def test_poison_and_checksums(spark, tmp_path):
    put(tmp_path / "in", "1.json", [message("a", "b", receives="5"), message("c", "b", md5="00"), message("d", "b", receives="")])
    healthy, poison = streams.split_poison(streams.decode_envelopes(streams.read_messages(spark, str(tmp_path / "in"), stream=False)))
    assert [r["id"] for r in poison.collect()] == ["a"]
    assert sorted((r["id"], r["md5_ok"]) for r in healthy.collect()) == [("c", False), ("d", True)]


def test_replay_sends_once(spark, tmp_path):
    put(tmp_path / "in", "1.json", [message("a", "x", 5000), message("a", "x", 5001), message("b", "y", 5002)])
    stream = streams.read_messages(spark, str(tmp_path / "in")).withColumn("event_time", F.timestamp_seconds("receivedAt"))
    out = streams.drain(streams.replay(stream, fifo=True), "r", str(tmp_path / "c"), str(tmp_path / "o"))
    assert sorted((r["id"], r["dedup_id"]) for r in out.collect()) == [("a", "a"), ("b", "b")]


def test_acks_follow_outcomes_and_the_outbox_sends_once(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"id": "a", "delivery": "NEW"}, {"id": "b", "delivery": "CONFLICT"}])
    stream = spark.readStream.schema("id string, delivery string").json(str(tmp_path / "in"))
    streams.ack_after_durable(stream, str(tmp_path / "o"), str(tmp_path / "a"), str(tmp_path / "c")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "a")).collect()] == ["a"]
    for n in ("1", "2"):
        put(tmp_path / "box", f"{n}.json", [{"eventId": "e1", "deliveryState": "PENDING"}, {"eventId": f"x{n}", "deliveryState": "PENDING"}, {"eventId": "d", "deliveryState": "DELIVERED"}])
        box = spark.readStream.schema("eventId string, deliveryState string").json(str(tmp_path / "box"))
        streams.publish_outbox(box, str(tmp_path / "sent"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r["eventId"] for r in spark.read.parquet(str(tmp_path / "sent")).collect()) == ["e1", "x1", "x2"]


def shuffled_events(spark, folder, n=6):
    """events in files of shuffled rows."""
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    e.orderBy(F.rand(7)).repartition(n).write.parquet(str(folder))
    return e


def one_file_a_trigger(spark, folder):
    e = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").cast("string").alias("id"), key.alias("business_id"), F.col("props").alias("body"), F.unix_timestamp("ts").alias("receivedAt"))


def test_no_message_is_lost_over_triggers_out_of_order(rocks, tmp_path):
    events = shuffled_events(rocks, tmp_path / "in")
    out = streams.drain(streams.consume_idempotent(one_file_a_trigger(rocks, tmp_path / "in")), "c", str(tmp_path / "c"), str(tmp_path / "o"))
    rows = out.collect()
    assert len(rows) == events.count() == len({r["id"] for r in rows})
    first, by = {r["business_id"]: r["hash"] for r in rows if r["delivery"] == "NEW"}, {}
    for r in rows:
        by.setdefault(r["business_id"], []).append(r)
    assert len(first) == len(by) and all(sum(r["delivery"] == "NEW" for r in x) == 1 for x in by.values())
    assert all(r["delivery"] == "NEW" or (r["delivery"] == "DUPLICATE") == (r["hash"] == first[r["business_id"]]) for r in rows)


def test_replay_is_complete_over_triggers_out_of_order(rocks, tmp_path):
    events = shuffled_events(rocks, tmp_path / "in")
    twice = one_file_a_trigger(rocks, tmp_path / "in").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = streams.drain(streams.replay(twice), "r", str(tmp_path / "c"), str(tmp_path / "o"))
    assert out.count() == events.count() == out.select("id").distinct().count()


def log_of(spark, path, *parts):
    for part in parts:
        length = append_log(spark.createDataFrame(part, "id string, receivedAt long, body string"), path, files_of=3)
    return length


def test_intake_stops_at_any_message(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    parts = [[(f"m{i:03d}", i, "x") for i in range(100)], [(f"n{i:03d}", i, None) for i in range(17)]]
    assert log_of(spark, path, *parts) == 117 and len(log_files(spark, path)) > 2
    want = [r[0] for p in parts for r in p]
    seen = []
    for n in (1, 50, 0, 49, 9, 500, 5):
        before = len(seen)
        out = streams.drain_messages(spark, path, f"{path}/c", f"{path}/o", n) if n or seen else None
        seen = sorted(r["id"] for r in out.collect())
        assert seen == sorted(want[: min(117, before + n)]) and consumed(spark, f"{path}/c") == len(seen)
    # Messages that come later are taken by the next run.
    log_of(spark, path, [("later", 0, "y")])
    assert streams.drain_messages(spark, path, f"{path}/c", f"{path}/o", 5).count() == 118


def test_triggers_of_a_bounded_number(spark, tmp_path):
    path, sizes = f"file://{tmp_path}/log", []
    log_of(spark, path, [(f"m{i:03d}", i, "x") for i in range(25)])
    for _ in range(2):  # the second run finds nothing new
        q = log_stream(spark, path, most=10).writeStream.foreachBatch(lambda df, _: sizes.append([r["id"] for r in df.orderBy("id").collect()])).option("checkpointLocation", f"{path}/c").start()
        q.processAllAvailable()
        q.stop()
    assert [len(x) for x in sizes] == [10, 10, 5] and sizes[0][0] == "m000" and sizes[2][-1] == "m024"


def test_an_empty_log_and_none(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with pytest.raises(ValueError):
        log_stream(spark, path)
    empty = spark.createDataFrame([], "id string, receivedAt long, body string")
    assert append_log(empty, path) == 0 and log_stream(spark, path).columns == empty.columns
    assert log_of(spark, path, [("a", 1, "x"), ("b", None, None)]) == 2
    assert sorted(r["id"] for r in streams.drain_messages(spark, path, f"{path}/c", f"{path}/o", 9).collect()) == ["a", "b"]


def test_two_writers_of_a_segment(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    log_of(spark, path, [("a", 1, "x")])
    monkeypatch.setattr(message_log, "segments", lambda *_: [])
    with pytest.raises(CommitConflict):
        log_of(spark, path, [("b", 1, "x")])
    monkeypatch.undo()
    assert log_length(spark, path) == 1


def receives(spark):
    tasks = [("t1", "q", "m1", "r", 1000, 1010), ("t2", "q", "m2", "r", 1000, 5000), ("t3", "p", "m3", " ", 1000, 5000), ("t4", "x", "m4", "r", 1000, 5000), ("t5", "x", "m5", "r", 1000, 1030), ("t6", None, "m6", "r", 1000, 9000)]
    got = [("q", "m1", "n1", 1005, 2000), ("q", "m9", "n2", 1020, 2000), ("q", "m8", "n3", 1030, 1030), ("p", "m3", "n4", 1001, 1050), ("p", "m3", "n5", 1002, 9000), ("p", "m3", "n6", 1003, 9000), ("x", "m4", "late", 9999, 20000), ("x", "m4", "early", 999, 20000)]
    return spark.createDataFrame(tasks, "task string, queue string, id string, receipt string, at long, leaseUntil long"), spark.createDataFrame(got, "queue string, id string, receipt string, receivedAt long, leaseUntil long")


def test_receives_meet_their_tasks(spark):
    out = streams.receives_of_tasks(*receives(spark), 600, 60)
    got = sorted((r["task"], r["receipt"], r["verdict"]) for r in out.collect())
    assert got == [
        ("t1", "n1", "VALID"), ("t1", "n2", "RELEASED"), ("t1", "n3", "LEASE_EXPIRED"), ("t2", "n1", "RELEASED"), ("t2", "n2", "RELEASED"), ("t2", "n3", "LEASE_EXPIRED"),
        ("t3", "n4", "NEEDS_RECEIVE"), ("t3", "n5", "VALID"), ("t3", "n6", "VALID"), ("t4", "r", "VALID"), ("t5", "r", "NEEDS_RECEIVE"), ("t6", "r", "VALID"),
    ]
    ends = {r["task"]: tuple(r)[1:] for r in streams.receipt_outcomes(out, 3).collect()}
    assert ends == {
        "t1": ("VALID", "n1", 1, 0), "t2": ("RECONCILIATION_REQUIRED", None, 3, 2), "t3": ("VALID", "n5", 2, 0), "t4": ("VALID", "r", 0, 0), "t5": ("NEEDS_RECEIVE", None, 0, 0), "t6": ("VALID", "r", 0, 0),
    }
    assert streams.receipt_outcomes(out.where("task = 't2'"), 9).first()["outcome"] == "NEEDS_RECEIVE"


def test_receives_of_streams_in_triggers(rocks, tmp_path):
    tasks, got = receives(rocks)
    tasks = tasks.where("queue is not null")
    end = 50_000
    for name, df, time in (("t", tasks, "at"), ("r", got, "receivedAt")):
        rows = sorted(df.collect(), key=lambda r: r[time])
        for i, part in enumerate((rows[:2], rows[2:], rows[:1])):
            made = rocks.createDataFrame(part, df.schema)
            if i == 2:  # moves the watermark
                made = made.withColumn("queue", F.lit("end")).withColumn(time, F.lit(end).cast("long"))
                made = made.withColumn("task", F.lit("end")) if name == "t" else made
            made.coalesce(1).write.mode("append").json(str(tmp_path / name))
    read = lambda name, df: rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    out = streams.drain(streams.receives_of_tasks(read("t", tasks), read("r", got), 600, 60, "20000 seconds"), "x", str(tmp_path / "c"), str(tmp_path / "o"))
    want = streams.receives_of_tasks(tasks, got, 600, 60)
    key = lambda df: sorted(map(str, df.where("task <> 'end'").select("task", "id", "received_at", "receipt", "verdict").collect()))
    assert key(out) == key(want)
