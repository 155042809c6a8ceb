"""Message streams: envelopes, poison, idempotent consumption, replay, leases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.functions.scalar import md5_ok, receive_count, sha256_hex
from ledgerline.streaming.message_log import consumed, log_stream

ENVELOPE = (
    "id string, receipt string, body string, md5OfBody string, attributes map<string, struct<type:string, string:string, binary:string>>, "
    "receiveCount string, receivedAt bigint, leaseUntil bigint"
)
#: Deliveries after which a message is poison, and seconds that a receive hides it.
POISON, VISIBILITY = 5, 120


def read_messages(spark: SparkSession, path: str, stream: bool = True, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """Envelopes from files; a trigger takes a bounded number of them."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    return reader.schema(ENVELOPE).format(fmt).load(path)


def decode_envelopes(df: DataFrame, visibility: int = VISIBILITY) -> DataFrame:
    """Checked envelopes: whether the checksum holds, deliveries as a number, and the lease's end."""
    return (
        df.withColumn("md5_ok", md5_ok("body", "md5OfBody"))
        .withColumn("receives", receive_count("receiveCount"))
        .withColumn("leaseUntil", F.coalesce(F.col("leaseUntil"), F.col("receivedAt") + visibility))
    )


def split_poison(df: DataFrame, threshold: int = POISON) -> tuple[DataFrame, DataFrame]:
    """(healthy, poison); poison isn't acknowledged."""
    bad = F.col("receives") >= threshold
    return df.where(~bad), df.where(bad).withColumn("outcome", F.lit("POISON_NO_ACK"))


def inspect(df: DataFrame) -> DataFrame:
    return df.withColumn("outcome", F.lit("INSPECTED_NO_ACK"))


#: How long a stream remembers a business id: longer than a queue keeps messages.
REMEMBERED = timedelta(days=14)


#: Groups that business ids are dealt to by their hash; a group's ids are judged in one call.
ID_GROUPS = 1024


def _judge(_key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Judges a group's messages by the first payload hash of each business id, which it keeps until the watermark passes the id's last arrival."""
    if state.hasTimedOut:
        state.remove()
        return
    now = state.getCurrentWatermarkMs()
    first = {i: (h, t) for i, h, t in zip(*state.get) if t > now} if state.exists else {}
    # What a trigger bounds is put in order together.
    rows = pd.concat(list(frames)).sort_values(["receivedAt", "id"], kind="stable")
    arrived = int(rows["arrived"].max().timestamp() * 1000)
    came, delivery = set(rows["business_id"]), []
    for i, h, known in zip(rows["business_id"], rows["hash"], rows["known"]):
        by = first.get(i)
        if by is None and known is None:
            first[i], kind = (h, arrived), "NEW"
        else:
            first[i] = by = by or (known, arrived)
            kind = "DUPLICATE" if h == by[0] else "CONFLICT"
        delivery.append(kind)
    kept = [(i, h, arrived if i in came else t) for i, (h, t) in first.items()]
    state.update(tuple(map(list, zip(*kept))))
    state.setTimeoutTimestamp(max(t for _, _, t in kept))
    yield pd.DataFrame({"business_id": rows["business_id"], "id": rows["id"], "hash": rows["hash"], "delivery": delivery})


def by_arrival(stream: DataFrame, remembered: timedelta) -> DataFrame:
    """A stream with the time at which its rows arrive, ``arrived``, and a watermark that far behind it.

    State that is kept by it ends so long after a key's last arrival. No row is ever late, whatever its own times say.
    """
    return stream.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", f"{int(remembered.total_seconds())} seconds")


def consume_idempotent(stream: DataFrame, processed: DataFrame | None = None, remembered: timedelta = REMEMBERED) -> DataFrame:
    """(business_id, id, hash, delivery) of a stream (business_id, id, body, receivedAt): NEW, DUPLICATE or CONFLICT.

    Messages are judged as they arrive, and none is dropped: of those that come in one trigger the first by receive time, then id, sets the
    hash; later triggers are judged by it. From a log in order (see message_log) that is the judgement of consume_batch(), however
    many messages a trigger takes. A null body counts as an empty one, a missing receive time as the trigger's. State is one hash a
    business id, kept in ID_GROUPS rows, and ends ``remembered`` after its last arrival, longer than a queue keeps messages; after that,
    messages are judged by ``processed`` (id, payloadHash), the table of what has been consumed, if it is given.
    """
    at = F.coalesce(F.col("receivedAt"), F.unix_timestamp(F.current_timestamp()))
    rows = by_arrival(stream, remembered).select("business_id", "id", at.alias("receivedAt"), sha256_hex(F.coalesce("body", F.lit(""))).alias("hash"), "arrived")
    if processed is None:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    else:
        rows = rows.join(processed.select(F.col("id").alias("business_id"), F.col("payloadHash").alias("known")), "business_id", "left")
    return rows.withColumn("group", F.pmod(F.xxhash64("business_id"), F.lit(ID_GROUPS))).groupBy("group").applyInPandasWithState(
        _judge, "business_id string, id string, hash string, delivery string", "ids array<string>, hashes array<string>, last array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def consume_batch(messages: DataFrame) -> DataFrame:
    """The same judgement over a whole table: the first by receive time, then id, sets the hash."""
    rows = messages.select("business_id", "id", "receivedAt", sha256_hex(F.coalesce("body", F.lit(""))).alias("hash"))
    first = rows.groupBy("business_id").agg(F.min(F.struct("receivedAt", "id", "hash")).alias("f"))
    kind = F.when((F.col("receivedAt") == F.col("f.receivedAt")) & (F.col("id") == F.col("f.id")), "NEW").when(F.col("hash") == F.col("f.hash"), "DUPLICATE").otherwise("CONFLICT")
    return rows.join(first, "business_id").select("business_id", "id", "hash", kind.alias("delivery"))


def replay(stream: DataFrame, fifo: bool = False, remembered: timedelta = REMEMBERED) -> DataFrame:
    """One send for each message id, with its attributes; FIFO adds group and dedup ids.

    A stream remembers an id for ``remembered`` after its arrival; no message is dropped for being late.
    """
    if stream.isStreaming:
        out = by_arrival(stream, remembered).dropDuplicatesWithinWatermark(["id"]).drop("arrived")
    else:
        out = stream.dropDuplicates(["id"])
    if fifo:
        out = out.withColumn("group_id", F.lit("replay")).withColumn("dedup_id", F.col("id"))
    return out


class _Lease(StatefulProcessor):
    """Keeps the newest receipt of a message until its lease ends."""

    def __init__(self, reserve: int):
        self.reserve = reserve

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "receivedAt bigint, receipt string, leaseUntil bigint")

    def _row(self, key, newest: tuple, lease: str) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "receipt": [newest[1]], "leaseUntil": [newest[2]], "lease": [lease]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = tuple(self.newest.get()) if self.newest.exists() else None
        best, now = had or (-1, "", 0), 0
        for frame in rows:
            frame = frame.fillna({"receipt": "", "leaseUntil": 0, "now": 0})
            for at, receipt, until, clock in zip(frame["receivedAt"], frame["receipt"], frame["leaseUntil"], frame["now"]):
                now = max(now, int(clock))
                best = max(best, (int(at), receipt, int(until)))
        if best != had:
            if had:
                self.handle.deleteTimer(had[2] * 1000)
            self.newest.update(best)
            self.handle.registerTimer(best[2] * 1000)
        held = bool(best[1].strip()) and best[2] > now + self.reserve
        yield self._row(key, best, "VALID" if held else "NEEDS_RECEIVE")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            newest = tuple(self.newest.get())
            self.newest.clear()
            yield self._row(key, newest, "NEEDS_RECEIVE")

    def close(self) -> None:
        pass


def lease_state(stream: DataFrame, reserve: int = 0, delay: str = "120 seconds") -> DataFrame:
    """Newest receipt of each message of a stream (id, receipt, receivedAt, leaseUntil, now), and whether its lease holds.

    The watermark of ``receivedAt`` drives expiry: once it passes a lease's end, the message comes out
    as NEEDS_RECEIVE and its state goes, so state is what is leased. Rows without a receive time are left out; a blank receipt
    holds nothing. Needs the RocksDB state store.
    """
    received = stream.where(F.col("receivedAt").isNotNull()).withColumn("received", F.timestamp_seconds("receivedAt")).withWatermark("received", delay)
    return received.select("id", "receipt", "receivedAt", "leaseUntil", "now", "received").groupBy("id").transformWithStateInPandas(
        statefulProcessor=_Lease(reserve), outputStructType="id string, receipt string, leaseUntil bigint, lease string", outputMode="Update", timeMode="EventTime"
    )


def lease_batch(receives: DataFrame, reserve: int = 0) -> DataFrame:
    """The same judgement over a whole table."""
    row = F.struct("receivedAt", F.coalesce("receipt", F.lit("")).alias("receipt"), F.coalesce("leaseUntil", F.lit(0)).alias("leaseUntil"))
    newest = receives.where(F.col("receivedAt").isNotNull()).groupBy("id").agg(F.max(row).alias("x"), F.coalesce(F.max("now"), F.lit(0)).alias("now"))
    held = (F.length(F.trim("x.receipt")) > 0) & (F.col("x.leaseUntil") > F.col("now") + reserve)
    return newest.select("id", "x.receipt", "x.leaseUntil", F.when(held, "VALID").otherwise("NEEDS_RECEIVE").alias("lease"))


def receives_of_tasks(tasks: DataFrame, receives: DataFrame, window: int = 3600, reserve: int = 0, delay: str = "600 seconds") -> DataFrame:
    """What was received for each task while it waited for a valid receipt: (task, id, received_at, receipt, verdict), of streams or tables.

    tasks: (task, queue, id, receipt, at, leaseUntil), a message whose receipt is needed at second ``at``. receives: (queue, id, receipt,
    receivedAt, leaseUntil), what came from the queue. Those up to ``window`` seconds from ``at`` count:

    VALID: the task's own message, whose lease lasts beyond the receive and ``reserve``; its receipt may be used.
    NEEDS_RECEIVE: the task's own message, but its receipt is blank or its lease too short.
    RELEASED: another message, which is given back while its lease lasts; LEASE_EXPIRED: another one, whose lease has ended.

    A task for which nothing was received comes once, with null received_at: VALID if its own receipt holds at ``at``, else NEEDS_RECEIVE. In a
    stream that is known when the watermarks, ``delay`` behind both times, have passed the task's window; until then
    state holds what can still meet. Rows without a time or queue meet nothing; such tasks come out alone from a table, and are late in a stream.
    """
    t = tasks.select(F.col("task"), F.col("queue").alias("t_queue"), F.col("id").alias("t_id"), F.col("receipt").alias("t_receipt"), F.col("leaseUntil").alias("t_lease"), F.timestamp_seconds("at").alias("t_at"))
    r = receives.select(F.col("queue").alias("r_queue"), F.col("id").alias("r_id"), F.col("receipt").alias("r_receipt"), F.col("leaseUntil").alias("r_lease"), F.timestamp_seconds("receivedAt").alias("r_at"))
    if tasks.isStreaming:
        t, r = t.withWatermark("t_at", delay), r.withWatermark("r_at", delay)
    near = (F.col("r_at") >= F.col("t_at")) & (F.col("r_at") <= F.col("t_at") + F.expr(f"INTERVAL {int(window)} SECONDS"))
    met = t.join(r, (F.col("t_queue") == F.col("r_queue")) & near, "left")
    holds = lambda receipt, lease, at, more: (F.length(F.trim(F.coalesce(receipt, F.lit("")))) > 0) & (F.coalesce(lease, F.lit(0)) > F.unix_timestamp(at) + more)
    own = F.when(holds(F.col("r_receipt"), F.col("r_lease"), F.col("r_at"), reserve), "VALID").otherwise("NEEDS_RECEIVE")
    other = F.when(holds(F.lit("-"), F.col("r_lease"), F.col("r_at"), 0), "RELEASED").otherwise("LEASE_EXPIRED")
    alone = F.when(holds(F.col("t_receipt"), F.col("t_lease"), F.col("t_at"), reserve), "VALID").otherwise("NEEDS_RECEIVE")
    verdict = F.when(F.col("r_at").isNull(), alone).when(F.col("r_id") == F.col("t_id"), own).otherwise(other)
    return met.select("task", F.coalesce("r_id", "t_id").alias("id"), F.unix_timestamp("r_at").alias("received_at"), F.when(F.col("r_at").isNull(), F.col("t_receipt")).otherwise(F.col("r_receipt")).alias("receipt"), verdict.alias("verdict"))


def receipt_outcomes(verdicts: DataFrame, attempts: int = 10) -> DataFrame:
    """(task, outcome, receipt, receives, released) of a table of receives_of_tasks(): the first ``attempts`` receives of a task count.

    VALID with the first receipt that holds; RECONCILIATION_REQUIRED if all attempts are used up; NEEDS_RECEIVE otherwise. Receives
    after the one that holds aren't made and don't count.
    """
    w = Window.partitionBy("task").orderBy(F.col("received_at"), "id", "receipt")
    numbered = verdicts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= attempts)
    held = numbered.withColumn("before", F.coalesce(F.max((F.col("verdict") == "VALID").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    made = held.where("before = 0")
    out = made.groupBy("task").agg(
        F.max(F.when(F.col("verdict") == "VALID", F.col("receipt"))).alias("receipt"), F.bool_or(F.col("verdict") == "VALID").alias("ok"),
        F.count("received_at").alias("receives"), F.count_if(F.col("verdict") == "RELEASED").alias("released"),
    )
    outcome = F.when(F.col("ok"), "VALID").when(F.col("receives") >= attempts, "RECONCILIATION_REQUIRED").otherwise("NEEDS_RECEIVE")
    return out.select("task", outcome.alias("outcome"), "receipt", "receives", "released")


def ack_after_durable(stream: DataFrame, outcomes_path: str, acks_path: str, checkpoint: str):
    """Write each batch's outcomes, then its acknowledgements; both folders are named by batch, so a repeat replaces them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{outcomes_path}/batch={batch_id}")
        done = batch.sparkSession.read.parquet(f"{outcomes_path}/batch={batch_id}")
        done.where("delivery <> 'CONFLICT'").select("id").write.mode("overwrite").parquet(f"{acks_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of what publish_outbox() keeps of delivered events, by the first digits of their ids' hashes.
_SENT = "eventId string, batch bigint, part string"


def publish_outbox(stream: DataFrame, path: str, checkpoint: str):
    """Deliver pending events once each; what an earlier batch delivered is left out.

    Events go to ``path`` by batch. Their ids go to ``path``-ids, by batch and by part, so a batch looks only
    into the parts that its own ids are in; a batch that runs again replaces its own.
    """
    ids = f"{path.rstrip('/')}-ids"
    part = F.substring(sha256_hex("eventId"), 1, 2)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pending = batch.where("deliveryState = 'PENDING'").dropDuplicates(["eventId"])
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ids)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            # At most 256 parts.
            parts = [r[0] for r in pending.select(part).distinct().collect()]
            sent = spark.read.schema(_SENT).parquet(ids).where(F.col("part").isin(parts) & (F.col("batch") < batch_id))
            pending = pending.join(sent.select("eventId"), "eventId", "left_anti")
        target = f"{path}/batch={batch_id}"
        pending.write.mode("overwrite").parquet(target)
        delivered = spark.read.schema(batch.schema).parquet(target).select("eventId", F.lit(batch_id).cast("bigint").alias("batch"), part.alias("part"))
        delivered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(ids)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, checkpoint: str, path: str, continuous: bool = False) -> DataFrame:
    """Process what is there now, then stop; returns what was written.

    ``continuous`` lets a source's own bound of a trigger hold, as message_log's ``most``; otherwise the source decides how many triggers it takes.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).queryName(name)
    if continuous:
        query = writer.start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def drain_messages(spark: SparkSession, log: str, checkpoint: str, path: str, n: int, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Take the next ``n`` messages of a log (fewer if there are no more), wherever its files end, and write what ``work`` makes of them.

    The next call with this checkpoint goes on behind them. Returns all that was written so far.
    """
    until = consumed(spark, checkpoint) + n
    return drain(work(log_stream(spark, log, until=until)), path.rstrip("/").rsplit("/", 1)[-1], checkpoint, path)
