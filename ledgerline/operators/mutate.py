"""Conditional changes decided set-wise: every operator gives the new items and the outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalar import event_id, sha256_hex
from ledgerline.operators.access import select_marked

KEY = "record_key"


def version_guard(df: DataFrame, version: str = "version") -> DataFrame:
    """Rows as they are; a missing or negative version is an error."""
    ok = F.coalesce(F.col(version) >= 0, F.lit(False))
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a version is missing or negative")).cast("boolean")))


def unique_changes(changes: DataFrame, key: str = KEY) -> DataFrame:
    """Changes as they are; two for one key are an error, since a join would fan out."""
    n = changes.groupBy(key).agg(F.count("*").alias("__n"))
    checked = n.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("two changes for one key")).cast("boolean"))).select(key)
    return changes.join(checked, key)


def conditional_update(items: DataFrame, changes: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Compare and set. changes: (key, expected_version, expected_status, new_status).

    A row changes only if it is there with that version and status; its version goes up by one. The outcome
    is UPDATED or CONFLICT.
    """
    c = changes.select(F.col(key).alias("__key"), "expected_version", "expected_status", "new_status", F.lit(True).alias("__asked"))
    joined = items.join(c, items[key] == F.col("__key"), "full")
    met = F.col(key).isNotNull() & F.col("__asked") & (F.col("version") == F.col("expected_version")) & (F.col("status") == F.col("expected_status"))
    met = F.coalesce(met, F.lit(False))
    decided = joined.withColumn("__met", met)
    rest = [x for x in items.columns if x not in ("status", "version")]
    new = decided.where(F.col(key).isNotNull()).select(*rest, F.when(F.col("__met"), F.col("new_status")).otherwise(F.col("status")).alias("status"), (F.col("version") + F.when(F.col("__met"), 1).otherwise(0)).alias("version"))
    outcomes = decided.where("__asked").select(F.col("__key").alias(key), F.when(F.col("__met"), "UPDATED").otherwise("CONFLICT").alias("outcome"))
    return new.select(*items.columns), outcomes


def conditional_put(items: DataFrame, new: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Insert what isn't there: CREATED, else CONFLICT."""
    there = items.select(key, F.lit(True).alias("__there"))
    decided = new.join(there, key, "left")
    outcomes = decided.select(key, F.when(F.col("__there").isNull(), "CREATED").otherwise("CONFLICT").alias("outcome"))
    return items.unionByName(decided.where("__there is null").drop("__there"), allowMissingColumns=True), outcomes


def conditional_delete(items: DataFrame, keys: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Delete rows with the expected version: DELETED, else CONFLICT. keys: (key, expected_version)."""
    now = items.select(key, F.col("version").alias("__version"))
    decided = keys.join(now, key, "left").withColumn("outcome", F.when(F.col("__version") == F.col("expected_version"), "DELETED").otherwise("CONFLICT"))
    gone = decided.where("outcome = 'DELETED'").select(key)
    return items.join(gone, key, "left_anti"), decided.select(key, "outcome")


MOST_ACTIONS, MOST_TOKEN = 100, 36
KINDS = ("put", "update", "delete", "check")


def transact(items: DataFrame, actions: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """All-or-nothing groups. actions: (txn, key, kind, expected_version, new_status).

    put needs an absent key; update, delete and check need the expected version. One failing condition cancels
    its group. A group of more than MOST_ACTIONS, an unknown kind, two actions for a key or a
    token longer than MOST_TOKEN is an error. Outcomes: (txn, COMMITTED or CANCELLED, n_actions).
    """
    now = items.select(F.col(key), F.col("version").alias("__v"))
    joined = actions.join(now, key, "left")
    held = F.when(F.col("kind") == "put", F.col("__v").isNull()).otherwise(F.coalesce(F.col("__v") == F.col("expected_version"), F.lit(False)))
    groups = joined.groupBy("txn").agg(
        F.bool_and(held).alias("ok"), F.count("*").alias("n_actions"), F.bool_and(F.col("kind").isin(*KINDS)).alias("known"), F.count_distinct(key).alias("keys")
    )
    valid = (F.col("n_actions") <= MOST_ACTIONS) & F.col("known") & (F.length(F.col("txn").cast("string")) <= MOST_TOKEN) & (F.col("keys") == F.col("n_actions"))
    groups = groups.where(F.when(valid, True).otherwise(F.raise_error(F.lit("not a valid group of actions")).cast("boolean")))
    outcomes = groups.select("txn", F.when(F.col("ok"), "COMMITTED").otherwise("CANCELLED").alias("outcome"), "n_actions")
    done = actions.join(groups.where("ok").select("txn"), "txn", "left_semi").where("kind <> 'check'").select(key, F.col("kind").alias("__kind"), F.col("new_status").alias("__new"))
    old = items.join(done, key, "left").where("__kind is null or __kind = 'update'")
    changed = F.col("__kind").isNotNull()
    old = old.withColumn("status", F.when(changed, F.col("__new")).otherwise(F.col("status"))).withColumn("version", F.when(changed, F.col("version") + 1).otherwise(F.col("version"))).select(*items.columns)
    added = done.where("__kind = 'put'").select(key, F.col("__new").alias("status"), F.lit(1).cast(items.schema["version"].dataType).alias("version"))
    return old.unionByName(added, allowMissingColumns=True), outcomes


MOST_BATCH = 25


def batch_put_delete(items: DataFrame, changes: DataFrame, key: str = KEY, order: str = "position") -> tuple[DataFrame, DataFrame]:
    """Unconditional puts and deletes; the last of a key wins. changes: items' columns, kind, a position in its batch, and
    a batch number if there are several.

    Rows past the size of their batch come back as unprocessed, not hidden.
    """
    within = F.col(order) <= MOST_BATCH
    turn = [c for c in ("batch", order) if c in changes.columns]
    columns = [c for c in changes.columns if c not in (key, *turn)]
    last = changes.where(within).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*turn)).alias("x")).select(key, "x.*")
    kept = items.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("kind = 'put'").select(*[c for c in items.columns if c in last.columns]), allowMissingColumns=True), changes.where(~within)


def enrich(df: DataFrame, confirmations: DataFrame, key: str = KEY) -> DataFrame:
    """Candidates with their confirmation (reference, status, version) and what it allows.

    CONTINUE if it is SETTLED, SKIPPED for another status, REJECTED if there is none or it isn't valid.
    """
    c = confirmations.select(F.col("reference").alias(key), F.col("status").alias("confirmed_status"), F.col("version").alias("confirmed_version"))
    valid = F.col("confirmed_status").isNotNull() & F.coalesce(F.col("confirmed_version") >= 0, F.lit(False))
    verdict = F.when(~valid, "REJECTED").when(F.col("confirmed_status") == "SETTLED", "CONTINUE").otherwise("SKIPPED")
    return df.join(c, key, "left").withColumn("verdict", verdict)


def repair_decisions(items: DataFrame, confirmations: DataFrame, job_id: str, current: DataFrame | None = None, key: str = KEY, validations: DataFrame | None = None, outbox: DataFrame | None = None) -> DataFrame:
    """Every item as it is after a repair, with __outcome (null for those that weren't planned) and __event, the id of what is published.

    See repair(). With an ``outbox`` (eventId), an item whose event is there already is a CONFLICT and isn't changed, so that item and event change
    together or not at all.
    """
    planned = version_guard(items.where("status = 'PENDING'").select(key, F.col("version").alias("__version")), "__version")
    planned = enrich(planned, confirmations, key)
    if validations is not None:
        planned = planned.join(validations.select(key, F.col("verdict").alias("__checked")), key, "left")
    else:
        planned = planned.withColumn("__checked", F.lit(None).cast("string"))
    planned = planned.withColumn("__event", event_id(F.lit(job_id), F.col(key)))
    if outbox is not None:
        planned = planned.join(outbox.select(F.col("eventId").alias("__event")).distinct().withColumn("__sent", F.lit(True)), "__event", "left")
    else:
        planned = planned.withColumn("__sent", F.lit(None).cast("boolean"))
    now = items if current is None else current
    joined = now.join(planned.select(key, "__version", "verdict", "__checked", "__event", "__sent"), key, "left")
    holds = (F.col("verdict") == "CONTINUE") & (F.col("version") == F.col("__version")) & (F.col("status") == "PENDING") & F.col("__sent").isNull()
    decided = joined.withColumn("__met", F.coalesce(holds, F.lit(False)))
    applied = F.when(F.col("__checked").isin("FUNCTION_ERROR", "BUSINESS_REJECTED"), F.col("__checked")).otherwise("REPAIRED")
    outcome = F.when(F.col("__met"), applied).when(F.col("verdict") == "CONTINUE", "CONFLICT").otherwise(F.col("verdict"))
    had = {c: F.col(c) if c in now.columns else F.lit(None).cast("string") for c in ("opsMarker", "opsPreviousStatus")}
    return decided.select(
        *[F.col(c) for c in now.columns if c not in ("status", "version", "opsMarker", "opsPreviousStatus")],
        F.when(F.col("__met"), "SETTLED").otherwise(F.col("status")).alias("status"),
        (F.col("version") + F.when(F.col("__met"), 1).otherwise(0)).alias("version"),
        F.coalesce(F.when(F.col("__met"), F.col("__event")), had["opsMarker"]).alias("opsMarker"),
        F.when(F.col("__met"), F.lit("PENDING")).otherwise(had["opsPreviousStatus"]).alias("opsPreviousStatus"),
        outcome.alias("__outcome"),
        (F.col("version") + 1).alias("__new_version"),
        F.when(F.col("__met"), F.col("__event")).alias("__event"),
    )


def repair(items: DataFrame, confirmations: DataFrame, job_id: str, current: DataFrame | None = None, key: str = KEY, validations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Settle pending items that are confirmed, if they are still as they were read.

    ``current`` is the table as it is when changes apply; a planned version that is missing or negative is an error. Outcomes: REPAIRED,
    SKIPPED, REJECTED, CONFLICT. A repaired item carries a marker job:key and its status before. ``validations`` (key, verdict) are what
    a check of repaired items said: FUNCTION_ERROR and BUSINESS_REJECTED are the outcome then, though the item stays changed;
    ACCEPTED, null and no row leave it REPAIRED.
    """
    decided = repair_decisions(items, confirmations, job_id, current, key, validations)
    return decided.drop("__outcome", "__new_version", "__event"), decided_outcomes(decided, key)


def decided_outcomes(decided: DataFrame, key: str = KEY) -> DataFrame:
    return decided.where("__outcome is not null").select(key, F.col("__outcome").alias("outcome"), F.col("__new_version").alias("new_version"))


def compensate(items: DataFrame, planned: DataFrame, source_job: str, job_id: str, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Give items that a job marked their earlier status back, if nothing has touched them since.

    planned: (key, version, opsMarker, opsPreviousStatus) as planning read them; those that another job marked are no candidates. A
    pre-image other than PENDING, or a version that is missing or below 1, is an error. Outcomes: COMPENSATED_DATA_ONLY, or CONFLICT, also
    for an item that isn't there any more.
    """
    p = select_marked(planned, source_job)
    ok = F.coalesce((F.col("opsPreviousStatus") == "PENDING") & (F.col("version") >= 1), F.lit(False))
    p = p.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a pre-image isn't PENDING or its version is below 1")).cast("boolean")))
    p = p.select(F.col(key).alias("__key"), F.col("version").alias("__version"), F.col("opsMarker").alias("__marker"), F.col("opsPreviousStatus").alias("__status"))
    joined = items.join(p, items[key] == F.col("__key"), "full")
    holds = (F.col("version") == F.col("__version")) & (F.col("opsMarker") == F.col("__marker")) & (F.col("status") == "SETTLED")
    decided = joined.withColumn("__met", F.coalesce(holds, F.lit(False)))
    outcomes = decided.where("__key is not null").select(F.col("__key").alias(key), F.when(F.col("__met"), "COMPENSATED_DATA_ONLY").otherwise("CONFLICT").alias("outcome"))
    new = decided.where(F.col(key).isNotNull()).select(
        *[F.col(c) for c in items.columns if c not in ("status", "version", "opsMarker", "opsPreviousStatus")],
        F.when(F.col("__met"), F.col("__status")).otherwise(F.col("status")).alias("status"),
        (F.col("version") + F.when(F.col("__met"), 1).otherwise(0)).alias("version"),
        F.when(F.col("__met"), event_id(F.lit(job_id), F.col(key))).otherwise(F.col("opsMarker")).alias("opsMarker"),
        F.when(~F.col("__met"), F.col("opsPreviousStatus")).alias("opsPreviousStatus"),
    )
    return new.select(*items.columns), outcomes


def build_outbox(outcomes: DataFrame, job_id: str, outbox: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """Events of the repaired items that the outbox doesn't hold yet."""
    done = outcomes.where("outcome = 'REPAIRED'")
    eid = event_id(F.lit(job_id), F.col(key))
    payload = F.to_json(F.struct(eid.alias("eventId"), F.col(key).alias("paymentId"), F.lit("SETTLED").alias("status"), F.col("new_version").alias("version")))
    events = done.select(eid.alias("eventId"), F.lit(job_id).alias("operationId"), F.col(key).alias("paymentId"), payload.alias("payload"), F.lit("PENDING").alias("deliveryState"), F.col("new_version").alias("version"))
    return events if outbox is None else events.join(outbox.select("eventId"), "eventId", "left_anti")


def mark_outbox(outbox: DataFrame, acks: DataFrame) -> DataFrame:
    """Brokers' message ids on events; DELIVERED once both are known. acks: (eventId, broker, message_id)."""
    ids = acks.groupBy("eventId").agg(*[F.min(F.when(F.col("broker") == b, F.col("message_id"))).alias(f"{b}MessageId") for b in ("sqs", "sns")])
    joined = outbox.drop("sqsMessageId", "snsMessageId").join(ids, "eventId", "left")
    both = F.col("sqsMessageId").isNotNull() & F.col("snsMessageId").isNotNull()
    return joined.withColumn("deliveryState", F.when(both, "DELIVERED").otherwise(F.col("deliveryState")))


def classify_invocation(df: DataFrame) -> DataFrame:
    """Outcome of a response (function_error, status_code, invocation, accepted)."""
    plain = F.when((F.col("status_code") == 202) & (F.col("invocation") == "Event"), "ACCEPTED").when((F.col("status_code") == 204) & (F.col("invocation") == "DryRun"), "PERMISSION_CHECKED")
    body = F.when(F.col("accepted").isNull(), "EXECUTED").when(F.col("accepted"), "ACCEPTED").otherwise("BUSINESS_REJECTED")
    result = F.when(F.coalesce(F.col("function_error"), F.lit("")) != "", "FUNCTION_ERROR").otherwise(F.coalesce(plain, F.when(F.col("status_code") == 200, body), F.lit("FAILED")))
    return df.withColumn("outcome", result)


def classify_http(df: DataFrame, max_attempts: int = 3, longest_wait: int | None = None) -> DataFrame:
    """What a call's status asks for; retries that are used up, or that are to wait longer than ``longest_wait``
    seconds, pause the job. Columns: status_code, attempt (from 1), and retry_after where waits are asked for."""
    code = F.col("status_code")
    spent = F.col("attempt") >= max_attempts
    if longest_wait is not None:
        spent = spent | (F.coalesce(F.col("retry_after"), F.lit(0)) > longest_wait)
    retry = F.when(spent, "PAUSED").otherwise("RETRY")
    return df.withColumn("outcome", F.when(code == 200, "OK").when(code == 401, "AUTHENTICATION").when(code == 403, "AUTHORIZATION").when((code == 429) | (code >= 500), retry).otherwise("REJECT"))


def classify_calls(log: DataFrame, call: str, order: list[str], max_attempts: int = 3, longest_wait: int | None = None) -> DataFrame:
    """classify_http() over a log of calls, with their attempts numbered by ``order`` within a call; a call has few attempts."""
    attempt = F.row_number().over(Window.partitionBy(call).orderBy(*order))
    return classify_http(log.withColumn("attempt", attempt.cast("bigint")), max_attempts, longest_wait)


def reconcile_effects(effects: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unresolved effects (job, task, step, state) against what was observed (job, task, step, found)."""
    e = evidence.select("job", "task", "step", "found")
    open_ = F.col("state").isin("INTENT", "UNKNOWN")
    settled = F.when(F.col("found"), "SUCCEEDED").when(~F.col("found"), "NOT_SENT").otherwise("RECONCILIATION_REQUIRED")
    return effects.join(e, ["job", "task", "step"], "left").withColumn("reconciled", F.when(open_, settled).otherwise(F.col("state"))).drop("found")


def verify_outbox(items: DataFrame, outbox: DataFrame, key: str = KEY) -> DataFrame:
    """Marked items with whether the outbox holds just the event of their marker."""
    o = outbox.select(F.col("eventId").alias("opsMarker"), "paymentId", "payload")
    joined = items.where("opsMarker is not null").join(o, "opsMarker", "left")
    ok = F.coalesce((F.col("paymentId") == F.col(key)) & (F.get_json_object("payload", "$.paymentId") == F.col(key)) & (F.get_json_object("payload", "$.eventId") == F.col("opsMarker")), F.lit(False))
    return joined.select(key, "opsMarker", ok.alias("verified"))


def prior_delivery(effects: DataFrame) -> DataFrame:
    """The earliest task of each delivery step, whose result later ones reuse."""
    first = effects.groupBy("job", "step").agg(F.min("task").alias("owner"))
    return effects.join(first, ["job", "step"]).withColumn("reuses", F.col("task") != F.col("owner"))


def known_delivery_split(messages: DataFrame, processed: DataFrame, id_col: str = "business_id", body: str = "body") -> DataFrame:
    """NEW, DUPLICATE or CONFLICT of messages against processed ids and payload hashes."""
    p = processed.select(F.col("id").alias(id_col), "payloadHash")
    h = sha256_hex(body)
    return messages.join(p, id_col, "left").withColumn("delivery", F.when(F.col("payloadHash").isNull(), "NEW").when(F.col("payloadHash") == h, "DUPLICATE").otherwise("CONFLICT")).drop("payloadHash")
