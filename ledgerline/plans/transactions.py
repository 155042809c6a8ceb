"""Changes of several tables in one commit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import mutate
from ledgerline.sources.commits import VERSION, Tables

OUTBOX = f"eventId string, operationId string, paymentId string, payload string, deliveryState string, version bigint, {VERSION} bigint"


def commit_repair(tables: Tables, confirmations: DataFrame, job_id: str, parent: int | None = None, validations: DataFrame | None = None) -> tuple[int, DataFrame]:
    """Repair the tables' ``items`` and add the events of what was repaired to their ``outbox``, in one version: (version, outcomes).

    Every item is decided once: decisions are written where no reader looks, and the new items, the events and the outcomes are all taken from
    them. ``parent`` is the version that planning read (the newest if None). The items may have moved on since, up to the newest version,
    which then is what changes apply to; what a change no longer meets is a CONFLICT. A writer that commits in between makes
    this one fail with CommitConflict, with nothing changed. A job that has committed already changes nothing and gets its
    outcomes again.
    """
    newest = tables.manifest()
    done = newest["batches"].get(f"repair-{job_id}")
    if done:
        return done, tables.read(f"outcomes-{job_id}", done)
    planned = tables.read("items", parent) if parent is not None else tables.read("items", newest["version"])
    current, outbox = tables.read("items", newest["version"]), tables.read("outbox", newest["version"], OUTBOX)
    token = uuid.uuid4().hex
    decided = tables.staged(tables.stage(mutate.repair_decisions(planned, confirmations, job_id, current, validations=validations, outbox=outbox), token, "decided"))
    outcomes = mutate.decided_outcomes(decided)
    events = mutate.build_outbox(outcomes, job_id).withColumn(VERSION, F.lit(newest["version"] + 1).cast("bigint"))
    parts = {
        "items": [tables.stage(decided.drop("__outcome", "__new_version", "__event"), token, "items")],
        "outbox": [*newest["parts"].get("outbox", []), tables.stage(events, token, "outbox")],
        f"outcomes-{job_id}": [tables.stage(outcomes, token, "outcomes")],
    }
    version = tables.publish(newest["version"], parts, f"repair-{job_id}")
    tables.files.delete(f"{tables.path}/data/{token}/decided")
    return version, tables.read(f"outcomes-{job_id}", version)
