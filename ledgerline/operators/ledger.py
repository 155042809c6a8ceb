"""Read models of a job ledger: counts, status, pages, history, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalar import stable_id
from ledgerline.operators.planning import ERRORS
from ledgerline.operators.segments import keyset_page

TERMINAL = ("DRY_RUN_COMPLETE", "COMPLETED", "CANCELLED", "FAILED")
INTERRUPTED = ("PLANNING", "RUNNING", "APPROVED")


def outcome_counts(tasks: DataFrame) -> DataFrame:
    """Tasks by job and outcome, or by state where there is no outcome yet."""
    label = F.when(F.coalesce(F.col("outcome"), F.lit("")) == "", F.col("state")).otherwise(F.col("outcome"))
    return tasks.groupBy("job", label.alias("label")).agg(F.count("*").alias("n"))


def effect_counts(effects: DataFrame) -> DataFrame:
    return effects.groupBy("job", "state").agg(F.count("*").alias("n"))


def error_conflict_counts(tasks: DataFrame) -> DataFrame:
    """Done tasks, and errors and conflicts among them, by job."""
    done = F.col("state") == "DONE"
    return tasks.groupBy("job").agg(
        F.count_if(done).alias("done"), F.count_if(done & F.col("outcome").isin(*ERRORS)).alias("errors"), F.count_if(done & (F.col("outcome") == "CONFLICT")).alias("conflicts")
    )


def job_summary(jobs: DataFrame, tasks: DataFrame, effects: DataFrame) -> DataFrame:
    """Rates and open effects of each job (job, elapsed)."""
    counts = error_conflict_counts(tasks)
    open_ = effects.groupBy("job").agg(F.count_if(F.col("state").isin("INTENT", "UNKNOWN")).alias("unresolved"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = jobs.join(counts, "job", "left").join(open_, "job", "left")
    rate = F.when(zero("done") == 0, F.lit(0.0)).otherwise(zero("errors") / zero("done"))
    speed = F.when(F.coalesce(F.col("elapsed"), F.lit(0)) == 0, F.lit(0.0)).otherwise(zero("done") / F.col("elapsed"))
    return joined.select(
        "job", zero("done").alias("done"), zero("errors").alias("errors"), zero("conflicts").alias("conflicts"), rate.alias("error_rate"), speed.alias("records_per_second"), zero("unresolved").alias("unresolved"), (zero("unresolved") == 0).alias("reconciled")
    )


def job_totals(jobs: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return jobs.agg(F.count("*").alias("jobs"), zero("calls"), zero("elapsed"))


def usage(pages: DataFrame) -> DataFrame:
    columns = [c for c in ("scanned", "read_units", "retries", "throttles") if c in pages.columns]
    return pages.groupBy("job").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def job_status(jobs: DataFrame, tasks: DataFrame, pages: DataFrame, resources: DataFrame) -> DataFrame:
    """State, masked identity, counts, usage and resources of each job."""
    per = resources.groupBy("job").agg(F.array_join(F.sort_array(F.collect_set("resource")), ",").alias("resources"))
    out = reduce(lambda a, b: a.join(b, "job", "left"), [error_conflict_counts(tasks), usage(pages), per], jobs)
    return out.withColumn("identity", stable_id("identity"))


def latest_effect(effects: DataFrame, prefix: str) -> DataFrame:
    """The last step by name among those with a prefix, of each task."""
    some = effects.where(F.col("step").startswith(prefix))
    return some.groupBy("job", "task").agg(F.max(F.struct("step", "state")).alias("x")).select("job", "task", "x.step", "x.state")


def effect_history(events: DataFrame, order: list[str]) -> DataFrame:
    """The current state of each step, from an append-only log."""
    return events.groupBy("job", "task", "step").agg(F.max(F.struct(*order, "state")).alias("x"), F.count("*").alias("changes")).select("job", "task", "step", "x.state", "changes")


def state_transitions(audit: DataFrame) -> DataFrame:
    """State changes of each job in order, with the seconds until the next one."""
    w = Window.partitionBy("job").orderBy("seq")
    changes = audit.withColumn("previous", F.lag("state").over(w)).where(~F.col("state").eqNullSafe(F.col("previous")))
    return changes.withColumn("seconds", F.lead("time").over(w) - F.col("time"))


def at_start(jobs: DataFrame) -> DataFrame:
    """Jobs as a restart leaves them: what was under way is INTERRUPTED and its approval is revoked."""
    cut = F.col("state").isin(*INTERRUPTED)
    return jobs.withColumn("approved_until", F.when(cut, F.lit(None)).otherwise(F.col("approved_until"))).withColumn("state", F.when(cut, "INTERRUPTED").otherwise(F.col("state")))


def receipt_sequence(receives: DataFrame, most: int = 10) -> DataFrame:
    """Numbered receives of each task, ``most`` at most, and whether it is the newest valid one."""
    w = Window.partitionBy("task").orderBy("received_at", "receipt")
    numbered = receives.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    newest = F.max(F.when(F.col("valid"), F.col("n"))).over(Window.partitionBy("task"))
    return numbered.withColumn("newest", F.coalesce(F.col("n") == newest, F.lit(False)))


def report_rows(tasks: DataFrame) -> DataFrame:
    """All tasks by sequence, with masked keys."""
    return tasks.select(F.col("seq").alias("sequence"), stable_id("record_key").alias("record"), "state", F.coalesce("outcome", F.lit("")).alias("outcome")).orderBy("sequence")


def error_page(tasks: DataFrame, after: int, limit: int) -> DataFrame:
    """The next failed or conflicting tasks, whatever their state."""
    return keyset_page(tasks.where(F.col("outcome").isin(*ERRORS, "CONFLICT")), "seq", after, limit)


def audit_page(audit: DataFrame, after: int, limit: int) -> DataFrame:
    return keyset_page(audit, "seq", after, limit)


def plan_remainder(plan: DataFrame, done: DataFrame, key: str = "record_key") -> DataFrame:
    return plan.join(done.select(key), key, "left_anti")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def expire_payloads(tasks: DataFrame, jobs: DataFrame, cutoff: int) -> DataFrame:
    """Tasks with the payload blanked where their job ended and was created before the cutoff."""
    old = jobs.where(F.col("state").isin(*TERMINAL) & (F.col("created") < cutoff)).select("job", F.lit(True).alias("__old"))
    return tasks.join(old, "job", "left").withColumn("payload", F.when(F.col("__old"), "").otherwise(F.col("payload"))).drop("__old")
