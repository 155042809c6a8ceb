"""User rules and batches, and the run that puts the operators together."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import planning
from ledgerline.operators.access import require_key
from ledgerline.sources.commits import Tables
from ledgerline.sources.shared import new_path


class Rule(Protocol):
    """A change: which rows it takes, what it proposes and what it does, as DataFrame expressions."""

    type: str
    version: str

    def validate(self, request: dict) -> None: ...

    def plan(self, items: DataFrame) -> DataFrame: ...

    def proposal(self, candidates: DataFrame) -> DataFrame: ...

    def execute(self, tasks: DataFrame) -> DataFrame: ...

    def risks(self) -> list[str]: ...

    def calls(self) -> int: ...


@dataclass
class Request:
    """Limits of a run."""

    max_records: int
    canary: int
    page_size: int = 1000
    max_conflicts: int = 10
    max_errors: int = 10
    max_rate: float = 0.05
    min_sample: int = 20
    promoted: bool = False
    #: Tasks of the first wave and of the largest; each wave that stays within the budgets doubles the next one.
    first_wave: int = 100
    largest_wave: int = 1_000_000
    #: Calls that the run may make, by the rule's own count a task; None for any number.
    max_calls: int | None = None


#: Phases after which a run executes nothing more. A complete canary goes on once it is promoted, and so does a run that gets more calls.
ENDED = ("COMPLETED", "BUDGET_EXCEEDED")


def _asked(rule: Rule, name: str, default: Callable) -> Callable:
    """A rule's method; a rule may leave out what it proposes, risks and calls."""
    return getattr(rule, name, default)


def plan_job(rule: Rule, items: DataFrame, request: Request, tables: Tables, identity: str = "") -> dict:
    """Select, dedup, number, budget, seal and store a run's plan, once; returns the run's state.

    The stored plan holds the rule's proposals; its files follow the sequence, so a wave reads only its own part of them.
    """
    old = tables.manifest()
    if "plan" in old["parts"]:
        return old["state"]
    rule.validate(vars(request))
    candidates = require_key(rule.plan(items), "record_key")
    rest = [c for c in candidates.columns if c not in ("record_key", "payload")]
    first = candidates.groupBy("record_key").agg(F.min(F.struct("payload", *rest)).alias("__first")).select("record_key", "__first.*")
    tasks = planning.assign_sequence(first).withColumn("page_no", F.floor((F.col("seq") - 1) / request.page_size).cast("bigint"))
    planned = _asked(rule, "proposal", lambda df: df)(planning.record_budget(tasks, request.max_records))
    token = uuid.uuid4().hex
    part = tables.stage(planned.repartitionByRange("seq").sortWithinPartitions("seq"), token, "plan")
    seal = planning.seal_plan(tables.staged(part), str(sorted(vars(request).items())), rule.version, identity).first()
    state = {"phase": "PLANNED", "rule": rule.type, "hash": seal["hash"], "planned": seal["n"], "risks": list(_asked(rule, "risks", tuple)()), "next": 1, "wave": 0, "size": request.first_wave, "calls": 0, "done": 0, "conflicts": 0, "errors": 0, "cut": None}
    tables.publish(old["version"], {"plan": [part]}, "plan", state)
    return state


def run_waves(rule: Rule, request: Request, tables: Tables, most_waves: int | None = None) -> dict:
    """Execute a stored plan in waves until it, the canary, the calls or an error budget ends; returns the run's state.

    A wave is a run of tasks by sequence. Its outcomes are written, then judged from the totals that the state carries, and
    published with the new totals before the next wave is looked at; so nothing beyond the wave in flight happens after the task that
    trips a budget (the state's ``cut``). A wave within the budgets doubles the next. A call after a stop goes on behind the last
    published wave; one whose outcomes were written whole but not published isn't executed again. Two runners can't publish the
    same wave: the later one fails with CommitConflict.
    """
    waves, calls_each = 0, _asked(rule, "calls", int)()
    while True:
        now = tables.manifest()
        state = dict(now["state"])
        limit = state["planned"] if request.promoted else min(request.canary, state["planned"])
        calls = request.max_calls // calls_each if calls_each and request.max_calls is not None else limit
        if state["phase"] in ENDED or waves == most_waves:
            return state
        if state["next"] > min(limit, calls):
            phase = "COMPLETED" if state["next"] > state["planned"] else "CALLS_EXHAUSTED" if calls < limit else "CANARY_COMPLETE"
            if phase != state["phase"]:
                state["phase"] = phase
                tables.publish(now["version"], {}, None, state)
            return state
        limit = min(limit, calls)
        low, high = state["next"], min(limit, state["next"] + state["size"] - 1)
        name = f"wave-{state['wave'] + 1:08d}"
        tasks = tables.read("plan", now["version"]).where(F.col("seq").between(low, high))
        part = tables.stage(rule.execute(tasks).withColumn("wave", F.lit(state["wave"] + 1)), name, "outcomes")
        used = planning.budget_use(tables.staged(part).select("seq", "outcome"))
        trips = planning.trips(request.max_conflicts, request.max_errors, request.max_rate, request.min_sample, state["done"], state["conflicts"], state["errors"])
        row = used.agg(F.min(F.when(trips, F.col("seq"))).alias("cut"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("done", "conflicts", "errors")]).first()
        state |= {c: state[c] + row[c] for c in ("done", "conflicts", "errors")}
        state |= {"phase": "RUNNING" if row["cut"] is None else "BUDGET_EXCEEDED", "cut": row["cut"], "next": high + 1, "wave": state["wave"] + 1, "calls": state["calls"] + calls_each * row["done"]}
        state["size"] = min(2 * state["size"], request.largest_wave)
        tables.publish(now["version"], {"outcomes": [*now["parts"].get("outcomes", []), part]}, name, state)
        waves += 1


def run_job(rule: Rule, items: DataFrame, request: Request, identity: str = "", path: str | None = None) -> dict[str, DataFrame]:
    """Plan, then execute in waves; a call with the same ``path`` goes on where an earlier one stopped.

    plan holds the proposals; outcomes every executed task, DONE, with after_cut where it was in flight when a budget tripped before it;
    waiting the tasks that stay PLANNED; seal and state one row each.
    """
    spark = items.sparkSession
    tables = Tables(spark, path or new_path(spark, "job"))
    plan_job(rule, items, request, tables, identity)
    state = run_waves(rule, request, tables)
    plan = tables.read("plan")
    outcomes = tables.read("outcomes") if state["wave"] else rule.execute(plan.limit(0)).withColumn("wave", F.lit(0))
    cut = F.lit(state["cut"]).cast("bigint")
    return {
        "plan": plan,
        "seal": spark.createDataFrame([(state["hash"], state["planned"])], "hash string, n bigint"),
        "outcomes": outcomes.withColumn("state", F.lit("DONE")).withColumn("after_cut", F.coalesce(F.col("seq") > cut, F.lit(False))),
        "waiting": plan.where(F.col("seq") >= state["next"]).withColumn("state", F.lit("PLANNED")),
        "state": spark.createDataFrame([(state["phase"], state["wave"], state["done"], state["conflicts"], state["errors"], state["calls"])], "phase string, waves bigint, done bigint, conflicts bigint, errors bigint, calls bigint"),
    }


def process_batches(df: DataFrame, fn: Callable[[pd.DataFrame], int], batch_size: int = 1000) -> DataFrame:
    """A user function over bounded batches: (items, failed, error). A batch that fails doesn't stop later ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                error = None
                try:
                    fn(part)
                except Exception as e:  # noqa: BLE001 - a user's error is a result here
                    error = f"{type(e).__name__}: {e}"[:500]
                yield pd.DataFrame({"items": [len(part)], "failed": [error is not None], "error": [error]})

    return df.mapInPandas(run, "items bigint, failed boolean, error string")
