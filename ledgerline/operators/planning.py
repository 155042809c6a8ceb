"""Planning a bounded change set: dedup, sequence, budgets, seal, canary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ordered import dense_sequence, prefix_sums
from ledgerline.functions.scalar import sha256_hex, stable_id

#: Calls that a dispatch reserves.
RESERVED_CALLS = 2
#: Hex digits of a key's hash that name a plan's least buckets, and by how many digits buckets merge.
SEAL_DIGITS, SEAL_STEP = 6, 3


def dedup_candidates(df: DataFrame, key: str = "record_key", by: str | None = "job", order: tuple[str, ...] = ("segment", "page", "position")) -> DataFrame:
    """The first candidate of each key, by scan position; rows that repeat a position are equal."""
    keys = [c for c in (by, key) if c]
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__first"))
    return first.select(*keys, "__first.*").select(*df.columns)


def assign_sequence(df: DataFrame, order: str = "record_key") -> DataFrame:
    return dense_sequence(df, [order], "seq")


def record_budget(df: DataFrame, max_records: int, page: str = "page_no") -> DataFrame:
    """Rows of the leading pages that fit; the first page that doesn't ends the plan."""
    counts = df.groupBy(page).agg(F.count("*").alias("__n"))
    running = prefix_sums(counts, [page], __sum=F.col("__n"))
    fits = running.where(F.col("__sum") <= max_records).select(page)
    return df.join(fits, page, "left_semi")


def read_budget(pages: DataFrame, max_scanned: int, max_capacity: float, order: str = "page_no") -> DataFrame:
    """Pages with running usage; use counts first, so the page that passes a budget is charged but not committed."""
    running = prefix_sums(pages, [order], used_scanned=F.col("scanned"), used_capacity=F.col("capacity"))
    over = (F.col("used_scanned") > max_scanned) | (F.col("used_capacity") > max_capacity)
    cut = running.where(over).agg(F.min(order).alias("__cut"))
    marked = running.join(F.broadcast(cut), F.lit(True))
    charged = F.col("__cut").isNull() | (F.col(order) <= F.col("__cut"))
    return marked.where(charged).withColumn("committed", F.col("__cut").isNull() | (F.col(order) < F.col("__cut"))).drop("__cut")


def call_budget(tasks: DataFrame, max_calls: int, order: str = "seq") -> DataFrame:
    """The first tasks, which may be dispatched when each reserves its calls, with the calls reserved by then."""
    first = dense_sequence(tasks.orderBy(order).limit(max(0, max_calls) // RESERVED_CALLS), [order], "__n")
    return first.withColumn("calls", F.col("__n") * RESERVED_CALLS).drop("__n")


def _framed(c: Column | str) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat(F.lpad(F.lower(F.hex(F.length(c))), 8, "0"), c)


def seal_plan(df: DataFrame, request: str, version: str, identity: str, key: str = "record_key", payload: str = "payload") -> DataFrame:
    """(hash, n): digest of a request and its candidates, each field preceded by its length.

    A candidate's digest is one line; digests of one bucket (the first digits of the key's hash) are sorted and
    digested, and buckets merge by SEAL_STEP digits at a time to the root. A bucket of ten billion candidates' plan holds
    some 600 of them, and a merge 4,096 buckets at most, so no task holds the plan.
    """
    line = sha256_hex(F.concat(_framed(key), _framed(payload)))
    level = df.select(F.substring(sha256_hex(F.coalesce(F.col(key), F.lit(""))), 1, SEAL_DIGITS).alias("b"), line.alias("h"), F.lit(1).cast("bigint").alias("n"))
    for digits in range(SEAL_DIGITS, -1, -SEAL_STEP):
        merged = sha256_hex(F.array_join(F.sort_array(F.collect_list("h")), ""))
        level = level.groupBy(F.substring("b", 1, digits).alias("b")).agg(merged.alias("h"), F.sum("n").alias("n"))
        if digits:
            # A bucket's name counts, so that equal digests of two buckets differ.
            level = level.withColumn("h", F.concat("b", "h"))
    head = F.concat(_framed(F.lit(request)), _framed(F.lit(version)), _framed(F.lit(identity)))
    root = level.agg(F.max("h").alias("h"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return root.select(sha256_hex(F.concat(head, F.coalesce("h", F.lit("")))).alias("hash"), "n")


def verify_plan(df: DataFrame, expected: str, request: str, version: str, identity: str, **columns) -> DataFrame:
    return seal_plan(df, request, version, identity, **columns).select("hash", "n", (F.col("hash") == expected).alias("approved"))


def propose(df: DataFrame, rule: str) -> DataFrame:
    """Action with the attributes before and after; repair settles and raises the version, inventory only reads."""
    text = lambda c: F.col(c).cast("string")
    before = F.create_map(F.lit("status"), text("status"), F.lit("version"), text("version"))
    if rule == "repair":
        after = F.create_map(F.lit("status"), F.lit("SETTLED"), F.lit("version"), (F.col("version") + 1).cast("string"))
        action = "UPDATE"
    elif rule == "compensate":
        after = F.create_map(F.lit("status"), text("opsPreviousStatus"), F.lit("version"), (F.col("version") + 1).cast("string"))
        action = "UPDATE"
    elif rule == "inventory":
        after, action = before, "READ_ONLY"
    else:
        raise ValueError(f"no such rule: {rule}")
    return df.withColumn("action", F.lit(action)).withColumn("before", before).withColumn("after", after)


#: Calls that each rule makes for a candidate (fixed values).
CALLS = {"repair": 9, "consume": 3, "replay": 3, "inventory": 0, "compensate": 2}


#: What a rule's run may meet (fixed values are the rules' own; these are the library's wording).
RISKS = {
    "repair": ("items may change between plan and run", "a published event may arrive more than once"),
    "compensate": ("items touched since the repair are left", "only data is compensated, not events"),
    "consume": ("a lease may end before its acknowledgement",),
    "replay": ("a destination may get a message twice after its dedup state has ended",),
    "inventory": (),
}


def dry_run_summary(candidates: DataFrame, scanned: int, rule: str, sample: int = 10, order: str = "record_key", resources: tuple[str, ...] = (), read_units: float = 0.0) -> DataFrame:
    """One row on what a run would touch, from the plan and what planning read.

    located, candidates, ignored, proposed_changes, estimated_calls; usage (scanned, read_units); resources and risks; and
    samples, the first proposals by ``order`` with masked keys.
    """
    counts = candidates.agg(F.count("*").alias("candidates"), F.count_if(F.lit(rule != "inventory")).alias("proposed_changes"))
    located = F.greatest(F.lit(scanned).cast("bigint"), F.col("candidates"))
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    # ``sample`` rows.
    proposals = sample_proposals(propose(candidates, rule), sample, order).select(F.col(order).alias("at"), stable_id(order).alias("record"), "action", "before", "after")
    sampled = proposals.agg(F.sort_array(F.collect_list(F.struct("at", "record", "action", F.to_json("before").alias("before"), F.to_json("after").alias("after")))).alias("s"))
    shown = F.transform("s", lambda x: F.struct(x["record"].alias("record"), x["action"].alias("action"), x["before"].alias("before"), x["after"].alias("after")))
    return counts.join(F.broadcast(sampled), F.lit(True)).select(
        located.alias("located"),
        "candidates",
        F.greatest(F.lit(0), located - F.col("candidates")).alias("ignored"),
        "proposed_changes",
        (F.col("candidates") * CALLS[rule]).alias("estimated_calls"),
        F.struct(F.lit(scanned).cast("bigint").alias("scanned"), F.lit(float(read_units)).alias("read_units")).alias("usage"),
        texts(resources).alias("resources"),
        texts(RISKS[rule]).alias("risks"),
        shown.alias("samples"),
    )


def sample_proposals(candidates: DataFrame, n: int, order: str = "seq") -> DataFrame:
    return candidates.orderBy(order).limit(n)


def plan_view(proposals: DataFrame, after: int, limit: int, key: str = "record_key") -> DataFrame:
    """A page of proposals with masked keys."""
    page = proposals.where(F.col("seq") > after).orderBy("seq").limit(limit)
    return page.withColumn(key, stable_id(key))


def canary_split(tasks: DataFrame, n: int, promoted: bool = False, order: str = "seq") -> DataFrame:
    """RUN for the first tasks, or all once promoted; the rest stay PLANNED."""
    go = F.lit(True) if promoted else F.col(order) <= n
    return tasks.withColumn("decision", F.when(go, "RUN").otherwise("PLANNED"))


def canary_state(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.when(F.count_if(F.col("decision") == "PLANNED") == 0, "COMPLETED").otherwise("CANARY_COMPLETE").alias("state"))


ERRORS = ("FAILED", "FUNCTION_ERROR", "BUSINESS_REJECTED", "ERROR")


def budget_use(outcomes: DataFrame, order: str = "seq") -> DataFrame:
    """``outcomes`` with running counts of done tasks, conflicts and errors, the task itself included."""
    return prefix_sums(
        outcomes,
        [order],
        done=F.lit(1).cast("bigint"),
        conflicts=F.when(F.col("outcome") == "CONFLICT", 1).otherwise(0).cast("bigint"),
        errors=F.when(F.col("outcome").isin(*ERRORS), 1).otherwise(0).cast("bigint"),
    )


def trips(max_conflicts: int, max_errors: int, max_rate: float, min_sample: int, done: int = 0, conflicts: int = 0, errors: int = 0) -> Column:
    """Whether running counts pass a budget, when so many tasks went before."""
    d, c, e = F.col("done") + done, F.col("conflicts") + conflicts, F.col("errors") + errors
    return (c > max_conflicts) | (e > max_errors) | ((d >= min_sample) & (e / d > max_rate))


def apply_error_budget(outcomes: DataFrame, max_conflicts: int, max_errors: int, max_rate: float, min_sample: int, order: str = "seq") -> DataFrame:
    """Tasks with their state after the budgets: the one that trips a budget is still DONE, later ones stay PLANNED."""
    running = budget_use(outcomes, order)
    cut = running.where(trips(max_conflicts, max_errors, max_rate, min_sample)).agg(F.min(order).alias("__cut"))
    ok = F.col("__cut").isNull() | (F.col(order) <= F.col("__cut"))
    # One row.
    return running.join(F.broadcast(cut), F.lit(True)).withColumn("state", F.when(ok, "DONE").otherwise("PLANNED")).drop("__cut")


def idempotent_request(requests: DataFrame, key: str = "idempotency_key", fields: tuple[str, ...] = ("type", "payload"), order: tuple[str, ...] = ("created", "request_id")) -> DataFrame:
    """Each request's decision: ACCEPTED for the first of a key, SAME if it repeats it, REJECTED if it differs."""
    print_of = sha256_hex(F.concat_ws("\u0001", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    marked = requests.withColumn("fingerprint", print_of)
    first = marked.groupBy(key).agg(F.min(F.struct(*order, "fingerprint")).alias("__first"))
    at = F.struct(*order)
    same_row = at == F.struct(*[F.col(f"__first.{c}").alias(c) for c in order])
    decision = F.when(same_row, "ACCEPTED").when(F.col("fingerprint") == F.col("__first.fingerprint"), "SAME").otherwise("REJECTED")
    return marked.join(first, key).withColumn("decision", decision).drop("__first")


def top_pending(tasks: DataFrame, n: int, order: str = "seq") -> DataFrame:
    return tasks.where(F.col("state") == "PLANNED").orderBy(order).limit(n)


def contiguity(chunks: DataFrame, total: int, page: int) -> DataFrame:
    """Chunks of each job with whether their cursor follows the one before."""
    before = F.lag("cursor", 1, 0).over(Window.partitionBy("job").orderBy("cursor"))
    return chunks.withColumn("follows", F.col("cursor") == F.least(F.lit(total), before + page))


def check_contiguity(chunks: DataFrame, total: int, page: int) -> DataFrame:
    """Chunks as they are; one whose cursor doesn't follow the one before is an error."""
    fine = contiguity(chunks, total, page)
    return fine.where(F.when(F.col("follows"), True).otherwise(F.raise_error(F.lit("a chunk doesn't follow the one before")).cast("boolean"))).drop("follows")
