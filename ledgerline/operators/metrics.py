"""Measures of tables and runs, and their comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ordered import prefix_sums, stable
from ledgerline.functions.scalar import classify_delta, pct_delta


def table_profile(items: DataFrame, by: str, key: str, size: Column) -> DataFrame:
    """Rows, bytes, distinct keys and the share of the hottest key, by table or tenant."""
    per = items.groupBy(by, key).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    out = per.groupBy(by).agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.count(key).alias("n_keys"), F.max("n").alias("hottest"))
    return out.withColumn("hot_share", F.col("hottest") / F.col("n_rows"))


def approximate_profile(items: DataFrame, by: str, key: str) -> DataFrame:
    """Distinct keys by sketch, for tables whose keys are too many to group by."""
    return items.groupBy(by).agg(F.count("*").alias("n_rows"), F.approx_count_distinct(key).alias("n_keys"))


#: Counters of a sketch of frequent keys; a key that holds more than the inverse of its share of a group is always among them.
COUNTERS = 1024


def _frequent(counters: int):
    """Each task's candidates for frequent (by, key): the keys of each group that counters are left with (Misra-Gries), in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, dict] = {}
        kinds = None
        for batch in batches:
            kinds = batch.schema
            counts = pa.TableGroupBy(pa.Table.from_batches([batch]), ["by", "key"]).aggregate([("n", "sum")])
            for group, key, n in zip(*(counts.column(c).to_pylist() for c in ("by", "key", "n_sum"))):
                mine = held.setdefault(group, {})
                mine[key] = mine.get(key, 0) + n
                if len(mine) > 2 * counters:
                    # What a whole set of counters shares goes from each: no key loses more than the group's rows over the counters.
                    least = sorted(mine.values(), reverse=True)[counters]
                    held[group] = {k: v - least for k, v in mine.items() if v > least}
        if kinds is not None:
            flat = [(g, k, n) for g, mine in held.items() for k, n in mine.items()]
            yield pa.record_batch([pa.array([x[i] for x in flat], kinds.field(c).type) for i, c in enumerate(("by", "key", "n"))], names=["by", "key", "n"])

    return run


def hot_keys(items: DataFrame, by: str, key: str, share: float = 0.01, counters: int = COUNTERS) -> DataFrame:
    """(by, n_rows, hot_key, hottest, hot_share): the most frequent key of each group, wherever one holds more than ``share`` of it.

    Without a group for each key: every task keeps ``counters`` counters a group and passes on the keys that are left, among which is every key that
    holds more than 1 / counters of the task's rows; one that holds ``share`` of the group does so in some task. These candidates are then counted
    exactly. Ties go to the smaller key; groups without such a key have nulls. Null keys count as a group's rows, but aren't keys. Groups
    are to be few (tables, tenants), as each task holds counters for every one it meets.
    """
    if not 1 / counters < share <= 1:
        raise ValueError("a share must be above 1 / counters")
    pairs = items.where(F.col(key).isNotNull()).select(F.col(by).alias("by"), F.col(key).alias("key"), F.lit(1).cast("bigint").alias("n"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    likely = pairs.mapInArrow(_frequent(counters), kinds).select(F.col("by").alias("__by"), F.col("key").alias("__key")).distinct()
    counted = pairs.join(likely, F.col("by").eqNullSafe(F.col("__by")) & (F.col("key") == F.col("__key")), "left_semi").groupBy("by", "key").agg(F.count("*").alias("n"))
    best = counted.groupBy("by").agg(F.max(F.col("n")).alias("hottest"), F.min_by("key", F.struct(-F.col("n"), F.col("key"))).alias("hot_key"))
    totals = items.groupBy(F.col(by).alias("__of")).agg(F.count("*").alias("n_rows"))
    out = totals.join(best, F.col("__of").eqNullSafe(F.col("by")), "left").drop("by")
    enough = F.col("hottest") > share * F.col("n_rows")
    return out.select(F.col("__of").alias(by), "n_rows", F.when(enough, F.col("hot_key")).alias("hot_key"), F.when(enough, F.col("hottest")).alias("hottest"), F.when(enough, F.col("hottest") / F.col("n_rows")).alias("hot_share"))


def capacity_estimate(profiles: DataFrame, target: int) -> DataFrame:
    """Logical and physical bytes of ``target`` items, from (logical_bytes, observed_bytes, n_rows) by table."""
    mean = F.col("logical_bytes") / F.col("n_rows")
    ratio = (F.col("observed_bytes") / F.col("n_rows")) / mean
    return profiles.select("*", mean.alias("mean_bytes"), (mean * target).alias("logical_total"), ratio.alias("physical_ratio"), (mean * target * ratio).alias("physical_total"))


def batch_counters(results: DataFrame) -> DataFrame:
    """Totals of per-batch results (batch, items, failed)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return results.agg(
        F.count("*").alias("batches"),
        zero(F.sum("items")).alias("items"),
        F.count_if(F.col("failed")).alias("failed_batches"),
        zero(F.sum(F.when(F.col("failed"), F.col("items")))).alias("failed_items"),
    )


#: Size of a sketch of a group's values; by how much of the group a rank is looked for on either side of its estimate, some three
#: times the sketch's error; and the steps of ranks that a sketch is asked for.
SKETCH, MARGIN, GRID = 2048, 0.005, 400


def at_places(df: DataFrame, by: list[str], values: list[str], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, name...) of each group: the values (a struct) at 1-based places among its sorted rows.

    A place is a function of the group's number of rows. Rows with a null value are left out. A mergeable sketch of each group's first value
    brackets every place; rows below a bracket are counted, and only the rows inside are counted by value and put in
    order, some hundredth of the group. So no task holds or sorts a group. Should a sketch be further off (or values be NaN, which it leaves
    out), that group's values are all put in order.
    """
    keys, names = [f"__by_{i}" for i in range(len(by))], list(places)
    rows = df.where(reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in values]))
    rows = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[F.col(v).alias(f"__v_{v}") for v in values], F.col(values[0]).cast("double").alias("__d"))
    sketched = rows.groupBy(*keys).agg(F.count("*").alias("__total"), F.kll_sketch_agg_double("__d", F.lit(SKETCH)).alias("__sketch"))
    groups = sketched.select(*keys, "__total", "__sketch", *[place(F.col("__total")).cast("bigint").alias(f"__at_{n}") for n, place in places.items()])

    # Quantiles at GRID + 1 even ranks; none of a sketch without numbers.
    grid = F.when(F.kll_sketch_get_n_double("__sketch") > 0, F.kll_sketch_get_quantile_double("__sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])))
    groups = groups.withColumn("__grid", grid)

    def edge(name: str, side: int, none: float) -> Column:
        """A bracket's end; none where it is all the way to the group's end."""
        q = (F.col(f"__at_{name}") - 0.5) / F.col("__total") + side * MARGIN
        step = F.floor(q * GRID) if side < 0 else F.ceil(q * GRID)
        return F.when((step > 0) & (step < GRID), F.get("__grid", step.cast("int"))).otherwise(F.lit(none))

    # NaN is above all numbers.
    bounds = [e for n in names for e in (edge(n, -1, float("-inf")).alias(f"__low_{n}"), edge(n, 1, float("nan")).alias(f"__high_{n}"))]
    # One row a group.
    groups = stable(groups.select(*keys, "__total", *[f"__at_{n}" for n in names], *bounds))
    of = groups.select(*[F.col(k).alias(f"{k}_of") for k in keys], *[c for c in groups.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys])
    met = rows.join(of, same)
    below = met.groupBy(*keys).agg(*[F.count_if(F.col("__d") < F.col(f"__low_{n}")).alias(f"__below_{n}") for n in names])
    here = F.array_compact(F.array(*[F.when((F.col("__d") >= F.col(f"__low_{n}")) & (F.col("__d") <= F.col(f"__high_{n}")), F.lit(n)) for n in names]))
    inside = met.select(*keys, F.explode(here).alias("__name"), *[f"__v_{v}" for v in values])
    # One row a group and place.
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col(f"__at_{n}") - F.col(f"__below_{n}")).alias("at")) for n in names]))
    below = below.select(*[F.col(k).alias(f"{k}_of") for k in keys], *[f"__below_{n}" for n in names])
    wanted = groups.join(below, same).select(*keys, at.alias("__w")).select(*keys, F.col("__w.name").alias("__name"), F.col("__w.at").alias("at"))
    found = _at_sorted(inside, [*keys, "__name"], [f"__v_{v}" for v in values], wanted)
    row = F.struct(*[F.col(f"__v_{v}").alias(v) for v in values])
    picked = stable(found.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, row)).alias(f"__r_{n}") for n in names]))
    of = picked.select(*[F.col(k).alias(f"{k}_of") for k in keys], *[f"__r_{n}" for n in names])
    out = groups.join(of, same, "left")
    missed = reduce(lambda a, b: a | b, [F.col(f"__r_{n}").isNull() for n in names])
    result = lambda df: df.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.col("__total").alias("n"), *[F.col(f"__r_{n}").alias(n) for n in names])
    again = out.where(missed).select(*keys, "__total", *[f"__at_{n}" for n in names])
    if again.isEmpty():
        return result(out)
    whole = again.select(*[F.col(k).alias(f"{k}_of") for k in keys])
    some = rows.join(whole, same, "left_semi")
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"__at_{n}").alias("at")) for n in names]))
    wanted = again.select(*keys, at.alias("__w")).select(*keys, F.col("__w.name").alias("__name"), F.col("__w.at").alias("at"))
    every = some.select(*keys, F.explode(F.array(*map(F.lit, names))).alias("__name"), *[f"__v_{v}" for v in values])
    found = _at_sorted(every, [*keys, "__name"], [f"__v_{v}" for v in values], wanted)
    exact = found.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, row)).alias(f"__r_{n}") for n in names])
    of = exact.select(*[F.col(k).alias(f"{k}_of") for k in keys], *[f"__r_{n}" for n in names])
    return result(out.where(~missed)).union(result(again.join(of, same)))


def _at_sorted(rows: DataFrame, keys: list[str], values: list[str], wanted: DataFrame) -> DataFrame:
    """Rows (keys, values) at the places that ``wanted`` (keys, at: from 1) names in each group's order by values; none where a group is shorter.

    Rows are counted by value and the counts summed up over all groups, so no task holds a group.
    """
    counts = rows.groupBy(*keys, *values).agg(F.count("*").alias("__n"))
    upto = prefix_sums(counts, [*keys, *values], __upto=F.col("__n"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys])
    starts = upto.groupBy(*keys).agg(F.min(F.col("__upto") - F.col("__n")).alias("__start")).select(*[F.col(k).alias(f"{k}_of") for k in keys], "__start")
    places = wanted.join(starts, same).select(*[F.col(f"{k}_of") for k in keys], (F.col("__start") + F.col("at")).alias("__place"))
    return upto.join(places, same & (F.col("__place") > F.col("__upto") - F.col("__n")) & (F.col("__place") <= F.col("__upto"))).select(*keys, *values)


def nearest_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """(by, n, name...): the value at ceil(q * n) of each group, for each named q."""
    places = {name: lambda n, q=q: F.greatest(F.lit(1), F.ceil(n * F.lit(q))) for name, q in ranks.items()}
    return at_places(df, by, [value], places).select(*by, "n", *[F.col(name)[value].alias(name) for name in ranks])


def latency_metrics(samples: DataFrame, by: list[str], value: str, segment: str) -> DataFrame:
    """Count, mean, nearest-rank percentiles, and the slowest segment of each group that has samples."""
    plain = samples.where(F.col(value).isNotNull()).groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(
        F.avg(value).alias("mean"), F.max(value).alias("slowest"), F.max_by(segment, F.struct(value, segment)).alias("slowest_segment")
    )
    ranks = nearest_ranks(samples, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by])
    return ranks.join(plain, same).select(*by, "n", "mean", "p50", "p95", "p99", "slowest", "slowest_segment")


def throughput_metric(df: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Rates of (scanned, returned, bytes) totals; 0 without time."""
    per = lambda c: F.when(F.col(seconds) == 0, F.lit(0.0)).otherwise(F.col(c) / F.col(seconds))
    return df.select("*", per("scanned").alias("scanned_per_s"), per("returned").alias("returned_per_s"), (per("bytes") / (1 << 20)).alias("mib_per_s"))


def repeat_summary(runs: DataFrame, by: list[str], value: str = "records_per_second", order: str = "run") -> DataFrame:
    """The median run of each configuration and the spread of its runs, in percent of the median.

    Runs are ordered by value, then name; of an even number the upper middle one counts. Runs without a value or name are left out.
    """
    middle = at_places(runs, by, [value, order], {"m": lambda n: F.floor(n / 2) + 1, "low": lambda n: F.lit(1), "high": lambda n: n})
    out = middle.select(
        *by, "n", F.col("m")[order].alias("median_run"), F.col("m")[value].alias("median"), F.col("high")[value].alias("most"), F.col("low")[value].alias("least")
    )
    return out.withColumn("spread", F.when(F.col("median") == 0, F.lit(0.0)).otherwise((F.col("most") - F.col("least")) / F.col("median") * 100))


def balanced_runs(runs: DataFrame, by: str = "kind") -> DataFrame:
    """Totals over order-balanced repeats; capacity is null unless every run reported it."""
    return runs.groupBy(by).agg(
        F.count("*").alias("n"), F.sum("elapsed").alias("elapsed"), F.avg("n_rows").alias("mean_rows"), F.when(F.bool_and(F.col("capacity").isNotNull()), F.sum("capacity")).alias("capacity")
    )


def elapsed_ratio(balanced: DataFrame, above: str, below: str, by: str = "kind") -> DataFrame:
    pick = lambda k: F.max(F.when(F.col(by) == k, F.col("elapsed")))
    return balanced.agg((pick(above) / pick(below)).alias("ratio"))


def segment_progress(checkpoints: DataFrame, by: str = "run", order: str = "at") -> DataFrame:
    """Completed segments, rows and rate as segments finish."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = checkpoints.withColumn("completed", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("bigint")).withColumn("scanned_total", F.sum("scanned").over(w))
    return out.withColumn("rate", F.when(F.col(order) == 0, F.lit(0.0)).otherwise(F.col("scanned_total") / F.col(order)))


def compare_runs(runs: DataFrame, sweep: str, order: str, value: str = "records_per_second", threshold: float = 5.0) -> DataFrame:
    """Change against the run before in its sweep, and what it means."""
    before = F.lag(value).over(Window.partitionBy(sweep).orderBy(order))
    delta = F.when(before.isNull(), F.lit(None)).otherwise(pct_delta(F.col(value), before))
    out = runs.withColumn("delta", delta)
    return out.withColumn("verdict", classify_delta("delta", threshold))


def compare_pair(before: DataFrame, after: DataFrame, metrics: dict[str, bool], threshold: float = 5.0, method: tuple[str, ...] = ()) -> DataFrame:
    """Metric by metric of two one-row measures; metrics: name -> higher is better. Other methods are an error."""
    def long(df: DataFrame, name: str) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name), F.lit(up).alias("up")) for m, up in metrics.items()]))
        return df.select(*[F.col(m).alias(f"{name}_{m}") for m in method], rows.alias("x")).select("x.*", *[f"{name}_{m}" for m in method])

    a, b = long(before, "old"), long(after, "new").drop("up")
    joined = a.join(b, "metric")
    for m in method:
        joined = joined.where(F.when(F.col(f"old_{m}").eqNullSafe(F.col(f"new_{m}")), True).otherwise(F.raise_error(F.lit("the runs' methods differ")).cast("boolean")))
    out = joined.withColumn("delta", pct_delta("new", "old"))
    return out.select("metric", "old", "new", "delta", classify_delta("delta", threshold, F.col("up")).alias("verdict"))


def pair_verdict(compared: DataFrame) -> DataFrame:
    worse, better = F.bool_or(F.col("verdict") == "REGRESSION"), F.bool_or(F.col("verdict") == "IMPROVEMENT")
    return compared.agg(F.when(worse, "REVIEW_REQUIRED").when(better, "IMPROVEMENT").otherwise("NEUTRAL").alias("verdict"))


def rounded_percentiles(df: DataFrame, by: str, value: str, p: float, to: str) -> DataFrame:
    """Value at round((n - 1) * p), half to even, of each group's n values that aren't null."""
    found = at_places(df, [by], [value], {to: lambda n: F.bround((n - 1) * F.lit(p)) + 1})
    return found.select(by, F.col(to)[value].alias(to))
