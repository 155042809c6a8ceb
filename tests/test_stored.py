"""Stored layouts: what is read, and that a base isn't exchanged."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import segments
from ledgerline.sources import stored


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def read_by_scans(df, metric="numFiles"):
    """What the scans of a plan have read, after it ran."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage") or name.startswith("ShuffleQueryStage") or name.startswith("BroadcastQueryStage"):
            todo.append(node.plan())
            continue
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            found.append(metrics.apply(metric).value())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return found


@pytest.fixture(scope="module")
def items(spark):
    n = F.col("id")
    rows = spark.range(4000).select(F.concat(F.lit("k"), n.cast("string")).alias("record_key"), (n % 1500).alias("pk"), n.alias("sk"), F.when(n % 100 == 0, "MATCH").when(n % 7 == 0, F.lit(None)).otherwise("PENDING").alias("status"))
    stored.write_base(rows, "stored_base", 16)
    stored.write_index(rows, "stored_index", "status")
    return rows


def test_few_keys_read_their_buckets(spark, items):
    out = stored.query_stored_index(spark, "stored_index", "stored_base", "status", "MATCH", (100, 400))
    assert sorted(r["sk"] for r in out.collect()) == [100, 200, 300, 400]
    plan = plan_of(out)
    assert "status=MATCH]" in plan  # the index's folder of that value alone
    # Four partition keys lie in four buckets of sixteen at most.
    again = stored.query_stored_index(spark, "stored_index", "stored_base", "status", "MATCH", (100, 400))
    assert 0 < max(read_by_scans(again, "numOutputRows")) <= 4000 * 6 / 16


def test_many_keys_are_joined_without_an_exchange_of_the_base(spark, items):
    out = stored.query_stored_index(spark, "stored_index", "stored_base", "status", "PENDING", (10, 3900), listed=50)
    want = items.where("status = 'PENDING' and sk between 10 and 3900")
    assert sorted(r["record_key"] for r in out.collect()) == sorted(r["record_key"] for r in want.collect())
    plan = plan_of(out).split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # The only exchanges are of the index's keys: the base's columns are in none.
    assert "hashpartitioning" in plan and not [x for x in re.findall(r"Exchange hashpartitioning[^\n]*", plan) if "record_key" in x]
    base = plan.split("stored_base")[0].rsplit("SortMergeJoin", 1)[1]
    assert "Exchange" not in base


def test_entries_that_are_stale(spark, items):
    spark.createDataFrame([("MATCH", 77, 100), ("MATCH", 2, 2), ("MATCH", None, 5)], "status string, pk long, sk long").write.mode("overwrite").partitionBy("status").saveAsTable("stale_index")
    for listed in (1000, 0):
        out = stored.query_stored_index(spark, "stale_index", "stored_base", "status", "MATCH", (0, 999), listed=listed)
        assert [r["sk"] for r in out.collect()] == [2]
    assert stored.query_stored_index(spark, "stale_index", "stored_base", "status", "none", (0, 999)).count() == 0


def test_resume_reads_open_segments_only(spark, items, tmp_path):
    path = f"file://{tmp_path}/segments"
    stored.write_segments(items, path, "record_key", 8)
    rows = segments.with_segment(items, "record_key", 8)
    cursors = segments.cursors_after(rows, 2, 100, "record_key")
    assert cursors.where("completed").count() == 0
    some = cursors.where("segment <> 6").withColumn("completed", F.col("segment").isin(0, 1, 2, 3, 4)).withColumn("cursor", F.when(F.col("segment") != 7, F.col("cursor")))
    out = stored.resume_segments(spark, path, some, "record_key")
    want = segments.resume_after(rows, some, "record_key")
    assert sorted(r["record_key"] for r in out.collect()) == sorted(r["record_key"] for r in want.collect()) and out.count() > 0
    assert set(out.columns) == {*items.columns, "segment"}
    all_files = len({r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()})
    open_files = len({r[0] for r in spark.read.parquet(path).where("segment > 4").select(F.input_file_name()).distinct().collect()})
    assert max(read_by_scans(stored.resume_segments(spark, path, some, "record_key"))) == open_files < all_files
    everything = stored.resume_segments(spark, path, some.limit(0), "record_key")
    assert everything.count() == 4000


def test_first_pages_and_cursors_equal_the_numbered_ones(spark, items):
    rows = segments.with_segment(items, "record_key", 5)
    paged = segments.with_page(rows, 100, "record_key")
    for budget in (1, 7, 9, 50):
        pick = lambda df: sorted(map(tuple, df.select("segment", "record_key", "page").collect()))
        assert pick(segments.first_pages(rows, budget, 100, "record_key")) == pick(segments.page_budget(paged, budget))
        assert sorted(map(tuple, segments.cursors_after(rows, budget, 100, "record_key").collect())) == sorted(map(tuple, segments.segment_cursors(paged, budget, "record_key").collect()))
    plan = plan_of(segments.first_pages(rows, 1, 100, "record_key"))
    assert "WindowGroupLimit" in plan
