"""Registered queries of the engine's operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalar as S
from ledgerline.functions.ordered import prefix_sums
from ledgerline.operators import access, ledger, metrics, mutate, planning, quality, segments
from ledgerline.plans import fixtures as fx
from ledgerline.plans.fixtures import with_views
from ledgerline.plans.rules import Request, plan_job, process_batches, run_job, run_waves
from ledgerline.plans.transactions import commit_repair
from ledgerline.sources import items as items_source
from ledgerline.sources import documents, sinks, stored
from ledgerline.sources.commits import Tables
from ledgerline.sources.shared import new_path
from ledgerline.sources.sinks import report_lines, select_columns
from ledgerline.streaming import streams
from ledgerline.streaming.message_log import append_log, log_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Selecting ---------------------------------------------------------------------------------------


@query(with_views("items", body="SELECT record_key, status, version FROM items"))
def scan_project(spark, sf):
    return access.project(fx.items(spark, sf), ["record_key", "status", "version"])


@query(with_views("items", body="SELECT record_key, amount FROM items WHERE status = 'PENDING'"))
def filter_status(spark, sf):
    return access.filter_eq(fx.items(spark, sf), "status", "PENDING").select("record_key", "amount")


@query(with_views("items", body="SELECT count(*) AS examined, count(*) FILTER (status = 'MATCH') AS returned FROM items"))
def filter_counts(spark, sf):
    return access.examined_returned(fx.items(spark, sf), F.col("status") == "MATCH")


@query("SELECT event_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def filter_json_attr(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("doc", F.from_json("props", "k bigint"))
    return access.filter_nested(e, "doc.k", 7).select("event_id", "event_type")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NULL' WHEN event_id % 5 = 1 THEN 'ABSENT' ELSE 'VALUE' END AS k_state FROM events""")
def attr_states(spark, sf):
    doc = F.when(F.col("event_id") % 5 == 0, '{"k": null}').when(F.col("event_id") % 5 == 1, "{}").otherwise(F.col("props"))
    return fx.table(spark, sf, "events").select("event_id", access.attr_state(doc, "k").alias("k_state"))


@query("SELECT event_id, event_id % 3 = 0 AS quarantined FROM events")
def require_type_lenient(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("doc", F.when(F.col("event_id") % 3 == 0, '{"k": "text"}').otherwise(F.col("props")))
    right, wrong = access.require_type(e, "doc", "k", "N", strict=False)
    return right.select("event_id", F.lit(False).alias("quarantined")).union(wrong.select("event_id", F.lit(True)))


@query(with_views("items", body="SELECT record_key, sk FROM items WHERE status = 'PENDING'"))
def require_key_pending(spark, sf):
    return access.select_pending(access.require_key(fx.items(spark, sf), "record_key")).select("record_key", "sk")


@query("SELECT s_name, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def resource_guard(spark, sf):
    s = fx.table(spark, sf, "supplier").withColumn("resource", F.col("s_nationkey"))
    allowed = fx.table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("resource"))
    return access.resource_guard(s, allowed).select("s_name", "s_nationkey")


@query(with_views("items", body="SELECT * FROM items WHERE pk = 77 AND sk % 2 = 0 OR sk = 42"))
def get_item(spark, sf):
    i = fx.items(spark, sf)
    return access.get_item(i, sk=42).union(access.get_item(i, pk=77).where("sk % 2 = 0 and sk <> 42"))


_KEYS = "asked AS (SELECT c_custkey * 17 AS sk FROM customer WHERE c_custkey % 3 = 0)"


@query(with_views("items", more=_KEYS, body="SELECT record_key, sk FROM items WHERE sk IN (SELECT sk FROM asked)"))
def batch_get_found(spark, sf):
    keys = fx.table(spark, sf, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") * 17).alias("sk"))
    return access.batch_get(fx.items(spark, sf), keys, ["sk"])[0].select("record_key", "sk")


@query(with_views("items", more=_KEYS, body="SELECT DISTINCT sk FROM asked WHERE sk NOT IN (SELECT sk FROM items)"))
def batch_get_missing(spark, sf):
    keys = fx.table(spark, sf, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") * 17).alias("sk"))
    return access.batch_get(fx.items(spark, sf), keys, ["sk"])[1]


@query(with_views("items", body="SELECT record_key, sk, amount FROM items WHERE pk = 5 AND sk BETWEEN 100 AND 12000 ORDER BY sk"))
def query_partition(spark, sf):
    return access.query_partition(fx.items(spark, sf), 5, (100, 12000)).select("record_key", "sk", "amount")


@query(with_views("items", body="SELECT record_key, amount FROM items WHERE status = 'MATCH' AND sk BETWEEN 1000 AND 2000"))
def query_index(spark, sf):
    i = fx.items(spark, sf)
    index = access.build_index(i, ["status", "sk"], ["pk", "sk"])
    return access.query_index(index, i, "MATCH", (1000, 2000), ["pk", "sk"]).select("record_key", "amount")


def _stored_index(spark, sf, status: str, sk_range: tuple) -> DataFrame:
    name = new_path(spark, "t").rsplit("-", 1)[1]
    i = fx.items(spark, sf)
    stored.write_base(i, f"base_{name}", 16)
    stored.write_index(i, f"index_{name}", "status")
    return stored.query_stored_index(spark, f"index_{name}", f"base_{name}", "status", status, sk_range).select("record_key", "amount")


@query(with_views("items", body="SELECT record_key, amount FROM items WHERE status = 'MATCH' AND sk BETWEEN 1000 AND 2000"))
def stored_index(spark, sf):
    """Few keys: the index's folder of a status, then only the base's buckets that hold them."""
    return _stored_index(spark, sf, "MATCH", (1000, 2000))


@query(with_views("items", body="SELECT record_key, amount FROM items WHERE status = 'PENDING' AND sk >= 50"))
def stored_index_join(spark, sf):
    """Many keys: dealt to the base's buckets, which stay where they are."""
    return _stored_index(spark, sf, "PENDING", (50, 1 << 60))


@query(with_views("items", more="a AS (SELECT count(*) AS rows_a, CAST(sum(amount) AS BIGINT) AS bytes_a FROM items WHERE pk = 5), b AS (SELECT count(*) AS rows_b, CAST(sum(amount) AS BIGINT) AS bytes_b FROM items WHERE pk > 4 AND pk < 6)", body="SELECT *, rows_a = rows_b AND bytes_a = bytes_b AS same FROM a, b"))
def sql_parity(spark, sf):
    i = fx.items(spark, sf)
    by_sql = access.select_sql(spark, "SELECT * FROM {t} WHERE pk = :pk", {"pk": 5}, t=i)
    return access.access_parity(access.query_partition(i, 5), by_sql, F.col("amount"))


@query("SELECT o_orderkey AS sk FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(spark, sf):
    expected = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sk"))
    actual = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sk"))
    return access.missing_keys(expected, actual, ["sk"])


@query(with_views("items", "confirmations", body="""SELECT i.record_key, CASE WHEN c.status IS NULL THEN 'REJECTED' WHEN c.status = 'SETTLED' THEN 'CONTINUE' ELSE 'SKIPPED' END AS verdict
   FROM items i LEFT JOIN confirmations c ON i.record_key = c.reference"""))
def enrich(spark, sf):
    return mutate.enrich(fx.items(spark, sf), fx.confirmations(spark, sf)).select("record_key", "verdict")


# Segments ----------------------------------------------------------------------------------------

_SEG = "seg AS (SELECT *, CAST(('0x' || substr(md5(record_key), 1, 8)) AS BIGINT) % 16 AS segment FROM items)"
_PAGED = _SEG + ", paged AS (SELECT *, (row_number() OVER (PARTITION BY segment ORDER BY record_key) - 1) // 100 AS page FROM seg)"


def _segmented(spark, sf):
    return segments.with_segment(fx.items(spark, sf), "record_key", 16)


def _paged(spark, sf):
    return segments.with_page(_segmented(spark, sf), 100, "record_key")


@query(with_views("items", more=_SEG, body="SELECT segment, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM seg GROUP BY 1"))
def segment_summary(spark, sf):
    return segments.with_segment(fx.items(spark, sf), "record_key", 16).groupBy("segment").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(with_views("items", more=_PAGED, body="SELECT record_key, segment, page FROM paged WHERE page < 3"))
def page_budget(spark, sf):
    return segments.first_pages(_segmented(spark, sf), 3, 100, "record_key").select("record_key", "segment", "page")


@query(with_views("items", more=_PAGED, body="SELECT segment, max(page) + 1 AS pages, count(*) AS n FROM paged GROUP BY 1"))
def segment_pages(spark, sf):
    return _paged(spark, sf).groupBy("segment").agg((F.max("page") + 1).alias("pages"), F.count("*").alias("n"))


_CUR = _PAGED + """, cur AS (SELECT segment, CASE WHEN max(page) < 9 THEN NULL ELSE max(record_key) FILTER (page < 9) END AS cursor, max(page) < 9 AS completed,
   count(*) FILTER (page < 9) AS examined FROM paged GROUP BY 1)"""


@query(with_views("items", more=_CUR, body="SELECT * FROM cur"))
def segment_cursors(spark, sf):
    return segments.cursors_after(_segmented(spark, sf), 9, 100, "record_key")


@query(with_views("items", more=_CUR, body="SELECT p.record_key, p.segment FROM paged p JOIN cur c USING (segment) WHERE NOT c.completed AND p.record_key > c.cursor"))
def resume_after(spark, sf):
    rows = _segmented(spark, sf)
    return segments.resume_after(rows, segments.cursors_after(rows, 9, 100, "record_key"), "record_key").select("record_key", "segment")


@query(with_views("items", more=_CUR, body="SELECT p.record_key, p.segment, p.status FROM paged p JOIN cur c USING (segment) WHERE segment % 4 <> 1 AND p.record_key > c.cursor"))
def stored_segments(spark, sf):
    """A scan of segments in files of their own, which goes on after its cursors; every fourth segment is complete, and isn't read."""
    path, rows = new_path(spark, "segments"), _segmented(spark, sf)
    stored.write_segments(fx.items(spark, sf), path, "record_key", 16)
    cursors = segments.cursors_after(rows, 9, 100, "record_key").withColumn("completed", F.col("completed") | (F.col("segment") % 4 == 1))
    return stored.resume_segments(spark, path, cursors, "record_key").select("record_key", F.col("segment").cast("bigint").alias("segment"), "status")


@query("SELECT CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(examined) AS BIGINT) AS examined, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(capacity) AS BIGINT) AS capacity, count(*) AS completed FROM (SELECT l_suppkey % 9 AS s, count(DISTINCT l_orderkey) AS pages, count(*) AS examined, count(*) FILTER (l_returnflag = 'A') AS returned, sum(l_linenumber) AS capacity FROM lineitem GROUP BY 1)")
def scan_totals(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    per = li.groupBy(F.col("l_suppkey") % 9).agg(F.count_distinct("l_orderkey").alias("pages"), F.count("*").alias("examined"), F.count_if(F.col("l_returnflag") == "A").alias("returned"), F.sum("l_linenumber").alias("capacity"), F.lit(1).cast("bigint").alias("completed"))
    return segments.scan_summary(per)


@query(with_views("tasks", more="m AS (SELECT seq, record_key FROM tasks WHERE seq > 1000), p AS (SELECT * FROM m ORDER BY seq LIMIT 50)", body="SELECT seq, record_key, (SELECT count(*) FROM m) > 50 AS has_more, (SELECT max(seq) FROM p) AS next_after FROM p"))
def keyset_page(spark, sf):
    return segments.keyset_page(fx.tasks(spark, sf), "seq", 1000, 50).select("seq", "record_key", "has_more", "next_after")


@query(with_views("tasks", more="m AS (SELECT seq, record_key FROM tasks WHERE seq > (SELECT max(seq) - 20 FROM tasks))", body="SELECT seq, record_key, (SELECT count(*) FROM m) > 50 AS has_more FROM m ORDER BY seq LIMIT 50"))
def keyset_last_page(spark, sf):
    t = fx.tasks(spark, sf)
    return segments.keyset_page(t, "seq", t.agg(F.max("seq")).first()[0] - 20, 50).select("seq", "record_key", "has_more")


_SAVED = """s AS (SELECT event_id // 2 AS run, event_id % 2 AS side, user_id % 3 <> 0 AS there, event_type <> 'error' AS valid, CAST(floor(value) AS BIGINT) % 5 AS attempts, user_id % 50 AS elapsed FROM events),
  p AS (SELECT * FROM s WHERE side = 0 AND there), b AS (SELECT * FROM s WHERE side = 1 AND there),
  j AS (SELECT r.run, p.run IS NULL AND b.run IS NULL AS never, coalesce(p.valid, false) AS p_ok, coalesce(b.valid, false) AS b_ok, p.attempts AS pa, p.elapsed AS pe, b.attempts AS ba, b.elapsed AS be FROM (SELECT DISTINCT run FROM s) r LEFT JOIN p USING (run) LEFT JOIN b USING (run)),
  c AS (SELECT *, CASE WHEN NOT p_ok AND NOT b_ok THEN CASE WHEN never THEN 'NONE' ELSE 'LOST' END WHEN NOT p_ok THEN 'BACKUP' WHEN NOT b_ok OR pa > ba OR pa = ba AND pe >= be THEN 'PRIMARY' ELSE 'BACKUP' END AS source FROM j)"""


@query(f"""WITH {_SAVED} SELECT run, source, CASE source WHEN 'PRIMARY' THEN pa WHEN 'BACKUP' THEN ba ELSE 0 END AS attempts, CASE source WHEN 'PRIMARY' THEN pe WHEN 'BACKUP' THEN be ELSE 0 END AS elapsed, source IN ('PRIMARY', 'NONE') AS history_complete FROM c""")
def merge_run_state(spark, sf):
    """Each pair of events is a run: the even one its primary state, the odd one its backup; some were never saved, some can't be read."""
    e = fx.table(spark, sf, "events")
    run = F.floor(F.col("event_id") / 2).cast("bigint").alias("run")
    saved = e.where("user_id % 3 <> 0").select("event_id", run, (F.col("value").cast("bigint") % 5).alias("attempts"), (F.col("user_id") % 50).alias("elapsed"), (F.col("event_type") != "error").alias("valid"))
    first, second = (saved.where(c).drop("event_id") for c in ("event_id % 2 = 0", "event_id % 2 = 1"))
    return segments.merge_run_state(first, second, e.select(run).distinct())


@query(with_views("items", more=_CUR, body="SELECT segment, cursor, completed, 16 AS total, 'items' AS of_table FROM cur"))
def valid_cursors(spark, sf):
    found = segments.segment_cursors(_paged(spark, sf), 9, "record_key").select("segment", "cursor", "completed", F.lit(16).alias("total"), F.lit("items").alias("of_table"))
    return segments.validate_cursors(found, total=16, of_table="items")


@query(with_views("items", more=_PAGED + """, c AS (SELECT segment, page < 9 AS early, count(DISTINCT page) AS pages, count(*) AS examined, count(*) FILTER (status = 'PENDING') AS returned, sum(amount) AS bytes FROM paged GROUP BY 1, 2)""",
   body="SELECT CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(examined) AS BIGINT) AS examined, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(bytes) AS BIGINT) AS bytes, (SELECT count(*) FROM items) = sum(examined) AS completed FROM c"))
def resume_totals(spark, sf):
    """Two attempts of every segment: the first stopped at its page budget, the second ended the segment."""
    attempts = _paged(spark, sf).groupBy("segment", (F.col("page") < 9).alias("early")).agg(
        F.count_distinct("page").alias("pages"), F.count("*").alias("examined"), F.count_if(F.col("status") == "PENDING").alias("returned"), F.sum("amount").alias("bytes"), F.lit(True).alias("completed"), F.lit(1.0).alias("elapsed"), F.lit(True).alias("history_complete")
    )
    return segments.resume_totals(attempts, fx.items(spark, sf).count()).drop("elapsed")


_SHARED = "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (segments > 1) AS shared_keys FROM (SELECT {0}, count(*) AS n, count(DISTINCT segment) AS segments FROM seg GROUP BY 1)"


@query(with_views("items", more=_SEG, body=_SHARED.format("record_key")))
def segment_disjoint(spark, sf):
    return quality.segment_disjoint(segments.with_segment(fx.items(spark, sf), "record_key", 16), ["record_key"])


@query(with_views("items", more=_SEG, body=_SHARED.format("pk")))
def segment_overlap(spark, sf):
    """By a key that isn't the segments' own, keys lie in several of them."""
    return quality.segment_disjoint(segments.with_segment(fx.items(spark, sf), "record_key", 16), ["pk"])


# Planning ----------------------------------------------------------------------------------------

_CAND = "cand AS (SELECT 'job-1' AS job, 'payment-' || l_orderkey AS record_key, l_suppkey % 8 AS segment, l_linenumber AS page, l_partkey AS position, min(l_quantity) AS payload FROM lineitem GROUP BY 1, 2, 3, 4, 5)"


def _candidates(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    c = li.select(F.lit("job-1").alias("job"), F.concat(F.lit("payment-"), F.col("l_orderkey").cast("string")).alias("record_key"), (F.col("l_suppkey") % 8).alias("segment"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("position"), F.col("l_quantity"))
    return c.groupBy("job", "record_key", "segment", "page", "position").agg(F.min("l_quantity").alias("payload"))


@query(f"WITH {_CAND} SELECT job, record_key, segment, page, position, payload FROM (SELECT *, row_number() OVER (PARTITION BY job, record_key ORDER BY segment, page, position) AS rn FROM cand) WHERE rn = 1")
def plan_dedup(spark, sf):
    return planning.dedup_candidates(_candidates(spark, sf)).select("job", "record_key", "segment", "page", "position", "payload")


@query(with_views("items", body="SELECT record_key, row_number() OVER (ORDER BY record_key) AS seq FROM items WHERE status = 'PENDING'"))
def plan_sequence(spark, sf):
    return planning.assign_sequence(access.select_pending(fx.items(spark, sf)).select("record_key"))


@query(with_views("items", more="p AS (SELECT record_key, sk // 37 AS page_no FROM items), c AS (SELECT page_no, sum(count(*)) OVER (ORDER BY page_no) AS s FROM p GROUP BY page_no)", body="SELECT record_key, page_no FROM p WHERE page_no IN (SELECT page_no FROM c WHERE s <= 5000)"))
def record_budget(spark, sf):
    p = fx.items(spark, sf).select("record_key", F.floor(F.col("sk") / 37).cast("bigint").alias("page_no"))
    return planning.record_budget(p, 5000).select("record_key", "page_no")


@query(with_views("scan_pages", more="r AS (SELECT page_no, sum(scanned) OVER w AS us, sum(capacity) OVER w AS uc FROM scan_pages WINDOW w AS (ORDER BY page_no)), k AS (SELECT min(page_no) AS cut FROM r WHERE us > 4000 OR uc > 30000000)",
   body="SELECT page_no, CAST(us AS BIGINT) AS used_scanned, CAST(uc AS BIGINT) AS used_capacity, cut IS NULL OR page_no < cut AS committed FROM r, k WHERE cut IS NULL OR page_no <= cut"))
def read_budget(spark, sf):
    return planning.read_budget(fx.scan_pages(spark, sf), 4000, 30000000).select("page_no", "used_scanned", "used_capacity", "committed")


@query(with_views("tasks", body="SELECT seq, record_key, CAST(2 * row_number() OVER (ORDER BY seq) AS BIGINT) AS calls FROM tasks QUALIFY 2 * row_number() OVER (ORDER BY seq) <= 9001"))
def call_budget(spark, sf):
    return planning.call_budget(fx.tasks(spark, sf), 9001).select("seq", "record_key", "calls")


def _frame(c):
    return f"(lpad(lower(printf('%x', length({c}))), 8, '0') || {c})"


_SEAL = f"""c AS (SELECT substr(sha256(record_key), 1, 6) AS b, sha256({_frame('record_key')} || {_frame('priority')}) AS h FROM items WHERE status = 'PENDING'),
   six AS (SELECT b, b || sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM c GROUP BY b),
   three AS (SELECT substr(b, 1, 3) AS b, substr(b, 1, 3) || sha256(string_agg(h, '' ORDER BY h)) AS h, sum(n) AS n FROM six GROUP BY substr(b, 1, 3)),
   root AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h, CAST(sum(n) AS BIGINT) AS n FROM three)"""
_HEAD = "".join(f" || '{len(x):08x}{x}'" for x in ("repair", "v1", "team"))[4:]
_HASH = f"sha256({_HEAD} || h)"


@query(with_views("items", more=_SEAL, body=f"SELECT {_HASH} AS hash, n FROM root"))
def plan_seal(spark, sf):
    return planning.seal_plan(access.select_pending(fx.items(spark, sf)), "repair", "v1", "team", payload="priority")


@query(with_views("items", more=_SEAL, body=f"SELECT 'sealed' AS plan, {_HASH} AS hash, n, {_HASH} = {_HASH} AS approved FROM root UNION ALL SELECT 'other', {_HASH}, n, {_HASH} = repeat('0', 64) FROM root"))
def plan_verify(spark, sf):
    plan = access.select_pending(fx.items(spark, sf))
    sealed = planning.seal_plan(plan, "repair", "v1", "team", payload="priority").first()["hash"]
    verified = [planning.verify_plan(plan, x, "repair", "v1", "team", payload="priority").select(F.lit(n).alias("plan"), "hash", "n", "approved") for n, x in (("sealed", sealed), ("other", "0" * 64))]
    return verified[0].union(verified[1])


@query(with_views("items", body="SELECT record_key, 'UPDATE' AS action, status AS status_before, 'SETTLED' AS status_after, CAST(version AS VARCHAR) AS version_before, CAST(version + 1 AS VARCHAR) AS version_after FROM items WHERE status = 'PENDING'"))
def proposals(spark, sf):
    p = planning.propose(access.select_pending(fx.items(spark, sf)), "repair")
    return p.select("record_key", "action", *[F.col(s)[c].alias(f"{c}_{s}") for c in ("status", "version") for s in ("before", "after")])


@query(with_views("items", more="p AS (SELECT * FROM items WHERE status = 'PENDING'), s AS (SELECT * FROM p ORDER BY record_key LIMIT 4)", body="""SELECT greatest(20000, count(*)) AS located, count(*) AS candidates, greatest(0, greatest(20000, count(*)) - count(*)) AS ignored, count(*) AS proposed_changes, count(*) * 9 AS estimated_calls,
   CAST(20000 AS BIGINT) AS scanned, 'items,queue' AS resources, (SELECT string_agg(substr(sha256(record_key), 1, 16) || ' UPDATE ' || version || '>' || (version + 1), ',' ORDER BY record_key) FROM s) AS samples FROM p"""))
def dry_run_summary(spark, sf):
    out = planning.dry_run_summary(access.select_pending(fx.items(spark, sf)), 20000, "repair", sample=4, resources=("items", "queue"))
    of = lambda x, side: F.get_json_object(x[side], "$.version")
    shown = F.transform("samples", lambda x: F.concat(x["record"], F.lit(" "), x["action"], F.lit(" "), of(x, "before"), F.lit(">"), of(x, "after")))
    return out.select("located", "candidates", "ignored", "proposed_changes", "estimated_calls", "usage.scanned", F.array_join("resources", ",").alias("resources"), F.array_join(shown, ",").alias("samples"))


@query(with_views("tasks", body="SELECT seq, substr(sha256(record_key), 1, 16) AS record_key FROM tasks WHERE seq > 500 ORDER BY seq LIMIT 40"))
def plan_view(spark, sf):
    return planning.plan_view(fx.tasks(spark, sf).select("seq", "record_key"), 500, 40)


@query(with_views("tasks", body="SELECT seq, CASE WHEN seq <= 1500 THEN 'RUN' ELSE 'PLANNED' END AS decision FROM tasks"))
def canary_split(spark, sf):
    return planning.canary_split(fx.tasks(spark, sf), 1500).select("seq", "decision")


@query(with_views("tasks", more="""r AS (SELECT seq, sum(1) OVER w AS d, sum((outcome = 'CONFLICT')::INT) OVER w AS c, sum((outcome IN ('FAILED','FUNCTION_ERROR','BUSINESS_REJECTED','ERROR'))::INT) OVER w AS e FROM tasks WHERE state = 'DONE' WINDOW w AS (ORDER BY seq)),
   k AS (SELECT min(seq) AS cut FROM r WHERE c > 200 OR e > 900 OR (d >= 5000 AND e / d > 0.5))""", body="SELECT seq, CAST(d AS BIGINT) AS done, CAST(c AS BIGINT) AS conflicts, CAST(e AS BIGINT) AS errors, CASE WHEN cut IS NULL OR seq <= cut THEN 'DONE' ELSE 'PLANNED' END AS state FROM r, k"))
def error_budget_cut(spark, sf):
    done = fx.tasks(spark, sf).where("state = 'DONE'").drop("state")
    return planning.apply_error_budget(done, 200, 900, 0.5, 5000).select("seq", "done", "conflicts", "errors", "state")


@query("""WITH q AS (SELECT event_id AS request_id, 'key-' || (event_id % 3000) AS idempotency_key, event_type AS type, user_id % 2 AS payload, CAST(floor(epoch(ts)) AS BIGINT) AS created FROM events),
  f AS (SELECT *, first_value(type || payload) OVER w AS ft, row_number() OVER w AS rn FROM q WINDOW w AS (PARTITION BY idempotency_key ORDER BY created, request_id))
  SELECT request_id, CASE WHEN rn = 1 THEN 'ACCEPTED' WHEN type || payload = ft THEN 'SAME' ELSE 'REJECTED' END AS decision FROM f""")
def idempotent_requests(spark, sf):
    e = fx.table(spark, sf, "events")
    q = e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("key-"), (F.col("event_id") % 3000).cast("string")).alias("idempotency_key"), F.col("event_type").alias("type"), (F.col("user_id") % 2).alias("payload"), F.unix_timestamp("ts").alias("created"))
    return planning.idempotent_request(q).select("request_id", "decision")


@query(with_views("tasks", body="SELECT seq, record_key FROM tasks WHERE state = 'PLANNED' ORDER BY seq LIMIT 300"))
def pending_tasks(spark, sf):
    return planning.top_pending(fx.tasks(spark, sf), 300).select("seq", "record_key")


@query("SELECT o_custkey AS job, o_orderkey AS cursor, o_orderkey = least(15000, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) + 1000) AS follows FROM orders")
def contiguity(spark, sf):
    chunks = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("cursor"))
    return planning.contiguity(chunks, 15000, 1000)


@query("SELECT o_custkey AS job, CAST(1000 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS cursor FROM orders")
def contiguous_chunks(spark, sf):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    chunks = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("job"), (1000 * place).cast("bigint").alias("cursor"))
    return planning.check_contiguity(chunks, 1 << 40, 1000)


# Changing ----------------------------------------------------------------------------------------

_CHG = "chg AS (SELECT 'payment-' || lpad(CAST(o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 90000000 ELSE 0 END AS VARCHAR), 8, '0') AS record_key, 1 + o_orderkey % 2 AS expected_version, 'PENDING' AS expected_status, 'SETTLED' AS new_status FROM orders WHERE o_orderkey % 5 = 0)"


def _changes(spark, sf):
    k = F.col("o_orderkey")
    shifted = k + F.when(k % 50 == 0, 90000000).otherwise(0)
    return fx.table(spark, sf, "orders").where(k % 5 == 0).select(fx._key(shifted).alias("record_key"), (1 + k % 2).alias("expected_version"), F.lit("PENDING").alias("expected_status"), F.lit("SETTLED").alias("new_status"))


_MET = "i.version = c.expected_version AND i.status = c.expected_status"


@query(with_views("items", more=_CHG, body=f"SELECT i.record_key, CASE WHEN {_MET} THEN new_status ELSE i.status END AS status, CASE WHEN {_MET} THEN i.version + 1 ELSE i.version END AS version FROM items i LEFT JOIN chg c USING (record_key)"))
def conditional_update(spark, sf):
    return mutate.conditional_update(fx.items(spark, sf), mutate.unique_changes(_changes(spark, sf)))[0].select("record_key", "status", "version")


@query(with_views("items", more=_CHG, body=f"SELECT c.record_key, CASE WHEN {_MET} THEN 'UPDATED' ELSE 'CONFLICT' END AS outcome FROM chg c LEFT JOIN items i USING (record_key)"))
def conditional_update_outcomes(spark, sf):
    return mutate.conditional_update(fx.items(spark, sf), _changes(spark, sf))[1]


@query(with_views("items", more=_CHG, body="SELECT c.record_key, CASE WHEN i.record_key IS NULL THEN 'CREATED' ELSE 'CONFLICT' END AS outcome FROM chg c LEFT JOIN items i USING (record_key)"))
def conditional_put(spark, sf):
    new = _changes(spark, sf).select("record_key", F.lit("PENDING").alias("status"), F.lit(1).cast("bigint").alias("version"))
    return mutate.conditional_put(fx.items(spark, sf), new)[1]


@query(with_views("items", more=_CHG, body="SELECT record_key, amount FROM items i WHERE NOT EXISTS (SELECT 1 FROM chg c WHERE c.record_key = i.record_key AND c.expected_version = i.version)"))
def conditional_delete(spark, sf):
    keys = _changes(spark, sf).select("record_key", "expected_version")
    return mutate.conditional_delete(fx.items(spark, sf), keys)[0].select("record_key", "amount")


_ACT = """act AS (SELECT 'txn-' || (o_orderkey // 4) AS txn, 'payment-' || lpad(CAST(o_orderkey + CASE WHEN o_orderkey % 4 = 3 THEN 90000000 ELSE 0 END AS VARCHAR), 8, '0') AS record_key,
  CASE o_orderkey % 4 WHEN 0 THEN 'update' WHEN 1 THEN 'delete' WHEN 2 THEN 'check' ELSE 'put' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE 1 + o_orderkey % 3 END AS expected_version, 'MATCH' AS new_status FROM orders)"""


def _actions(spark, sf):
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("update", "delete", "check", "put")])
    return fx.table(spark, sf, "orders").select(
        F.concat(F.lit("txn-"), F.floor(k / 4).cast("string")).alias("txn"), fx._key(k + F.when(k % 4 == 3, 90000000).otherwise(0)).alias("record_key"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("kind"), F.when(k % 7 == 0, 9).otherwise(1 + k % 3).alias("expected_version"), F.lit("MATCH").alias("new_status")
    )


_GRP = _ACT + ", grp AS (SELECT txn, bool_and(CASE WHEN kind = 'put' THEN i.record_key IS NULL ELSE coalesce(i.version = a.expected_version, false) END) AS ok, count(*) AS n_actions FROM act a LEFT JOIN items i USING (record_key) GROUP BY 1)"


@query(with_views("items", more=_GRP, body="SELECT txn, CASE WHEN ok THEN 'COMMITTED' ELSE 'CANCELLED' END AS outcome, n_actions FROM grp"))
def transact_groups(spark, sf):
    return mutate.transact(fx.items(spark, sf), _actions(spark, sf))[1]


@query(with_views("items", more=_GRP + ", d AS (SELECT a.* FROM act a JOIN grp g USING (txn) WHERE g.ok AND kind <> 'check')", body="""SELECT i.record_key, CASE WHEN d.kind = 'update' THEN 'MATCH' ELSE i.status END AS status, CASE WHEN d.kind = 'update' THEN i.version + 1 ELSE i.version END AS version
   FROM items i LEFT JOIN d USING (record_key) WHERE d.kind IS NULL OR d.kind = 'update' UNION ALL SELECT record_key, 'MATCH', 1 FROM d WHERE kind = 'put'"""))
def transact_items(spark, sf):
    return mutate.transact(fx.items(spark, sf), _actions(spark, sf))[0].select("record_key", "status", "version")


@query(with_views("items", more="""ch AS (SELECT 'payment-' || lpad(CAST(l_orderkey % 5000 AS VARCHAR), 8, '0') AS record_key, CASE WHEN min(l_suppkey) % 4 = 0 THEN 'delete' ELSE 'put' END AS kind, l_linenumber + 20 AS position, 'MATCH' AS status, CAST(max(l_partkey) AS BIGINT) AS version FROM lineitem GROUP BY 1, 3),
   l AS (SELECT * FROM ch WHERE position <= 25 QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY position DESC) = 1)""",
   body="SELECT record_key, status, version FROM items WHERE record_key NOT IN (SELECT record_key FROM l) UNION ALL SELECT record_key, status, version FROM l WHERE kind = 'put'"))
def batch_upsert(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    ch = li.groupBy(fx._key(F.col("l_orderkey") % 5000).alias("record_key"), (F.col("l_linenumber") + 20).alias("position")).agg(F.when(F.min("l_suppkey") % 4 == 0, "delete").otherwise("put").alias("kind"), F.max("l_partkey").alias("version")).withColumn("status", F.lit("MATCH"))
    return mutate.batch_put_delete(fx.items(spark, sf), ch)[0].select("record_key", "status", "version")


_NOW = "now AS (SELECT * REPLACE (CASE WHEN sk % 11 = 0 THEN version + 1 ELSE version END AS version) FROM items)"
_REP = _NOW + """, rep AS (SELECT i.record_key, CASE WHEN c.status IS NULL THEN 'REJECTED' WHEN c.status <> 'SETTLED' THEN 'SKIPPED' WHEN n.version = i.version AND n.status = 'PENDING' THEN 'REPAIRED' ELSE 'CONFLICT' END AS outcome, n.version + 1 AS new_version
   FROM items i JOIN now n USING (record_key) LEFT JOIN confirmations c ON c.reference = i.record_key WHERE i.status = 'PENDING')"""


def _repaired(spark, sf):
    i = fx.items(spark, sf)
    now = i.withColumn("version", F.when(F.col("sk") % 11 == 0, F.col("version") + 1).otherwise(F.col("version")))
    return mutate.repair(i, fx.confirmations(spark, sf), "job-9", now)


@query(with_views("items", "confirmations", more=_REP, body="SELECT record_key, outcome, new_version FROM rep"))
def repair_outcomes(spark, sf):
    return _repaired(spark, sf)[1]


@query(with_views("items", "confirmations", more=_REP, body="SELECT n.record_key, CASE WHEN r.outcome = 'REPAIRED' THEN 'SETTLED' ELSE n.status END AS status, CASE WHEN r.outcome = 'REPAIRED' THEN n.version + 1 ELSE n.version END AS version, CASE WHEN r.outcome = 'REPAIRED' THEN 'job-9:' || n.record_key END AS \"opsMarker\" FROM now n LEFT JOIN rep r USING (record_key)"))
def repair_items(spark, sf):
    return _repaired(spark, sf)[0].select("record_key", "status", "version", "opsMarker")


@query(with_views("items", "confirmations", more=_REP + ", x AS (SELECT *, CAST(substr(record_key, 9) AS BIGINT) % 5 AS v FROM rep)", body="SELECT record_key, CASE WHEN outcome = 'REPAIRED' AND v = 0 THEN 'FUNCTION_ERROR' WHEN outcome = 'REPAIRED' AND v = 1 THEN 'BUSINESS_REJECTED' ELSE outcome END AS outcome FROM x"))
def repair_validated(spark, sf):
    i = fx.items(spark, sf)
    now = i.withColumn("version", F.when(F.col("sk") % 11 == 0, F.col("version") + 1).otherwise(F.col("version")))
    said = F.element_at(F.array(*map(F.lit, ("FUNCTION_ERROR", "BUSINESS_REJECTED", "ACCEPTED"))), (F.col("sk") % 5 + 1).cast("int"))
    validations = i.where("sk % 5 < 3").select("record_key", said.alias("verdict"))
    return mutate.repair(i, fx.confirmations(spark, sf), "job-9", now, validations=validations)[1].select("record_key", "outcome")


def _compensated(spark, sf):
    """Of the repaired items, some have changed since and some are gone."""
    new, outcomes = _repaired(spark, sf)
    planned = new.join(outcomes.where("outcome = 'REPAIRED'").select("record_key"), "record_key", "left_semi").select("record_key", "version", "opsMarker", "opsPreviousStatus")
    touched = new.where("sk % 35 <> 0").withColumn("version", F.when(F.col("sk") % 6 == 0, F.col("version") + 1).otherwise(F.col("version")))
    return mutate.compensate(touched, planned, "job-9", "job-10")


@query(with_views("items", "confirmations", more=_REP + ", x AS (SELECT *, CAST(substr(record_key, 9) AS BIGINT) AS k FROM rep)", body="SELECT record_key, CASE WHEN k % 6 = 0 OR k % 35 = 0 THEN 'CONFLICT' ELSE 'COMPENSATED_DATA_ONLY' END AS outcome FROM x WHERE outcome = 'REPAIRED'"))
def compensate_outcomes(spark, sf):
    return _compensated(spark, sf)[1]


@query(with_views("items", "confirmations", more=_REP, body="""SELECT n.record_key, CASE WHEN n.sk % 6 <> 0 THEN 'PENDING' ELSE 'SETTLED' END AS status, CASE WHEN n.sk % 6 <> 0 THEN 'job-10:' ELSE 'job-9:' END || n.record_key AS "opsMarker", CASE WHEN n.sk % 6 = 0 THEN 'PENDING' END AS "opsPreviousStatus", n.version + 2 AS version
   FROM now n JOIN rep r USING (record_key) WHERE r.outcome = 'REPAIRED' AND n.sk % 35 <> 0"""))
def compensate_items(spark, sf):
    return _compensated(spark, sf)[0].where("opsMarker is not null").select("record_key", "status", "opsMarker", "opsPreviousStatus", "version")


@query(with_views("items", "confirmations", more=_REP, body="SELECT record_key FROM rep WHERE outcome = 'REPAIRED'"))
def marked_items(spark, sf):
    return access.select_marked(_repaired(spark, sf)[0], "job-9").select("record_key")


@query(with_views("items", body="SELECT record_key, version FROM items"))
def guarded_versions(spark, sf):
    return mutate.version_guard(fx.items(spark, sf)).select("record_key", "version")


@query(with_views("items", "confirmations", more=_REP, body="""SELECT 'job-9:' || record_key AS "eventId", record_key AS "paymentId", 'PENDING' AS "deliveryState", new_version AS version,
   '{"eventId":"job-9:' || record_key || '","paymentId":"' || record_key || '","status":"SETTLED","version":' || new_version || '}' AS payload FROM rep WHERE outcome = 'REPAIRED'"""))
def outbox_events(spark, sf):
    return mutate.build_outbox(_repaired(spark, sf)[1], "job-9").select("eventId", "paymentId", "deliveryState", "version", "payload")


@query(with_views("items", "confirmations", more=_REP, body="""SELECT 'job-9:' || record_key AS "eventId", CASE WHEN CAST(substr(record_key, 9) AS BIGINT) % 3 = 0 THEN 'DELIVERED' ELSE 'PENDING' END AS "deliveryState" FROM rep WHERE outcome = 'REPAIRED'"""))
def outbox_delivery(spark, sf):
    outbox = mutate.build_outbox(_repaired(spark, sf)[1], "job-9")
    n = F.substring("paymentId", 9, 8).cast("bigint")
    acks = [outbox.where(n % m == 0).select("eventId", F.lit(b).alias("broker"), F.concat(F.lit(b), "paymentId").alias("message_id")) for b, m in (("sqs", 1), ("sns", 3))]
    return mutate.mark_outbox(outbox, acks[0].union(acks[1])).select("eventId", "deliveryState")


@query(with_views("items", "confirmations", more=_REP, body="SELECT record_key, 'job-9:' || record_key AS \"opsMarker\", CAST(substr(record_key, 9) AS BIGINT) % 4 <> 0 AS verified FROM rep WHERE outcome = 'REPAIRED'"))
def outbox_verified(spark, sf):
    new, outcomes = _repaired(spark, sf)
    outbox = mutate.build_outbox(outcomes, "job-9").where(F.substring("paymentId", 9, 8).cast("bigint") % 4 != 0)
    return mutate.verify_outbox(new, outbox)


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'FUNCTION_ERROR' WHEN event_id % 4 = 0 THEN 'ACCEPTED' WHEN event_id % 4 = 1 THEN 'PERMISSION_CHECKED' WHEN event_id % 4 = 2 THEN CASE event_id % 3 WHEN 0 THEN 'EXECUTED' WHEN 1 THEN 'ACCEPTED' ELSE 'BUSINESS_REJECTED' END ELSE 'FAILED' END AS outcome FROM events""")
def classify_invocation(spark, sf):
    k = F.col("event_id")
    log = fx.table(spark, sf, "events").select(
        "event_id",
        F.when(k % 9 == 0, "Unhandled").alias("function_error"),
        F.element_at(F.array(*[F.lit(x) for x in (202, 204, 200, 500)]), (k % 4 + 1).cast("int")).alias("status_code"),
        F.element_at(F.array(*[F.lit(x) for x in ("Event", "DryRun", "RequestResponse", "Event")]), (k % 4 + 1).cast("int")).alias("invocation"),
        F.when(k % 3 == 1, True).when(k % 3 == 2, False).alias("accepted"),
    )
    return mutate.classify_invocation(log).select("event_id", "outcome")


@query("""SELECT event_id, list_extract(['OK','AUTHENTICATION','AUTHORIZATION', CASE WHEN event_id // 6 % 4 >= 3 THEN 'PAUSED' ELSE 'RETRY' END, CASE WHEN event_id // 6 % 4 >= 3 THEN 'PAUSED' ELSE 'RETRY' END, 'REJECT'], event_id % 6 + 1) AS outcome FROM events""")
def classify_http(spark, sf):
    k = F.col("event_id")
    log = fx.table(spark, sf, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in (200, 401, 403, 429, 503, 404)]), (k % 6 + 1).cast("int")).alias("status_code"), (F.floor(k / 6) % 4).alias("attempt"))
    return mutate.classify_http(log, 3).select("event_id", "outcome")


@query("""WITH l AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt, list_extract([200,429,503,404], event_id % 4 + 1) AS code, event_id % 90 AS wait FROM events)
   SELECT event_id, attempt, CASE code WHEN 200 THEN 'OK' WHEN 404 THEN 'REJECT' ELSE CASE WHEN attempt >= 3 OR wait > 60 THEN 'PAUSED' ELSE 'RETRY' END END AS outcome FROM l""")
def classify_calls(spark, sf):
    k = F.col("event_id")
    log = fx.table(spark, sf, "events").select("event_id", F.concat_ws("/", "user_id", "event_type").alias("call"), F.element_at(F.array(*[F.lit(x) for x in (200, 429, 503, 404)]), (k % 4 + 1).cast("int")).alias("status_code"), (k % 90).alias("retry_after"))
    return mutate.classify_calls(log, "call", ["event_id"], 3, 60).select("event_id", "attempt", "outcome")


# Ledger ------------------------------------------------------------------------------------------

_HIST = """hist AS (SELECT job, task, step, state, count(*) OVER (PARTITION BY job, task, step) AS changes FROM effect_events QUALIFY row_number() OVER (PARTITION BY job, task, step ORDER BY seen DESC, part DESC, state DESC) = 1)"""


def _history(spark, sf):
    return ledger.effect_history(fx.effect_events(spark, sf), ["seen", "part"])


@query(with_views("effect_events", more=_HIST, body="SELECT job, task, step, state, changes FROM hist"))
def effect_history(spark, sf):
    return _history(spark, sf)


@query(with_views("effect_events", more=_HIST, body="SELECT job, state, count(*) AS n FROM hist GROUP BY 1, 2"))
def effect_counts(spark, sf):
    return ledger.effect_counts(_history(spark, sf))


@query(with_views("effect_events", more=_HIST, body="SELECT job, task, max(step) AS step, arg_max(state, step) AS state FROM hist WHERE step LIKE 'step-%' GROUP BY 1, 2"))
def effect_latest(spark, sf):
    return ledger.latest_effect(_history(spark, sf), "step-")


@query(with_views("effect_events", more=_HIST, body="""SELECT job, task, step, CASE WHEN state = 'SUCCEEDED' THEN state WHEN task % 3 = 0 THEN 'SUCCEEDED' WHEN task % 3 = 1 THEN 'NOT_SENT' ELSE 'RECONCILIATION_REQUIRED' END AS reconciled FROM hist"""))
def reconcile_effects(spark, sf):
    h = _history(spark, sf)
    evidence = h.where("task % 3 < 2").select("job", "task", "step", (F.col("task") % 3 == 0).alias("found"))
    return mutate.reconcile_effects(h, evidence).select("job", "task", "step", "reconciled")


@query(with_views("effect_events", more=_HIST, body="SELECT job, step, task, min(task) OVER (PARTITION BY job, step) AS owner, task <> min(task) OVER (PARTITION BY job, step) AS reuses FROM hist"))
def prior_delivery(spark, sf):
    return mutate.prior_delivery(_history(spark, sf)).select("job", "step", "task", "owner", "reuses")


@query(with_views("tasks", body="SELECT job, CASE WHEN outcome = '' THEN state ELSE outcome END AS label, count(*) AS n FROM tasks GROUP BY 1, 2"))
def outcome_counts(spark, sf):
    return ledger.outcome_counts(fx.tasks(spark, sf))


_ERR = "('FAILED','FUNCTION_ERROR','BUSINESS_REJECTED','ERROR')"
_CNT = f"cnt AS (SELECT job, count(*) FILTER (state = 'DONE') AS done, count(*) FILTER (state = 'DONE' AND outcome IN {_ERR}) AS errors, count(*) FILTER (state = 'DONE' AND outcome = 'CONFLICT') AS conflicts FROM tasks GROUP BY 1)"


@query(with_views("tasks", more=_CNT, body="SELECT * FROM cnt"))
def error_conflict_counts(spark, sf):
    return ledger.error_conflict_counts(fx.tasks(spark, sf))


def _jobs(spark, sf):
    return fx.tasks(spark, sf).groupBy("job").agg((F.count("*") % 1000).alias("elapsed"), F.sum("seq").alias("calls"), F.min("record_key").alias("identity"))


@query(with_views("tasks", "effect_events", more=_CNT + ", " + _HIST + ", j AS (SELECT job, count(*) % 1000 AS elapsed FROM tasks GROUP BY 1), u AS (SELECT job, count(*) FILTER (state IN ('INTENT','UNKNOWN')) AS unresolved FROM hist GROUP BY 1)",
   body="""SELECT job, done, errors, conflicts, round(errors / done, 6) AS error_rate, CASE WHEN elapsed = 0 THEN 0 ELSE round(done / elapsed, 6) END AS records_per_second, coalesce(unresolved, 0) AS unresolved, coalesce(unresolved, 0) = 0 AS reconciled FROM j JOIN cnt USING (job) LEFT JOIN u USING (job)"""))
def job_summary(spark, sf):
    out = ledger.job_summary(_jobs(spark, sf), fx.tasks(spark, sf), _history(spark, sf))
    return out.withColumn("error_rate", F.round("error_rate", 6)).withColumn("records_per_second", F.round("records_per_second", 6))


@query(with_views("tasks", body="SELECT count(*) AS jobs, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(elapsed) AS BIGINT) AS elapsed FROM (SELECT job, sum(seq) AS calls, count(*) % 1000 AS elapsed FROM tasks GROUP BY 1)"))
def job_totals(spark, sf):
    return ledger.job_totals(_jobs(spark, sf))


@query(with_views("scan_pages", body="SELECT job, CAST(sum(scanned) AS BIGINT) AS scanned, CAST(sum(retries) AS BIGINT) AS retries FROM scan_pages GROUP BY 1"))
def usage(spark, sf):
    return ledger.usage(fx.scan_pages(spark, sf)).select("job", "scanned", "retries")


@query(with_views("tasks", "scan_pages", more=_CNT, body="""SELECT c.job, substr(sha256(i.identity), 1, 16) AS identity, done, errors, conflicts, scanned, resources FROM cnt c JOIN (SELECT job, min(record_key) AS identity FROM tasks GROUP BY 1) i USING (job)
   LEFT JOIN (SELECT job, CAST(sum(scanned) AS BIGINT) AS scanned FROM scan_pages GROUP BY 1) s USING (job) LEFT JOIN (SELECT job, string_agg(DISTINCT payload, ',' ORDER BY payload) AS resources FROM tasks GROUP BY 1) r USING (job)"""))
def job_status(spark, sf):
    t = fx.tasks(spark, sf)
    out = ledger.job_status(_jobs(spark, sf), t, fx.scan_pages(spark, sf), t.select("job", F.col("payload").alias("resource")))
    return out.select("job", "identity", "done", "errors", "conflicts", "scanned", "resources")


@query(f"""WITH a AS (SELECT user_id AS job, event_id AS seq, event_type AS state, CAST(floor(epoch(ts)) AS BIGINT) AS time FROM events), c AS (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY seq) AS previous FROM a)
   SELECT job, seq, state, previous, lead(time) OVER (PARTITION BY job ORDER BY seq) - time AS seconds FROM c WHERE state IS DISTINCT FROM previous""")
def state_transitions(spark, sf):
    a = fx.table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.unix_timestamp("ts").alias("time"))
    return ledger.state_transitions(a).select("job", "seq", "state", "previous", "seconds")


@query("""SELECT o_orderkey AS job, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'INTERRUPTED' ELSE 'COMPLETED' END AS state, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN NULL ELSE o_custkey END AS approved_until FROM orders""")
def interrupted_jobs(spark, sf):
    p = F.col("o_orderpriority")
    state = F.when(p.startswith("1"), "RUNNING").when(p.startswith("2"), "APPROVED").otherwise("COMPLETED")
    return ledger.at_start(fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), state.alias("state"), F.col("o_custkey").alias("approved_until")))


@query("""WITH r AS (SELECT user_id AS task, 'r' || event_id AS receipt, CAST(floor(epoch(ts)) AS BIGINT) AS received_at, event_type <> 'error' AS valid FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY received_at, receipt) AS n FROM r QUALIFY n <= 10)
   SELECT task, receipt, n, coalesce(n = max(n) FILTER (valid) OVER (PARTITION BY task), false) AS newest FROM n""")
def receipt_sequence(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("task"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("receipt"), F.unix_timestamp("ts").alias("received_at"), (F.col("event_type") != "error").alias("valid"))
    return ledger.receipt_sequence(e).select("task", "receipt", F.col("n").cast("bigint").alias("n"), "newest")


@query(with_views("tasks", body="SELECT seq AS sequence, substr(sha256(record_key), 1, 16) AS record, state, outcome FROM tasks ORDER BY 1"))
def masked_report(spark, sf):
    return select_columns(ledger.report_rows(fx.tasks(spark, sf)), "sequence,record,state,outcome")


@query(with_views("tasks", body=f"SELECT seq, record_key, outcome, (SELECT count(*) FROM tasks WHERE (outcome IN {_ERR} OR outcome = 'CONFLICT') AND seq > 700) > 60 AS has_more FROM tasks WHERE outcome IN {_ERR} AND seq > 700 OR outcome = 'CONFLICT' AND seq > 700 ORDER BY seq LIMIT 60"))
def error_page(spark, sf):
    return ledger.error_page(fx.tasks(spark, sf), 700, 60).select("seq", "record_key", "outcome", "has_more")


@query("SELECT event_id AS seq, event_type, (SELECT count(*) FROM events WHERE event_id > 250) > 25 AS has_more FROM events WHERE event_id > 250 ORDER BY 1 LIMIT 25")
def audit_page(spark, sf):
    a = fx.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type")
    return ledger.audit_page(a, 250, 25).select("seq", "event_type", "has_more")


@query(with_views("items", "tasks", body="SELECT record_key FROM items WHERE record_key NOT IN (SELECT record_key FROM tasks WHERE state = 'DONE')"))
def plan_remainder(spark, sf):
    return ledger.plan_remainder(fx.items(spark, sf), fx.tasks(spark, sf).where("state = 'DONE'")).select("record_key")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_tables(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return ledger.union_tables([c, s])


@query(with_views("tasks", body="SELECT seq, CASE WHEN job IN ('job-1', 'job-3') THEN '' ELSE payload END AS payload FROM tasks"))
def expire_payloads(spark, sf):
    t = fx.tasks(spark, sf)
    jobs = t.select("job").distinct().select("job", F.when(F.col("job").isin("job-1", "job-3", "job-5"), "COMPLETED").otherwise("RUNNING").alias("state"), F.when(F.col("job") == "job-5", 500).otherwise(100).alias("created"))
    return ledger.expire_payloads(t, jobs, 200).select("seq", "payload")


# Functions ---------------------------------------------------------------------------------------


_LED = "list_extract(['', ' ', chr(9), chr(11), ' ' || chr(9), chr(8195), chr(160), chr(28)], doc_id % 8 + 1) || CASE WHEN doc_id % 3 = 0 THEN '=' ELSE '' END || text"
_FORMULA = r"'^[\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]*[=+@-]|^[\t\r\n]'"


@query(f"WITH t AS (SELECT doc_id, {_LED} AS text FROM documents) SELECT doc_id, CASE WHEN regexp_matches(text, {_FORMULA}) THEN '''' || text ELSE text END AS text FROM t")
def csv_safe_text(spark, sf):
    led = F.element_at(F.array(*map(F.lit, ("", " ", "\t", "\x0b", " \t", " ", "\xa0", "\x1c"))), (F.col("doc_id") % 8 + 1).cast("int"))
    text = F.concat(led, F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", S.csv_safe(text).alias("text"))


@query("""WITH m AS (SELECT o_orderkey, md5('job:' || o_orderkey) AS m FROM orders) SELECT o_orderkey, substr(m,1,8) || '-' || substr(m,9,4) || '-3' || substr(m,14,3) || '-' || printf('%02x', (CAST('0x' || substr(m,17,2) AS INT) & 63) | 128) || substr(m,19,2) || '-' || substr(m,21,12) AS uuid FROM m""")
def name_uuid(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", S.name_uuid(S.event_id(F.lit("job"), F.col("o_orderkey").cast("string"))).alias("uuid"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS masked, sha256(c_mktsegment) AS segment_hash FROM customer")
def masked_ids(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", S.stable_id("c_name").alias("masked"), S.sha256_hex("c_mktsegment").alias("segment_hash"))


@query(with_views("messages", body="SELECT id, md5OfBody = '' OR lower(md5OfBody) = md5(body) AS md5_ok, CAST(receiveCount AS INT) AS receives, leaseUntil > receivedAt + 60 AS lease_ok FROM messages"))
def message_checks(spark, sf):
    m = fx.messages(spark, sf)
    return m.select("id", S.md5_ok("body", "md5OfBody").alias("md5_ok"), S.receive_count("receiveCount").alias("receives"), S.lease_valid("receipt", "leaseUntil", F.col("receivedAt"), 60).alias("lease_ok"))


@query("SELECT o_orderkey, printf('tenant-%05d', CASE WHEN o_orderkey % 10 < 8 THEN 0 ELSE o_orderkey % 100 END) AS tenant, 'arn:aws:iam::' || o_custkey || ':role/ops' AS principal, make_timestamp(o_orderkey * 1000000) AS at FROM orders")
def names_and_times(spark, sf):
    k = F.col("o_orderkey")
    arn = F.concat(F.lit("arn:aws:sts::"), F.col("o_custkey").cast("string"), F.lit(":assumed-role/ops/s"), k.cast("string"))
    return fx.table(spark, sf, "orders").select("o_orderkey", S.tenant(k, True, 100).alias("tenant"), S.normalize_principal(arn).alias("principal"), S.epoch_to_ts(k).cast("timestamp_ntz").alias("at"))


_TEXTS = "list_extract([(k * 10) || '', '-' || (k * 100), k || '.50', '0.00' || k, k || 'E3', '-0.0' || k || '0'], k % 6 + 1)"
_DIGITS = f"""t AS (SELECT k, {_TEXTS} AS t FROM (SELECT o_orderkey AS k FROM orders)), m AS (SELECT k, t[1:1] = '-' AS neg, split_part(t, 'E', 1) AS m, CASE WHEN contains(t, 'E') THEN CAST(split_part(t, 'E', 2) AS BIGINT) ELSE 0 END AS e FROM t),
  d AS (SELECT k, neg, e - CASE WHEN contains(m, '.') THEN length(split_part(m, '.', 2)) ELSE 0 END AS e, ltrim(replace(replace(m, '-', ''), '.', ''), '0') AS d FROM m),
  n AS (SELECT k, neg, e + length(d) - length(rtrim(d, '0')) AS e, rtrim(d, '0') AS d FROM d), p AS (SELECT k, neg, d, (length(d) + abs(length(d) + e) % 2 + 1) // 2 AS pairs FROM n)"""


@query(f"WITH {_DIGITS} SELECT k AS o_orderkey, CASE WHEN d = '' THEN 1 ELSE pairs + 1 + CASE WHEN neg AND pairs < 20 THEN 1 ELSE 0 END END AS n FROM p")
def number_lengths(spark, sf):
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    texts = ((k * 10).cast("string"), F.concat(F.lit("-"), (k * 100).cast("string")), F.concat(text, F.lit(".50")), F.concat(F.lit("0.00"), text), F.concat(text, F.lit("E3")), F.concat(F.lit("-0.0"), text, F.lit("0")))
    return fx.table(spark, sf, "orders").select("o_orderkey", S.number_len(F.element_at(F.array(*texts), (k % 6 + 1).cast("int"))).alias("n"))


@query("""WITH n AS (SELECT *, CASE WHEN c_custkey = 0 THEN 1 ELSE (length(rtrim(c_custkey || '', '0')) + length(c_custkey || '') % 2 + 1) // 2 + 1 END AS num FROM customer)
  SELECT c_custkey, 9 + num + 6 + strlen(c_name) + 4 + strlen(c_mktsegment) + 2 + 5 + 3 + 2 + 2 + strlen(c_name) + 1 + 3 + 1 + num + 1 + 3 + strlen(c_mktsegment) + 1 AS bytes FROM n""")
def item_sizes(spark, sf):
    """Names and values: a number, a text, a set, a list of two texts, a structure of a number and a text."""
    c = fx.table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.array("c_mktsegment", F.lit("xy")).alias("tags"), F.array("c_name", F.lit("ab")).alias("flags"), F.struct(F.col("c_custkey").alias("n"), F.col("c_mktsegment").alias("seg")).alias("m")
    )
    return c.select("c_custkey", S.item_size(c.schema, sets=("tags",)).alias("bytes"))


@query("SELECT event_id, base64(CAST(props AS BLOB)) AS coded, props AS decoded FROM events")
def attribute_codes(spark, sf):
    value = F.struct(F.lit("Binary").alias("type"), F.lit(None).cast("string").alias("string"), F.col("props").cast("binary").alias("binary"))
    coded = fx.table(spark, sf, "events").select("event_id", S.encode_attributes(F.create_map(F.lit("k"), value)).alias("m"))
    return coded.select("event_id", F.col("m")["k"]["binary"].alias("coded"), S.decode_attributes("m")["k"]["binary"].cast("string").alias("decoded"))


@query("SELECT c_custkey, 9 + length(CAST(c_custkey AS VARCHAR)) + 6 + strlen(c_name) + 12 + strlen(c_mktsegment) AS bytes FROM customer")
def item_bytes(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.select("c_custkey", S.estimated_bytes(c.schema).alias("bytes"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS event, event_type AS parsed FROM events")
def json_events(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", S.json_event(id=F.col("event_id"), type=F.col("event_type")).alias("event"))
    return e.withColumn("parsed", F.from_json("event", "id bigint, type string")["type"])


# Metrics -----------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS slowest, arg_max(user_id, (value, user_id)) AS slowest_segment FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    return metrics.latency_metrics(fx.table(spark, sf, "events"), ["event_type"], "value", "user_id").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INT) + 1] AS p95 FROM events GROUP BY 1")
def rounded_percentiles(spark, sf):
    return metrics.rounded_percentiles(fx.table(spark, sf, "events"), "user_id", "value", 0.95, "p95")


_RUNS = "runs AS (SELECT user_id AS sweep, CAST(date_part('doy', ts) AS INT) * 24 + CAST(date_part('hour', ts) AS INT) AS run, count(*) AS records_per_second FROM events GROUP BY 1, 2)"


def _runs(spark, sf):
    at = (F.dayofyear("ts") * 24 + F.hour("ts")).alias("run")
    return fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("sweep"), at).agg(F.count("*").alias("records_per_second"))


@query(f"""WITH {_RUNS}, d AS (SELECT *, (records_per_second / lag(records_per_second) OVER (PARTITION BY sweep ORDER BY run) - 1) * 100 AS delta FROM runs) SELECT sweep, run, round(delta, 6) AS delta, CASE WHEN delta IS NULL THEN 'BASELINE' WHEN delta > 5 THEN 'IMPROVEMENT' WHEN delta < -5 THEN 'REGRESSION' ELSE 'NEUTRAL' END AS verdict FROM d""")
def compare_runs(spark, sf):
    return metrics.compare_runs(_runs(spark, sf), "sweep", "run").select("sweep", "run", F.round("delta", 6).alias("delta"), "verdict")


@query(f"""WITH {_RUNS}, l AS (SELECT sweep, list(records_per_second ORDER BY records_per_second, run) AS v, list(run ORDER BY records_per_second, run) AS r FROM runs GROUP BY 1) SELECT sweep, CAST(len(v) AS BIGINT) AS n, r[len(v) // 2 + 1] AS median_run, v[len(v) // 2 + 1] AS median, v[len(v)] AS most, v[1] AS least, round((v[len(v)] - v[1]) / v[len(v) // 2 + 1] * 100, 6) AS spread FROM l""")
def repeat_summary(spark, sf):
    return metrics.repeat_summary(_runs(spark, sf), ["sweep"]).withColumn("spread", F.round("spread", 6))


@query("SELECT n, CAST(elapsed AS BIGINT) AS elapsed, round(mean_rows, 6) AS mean_rows, kind, CASE WHEN kind = 'A' THEN NULL ELSE CAST(cap AS BIGINT) END AS capacity FROM (SELECT l_returnflag AS kind, count(*) AS n, sum(l_partkey) AS elapsed, avg(l_linenumber) AS mean_rows, sum(l_suppkey) AS cap FROM lineitem GROUP BY 1)")
def balanced_runs(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("elapsed"), F.col("l_linenumber").alias("n_rows"), F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), F.lit(None)).otherwise(F.col("l_suppkey")).alias("capacity"))
    return metrics.balanced_runs(li).withColumn("mean_rows", F.round("mean_rows", 6))


@query("SELECT round(sum(l_partkey) FILTER (l_returnflag = 'A') / sum(l_partkey) FILTER (l_returnflag = 'N'), 6) AS ratio FROM lineitem")
def elapsed_ratio(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("elapsed"), F.col("l_linenumber").alias("n_rows"), F.lit(1).alias("capacity"))
    return metrics.elapsed_ratio(metrics.balanced_runs(li), "A", "N").select(F.round("ratio", 6).alias("ratio"))


@query("""WITH k AS (SELECT o_custkey, count(*) AS n, sum(length(o_orderpriority)) AS b, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 4) SELECT nation, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(b) AS BIGINT) AS n_bytes, count(*) AS n_keys, max(n) AS hottest, round(max(n) / sum(n), 6) AS hot_share FROM k GROUP BY 1""")
def skew_profile(spark, sf):
    o = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "nation")
    return metrics.table_profile(o, "nation", "o_custkey", F.length("o_orderpriority")).withColumn("hot_share", F.round("hot_share", 6))


@query("""WITH s AS (SELECT event_type AS kind, CASE WHEN event_id % 10 < 3 THEN -1 - (event_id % 3) ELSE user_id * 1000 + event_id % 97 END AS key FROM events), k AS (SELECT kind, key, count(*) AS n FROM s GROUP BY 1, 2),
  t AS (SELECT kind, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS hottest, arg_min(key, (-n, key)) AS hot_key FROM k GROUP BY 1)
  SELECT kind, n_rows, CASE WHEN hottest > 0.02 * n_rows THEN hot_key END AS hot_key, CASE WHEN hottest > 0.02 * n_rows THEN hottest END AS hottest, CASE WHEN hottest > 0.02 * n_rows THEN round(hottest / n_rows, 6) END AS hot_share FROM t""")
def hot_keys(spark, sf):
    """The hottest key of each type of event, of many keys of which three are frequent, without a group for each."""
    n = F.col("event_id")
    e = fx.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.when(n % 10 < 3, -1 - n % 3).otherwise(F.col("user_id") * 1000 + n % 97).alias("key"))
    return metrics.hot_keys(e, "kind", "key", 0.02).withColumn("hot_share", F.round("hot_share", 6))


@query("""SELECT segment, round(logical_bytes / n_rows, 6) AS mean_bytes, round(logical_bytes / n_rows * 1000000, 2) AS logical_total, round(observed_bytes / logical_bytes, 6) AS physical_ratio FROM (SELECT c_mktsegment AS segment, count(*) AS n_rows, sum(length(c_name)) AS logical_bytes, sum(length(c_name) + 40) AS observed_bytes FROM customer GROUP BY 1)""")
def capacity_estimate(spark, sf):
    p = fx.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n_rows"), F.sum(F.length("c_name")).alias("logical_bytes"), F.sum(F.length("c_name") + 40).alias("observed_bytes"))
    out = metrics.capacity_estimate(p, 1_000_000)
    return out.select("segment", F.round("mean_bytes", 6).alias("mean_bytes"), F.round("logical_total", 2).alias("logical_total"), F.round("physical_ratio", 6).alias("physical_ratio"))


@query("SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (bad) AS failed_batches, CAST(sum(n) FILTER (bad) AS BIGINT) AS failed_items FROM (SELECT l_suppkey, count(*) AS n, l_suppkey % 7 = 0 AS bad FROM lineitem GROUP BY 1, 3)")
def batch_counters(spark, sf):
    r = fx.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("items")).withColumn("failed", F.col("l_suppkey") % 7 == 0)
    return metrics.batch_counters(r)


@query("SELECT user_id, round(n / s, 6) AS scanned_per_s, round(e / s, 6) AS returned_per_s, round(b / s / 1048576, 6) AS mib_per_s FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, sum(strlen(props)) AS b, max(event_id) + 1 AS s FROM events GROUP BY 1)")
def throughput(spark, sf):
    t = fx.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("scanned"), F.count_if(F.col("event_type") == "error").alias("returned"), F.sum(F.octet_length("props")).alias("bytes"), (F.max("event_id") + 1).alias("seconds"))
    return metrics.throughput_metric(t).select("user_id", *[F.round(c, 6).alias(c) for c in ("scanned_per_s", "returned_per_s", "mib_per_s")])


@query("""SELECT o_custkey AS run, o_orderkey AS at, row_number() OVER w AS completed, CAST(sum(length(o_orderpriority)) OVER w AS BIGINT) AS scanned_total, CASE WHEN o_orderkey = 0 THEN 0 ELSE round(sum(length(o_orderpriority)) OVER w / o_orderkey, 6) END AS rate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def segment_progress(spark, sf):
    c = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("at"), F.length("o_orderpriority").alias("scanned"))
    return metrics.segment_progress(c).select("run", "at", "completed", "scanned_total", F.round("rate", 6).alias("rate"))


_PAIR = "m AS (SELECT avg(value) FILTER (event_id % 2 = 0) AS o1, avg(value) FILTER (event_id % 2 = 1) AS n1, count(*) FILTER (event_id % 4 = 0) AS o2, count(*) FILTER (event_id % 3 = 0) AS n2 FROM events), p AS (SELECT 'latency' AS metric, o1 AS o, n1 AS n, -1 AS up FROM m UNION ALL SELECT 'n_rows', o2, n2, 1 FROM m), v AS (SELECT *, (n / o - 1) * 100 AS delta FROM p)"
_PV = "CASE WHEN delta * up > 5 THEN 'IMPROVEMENT' WHEN delta * up < -5 THEN 'REGRESSION' ELSE 'NEUTRAL' END"


def _pair(spark, sf):
    e = fx.table(spark, sf, "events")
    measure = lambda a, b: e.agg(F.avg(F.when(a, F.col("value"))).alias("latency"), F.count_if(b).alias("n_rows"))
    k = F.col("event_id")
    return metrics.compare_pair(measure(k % 2 == 0, k % 4 == 0), measure(k % 2 == 1, k % 3 == 0), {"latency": False, "n_rows": True})


@query(f"WITH {_PAIR} SELECT metric, round(delta, 6) AS delta, {_PV} AS verdict FROM v")
def compare_pair(spark, sf):
    return _pair(spark, sf).select("metric", F.round("delta", 6).alias("delta"), "verdict")


@query(f"WITH {_PAIR}, w AS (SELECT {_PV} AS verdict FROM v) SELECT CASE WHEN bool_or(verdict = 'REGRESSION') THEN 'REVIEW_REQUIRED' WHEN bool_or(verdict = 'IMPROVEMENT') THEN 'IMPROVEMENT' ELSE 'NEUTRAL' END AS verdict FROM w")
def pair_verdict(spark, sf):
    return metrics.pair_verdict(_pair(spark, sf))


# Quality -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS probe, count(*) AS n FROM orders WHERE o_orderkey IN (0, (SELECT count(*) - 1 FROM orders)) GROUP BY 1")
def probe_first_last(spark, sf):
    o = fx.table(spark, sf, "orders")
    return quality.probe_first_last(o, "o_orderkey", 0, o.count() - 1)


@query("SELECT count(*) FILTER (o_orderkey % 100 = 0 OR o_orderkey = 7) AS found, count(*) FILTER (o_orderkey % 100 = 0) AS expected, count(*) FILTER (o_orderkey = 7) AS misplaced FROM orders")
def needle_counts(spark, sf):
    k = F.col("o_orderkey")
    return quality.needle_counts(fx.table(spark, sf, "orders"), "o_orderkey", (k % 100 == 0) | (k == 7), 100)


@query("SELECT count(*) AS n_different, CAST(count(*) AS BIGINT) AS n_rows FROM orders WHERE o_orderkey % 10 = 0")
def semantic_diff(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.array(F.col("o_orderstatus"), F.lit("Z")).alias("tags"))
    other = o.where("o_orderkey % 10 <> 0").select("o_custkey", F.array_union(F.array(F.lit("Z")), "tags").alias("tags"), "o_orderkey")
    return quality.semantic_diff(o, other, ("tags",)).agg(F.count("*").alias("n_different"), F.sum("n_a").alias("n_rows"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS note, 'a,b' AS tags, o_custkey AS of_customer, 0 AS n_bad FROM orders")
def typed_items_round_trip(spark, sf):
    """Rows as typed documents and back: a number, texts, an absent one, a set, a structure."""
    note = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("note")
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", note, F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("tags"), F.struct("o_custkey", "o_orderpriority").alias("incident"))
    back = items_source.parse_typed_items(items_source.to_typed_items(o), "document", o.schema)
    return back.select("o_orderkey", "o_orderstatus", "note", F.array_join("tags", ",").alias("tags"), F.col("incident.o_custkey").alias("of_customer"), F.size("bad_numbers").alias("n_bad"))


_DOC = """d AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS t, o_orderpriority AS p, o_orderkey % 4 <> 0 AS has, o_orderkey % 5 = 0 AS bad FROM orders)"""


@query(f"""WITH {_DOC} SELECT k, CASE WHEN NOT bad THEN '{{' || CASE WHEN has THEN '"a":{{"S":"' || p || '"}},' ELSE '' END || '"big":{{"N":"12345678901234567890123456789012345678901234567890"}},"bin":{{"BS":["YQ==","YmI="]}},"gone":{{"NULL":true}},"list":{{"L":[{{"S":"x"}},{{"NULL":true}},{{"N":"7"}}]}},"map":{{"M":{{"x":{{"N":"0"}},"y":{{"BOOL":true}}}}}},"nums":{{"NS":["2","10"]}},"tags":{{"SS":["a","b"]}},"z":{{"N":"' || t || '.5"}}}}' END AS document,
  CASE WHEN NOT bad THEN CAST(81 + CASE WHEN has THEN 1 + length(p) ELSE 0 END + CASE WHEN k = 0 THEN 2 ELSE (length(t) + 2 + length(t) % 2) // 2 + 1 END AS BIGINT) END AS bytes, bad AS failed,
  CASE WHEN has THEN 'S' ELSE 'ABSENT' END AS a, 'NULL' AS gone, 'BOOL' AS inside FROM d""")
def document_forms(spark, sf):
    """Documents of every type in one normal form, with sizes; every fifth holds a number that is none."""
    k = F.col("o_orderkey")
    doc = F.concat(
        F.lit('{"z":{"N":"'), F.when(k % 5 == 0, "1.2.3").otherwise(F.concat(F.lit("0"), k.cast("string"), F.lit(".50"))), F.lit('"},'),
        F.when(k % 4 != 0, F.concat(F.lit('"a":{"S":"'), F.col("o_orderpriority"), F.lit('"},'))).otherwise(""),
        F.lit('"gone":{"NULL":true},"tags":{"SS":["b","a","b"]},"nums":{"NS":["1e1","2.0","10"]},"bin":{"BS":["YmI=","YQ=="]},"big":{"N":"+12345678901234567890123456789012345678901234567890.000"},'),
        F.lit('"list":{"L":[{"S":"x"},{"NULL":true},{"N":"07"}]},"map":{"M":{"y":{"BOOL":true},"x":{"N":"-0.0"}}}}'),
    )
    out = documents.normal_documents(fx.table(spark, sf, "orders").select(k.alias("k"), doc.alias("document")))
    kinds = {"a": "a", "gone": "gone", "inside": "map.y"}
    return out.select("row.k", "document", "bytes", F.col("error").isNotNull().alias("failed"), *[documents.attribute_kind("row.document", p).alias(n) for n, p in kinds.items()])


@query("SELECT o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'NULL' WHEN o_orderkey % 3 = 1 THEN 'S' ELSE 'ABSENT' END AS note, true AS same FROM orders")
def document_round_trip(spark, sf):
    """Documents as attribute rows and back: in normal form they are what they were."""
    k = F.col("o_orderkey")
    note = F.when(k % 3 == 0, ',"note":{"NULL":true}').when(k % 3 == 1, F.concat(F.lit(',"note":{"S":"'), F.col("o_orderpriority"), F.lit(' \\"é\\""}'))).otherwise("")
    doc = F.concat(F.lit('{"status":{"S":"'), F.col("o_orderstatus"), F.lit('"},"n\\"q":{"L":[{"N":"1.50"},{"M":{"x":{"NS":["2","1"]}}}]}'), note, F.lit("}"))
    was = documents.normal_documents(fx.table(spark, sf, "orders").select(k.alias("k"), doc.alias("document"))).select("row.k", F.col("document").alias("was"))
    # What a document was goes along with its attributes, so it is made once and isn't joined again.
    back = documents.assembled(documents.attribute_rows(was, ["k", "was"], "was"), ["k", "was"])
    again = documents.normal_documents(back).select("row.k", "row.was", "document")
    return again.select("k", documents.attribute_value("document", "status", "S").alias("status"), documents.attribute_kind("document", "note").alias("note"), (F.col("document") == F.col("was")).alias("same"))


_N = "n AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 100 = 0 THEN 'MATCH' WHEN o_orderkey % 2 = 0 THEN 'PENDING' ELSE 'SETTLED' END AS status, printf('%016x', o_orderkey) AS x, printf('2026-09-%02dT%02d', o_orderkey % 28 + 1, o_orderkey % 24) AS hour FROM orders)"


@query(f"""WITH {_N} SELECT printf('tenant-%05d', CASE WHEN n % 10 < 8 THEN 0 ELSE n % 1000 END) AS pk, printf('record-%012d', n) AS sk, status, 'category-' || (n % 50) AS category, CAST(1 AS BIGINT) AS version, 'txn-' || x AS "transactionId",
  printf('pay-%014d', n) AS "paymentId", printf('customer-%07d', n % 10000000) AS "customerId", printf('acct-%08d', n % 100000000) AS "accountId", printf('%011d', n % 99999999999) AS document, n % 5000000 + 100 AS amount, 'BRL' AS currency,
  list_extract(['API', 'BATCH', 'MOBILE', 'BRANCH'], n % 4 + 1) AS channel, printf('product-%02d', n % 24) AS "productCode", hour || ':00:00Z' AS "createdAt", hour || ':30:00Z' AS "updatedAt", n % 7 <> 0 AS active, n % 4 AS "retryCount",
  'flow-' || (n % 5) || ',tag-' || (n % 8) AS tags, CASE WHEN n % 10000 = 0 THEN 'incident-needle' ELSE 'corr-' || x END AS "correlationId", 'trace-' || x AS "traceId", printf('system-%02d', n % 12) AS "sourceSystem",
  list_extract(['PAYMENT', 'REVERSAL', 'RECONCILIATION'], n % 3 + 1) AS operation, n % 5 + 1 AS priority, printf('%03d', n % 999) AS "bankCode", printf('%04d', n % 10000) AS branch, printf('%08d', n % 100000000) AS account, list_extract(['SP', 'RJ', 'MG', 'PR'], n % 4 + 1) AS region,
  printf('counterparty-%05d', n % 100000) AS name, printf('%011d', n * 17 % 99999999999) AS other_document, CASE WHEN n % 3 = 0 THEN 'LEGAL' ELSE 'PERSON' END AS type, CAST(3 AS BIGINT) AS "schemaVersion", 'performance-lab' AS origin, 'audited,replayable' AS flags, 512 AS payload FROM n""")
def generated_items(spark, sf):
    """The item of every order's number, its structures laid flat."""
    i = fx.table(spark, sf, "orders").select(*items_source.item_columns(F.col("o_orderkey"), "rich-skewed"))
    flat = [c for c in i.columns if c not in ("tags", "incident", "routing", "counterparty", "history", "metadata", "payload")]
    return i.select(
        *flat, F.array_join("tags", ",").alias("tags"), "incident.*", "routing.*", "counterparty.name", F.col("counterparty.document").alias("other_document"), "counterparty.type", "metadata.schemaVersion", "metadata.origin", F.array_join("metadata.flags", ",").alias("flags"), F.length("payload").alias("payload")
    )


@query(f"WITH {_N} SELECT printf('record-%012d', n) AS sk, 0 AS place, 'CREATED' AS state, make_timestamp((1700000000 + n) * 1000000) AS at FROM n UNION ALL SELECT printf('record-%012d', n), 1, status, make_timestamp((1700000060 + n) * 1000000) FROM n")
def item_histories(spark, sf):
    i = fx.table(spark, sf, "orders").select(*items_source.item_columns(F.col("o_orderkey"), "rich-uniform"))
    return items_source.history_rows(i, ["sk"]).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT CAST(2 * count(*) FILTER (o_orderkey % 9 = 0) AS BIGINT) AS different, CAST(sum(CASE WHEN o_orderkey % 9 = 0 THEN 3 ELSE 0 END) AS BIGINT) AS more_bytes FROM orders")
def generated_check(spark, sf):
    """As many items as there are orders against themselves made anew; every ninth has a longer currency."""
    stored = fx.table(spark, sf, "orders").select("o_orderkey", *items_source.item_columns(F.col("o_orderkey"), "hot-key"))
    stored = stored.withColumn("currency", F.when(F.col("o_orderkey") % 9 == 0, "BRL/01").otherwise(F.col("currency"))).drop("o_orderkey")
    out = quality.check_generated(stored, "hot-key", fx.table(spark, sf, "orders").count())
    return out.select("different", (F.col("stored_bytes") - F.col("made_bytes")).alias("more_bytes"))


@query("SELECT o_orderkey AS n FROM orders WHERE o_orderkey % 700 = 0")
def missing_needles(spark, sf):
    """Needles that are due at every hundredth number, of which every seventh isn't stored."""
    n = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"))
    return quality.check_needles(n.where("n % 700 <> 0"), n.where("n % 100 = 0"), "n")


@query("SELECT count(*) AS n_rows FROM orders")
def cardinality(spark, sf):
    o = fx.table(spark, sf, "orders")
    return quality.check_cardinality(o, o.count())


@query(with_views("items", body="SELECT record_key, priority FROM items"))
def limits_kept(spark, sf):
    return access.enforce_limits(fx.items(spark, sf), payload="priority").select("record_key", "priority")


@query(with_views("items", "confirmations", body="SELECT record_key, c.reference IS NOT NULL AS there, c.reference IS NULL AS missing FROM items i LEFT JOIN confirmations c ON c.reference = i.record_key"))
def attribute_presence(spark, sf):
    joined = fx.items(spark, sf).join(fx.confirmations(spark, sf).select("reference"), F.col("record_key") == F.col("reference"), "left")
    return joined.select("record_key", access.attribute_exists("reference").alias("there"), access.attribute_not_exists("reference").alias("missing"))


# Files -------------------------------------------------------------------------------------------


@query(with_views("items", body="SELECT record_key, status FROM items WHERE status <> 'MATCH'"))
def stored_items(spark, sf):
    """Two versions of an item table; its newest is read, two columns of it."""
    path = new_path(spark, "items")
    items_source.write_items(fx.items(spark, sf), path, 1)
    items_source.write_items(fx.items(spark, sf).where("status <> 'MATCH'"), path, 2)
    return items_source.read_items(spark, items_source.latest_path(spark, path), ["record_key", "status"])


@query(with_views("tasks", body="SELECT seq, CASE WHEN (seq - 1) // 500 % 2 = 0 THEN 'again' ELSE state END AS state FROM tasks WHERE (seq - 1) // 500 < 20"))
def stored_chunks(spark, sf):
    """Chunks of a sequence, every other of which is written again; the first 20 are committed, the others aren't seen."""
    path, tasks = new_path(spark, "chunks"), fx.tasks(spark, sf).select("seq", "state")
    sinks.write_chunks(tasks, path, 500)
    total = tasks.agg(F.max("seq")).first()[0]
    sinks.commit_chunks(spark, path, min(5000, total), total, 500)
    sinks.write_chunks(tasks.where(F.floor((F.col("seq") - 1) / 500) % 2 == 0).withColumn("state", F.lit("again")), path, 500)
    sinks.commit_chunks(spark, path, min(10_000, total), total, 500)
    return sinks.read_chunks(spark, path).select("seq", "state")


@query(with_views("tasks", body="SELECT job, seq, job || ':' || record_key AS \"eventId\" FROM tasks WHERE outcome = 'REPAIRED'"))
def stored_evidence(spark, sf):
    path, done = new_path(spark, "evidence"), fx.tasks(spark, sf).where("outcome = 'REPAIRED'")
    rows = done.select("job", "seq", S.event_id("job", "record_key").alias("eventId"))
    for batch in ("seq % 2 = 0", "seq % 2 = 1", "seq % 2 = 0"):  # the first one again
        sinks.write_evidence(rows.where(batch), path, batch[-1])
    return spark.read.schema("seq bigint, eventId string, batch string, job string").json(path).select("job", "seq", "eventId")


@query(with_views("effect_events", body="SELECT job, state, count(*) AS n FROM effect_events GROUP BY 1, 2"))
def stored_ledger(spark, sf):
    """A ledger of two batches, each of which comes twice."""
    tables, e = Tables(spark, new_path(spark, "ledger")), fx.effect_events(spark, sf)
    for half in (0, 0, 1, 1):
        sinks.append_ledger(tables, e.where(f"task % 2 = {half}"), f"half-{half}")
    return ledger.effect_counts(tables.read("effects"))


@query(with_views("effect_events", body="SELECT job, task, step, arg_max(state, (part % 2, seen, part, state)) AS state, count(*) AS changes FROM effect_events GROUP BY 1, 2, 3"))
def ledger_snapshot(spark, sf):
    """Effects by key, from a snapshot of the first batch and the second one behind it, which is retried."""
    tables, e = Tables(spark, new_path(spark, "ledger")), fx.effect_events(spark, sf)
    sinks.append_ledger(tables, e.where("part % 2 = 0"), "even")
    sinks.compact_ledger(tables, ("seen", "part"))
    for _ in range(2):
        sinks.append_ledger(tables, e.where("part % 2 = 1"), "odd")
    return sinks.current_effects(tables, ("seen", "part")).select("job", "task", "step", "state", "changes")


@query(with_views("tasks", body="""SELECT '"' || seq || '","' || substr(sha256(record_key), 1, 16) || '","' || state || '","' || outcome || '"' AS line FROM tasks"""))
def stored_report(spark, sf):
    path = new_path(spark, "report")
    sinks.write_report_csv(ledger.report_rows(fx.tasks(spark, sf)), path, "sequence,record,state,outcome", header=False)
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))


@query(with_views("tasks", body="SELECT count(*) FILTER (state = 'PLANNED') AS planned_files, count(*) AS files FROM (SELECT DISTINCT state, payload FROM tasks)"))
def stored_objects(spark, sf):
    """One file for each state and payload, listed with their sizes."""
    path = new_path(spark, "objects")
    fx.tasks(spark, sf).select("seq", "state", "payload").repartition("state", "payload").write.partitionBy("state", "payload").parquet(path)
    listed = items_source.object_inventory(spark, path, "*.parquet", 1).where("over_budget")
    return listed.agg(F.count_if(F.col("path").contains("state=PLANNED")).alias("planned_files"), F.count("*").alias("files"))


# Jobs --------------------------------------------------------------------------------------------


class _Settle:
    """Settles open items; those of every seventh customer fail."""

    type, version = "settle", "v1"

    def validate(self, request):
        assert request["max_records"] > 0

    def plan(self, items):
        return access.select_pending(items).withColumn("payload", F.col("pk").cast("string"))

    def proposal(self, candidates):
        return planning.propose(candidates, "repair")

    def execute(self, tasks):
        return tasks.withColumn("outcome", F.when(F.col("payload").cast("bigint") % 7 == 0, "FAILED").otherwise("REPAIRED"))

    def risks(self):
        return list(planning.RISKS["repair"])

    def calls(self):
        return planning.CALLS["repair"]


_RUN = """p AS (SELECT record_key, pk, row_number() OVER (ORDER BY record_key) AS seq FROM items WHERE status = 'PENDING'), b AS (SELECT *, (seq - 1) // 1000 AS page_no FROM p), f AS (SELECT page_no FROM (SELECT page_no, sum(count(*)) OVER (ORDER BY page_no) AS s FROM b GROUP BY 1) WHERE s <= 5000),
  t AS (SELECT *, CASE WHEN pk % 7 = 0 THEN 'FAILED' ELSE 'REPAIRED' END AS outcome FROM b WHERE page_no IN (SELECT page_no FROM f) AND seq <= 2500), r AS (SELECT *, sum((outcome = 'FAILED')::INT) OVER (ORDER BY seq) AS e FROM t), k AS (SELECT min(seq) AS cut FROM r WHERE e > 150),
  w AS (SELECT wave, 100 * (2 ** wave - 1) AS last FROM range(1, 6) x(wave)), z AS (SELECT min(last) AS last FROM w, k WHERE last >= cut)"""


@query(with_views("items", more=_RUN, body="SELECT record_key, seq, outcome, 'DONE' AS state, (SELECT min(wave) FROM w WHERE last >= seq) AS wave, coalesce(seq > cut, false) AS after_cut FROM r, k, z WHERE z.last IS NULL OR seq <= z.last"))
def job_run(spark, sf):
    """A whole run in growing waves, which ends with the wave in which a task trips the error budget."""
    request = Request(max_records=5000, canary=2500, max_conflicts=10, max_errors=150, max_rate=1.0)
    return run_job(_Settle(), fx.items(spark, sf), request, "team")["outcomes"].select("record_key", "seq", "outcome", "state", F.col("wave").cast("bigint").alias("wave"), "after_cut")


@query(with_views("items", more=_RUN.replace("seq <= 2500", "seq <= 5000").replace("e > 150", "e > 100000"), body="SELECT outcome, count(*) AS n, CAST(ceil(log2(max(seq) / 100 + 1)) AS BIGINT) AS last_wave FROM t GROUP BY 1"))
def job_resumed(spark, sf):
    """A run that stops after two waves, goes on to the end of its canary, and then, promoted, to the end of its plan."""
    tables, request = Tables(spark, new_path(spark, "job")), Request(max_records=5000, canary=1000, max_errors=100_000, max_rate=1.0)
    plan_job(_Settle(), fx.items(spark, sf), request, tables)
    run_waves(_Settle(), request, tables, most_waves=2)
    run_waves(_Settle(), request, tables)
    run_waves(_Settle(), replace(request, promoted=True), tables)
    return tables.read("outcomes").groupBy("outcome").agg(F.count("*").alias("n")).join(F.broadcast(tables.read("outcomes").agg(F.max("wave").cast("bigint").alias("last_wave"))), F.lit(True))


_SENT = """c AS (SELECT i.record_key, i.sk, i.status AS old, i.version AS v, f.status AS said, i.sk % 13 = 0 AS sent FROM items i LEFT JOIN confirmations f ON f.reference = i.record_key),
  d AS (SELECT *, CASE WHEN old <> 'PENDING' THEN NULL WHEN said IS NULL THEN 'REJECTED' WHEN said <> 'SETTLED' THEN 'SKIPPED' WHEN sent OR sk % 11 = 0 THEN 'CONFLICT' ELSE 'REPAIRED' END AS outcome, v + (sk % 11 = 0)::INT AS v1 FROM c)"""


@query(with_views("items", "confirmations", more=_SENT, body="""SELECT record_key, CASE WHEN outcome = 'REPAIRED' THEN 'SETTLED' ELSE old END AS status, v1 + coalesce((outcome = 'REPAIRED')::INT, 0) AS version, outcome,
  outcome = 'REPAIRED' IS TRUE OR sent AS published FROM d"""))
def repair_commit(spark, sf):
    """Items and their events change in one version: some items were touched after planning, some events were there already."""
    tables, i = Tables(spark, new_path(spark, "payments")), fx.items(spark, sf)
    event = S.event_id(F.lit("job-9"), F.col("record_key"))
    sent = i.where("sk % 13 = 0").select(event.alias("eventId"), F.lit("job-9").alias("operationId"), F.col("record_key").alias("paymentId"), F.lit("{}").alias("payload"), F.lit("DELIVERED").alias("deliveryState"), F.col("version"))
    planned = tables.commit(0, replace={"items": i}, append={"outbox": sent})
    touched = i.withColumn("version", F.when(F.col("sk") % 11 == 0, F.col("version") + 1).otherwise(F.col("version")))
    tables.commit(planned, replace={"items": touched})
    version, outcomes = commit_repair(tables, fx.confirmations(spark, sf), "job-9", planned)
    published = tables.read("outbox", version).groupBy(F.col("paymentId").alias("record_key")).agg(F.count("*").alias("events"))
    out = tables.read("items", version).join(outcomes, "record_key", "left").join(published, "record_key", "left")
    return out.select("record_key", "status", "version", "outcome", F.coalesce(F.col("events") == 1, F.lit(False)).alias("published"))


@query("SELECT count(*) AS items, CAST(0 AS BIGINT) + count(*) FILTER (o_orderkey < 0) AS failed_items FROM orders")
def batched_items(spark, sf):
    """Every order goes through a user's function in some batch."""
    out = process_batches(fx.table(spark, sf, "orders").select("o_orderkey"), len, 500)
    return metrics.batch_counters(out).select("items", "failed_items")


# Streams -----------------------------------------------------------------------------------------


@query(with_views("messages", body="SELECT id, CASE WHEN CAST(receiveCount AS INT) >= 5 THEN 'POISON_NO_ACK' ELSE 'INSPECTED_NO_ACK' END AS outcome FROM messages"))
def poison_split(spark, sf):
    healthy, poison = streams.split_poison(streams.decode_envelopes(fx.messages(spark, sf)))
    return streams.inspect(healthy).select("id", "outcome").union(poison.select("id", "outcome"))


_FIRST = "f AS (SELECT business_id, id, sha256(body) AS hash, first_value(sha256(body)) OVER w AS fh, row_number() OVER w AS rn FROM messages WINDOW w AS (PARTITION BY business_id ORDER BY receivedAt, id))"


@query(with_views("messages", more=_FIRST, body="SELECT business_id, id, hash, CASE WHEN rn = 1 THEN 'NEW' WHEN hash = fh THEN 'DUPLICATE' ELSE 'CONFLICT' END AS delivery FROM f"))
def consume_idempotent(spark, sf):
    return streams.consume_batch(fx.messages(spark, sf))


#: State of streams is kept in RocksDB: one store a partition also for a join, of which a trigger saves what has changed.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def _rocks(spark):
    """Streams that start within keep their state as _STATE says."""
    had = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in had.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _message_log(spark, sf, name: str) -> tuple[str, int]:
    """All messages as a log in two segments by time, and how many there are."""
    path, m = new_path(spark, name), fx.messages(spark, sf)
    half = m.agg(F.percentile_approx("receivedAt", 0.5)).first()[0]
    append_log(m.where(F.col("receivedAt") <= half), path)
    return path, append_log(m.where(F.col("receivedAt") > half), path)


def _drained(spark, sf, work, name: str) -> DataFrame:
    """What ``work`` makes of the messages in order, a third of them a trigger."""
    path, n = _message_log(spark, sf, name)
    with _rocks(spark):
        return streams.drain(work(log_stream(spark, path, most=-(-n // 3))), path.rsplit("/", 1)[1], f"{path}/checkpoint", f"{path}/out", continuous=True)


@query(with_views("messages", more=_FIRST, body="SELECT business_id, id, hash, CASE WHEN rn = 1 THEN 'NEW' WHEN hash = fh THEN 'DUPLICATE' ELSE 'CONFLICT' END AS delivery FROM f"))
def consume_stream(spark, sf):
    return _drained(spark, sf, streams.consume_idempotent, "consumed")


@query(with_views("messages", more="o AS (SELECT id, row_number() OVER (ORDER BY receivedAt, id) AS n FROM messages)", body="SELECT id, CASE WHEN n <= 1500 THEN 1 ELSE 2 END AS run FROM o WHERE n <= 2345"))
def drained_messages(spark, sf):
    """Two runs that take 1,500 and then 845 messages, wherever files end."""
    path, _ = _message_log(spark, sf, "drained")
    for run, n in ((1, 1500), (2, 845)):
        out = streams.drain_messages(spark, path, f"{path}/checkpoint", f"{path}/out", n, lambda df, run=run: df.select("id", F.lit(run).alias("run")))
    return out


@query(with_views("messages", body="SELECT id, md5OfBody = '' OR lower(md5OfBody) = md5(body) AS md5_ok, CAST(receiveCount AS INT) AS receives, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN leaseUntil ELSE receivedAt + 90 END AS \"leaseUntil\" FROM messages"))
def message_files(spark, sf):
    """Envelopes in JSON files, read as a stream of several triggers; half of them say when their lease ends."""
    path = new_path(spark, "envelopes")
    m = fx.messages(spark, sf).select("id", "receipt", "body", "md5OfBody", "receiveCount", "receivedAt", F.when(F.col("id").cast("bigint") % 2 == 0, F.col("leaseUntil")).alias("leaseUntil"))
    m.repartition(5, "id").write.json(f"{path}/in")
    seen = streams.decode_envelopes(streams.read_messages(spark, f"{path}/in", files_per_trigger=2), 90)
    return streams.drain(seen.select("id", "md5_ok", "receives", "leaseUntil"), path.rsplit("/", 1)[1], f"{path}/checkpoint", f"{path}/out")


_WAITS = """t AS (SELECT id AS task, user_id AS queue, business_id AS id, receipt, receivedAt AS at, leaseUntil FROM messages WHERE CAST(id AS BIGINT) % 4 = 0),
  r AS (SELECT user_id AS queue, business_id AS id, receipt, receivedAt, leaseUntil FROM messages WHERE CAST(id AS BIGINT) % 4 <> 0),
  v AS (SELECT task, coalesce(r.id, t.id) AS id, r.receivedAt AS received_at, CASE WHEN r.id IS NULL THEN t.receipt ELSE r.receipt END AS receipt,
    CASE WHEN r.receivedAt IS NULL THEN CASE WHEN t.leaseUntil > t.at + 60 THEN 'VALID' ELSE 'NEEDS_RECEIVE' END WHEN r.id = t.id THEN CASE WHEN r.leaseUntil > r.receivedAt + 60 THEN 'VALID' ELSE 'NEEDS_RECEIVE' END
      WHEN r.leaseUntil > r.receivedAt THEN 'RELEASED' ELSE 'LEASE_EXPIRED' END AS verdict
    FROM t LEFT JOIN r ON r.queue = t.queue AND r.receivedAt BETWEEN t.at AND t.at + 43200),
  n AS (SELECT *, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY task ORDER BY received_at NULLS FIRST, id, receipt)),
  m AS (SELECT *, coalesce(max((verdict = 'VALID')::INT) OVER (PARTITION BY task ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WHERE n <= 3)"""


@query(with_views("messages", more=_WAITS, body="""SELECT task, CASE WHEN bool_or(verdict = 'VALID') THEN 'VALID' WHEN count(received_at) >= 3 THEN 'RECONCILIATION_REQUIRED' ELSE 'NEEDS_RECEIVE' END AS outcome,
   max(receipt) FILTER (verdict = 'VALID') AS receipt, count(received_at) AS receives, count(*) FILTER (verdict = 'RELEASED') AS released FROM m WHERE before = 0 GROUP BY 1"""))
def receipts_stream(spark, sf):
    """Messages that wait for receipts against what is received from their queues in half a day, as two streams over several triggers.

    A last message, long after the others, moves the watermarks past every window.
    """
    path, n = _message_log(spark, sf, "receipts")
    last = fx.messages(spark, sf).orderBy(F.desc("receivedAt")).limit(1)
    for k in (3, 4):
        append_log(last.withColumn("id", F.lit(str(-k))).withColumn("user_id", F.lit(-1).cast("bigint")).withColumn("receivedAt", F.col("receivedAt") + 100 * 86400), path)
    stream, number = lambda: log_stream(spark, path, most=-(-n // 3)), F.col("id").cast("bigint")
    tasks = stream().where(number % 4 == 0).select(F.col("id").alias("task"), F.col("user_id").alias("queue"), F.col("business_id").alias("id"), "receipt", F.col("receivedAt").alias("at"), "leaseUntil")
    receives = stream().where(number % 4 != 0).select(F.col("user_id").alias("queue"), F.col("business_id").alias("id"), "receipt", "receivedAt", "leaseUntil")
    with _rocks(spark):
        out = streams.drain(streams.receives_of_tasks(tasks, receives, 43_200, 60), "receipts", f"{path}/checkpoint", f"{path}/out", continuous=True)
    return streams.receipt_outcomes(out.where("task <> '-4'"), 3)


@query(with_views("messages", body="SELECT DISTINCT business_id AS id, 'replay' AS group_id, business_id AS dedup_id FROM messages"))
def replay_dedup(spark, sf):
    return streams.replay(fx.messages(spark, sf).select(F.col("business_id").alias("id")), fifo=True)


@query(with_views("messages", body="SELECT id, 'replay' AS group_id, id AS dedup_id FROM messages"))
def replay_stream(spark, sf):
    """Every message is in the stream twice and sent once."""

    twice = lambda m: m.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return _drained(spark, sf, lambda m: streams.replay(twice(m), fifo=True).select("id", "group_id", "dedup_id"), "replayed")


_LEASES = """l AS (SELECT user_id AS id, arg_max(receipt, (receivedAt, receipt)) AS receipt, arg_max(leaseUntil, (receivedAt, receipt)) AS leaseUntil, max(receivedAt) + 60 AS now FROM messages GROUP BY 1)"""


@query(with_views("messages", more=_LEASES, body="SELECT CAST(id AS VARCHAR) AS id, receipt, leaseUntil AS \"leaseUntil\", CASE WHEN leaseUntil > now + 15 THEN 'VALID' ELSE 'NEEDS_RECEIVE' END AS lease FROM l"))
def lease_state(spark, sf):
    m = fx.messages(spark, sf).select(F.col("user_id").cast("string").alias("id"), "receipt", "receivedAt", "leaseUntil", (F.col("receivedAt") + 60).alias("now"))
    return streams.lease_batch(m, 15)


@query(with_views("messages", more="d AS (SELECT id FROM messages WHERE CAST(id AS BIGINT) % 5 < 3)", body="SELECT id, false AS twice FROM d"))
def acknowledged_stream(spark, sf):
    """Outcomes are written before acknowledgements; conflicts aren't acknowledged."""
    path, n = new_path(spark, "acks"), F.col("id").cast("bigint")
    judged = fx.messages(spark, sf, stream=True).select("id", F.when(n % 5 < 3, "NEW").otherwise("CONFLICT").alias("delivery"))
    streams.ack_after_durable(judged, f"{path}/outcomes", f"{path}/acks", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/acks").groupBy("id").agg((F.count("*") > 1).alias("twice"))


@query(with_views("messages", body="SELECT business_id AS \"eventId\", count(DISTINCT business_id) AS sent FROM messages WHERE CAST(id AS BIGINT) % 4 <> 0 GROUP BY 1"))
def published_stream(spark, sf):
    """Pending events, which come several times, are delivered once."""
    path = new_path(spark, "outbox")
    box = fx.messages(spark, sf, stream=True).select(F.col("business_id").alias("eventId"), F.when(F.col("id").cast("bigint") % 4 == 0, "DELIVERED").otherwise("PENDING").alias("deliveryState"))
    streams.publish_outbox(box, f"{path}/sent", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/sent").groupBy("eventId").agg(F.count("*").alias("sent"))


@query(with_views("messages", body="SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'NEW' WHEN CAST(id AS BIGINT) % 3 = 1 THEN 'DUPLICATE' ELSE 'CONFLICT' END AS delivery FROM messages"))
def known_deliveries(spark, sf):
    m = fx.messages(spark, sf)
    n = F.col("id").cast("bigint")
    processed = m.where(n % 3 != 0).select("id", F.when(n % 3 == 1, S.sha256_hex("body")).otherwise(F.lit("other")).alias("payloadHash"))
    return mutate.known_delivery_split(m, processed, "id").select("id", "delivery")


@query(with_views("scan_pages", body="SELECT page_no, CAST(sum(scanned) OVER (ORDER BY page_no) AS BIGINT) AS running FROM scan_pages"))
def running_totals(spark, sf):
    return prefix_sums(fx.scan_pages(spark, sf), ["page_no"], running=F.col("scanned")).select("page_no", "running")


@query(with_views("tasks", body="SELECT CAST(seq AS VARCHAR) AS seq, record_key, outcome FROM tasks"))
def report_text(spark, sf):
    return report_lines(fx.tasks(spark, sf).select("seq", "record_key", "outcome"))


def repair_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Which open orders would be repaired, and how many of each outcome."""
    return _repaired(spark, sf)[1].groupBy("outcome").agg(F.count("*").alias("n"))


@query(with_views("items", "confirmations", more=_REP, body="SELECT outcome, count(*) AS n FROM rep GROUP BY 1"))
def repair_counts(spark, sf):
    return repair_preview(spark, sf)
