"""Queries of usage, conversation and evaluation operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import conversations as H
from loamgrid.operators import evaluation as E
from loamgrid.operators import usage as U
from loamgrid.plans.views import view, with_views

Q: dict = {}
O: dict = {}

PRICES = {"small": ("0.5000", "1.5000"), "large": ("2.2500", "9.7500")}


def _q(name, fn, sql=None, *views):
    Q[name] = fn
    if sql:
        O[name] = with_views(sql, *views) if views else sql


_q("u1_usage_summary", lambda s, d: U.usage_summary(view(s, d, "query_log"), ["tenant"]),
   """SELECT tenant, count(*) AS queries, count(*) FILTER (WHERE refused) AS refused, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
 CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(avg(latency_ms), 6) AS avg_latency_ms FROM query_log GROUP BY 1""", "query_log")
_q("u2_daily_series", lambda s, d: U.daily_series(view(s, d, "query_log")),
   "SELECT CAST(created_at AS DATE) AS day, count(*) AS queries, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens FROM query_log GROUP BY 1", "query_log")
_q("u3_query_cost", lambda s, d: U.query_cost(view(s, d, "query_log"), PRICES).select("id", F.col("cost").cast("double").alias("cost")),
   """WITH n AS (SELECT id, CASE split_part(model, '@', 1) WHEN 'small' THEN prompt_tokens * 50 + completion_tokens * 150 WHEN 'large' THEN prompt_tokens * 225 + completion_tokens * 975 END AS n FROM query_log)
 SELECT id, CAST(n // 100 + CASE WHEN n % 100 > 50 THEN 1 WHEN n % 100 = 50 THEN (n // 100) % 2 ELSE 0 END AS DOUBLE) / 1000000 AS cost FROM n""", "query_log")
_q("u4_cost_by_model", lambda s, d: U.query_cost(view(s, d, "query_log"), PRICES).groupBy(F.split_part("model", F.lit("@"), F.lit(1)).alias("base")).agg(F.count("cost").alias("priced"), F.count(F.lit(1)).alias("n")),
   "SELECT split_part(model, '@', 1) AS base, count(*) FILTER (WHERE split_part(model, '@', 1) <> 'unknown') AS priced, count(*) AS n FROM query_log GROUP BY 1", "query_log")
_q("u5_reservation_bound", lambda s, d: view(s, d, "docs").select("doc_id", U.reservation_bound(F.col("text"), "2.2500").cast("double").alias("bound")),
   "SELECT doc_id, ceil((strlen(text) + 1024) * 2.25 * 100) / 100000000.0 AS bound FROM docs", "docs")
_q("u6_ledger_totals", lambda s, d: U.ledger_totals(view(s, d, "ledger"), ["day", "ip_digest"]).withColumns({c: F.col(c).cast("double") for c in ("spent", "reserved")}),
   "SELECT day, ip_digest, CAST(coalesce(sum(actual), 0) AS DOUBLE) AS spent, CAST(coalesce(sum(amount) FILTER (WHERE actual IS NULL), 0) AS DOUBLE) AS reserved FROM ledger GROUP BY 1, 2",
   "ledger")
_q("u7_remaining_allowance", lambda s, d: U.remaining_allowance(U.ledger_totals(view(s, d, "ledger"), ["day", "ip_digest"]), "day", 2000.0).withColumn("remaining", F.col("remaining").cast("double")),
   """WITH t AS (SELECT day, ip_digest, coalesce(sum(actual), 0) + coalesce(sum(amount) FILTER (WHERE actual IS NULL), 0) AS used FROM ledger GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY used DESC, ip_digest DESC) AS n FROM t)
 SELECT day, ip_digest AS scope, CAST(greatest(0, 2000.0 - used) AS DOUBLE) AS remaining, CAST(day + INTERVAL 1 DAY AS DATE) AS reset_day FROM r WHERE n = 1""", "ledger")
_q("u8_guest_import", lambda s, d: U.guest_import(view(s, d, "ledger")),
   """SELECT reservation_id, concat('ip:', ip_digest) AS scope FROM ledger UNION SELECT reservation_id, concat('user:', CAST(payer AS STRING)) FROM ledger WHERE payer IS NOT NULL""", "ledger")
_q("u9_settlement", lambda s, d: U.settlement(view(s, d, "ledger").withColumn("reservation_id", F.col("reservation_id") % 500)).withColumn("settled", F.col("settled").cast("double")),
   """SELECT reservation_id % 500 AS reservation_id, CAST(arg_min(actual, ts) AS DOUBLE) AS settled, count(DISTINCT actual) > 1 AS conflict,
 coalesce(arg_min(actual, ts) > max(amount), false) AS overrun FROM ledger GROUP BY 1""", "ledger")
_q("u10_admission_replay", lambda s, d: U.admission_replay(view(s, d, "ledger"), 500.0),
   """WITH RECURSIVE ev AS (SELECT day, ip_digest AS ip, reservation_id AS id, CAST(CAST(amount AS DECIMAL(38,8)) * 100000000 AS BIGINT) AS units, row_number() OVER (PARTITION BY day, ip_digest ORDER BY ts, reservation_id) AS m FROM ledger),
 f AS (SELECT DISTINCT day, ip, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS used, false AS admitted FROM ev
 UNION ALL SELECT f.day, f.ip, ev.m, ev.id, CASE WHEN used + units <= 50000000000 THEN used + units ELSE used END, used + units <= 50000000000 FROM f JOIN ev ON ev.day = f.day AND ev.ip = f.ip AND ev.m = f.m + 1)
 SELECT id AS reservation_id, admitted FROM f WHERE m > 0""", "ledger")
_q("u11_ingest_status", lambda s, d: U.ingest_status(view(s, d, "docs")),
   """SELECT collection, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
 count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'failed') AS failed,
 CAST(coalesce(sum(size_bytes) FILTER (WHERE status IN ('pending', 'processing')), 0) AS BIGINT) AS queued_bytes, count(*) FILTER (WHERE access_label <> 'all') AS restricted FROM docs GROUP BY 1""", "docs")
_q("u12_eta", lambda s, d: U.eta_seconds(view(s, d, "docs")),
   """WITH r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY processed_s DESC, doc_id DESC) AS n FROM docs WHERE status = 'ready'),
 v AS (SELECT collection, sum(size_bytes) AS b, sum(processed_s - created_s) AS s FROM r WHERE n <= 20 GROUP BY 1),
 q AS (SELECT collection, coalesce(sum(size_bytes) FILTER (WHERE status IN ('pending', 'processing')), 0) AS queued FROM docs GROUP BY 1)
 SELECT q.collection, CASE WHEN queued > 0 THEN CAST(greatest(1, ceil(queued / (b / s))) AS BIGINT) END AS eta_s FROM q LEFT JOIN v ON q.collection = v.collection""", "docs")
_q("u13_collection_counts", lambda s, d: U.counts_per_collection(view(s, d, "docs").filter("status = 'failed'"), view(s, d, "docs").select("collection").distinct()),
   "SELECT collection, count(*) FILTER (WHERE status = 'failed') AS documents FROM docs GROUP BY 1", "docs")
_q("u14_restricted_labels", lambda s, d: U.restricted_labels(view(s, d, "docs"), "collection"),
   """SELECT collection, concat_ws(',', CASE WHEN bool_or(access_label = 'managers') THEN 'managers' END, CASE WHEN bool_or(access_label = 'hr') THEN 'hr' END,
 CASE WHEN bool_or(access_label = 'finance') THEN 'finance' END, CASE WHEN bool_or(access_label = 'leadership') THEN 'leadership' END) AS labels FROM docs GROUP BY 1""", "docs")
_q("u15_listing_page", lambda s, d: U.listing_page(view(s, d, "docs"), 40, 20),
   "SELECT doc_id, created_s, (SELECT count(*) FROM docs) AS total FROM docs ORDER BY created_s DESC, doc_id DESC LIMIT 20 OFFSET 40", "docs")
_q("u16_passage_page", lambda s, d: U.passage_page(view(s, d, "chunks"), ["all", "hr"], 4, 3),
   """WITH p AS (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) - 1 AS pos,
 count(*) FILTER (WHERE chunk_index < 4) OVER (PARTITION BY document_id) AS before FROM chunks WHERE access_label IN ('all', 'hr'))
 SELECT document_id, chunk_id, CAST(pos AS INT) AS pos FROM p WHERE pos >= greatest(0, before - 1) AND pos < greatest(0, before - 1) + 3""", "chunks")
_q("u17_document_lock", lambda s, d: U.document_lock(view(s, d, "docs"), view(s, d, "role_labels")),
   "SELECT doc_id, role, NOT bool_or(label = access_label) AS locked FROM docs CROSS JOIN role_labels GROUP BY doc_id, role, access_label", "docs", "role_labels")
_q("u18_storage_usage", lambda s, d: U.storage_usage(view(s, d, "docs"), 500_000),
   "SELECT tenant, CAST(sum(size_bytes) AS BIGINT) AS used_bytes, count(*) AS documents, sum(size_bytes) > 500000 AS over FROM docs GROUP BY 1".replace(" over ", ' "over" '), "docs")
_q("u19_orphan_originals", lambda s, d: U.orphan_originals(view(s, d, "docs").select("tenant", F.sha2("text", 256).alias("sha256")).distinct(), view(s, d, "docs").filter("status <> 'failed'").withColumn("sha256", F.sha2("text", 256))),
   """SELECT DISTINCT tenant, sha256(text) AS sha256 FROM docs a WHERE NOT EXISTS (SELECT 1 FROM docs b WHERE b.status <> 'failed' AND b.tenant = a.tenant AND b.text = a.text)""", "docs")
_q("u20_recovery_sweep", lambda s, d: U.recovery_sweep(view(s, d, "docs"), 20000),
   """SELECT doc_id, status, created_s FROM docs WHERE (status = 'pending' AND created_s < 19940) OR (status = 'processing' AND created_s < 19340) ORDER BY created_s, doc_id LIMIT 100""", "docs")
_q("u21_retry_schedule", lambda s, d: U.retry_schedule(view(s, d, "docs")),
   """SELECT doc_id, attempts, CASE WHEN status = 'failed' AND attempts BETWEEN 1 AND 3 THEN processed_s + CAST(10 * power(2, attempts - 1) AS BIGINT) END AS next_attempt_s,
 status = 'failed' AND attempts >= 4 AS exhausted FROM docs""", "docs")
_q("u22_auto_sync_due", lambda s, d: U.auto_sync_due(view(s, d, "docs").selectExpr("doc_id as source_id", "status", "created_s as last_s", "(attempts + 1) * 3600 as interval_s", "processed_s as lease_s"), 50000),
   "SELECT doc_id AS source_id, status FROM docs WHERE created_s + (attempts + 1) * 3600 <= 50000 OR (status IN ('queued', 'partial') AND processed_s < 50000)", "docs")
_q("u23_reprocess_selection", lambda s, d: U.reprocess_selection(view(s, d, "docs"), "src3", "7.md"), "SELECT doc_id, filename FROM docs WHERE collection = 'src3' AND lower(filename) LIKE '%7.md'", "docs")
_q("u24_visible_collections", lambda s, d: U.visible_collections(
    s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as collection", "c_nationkey as tenant", "c_acctbal > 0 as is_public", "c_mktsegment = 'FURNITURE' as read_only"),
    s.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey as id", "case when n_regionkey = 1 then 'service' else 'personal' end as kind", "n_nationkey % 2 = 0 as is_active"), 3),
   """SELECT c_custkey AS collection FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = 3 OR (c_acctbal > 0 AND c_mktsegment = 'FURNITURE' AND n_regionkey = 1 AND n_nationkey % 2 = 0)""")
_q("u25_slugify", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", U.slugify(F.col("url")).alias("slug")),
   "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
_q("t4_daily_quota", lambda s, d: U.tenure(view(s, d, "query_log"), 3),
   "SELECT id, row_number() OVER (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY created_at, id) <= 3 AS admitted FROM query_log", "query_log")
_q("t6_attempt_windows", lambda s, d: U.fixed_window_attempts(view(s, d, "query_log"), 900, 1),
   "SELECT user_id, CAST(floor(epoch(created_at) / 900) AS BIGINT) AS period, count(*) AS attempts, count(*) > 1 AS blocked FROM query_log GROUP BY 1, 2", "query_log")
_q("t7_idempotent_replay", lambda s, d: U.idempotent_replay(view(s, d, "query_log").withColumn("model", F.col("refused").cast("string"))),
   """SELECT id, first_value(id) OVER w AS first_id, first_value(refused) OVER w <> refused AS conflict FROM query_log
 WINDOW w AS (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "query_log")
_q("t8_lease_audit", lambda s, d: U.lease_audit(s.read.parquet(f"{d}/events.parquet"), [("view", "click"), ("click", "purchase"), ("signup", "view")]),
   """SELECT before, after, count(*) AS n, concat(before, '>', after) IN ('view>click', 'click>purchase', 'signup>view') AS legal FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events) x WHERE before IS NOT NULL GROUP BY 1, 2""")

_q("h1_keyset_page", lambda s, d: H.keyset_page(view(s, d, "turns"), (2, 10**9), 10),
   """WITH p AS (SELECT id, created_at FROM turns WHERE created_at < 2 OR (created_at = 2 AND id < 1000000000) ORDER BY created_at DESC, id DESC LIMIT 11)
 SELECT id, created_at, (SELECT count(*) FROM p) > 10 AS has_more FROM p ORDER BY created_at DESC, id DESC LIMIT 10""", "turns")
_q("h2_latest_turn", lambda s, d: H.latest_turn(view(s, d, "turns")),
   "SELECT conv_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at DESC, id DESC) AS n FROM turns) x WHERE n = 1", "turns")
_q("h3_cursor", lambda s, d: view(s, d, "turns").select("id", H.cursor(F.col("created_at"), F.col("id")).alias("cursor"), H.decode_cursor(H.cursor(F.col("created_at"), F.col("id"))).alias("back")),
   """SELECT id, rtrim(translate(base64(encode(concat('{"t":', created_at, ',"id":', id, '}'))), '+/', '-_'), '=') AS cursor, concat('{"t":', created_at, ',"id":', id, '}') AS back FROM turns""", "turns")
_q("h4_parent_chain", lambda s, d: H.parent_chain(view(s, d, "turns")),
   """WITH RECURSIVE c AS (SELECT id AS leaf, id AS at, parent_id, context_reset, 0 AS hop FROM turns UNION ALL
 SELECT c.leaf, t.id, t.parent_id, t.context_reset, c.hop + 1 FROM c JOIN turns t ON t.id = c.parent_id WHERE NOT c.context_reset AND c.hop < 4)
 SELECT leaf, c.at AS ancestor, hop FROM c WHERE hop > 0""", "turns")
_q("h5_snapshot_reset", lambda s, d: H.snapshot_reset(view(s, d, "turns")),
   """WITH RECURSIVE c AS (SELECT id AS leaf, id AS at, parent_id, context_reset, false AS bad, 0 AS hop FROM turns UNION ALL
 SELECT c.leaf, t.id, t.parent_id, t.context_reset, t.generation <> t.seen_generation, c.hop + 1 FROM c JOIN turns t ON t.id = c.parent_id WHERE NOT c.context_reset AND c.hop < 4)
 SELECT leaf, bool_or(bad) AS reset, count(*) AS chain FROM c WHERE hop > 0 GROUP BY 1""", "turns")
_q("h6_access_fingerprint", lambda s, d: view(s, d, "turns").select("id", F.when(F.col("user_id") % 2 == 0, "hr").otherwise("finance").alias("role")).join(H.access_fingerprint(view(s, d, "role_labels")), "role").select("id", "fingerprint"),
   """SELECT id, CASE WHEN user_id % 2 = 0 THEN sha256('["hr",["all","hr","managers"]]') ELSE sha256('["finance",["all","finance","managers"]]') END AS fingerprint FROM turns""", "turns")
_q("h7_budgeted_turns", lambda s, d: H.budgeted_turns(view(s, d, "turns"), 120),
   """WITH k AS (SELECT id, conv_id, created_at, greatest(1, CAST(round_even(len(regexp_extract_all(text, '[^\\t-\\r ]+')) * 1.3, 0) AS BIGINT)) AS tokens FROM turns),
 r AS (SELECT id, conv_id, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY created_at DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM k) SELECT * FROM r WHERE total <= 120""", "turns")
_q("h8_reference_selection", lambda s, d: H.reference_selection(view(s, d, "ranked")),
   """WITH f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list_no, rank) AS n FROM ranked),
 p AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank, chunk_id) AS pick FROM f WHERE n = 1) SELECT query_id, chunk_id, CAST(pick AS INT) AS pick FROM p WHERE pick <= 6""", "ranked")
_q("h9_follow_up", lambda s, d: view(s, d, "turns").withColumn("turn", F.col("created_at")).select("id", H.follow_up(F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"action":"search","effective_question":"'), "role", F.lit('"}'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"action":"clarify","question":"'), "role", F.lit('"}'))).otherwise(F.lit('{"action":"search"}'))).alias("x")).select("id", "x.action", "x.text"),
   "SELECT id, CASE WHEN created_at % 3 = 0 THEN 'search' ELSE 'clarify' END AS action, CASE WHEN created_at % 3 < 2 THEN role END AS text FROM turns", "turns")
_q("h10_history", lambda s, d: H.history_with_sources(view(s, d, "ranked").select("query_id").distinct(), view(s, d, "ranked").filter("list_no = 1 and rank <= 5")),
   """SELECT q.query_id, coalesce(string_agg(CAST(chunk_id AS STRING), ',' ORDER BY rank, chunk_id) FILTER (WHERE rank <= 5 AND list_no = 1), '') AS sources FROM ranked q GROUP BY 1""", "ranked")
_q("h11_transfer", lambda s, d: H.transfer_ownership(view(s, d, "turns"), view(s, d, "turns").filter("conv_id % 5 = 0").select("conv_id", (F.col("conv_id") + 900).alias("claimed_by")).distinct()),
   "SELECT id, CASE WHEN conv_id % 5 = 0 THEN conv_id + 900 ELSE user_id END AS user_id FROM turns", "turns")
_q("h12_backfill", lambda s, d: H.backfill(view(s, d, "turns")),
   "SELECT collection_id, user_id, min(id) AS conversation_id, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS turns FROM turns GROUP BY 1, 2", "turns")
_q("h13_question_shape", lambda s, d: view(s, d, "turns").groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("q")).select("conv_id", F.array_join(F.transform(H.upgrade_questions(F.col("q")), lambda x: F.concat(x["question"], F.lit("/"), x["min_role"])), ",").alias("up"), F.array_join(H.downgrade_questions(H.upgrade_questions(F.col("q"))), ",").alias("down")),
   "SELECT conv_id, string_agg(concat(role, '/employee'), ',' ORDER BY role) AS up, string_agg(role, ',' ORDER BY role) AS down FROM turns GROUP BY 1", "turns")
_q("h14_constraint_audit", lambda s, d: H.constraint_audit(view(s, d, "turns")),
   "SELECT 'text_length' AS rule, count(*) AS rows, min(id) AS first_id FROM turns WHERE length(text) < 1 OR length(text) > 400 HAVING count(*) > 0".replace(" AS rows", ' AS "rows"'), "turns")

_q("e1_recall_hit", lambda s, d: view(s, d, "ranked").groupBy("query_id").agg(F.collect_set(F.when((F.col("list_no") == 1) & (F.col("rank") <= 8), F.col("chunk_id"))).alias("found"), F.collect_set(F.when((F.col("list_no") == 2) & (F.col("rank") <= 2), F.col("chunk_id"))).alias("expected")).select("query_id", E.recall_hit(F.col("expected"), F.col("found")).alias("hit")),
   """WITH e AS (SELECT DISTINCT query_id, chunk_id FROM ranked WHERE list_no = 2 AND rank <= 2), f AS (SELECT DISTINCT query_id, chunk_id FROM ranked WHERE list_no = 1 AND rank <= 8)
 SELECT q.query_id, bool_and(f.chunk_id IS NOT NULL) FILTER (WHERE e.chunk_id IS NOT NULL) AS hit FROM (SELECT DISTINCT query_id FROM ranked) q LEFT JOIN e ON q.query_id = e.query_id
 LEFT JOIN f ON f.query_id = e.query_id AND f.chunk_id = e.chunk_id GROUP BY 1""", "ranked")
_q("e2_recall_by_category", lambda s, d: E.recall_by_category(view(s, d, "judged")),
   "SELECT category, round(avg(quality), 9) AS recall, round(avg(gate), 9) AS mean_gate, count(*) AS n FROM judged GROUP BY ROLLUP (category)", "judged")
_SWEEP = """SELECT threshold, round(a, 9) AS refusal_rate, round(b, 9) AS pass_rate, round((a + b) / 2, 9) AS balanced FROM (SELECT i / 100 AS threshold,
 count(*) FILTER (WHERE quality = 0 AND {g} < i / 100) / count(*) FILTER (WHERE quality = 0) AS a,
 count(*) FILTER (WHERE quality = 1 AND {g} >= i / 100) / count(*) FILTER (WHERE quality = 1) AS b FROM judged, range(10, 71, 2) t(i) GROUP BY i) x"""
_sweep = lambda s, d, g: E.threshold_sweep(view(s, d, "judged"), F.col("quality") == 1, g)
_q("e3_threshold_sweep", lambda s, d: _sweep(s, d, F.col("gate")), _SWEEP.format(g="gate"), "judged")
_q("e4_recommended_threshold", lambda s, d: E.recommend_threshold(_sweep(s, d, F.col("gate"))),
   f"SELECT coalesce(max(threshold) FILTER (WHERE pass_rate >= 0.95), arg_max(threshold, balanced * 1000 + threshold / 1000000)) AS threshold FROM ({_SWEEP.format(g='gate')}) s", "judged")
_q("e5_answer_metrics", lambda s, d: E.answer_metrics(view(s, d, "judged")),
   """SELECT category, count(*) AS n, count(*) FILTER (WHERE refused) AS refused, count(*) FILTER (WHERE refused AND quality = 1) AS false_refusals,
 count(*) FILTER (WHERE NOT refused AND quality = 1) AS right_sources FROM judged GROUP BY 1""", "judged")
_q("e6_verdict", lambda s, d: view(s, d, "judged").select("doc_id", E.verdict(F.concat(F.lit("Reason. VERDICT: "), F.when(F.col("quality") == 1, "Pass").when(F.col("toxic") == 1, "fail").otherwise("?"))).alias("ok")),
   "SELECT doc_id, quality = 1 AS ok FROM judged", "judged")
_q("e7_leak_test", lambda s, d: E.leak_test(view(s, d, "chunks").withColumn("role", F.when(F.col("document_id") % 2 == 0, "hr").otherwise("employee")), view(s, d, "role_labels")),
   """SELECT role, count(*) AS shown, count(*) FILTER (WHERE NOT (access_label = 'all' OR (role = 'hr' AND access_label IN ('managers', 'hr')))) AS leaks
 FROM (SELECT *, CASE WHEN document_id % 2 = 0 THEN 'hr' ELSE 'employee' END AS role FROM chunks) x GROUP BY 1""", "chunks")
_q("e8_miss_list", lambda s, d: E.miss_list(view(s, d, "judged")),
   "SELECT category, doc_id, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS n FROM judged WHERE quality = 0) x WHERE n <= 5", "judged")
_q("e9_route_collection", lambda s, d: s.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.collect_set(F.concat(F.lit("d-"), F.upper("lang"))).alias("e")).select("source", E.route_collection(F.col("e")).alias("route")),
   "SELECT source, CASE WHEN bool_or(lang = 'de') THEN 'de' ELSE 'default' END AS route FROM documents GROUP BY 1")
_q("e11_heading_recall", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", E.heading_recall(F.array(F.lit("One"), F.lit("Two"), F.col("lang")), F.array(F.lit("  one"), F.lit("de"))).alias("recall")),
   "SELECT doc_id, CASE WHEN lang = 'de' THEN 2.0 / 3 ELSE 1.0 / 3 END AS recall FROM documents")
_q("e12_variant_summary", lambda s, d: E.variant_summary(s.read.parquet(f"{d}/events.parquet"), "event_type", "value"),
   "SELECT event_type, round(avg(value), 6) AS mean, median(value) AS median, count(*) AS n FROM events GROUP BY 1")
_q("e13_gate_or_sentinel", lambda s, d: _sweep(s, d, F.when(F.col("refused"), F.lit(-1.0)).otherwise(F.col("gate"))), _SWEEP.format(g="(CASE WHEN refused THEN -1.0 ELSE gate END)"), "judged")
_T = "(SELECT query_id, max(chunk_id) AS chunk_id FROM ranked GROUP BY 1)"
_targets = lambda s, d: view(s, d, "ranked").groupBy("query_id").agg(F.max("chunk_id").alias("chunk_id"))
_q("e14_rank_bands", lambda s, d: E.rank_bands(view(s, d, "ranked").filter("list_no = 1"), _targets(s, d)),
   f"""WITH b AS (SELECT t.query_id, min(r.rank) AS r FROM {_T} t LEFT JOIN (SELECT * FROM ranked WHERE list_no = 1) r ON r.query_id = t.query_id AND r.chunk_id = t.chunk_id GROUP BY 1)
 SELECT CASE WHEN r <= 20 THEN '1-20' WHEN r <= 150 THEN '21-150' ELSE 'absent' END AS band, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 9) AS share FROM b GROUP BY 1""", "ranked")
_q("r18_coverage_sweep", lambda s, d: E.coverage_sweep(view(s, d, "ranked").filter("list_no = 1"), _targets(s, d), [8, 16, 24, 32, 40]),
   f"""WITH b AS (SELECT t.query_id, min(r.rank) AS r FROM {_T} t LEFT JOIN (SELECT * FROM ranked WHERE list_no = 1) r ON r.query_id = t.query_id AND r.chunk_id = t.chunk_id GROUP BY 1)
 SELECT CAST(cap AS INT) AS cap, count(*) FILTER (WHERE r <= cap) AS covered, count(*) AS queries FROM b, (VALUES (8), (16), (24), (32), (40)) c(cap) GROUP BY 1""", "ranked")
