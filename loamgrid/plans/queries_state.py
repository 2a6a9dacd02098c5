"""Queries of ordered replays and of streams with typed state, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import replay as P
from loamgrid.plans.session import Scratch
from loamgrid.plans.views import view, with_views
from loamgrid.streaming import ops as T
from loamgrid.streaming import state as S

Q: dict = {}
O: dict = {}


def _q(name, fn, sql=None, *views):
    Q[name] = fn
    if sql:
        O[name] = with_views(sql, *views) if views else sql


def _streamed(s, d, table, made):
    """The table as a stream of its files, through ``made``, into a table."""
    k = Scratch(s, "stream")
    with S.typed_state(s):
        return k.finish(T.run_to_table(made(T.stream_table(s, f"{d}/{table}.parquet")), k))


# Budgets of addresses and accounts
_LIMIT = 250.0


def _spend(s, d):
    money = lambda name: view(s, d, name).withColumn("amount", (F.col("cents") / 100).cast("decimal(18,8)"))
    return P.budget_events(money("spend"), money("spent"))


_BUDGET = f"""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, kind, id, cents NULLS LAST) AS m FROM (
  SELECT day, id, ts, 'reserve' AS kind, ip, payer, cents FROM spend UNION ALL SELECT s.day, s.id, t.ts, 'settle', s.ip, s.payer, t.cents FROM spent t JOIN spend s ON s.id = t.id) x),
f AS (SELECT DISTINCT day, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS id, '' AS kind, '' AS outcome, CAST([] AS STRUCT(id BIGINT, ip VARCHAR, guest BOOLEAN, v BIGINT, r BIGINT, done BOOLEAN, users VARCHAR[])[]) AS held FROM ev
  UNION ALL SELECT day, m, id, kind, outcome, CASE WHEN outcome = 'admitted' THEN list_append(seen, {{'id': id, 'ip': ip, 'guest': payer IS NULL, 'v': cents, 'r': cents, 'done': false, 'users': CASE WHEN payer IS NULL THEN [] ELSE [payer] END}})
      WHEN outcome IN ('settled', 'overrun') THEN list_transform(held, lambda h: CASE WHEN h.id = gid THEN {{'id': h.id, 'ip': h.ip, 'guest': h.guest, 'v': cents, 'r': h.r, 'done': true, 'users': h.users}} ELSE h END) ELSE held END
  FROM (SELECT *, id AS gid, CASE WHEN kind = 'reserve' THEN CASE WHEN coalesce(list_sum(list_transform(list_filter(seen, lambda h: h.ip = eip), lambda h: h.v)), 0) + cents <= {int(_LIMIT * 100)}
        AND (payer IS NULL OR coalesce(list_sum(list_transform(list_filter(seen, lambda h: list_contains(h.users, epayer)), lambda h: h.v)), 0) + cents <= {int(_LIMIT * 100)}) THEN 'admitted' ELSE 'denied' END
      WHEN one IS NULL THEN 'missing' WHEN cents IS NULL THEN 'unknown' WHEN one.done THEN CASE WHEN one.v = cents THEN 'repeated' ELSE 'conflict' END WHEN cents > one.r THEN 'overrun' ELSE 'settled' END AS outcome
    FROM (SELECT ev.*, ev.ip AS eip, ev.payer AS epayer, held, list_filter(held, lambda h: h.id = ev.id)[1] AS one,
        CASE WHEN ev.payer IS NULL THEN held ELSE list_transform(held, lambda h: CASE WHEN h.guest AND h.ip = ev.ip AND NOT list_contains(h.users, ev.payer) THEN {{'id': h.id, 'ip': h.ip, 'guest': h.guest, 'v': h.v, 'r': h.r, 'done': h.done, 'users': list_append(h.users, ev.payer)}} ELSE h END) END AS seen
      FROM f JOIN ev ON ev.day = f.day AND ev.m = f.m + 1) a) b)
SELECT id, kind, outcome FROM f WHERE m > 0"""
_q("u10_budget_both_scopes", lambda s, d: P.budget_replay(_spend(s, d), _LIMIT), _BUDGET, "spend", "spent")
_q("u10_scope_groups", lambda s, d: P.scope_groups(_spend(s, d)),
   """WITH RECURSIVE e AS (SELECT DISTINCT a.day, a.ip, b.ip AS other FROM spend a JOIN spend b ON a.day = b.day AND a.payer = b.payer), r AS (SELECT DISTINCT day, ip, ip AS other FROM spend UNION SELECT r.day, r.ip, e.other FROM r JOIN e ON e.day = r.day AND e.ip = r.other)
 SELECT day, ip, min(other) AS "group" FROM r GROUP BY 1, 2""", "spend")


def _budget_stream(s, d):
    """The events are written with the groups of what is known, and read as a stream of files."""
    k = Scratch(s, "budget")
    events = _spend(s, d)
    at = k.path("events")
    events.join(P.scope_groups(events), ["day", "ip"]).write.parquet(at)
    with S.typed_state(s):
        return k.finish(T.run_to_table(S.budget_decisions(T.stream_table(s, at), _LIMIT), k))


_q("t5_budget_both_scopes", _budget_stream, _BUDGET, "spend", "spent")
_q("t5_budget_admission", lambda s, d: _streamed(s, d, "events", lambda e: S.budget_decisions(e.select(F.to_date("ts").alias("day"), (F.col("user_id") % 9).cast("string").alias("group"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("reserve").alias("kind"), (F.col("user_id") % 9).cast("string").alias("ip"), F.lit(None).cast("string").alias("payer"), (F.col("value").cast("decimal(18,8)") * F.lit(P.UNITS)).cast("long").alias("units")), 200.0).select("id", (F.col("outcome") == "admitted").alias("admitted"))),
   """WITH RECURSIVE ev AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, user_id % 9 AS ip, CAST(CAST(CAST(value AS DECIMAL(18,8)) AS DECIMAL(38,8)) * 100000000 AS BIGINT) AS units, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id % 9 ORDER BY ts, event_id) AS m FROM events),
f AS (SELECT DISTINCT day, ip, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS used, false AS admitted FROM ev
 UNION ALL SELECT f.day, f.ip, ev.m, ev.id, CASE WHEN used + units <= 20000000000 THEN used + units ELSE used END, used + units <= 20000000000 FROM f JOIN ev ON ev.day = f.day AND ev.ip = f.ip AND ev.m = f.m + 1)
SELECT id, admitted FROM f WHERE m > 0""")

# Answers in pieces; some refuse, some end with quotes whose heading is cut in two
_pieces = lambda c: c.selectExpr("conv_id as query_id", "turn as seq", "timestamp_seconds(1000000000 + conv_id % 50 * 3600 + turn) as ts", "text", "turn % 3 = 2 as last")
_q("t2_delta_assembly", lambda s, d: _streamed(s, d, "conversations", lambda c: S.answer_deltas(_pieces(c)).filter("ended is null or ended = 'last'").select("query_id", "seq", "visible", "refused")))
_CUT = """SELECT conv_id AS query_id, i AS seq, CASE WHEN i = 4 THEN CASE WHEN conv_id % 4 = 0 THEN '' ELSE '] "end"' END WHEN conv_id % 5 = 0 AND i = 0 THEN '  NO_ANS' WHEN conv_id % 5 = 0 AND i = 1 THEN 'WER because' WHEN conv_id % 5 = 1 AND i = 0 THEN 'NO_' WHEN conv_id % 3 = 0 AND i = 2 THEN concat(t, '   {n}**QUO') WHEN conv_id % 3 = 0 AND i = 3 THEN 'tes:**{n}[1' ELSE t END AS text
 FROM (SELECT conv_id, text AS t FROM {conversations} WHERE turn = 0) a JOIN (SELECT CAST(id AS INT) AS i FROM {five}) b ON true"""


def _answered(s, d):
    k = Scratch(s, "pieces")
    at = k.path("pieces")
    sql = _CUT.replace("{n}", "\\n").replace("{five}", "range(5)")
    s.sql(sql, conversations=s.read.parquet(f"{d}/conversations.parquet")).withColumns({"ts": F.timestamp_seconds(10**9 + F.col("query_id") * 7 + F.col("seq")), "last": F.col("seq") == 4}).write.parquet(at)
    with S.typed_state(s):
        out = T.run_to_table(S.answer_deltas(T.stream_table(s, at)), k)
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "visible"))), lambda x: x["visible"]), "")
        return k.finish(out.groupBy("query_id").agg(whole.alias("visible"), F.max("section").alias("section"), F.bool_or("refused").alias("refused")))


_q("t2_answers", _answered,
   f"""WITH p AS ({_CUT.replace('{n}', "' || chr(10) || '").replace('{five}', '(SELECT unnest(range(5)) AS id)').replace('{conversations}', 'conversations')}),
w AS (SELECT query_id, string_agg(text, '' ORDER BY seq) AS t FROM p GROUP BY 1), x AS (SELECT *, '(?i)(?:^|\\n)[ \\t]*[*_#>-]*[ \\t]*quotes[ \\t]*:?[ \\t]*[*_]*[ \\t]*(?:\\n|$)' AS q, starts_with(ltrim(t, ' ' || chr(10)), 'NO_ANSWER') AS refused FROM w),
y AS (SELECT *, regexp_extract(t, q) AS line FROM x)
SELECT query_id, CASE WHEN refused THEN '' WHEN line <> '' THEN rtrim(left(t, instr(t, line) - 1), ' ' || chr(10)) ELSE t END AS visible, CASE WHEN refused OR line = '' THEN '' ELSE substr(t, instr(t, line) + length(rtrim(line, chr(10)))) END AS section, refused FROM y""")

# T3
_q("t3_token_bucket", lambda s, d: _streamed(s, d, "events", lambda e: S.limited_requests(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")), 0.02)),
   """WITH RECURSIVE ev AS (SELECT user_id AS k, event_id AS id, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM events),
f AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS id, CAST(0.02 AS DOUBLE) AS tokens, CAST(0 AS DOUBLE) AS t, false AS ok, CAST(0 AS DOUBLE) AS had FROM ev
 UNION ALL SELECT k, m, id, CASE WHEN had >= 1 THEN had - 1 ELSE had END, t, had >= 1, had FROM (SELECT f.k, ev.m, ev.id, ev.t, least(CAST(0.02 AS DOUBLE), tokens + greatest(0, ev.t - f.t) * CAST(0.02 AS DOUBLE) / 60) AS had FROM f JOIN ev ON ev.k = f.k AND ev.m = f.m + 1) x)
SELECT id, ok AS admitted, CASE WHEN ok THEN 0 ELSE CAST(ceil((1 - had) * 60 / CAST(0.02 AS DOUBLE)) AS BIGINT) END AS retry_after FROM f WHERE m > 0""")
_q("t3_token_buckets", lambda s, d: _streamed(s, d, "events", lambda e: S.limited_requests(e.select((F.col("user_id") % 5).alias("key"), F.col("event_id").alias("id"), F.timestamp_seconds(10**9 + F.col("event_id") * 37 % 4000).alias("ts")), 6.0)),
   """WITH RECURSIVE ev AS (SELECT user_id % 5 AS k, event_id AS id, CAST(1000000000 + event_id * 37 % 4000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id * 37 % 4000, event_id) AS m FROM events),
f AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS id, CAST(6 AS DOUBLE) AS tokens, CAST(0 AS DOUBLE) AS t, false AS ok, CAST(0 AS DOUBLE) AS had FROM ev
 UNION ALL SELECT k, m, id, CASE WHEN had >= 1 THEN had - 1 ELSE had END, t, had >= 1, had FROM (SELECT f.k, ev.m, ev.id, ev.t, least(6, tokens + greatest(0, ev.t - f.t) * 6 / 60) AS had FROM f JOIN ev ON ev.k = f.k AND ev.m = f.m + 1) x)
SELECT id, ok AS admitted, CASE WHEN ok THEN 0 ELSE CAST(ceil((1 - had) * 60 / 6) AS BIGINT) END AS retry_after FROM f WHERE m > 0""")

# Requests of a key within a day of the first; one in ten failed, and one in ten is bound to no request
_ASKED = "SELECT user_id AS key, event_id AS id, ts, CASE WHEN event_id % 10 > 0 THEN concat('f', CAST(event_id % 2 AS STRING)) END AS fingerprint, event_type = 'error' AS failed FROM {events}"
_SAID = f"""WITH RECURSIVE r AS (SELECT * REPLACE (epoch_us(ts) / 1000000 AS ts) FROM ({_ASKED.format(events='events')}) x),
b AS (SELECT key, arg_min(id, {{'t': ts, 'i': id}}) AS id, min(ts) AS ts FROM r WHERE NOT failed GROUP BY 1
 UNION ALL SELECT key, id, ts FROM (SELECT b.key, r.id, r.ts, row_number() OVER (PARTITION BY b.key ORDER BY r.ts, r.id) AS n FROM b JOIN r ON r.key = b.key AND NOT r.failed AND r.ts >= b.ts + 86400) x WHERE n = 1),
w AS (SELECT r.*, b.id AS first, b.ts AS began, row_number() OVER (PARTITION BY r.id ORDER BY b.ts DESC, b.id DESC) AS n FROM r LEFT JOIN b ON b.key = r.key AND (b.ts < r.ts OR (b.ts = r.ts AND b.id <= r.id))),
o AS (SELECT w.*, (SELECT fingerprint FROM r q WHERE q.id = w.first) AS fp FROM w WHERE n = 1)
SELECT id, CASE WHEN first IS NULL OR ts >= began + 86400 THEN id ELSE first END AS first_id, CASE WHEN first IS NULL OR ts >= began + 86400 THEN 'failed' WHEN first = id THEN 'first' WHEN fingerprint IS NULL OR fingerprint IS NOT DISTINCT FROM fp THEN 'replayed' ELSE 'conflict' END AS outcome FROM o"""
_asked = lambda s, d: s.sql(_ASKED, events=s.read.parquet(f"{d}/events.parquet"))
_q("t7_idempotent_requests", lambda s, d: P.idempotent_requests(_asked(s, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).drop("ts")), _SAID)
_q("t7_idempotent_stream", lambda s, d: _streamed(s, d, "events", lambda e: S.idempotent_stream(e.selectExpr("user_id as key", "event_id as id", "cast(ts as timestamp) as ts", "case when event_id % 10 > 0 then concat('f', cast(event_id % 2 as string)) end as fingerprint", "event_type = 'error' as failed"))), _SAID)
