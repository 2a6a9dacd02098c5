"""Queries of schemas, typed fields, corrections, exports, usage, reranked contexts and golden questions, and their SQL."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from loamgrid.operators import corpus as V
from loamgrid.operators import documents as D
from loamgrid.operators import extraction as X
from loamgrid.operators import golden as N
from loamgrid.operators import retrieval as R
from loamgrid.operators import usage as U
from loamgrid.plans.queries_semantics import _HEAD, _TOK, _W, _pipeline_sql
from loamgrid.plans.views import view, with_views

Q: dict = {}
O: dict = {}


def _q(name, fn, sql=None, *views):
    Q[name] = fn
    if sql:
        O[name] = with_views(sql, *views) if views else sql


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


# The last ten days of the log, with costs
_PRICES = {"small": ("0.15", "0.6"), "large": ("2.5", "10")}


def _recent(s, d):
    log = U.query_cost(view(s, d, "query_log"), _PRICES)
    now = log.agg(F.max("created_at")).first()[0]  # one value
    return U.since(log, F.lit(now), 10)


_COST = """c AS (SELECT *, CASE split_part(model, '@', 1) WHEN 'small' THEN round_even((prompt_tokens * 15 + completion_tokens * 60) / 100.0 / 1000000, 6) WHEN 'large' THEN round_even((prompt_tokens * 25 + completion_tokens * 100) / 10.0 / 1000000, 6) END AS cost
 FROM query_log WHERE created_at >= (SELECT max(created_at) FROM query_log) - INTERVAL 10 DAY)"""
_q("u1_recent_usage", lambda s, d: U.cost_summary(_recent(s, d), ["tenant"]).withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 4)),
   f"WITH {_COST} SELECT tenant, count(*) AS queries, CAST(count_if(refused) AS BIGINT) AS refused, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, round(avg(latency_ms), 6) AS avg_latency_ms, round(CAST(coalesce(sum(cost), 0) AS DOUBLE), 4) AS cost_usd FROM c GROUP BY 1", "query_log")
_q("u2_recent_days", lambda s, d: U.daily_cost(_recent(s, d), ["tenant"]).withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 4)),
   f"WITH {_COST} SELECT tenant, CAST(created_at AS DATE) AS day, count(*) AS queries, round(CAST(coalesce(sum(cost), 0) AS DOUBLE), 4) AS cost_usd FROM c GROUP BY 1, 2", "query_log")
_q("u25_slug_fallback", lambda s, d: _t(s, d, "pages").select("page_id", U.slugify(F.when(F.col("page_id") % 3 == 0, F.lit(" §!? ")).otherwise(F.col("url")), F.col("page_id")).alias("slug")),
   "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'collection-' || left(sha256(CAST(page_id AS VARCHAR)), 8) ELSE trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM pages")
_q("u23_reprocess_suffix", lambda s, d: U.reprocess_selection(view(s, d, "docs"), "src3", ".md"), "SELECT doc_id, filename FROM docs WHERE collection = 'src3' AND lower(filename) LIKE '%.md'", "docs")
_q("q8_settled_collections", lambda s, d: X.settle_trigger(view(s, d, "docs").withColumn("collection", F.col("doc_id") % 21)),
   "SELECT doc_id % 21 AS collection, arg_max(doc_id, processed_s * 1000000 + doc_id) AS last_doc FROM docs GROUP BY 1 HAVING count_if(status IN ('pending', 'processing')) = 0", "docs")

# A table of schemas
def _schemas(s, d):
    spec = lambda name, kind, values=None: F.struct(name.alias("name"), kind.alias("type"), (F.lit(None) if values is None else values).cast("array<string>").alias("enum_values"))
    size = F.col("p_size")
    three = F.array(
        spec(F.lower(F.substring_index("p_name", " ", 1)), F.lit("string")), spec(F.lit("a"), F.when(size % 2 == 0, "enum").otherwise("number"), F.when(size % 3 == 0, F.array(F.lit("x")))), spec(F.when(size % 5 == 0, "a").otherwise("Bad Name"), F.lit("text")),
    )
    return _t(s, d, "part").select(F.col("p_partkey").alias("schema_id"), F.array_repeat(F.lit("a > 1"), (F.col("p_partkey") % 23).cast("int")).alias("rules"), F.slice(three, F.lit(1), (size % 4).cast("int")).alias("fields"))


_q("x1_schema_issues", lambda s, d: X.schema_issues(_schemas(s, d)),
   """WITH p AS (SELECT p_partkey AS id, p_size AS z, p_size % 4 AS n, lower(split_part(p_name, ' ', 1)) AS w FROM part)
 SELECT id AS schema_id, unnest(list_filter([CASE WHEN n >= 1 AND NOT regexp_full_match(w, '[a-z][a-z0-9_]{0,63}') THEN 'bad name: ' || w END, CASE WHEN n >= 3 AND z % 5 > 0 THEN 'bad name: Bad Name' END,
  CASE WHEN (n >= 2 AND w = 'a') OR (n >= 3 AND z % 5 = 0) THEN 'repeated name: a' END, CASE WHEN n >= 3 AND z % 5 > 0 AND w = 'Bad Name' THEN 'repeated name: Bad Name' END, CASE WHEN n >= 3 THEN 'bad type: ' || CASE WHEN z % 5 = 0 THEN 'a' ELSE 'Bad Name' END END,
  CASE WHEN n >= 2 AND z % 2 = 0 AND z % 3 <> 0 THEN 'enum without values: a' END, CASE WHEN n >= 2 AND z % 2 = 1 AND z % 3 = 0 THEN 'values without enum: a' END, CASE WHEN n = 0 THEN 'no fields' END, CASE WHEN id % 23 > 20 THEN 'too many rules' END], lambda x: x IS NOT NULL)) AS issue FROM p""")

# Raw values of orders
_SPECS = [{"name": "total", "type": "number", "required": True}, {"name": "day", "type": "date", "required": True}, {"name": "status", "type": "enum", "enum_values": ["F", "O"]}, {"name": "urgent", "type": "boolean"}, {"name": "tags", "type": "array", "required": True}, {"name": "clerk", "type": "string", "pattern": r"C\d+"}]
_RULES = ["total > 100000", "urgent and total > 1", "tags > total", "day >= '1995-01-01'", "nothing > 1"]


def _raw(s, d):
    k = F.col("o_orderkey")
    row = lambda name, v: F.struct(F.lit(name).alias("field"), v.cast("string").alias("raw"))
    rows = [row("total", F.when(k % 7 == 0, "n/a").when(k % 7 == 1, "").otherwise(F.round("o_totalprice").cast("long").cast("string"))), row("day", F.when(k % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")), row("status", F.lower("o_orderstatus")), row("urgent", F.element_at(F.array(F.lit("yes"), F.lit("nein"), F.lit("maybe"), F.lit(None)), (k % 4 + 1).cast("int"))), row("tags", F.when(k % 3 > 0, "a; b, c").when(k % 2 == 0, " ; ")), row("clerk", F.concat(F.when(k % 2 == 0, "C").otherwise("X"), k.cast("string")))]
    return _t(s, d, "orders").select(k.alias("doc_id"), F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")


_TYPED = """r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 > 1 THEN round(o_totalprice) END AS total, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS urgent, o_orderkey % 3 > 0 AS tags FROM orders)"""
_q("x7_issues", lambda s, d: X.validate_fields(_raw(s, d), _SPECS, _RULES)[1],
   f"""WITH {_TYPED} SELECT k AS doc_id, i.f AS field, i.c AS code FROM (SELECT k, unnest(list_filter([CASE WHEN k % 7 = 0 THEN {{'f': 'total', 'c': 'type_mismatch'}} END, CASE WHEN total IS NULL THEN {{'f': 'total', 'c': 'missing_required'}} END, CASE WHEN day IS NULL THEN {{'f': 'day', 'c': 'type_mismatch'}} END, CASE WHEN day IS NULL THEN {{'f': 'day', 'c': 'missing_required'}} END,
  CASE WHEN status IS NULL THEN {{'f': 'status', 'c': 'enum_mismatch'}} END, CASE WHEN k % 4 = 2 THEN {{'f': 'urgent', 'c': 'type_mismatch'}} END, CASE WHEN NOT tags THEN {{'f': 'tags', 'c': 'missing_required'}} END, CASE WHEN k % 2 = 1 THEN {{'f': 'clerk', 'c': 'pattern_mismatch'}} END,
  CASE WHEN total <= 100000 THEN {{'f': NULL, 'c': 'rule_failed: total > 100000'}} END, CASE WHEN NOT urgent OR (urgent AND total <= 1) THEN {{'f': NULL, 'c': 'rule_failed: urgent and total > 1'}} END, {{'f': NULL, 'c': 'rule_error: tags > total'}}, CASE WHEN day < '1995-01-01' THEN {{'f': NULL, 'c': 'rule_failed: day >= ''1995-01-01'''}} END, {{'f': NULL, 'c': 'rule_error: nothing > 1'}}], lambda x: x IS NOT NULL)) AS i FROM r) x""")
_q("x7_values", lambda s, d: X.validate_fields(_raw(s, d), _SPECS, [])[0].select("doc_id", "field", F.when(F.col("field") == "total", F.col("value").try_cast("double").cast("long").cast("string")).otherwise(F.col("value")).alias("value"), F.array_join("items", "|").alias("items")),
   f"""WITH {_TYPED} SELECT k AS doc_id, i.f AS field, i.v AS value, i.i AS items FROM (SELECT k, unnest([{{'f': 'total', 'v': CAST(CAST(total AS BIGINT) AS VARCHAR), 'i': NULL}}, {{'f': 'day', 'v': day, 'i': NULL}}, {{'f': 'status', 'v': status, 'i': NULL}}, {{'f': 'urgent', 'v': CAST(urgent AS VARCHAR), 'i': NULL}}, {{'f': 'tags', 'v': NULL, 'i': CASE WHEN tags THEN 'a|b|c' END}}, {{'f': 'clerk', 'v': CASE WHEN k % 2 = 0 THEN 'C' ELSE 'X' END || k, 'i': NULL}}]) AS i FROM r) x""")

# Fields of orders with people's corrections
_fields = lambda s, d: view(s, d, "fields").groupBy("doc_id", "field").agg(F.max("value").cast("long").cast("string").alias("value"), F.max("flag").alias("flag"))
_stored = lambda s, d: _fields(s, d).select("doc_id", "field", "value", F.lit(0.75).alias("confidence"), F.concat("field", F.lit("@"), "flag").alias("evidence"), (F.col("doc_id") % 5 == 0).alias("edited"))
_patches = lambda s, d: _fields(s, d).filter("flag <> 'N' and doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "new").otherwise(F.col("field")).alias("field"), F.lit("patched").alias("value"), (F.col("flag") == "A").alias("cleared")).dropDuplicates(["doc_id", "field"])
_FL = "f AS (SELECT doc_id, field, CAST(CAST(max(value) AS BIGINT) AS VARCHAR) AS value, max(flag) AS flag FROM fields GROUP BY 1, 2), p AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE field END AS field, flag = 'A' AS cleared FROM f WHERE flag <> 'N' AND doc_id % 3 = 0 AND (doc_id % 4 > 0 OR true))"
_q("x12_patched_fields", lambda s, d: X.patch_fields(_stored(s, d), _patches(s, d).filter("field <> 'new'").unionByName(_patches(s, d).filter("field = 'new'").withColumn("cleared", F.lit(False)))),
   f"""WITH {_FL}, q AS (SELECT DISTINCT doc_id, field, CASE WHEN field = 'new' THEN false ELSE cleared END AS cleared FROM p)
 SELECT coalesce(f.doc_id, q.doc_id) AS doc_id, coalesce(f.field, q.field) AS field, CASE WHEN q.doc_id IS NULL THEN value WHEN NOT cleared THEN 'patched' END AS value, CASE WHEN q.doc_id IS NULL THEN CAST(0.75 AS DOUBLE) WHEN NOT cleared THEN 1 END AS confidence,
 CASE WHEN q.doc_id IS NULL OR NOT cleared THEN f.field || '@' || flag END AS evidence, q.doc_id IS NOT NULL OR coalesce(f.doc_id % 5 = 0, false) AS edited FROM f FULL JOIN q ON q.doc_id = f.doc_id AND q.field = f.field""", "fields")
_issues = lambda s, d: _fields(s, d).filter("value > 40").select("doc_id", F.when(F.col("flag") != "R", F.col("field")).alias("field"), F.lit("type_mismatch").alias("code"))
_q("x12_open_issues", lambda s, d: X.open_issues(_issues(s, d), _patches(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("issues"), F.count("field").alias("of_fields")),
   f"WITH {_FL}, i AS (SELECT doc_id, CASE WHEN flag <> 'R' THEN field END AS field FROM f WHERE CAST(value AS INT) > 40) SELECT doc_id, count(*) AS issues, count(field) AS of_fields FROM i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = i.doc_id AND p.field = i.field) GROUP BY 1", "fields")
_NAMES = ["f3", "f1", "f2", "f_none"]
_q("x13_facts_chunks", lambda s, d: X.facts_chunks(_fields(s, d).select("doc_id", "field", F.when(F.col("flag") != "A", F.col("value")).alias("value"), F.when(F.col("flag") == "A", F.array(F.lit("a"), F.col("value"))).alias("items")), _NAMES, view(s, d, "chunks").select(F.col("document_id").alias("doc_id"), "chunk_index", "access_label", F.when(F.col("chunk_index") % 4 == 3, X.FACTS_SECTION).when(F.col("chunk_index") % 4 == 2, "s").alias("section_path")), "lines"),
   """WITH f AS (SELECT doc_id, field, CAST(CAST(max(value) AS BIGINT) AS VARCHAR) AS value, max(flag) AS flag FROM fields WHERE field IN ('f1', 'f2', 'f3') GROUP BY 1, 2),
 b AS (SELECT doc_id, 'Extracted fields (lines)' || chr(10) || chr(10) || string_agg(field || ': ' || CASE WHEN flag = 'A' THEN 'a, ' || value ELSE value END, chr(10) ORDER BY list_position(['f3', 'f1', 'f2'], field)) AS content FROM f GROUP BY 1),
 c AS (SELECT document_id AS doc_id, max(chunk_index) AS last, count(DISTINCT access_label) FILTER (access_label <> 'all') AS n, max(access_label) FILTER (access_label <> 'all') AS l FROM chunks WHERE chunk_index % 4 <> 3 GROUP BY 1)
 SELECT b.doc_id, coalesce(last, -1) + 1 AS chunk_index, content, 'Extracted fields' AS section_path, CASE WHEN coalesce(n, 0) = 0 THEN 'all' WHEN n = 1 THEN l ELSE 'leadership' END AS access_label, CAST(round_even(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) * 1.3, 0) AS INT) AS token_count FROM b LEFT JOIN c ON c.doc_id = b.doc_id""", "fields", "chunks")
_q("x14_export_rows", lambda s, d: X.export_rows(_t(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order "), "o_orderkey").alias("filename"), F.when(F.col("o_orderkey") % 9 == 0, "failed").otherwise("ready").alias("status")), _fields(s, d).select("doc_id", "field", F.when(F.col("flag") == "N", F.lower((F.col("value") > 25).cast("string"))).when(F.col("flag") == "R", F.col("value")).alias("value"), F.when(F.col("flag") == "A", F.array(F.lit("a"), F.col("value"))).alias("items")), _issues(s, d), ["f2", "f1", "f9"]),
   """WITH f AS (SELECT doc_id, field, CAST(CAST(max(value) AS BIGINT) AS VARCHAR) AS value, max(flag) AS flag FROM fields GROUP BY 1, 2), c AS (SELECT doc_id, field, CASE flag WHEN 'N' THEN CASE WHEN CAST(value AS INT) > 25 THEN 'true' ELSE 'false' END WHEN 'R' THEN value ELSE 'a; ' || value END AS cell, CAST(value AS INT) > 40 AS issue FROM f)
 SELECT o_orderkey AS doc_id, 'order ' || o_orderkey AS filename, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'ready' END AS status, coalesce(max(cell) FILTER (field = 'f2'), '') AS f2, coalesce(max(cell) FILTER (field = 'f1'), '') AS f1, '' AS f9, CAST(coalesce(count_if(issue), 0) AS BIGINT) AS issues FROM orders LEFT JOIN c ON doc_id = o_orderkey GROUP BY ALL""", "fields")
_q("x16_abandoned_claims", lambda s, d: X.abandoned_claims(view(s, d, "docs").select(F.col("doc_id").alias("id"), "status", F.col("created_s").alias("updated_s")), 30000),
   "SELECT doc_id AS id, CASE status WHEN 'pending' THEN 'requeue' ELSE 'failed' END AS action, created_s AS updated_s FROM docs WHERE (status = 'pending' AND created_s < 30000 - 60) OR (status = 'processing' AND created_s < 30000 - 660) ORDER BY created_s, doc_id LIMIT 100", "docs")


# The stub as a model that takes 64 texts a call at most, with its values
def _stub_call(texts):
    if not 0 < len(texts) <= 64:
        raise ValueError("a call takes 1 to 64 texts")
    out = []
    for t in texts:
        seed = hashlib.sha256(t.encode()).digest()
        v = np.frombuffer(b"".join(hashlib.sha256(seed + i.to_bytes(4, "big")).digest() for i in range(8)), ">u4") / (2**32 - 1) * 2 - 1
        out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
    return out


_STUB = """WITH h AS (SELECT doc_id, sha256(text) AS s FROM documents), b AS (SELECT doc_id, i, sha256(unhex(s || printf('%08x', i))) AS x FROM h, range(8) r(i)), u AS (SELECT doc_id, i * 8 + j AS k, CAST('0x' || substr(x, CAST(j * 8 + 1 AS BIGINT), 8) AS BIGINT) / 4294967295 * 2 - 1 AS v FROM b, range(8) r(j))
 SELECT doc_id AS id, {0} FROM u GROUP BY 1"""
_first = lambda df: df.select("id", F.size("vector").alias("dim"), *[F.round(F.get("vector", F.lit(i)).cast("double"), 5).alias(f"v{i}") for i in (0, 9, 63)])
_V = "count(*)::INT AS dim, " + ", ".join(f"round(CAST(CAST(max(v) FILTER (k = {i}) / sqrt(sum(v * v)) AS FLOAT) AS DOUBLE), 5) AS v{i}" for i in (0, 9, 63))
_texts = lambda s, d: _t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
_q("c12_stub_values", lambda s, d: _first(D.embed(_texts(s, d))), _STUB.format(_V))
_q("c13_batched_embedding", lambda s, d: _first(D.embed(_texts(s, d), D.in_batches(_stub_call))), _STUB.format(_V))

# R8-R17 in one: contexts by overlap
_CTX = f"""WITH base AS ({_pipeline_sql(0.0, 40, 40).replace("rank <= 40", "rank <= 100").replace("fused_rank <= 100", "fused_rank <= 40")}),
q AS (SELECT query_id, list_distinct(regexp_extract_all(lower(question), '[a-zа-яёäöüß0-9]+')) AS w FROM asked),
m AS (SELECT b.query_id, b.chunk_id, round(coalesce(len(list_intersect(w, list_distinct(regexp_extract_all(lower(left(content, 4000)), '[a-zа-яёäöüß0-9]+')))) / nullif(len(w), 0), 0), 9) AS score, fused_rank, p.* EXCLUDE (chunk_id) FROM base b JOIN q USING (query_id) JOIN passages p ON p.chunk_id = b.chunk_id),
g AS (SELECT a.query_id, max(score) AS gate_score, coalesce(max(score) < 0.3, true) AS refused FROM asked a LEFT JOIN m USING (query_id) GROUP BY 1)"""
_ctx = lambda s, d, i: R.answer_contexts(view(s, d, "asked"), view(s, d, "passages"), view(s, d, "role_labels"), 0.3, top=8, budget=900, chunk_max=200)[i]
_q("r10_reranked_gate", lambda s, d: _ctx(s, d, 0), f"{_CTX} SELECT query_id, gate_score, refused FROM g", "asked", "passages", "role_labels")
_q("r10_reranked_context", lambda s, d: _ctx(s, d, 1).select("query_id", "n", "chunk_id", "header", "total", F.md5("text").alias("text_md5")),
   f"""{_CTX}, h AS (SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS n FROM m JOIN g USING (query_id) WHERE NOT refused),
 t AS (SELECT *, {_HEAD} AS header, CASE WHEN {_TOK.format('content')} > 200 THEN array_to_string(list_slice({_W.format('content')}, 1, 153), ' ') ELSE content END AS text FROM h WHERE n <= 8),
 b AS (SELECT *, sum({_TOK.format('header')} + {_TOK.format('text')}) OVER (PARTITION BY query_id ORDER BY n) AS total FROM t)
 SELECT query_id, CAST(n AS INT) AS n, chunk_id, header, CAST(total AS BIGINT) AS total, md5(text) AS text_md5 FROM b WHERE total <= 900 OR n = 1""", "asked", "passages", "role_labels")

# V2, V16
_titled = lambda s, d: _t(s, d, "documents").select("doc_id", F.concat(F.lit("# T\n\n## 1. "), "source", F.lit("\n\nx\n\n## "), F.when(F.col("doc_id") % 4 == 3, "3").otherwise("2"), F.lit(". Part "), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.lit("two")), F.lit(" \n\n## no number\n\n"), F.when(F.col("doc_id") % 5 == 0, F.lit("## 3.More\n\ny")).otherwise(F.lit("y"))).alias("text"))
_q("v2_heading_titles", lambda s, d: V.heading_check(D.markdown_blocks(_titled(s, d)), _t(s, d, "documents").select("doc_id", "lang", F.array(F.col("source"), F.lit("Part two")).alias("titles"))).withColumn("wrong_titles", F.array_join("wrong_titles", "; ")),
   """SELECT doc_id, doc_id % 4 <> 3 AND doc_id % 5 <> 0 AS numbers_ok, CASE WHEN lang = 'en' AND doc_id % 4 <> 3 AND doc_id % 3 = 0 THEN '2 Part en' ELSE '' END AS wrong_titles FROM documents""")
_q("v16_localised", lambda s, d: _t(s, d, "orders").select("o_orderkey", *[V.localised(F.lit(k), F.lit(u), v.cast("string"), x).alias(f"{n}_{x}") for n, k, u, v in (("money", "money", "", F.col("o_totalprice")), ("whole", "money", "per month", F.floor("o_totalprice")), ("share", "percent", "", F.col("o_orderkey") % 400 / 8), ("days", "count", "days", F.col("o_orderkey") % 3), ("ms", "count", "ms", F.col("o_orderkey") % 3), ("date", "date", "", F.date_format("o_orderdate", "M-d")), ("text", "text", "", F.col("o_orderkey"))) for x in ("en", "de")]),
   """WITH x AS (SELECT o_orderkey AS k, printf('%.2f', o_totalprice) AS m, CAST(floor(o_totalprice) AS BIGINT) AS w, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS wf, o_totalprice = floor(o_totalprice) AS flat, rtrim(rtrim(printf('%.3f', k % 400 / 8.0), '0'), '.') AS p, o_orderkey % 3 AS n, month(o_orderdate) AS mo, day(o_orderdate) AS da FROM (SELECT *, o_orderkey AS k FROM orders) o),
 y AS (SELECT *, CASE WHEN flat THEN wf ELSE wf || right(m, 3) END AS en, CASE WHEN flat THEN translate(wf, ',', '.') ELSE translate(wf || right(m, 3), ',.', '.,') END AS de FROM x)
 SELECT k AS o_orderkey, '€' || en AS money_en, de || ' €' AS money_de, '€' || wf || ' per month' AS whole_en, translate(wf, ',', '.') || ' € pro Monat' AS whole_de, p || '%' AS share_en, replace(p, '.', ',') || ' %' AS share_de, n || CASE WHEN n = 1 THEN ' day' ELSE ' days' END AS days_en, n || CASE WHEN n = 1 THEN ' Tag' ELSE ' Tage' END AS days_de, n || ' ms' AS ms_en, n || ' ms' AS ms_de,
 ['January','February','March','April','May','June','July','August','September','October','November','December'][mo] || ' ' || da AS date_en, da || '. ' || ['Januar','Februar','März','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember'][mo] AS date_de, CAST(k AS VARCHAR) AS text_en, CAST(k AS VARCHAR) AS text_de FROM y""")


# A registry of facts made of documents, each stated in two of them and mentioned in a third
def golden_tables(s, d):
    doc = _t(s, d, "documents")
    k = F.col("doc_id")
    name = lambda x: F.concat(F.lit("D"), x.cast("string"))
    fact = lambda x: F.concat(F.lit("F"), x.cast("string"))
    facts = doc.select(
        fact(k).alias("fact_id"), F.concat(F.lit("k"), F.floor(k / 2).cast("string")).alias("key"), F.when(k % 17 == 5, "hr").otherwise("all").alias("label"), (k % 4).cast("int").alias("section"), F.concat(F.lit("€"), F.col("n_chars").cast("string")).alias("text_en"), F.concat(F.col("n_chars").cast("string"), F.lit(" €")).alias("text_de"),
        F.lit("It is {value} a year.").alias("statement"), F.element_at(F.array(F.lit("version:a"), F.lit("year:b"), F.lit("country:c"), F.lit("meeting:m"), F.lit(None)), (k % 5 + 1).cast("int")).alias("family"), (k % 4 != 1).alias("current"), (k % 10 == 4).alias("in_table"), (k % 10 == 9).alias("buried"),
        F.when(k % 4 == 1, F.array(F.lit("FAQ-1"))).otherwise(F.array().cast("array<string>")).alias("stale_in"),
    )
    docs = doc.select(
        name(k).alias("doc_id"), k.alias("ord"), F.col("source").alias("title"), F.when(k % 5 == 0, "de").otherwise("en").alias("lang"), F.when(k % 5 == 0, "DE").when(k % 11 == 1, "FAQ").otherwise("policy").alias("family"), F.when(k % 7 == 0, "finance").otherwise("all").alias("default_label"), (k % 6 == 1).alias("superseded"),
        F.when(k % 3 == 0, F.create_map(F.lit(2), F.lit("managers"), F.lit(3), F.lit("leadership"))).otherwise(F.create_map().cast("map<int,string>")).alias("restricted"),
    )
    held = doc.select(name(k).alias("doc_id"), F.explode(F.array(k, k + 1, k - 4)).alias("f"), k.alias("at")).select("doc_id", fact(F.col("f")).alias("fact_id"), (F.col("f") - F.col("at")).alias("ord")).join(facts.select("fact_id"), "fact_id").select("doc_id", "fact_id", "ord")
    mentions = doc.select(name(k).alias("doc_id"), fact(k + 3).alias("fact_id")).join(facts.select("fact_id"), "fact_id")
    pairs = held.alias("a").join(held.alias("b"), F.expr("a.doc_id = b.doc_id and a.fact_id <> b.fact_id")).select(F.concat_ws("+", "a.fact_id", "b.fact_id").alias("item"))
    topics = s.createDataFrame([("dental insurance",), ("parking",)], "topic string")
    items = facts.select(F.col("fact_id").alias("item")).unionByName(mentions.unionByName(held.drop("ord")).select(F.concat_ws("|", "doc_id", "fact_id").alias("item"))).unionByName(pairs).unionByName(topics.select(F.col("topic").alias("item"))).distinct()
    key = F.pmod(F.xxhash64("item"), F.lit(9))
    ask = F.array(F.concat(F.lit("What about "), F.translate("item", "0123456789", "abcdefghij"), F.lit("?")), F.when(key == 0, "What is it, €5?").otherwise(F.concat(F.lit("How much is "), F.translate("item", "0123456789", "ABCDEFGHIJ"), F.lit("?"))), F.lit("Same for all?"), F.when(key == 1, "same FOR all?").otherwise("Last one?"))
    questions = items.select("item", F.posexplode(ask).alias("n", "question"))
    return facts, docs, held, mentions, questions, topics


_q("v14_golden_questions", lambda s, d: (lambda g: g.select("category", "role", "question", "expected_answer", "expected_refusal", *[F.array_join(F.transform(c, lambda x: F.concat_ws("#", x["doc"], F.coalesce(x["section"].cast("string"), F.lit("-")))), ",").alias(c) for c in ("expected_sources", "hidden_sources")], F.array_join("hidden_labels", ",").alias("hidden_labels"), F.array_join("hidden_values", ",").alias("hidden_values")))(N.golden_questions(*golden_tables(s, d))))
_q("q1_ready_excerpts", lambda s, d: X.sample_excerpts(view(s, d, "docs").selectExpr("collection", "filename", "0 as chunk_index", "access_label", "size_bytes div 4 as token_count", "status")),
   """WITH n AS (SELECT *, size_bytes // 4 AS t, row_number() OVER (PARTITION BY collection ORDER BY filename) AS n FROM docs WHERE access_label = 'all' AND status = 'ready'), r AS (SELECT *, sum(t) OVER (PARTITION BY collection ORDER BY filename) AS total FROM n WHERE n <= 12)
 SELECT collection, filename, CAST(n AS INT) AS n, CAST(total AS BIGINT) AS total FROM r WHERE total <= 3200 OR n = 1""", "docs")
_q("x9_greedy_context", lambda s, d: X.select_context(view(s, d, "chunks").dropDuplicates(["document_id", "chunk_index"]).withColumn("score", (F.col("chunk_id") * 37 % 101).cast("double")), 800, 2300),
   """WITH RECURSIVE c AS (SELECT document_id AS d, chunk_index AS i, token_count AS t, chunk_id * 37 % 101 AS s, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index <> 0, chunk_id * 37 % 101 DESC, chunk_index) AS m, sum(token_count) OVER (PARTITION BY document_id) AS whole FROM chunks),
 f AS (SELECT DISTINCT d, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS used, CAST(NULL AS INT) AS kept FROM c
  UNION ALL SELECT d, m, CASE WHEN fits THEN used + t ELSE used END, CASE WHEN fits THEN i END FROM (SELECT f.d, c.m, f.used, c.t, c.i, used + t <= 800 OR i = 0 AS fits FROM f JOIN c ON c.d = f.d AND c.m = f.m + 1) x)
 SELECT d AS document_id, i AS chunk_index FROM c WHERE whole <= 2300 UNION ALL SELECT d, kept FROM f WHERE kept IS NOT NULL AND d NOT IN (SELECT d FROM c WHERE whole <= 2300)""", "chunks")


# V3: documents with their markers, some of them wrong, some in the other place
def _marked(s, d):
    k = F.col("doc_id")
    lang = F.when(k % 3 == 0, "de").otherwise("en")
    label = F.element_at(F.array(*map(F.lit, ["all", "hr", "finance", "managers"])), (k % 4 + 1).cast("int"))
    marker = lambda of: F.coalesce(*[F.when((lang == g) & (of == n), v) for g, x in V.MARKERS.items() for n, v in x.items()], F.lit("Open to all."))
    head = F.when(k % 5 == 0, F.lit("Access: nobody")).otherwise(marker(label))
    body = F.when(k % 11 == 0, F.lit("")).when(k % 7 == 0, F.concat(F.lit("x"), F.col("lang"), F.lit("\n\n"))).otherwise(F.concat(marker(F.lit("leadership")), F.lit("\n\n")))
    text = F.concat(F.lit("# T\n\n"), head, F.lit("\n\n## 1. One\n\n"), body, F.lit("## 2. Two\n\n"), F.regexp_replace("text", r"(?m)^#", ""))
    docs = _t(s, d, "documents").select("doc_id", lang.alias("lang"), label.alias("default_label"), F.when(k % 2 == 0, F.create_map(F.lit(1), F.lit("leadership"))).otherwise(F.create_map().cast("map<int,string>")).alias("restricted"))
    return D.markdown_blocks(_t(s, d, "documents").select("doc_id", text.alias("text"))), docs


_q("v3_marker_faults", lambda s, d: V.marker_faults(*_marked(s, d)),
   """WITH x AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN ['', 'Zugriff: nur People & Culture', 'Zugriff: nur Finanzen', 'Zugriff: nur Führungskräfte'] ELSE ['', 'Access: People & Culture only', 'Access: Finance only', 'Access: Managers only'] END[doc_id % 4 + 1] AS top, CASE WHEN doc_id % 3 = 0 THEN 'Zugriff: nur Geschäftsführung' ELSE 'Access: Leadership only' END AS sub FROM documents)
 SELECT doc_id, 0 AS section, top AS wanted, 'Access: nobody' AS found FROM x WHERE doc_id % 4 > 0 AND doc_id % 5 = 0
 UNION ALL SELECT doc_id, 1, sub, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'x' || lang END FROM x WHERE doc_id % 2 = 0 AND (doc_id % 11 = 0 OR doc_id % 7 = 0)""")
