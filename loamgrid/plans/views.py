"""Logical tables over the given Parquet tables, in SQL that both engines of the checks can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_LABEL = "CASE {0} % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'managers' WHEN 2 THEN 'hr' WHEN 3 THEN 'finance' ELSE 'leadership' END"
_ROLE = "CASE {0} % 5 WHEN 0 THEN 'employee' WHEN 1 THEN 'manager' WHEN 2 THEN 'hr' WHEN 3 THEN 'finance' ELSE 'leadership' END"

VIEWS = {
    "query_log": """SELECT event_id AS id, user_id % 4 AS tenant, user_id, ts AS created_at, event_type = 'error' AS refused,
 CAST(floor(value) AS BIGINT) AS latency_ms, CASE user_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large@1024' ELSE 'unknown' END AS model,
 CAST(floor(value * 7) AS BIGINT) AS prompt_tokens, event_id % 97 AS completion_tokens FROM {events}""",
    "docs": f"""SELECT doc_id, source AS collection, concat('doc-', CAST(doc_id AS STRING), '.MD') AS filename, n_chars AS size_bytes,
 CASE doc_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'ready' END AS status,
 (doc_id * 37) % 100000 AS created_s, (doc_id * 37) % 100000 + 5 + doc_id % 50 AS processed_s, doc_id % 4 AS tenant,
 doc_id % 5 AS attempts, {_LABEL.format('doc_id')} AS access_label, text FROM {{documents}}""",
    "chunks": f"""SELECT vec_id AS chunk_id, vec_id % 50 AS document_id, {_LABEL.format('label')} AS access_label,
 CAST(floor(vec_id / 50) AS INT) AS chunk_index, vec_id % 400 + 30 AS token_count, embedding FROM {{embeddings}}""",
    "questions": f"SELECT vec_id AS query_id, {_ROLE.format('(vec_id / 20)').replace('(vec_id / 20)', 'CAST(floor(vec_id / 20) AS INT)')} AS role, embedding FROM {{embeddings}} WHERE vec_id % 20 = 0",
    "passages": f"""SELECT e.vec_id AS chunk_id, {_LABEL.format('e.label')} AS access_label, d.text AS content, e.embedding, concat('doc-', CAST(d.doc_id AS STRING), '.md') AS filename,
 CASE WHEN d.doc_id % 3 > 0 THEN d.source END AS section_path, CASE WHEN d.doc_id % 4 > 0 THEN d.doc_id % 9 END AS page_start, CASE WHEN d.doc_id % 4 > 1 THEN d.doc_id % 9 + d.doc_id % 2 END AS page_end
 FROM {{embeddings}} e JOIN {{documents}} d ON d.doc_id = e.vec_id""",
    # Every 20th passage asks: a query of its own words with a phrase, an alternative and an exclusion, or a whole benchmark text.
    "asked": f"""SELECT query_id, role, embedding, w, CASE WHEN k % 2 = 0 THEN concat('"', w3, ' ', w4, '" ', w6, ' OR ', w8, ' -', w1) ELSE b.text END AS question
 FROM (SELECT vec_id AS query_id, CAST(floor(vec_id / 20) AS INT) AS k, {_ROLE.format('CAST(floor(vec_id / 20) AS INT)')} AS role, embedding, w,
 {{at}}(w, 1) AS w1, {{at}}(w, 3) AS w3, {{at}}(w, 4) AS w4, {{at}}(w, 6) AS w6, {{at}}(w, 8) AS w8
 FROM (SELECT e.vec_id, e.embedding, regexp_extract_all(lower(d.text), '([a-z][a-z]+)', 1) AS w FROM {{embeddings}} e JOIN {{documents}} d ON d.doc_id = e.vec_id WHERE e.vec_id % 20 = 0) a WHERE {{size}}(w) > 8) x
 JOIN {{benchmark}} b ON b.item_id = x.k""",
    "role_labels": """SELECT * FROM (VALUES ('employee', 'all'), ('manager', 'all'), ('manager', 'managers'), ('hr', 'all'), ('hr', 'managers'), ('hr', 'hr'),
 ('finance', 'all'), ('finance', 'managers'), ('finance', 'finance'), ('leadership', 'all'), ('leadership', 'managers'), ('leadership', 'hr'),
 ('leadership', 'finance'), ('leadership', 'leadership')) AS t(role, label)""",
    "ranked": """SELECT user_id AS query_id, list_no, chunk_id, CAST(row_number() OVER (PARTITION BY user_id, list_no ORDER BY score DESC, chunk_id) AS INT) AS rank, score
 FROM (SELECT user_id, 1 AS list_no, event_id AS chunk_id, value AS score FROM {events}
 UNION ALL SELECT user_id, 2 AS list_no, event_id AS chunk_id, CAST((event_id * 7919) % 1009 AS DOUBLE) AS score FROM {events} WHERE event_type <> 'error') x""",
    "turns": """SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, conv_id, conv_id % 3 AS collection_id,
 conv_id % 11 AS user_id, turn AS created_at, role, text, turn % 7 = 6 AS context_reset, conv_id % 2 AS generation, CASE WHEN conv_id % 13 = 0 AND turn % 4 = 1 THEN 1 ELSE conv_id % 2 END AS seen_generation FROM {conversations}""",
    "ledger": """SELECT event_id AS reservation_id, CAST(ts AS DATE) AS day, concat('ip', CAST(user_id % 9 AS STRING)) AS ip_digest,
 CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS payer, CAST(value AS DECIMAL(18,8)) AS amount,
 CASE WHEN event_type = 'purchase' THEN CAST(CAST(value AS DECIMAL(18,8)) / 2 AS DECIMAL(18,8)) END AS actual, ts FROM {events}""",
    # Requests of accounts that move between addresses, a third of them without an account, and what they cost in the end: known, unknown, more than reserved, told twice.
    "spend": """SELECT event_id AS id, CAST(ts AS DATE) AS day, ts, concat('a', CAST((user_id * 7 + hour(ts)) % 40 AS STRING)) AS ip, CASE WHEN event_id % 3 > 0 THEN concat('u', CAST(user_id % 97 AS STRING)) END AS payer,
 CAST(floor(value * 100) AS BIGINT) AS cents FROM {events}""",
    "spent": """SELECT event_id AS id, ts + INTERVAL 1 HOUR AS ts, CASE WHEN event_id % 16 <> 1 THEN CAST(floor(value * 50) AS BIGINT) END AS cents FROM {events} WHERE event_id % 4 = 1
 UNION ALL SELECT event_id, ts + INTERVAL 30 MINUTE, CAST(floor(value * 125) AS BIGINT) FROM {events} WHERE event_id % 4 = 2
 UNION ALL SELECT event_id, ts + INTERVAL 2 HOUR, CAST(floor(value * CASE WHEN event_id % 8 = 2 THEN 125 ELSE 100 END) AS BIGINT) FROM {events} WHERE event_id % 4 = 2""",
    "golden": """SELECT item_id AS id, CASE item_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'access' WHEN 2 THEN 'no_answer' ELSE 'multi' END AS category,
 (item_id * 31) % 100 / 100.0 AS gate, (item_id * 17) % 5 = 0 AS sentinel, text FROM {benchmark}""",
    "judged": """SELECT l.doc_id, l.quality, l.toxic, d.source AS category, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS gate, d.n_chars % 3 = 0 AS refused FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "fields": """SELECT l_orderkey AS doc_id, concat('f', CAST(l_linenumber AS STRING)) AS field, CAST(l_quantity AS DOUBLE) AS value, l_returnflag AS flag FROM {lineitem}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name].replace("{size}", "size").replace("{at}", "element_at"), **used)


def with_views(sql: str, *names: str) -> str:
    """``sql`` for the other engine, with the named views in front."""
    heads = ", ".join(f"{n} AS ({VIEWS[n].format(size="len", at="list_extract", **{t: t for t in TABLES})})" for n in names)
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, " + sql.lstrip()[len("WITH RECURSIVE") :]
    if sql.lstrip().upper().startswith("WITH"):
        return f"WITH {heads}, " + sql.lstrip()[len("WITH") :]
    return f"WITH {heads} {sql}"
