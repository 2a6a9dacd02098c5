"""Queries of document, retrieval, answer, extraction, corpus and streaming operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import answers as G
from loamgrid.operators import corpus as V
from loamgrid.operators import documents as D
from loamgrid.operators import extraction as X
from loamgrid.operators import retrieval as R
from loamgrid.plans import queries_state
from loamgrid.plans.session import Scratch
from loamgrid.plans.views import view, with_views
from loamgrid.streaming import ops as T

Q: dict = {}
O: dict = {}


def _q(name, fn, sql=None, *views):
    Q[name] = fn
    if sql:
        O[name] = with_views(sql, *views) if views else sql


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _md(s, d):
    """Documents with their first line as a heading, every eighth line as a lower one, and access markers."""
    line = lambda x, i: F.when(i == 0, F.concat(F.lit("# "), x)).when(i % 8 == 0, F.concat(F.lit("## "), x, F.lit("\n\nAccess: "), F.element_at(F.array(*map(F.lit, ["all", "managers", "hr", "finance", "leadership"])), (F.pmod(F.col("doc_id") + i, F.lit(5)) + 1).cast("int")))).otherwise(x)
    return _t(s, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n\n").alias("text"))


_WORDS = "list_filter(regexp_split_to_array({0}, '[\\t-\\r ]+'), lambda w: w <> '')"
_TOK = "greatest(1, CAST(round_even(len({0}) * 1.3, 0) AS INT))".format(_WORDS)

# S: sources and blocks
_q("s1_markdown_blocks", lambda s, d: D.markdown_blocks(_md(s, d)).groupBy("doc_id").agg(F.count_if(F.col("level") == 1).alias("h1"), F.count_if(F.col("level") == 2).alias("h2"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs")),
   """SELECT doc_id, 1 AS h1, CAST(floor((n - 1) / 8) AS BIGINT) AS h2, n - 1 AS paragraphs FROM (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents) x""")
_q("s2_front_matter", lambda s, d: _t(s, d, "documents").select("doc_id", D.front_matter(F.concat(F.lit("---\nTitle: 'A b'\nlang: "), F.col("lang"), F.lit(" # note\n# skip\nAccess: hr\n---\n"), F.col("text"))).alias("m")).select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["lang"].alias("lang"), F.col("m")["access"].alias("access")),
   "SELECT doc_id, 'A b' AS title, lang, 'hr' AS access FROM documents")
_q("s3_plain_text", lambda s, d: _t(s, d, "documents").select("doc_id", F.length(D.plain_text(F.col("text").cast("binary"))).alias("n")), "SELECT doc_id, length(trim(text)) AS n FROM documents")
_q("s5_admission", lambda s, d: _t(s, d, "documents").select("doc_id", D.admission(F.col("n_chars"), F.size(F.split("text", "\n")), 5000, 20).alias("reason")),
   "SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars > 5000 THEN 'too_large' WHEN len(string_split(text, chr(10))) > 20 THEN 'too_many_pages' END AS reason FROM documents")
_q("s6_duplicates", lambda s, d: D.duplicates(view(s, d, "docs")),
   "SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY collection, text), doc_id) AS existing_document_id FROM docs", "docs")
_lines = lambda s, d: D.lines_of(_t(s, d, "documents")).select("doc_id", F.floor(F.col("pos") / 40).cast("int").alias("page"), "pos", (F.length("line") % 13 + 6).cast("double").alias("size"), (F.col("pos") % 9 == 0).alias("bold"), F.col("line").alias("text"))
_LN = "SELECT doc_id, CAST(floor(pos / 40) AS INT) AS page, pos, CAST(length(line) % 13 + 6 AS DOUBLE) AS size, pos % 9 = 0 AS bold, line AS text FROM (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a) b"
_q("s7_layout_headings", lambda s, d: D.layout_headings(_lines(s, d)),
   f"WITH l AS ({_LN}), m AS (SELECT doc_id, page, median(size) AS m FROM l GROUP BY 1, 2) SELECT l.doc_id, l.page, pos, size > m * 1.15 OR (bold AND length(text) < 80 AND NOT regexp_matches(text, '[.,;:]$')) AS is_heading FROM l JOIN m ON l.doc_id = m.doc_id AND l.page = m.page")
_q("s8_heading_levels", lambda s, d: _lines(s, d).groupBy("doc_id").agg(F.collect_set("size").alias("z")).select("doc_id", F.explode(D.heading_levels(F.col("z"))).alias("x")).select("doc_id", "x.size", "x.level"))
_words = lambda s, d: _lines(s, d).selectExpr("doc_id", "page", "pos div 10 as block", "pos div 5 as par", "pos as line", "0 as word", "pos * 3 as left", "pos * 12 as top", "length(text) as width", "cast(size as int) as height", "cast(length(text) % 101 - 1 as double) as conf", "text")
_q("s10_ocr_blocks", lambda s, d: D.ocr_blocks(_words(s, d)).drop("text"),
   f"""SELECT doc_id, page, pos // 10 AS block, pos // 5 AS par, min(pos * 3) AS x0, min(pos * 12) AS y0, max(pos * 3 + length(text)) AS x1, max(pos * 12 + CAST(size AS INT)) AS y1,
 round(avg(CAST(length(text) % 101 - 1 AS DOUBLE)) FILTER (WHERE length(text) % 101 - 1 >= 0), 6) AS conf, median(size) AS height FROM ({_LN}) l GROUP BY 1, 2, 3, 4""")
# Zero by zero is NaN in the SQL, where the operator has null.
_q("s11_page_confidence", lambda s, d: D.page_confidence(_words(s, d), 200).withColumn("conf", F.coalesce("conf", F.lit(float("nan")))),
   f"SELECT doc_id, page, round(sum(CAST(length(text) % 101 - 1 AS DOUBLE) * length(text)) / sum(length(text)), 6) AS conf, sum(length(text)) < 200 AS needs_ocr FROM ({_LN}) l GROUP BY 1, 2")
_q("s13_markdown_table", lambda s, d: _t(s, d, "part").select("p_partkey", D.markdown_table(F.array(F.array(F.lit("k"), F.lit("v|w")), F.array(F.col("p_name")), F.array(F.col("p_brand"), F.col("p_type")))).alias("t")),
   "SELECT p_partkey, concat('| k | v\\|w |', chr(10), '| --- | --- |', chr(10), '| ', p_name, ' |  |', chr(10), '| ', p_brand, ' | ', p_type, ' |') AS t FROM part")
_q("s14_rich_text", lambda s, d: _t(s, d, "part").select("p_partkey", D.rich_text(F.array(F.struct(F.col("p_name").alias("text"), F.lit(True).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("strike"), F.lit(False).alias("code"), F.lit(None).cast("string").alias("href")), F.struct(F.col("p_brand").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("strike"), F.lit(True).alias("code"), F.lit("u").alias("href")))).alias("t")),
   "SELECT p_partkey, concat('**', p_name, '**[`', p_brand, '`](u)') AS t FROM part")
_q("s15_list_numbers", lambda s, d: D.list_numbers(_t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f")).select(F.col("l_orderkey").alias("page_id"), F.lit(0).alias("parent_id"), F.col("l_linenumber").alias("block_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("f") == "N", "numbered").otherwise("paragraph").alias("type"))),
   """WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS block_id, CASE WHEN min(l_returnflag) = 'N' THEN 'numbered' ELSE 'p' END AS type FROM lineitem GROUP BY 1, 2),
 g AS (SELECT *, sum(CASE WHEN type = 'numbered' THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY block_id) AS g FROM b)
 SELECT page_id, block_id, CASE WHEN type = 'numbered' THEN CAST(row_number() OVER (PARTITION BY page_id, g, type ORDER BY block_id) AS INT) END AS number FROM g""")
_q("s17_scope_closure", lambda s, d: D.scope_closure(_t(s, d, "region").selectExpr("concat('r', r_regionkey) as id", "cast(null as string) as parent").union(_t(s, d, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)")).union(_t(s, d, "customer").selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)")), s.sql("select 'r1' as id")),
   "SELECT 'r1' AS id UNION ALL SELECT concat('n', n_nationkey) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT concat('c', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
_pages = lambda s, d: _t(s, d, "pages").select(F.col("url").alias("external_id"), "page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").alias("bytes"))
# A URL may name several pages.
_q("s18_snapshot_diff", lambda s, d: D.snapshot_diff(_pages(s, d).filter("page_id % 5 <> 0").withColumn("version", F.lit(2)), _pages(s, d).filter("page_id % 3 <> 0").select("external_id", "page_id", F.when(F.col("page_id") % 2 == 0, 2).otherwise(1).alias("version"), F.when(F.col("page_id") % 7 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256")), 20000, False, "page_id").drop("page_id"),
   """WITH p AS (SELECT url AS external_id, page_id, strlen(html) AS bytes, sha256(html) AS sha FROM pages), e AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN 'x' ELSE sha END AS old FROM p WHERE page_id % 3 <> 0),
 s AS (SELECT external_id, sha, CASE WHEN page_id % 5 = 0 THEN 'removed' WHEN page_id % 3 <> 0 AND (page_id % 2 = 0 OR page_id % 7 <> 0) THEN 'unchanged' WHEN bytes > 20000 THEN 'too_large' WHEN page_id % 3 <> 0 THEN 'updated'
 WHEN sha IN (SELECT old FROM e) THEN 'duplicate' ELSE 'added' END AS status FROM p WHERE page_id % 5 <> 0 OR page_id % 3 <> 0)
 SELECT external_id, CASE WHEN status = 'added' AND row_number() OVER (PARTITION BY status, sha ORDER BY external_id) > 1 THEN 'duplicate' ELSE status END AS status FROM s""")
_q("s20_seed_diff", lambda s, d: D.seed_diff(view(s, d, "docs").select("filename", F.sha2("text", 256).alias("sha256")), view(s, d, "docs").filter("attempts < 3").select("filename", F.sha2("text", 256).alias("sha256"))),
   "SELECT filename, sha256(text) AS sha256 FROM docs WHERE attempts >= 3", "docs")

# C: chunks and vectors
_q("c1_token_count", lambda s, d: _t(s, d, "documents").select("doc_id", D.token_count(F.col("text")).alias("tokens")), f"SELECT doc_id, {_TOK.format('text')} AS tokens FROM documents")
_q("c2_hard_split", lambda s, d: _t(s, d, "documents").select("doc_id", F.posexplode(D.hard_split(F.col("text"), 65)).alias("part", "slice")),
   f"SELECT doc_id, CAST(i AS INT) AS part, array_to_string(list_slice(w, i * 50 + 1, i * 50 + 50), ' ') AS slice FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 50.0) AS BIGINT))) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) a) b")
_q("c12_stub_embedding", lambda s, d: D.embed(_t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))).select("id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm")),
   "SELECT doc_id AS id, 64 AS dim, 1.0 AS norm FROM documents")
_q("c14_embed_missing", lambda s, d: (lambda c: D.embed_missing(c, D.embed(c.filter("id % 2 = 0")).join(c, "id").select(F.sha2(F.concat(F.lit("m"), F.lit("\x00"), "content"), 256).alias("key"), "vector").dropDuplicates(["key"]), "m"))(_t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))).select("id", "reused"),
   "SELECT doc_id AS id, text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS reused FROM documents")
_q("c15_document_rollup", lambda s, d: D.document_rollup(view(s, d, "chunks")),
   "SELECT document_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, min(chunk_index) AS first, max(chunk_index) AS last FROM chunks GROUP BY 1".replace(" first,", ' "first",').replace("AS last", 'AS "last"'), "chunks")

# R: retrieval
_COS = "round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 6)"
_TOP = f"""s AS (SELECT query_id, chunk_id, access_label, {_COS} AS score FROM questions q JOIN role_labels r ON q.role = r.role JOIN chunks c ON c.access_label = r.label),
 top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s)"""
_three = lambda s, d: (view(s, d, "questions"), view(s, d, "chunks"), view(s, d, "role_labels"))
_q("r1_vector_top_k", lambda s, d: R.vector_top_k(*_three(s, d)), f"WITH {_TOP} SELECT query_id, chunk_id, score, access_label, rank FROM top WHERE rank <= 10", "questions", "chunks", "role_labels")
_q("r2_lsh_top_k", lambda s, d: R.lsh_top_k(*_three(s, d)))
_q("r3_postings", lambda s, d: D.postings(_t(s, d, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")),
   "SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) AS term FROM documents) x GROUP BY 1")
_q("r6_rank_fusion", lambda s, d: R.reciprocal_rank_fusion(view(s, d, "ranked")).select("query_id", "chunk_id", "rrf", "fused_rank"),
   "WITH f AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 12) AS rrf FROM ranked GROUP BY 1, 2), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS INT) AS fused_rank FROM f) SELECT * FROM n WHERE fused_rank <= 40", "ranked")
_q("r7_no_rerank", lambda s, d: R.no_rerank(view(s, d, "ranked").filter("list_no = 1")).select("query_id", "chunk_id", "relative"),
   "SELECT query_id, chunk_id, round(score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY query_id) END, 9) AS relative FROM ranked WHERE list_no = 1", "ranked")
_q("r8_overlap_rerank", lambda s, d: _t(s, d, "conversations").select("conv_id", "turn", F.round(R.overlap_score(F.lit("the der inst and of stion 7"), F.col("text")), 9).alias("score")),
   "SELECT conv_id, turn, round(len(list_intersect(['the','der','inst','and','of','stion','7'], list_distinct(regexp_extract_all(lower(text), '[a-zа-яёäöüß0-9]+')))) / 7, 9) AS score FROM conversations")
_q("r9_model_rerank", lambda s, d: R.model_rerank(view(s, d, "ranked").filter("list_no = 1").withColumns({"question": F.lit("a"), "content": F.col("chunk_id").cast("string")}), lambda a, b: -b.cast("double")).select("query_id", "chunk_id", "model_rank"),
   "SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INT) AS model_rank FROM ranked WHERE list_no = 1", "ranked")
_q("r11_hidden_probe", lambda s, d: R.hidden_probe(*_three(s, d), R.vector_top_k(*_three(s, d)), 0.1),
   f"""WITH {_TOP}, b AS (SELECT query_id, max(score) AS best FROM top WHERE rank <= 10 GROUP BY 1),
 h AS (SELECT query_id, chunk_id, access_label, {_COS} AS score FROM questions q JOIN chunks c ON NOT EXISTS (SELECT 1 FROM role_labels r WHERE r.role = q.role AND r.label = c.access_label)),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM h)
 SELECT k.query_id, count(*) AS passages, string_agg(DISTINCT access_label, ',' ORDER BY access_label) AS labels, count(*) FILTER (WHERE score >= best) AS outranking
 FROM k LEFT JOIN b ON b.query_id = k.query_id WHERE n <= 10 AND score >= greatest(0.1, coalesce(best - 0.05, 0.1)) GROUP BY 1""", "questions", "chunks", "role_labels")
_q("r12_roles", lambda s, d: R.resolve_roles(_t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "leadership").when(F.col("c_custkey") % 3 == 1, "hr").alias("role")), view(s, d, "role_labels")),
   "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'leadership' WHEN 1 THEN 'hr' ELSE 'employee' END AS role, CASE c_custkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END AS labels, c_custkey % 3 = 0 AS full_access FROM customer")
_q("r14_valid_plan", lambda s, d: _t(s, d, "customer").select("c_custkey", F.size(F.coalesce(R.valid_plan(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"queries": ["'), "c_name", F.lit('", "b"]}'))).when(F.col("c_custkey") % 3 == 1, F.lit('{"queries": ["a", " A"]}')).otherwise(F.lit('{"queries": ["a"], "x": 1}'))), F.array().cast("array<string>"))).alias("n")),
   "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS n FROM customer")
_q("r15_round_robin", lambda s, d: R.round_robin(view(s, d, "ranked"), 30),
   "WITH o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, list_no) AS n FROM ranked), p AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no) AS INT) AS place FROM o WHERE n = 1) SELECT * FROM p WHERE place <= 30", "ranked")
_q("r19_model_guard", lambda s, d: R.model_guard(view(s, d, "query_log").select(F.col("id").alias("query_id"), F.col("tenant").alias("collection"), "model"), view(s, d, "query_log").groupBy(F.col("tenant").alias("collection")).agg(F.min("model").alias("model"))),
   "SELECT id AS query_id, model, m AS collection_model FROM (SELECT *, min(model) OVER (PARTITION BY tenant) AS m FROM query_log) x WHERE model <> m", "query_log")

# G: answers. The quote is cut from the document itself.
_ans = lambda s, d: _t(s, d, "documents").select(F.col("doc_id").alias("key"), F.concat(F.when(F.col("doc_id") % 9 == 0, F.lit(" NO_ANSWER ")).otherwise(F.lit("It is [2] , so [7][1].")), F.lit("\n**QUOTES**\n- [1] \"ab\"\n[2] “long quote”")).alias("answer"), F.col("text").alias("content"))
_q("g1_refusal", lambda s, d: _ans(s, d).select("key", G.is_refusal(F.col("answer")).alias("refused")), "SELECT doc_id AS key, doc_id % 9 = 0 AS refused FROM documents")
_q("g4_citations", lambda s, d: _ans(s, d).select("key", F.array_join(G.citations(F.col("answer"), F.array(F.lit(1), F.lit(2), F.lit(3))), ",").alias("cited")), "SELECT doc_id AS key, CASE WHEN doc_id % 9 = 0 THEN '1,2' ELSE '2,1' END AS cited FROM documents")
_quote = lambda s, d: _t(s, d, "documents").select(F.col("doc_id").alias("key"), F.substring("text", 5, 40).alias("quote"), F.col("text").alias("content"))
_q("g6_exact_span", lambda s, d: _quote(s, d).select("key", G.exact_span(F.col("quote"), F.col("content")).alias("x")).select("key", "x.start", "x.end"),
   'SELECT doc_id AS key, CASE WHEN length(text) > 4 THEN strpos(text, substring(text, 5, 40)) - 1 END AS start, CASE WHEN length(text) > 4 THEN strpos(text, substring(text, 5, 40)) - 1 + length(substring(text, 5, 40)) END AS "end" FROM documents')
_q("g7_locate", lambda s, d: G.locate(_quote(s, d).withColumn("quote", F.when(F.col("key") % 4 == 0, F.upper("quote")).when(F.col("key") % 4 == 1, F.concat(F.lit("zz"), "quote")).otherwise(F.col("quote")))))
_spans = lambda s, d: view(s, d, "query_log").select(F.col("user_id").alias("key"), (F.col("id") % 500).alias("start"), (F.col("id") % 500 + F.col("latency_ms") % 40).alias("end"), F.element_at(F.array(*map(F.lit, G.METHODS)), (F.col("id") % 3 + 1).cast("int")).alias("method"))
_q("g10_merge_spans", lambda s, d: G.merge_spans(_spans(s, d)),
   """WITH s AS (SELECT user_id AS key, id % 500 AS a, id % 500 + latency_ms % 40 AS b, id % 3 AS m FROM query_log), p AS (SELECT *, max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM s),
 i AS (SELECT *, sum(CASE WHEN a <= pm + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM p)
 SELECT key, min(a) AS start, max(b) AS "end", CASE max(m) WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' ELSE 'fuzzy' END AS method FROM i GROUP BY key, g""", "query_log")
_q("g13_usage_totals", lambda s, d: G.usage_totals(view(s, d, "query_log").withColumn("prompt_tokens", F.when(F.col("id") % 50 != 0, F.col("prompt_tokens"))), "user_id"),
   "SELECT user_id, CASE WHEN bool_or(id % 50 = 0) THEN NULL ELSE CAST(sum(prompt_tokens) AS BIGINT) END AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM query_log GROUP BY 1", "query_log")
_q("g14_contract_checks", lambda s, d: G.contract_checks(_ans(s, d).withColumns({"must": F.array(F.lit("It is")), "context": F.lit("12 and 13")})),
   "SELECT doc_id AS key, doc_id % 9 <> 0 AS answered, doc_id % 9 <> 0 AS mentions, true AS no_invented FROM documents")

# X and Q: extraction and suggestions
_wide = lambda s, d: _t(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("doc_id"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"))
_q("x2_rules", lambda s, d: _wide(s, d).select("doc_id", X.compile_rule("q > 20 and p / q < 1500 or d in [0.05, 0.06]", {c: F.col(c) for c in "qpd"}).alias("ok")),
   "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS doc_id, CASE WHEN l_linenumber >= 7 THEN NULL ELSE (l_quantity > 20 AND l_extendedprice / l_quantity < 1500) OR l_discount IN (0.05, 0.06) END AS ok FROM lineitem")
_q("x7_validate", lambda s, d: X.validate(_wide(s, d), ["q"], {"cheap": "p < 90000"}),
   "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS doc_id, unnest(list_filter([CASE WHEN l_linenumber >= 7 THEN 'missing_required:q' END, CASE WHEN l_extendedprice >= 90000 THEN 'rule_failed:cheap' END], lambda x: x IS NOT NULL)) AS issue FROM lineitem")
_q("x8_label_values", lambda s, d: X.label_values(_t(s, d, "documents").select("doc_id", F.concat(F.col("text"), F.lit("\nTotal: "), F.col("n_chars").cast("string"), F.lit("\nTOTAL: 0\nDue – x")).alias("text")), ["total", "due", "none"]),
   "SELECT doc_id, 'total' AS field, CAST(n_chars AS STRING) AS value FROM documents UNION ALL SELECT doc_id, 'due', 'x' FROM documents")
_q("x12_merge_edits", lambda s, d: X.merge_edits(view(s, d, "fields").groupBy("doc_id", "field").agg(F.max("value").alias("value")), view(s, d, "fields").filter("flag = 'A'").groupBy("doc_id", "field").agg(F.min("value").alias("value"), F.lit(True).alias("edited"))),
   "SELECT doc_id, field, coalesce(min(value) FILTER (WHERE flag = 'A'), max(value)) AS value, CASE WHEN bool_or(flag = 'A') THEN 1.0 ELSE 0.75 END AS confidence FROM fields GROUP BY 1, 2", "fields")
_q("x13_facts_passage", lambda s, d: X.facts_passage(view(s, d, "fields").groupBy("doc_id", "field").agg(F.max("value").cast("long").alias("value")), view(s, d, "docs")),
   """WITH f AS (SELECT doc_id, field, CAST(max(value) AS BIGINT) AS value FROM fields GROUP BY 1, 2) SELECT f.doc_id, string_agg(concat(field, ': ', value), chr(10) ORDER BY field, value) AS content,
 coalesce(max(access_label), 'leadership') AS access_label FROM f LEFT JOIN docs ON docs.doc_id = f.doc_id GROUP BY 1""", "fields", "docs")
_q("x14_wide_export", lambda s, d: X.wide_export(view(s, d, "fields"), [f"f{i}" for i in range(1, 8)]),
   "SELECT doc_id, " + ", ".join(f"max(value) FILTER (WHERE field = 'f{i}') AS f{i}" for i in range(1, 8)) + " FROM fields GROUP BY 1", "fields")
_q("x15_schema_usage", lambda s, d: X.schema_usage(view(s, d, "fields")), "SELECT field, count(DISTINCT doc_id) AS documents FROM fields GROUP BY 1", "fields")
_dc = lambda s, d: view(s, d, "docs").selectExpr("collection", "filename", "0 as chunk_index", "access_label", "size_bytes div 4 as token_count")
_q("q1_sample_excerpts", lambda s, d: X.sample_excerpts(_dc(s, d)),
   """WITH n AS (SELECT *, size_bytes // 4 AS t, row_number() OVER (PARTITION BY collection ORDER BY filename) AS n FROM docs WHERE access_label = 'all'), r AS (SELECT *, sum(t) OVER (PARTITION BY collection ORDER BY filename) AS total FROM n WHERE n <= 12)
 SELECT collection, filename, CAST(n AS INT) AS n, CAST(total AS BIGINT) AS total FROM r WHERE total <= 3200 OR n = 1""", "docs")
_q("q2_parse_candidates", lambda s, d: _t(s, d, "benchmark").select("item_id", F.array_join(X.parse_candidates(F.concat(F.lit('Here: ["What  is it?", "what is IT?", "'), F.regexp_extract("text", r"([A-Za-z]+)", 1), F.lit('"] ok'))), "|").alias("q")),
   "SELECT item_id, concat('What is it?|', regexp_extract(text, '([A-Za-z]+)', 1)) AS q FROM benchmark")
_q("q3_leaky", lambda s, d: _t(s, d, "conversations").select("conv_id", "turn", X.is_leaky(F.col("text")).alias("leaky")), "SELECT conv_id, turn, regexp_matches(text, '[0-9€$£]') AS leaky FROM conversations")
_sc = lambda s, d: view(s, d, "chunks").select((F.col("chunk_id") % 40).alias("query_id"), "access_label", (F.col("token_count") % 100 / 100).alias("score"))
_q("q4_role_scores", lambda s, d: X.role_scores(_sc(s, d), view(s, d, "role_labels")),
   """WITH s AS (SELECT chunk_id % 40 AS query_id, access_label, token_count % 100 / 100 AS score FROM chunks) SELECT q.query_id, r.role, coalesce(max(s.score), 0.0) AS score
 FROM (SELECT DISTINCT query_id FROM s) q CROSS JOIN role_labels r LEFT JOIN s ON s.query_id = q.query_id AND s.access_label = r.label GROUP BY 1, 2""", "chunks", "role_labels")
_q("q6_final_pick", lambda s, d: X.final_pick(view(s, d, "docs").selectExpr("collection", "doc_id as query_id", "size_bytes % 97 as score", "access_label <> 'all' as locked"), 5),
   """WITH x AS (SELECT collection, doc_id AS query_id, size_bytes % 97 AS score, access_label <> 'all' AS locked FROM docs), p AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, query_id) AS place, row_number() OVER (PARTITION BY collection, locked ORDER BY score DESC, query_id) AS kp FROM x),
 k AS (SELECT *, CASE WHEN kp = 1 AND place > 5 THEN 4.5 ELSE place END AS key FROM p), r AS (SELECT collection, query_id, CAST(row_number() OVER (PARTITION BY collection ORDER BY key) AS INT) AS pick FROM k) SELECT * FROM r WHERE pick <= 5""", "docs")
_q("q8_settle_trigger", lambda s, d: X.settle_trigger(view(s, d, "docs").withColumn("collection", F.col("doc_id") % 40)),
   "SELECT doc_id % 40 AS collection, arg_max(doc_id, processed_s * 1000000 + doc_id) AS last_doc FROM docs GROUP BY 1 HAVING count(*) FILTER (WHERE status IN ('pending', 'processing')) = 0", "docs")

# V: corpus checks. A fact is the first word of eight letters or more of a document.
_FACT = "SELECT doc_id AS fact_id, doc_id, regexp_extract(text, '([a-z]{{8,}})', 1) AS value, lang AS kind, access_label AS label FROM (SELECT d.*, CASE doc_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'managers' ELSE 'hr' END AS access_label FROM {documents} d) x WHERE regexp_extract(text, '([a-z]{{8,}})', 1) <> ''"
_facts = lambda s, d: s.sql(_FACT, documents=_t(s, d, "documents"))
_F = _FACT.format(documents="documents")
_q("v2_heading_sequence", lambda s, d: V.heading_sequence(D.markdown_blocks(_t(s, d, "documents").select("doc_id", F.concat(F.lit("# T\n\n## 1. A\n\nx\n\n## "), F.when(F.col("doc_id") % 2 == 0, "2").otherwise("3"), F.lit(". B\n\ny")).alias("text")))),
   "SELECT doc_id, doc_id % 2 = 0 AS in_order, 2 AS headings FROM documents")
_q("v6_stray_digits", lambda s, d: _t(s, d, "documents").select("doc_id", F.size(V.stray_digits(F.col("text"), [r"\d{4}-\d{2}-\d{2}"])).alias("n")),
   "SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '\\d{4}-\\d{2}-\\d{2}', ' ', 'g'), '\\d+')) AS INT) AS n FROM documents")
_q("v7_absent_topics", lambda s, d: V.absent_topics(_t(s, d, "documents"), s.sql("select explode(array('the', 'unheard', 'der', 'neverthere')) as topic")),
   "SELECT topic FROM (VALUES ('the'), ('unheard'), ('der'), ('neverthere')) t(topic) WHERE topic NOT IN (SELECT unnest(regexp_split_to_array(lower(text), '[\\s.,;:!?|]+')) FROM documents)")
_q("v8_length_bounds", lambda s, d: _t(s, d, "documents").select("doc_id", V.length_bounds(F.regexp_replace("text", r"[\x09-\x0D ]+", " "), 100, 500).alias("ok")), f"SELECT doc_id, len({_WORDS.format('text')}) BETWEEN 75 AND 650 AS ok FROM documents")
_q("v9_registry_faults", lambda s, d: V.registry_faults(_facts(s, d)),
   f"WITH f AS ({_F}) SELECT 'shared_value' AS fault, concat_ws('/', kind, value) AS key, count(DISTINCT fact_id) AS n FROM f GROUP BY kind, value HAVING count(DISTINCT fact_id) > 1")
_q("v10_effective_label", lambda s, d: view(s, d, "docs").select("doc_id", V.effective_label(F.lit("s1"), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("s1"), F.lit("hr"))).otherwise(F.create_map(F.lit("s2"), F.lit("hr"))), F.col("access_label")).alias("label")),
   "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'hr' ELSE access_label END AS label FROM docs", "docs")
_q("v11_fact_category", lambda s, d: view(s, d, "docs").groupBy(V.fact_category(F.col("attempts") > 0, F.col("access_label") == "hr", F.col("tenant") == 1, F.col("tenant")).alias("category")).agg(F.count(F.lit(1)).alias("n")),
   "SELECT CASE WHEN access_label = 'hr' THEN 'access' WHEN attempts = 0 THEN 'version' WHEN tenant = 1 THEN 'table' WHEN tenant > 1 THEN 'variant' ELSE 'direct' END AS category, count(*) AS n FROM docs GROUP BY 1", "docs")
_q("v12_document_for_fact", lambda s, d: V.document_for_fact(view(s, d, "docs").selectExpr("collection as fact_id", "doc_id", "case when doc_id % 3 = 0 then doc_id + 1 end as superseded_by", "doc_id as ord")),
   "SELECT collection AS fact_id, coalesce(max(doc_id) FILTER (WHERE doc_id % 3 <> 0), max(doc_id)) AS doc_id FROM docs GROUP BY 1", "docs")
_q("v13_gives_away", lambda s, d: _t(s, d, "documents").select("doc_id", V.gives_away(F.col("text"), F.lit("erh 42")).alias("bad")), "SELECT doc_id, contains(text, 'erh 42') OR contains(regexp_replace(text, '[^0-9]', '', 'g'), '42') AS bad FROM documents")
_gold = lambda s, d: V.golden_assembly(_facts(s, d), _facts(s, d).select("fact_id", F.concat(F.lit("What is "), F.col("kind"), F.lit("?")).alias("question")))
_q("v14_golden_assembly", lambda s, d: _gold(s, d).groupBy("category", "role", "expected_refusal").agg(F.count(F.lit(1)).alias("n")),
   f"""WITH f AS ({_F}) SELECT 'direct' AS category, 'employee' AS role, false AS expected_refusal, count(*) AS n FROM f WHERE label = 'all' UNION ALL SELECT 'access', 'employee', true, count(*) FROM f WHERE label <> 'all'
 UNION ALL SELECT 'access', CASE label WHEN 'managers' THEN 'manager' ELSE label END, false, count(*) FROM f WHERE label <> 'all' GROUP BY label""")
_q("v15_dedup_golden", lambda s, d: V.dedup_golden(_gold(s, d)),
   f"WITH f AS ({_F}) SELECT 'direct' AS category, count(DISTINCT kind) AS questions FROM f WHERE label = 'all' UNION ALL SELECT 'access', count(DISTINCT kind) FILTER (WHERE label <> 'all') + count(DISTINCT kind) FILTER (WHERE label = 'managers') + count(DISTINCT kind) FILTER (WHERE label = 'hr') FROM f")
_q("v16_rendered", lambda s, d: _t(s, d, "orders").select("o_orderkey", V.rendered(F.col("o_totalprice"), "money", "de").alias("de"), V.rendered(F.col("o_totalprice"), "money", "en").alias("en")),
   "SELECT o_orderkey, concat(translate(format('{:,.2f}', o_totalprice), ',.', '.,'), ' €') AS de, concat('€', format('{:,.2f}', o_totalprice)) AS en FROM orders")

# T: streams over the tables' files
_q("t1_incremental_ingest", lambda s, d: (lambda k: k.finish(T.incremental_ingest(T.stream_table(s, f"{d}/documents.parquet"), k).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))))(Scratch(s, "ingest")))
Q.update({n: queries_state.Q[n] for n in ("t2_delta_assembly", "t3_token_bucket", "t5_budget_admission")})
_q("t6_stream_attempts", lambda s, d: (lambda k: k.finish(T.run_to_table(T.attempt_limit(T.stream_table(s, f"{d}/events.parquet")), k, "complete")))(Scratch(s, "attempts")),
   "SELECT user_id, CAST(floor(epoch(ts) / 900) AS BIGINT) AS period, count(*) AS attempts, count(*) > 1 AS blocked FROM events GROUP BY 1, 2")
_q("t9_running_usage", lambda s, d: (lambda k: k.finish(T.run_to_table(T.running_usage(T.stream_table(s, f"{d}/events.parquet")), k, "complete")))(Scratch(s, "usage")),
   "SELECT CAST(ts AS DATE) AS day, count(*) AS queries, round(sum(value), 3) AS value FROM events GROUP BY 1")
