"""Queries of the chunker, the retrieval pipeline, quotes and typed values, with twins that meet every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import answers as G
from loamgrid.operators import corpus as V
from loamgrid.operators import documents as D
from loamgrid.operators import evaluation as E
from loamgrid.operators import extraction as X
from loamgrid.operators import retrieval as R
from loamgrid.plans.queries_documents import _COS, _F, _facts, _md, _t
from loamgrid.plans.views import view, with_views

Q: dict = {}
O: dict = {}


def _q(name, fn, sql=None, *views):
    Q[name] = fn
    if sql:
        O[name] = with_views(sql, *views) if views else sql


def _pick(key, *values):
    """The value at ``key`` modulo their number, for Spark."""
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _sql_pick(key: str, *values: str | None) -> str:
    """The same as SQL text."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


# C: markers, sections, chunks
_MARKERS = {
    "Access: Managers only": "managers", "**Zugriff: nur Führungskräfte**": "managers", "access:  People &  Culture only": "hr", "Zugriff: alle Mitarbeitenden": "all",
    "Access: Finance only. Card limits need approval.": "finance", "Access: Managers only — for the review.": "managers", "Access: via Fern is granted. Ask there.": None,
    "Access: Finannce only": "leadership", "Zugriff: nur Vorstand": "leadership", "Access: Managers only\nA second line.": None, "The access policy is old.": None, "Access: personal": "leadership",
}
_q(
    "c3_access_marker",
    lambda s, d: _t(s, d, "documents").select("doc_id", D.access_marker(_pick(F.col("doc_id"), *_MARKERS)).alias("label")),
    f"SELECT doc_id, {_sql_pick('doc_id', *_MARKERS.values())} AS label FROM documents",
)
_TK = "greatest(1, CAST(round_even(len(list_filter(regexp_split_to_array({0}, '[\\t-\\r ]+'), lambda w: w <> '')) * 1.3, 0) AS INT))"
_SECS = f"""l AS (SELECT doc_id, CAST(unnest(range(len(v))) AS INT) AS pos, unnest(v) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents) a),
 b AS (SELECT doc_id, pos, 0 AS part, pos % 8 = 0 AS head, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t FROM l UNION ALL SELECT doc_id, pos, 1, false, 'Access: ' || ['all', 'managers', 'hr', 'finance', 'leadership'][(doc_id + pos) % 5 + 1] FROM l WHERE pos % 8 = 0 AND pos > 0),
 k AS (SELECT *, count_if(head) OVER (PARTITION BY doc_id ORDER BY pos, part) AS sec FROM b WHERE t <> ''),
 g AS (SELECT doc_id, sec, min(pos) AS pos, max(t) FILTER (head) AS title, CAST(sum({_TK.format('t')}) AS INT) AS tokens, CAST(count(*) AS INT) AS blocks FROM k GROUP BY 1, 2),
 s AS (SELECT g.doc_id, sec, CASE WHEN g.title IS NOT NULL THEN CASE WHEN g.pos > 0 AND h.title IS NOT NULL THEN h.title || ' > ' ELSE '' END || g.title END AS section_path, CASE WHEN g.pos > 0 THEN ['all', 'managers', 'hr', 'finance', 'leadership'][(g.doc_id + g.pos) % 5 + 1] ELSE 'all' END AS access_label, tokens, blocks
  FROM g LEFT JOIN (SELECT doc_id, title FROM g WHERE pos = 0) h ON h.doc_id = g.doc_id)"""
_q("c4_sections", lambda s, d: D.section_rows(D.markdown_blocks(_md(s, d))).select("doc_id", "sec", "section_path", "access_label", "tokens", F.size("blocks").alias("blocks")), f"WITH {_SECS} SELECT doc_id, CAST(sec AS BIGINT) AS sec, section_path, access_label, tokens, blocks FROM s")
_GROUPS = f"""{_SECS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS m FROM s),
 f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS m, 0 AS g, CAST(0 AS BIGINT) AS t, '' AS label, false AS opn FROM o
 UNION ALL SELECT doc_id, m, CASE WHEN joins THEN g ELSE g + 1 END, CASE WHEN joins THEN t + tokens ELSE tokens END, access_label, tokens <= 450 FROM (SELECT f.doc_id, o.m, g, t, o.tokens, o.access_label, opn AND o.tokens <= 450 AND label = o.access_label AND t + o.tokens <= 450 AS joins FROM f JOIN o ON o.doc_id = f.doc_id AND o.m = f.m + 1) x)"""
_q("c5_merge_groups", lambda s, d: D.section_rows(D.markdown_blocks(_md(s, d))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sec", "access_label", "tokens"))).alias("x")).select("doc_id", F.posexplode(D.merge_groups(F.col("x"), 450)).alias("sec", "grp")),
   f"WITH RECURSIVE {_GROUPS} SELECT doc_id, CAST(m - 1 AS INT) AS sec, g AS grp FROM f WHERE m > 0")
_W = "list_filter(regexp_split_to_array({0}, '[\\t-\\r ]+'), lambda w: w <> '')"
_q(
    "c6_sentence_units",
    lambda s, d: _t(s, d, "documents").select("doc_id", F.size(D.sentence_units(F.regexp_replace("text", r"^\|+", ""), 60)).alias("units")),
    f"""WITH u AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '^[|]+', ''), '([.!?…])\\s+', '\\1\x01', 'g'), chr(1))) AS x FROM documents),
 n AS (SELECT doc_id, len({_W.format('x')}) AS n FROM u)
 SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN n = 0 THEN 0 WHEN round_even(n * 1.3, 0) > 60 THEN ceil(n / 46.0) ELSE 1 END), 0) AS INT) AS units FROM documents d LEFT JOIN n USING (doc_id) GROUP BY 1""",
)
_q(
    "c7_split_table",
    lambda s, d: _t(s, d, "documents").select("doc_id", F.size(D.split_tables(F.concat(F.lit("| a | b |\n| --- | --- |\n"), F.array_join(F.transform(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w: F.concat(F.lit("| "), w, F.lit(" |"))), "\n")), 40)).alias("parts")),
    # Header: 10 words; a row: 3. 40 tokens hold 31 words, so 7 rows are a part.
    "SELECT doc_id, CAST(ceil(len(string_split(regexp_replace(text, '[\\t-\\r ]+', ' ', 'g'), ' ')) / 7.0) AS INT) AS parts FROM documents",
)
# Windows: each ends before the unit that takes it over 450 tokens; the next begins with the last units of its second half that come to 60, or with that unit where both are over 512.
_WINDOWS = f"""{_GROUPS},
 gs AS (SELECT o.doc_id, f.g, o.sec, o.section_path, o.access_label, o.tokens FROM f JOIN o ON o.doc_id = f.doc_id AND o.m = f.m),
 gb AS (SELECT gs.doc_id, gs.g, k.pos, k.part, k.t, gs.tokens > 450 AS long FROM gs JOIN k ON k.doc_id = gs.doc_id AND k.sec = gs.sec),
 gf AS (SELECT doc_id, g, arg_min(section_path, sec) AS section_path, arg_min(access_label, sec) AS access_label FROM gs GROUP BY 1, 2),
 u0 AS (SELECT doc_id, g, pos, part, unnest(v) AS x, unnest(range(len(v))) AS j FROM (SELECT *, string_split(regexp_replace(t, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS v FROM gb WHERE long) y),
 u1 AS (SELECT doc_id, g, pos, part, j, unnest(v) AS x, unnest(range(len(v))) AS h FROM (SELECT *, CASE WHEN {_TK.format('x')} > 512 THEN list_transform(range(0, len({_W.format('x')}), 393), lambda i: array_to_string(list_slice({_W.format('x')}, i + 1, i + 393), ' ')) ELSE [trim(x)] END AS v FROM u0) y WHERE trim(x) <> ''),
 us AS (SELECT doc_id, g, list(x ORDER BY pos, part, j, h) AS units, list({_TK.format('x')} ORDER BY pos, part, j, h) AS n FROM u1 GROUP BY 1, 2),
 cs AS (SELECT doc_id, g, units, len(n) AS n, list_transform(range(len(n) + 1), lambda i: coalesce(list_sum(list_slice(n, 1, i)), 0)) AS c FROM us),
 w AS (SELECT doc_id, g, 0 AS nth, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS i0, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS q, false AS ended FROM cs
  UNION ALL SELECT doc_id, g, nth + 1, CASE WHEN b IS NULL THEN a WHEN c[b + 2] - c[tail + 1] > 512 THEN b ELSE tail END, coalesce(b, n), a, coalesce(b, n), b IS NULL
  FROM (SELECT *, coalesce(list_max(list_filter(range(a + (b - a) // 2, b + 1), lambda y: c[b + 1] - c[y + 1] >= 60)), a + (b - a) // 2) AS tail
   FROM (SELECT w.*, cs.c, cs.n, list_filter(range(i0 + 1, cs.n), lambda y: c[y + 2] - c[a + 1] > 450)[1] AS b FROM w JOIN cs ON cs.doc_id = w.doc_id AND cs.g = w.g WHERE NOT ended) y) z),
 ch AS (SELECT w.doc_id, w.g, nth, trim(array_to_string(list_transform(list_slice(units, p + 1, q), lambda y: CASE WHEN starts_with(y, '|') THEN chr(10) || chr(10) || y || chr(10) || chr(10) ELSE y || ' ' END), ''), ' ' || chr(10)) AS content FROM w JOIN cs ON cs.doc_id = w.doc_id AND cs.g = w.g WHERE nth > 0
  UNION ALL SELECT doc_id, g, 0, string_agg(t, chr(10) || chr(10) ORDER BY pos, part) FROM gb GROUP BY 1, 2, 3 HAVING NOT bool_or(long)),
 nm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, nth) - 1 AS chunk_index FROM ch)"""
_q("c8_chunks", lambda s, d: D.chunk_documents(_md(s, d)).withColumn("content", F.md5("content")),
   f"WITH RECURSIVE {_WINDOWS} SELECT nm.doc_id, CAST(chunk_index AS INT) AS chunk_index, md5(content) AS content, {_TK.format('content')} AS token_count, CAST(NULL AS INT) AS page_start, CAST(NULL AS INT) AS page_end, section_path, access_label FROM nm JOIN gf ON gf.doc_id = nm.doc_id AND gf.g = nm.g WHERE trim(content) <> ''")

# T1 chunks the texts as they are: one section without a heading, each paragraph a block.
_PLAIN = f"""k AS (SELECT doc_id, pos, 0 AS part, 0 AS sec, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r\\f\\v]*\\n\\s*') AS v FROM documents) a) b WHERE trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
 s AS (SELECT doc_id, 0 AS sec, CAST(NULL AS VARCHAR) AS section_path, 'all' AS access_label, CAST(sum({_TK.format('t')}) AS INT) AS tokens FROM k GROUP BY 1)"""
O["t1_incremental_ingest"] = f"WITH RECURSIVE {_WINDOWS.replace(_SECS, _PLAIN)} SELECT doc_id, count(*) AS chunks FROM nm WHERE trim(content) <> '' GROUP BY 1"

# R: full text and the whole pipeline
_RW = "[\\p{L}\\p{N}\\p{M}_]+"
_ITEMS = f"""items AS (SELECT DISTINCT query_id, grp, neg, words FROM (
 SELECT query_id, 0 AS grp, false AS neg, [w[3], w[4]] AS words FROM asked WHERE (query_id // 20) % 2 = 0
 UNION ALL SELECT query_id, 0, false, [w[6]] FROM asked WHERE (query_id // 20) % 2 = 0
 UNION ALL SELECT query_id, 1, false, [w[8]] FROM asked WHERE (query_id // 20) % 2 = 0
 UNION ALL SELECT query_id, 1, true, [w[1]] FROM asked WHERE (query_id // 20) % 2 = 0
 UNION ALL SELECT query_id, 0, false, regexp_extract_all(lower(t), '{_RW}') FROM (SELECT query_id, unnest(regexp_extract_all(question, '\\S+')) AS t FROM asked WHERE (query_id // 20) % 2 = 1) z) y WHERE len(words) > 0)"""
_FTS = f"""{_ITEMS},
 pw AS (SELECT chunk_id, access_label, regexp_extract_all(lower(content), '{_RW}') AS w FROM passages),
 pp AS (SELECT chunk_id, access_label, w, unnest(range(len(w))) AS pos, unnest(w) AS term FROM pw),
 hh AS (SELECT i.query_id, p.chunk_id, i.grp, i.neg, i.words, p.pos AS l, p.pos + len(i.words) - 1 AS r FROM items i JOIN asked a ON a.query_id = i.query_id JOIN role_labels rl ON rl.role = a.role
  JOIN pp p ON p.term = i.words[1] AND p.access_label = rl.label WHERE list_slice(p.w, p.pos + 1, p.pos + len(i.words)) = i.words),
 nd AS (SELECT query_id, grp, count(*) AS n, sum(len(words)) AS size FROM items WHERE NOT neg GROUP BY 1, 2),
 ft AS (SELECT h.query_id, h.chunk_id, h.grp, any_value(n) AS n, any_value(size) AS size FROM hh h JOIN nd USING (query_id, grp) GROUP BY 1, 2, 3 HAVING NOT bool_or(neg) AND count(DISTINCT words) = any_value(n)),
 ev AS (SELECT a.query_id, a.chunk_id, a.grp, a.l, a.r, b.words, max(b.l) AS last FROM ft JOIN hh a USING (query_id, chunk_id, grp) JOIN hh b ON b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.grp = a.grp AND (b.l < a.l OR (b.l = a.l AND b.r <= a.r)) GROUP BY ALL),
 lf AS (SELECT query_id, chunk_id, grp, l, r, min(last) AS lft, count(*) AS k FROM ev GROUP BY ALL),
 cv AS (SELECT lf.query_id, lf.chunk_id, lf.grp, lft, arg_min(lf.r, lf.l * 1000000 + lf.r) AS r, any_value(size) AS size FROM lf JOIN ft USING (query_id, chunk_id, grp) WHERE k = n GROUP BY 1, 2, 3, 4),
 sc AS (SELECT query_id, chunk_id, round(sum(1.0 / (1 + greatest(r - lft + 1 - size, 0))), 9) AS score FROM cv GROUP BY 1, 2),
 fts AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM sc)"""
_VEC = f"""vs AS (SELECT q.query_id, c.chunk_id, {_COS} AS score FROM asked q JOIN role_labels r ON q.role = r.role JOIN passages c ON c.access_label = r.label),
 vec AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM vs)"""


def _pipeline_sql(threshold: float, fused: int, top: int) -> str:
    return f"""WITH {_FTS}, {_VEC}, al AS (SELECT query_id, chunk_id, rank FROM vec WHERE rank <= 40 UNION ALL SELECT query_id, chunk_id, rank FROM fts WHERE rank <= 40),
 fu AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 12) AS rrf FROM al GROUP BY 1, 2), fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS INT) AS fused_rank FROM fu),
 g AS (SELECT query_id, max(score) AS gate_score FROM vec WHERE rank <= 40 GROUP BY 1)
 SELECT a.query_id, f.chunk_id, f.rrf, f.fused_rank, round(f.rrf / max(f.rrf) OVER (PARTITION BY a.query_id), 9) AS relative, g.gate_score, coalesce(g.gate_score < {threshold}, true) AS refused
 FROM asked a LEFT JOIN g USING (query_id) LEFT JOIN (SELECT * FROM fr WHERE fused_rank <= {min(fused, top)}) f ON f.query_id = a.query_id"""


_ask = lambda s, d: view(s, d, "asked")
_pass = lambda s, d: view(s, d, "passages")
_lab = lambda s, d: view(s, d, "role_labels")
_items = lambda s, d: _ask(s, d).select("query_id", "role", R.parse_query(F.col("question")).alias("items"))
_q("r4_parse_query", lambda s, d: _items(s, d).select("query_id", F.explode("items").alias("i")).select("query_id", "i.grp", "i.neg", F.array_join("i.words", " ").alias("words")), f"WITH {_ITEMS} SELECT query_id, grp, neg, array_to_string(words, ' ') AS words FROM items", "asked")


def r5(s, d):
    posts = D.postings(_pass(s, d).select("chunk_id", "access_label", F.col("content").alias("text")), "chunk_id", "access_label")
    return R.fulltext_top_k(_items(s, d), posts, 10, _lab(s, d)).select("query_id", "chunk_id", "score", "rank")


_q("r5_fulltext_top_k", r5, f"WITH {_FTS} SELECT query_id, chunk_id, score, rank FROM fts WHERE rank <= 10", "asked", "passages", "role_labels")


def retrieval(threshold: float, fused: int = 40, top: int = 8):
    return lambda s, d: R.retrieve(_ask(s, d), _pass(s, d), _lab(s, d), threshold, fused=fused, top=top)


_q("flagship", retrieval(0.5), _pipeline_sql(0.5, 40, 8), "asked", "passages", "role_labels")
_q("r10_pipeline", retrieval(0.99, 20, 20), _pipeline_sql(0.99, 20, 20), "asked", "passages", "role_labels")
_q(
    "r13_refusal_gate",
    lambda s, d: R.refusal_gate(view(s, d, "ranked").select("query_id").distinct(), view(s, d, "ranked").filter("list_no = 1 and score > 20"), 60.0),
    "SELECT query_id, max(score) FILTER (WHERE list_no = 1 AND score > 20) AS gate_score, coalesce(max(score) FILTER (WHERE list_no = 1 AND score > 20) < 60, true) AS refused FROM ranked GROUP BY 1",
    "ranked",
)


def _hits(s, d):
    """Passages of a question in order of id, each question those of its remainder."""
    p = _pass(s, d).withColumn("query_id", F.col("chunk_id") % 20)
    return p.withColumn("rank", F.floor(F.col("chunk_id") / 20).cast("int") + 1)


_HEAD = """concat('[', n, '] ', filename, CASE WHEN length(section_path) > 0 THEN concat(' — ', section_path) ELSE '' END,
 CASE WHEN page_start IS NULL THEN '' WHEN coalesce(page_end, page_start) = page_start THEN concat(' (p. ', page_start, ')') ELSE concat(' (p. ', page_start, '–', page_end, ')') END)"""
_TOK = "greatest(1, CAST(round_even(len({0}) * 1.3, 0) AS INT))".format(_W)
_PACK = f"""h AS (SELECT *, chunk_id % 20 AS query_id, row_number() OVER (PARTITION BY chunk_id % 20 ORDER BY chunk_id) AS n FROM passages),
 t AS (SELECT *, {_HEAD} AS header, CASE WHEN {_TOK.format('content')} > 130 THEN array_to_string(list_slice({_W.format('content')}, 1, 100), ' ') ELSE content END AS text FROM h),
 b AS (SELECT *, sum({_TOK.format('header')} + {_TOK.format('text')}) OVER (PARTITION BY query_id ORDER BY n) AS total FROM t)"""
_q(
    "r16_pack_context",
    lambda s, d: R.pack_context(_hits(s, d), 700, 130).select("query_id", "n", "chunk_id", "header", "total", F.md5("text").alias("text_md5")),
    f"WITH {_PACK} SELECT query_id, CAST(n AS INT) AS n, chunk_id, header, CAST(total AS BIGINT) AS total, md5(text) AS text_md5 FROM b WHERE total <= 700 OR n = 1",
    "passages",
)
_q(
    "r17_prompt",
    lambda s, d: R.render_prompt(R.pack_context(_hits(s, d), 700, 130), s.range(20).selectExpr("id as query_id", "concat('Why ', id, '?') as question", "case when id % 2 = 1 then 'Why now?' end as effective_question")).select("query_id", F.md5("prompt").alias("prompt_md5")),
    f"""WITH {_PACK} SELECT query_id, md5(concat('Context blocks:', chr(10), chr(10), string_agg(concat(header, chr(10), text), concat(chr(10), chr(10)) ORDER BY n), chr(10), chr(10),
 CASE WHEN query_id % 2 = 0 THEN concat('Question: Why ', query_id, '?') ELSE concat('Original user wording: Why ', query_id, '?', chr(10), 'Standalone retrieval interpretation: Why now?') END)) AS prompt_md5
 FROM b WHERE total <= 700 OR n = 1 GROUP BY query_id""",
    "passages",
)

# G: quotes and citations on the texts themselves
_BODIES = ["It is [2] , so [7][1].", "Two  lines [9] .\nstay [1]", " Plain [3]. ", "[12]", "No marks,  kept"]
_CLEAN = ["It is [2], so [1].", "Two lines.\nstay [1]", "Plain [3].", "", "No marks,  kept"]
_LINES = ["QUOTES", "**Quotes:**", "> quotes", "### QUOTES:", "no QUOTES here"]
_q(
    "g2_split_quotes",
    lambda s, d: _t(s, d, "documents").select("doc_id", G.split_quotes(F.concat(_pick(F.col("doc_id"), *_BODIES), F.lit("  \n"), _pick(F.col("doc_id"), *_LINES), F.lit("\n[1] \""), F.left("text", F.lit(20)), F.lit("\""))).alias("x")).select("doc_id", "x.body", F.length("x.quotes").alias("quotes")),
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN concat({_sql_pick('doc_id', *_BODIES)}, '  ', chr(10), 'no QUOTES here', chr(10), '[1] "', left(text, 20), '"') ELSE rtrim({_sql_pick('doc_id', *_BODIES)}) END AS body,
 CAST(CASE WHEN doc_id % 5 = 4 THEN 0 ELSE 7 + least(length(text), 20) END AS INT) AS quotes FROM documents""",
)
_ITEMS_G3 = ['- [1] "{}"', "[22] : “{}”", "  • [3] ‘{}’  ", "[x] {}", '[4] "{}']
_q(
    "g3_quote_lines",
    lambda s, d: _t(s, d, "documents").select("doc_id", F.explode(G.quote_lines(F.array_join(F.array(*[F.concat(*[F.lit(x) for x in t.split("{}")][:1], F.concat(F.lit("q"), F.col("doc_id").cast("string")), F.lit(t.split("{}")[1])) for t in _ITEMS_G3]), "\n"))).alias("q")).select("doc_id", "q.n", "q.quote"),
    "SELECT doc_id, unnest(['1', '22', '3', '4']) AS n, concat('q', doc_id) AS quote FROM documents WHERE doc_id >= 10",
)
_q(
    "g5_clean_citations",
    lambda s, d: _t(s, d, "documents").select("doc_id", G.clean_citations(_pick(F.col("doc_id"), *_BODIES), F.array(F.lit(1), F.lit(2), F.lit(3))).alias("answer")),
    f"SELECT doc_id, {_sql_pick('doc_id', *_CLEAN)} AS answer FROM documents",
)
_q("g8_fuzzy", lambda s, d: G.locate(_t(s, d, "documents").filter(F.length("text") > 200).select(F.col("doc_id").alias("key"), F.concat(F.substring("text", 60, 20), F.lit("#"), F.substring("text", 81, 40)).alias("quote"), F.col("text").alias("content"))))
_q("g9_fallback_spans", lambda s, d: _t(s, d, "documents").select("doc_id", F.posexplode(G.fallback_spans(F.concat(F.lit("the of der 4207 [1] que and "), F.substring("text", 30, 40)), F.col("text"))).alias("i", "x")).select("doc_id", "i", "x.start", "x.end"))


def _answers(s, d):
    """An answer per document that cites two blocks: its text, quoted word for word in two thirds, and a short fixed one."""
    docs = _t(s, d, "documents").filter(F.length("text") > 60)
    quote = F.substring("text", 5, 40)
    a = docs.select(
        F.col("doc_id").alias("key"),
        F.concat(F.lit("Stated there [1]. The second one says seven cats [2]. And [5]."),).alias("body"),
        F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("\n- [1] «"), F.regexp_replace(quote, r"\s+", " "), F.lit("»\n[2] \"nowhere to be found\""))).otherwise(F.lit("\n")).alias("quotes"),
    )
    b = docs.select(F.col("doc_id").alias("key"), F.lit(1).alias("n"), F.col("text").alias("content"), "source")
    c = docs.select(F.col("doc_id").alias("key"), F.lit(2).alias("n"), F.lit("Dogs sleep. There are seven cats here. Rain").alias("content"), "source")
    return a, b.unionByName(c)


_q("g11_spans", lambda s, d: G.resolve_quotes(*_answers(s, d)))
_q("g11_resolve_quotes", lambda s, d: G.resolve_quotes(*_answers(s, d)).groupBy("n", "method").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("key").alias("answers")))
_q(
    "g12_payload",
    lambda s, d: (lambda a, b: G.payload(G.resolve_quotes(a, b).filter("n = 2"), b, 20))(*_answers(s, d)).select("key", "n", "start", "end", "method", "quote", "snippet", "source"),
    """SELECT doc_id AS key, 2 AS n, 12 AS start, 38 AS "end", 'fallback' AS method, 'There are seven cats here.' AS quote, 'Dogs sleep. There ar' AS snippet, source FROM documents WHERE length(text) > 60""",
)

# X: typed values
_NUMBERS = {"1,250.00 EUR": 1250.0, "€ 1.250,00": 1250.0, "1 250,50": 1250.5, "-42": -42.0, "12,345": 12345.0, "12,34": 12.34, "1,2345": 12345.0, ".5": 0.5, "1,234,56": 1234.56, "1.234.567": 1234567.0, "5-3": None, "n/a": None, "7,": 7.0}
_SHOWN = {"eu": lambda c: F.concat(F.lit("€ "), F.translate(F.format_number(c, 2), ",.", ".,")), "us": lambda c: F.concat(F.lit("-"), F.format_number(c, 2), F.lit(" USD"))}
_q(
    "x3_parse_number",
    lambda s, d: _t(s, d, "orders").select("o_orderkey", *[X.parse_number(f(F.col("o_totalprice"))).alias(n) for n, f in _SHOWN.items()], X.parse_number(_pick(F.col("o_orderkey"), *_NUMBERS)).alias("fixed")),
    "SELECT o_orderkey, round(o_totalprice, 2) AS eu, -round(o_totalprice, 2) AS us, CAST(" + _sql_pick("o_orderkey", *[None if v is None else str(v) for v in _NUMBERS.values()]) + " AS DOUBLE) AS fixed FROM orders",
)
_DAYS = ["yyyy-MM-dd", "dd.MM.yyyy", "d/M/yyyy", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "yyyy-MM-dd'T'HH:mm:ss"]
_ODD_DAYS = {"03/25/2026": "2026-03-25", "05-06-2024": None, "sometime": None, "Issued 2026-03-05T10:00:00": "2026-03-05", "2026-13-45": "2026-13-45", "5.3.26": None}
_q(
    "x4_parse_date",
    lambda s, d: _t(s, d, "orders").select("o_orderkey", X.parse_date(_pick(F.col("o_orderkey"), *[F.date_format("o_orderdate", f) for f in _DAYS])).alias("day"), X.parse_date(_pick(F.col("o_orderkey"), *_ODD_DAYS)).alias("odd")),
    f"SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, {_sql_pick('o_orderkey', *_ODD_DAYS.values())} AS odd FROM orders",
)
_BOOLS = {"Yes": "true", " JA ": "true", "x": "true", "checked": "true", "1": "true", "no": "false", "Nein": "false", "none": "false", "unchecked": "false", "wahr": None, "?": None}
_q(
    "x5_parse_boolean",
    lambda s, d: _t(s, d, "orders").select("o_orderkey", X.parse_boolean(_pick(F.col("o_orderkey"), *_BOOLS)).cast("string").alias("value")),
    f"SELECT o_orderkey, {_sql_pick('o_orderkey', *_BOOLS.values())} AS value FROM orders",
)


def x6(s, d):
    p = _t(s, d, "part").withColumn("first", F.initcap(F.lower(F.regexp_extract("p_type", r"^(\w+)", 1))))
    c = {
        "e": X.coerce(F.col("first"), "enum", ["ECONOMY", "STANDARD"]), "i": X.coerce(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".5").otherwise(".0")), "integer"),
        "s": X.coerce(F.concat(F.lit(" "), "p_name", F.lit(" ")), "string", None, "[a-m].*"), "a": X.coerce(F.concat("p_name", F.lit("; "), "p_brand", F.lit(",\n, ")), "array"), "n": X.coerce(F.lit("  "), "number"),
    }
    p = p.select("p_partkey", *[v.alias(k) for k, v in c.items()])
    return p.select("p_partkey", "e.value", F.col("e.issue").alias("e_issue"), F.col("i.value").alias("i"), F.col("i.issue").alias("i_issue"), F.col("s.value").alias("s"), F.col("s.issue").alias("s_issue"), F.array_join("a.items", "+").alias("a"), F.coalesce("n.value", "n.issue").alias("n"))


_q(
    "x6_coerce",
    x6,
    """SELECT p_partkey, CASE WHEN upper(regexp_extract(p_type, '^(\\w+)', 1)) IN ('ECONOMY', 'STANDARD') THEN upper(regexp_extract(p_type, '^(\\w+)', 1)) END AS value,
 CASE WHEN upper(regexp_extract(p_type, '^(\\w+)', 1)) NOT IN ('ECONOMY', 'STANDARD') THEN 'enum_mismatch' END AS e_issue, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS STRING) END AS i,
 CASE WHEN p_partkey % 2 = 0 THEN 'type_mismatch' END AS i_issue, p_name AS s, CASE WHEN NOT regexp_full_match(p_name, '[a-m].*') THEN 'pattern_mismatch' END AS s_issue, concat(p_name, '+', p_brand) AS a, NULL AS n FROM part""",
)

# V and E: facts in documents, word error rate
_q(
    "v3_marker_placement",
    lambda s, d: V.marker_placement(
        _t(s, d, "documents").select("doc_id", F.lit("1. Scope").alias("title"), _pick(F.col("doc_id"), "all", "hr", "finance").alias("access_label")).filter("doc_id % 7 > 0"),
        _t(s, d, "documents").filter("doc_id % 5 > 0").select("doc_id", F.lit("1. Scope").alias("title"), _pick(F.col("doc_id"), "all", "hr", "hr").alias("label")),
    ),
    """SELECT doc_id, '1. Scope' AS title, CASE WHEN doc_id % 7 = 0 THEN 'missing_section' WHEN doc_id % 5 = 0 THEN 'unexpected_marker' ELSE 'wrong_label' END AS fault,
 CASE WHEN doc_id % 7 > 0 THEN CASE doc_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'hr' ELSE 'finance' END END AS found, CASE WHEN doc_id % 5 > 0 THEN CASE doc_id % 3 WHEN 0 THEN 'all' ELSE 'hr' END END AS wanted
 FROM documents WHERE (doc_id % 7 = 0 AND doc_id % 5 > 0) OR (doc_id % 7 > 0 AND doc_id % 5 = 0 AND doc_id % 3 > 0) OR (doc_id % 7 > 0 AND doc_id % 5 > 0 AND doc_id % 3 = 2)""",
)
_VW = "[.,]?[\\p{L}\\p{N}_]+(?:[.,]\\p{N}+)*"
_q(
    "v4_fact_presence",
    lambda s, d: V.fact_presence(_facts(s, d).withColumn("sec", F.col("doc_id") % 2), _t(s, d, "documents").select("doc_id", F.lit(0).alias("sec"), "text")),
    f"WITH f AS ({_F}) SELECT fact_id, f.doc_id % 2 = 0 AND list_contains(regexp_extract_all(text, '{_VW}'), value) AS present FROM f JOIN documents d ON d.doc_id = f.doc_id",
)
_q(
    "v5_foreign_values",
    lambda s, d: V.foreign_values(_facts(s, d), _t(s, d, "documents")),
    f"""WITH f AS ({_F}), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_VW}')) AS term FROM documents), n AS (SELECT term, count(*) AS n FROM t GROUP BY 1)
 SELECT fact_id, n - CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS documents FROM f JOIN n ON n.term = f.value LEFT JOIN t ON t.term = f.value AND t.doc_id = f.doc_id WHERE n - CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END > 0""",
)
_q(
    "v1_section_split",
    lambda s, d: D.section_rows(D.markdown_blocks(_t(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Intro\n\n# "), "p_name", F.lit("\n\n```\n# no heading\n```\n\n## "), "p_brand", F.lit("\n\nAccess: HR only\n\n"), "p_type").alias("text")))).select("doc_id", "sec", "section_path", "access_label"),
    """SELECT p_partkey AS doc_id, CAST(sec AS BIGINT) AS sec, CASE sec WHEN 1 THEN p_name WHEN 2 THEN concat(p_name, ' > ', p_brand) END AS section_path, CASE sec WHEN 2 THEN 'hr' ELSE 'all' END AS access_label
 FROM part, (VALUES (0), (1), (2)) v(sec)""",
)
_q(
    "e10_word_errors",
    lambda s, d: _t(s, d, "conversations").select("conv_id", "turn", F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "").alias("w")).select("conv_id", "turn", F.round(E.word_error_rate(F.col("w"), F.filter("w", lambda x, i: i % 5 != 3)), 9).alias("rate")),
    f"SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(((len(w) + 1) // 5) / len(w), 9) END AS rate FROM (SELECT conv_id, turn, {_W.format('text')} AS w FROM conversations) x",
)

# S: types, properties and names
_TYPES = {
    "255044462D312E37": "application/pdf", "89504E470D0A1A0A": "image/png", "FFD8FFE000104A46": "image/jpeg", "4D4D002A00000008": "image/tiff", "424D36000000": "image/bmp", "524946462A00000057454250": "image/webp",
    "474946383961": "image/gif", "00000018667479706865696300": "image/heic", "00000018667479706D69663100": "image/heif", "504B030414000600": None, "74657874": "text/markdown", "FFFE": None,
}
_q(
    "s4_mime",
    lambda s, d: view(s, d, "docs").select("doc_id", D.detect_mime(F.unhex(_pick(F.col("doc_id"), *_TYPES)), F.when(F.col("doc_id") % 24 == 9, "A.DOCX").otherwise(F.col("filename"))).alias("mime")),
    f"SELECT doc_id, CASE WHEN doc_id % 24 = 9 THEN '{D.DOCX}' ELSE {_sql_pick('doc_id', *_TYPES.values())} END AS mime FROM docs",
    "docs",
)
_PROPS = [
    ("title", '[{"plain_text": "%", "annotations": {"bold": true}}, {"plain_text": "x", "href": "u"}]', "**%**[x](u)"), ("number", " 3.5 ", "3.5"), ("select", '{"name": "%"}', "%"), ("status", '{"name": ""}', None),
    ("multi_select", '[{"name": "%"}, {"name": "b"}]', "%, b"), ("date", '{"start": "2026-01-02", "end": "2026-02-03"}', "2026-01-02 → 2026-02-03"), ("date", '{"start": "2026-01-02", "end": null}', "2026-01-02"), ("checkbox", "false", "no"), ("checkbox", "true", "yes"),
    ("url", '"http://%"', "http://%"), ("people", '[{"name": "%"}, {"name": ""}, {"id": 1}]', "%"), ("files", "[]", None), ("formula", '{"type": "string", "string": "%"}', "%"), ("formula", '{"type": "boolean", "boolean": true}', "True"), ("rollup", '{"type": "array", "array": [1]}', None),
    ("unique_id", '{"prefix": "AB", "number": 7}', "AB-7"), ("unique_id", '{"prefix": null, "number": 7}', "7"), ("created_time", '"2026-01-02T03:04:05"', "2026-01-02T03:04:05"), ("relation", '[{"id": "a"}]', None), ("number", "null", None),
]
_q(
    "s16_property_text",
    lambda s, d: _t(s, d, "part").select("p_partkey", D.property_text(_pick(F.col("p_partkey"), *[k for k, _, _ in _PROPS]), F.replace(_pick(F.col("p_partkey"), *[v for _, v, _ in _PROPS]), F.lit("%"), F.col("p_name"))).alias("t")),
    f"SELECT p_partkey, replace({_sql_pick('p_partkey', *[t for _, _, t in _PROPS])}, '%', p_name) AS t FROM part",
)
_q(
    "s19_safe_filename",
    lambda s, d: _t(s, d, "pages").select("page_id", D.safe_filename(_pick(F.col("page_id"), F.col("url"), F.concat(F.lit(" a  b\t/\\c"), F.col("url")), F.lit(" / "), F.repeat("url", 9))).alias("name")),
    r"""SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'untitled.md' ELSE concat(rtrim(left(trim(regexp_replace(CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat(' a  b', chr(9), '/\c', url) ELSE repeat(url, 9) END, '[\x00-\x1f/\\]+', ' ', 'g')), 120)), '.md') END AS name FROM pages""",
)

# X and Q: context, boxes, roles
_ctx = lambda s, d: view(s, d, "chunks").dropDuplicates(["document_id", "chunk_index"]).withColumn("score", F.round(F.get("embedding", F.lit(0)).cast("double"), 6))
_q("x9_select_context", lambda s, d: X.select_context(_ctx(s, d), 800, 2300))

_ROLES = ["employee", "manager", "hr", "finance", "leadership"]
_sc = lambda s, d: view(s, d, "chunks").select((F.col("chunk_id") % 40).alias("query_id"), "access_label", (F.col("token_count") % 100 / 100).alias("score"))
_q(
    "q5_minimum_role",
    lambda s, d: X.minimum_role(X.role_scores(_sc(s, d), _lab(s, d)), _ROLES, 0.5),
    """WITH s AS (SELECT chunk_id % 40 AS query_id, access_label, token_count % 100 / 100 AS score FROM chunks),
 r AS (SELECT q.query_id, r.role, coalesce(max(s.score), 0.0) AS score FROM (SELECT DISTINCT query_id FROM s) q CROSS JOIN role_labels r LEFT JOIN s ON s.query_id = q.query_id AND s.access_label = r.label GROUP BY 1, 2),
 b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r)
 SELECT query_id, coalesce(arg_min(role, list_position(['employee', 'manager', 'hr', 'finance', 'leadership'], role)) FILTER (WHERE score >= 0.5 AND score >= best - 0.03), 'employee') AS min_role FROM b GROUP BY 1""",
    "chunks",
    "role_labels",
)
_q(
    "q7_locked_hint",
    lambda s, d: X.locked_hint(view(s, d, "docs"), _lab(s, d)),
    """WITH z AS (SELECT role, count(*) AS size FROM role_labels GROUP BY 1),
 x AS (SELECT d.collection, d.filename, d.doc_id, z.size, r.role FROM docs d JOIN role_labels r ON r.label = d.access_label JOIN z ON z.role = r.role WHERE d.access_label NOT IN (SELECT label FROM role_labels WHERE role = 'employee'))
 SELECT collection, doc_id, role FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY filename, doc_id, size, role) AS n FROM x) y WHERE n = 1""",
    "docs",
    "role_labels",
)
