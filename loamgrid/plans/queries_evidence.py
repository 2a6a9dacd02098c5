"""Queries of evidence, contexts and histories, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import conversations as H
from loamgrid.operators import documents as D
from loamgrid.operators import evidence as E
from loamgrid.operators import extraction as X
from loamgrid.plans.views import view, with_views

Q: dict = {}
O: dict = {}


def _q(name, fn, sql=None, *views):
    Q[name] = fn
    if sql:
        O[name] = with_views(sql, *views) if views else sql


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


# Documents as chunks of four lines and as boxes of a line each, some without pages
_LINES = "SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a"
_CH = f"ch AS (SELECT doc_id, pos // 4 AS chunk_index, doc_id * 1000 + pos // 4 AS chunk_id, CASE WHEN doc_id % 4 > 0 THEN pos // 8 END AS p0, CASE WHEN doc_id % 4 > 1 THEN pos // 8 + doc_id % 2 WHEN doc_id % 4 = 1 THEN pos // 8 END AS p1, string_agg(line, chr(10) ORDER BY pos) AS content FROM ({_LINES}) l GROUP BY ALL)"


def _evidence(s, d):
    lines = D.lines_of(_t(s, d, "documents"))
    page = F.floor(F.col("pos") / 8).cast("int")
    known = lines.withColumns({"chunk_index": F.floor(F.col("pos") / 4).cast("int"), "page_start": F.when(F.col("doc_id") % 4 > 0, page), "page_end": F.when(F.col("doc_id") % 4 > 1, page + F.col("doc_id") % 2).when(F.col("doc_id") % 4 == 1, page).cast("int")})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    chunks = known.groupBy("doc_id", "chunk_index", "page_start", "page_end").agg(text.alias("content")).withColumn("chunk_id", F.col("doc_id") * 1000 + F.col("chunk_index"))
    blocks = lines.select("doc_id", page.alias("page"), F.col("pos").alias("block"), F.array("pos", F.col("pos") + 1, F.lit(7), F.lit(9)).alias("bbox"), F.array(F.lit(600), F.lit(800)).alias("size"), F.upper("line").alias("text"))
    five = lines.filter("pos = 5 and length(line) >= 100")
    part = lambda a, n: F.substring("line", a, n)
    row = lambda name, value, quote, ok=True: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), quote.cast("string").alias("quote"), F.lit(ok).alias("searchable"))
    none = F.lit(None)
    fields = five.select("doc_id", F.explode(F.array(
        row("holds", part(8, 12), part(3, 90)), row("apart", F.lit("§§§§"), part(3, 90)), row("alone", part(3, 80), none), row("garbage", part(4, 80), F.lit("§¤§¤§¤§¤")), row("nothing", F.lit("¤¤¤¤"), F.lit("§¤§¤§¤§¤")),
        row("bare", none, part(3, 90)), row("list", part(3, 80), none, False), row("marked", part(10, 9), F.concat(F.lit("**"), F.replace(F.upper(part(3, 90)), F.lit(" "), F.lit("  ")), F.lit("**"))),
    )).alias("x")).select("doc_id", "x.*")
    return fields, chunks, blocks


_PLAIN = "trim(replace(lower(regexp_replace({0}, '[[:space:]]+', ' ', 'g')), 'ß', 'ss'))"
_NORMAL = "trim(regexp_replace(replace(lower(translate({0}, '*_`“”„«»‟‘’‚‹›–—‑−', '')), 'ß', 'ss'), '[[:space:]]+', ' ', 'g'))"
_FIELDS = f"""five AS (SELECT doc_id, line FROM ({_LINES}) l WHERE pos = 5 AND length(line) >= 100),
fields AS (SELECT doc_id, f.field AS field, f.value AS value, f.quote AS quote, f.ok AS ok FROM (SELECT doc_id, unnest([
  {{'field': 'holds', 'value': substr(line, 8, 12), 'quote': substr(line, 3, 90), 'ok': true}}, {{'field': 'apart', 'value': '§§§§', 'quote': substr(line, 3, 90), 'ok': true}}, {{'field': 'alone', 'value': substr(line, 3, 80), 'quote': NULL, 'ok': true}},
  {{'field': 'garbage', 'value': substr(line, 4, 80), 'quote': '§¤§¤§¤§¤', 'ok': true}}, {{'field': 'nothing', 'value': '¤¤¤¤', 'quote': '§¤§¤§¤§¤', 'ok': true}}, {{'field': 'bare', 'value': NULL, 'quote': substr(line, 3, 90), 'ok': true}},
  {{'field': 'list', 'value': substr(line, 3, 80), 'quote': NULL, 'ok': false}}, {{'field': 'marked', 'value': substr(line, 10, 9), 'quote': '**' || replace(upper(substr(line, 3, 90)), ' ', '  ') || '**', 'ok': true}}]) AS f FROM five) x)"""
_BOX = f"""needles AS ({{needles}}),
bl AS (SELECT doc_id, pos // 8 AS page, pos, {_PLAIN.format('line')} AS t FROM ({_LINES}) l),
sc AS (SELECT n.key, b.page, b.pos, CASE WHEN contains(t, needle) THEN 1.0 ELSE len(list_intersect(list_distinct(string_split(needle, ' ')), list_distinct(string_split(t, ' ')))) / len(list_distinct(string_split(needle, ' '))) END AS score
  FROM (SELECT key, doc_id, p0, p1, {_PLAIN.format('q')} AS needle FROM needles) n JOIN bl b ON b.doc_id = n.doc_id AND (p0 IS NULL OR p1 IS NULL OR b.page BETWEEN p0 AND p1) WHERE needle <> '' AND t <> ''),
bx AS (SELECT * FROM sc WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, page, pos) = 1)"""
_q("x10_evidence", lambda s, d: E.find_evidence(*_evidence(s, d)).select("doc_id", "field", "confidence", "chunk_index", F.when(F.col("method") == "exact", F.length("quote")).alias("n"), "page", F.get("bbox", F.lit(0)).alias("box")),
   f"""WITH {_CH}, {_FIELDS},
tr AS (SELECT doc_id, field, value, 0 AS turn, quote AS needle FROM fields WHERE quote <> '' UNION ALL SELECT doc_id, field, value, 1, value FROM fields WHERE ok AND value IS NOT NULL),
hit AS (SELECT tr.*, chunk_index, p0, p1, CASE WHEN contains(content, needle) THEN length(needle) END AS n FROM tr JOIN ch USING (doc_id) WHERE contains({_NORMAL.format('content')}, {_NORMAL.format('needle')})),
one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY turn, chunk_index) = 1),
{_BOX.format(needles="SELECT {'d': doc_id, 'f': field} AS key, doc_id, needle AS q, p0, p1 FROM one")}
SELECT f.doc_id, f.field, CASE WHEN o.turn IS NULL THEN CAST(0.4 AS DOUBLE) WHEN o.turn = 1 THEN 0.6 WHEN f.value IS NULL OR contains({_PLAIN.format("CASE WHEN f.field = 'marked' THEN substr(o.needle, 3, length(o.needle) - 4) ELSE o.needle END")}, {_PLAIN.format('f.value')}) THEN 0.9 ELSE 0.75 END AS confidence, chunk_index, n, coalesce(bx.page, p0) AS page, bx.pos AS box
FROM fields f LEFT JOIN one o ON o.doc_id = f.doc_id AND o.field = f.field LEFT JOIN bx ON bx.key.d = f.doc_id AND bx.key.f = f.field""")


def _boxes(s, d):
    """Every line, as it is, in other case or with two words more, looked up on its page or on all."""
    _, _, blocks = _evidence(s, d)
    lines = D.lines_of(_t(s, d, "documents"))
    quote = F.when(F.col("pos") % 3 == 1, F.concat(F.lit("Zz "), "line", F.lit(" zz"))).when(F.col("pos") % 3 == 2, F.concat(F.lit(" "), F.replace("line", F.lit(" "), F.lit("  ")))).otherwise(F.col("line"))
    page = F.when(F.col("doc_id") % 3 > 0, F.floor(F.col("pos") / 8).cast("int"))
    spans = lines.select(F.struct("doc_id", "pos").alias("key"), "doc_id", quote.alias("quote"), page.alias("page_start"), F.when(F.col("pos") % 5 > 0, page + F.col("pos") % 2).cast("int").alias("page_end"))
    return E.box_lookup(spans, blocks).select("key.doc_id", "key.pos", "page", F.get("bbox", F.lit(0)).alias("box"), F.array_join(F.transform("size", lambda x: x.cast("string")), "x").alias("size"), "score")


_q("x11_box_lookup", _boxes,
   f"""WITH {_BOX.format(needles=f"SELECT {{'d': doc_id, 'f': pos}} AS key, doc_id, CASE pos % 3 WHEN 1 THEN 'Zz ' || line || ' zz' WHEN 2 THEN ' ' || replace(line, ' ', '  ') ELSE line END AS q, CASE WHEN doc_id % 3 > 0 THEN pos // 8 END AS p0, CASE WHEN doc_id % 3 > 0 AND pos % 5 > 0 THEN pos // 8 + pos % 2 END AS p1 FROM ({_LINES}) l")}
SELECT key.d AS doc_id, key.f AS pos, page, pos AS box, '600x800' AS size, round(score, 9) AS score FROM bx""")

# Remainders and lists with other items
_q("x2_remainders", lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[X.compile_rule(r, {"a": (F.col("l_partkey") % 19 - 9).cast("double"), "b": (F.col("l_suppkey") % 7 - 3).cast("double")}).alias(n) for n, r in (("is_two", "a % b == 2"), ("above", "a % b > -1"), ("other", "a % b != 1"), ("sum", "-7 % 3 + a == 2 + a"))]),
   """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 19 - 9 AS a, l_suppkey % 7 - 3 AS b FROM lineitem), r AS (SELECT *, CASE WHEN b <> 0 THEN a - b * floor(a / b) END AS r FROM x)
 SELECT l_orderkey, l_linenumber, coalesce(r = 2, false) AS is_two, coalesce(r > -1, false) AS above, coalesce(r <> 1, true) AS other, true AS sum FROM r""")
_LISTS = ['Here: ["What  is it?", "what is IT?", "{w}", "Straße {w}", "STRASSE {w}"] ok', '[1] ["A?"]', '["a", 3, null, true, {{"x": "y"}}, ["q"], " {w} "]', '["{w}"', "none", '["{w}",]', '["' + "x" * 201 + '", "{w}\\n b"]']


def _lists(s, d):
    word = F.regexp_extract("text", r"([A-Za-z]+)", 1)
    filled = [F.replace(F.lit(x.replace("{{", "{").replace("}}", "}")), F.lit("{w}"), word) for x in _LISTS]
    raw = F.element_at(F.array(*filled), (F.col("doc_id") % len(_LISTS) + 1).cast("int"))
    return _t(s, d, "documents").select("doc_id", F.array_join(X.parse_candidates(raw), "|").alias("questions"))


_q("q2_candidate_lists", _lists,
   """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat_ws('|', 'What is it?', CASE WHEN lower(w) NOT IN ('') THEN w END, 'Straße ' || w) WHEN 2 THEN CASE WHEN lower(w) = 'a' OR w = '' THEN 'a' ELSE 'a|' || w END WHEN 6 THEN trim(w || ' b') ELSE '' END AS questions FROM (SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS w FROM documents) x""".replace("CASE WHEN lower(w) NOT IN ('') THEN w END", "nullif(w, '')").replace("'Straße ' || w)", "trim('Straße ' || w))"))

# Turns of conversations as queries, with passages they cite
_CITED = """SELECT CAST(t.conv_id * 1000 + t.turn AS BIGINT) AS query_id, t.conv_id, CAST(t.turn AS INT) AS turn, t.text, k.k AS rank, (t.conv_id * 7 + t.turn * 13 + k.k * k.k * 31) % {n} AS chunk_id, CASE WHEN (t.turn + k.k) % 3 = 0 THEN true WHEN (t.turn + k.k) % 3 = 1 THEN false END AS quoted FROM {conversations} t JOIN {k} k ON true"""


def _conversation(s, d):
    c = s.sql(_CITED.replace("{n}", "{m}").format(m=500, conversations="{conversations}", k="{k}"), conversations=_t(s, d, "conversations"), k=s.range(1, 7).selectExpr("cast(id as int) as k"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("newest"))
    c = c.join(last, "conv_id").withColumn("recency", F.col("newest") - F.col("turn")).filter("recency < 4")
    queries = c.select("query_id", "conv_id", "recency", F.when(F.col("query_id") % 3 > 0, F.concat("text", F.lit(" [2] and ["), (F.col("query_id") % 6).cast("string"), F.lit("]"))).alias("answer"), F.concat(F.lit("a \t b"), "text").alias("question")).distinct()
    return c.select("query_id", "rank", "chunk_id", "quoted"), queries


_ASKER = "SELECT conv_id, conv_id % 3 AS collection, CASE conv_id % 5 WHEN 0 THEN 'employee' WHEN 1 THEN 'manager' WHEN 2 THEN 'hr' WHEN 3 THEN 'finance' ELSE 'leadership' END AS role FROM {conversations}"


def _fitted(s, d):
    citations, queries = _conversation(s, d)
    askers = s.sql(f"SELECT DISTINCT * FROM ({_ASKER})", conversations=_t(s, d, "conversations"))
    docs = _t(s, d, "documents")
    chunks = view(s, d, "passages").select("chunk_id", F.col("chunk_id").alias("document_id"), "access_label", "filename", F.concat("section_path", F.lit(" of  it")).alias("section"))
    docs = docs.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 3).alias("collection"), F.when(F.col("doc_id") % 10 == 0, "failed").otherwise("ready").alias("status"))
    refs = H.authorised_citations(citations, queries.select("query_id", "conv_id", "recency", "answer"), chunks, docs, askers, view(s, d, "role_labels"))
    return H.fit_context(queries.select("conv_id", "query_id", "recency", "question"), refs, 90).select("conv_id", "turns", F.array_join(F.transform("references", lambda x: x.cast("string")), ",").alias("references"))


_CONV = f"""c0 AS ({_CITED.format(n=500, conversations='conversations', k='(SELECT CAST(unnest(range(1, 7)) AS INT) AS k)')}),
c AS (SELECT * FROM (SELECT c0.*, max(turn) OVER (PARTITION BY conv_id) - turn AS recency FROM c0) x WHERE recency < 4),
q AS (SELECT DISTINCT query_id, conv_id, recency, CASE WHEN query_id % 3 > 0 THEN text || ' [2] and [' || query_id % 6 || ']' END AS answer, 'a ' || chr(9) || ' b' || text AS question FROM c)"""
_WS = "len(regexp_extract_all({0}, '[ \\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+'))"
_q("h8_fitted_context", _fitted,
   f"""WITH RECURSIVE {_CONV}, ask AS (SELECT DISTINCT * FROM ({_ASKER.format(conversations='conversations')}) x),
t AS (SELECT *, sum({_WS.format('question')}) OVER (PARTITION BY conv_id ORDER BY recency) AS b FROM q),
k AS (SELECT * FROM t WHERE greatest(1, round_even((b + 1) * 1.3, 0)) <= 90), h AS (SELECT conv_id, count(*) AS turns, max(b) AS b FROM k GROUP BY 1),
r AS (SELECT c.conv_id, c.chunk_id, k.recency, c.rank, {_WS.format('filename')} + coalesce({_WS.format("section_path || ' of  it'")}, 0) AS n, coalesce(quoted, false) OR contains(coalesce(answer, ''), '[' || rank || ']') AS cited
  FROM c JOIN k ON k.query_id = c.query_id JOIN ask a ON a.conv_id = c.conv_id JOIN passages p ON p.chunk_id = c.chunk_id JOIN role_labels l ON l.role = a.role AND l.label = p.access_label WHERE c.chunk_id % 3 = a.collection AND c.chunk_id % 10 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY NOT cited, recency, rank, chunk_id) AS m FROM r),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS m, CAST(b AS BIGINT) AS b, CAST([] AS BIGINT[]) AS kept FROM h
 UNION ALL SELECT conv_id, m, CASE WHEN fits THEN b + n ELSE b END, CASE WHEN fits THEN list_append(kept, chunk_id) ELSE kept END FROM (SELECT f.conv_id, o.m, f.b, o.n, kept, chunk_id, len(kept) < 6 AND NOT list_contains(kept, chunk_id) AND greatest(1, round_even((f.b + n + 1) * 1.3, 0)) <= 90 AS fits FROM f JOIN o ON o.conv_id = f.conv_id AND o.m = f.m + 1) x)
SELECT u.conv_id, CAST(coalesce(turns, 0) AS INT) AS turns, coalesce(array_to_string(arg_max(kept, m), ','), '') AS "references" FROM (SELECT DISTINCT conv_id FROM q) u LEFT JOIN h USING (conv_id) LEFT JOIN f USING (conv_id) GROUP BY 1, 2""", "passages", "role_labels")


def _history(s, d):
    citations, queries = _conversation(s, d)
    q = queries.select("query_id", "answer", (F.col("query_id") % 4 == 0).alias("refused"), F.when(F.col("query_id") % 8 > 3, "m").alias("model"), (F.col("query_id") % 3).alias("completion_tokens"), F.when(F.col("query_id") % 5 > 1, "answered").alias("outcome"), F.when(F.col("query_id") % 7 == 0, "because").alias("outcome_reason"))
    given = F.when(F.col("quoted"), F.array(F.struct(F.lit(2).alias("start"), F.lit(9).alias("end")), F.struct(F.lit(11).alias("start"), F.lit(15).alias("end")))).when(~F.col("quoted"), F.array().cast("array<struct<start:int,end:int>>"))
    c = citations.select("query_id", "rank", "chunk_id", (F.col("rank") / 8).alias("score"), given.alias("quotes"))
    chunks = view(s, d, "passages").select("chunk_id", F.col("chunk_id").alias("document_id"), "filename", "section_path", "page_start", "page_end", "content", "access_label", F.lit(0).alias("chunk_index"))
    return H.history(q, c, chunks)


def _history_rows(s, d):
    """Sources as text; spans of citations without quotes are told by whether there are any, since SQL has no G9."""
    kept = lambda x: F.concat_ws("~", x["n"].cast("string"), x["filename"], F.coalesce(F.array_join(F.transform(x["pages"], lambda p: p.cast("string")), "-"), F.lit("none")), F.coalesce(x["section"], F.lit("none")), F.sha2(x["snippet"], 256), x["score"].cast("string"), x["access_label"], F.when(x["quotes"].isNull(), "no").when(x["content"].isNull(), "bad").otherwise("yes"))
    return _history(s, d).select("query_id", "refused", "reason", "outcome", F.array_join(F.transform("sources", kept), "\n").alias("sources"), F.aggregate("sources", F.lit(0), lambda a, x: a + F.size(F.filter(F.coalesce(x["quotes"], F.array().cast("array<struct<start:int,end:int,text:string>>")), lambda y: (F.length(y["text"]) == y["end"] - y["start"]) & (y["start"] == 2) & (y["end"] == 9)))).alias("given"))


_q("h10_nested_history", _history_rows,
   f"""WITH {_CONV}, s AS (SELECT c.query_id, concat_ws('~', rank, filename, coalesce(array_to_string(CASE WHEN page_start IS NOT NULL THEN [page_start, coalesce(page_end, page_start)] END, '-'), 'none'), coalesce(section_path, 'none'), sha256(left(content, 300)), CAST(rank / 8 AS VARCHAR), access_label,
   CASE WHEN quoted IS NOT NULL OR contains(coalesce(answer, ''), '[' || rank || ']') THEN 'yes' ELSE 'no' END) AS x, rank, quoted AND length(content) >= 9 AS given FROM c JOIN q USING (query_id) JOIN passages p ON p.chunk_id = c.chunk_id)
 SELECT q.query_id, q.query_id % 4 = 0 AS refused, CASE WHEN q.query_id % 7 = 0 THEN 'because' WHEN q.query_id % 4 = 0 THEN CASE WHEN q.query_id % 8 > 3 AND q.query_id % 3 > 0 THEN 'empty_completion' ELSE 'not_in_documents' END END AS reason, CASE WHEN q.query_id % 5 > 1 THEN 'answered' ELSE 'legacy_unknown' END AS outcome,
   coalesce(string_agg(x, chr(10) ORDER BY rank), '') AS sources, CAST(coalesce(sum(CASE WHEN given THEN 1 ELSE 0 END), 0) AS INT) AS given FROM q LEFT JOIN s ON s.query_id = q.query_id GROUP BY 1""", "passages")
