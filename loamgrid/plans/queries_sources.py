"""Queries of page layout, block trees, syncs and sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import documents as D
from loamgrid.operators import layout as L
from loamgrid.operators import sync as Y
from loamgrid.plans.session import Scratch
from loamgrid.plans.views import view, with_views
from loamgrid.sources.sinks import BucketedTable, append_log, export_csv, export_json, markdown_report

Q: dict = {}
O: dict = {}


def _q(name, fn, sql=None):
    Q[name] = fn
    if sql:
        O[name] = sql


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


# Lines of documents as lines of pages: forty a page, printed in an order of their own.
def _printed(s, d):
    x = D.lines_of(_t(s, d, "documents"))
    return x.select(
        "doc_id", F.floor(F.col("pos") / 40).cast("int").alias("page"), "pos", (F.col("pos") * 7 % 41 + F.col("pos") % 3 * 0.02).alias("y"), (F.col("pos") % 2 * 1.0).alias("x"), F.floor(F.col("pos") / 3).cast("int").alias("block"),
        (F.length("line") % 13 + F.col("doc_id") % 3 / 4 + 6).cast("double").alias("size"), ((F.col("pos") + F.col("doc_id")) % 9 == 0).alias("bold"), F.when(F.col("pos") % 17 == 4, F.lit("  ")).otherwise(F.concat(F.lit(" "), "line")).alias("text"),
    )


_SPLIT = "SELECT doc_id, source, lang, n_chars, unnest(l) AS line, CAST(unnest(range(len(l))) AS INT) AS pos FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) a"
_PRINTED = f"""lines AS (SELECT doc_id, pos // 40 AS page, pos, round(pos * 7 % 41 + pos % 3 * 0.02, 1) AS y, pos % 2 AS x, pos // 3 AS block, CAST(length(line) % 13 + doc_id % 3 / 4 + 6 AS DOUBLE) AS size,
  (pos + doc_id) % 9 = 0 AS bold, trim(line) AS text FROM ({_SPLIT}) l WHERE pos % 17 <> 4 AND trim(line) <> ''),
marked AS (SELECT l.*, size > m * 1.15 OR (bold AND length(text) < 80 AND NOT regexp_matches(text, '[.,;:]$')) AS h FROM lines l JOIN (SELECT doc_id, page, median(size) AS m FROM lines GROUP BY 1, 2) m USING (doc_id, page))"""


def _levels(rows: str, size: str, ratio: float) -> str:
    """Heads of levels, each the largest size that is small enough against the one before."""
    return f"""sizes AS (SELECT DISTINCT doc_id, round({size}, 1) AS z FROM {rows} WHERE h),
heads AS (SELECT doc_id, max(z) AS z FROM sizes GROUP BY 1 UNION ALL SELECT s.doc_id, max(s.z) FROM heads h JOIN sizes s ON s.doc_id = h.doc_id AND s.z < h.z * {ratio} GROUP BY 1, h.z),
levels AS (SELECT s.doc_id, s.z, least(3, count(*))::INT AS level FROM sizes s JOIN heads h ON h.doc_id = s.doc_id AND h.z >= s.z GROUP BY 1, 2)"""


_q("s8_heading_sizes", lambda s, d: (lambda x: L._levels_of(x.join(D.layout_headings(x), ["doc_id", "page", "pos"]).filter("is_heading"), "size", 0.92))(_printed(s, d).withColumn("text", F.trim("text")).filter("text <> ''")).select("doc_id", "size", "level"),
   f"WITH RECURSIVE {_PRINTED}, {_levels('marked', 'size', 0.92)} SELECT doc_id, z AS size, level FROM levels")
_q("s9_page_blocks", lambda s, d: L.page_blocks(_printed(s, d)),
   f"""WITH RECURSIVE {_PRINTED}, {_levels('marked', 'size', 0.92)},
o AS (SELECT *, row_number() OVER w AS n, lag(h) OVER w AS bh, lag(block) OVER w AS bb FROM marked WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x, pos)),
b AS (SELECT *, sum(CASE WHEN h OR bh IS NULL OR bh OR bb <> block THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY n) AS b FROM o),
g AS (SELECT doc_id, page, CAST(b AS INT) AS block, bool_or(h) AS h, round(max(size), 1) AS z, string_agg(text, ' ' ORDER BY n) AS text FROM b GROUP BY 1, 2, 3)
SELECT g.doc_id, page, block, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN h THEN level END AS level, text FROM g LEFT JOIN levels l ON l.doc_id = g.doc_id AND l.z = g.z""")
_q("s9_page_texts", lambda s, d: L.page_texts(L.page_blocks(_printed(s, d))).select("doc_id", "page", "text", F.array_join(F.transform("headings", lambda h: F.concat(h["level"].cast("string"), F.lit(" "), h["text"])), "\n").alias("headings")),
   O["s9_page_blocks"].replace("SELECT g.doc_id, page, block,", "SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY block) AS text, coalesce(string_agg(level || ' ' || text, chr(10) ORDER BY block) FILTER (kind = 'heading'), '') AS headings FROM (SELECT g.doc_id, page, block,") + ") x GROUP BY 1, 2")


# Lines as recognised blocks.
def _recognised(s, d):
    x = D.lines_of(_t(s, d, "documents"))
    return x.select(
        "doc_id", F.floor(F.col("pos") / 30).cast("int").alias("page"), F.col("pos").alias("block"), F.when(F.col("pos") % 11 != 3, (F.length("line") * 7 + F.col("doc_id")) % 11 / 2 + 5).alias("height"), (F.col("pos") % 4).alias("lines"),
        F.when(F.col("pos") % 13 == 6, F.lit(" ")).otherwise(F.col("line")).alias("text"), F.col("pos").alias("x0"), (F.col("pos") * 2).alias("y0"), (F.col("pos") + 9).alias("x1"), (F.col("pos") * 2 + 9).alias("y1"),
    )


_RECOGNISED = f"""blocks AS (SELECT doc_id, pos // 30 AS page, pos AS block, CASE WHEN pos % 11 <> 3 THEN (length(line) * 7 + doc_id) % 11 / 2 + 5 END AS height, pos % 4 AS lines, CASE WHEN pos % 13 = 6 THEN ' ' ELSE line END AS text FROM ({_SPLIT}) l),
medians AS (SELECT doc_id, page, median(height) AS m FROM (SELECT doc_id, page, height, unnest(range(greatest(length(text), 1))) FROM blocks WHERE height IS NOT NULL) x GROUP BY 1, 2),
marked AS (SELECT b.* EXCLUDE (text), trim(text) AS text, coalesce(m > 0 AND height > m * 1.25 AND length(trim(text)) < 80 AND lines <= 2 AND NOT regexp_matches(trim(text), '[.,;:]$'), false) AS h FROM blocks b LEFT JOIN medians USING (doc_id, page))"""
_q("s12_recognised_blocks", lambda s, d: L.recognised_blocks(_recognised(s, d)),
   f"""WITH RECURSIVE {_RECOGNISED}, {_levels('marked', 'height', 0.9)}
SELECT m.doc_id, page, block, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN h THEN level END AS level, text FROM marked m LEFT JOIN levels l ON l.doc_id = m.doc_id AND l.z = round(height, 1) WHERE text <> ''""")
_q("s12_compact_layout", lambda s, d: L.compact_layout(_recognised(s, d), _recognised(s, d).select("doc_id", "page").distinct().withColumns({"width": F.lit(600), "height": F.lit(800)})).select("doc_id", "page", F.array_join(F.transform("size", lambda x: x.cast("string")), "x").alias("size"), F.array_join(F.transform("blocks", lambda b: F.concat(F.array_join(F.transform(b["bbox"], lambda x: x.cast("string")), ","), F.lit(" "), b["text"])), "\n").alias("blocks")),
   f"WITH RECURSIVE {_RECOGNISED} SELECT doc_id, page, '600x800' AS size, coalesce(string_agg(concat_ws(',', block, block * 2, block + 9, block * 2 + 9) || ' ' || text, chr(10) ORDER BY block) FILTER (text <> ''), '') AS blocks FROM blocks GROUP BY 1, 2")

# Lines as blocks of a tree: in every third document chains down to fourteen levels, else branches.
_TYPES = [
    "paragraph", "bulleted_list_item", "numbered_list_item", "to_do", "heading_1", "numbered_list_item", "quote", "callout", "toggle", "column_list", "bulleted_list_item", "code", "equation", "divider", "table", "child_page", "paragraph",
    "bookmark", "image", "link_to_page", "numbered_list_item", "mystery", "heading_3", "table_row", "numbered_list_item", "child_database", "synced_block",
]


def _tree(s, d):
    x, pos, line = D.lines_of(_t(s, d, "documents")), F.col("pos"), F.col("line")
    kinds = F.array(*map(F.lit, _TYPES))
    chain, k = F.col("doc_id") % 3 == 0, pos % F.when(F.col("doc_id") % 3 == 0, 15).otherwise(6)
    parent = F.when(k == 0, None).when(chain, pos - 1).otherwise(pos - F.floor((k + 1) / 2))
    text = F.when(pos % 13 == 5, "").when(pos % 7 == 2, F.concat(line, F.lit("\n\n x\n"))).otherwise(line)
    kind = F.when(chain & (pos % 4 > 0), F.element_at(F.array(F.lit("bulleted_list_item"), F.lit("paragraph"), F.lit("numbered_list_item")), (pos % 4).cast("int"))).otherwise(F.element_at(kinds, ((pos * 11 + F.col("doc_id") * 3) % len(_TYPES) + 1).cast("int")))
    return x.select(
        F.col("doc_id").alias("page_id"), pos.alias("block_id"), parent.cast("int").alias("parent_id"), (-pos).alias("ord"), kind.alias("type"), text.alias("text"), (pos % 2 == 0).alias("checked"), F.when(pos % 2 == 0, "sql").alias("language"), F.left(line, F.lit(9)).alias("expression"), F.when(pos % 3 > 0, F.left(line, F.lit(12))).alias("title"),
        F.when(pos % 5 > 0, F.concat(F.lit("u"), pos.cast("string"))).alias("url"), F.when(pos % 2 == 1, "cap").alias("caption"), F.when(pos % 3 == 1, "name").alias("name"), (pos % 2 == 0).alias("has_header"), F.slice(F.array(F.left(line, F.lit(5)), F.lit("a|b\nc"), F.lit("z")), F.lit(1), (pos % 4).cast("int")).alias("cells"),
    )


def _tree_pages(s, d):
    prop = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    return _t(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 9 > 0, F.col("source")).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.array(prop("lang", F.col("lang")), prop("none", F.lit(None)), prop("n", F.col("n_chars")))).alias("properties"))


_INDENTED = r"array_to_string(list_transform({lines}, lambda y: {pad} || y), chr(10))"
_OWN_LINES = r"(CASE WHEN {t}[-1] = chr(10) THEN string_split({t}[:-2], chr(10)) ELSE string_split({t}, chr(10)) END)"
_q("s15_block_markdown", lambda s, d: L.block_tree_markdown(_tree_pages(s, d), _tree(s, d)),
   f"""WITH RECURSIVE b0 AS (SELECT doc_id AS page, pos, line, pos % (CASE WHEN doc_id % 3 = 0 THEN 15 ELSE 6 END) AS k FROM ({_SPLIT}) l),
b1 AS (SELECT page, pos AS id, line, CASE WHEN k = 0 THEN NULL WHEN page % 3 = 0 THEN pos - 1 ELSE pos - (k + 1) // 2 END AS parent, CASE WHEN page % 3 = 0 AND pos % 4 > 0 THEN ['bulleted_list_item', 'paragraph', 'numbered_list_item'][pos % 4] ELSE {_TYPES}[(pos * 11 + page * 3) % {len(_TYPES)} + 1] END AS type,
  CASE WHEN pos % 13 = 5 THEN '' WHEN pos % 7 = 2 THEN line || chr(10) || chr(10) || ' x' || chr(10) ELSE line END AS text FROM b0),
b2 AS (SELECT *, type IN ('bulleted_list_item', 'numbered_list_item', 'to_do') AS isl, row_number() OVER w AS i, sum(CASE WHEN type IN ('bulleted_list_item', 'numbered_list_item', 'to_do') THEN 0 ELSE 1 END) OVER w AS run,
  sum(CASE WHEN type IN ('numbered_list_item', 'to_do') THEN 0 ELSE 1 END) OVER w AS cnt FROM b1 WINDOW w AS (PARTITION BY page, parent ORDER BY -id)),
b3 AS (SELECT *, min(i) FILTER (isl) OVER (PARTITION BY page, parent, run) AS fst, count(*) FILTER (type = 'numbered_list_item') OVER (PARTITION BY page, parent, cnt ORDER BY i) AS num FROM b2),
cells AS (SELECT page, parent AS id, max(w) AS width, list({{'i': i, 'c': c}} ORDER BY i) AS r FROM (SELECT *, list_slice([replace(left(line, 5), '|', chr(92) || '|'), 'a' || chr(92) || '|b c', 'z'], 1, id % 4) AS c, id % 4 AS w FROM b3) x GROUP BY 1, 2),
tables AS (SELECT page, id, array_to_string(list_transform(CASE WHEN id % 2 = 0 THEN [r[1]['c']] ELSE [[]] END || [NULL] || list_transform(CASE WHEN id % 2 = 0 THEN r[2:] ELSE r END, lambda x: x['c']),
  lambda c: CASE WHEN c IS NULL THEN '| ' || array_to_string(list_transform(range(width), lambda x: '---'), ' | ') || ' |' ELSE '| ' || array_to_string(list_resize(c, width, ''), ' | ') || ' |' END), chr(10)) AS t FROM cells),
b4 AS (SELECT b.*, nullif(text, '') AS said, CASE WHEN id % 2 = 1 THEN 'cap' END AS caption, CASE WHEN id % 3 = 1 THEN 'name' END AS name, CASE WHEN id % 5 > 0 THEN 'u' || id END AS url, coalesce(CASE WHEN id % 3 > 0 THEN nullif(left(line, 12), '') END, 'Untitled') AS title, t FROM b3 b LEFT JOIN tables USING (page, id)),
b5 AS (SELECT *, CASE WHEN isl THEN rtrim(CASE type WHEN 'numbered_list_item' THEN num || '.' WHEN 'to_do' THEN CASE WHEN id % 2 = 0 THEN '- [x]' ELSE '- [ ]' END ELSE '-' END || ' ' || text, ' ' || chr(10))
  WHEN type = 'heading_1' THEN '## ' || said WHEN type = 'heading_3' THEN '#### ' || said WHEN type = 'quote' AND said IS NOT NULL THEN {_INDENTED.format(lines=_OWN_LINES.format(t='text'), pad="'> '")} WHEN type = 'quote' THEN NULL
  WHEN type = 'toggle' THEN '**' || said || '**' WHEN type = 'code' THEN '```' || CASE WHEN id % 2 = 0 THEN 'sql' ELSE '' END || chr(10) || text || chr(10) || '```' WHEN type = 'equation' THEN '$$ ' || nullif(left(line, 9), '') || ' $$' WHEN type = 'divider' THEN '---'
  WHEN type = 'table' THEN t WHEN type = 'child_page' THEN 'Sub-page: ' || title WHEN type = 'child_database' THEN 'Database: ' || title WHEN type = 'bookmark' THEN '[' || coalesce(caption, url) || '](' || url || ')' WHEN type = 'image' THEN '[image: ' || coalesce(caption, name) || ']'
  WHEN type IN ('link_to_page', 'column_list', 'synced_block') THEN NULL ELSE said END AS own,
  type NOT IN ('code', 'equation', 'divider', 'table', 'child_page', 'child_database', 'bookmark', 'image', 'link_to_page') AND NOT (type = 'quote' AND text = '') AS opn FROM b4),
tree AS (SELECT page, id, isl, own, opn, [i] AS path, [CASE WHEN isl THEN fst ELSE i END] AS part, 0 AS ind, 0 AS depth FROM b5 WHERE parent IS NULL
  UNION ALL SELECT b.page, b.id, b.isl, b.own, b.opn, list_append(t.path, b.i), CASE WHEN t.ind + t.isl::INT > 0 THEN t.part ELSE list_append(t.path, CASE WHEN b.isl THEN b.fst ELSE b.i END) END, t.ind + t.isl::INT, t.depth + 1 FROM tree t JOIN b5 b ON b.page = t.page AND b.parent = t.id WHERE t.opn AND t.depth < 8),
shown AS (SELECT page, path, part, CASE WHEN ind = 0 THEN own ELSE {_INDENTED.format(lines=_OWN_LINES.format(t='own'), pad="repeat('  ', ind)")} END AS line FROM tree WHERE own IS NOT NULL AND (ind = 0 OR own <> '')),
parts AS (SELECT page, part, string_agg(line, chr(10) ORDER BY path) AS x FROM shown GROUP BY 1, 2),
body AS (SELECT page, string_agg(x, chr(10) || chr(10) ORDER BY part) AS x FROM parts WHERE regexp_matches(x, '[^[:space:]]') GROUP BY 1)
SELECT doc_id AS page_id, concat_ws(chr(10) || chr(10), '# ' || CASE WHEN doc_id % 9 > 0 AND source <> '' THEN source ELSE 'Untitled' END, CASE WHEN doc_id % 2 = 0 THEN concat_ws(chr(10), '- lang: ' || nullif(lang, ''), '- n: ' || n_chars) END, x) || chr(10) AS markdown FROM documents LEFT JOIN body ON page = doc_id""")

# Heads with repeated and blank keys, comments and quotes.
_HEAD = ["---", "Title: 'A b'", "version: 1 # old", " indented: no", "# note: no", "Version: \"{lang}\"", "owner:", "doc_id: d-{id}", "no colon here", "CLASSIFICATION: {source} #no comment", "access: {lang} # last", "---"]


def _headed(s, d):
    put = lambda x: F.replace(F.replace(F.replace(F.lit(x), F.lit("{lang}"), F.col("lang")), F.lit("{id}"), F.col("doc_id").cast("string")), F.lit("{source}"), F.col("source"))
    head = F.array_join(F.array(*map(put, _HEAD)), "\n")
    return _t(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.concat(head, F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"))


_q("s2_header_blocks", lambda s, d: _headed(s, d).select("doc_id", F.array_join(D.front_matter_blocks(D.front_matter(F.col("text"))), "\n\n").alias("blocks"), F.length(D.without_front_matter(F.col("text"))).alias("n")),
   """SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN 'Doc Id: d-' || doc_id || ' · Version: ' || lang || ' · Classification: ' || source || CASE WHEN contains(source, ' #') THEN '?' ELSE '' END || chr(10) || chr(10) || 'Access: ' || lang ELSE '' END AS blocks, length(text) AS n FROM documents"""
   .replace("' · Classification: ' || source || CASE WHEN contains(source, ' #') THEN '?' ELSE '' END", "' · Classification: ' || source"))


# Pages of four sources of two tenants, one of them with a quota. Some items repeat a text of the listing, of an upload, or of a document that a later or earlier item updates.
def _sync_tables(s, d):
    p = _t(s, d, "pages").select("page_id", F.col("url").alias("external_id"), F.coalesce("html", F.lit("")).alias("html"))
    source = (F.floor(F.col("page_id") / 10) % 4).alias("source_id")
    other = p.select((F.col("page_id") + 1).alias("page_id"), F.col("html").alias("before"))
    text = F.when(F.col("page_id") % 6 == 1, F.concat(F.lit("copy "), (F.col("page_id") % 11).cast("string"))).when(F.col("page_id") % 10 == 1, F.col("before")).when(F.col("page_id") % 13 == 5, F.repeat(F.lit("y"), 30000)).otherwise(F.col("html"))
    broken = F.col("page_id") % 17 == 3
    listed = p.join(other, "page_id", "left").filter("page_id % 5 <> 2").select(source, "page_id", "external_id", F.when(F.col("page_id") % 4 == 0, 1).otherwise(2).alias("version"), F.concat(F.lit("Page/"), F.col("page_id").cast("string")).alias("title"), F.when(~broken, text).alias("text"), F.when(broken, "broken").alias("error"))
    listed = listed.select("source_id", (1000000 - F.col("page_id")).alias("pos"), "external_id", "version", "title", "text", "error")
    existing = p.filter("page_id % 3 <> 0").select(source, "external_id", F.col("page_id").alias("document_id"), F.when(F.col("page_id") % 2 == 0, 1).otherwise(0).alias("version"), F.sha2(F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"))).when(F.col("page_id") % 22 == 10, F.lit("copy 9")).otherwise(F.col("html")), 256).alias("sha256"), F.length("html").cast("long").alias("size_bytes"))
    uploads = p.filter("page_id % 30 = 0").select((F.floor(F.col("page_id") / 10) % 4).alias("collection_id"), F.sha2("html", 256).alias("sha256"), F.lit(7).cast("long").alias("size_bytes"))
    sources = s.range(4).selectExpr("id as source_id", "id as collection_id", "id % 2 as tenant_id")
    total = p.agg(F.sum(F.length("html")).alias("n"))
    quotas = s.range(2).selectExpr("id as tenant_id").crossJoin(total).selectExpr("tenant_id", "case when tenant_id = 0 then cast(n * 0.36 as bigint) end as quota")  # one row
    return listed, existing, sources, uploads, quotas


_SYNC = """WITH RECURSIVE p AS (SELECT page_id, url AS ext, coalesce(html, '') AS html, page_id // 10 % 4 AS src FROM pages),
l AS (SELECT src, -page_id AS pos, ext, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 2 END AS v, 'Page ' || page_id AS title, page_id % 17 = 3 AS broken,
  CASE WHEN page_id % 6 = 1 THEN 'copy ' || page_id % 11 WHEN page_id % 10 = 1 THEN (SELECT html FROM p o WHERE o.page_id = p.page_id - 1) WHEN page_id % 13 = 5 THEN repeat('y', 30000) ELSE html END AS body, row_number() OVER (PARTITION BY src ORDER BY -page_id) AS n FROM p WHERE page_id % 5 <> 2),
k AS (SELECT * FROM l WHERE n <= {most}), cut AS (SELECT src FROM l GROUP BY 1 HAVING count(*) > {most}),
e AS (SELECT src, ext, page_id AS doc, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS ov, sha256(CASE WHEN page_id % 7 = 0 THEN 'x' || page_id WHEN page_id % 22 = 10 THEN 'copy 9' ELSE html END) AS osha, length(html) AS obytes FROM p WHERE page_id % 3 <> 0),
i AS (SELECT k.*, doc, osha, obytes, strlen(body) AS bytes, sha256(body) AS sha, CASE WHEN v = ov THEN 'unchanged' WHEN broken THEN 'error' WHEN strlen(body) > 20000 THEN 'too_large' WHEN sha256(body) = osha THEN 'unchanged' END AS st FROM k LEFT JOIN e ON e.src = k.src AND e.ext = k.ext),
r AS (SELECT e.* FROM e WHERE src NOT IN (SELECT src FROM cut) AND NOT EXISTS (SELECT 1 FROM k WHERE k.src = e.src AND k.ext = e.ext)),
ev AS (SELECT *, src % 2 AS tenant, row_number() OVER (PARTITION BY src % 2 ORDER BY src, pos, ext) AS m FROM (
  SELECT src, pos, ext, sha, osha, bytes, coalesce(obytes, 0) AS obytes, CASE WHEN doc IS NULL THEN 'added' ELSE 'updated' END AS kind FROM i WHERE st IS NULL
  UNION ALL SELECT src, -1000000, ext, NULL, osha, NULL, obytes, 'removed' FROM r) x),
zero AS (SELECT t AS tenant, (SELECT CAST(sum(length(html)) * 0.36 AS BIGINT) FROM p) AS quota, (SELECT sum(obytes) FROM e WHERE src % 2 = t) + coalesce((SELECT 7 * count(*) FROM p WHERE page_id % 30 = 0 AND src % 2 = t), 0) AS used,
  (SELECT list(src || ' ' || osha) FROM e WHERE src % 2 = t) || coalesce((SELECT list(src || ' ' || sha256(html)) FROM p WHERE page_id % 30 = 0 AND src % 2 = t), []) AS held FROM range(2) x(t)),
f AS (SELECT tenant, quota, CAST(used AS BIGINT) AS used, held, CAST(0 AS BIGINT) AS m, CAST('' AS VARCHAR) AS st FROM zero
  UNION ALL SELECT f.tenant, quota, CAST(CASE WHEN s = 'removed' THEN used - obytes WHEN s IN ('added', 'updated') THEN used - obytes + bytes ELSE used END AS BIGINT), CASE WHEN s = 'removed' THEN list_filter(held, lambda h: h <> src || ' ' || osha) WHEN s = 'added' THEN held || [src || ' ' || sha] WHEN s = 'updated' THEN list_filter(held, lambda h: h <> src || ' ' || osha) || [src || ' ' || sha] ELSE held END, f.m + 1, s
  FROM (SELECT f.*, ev.* EXCLUDE (tenant, m), CASE WHEN kind = 'removed' THEN 'removed' WHEN f.tenant = 0 AND used - obytes + bytes > quota THEN 'quota' WHEN list_contains(held, src || ' ' || sha) THEN 'duplicate' ELSE kind END AS s FROM f JOIN ev ON ev.tenant = f.tenant AND ev.m = f.m + 1) f),
out AS (SELECT src AS source_id, pos, ext AS external_id, coalesce(i.st, (SELECT f.st FROM f JOIN ev ON ev.tenant = f.tenant AND ev.m = f.m WHERE ev.src = i.src AND ev.ext = i.ext AND kind <> 'removed')) AS status, doc AS document_id, title || '.md' AS filename, CASE WHEN NOT broken THEN sha END AS sha256, CASE WHEN NOT broken THEN bytes END AS bytes, CASE WHEN i.st = 'error' THEN replace(title, ' ', '/') || ': broken' END AS error FROM i
  UNION ALL SELECT src, -1, ext, 'removed', doc, NULL, osha, obytes, NULL FROM r)"""
_MOST = 40
_sync = lambda s, d: Y.sync_sources(*_sync_tables(s, d), most=_MOST, max_bytes=20000)
_q("s18_sync_items", lambda s, d: _sync(s, d).select("source_id", "external_id", "status", "document_id", "filename", "sha256", "bytes", "error"),
   _SYNC.format(most=_MOST) + " SELECT source_id, external_id, status, document_id, filename, sha256, bytes, error FROM out")
_q("s18_sync_stats", lambda s, d: Y.sync_stats(_sync(s, d), s.range(5).selectExpr("id as source_id")).withColumn("errors", F.array_join("errors", "; ")),
   _SYNC.format(most=_MOST) + """, c AS (SELECT source_id, count(*) FILTER (status <> 'removed') AS listed, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed,
 count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'too_large') AS skipped_too_large, count(*) FILTER (status = 'quota') AS skipped_quota, count(*) FILTER (status = 'error') AS skipped_errors, string_agg(error, '; ' ORDER BY pos) FILTER (error IS NOT NULL) AS errors FROM out GROUP BY 1)
 SELECT x.t AS source_id, coalesce(listed, 0) AS listed, coalesce(added, 0) AS added, coalesce(updated, 0) AS updated, coalesce(unchanged, 0) AS unchanged, coalesce(removed, 0) AS removed, coalesce(duplicates, 0) AS duplicates, coalesce(skipped_too_large, 0) AS skipped_too_large, coalesce(skipped_quota, 0) AS skipped_quota,
 coalesce(skipped_errors, 0) AS skipped_errors, x.t IN (SELECT src FROM cut) AS truncated, coalesce(errors, '') AS errors FROM range(5) x(t) LEFT JOIN c ON c.source_id = x.t""")


# A table whose documents are replaced, exports read back, a log by day, a report.
def _replaced(s, d):
    x = Scratch(s, "sinks")
    lines = D.lines_of(_t(s, d, "documents"))
    table = BucketedTable(x, x.path("table"), "doc_id", 16)
    table.write(lines)
    some = lines.filter("doc_id % 10 in (3, 7)")
    table.replace(some, some.filter("doc_id % 10 = 3").withColumn("line", F.concat(F.lit("new "), "line")))
    return x.finish(table.read().select("doc_id", "pos", F.sha2("line", 256).alias("line")))


_q("s21_replaced_documents", _replaced, f"SELECT doc_id, pos, sha256(CASE WHEN doc_id % 10 = 3 THEN 'new ' || line ELSE line END) AS line FROM ({_SPLIT}) l WHERE doc_id % 10 <> 7")


def _exported(kind):
    def run(s, d):
        x = Scratch(s, "sinks")
        at = x.path(kind)
        wide = _t(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(' "q", ;\t'), "p_brand").alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("size"), F.array("p_brand", "p_type").alias("tags"))
        (export_csv if kind == "csv" else export_json)(wide, at)
        back = s.read.schema("p_partkey long, name string, size int, tags string").csv(at, header=True, escape='"') if kind == "csv" else s.read.schema("p_partkey long, name string, size int, tags array<string>").json(at).withColumn("tags", F.array_join("tags", "; "))
        return x.finish(back)

    return run


for _kind in ("csv", "json"):
    _q(f"s21_{_kind}_export", _exported(_kind), "SELECT p_partkey, concat(p_name, ' \"q\", ;', chr(9), p_brand) AS name, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS size, concat(p_brand, '; ', p_type) AS tags FROM part")


def _logged(s, d):
    x = Scratch(s, "sinks")
    log, at = view(s, d, "query_log").select("id", "created_at", "latency_ms"), x.path("log")
    append_log(log.filter("id % 2 = 0"), at)
    append_log(log.filter("id % 2 = 1"), at)
    return x.finish(s.read.parquet(at).groupBy("day").agg(F.count(F.lit(1)).alias("queries"), F.sum("latency_ms").alias("latency_ms")))


_q("s21_query_log", _logged, with_views("SELECT CAST(created_at AS DATE) AS day, count(*) AS queries, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM query_log GROUP BY 1", "query_log"))
_q("s21_metric_report", lambda s, d: markdown_report(_t(s, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents")), ["source", "lang", "documents"]),
   "SELECT '| source | lang | documents |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || coalesce(source, '') || ' | ' || coalesce(lang, '') || ' | ' || n || ' |', chr(10) ORDER BY source NULLS FIRST, lang NULLS FIRST) AS report FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) x")


# Regions, nations and customers as a workspace; every third customer stands in a block, some nations are archived, ids come in all their forms.
def _workspace(s, d, with_roots=True):
    key = lambda p, c: F.md5(F.concat(F.lit(p), F.col(c).cast("string")))
    dashed = lambda h: F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    live = F.lit(False)
    objects = _t(s, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit("page").alias("kind"), F.lit(None).cast("string").alias("parent_id"), live.alias("archived"))
    objects = objects.union(_t(s, d, "nation").select(F.upper(key("n", "n_nationkey")), F.when(F.col("n_nationkey") % 4 == 0, "database").otherwise("page"), dashed(key("r", "n_regionkey")), F.col("n_nationkey") % 7 == 3))
    objects = objects.union(_t(s, d, "customer").select(dashed(key("c", "c_custkey")), F.lit("page"), F.when(F.col("c_custkey") % 3 == 0, key("b", "c_nationkey")).when(F.col("c_custkey") % 3 == 1, key("n", "c_nationkey")).otherwise(F.lit("no id")), live))
    blocks = _t(s, d, "nation").select(key("b", "n_nationkey").alias("id"), key("n", "n_nationkey").alias("parent_id"))
    roots = s.range(1).select(F.explode(F.array(F.concat(F.lit("https://wiki.example/team/A-title-"), F.md5(F.lit("r1")), F.lit("?pvs=4#x")), F.upper(dashed(F.md5(F.lit("n3")))), F.lit("https://wiki.example/none"), F.lit("zz"))).alias("id")).filter(F.lit(with_roots))
    return objects, blocks, roots


_DASH = "{0}[1:8] || '-' || {0}[9:12] || '-' || {0}[13:16] || '-' || {0}[17:20] || '-' || {0}[21:32]"
_WS = f"""WITH n AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), h AS (
  SELECT md5('r' || r_regionkey) AS h, r_regionkey = 1 AS hit FROM region UNION ALL SELECT md5('n' || n), r = 1 FROM n WHERE n % 7 <> 3 AND n % 4 > 0
  UNION ALL SELECT md5('c' || c_custkey), c_custkey % 3 < 2 AND (c_nationkey = 3 OR (r = 1 AND n % 7 <> 3)) FROM customer JOIN n ON n = c_nationkey)"""
_q("s17_pages_in_scope", lambda s, d: Y.pages_in_scope(*_workspace(s, d)), f"{_WS} SELECT {_DASH.format('h')} AS id FROM h WHERE hit")
_q("s17_pages_without_roots", lambda s, d: Y.pages_in_scope(*_workspace(s, d, False)), f"{_WS} SELECT {_DASH.format('h')} AS id FROM h")
