"""Conversations and history (H1-H14) over tables of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.answers import resolve_quotes
from loamgrid.plans.session import Scratch


def keyset_page(rows: DataFrame, before: tuple[int, int], limit: int) -> DataFrame:
    """H1: rows strictly before a (time, id) cursor, newest first, and whether more follow."""
    t, i = before
    page = rows.filter((F.col("created_at") < t) | ((F.col("created_at") == t) & (F.col("id") < i))).orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))  # limit + 1 rows at most
    return page.select("id", "created_at", n.alias("n"), (F.count(F.lit(1)).over(Window.partitionBy()) > limit).alias("has_more")).filter(F.col("n") <= limit).drop("n")


def latest_turn(turns: DataFrame) -> DataFrame:
    """H2: the newest row of each conversation."""
    top = turns.groupBy("conv_id").agg(F.max(F.struct("created_at", "id")).alias("t"))
    return top.select("conv_id", F.col("t.id").alias("id"), F.col("t.created_at").alias("created_at"))


def cursor(updated: Column, key: Column) -> Column:
    """H3: URL-safe base64 of a cursor, without padding."""
    text = F.concat(F.lit('{"t":'), updated.cast("string"), F.lit(',"id":'), key.cast("string"), F.lit("}"))
    return F.regexp_replace(F.translate(F.base64(text.cast("binary")), "+/", "-_"), "=+$", "")


def decode_cursor(value: Column) -> Column:
    """H3: the cursor's JSON text; null if it is no base64."""
    padded = F.concat(F.translate(value, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(value), F.lit(4))))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def parent_chain(turns: DataFrame, depth: int = 4) -> DataFrame:
    """H4: each turn with up to ``depth`` turns before it along parent ids; a reset ends the walk."""
    step = turns.select(F.col("id").alias("leaf"), F.col("id").alias("at"), "parent_id", "context_reset", F.lit(0).alias("hop"))
    up = turns.select(F.col("id").alias("at"), F.col("parent_id").alias("next"), F.col("context_reset").alias("reset"))
    out, last = None, step
    for hop in range(1, depth + 1):
        last = last.filter("not context_reset").select("leaf", F.col("parent_id").alias("at")).join(up, "at").select("leaf", "at", F.col("next").alias("parent_id"), F.col("reset").alias("context_reset"), F.lit(hop).alias("hop"))
        out = last if out is None else out.unionByName(last)
    return out.select("leaf", F.col("at").alias("ancestor"), "hop")


def snapshot_reset(turns: DataFrame, depth: int = 4) -> DataFrame:
    """H5: a turn loses its context if any turn of its chain saw another generation."""
    bad = turns.select(F.col("id").alias("ancestor"), (F.col("generation") != F.col("seen_generation")).alias("bad"))
    return parent_chain(turns, depth).join(bad, "ancestor").groupBy("leaf").agg(F.bool_or("bad").alias("reset"), F.count(F.lit(1)).alias("chain"))


def access_fingerprint(role_labels: DataFrame) -> DataFrame:
    """H6: SHA-256 of the canonical JSON of a role and its sorted labels."""
    labels = F.array_join(F.transform(F.array_sort(F.collect_set("label")), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")
    return role_labels.groupBy("role").agg(labels.alias("l")).select("role", F.sha2(F.concat(F.lit('["'), "role", F.lit('",['), "l", F.lit("]]")), 256).alias("fingerprint"))


def budgeted_turns(turns: DataFrame, budget: int) -> DataFrame:
    """H7: the newest turns of a conversation whose tokens, counted backwards, stay in the budget."""
    tokens = F.greatest(F.lit(1), F.bround(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) * 1.3)).cast("long")
    by = Window.partitionBy("conv_id").orderBy(F.desc("created_at")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("tokens", tokens).withColumn("total", F.sum("tokens").over(by)).filter(F.col("total") <= budget).select("id", "conv_id", "total")


def reference_selection(cited: DataFrame, limit: int = 6) -> DataFrame:
    """H8: references of a query, cited ones first, then newest and best rank; each chunk once."""
    first = cited.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("list_no", "rank"))).filter("n = 1")
    pick = F.row_number().over(Window.partitionBy("query_id").orderBy("list_no", "rank", "chunk_id"))
    return first.withColumn("pick", pick).filter(F.col("pick") <= limit).select("query_id", "chunk_id", "pick")


def follow_up(raw: Column) -> Column:
    """H9: ``search``/``clarify`` decision from strict JSON: (action, text); anything else asks to clarify."""
    keys = F.array_sort(F.json_object_keys(raw))
    action = F.get_json_object(raw, "$.action")
    once = (F.regexp_count(raw, F.lit('"action"\\s*:')) == 1) & (F.regexp_count(raw, F.lit('"(effective_question|question)"\\s*:')) == 1)
    search, ask = F.get_json_object(raw, "$.effective_question"), F.get_json_object(raw, "$.question")
    return (
        F.when((action == "search") & once & (keys == F.array(F.lit("action"), F.lit("effective_question"))) & (F.trim(search) != ""), F.struct(F.lit("search").alias("action"), F.trim(search).alias("text")))
        .when((action == "clarify") & once & (keys == F.array(F.lit("action"), F.lit("question"))) & (F.trim(ask) != ""), F.struct(F.lit("clarify").alias("action"), F.trim(ask).alias("text")))
        .otherwise(F.struct(F.lit("clarify").alias("action"), F.lit(None).cast("string").alias("text")))
    )


def history_with_sources(queries: DataFrame, cited: DataFrame) -> DataFrame:
    """Queries with their sources nested in order of rank; none is an empty list."""
    lists = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("sources"))
    chunks = F.coalesce(F.transform("sources", lambda x: x["chunk_id"].cast("string")), F.array().cast("array<string>"))
    return queries.join(lists, "query_id", "left").select("query_id", F.array_join(chunks, ",").alias("sources"))


def transfer_ownership(turns: DataFrame, claims: DataFrame) -> DataFrame:
    """Conversations of guests that a user claims move to that user."""
    return turns.join(claims.hint("merge"), "conv_id", "left").select("id", F.coalesce("claimed_by", "user_id").alias("user_id"))


def backfill(turns: DataFrame) -> DataFrame:
    """One conversation per collection and user, with the span of its turns."""
    return turns.groupBy("collection_id", "user_id").agg(F.min("id").alias("conversation_id"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("turns"))


def upgrade_questions(questions: Column, role: str = "employee") -> Column:
    """A list of texts becomes a list of (question, min_role)."""
    return F.transform(questions, lambda q: F.struct(q.alias("question"), F.lit(role).alias("min_role")))


def downgrade_questions(questions: Column) -> Column:
    """H13, reversed."""
    return F.transform(questions, lambda q: q["question"])


def constraint_audit(turns: DataFrame) -> DataFrame:
    """Violations of row constraints by rule."""
    rules = {"role_domain": ~F.col("role").isin("user", "assistant", "system"), "text_length": (F.length("text") < 1) | (F.length("text") > 400), "root_has_parent": (F.col("created_at") == 0) & F.col("parent_id").isNotNull()}
    flagged = turns.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    return flagged.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))


def _breaks(text: Column) -> Column:
    """Runs of white space in a text as JSON writes it: line ends and tabs are escaped and separate no words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)[\s&&[^\x00-\x1f]]+")).cast("int")


def _tokens(breaks: Column) -> Column:
    """C1 of a whole payload, whose words are those of its texts and one."""
    return F.greatest(F.lit(1), F.bround((breaks + 1) * F.lit(1.3))).cast("int")


def authorised_citations(citations: DataFrame, queries: DataFrame, chunks: DataFrame, docs: DataFrame, askers: DataFrame, role_labels: DataFrame) -> DataFrame:
    """H8: citations whose chunk the asker may still see, in a ready document of the conversation's collection.

    ``citations(query_id, rank, chunk_id, quoted)``, ``queries(query_id, conv_id, recency, answer)``,
    ``askers(conv_id, collection, role)``. A chunk counts as cited with a quote, or where the answer names it.
    """
    may = role_labels.select("role", F.col("label").alias("access_label"))
    x = citations.join(queries, "query_id").join(askers, "conv_id").join(chunks, "chunk_id").join(F.broadcast(may), ["role", "access_label"])  # five roles
    x = x.join(docs.filter("status = 'ready'"), ["document_id", "collection"])
    named = F.contains(F.coalesce("answer", F.lit("")), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")))
    return x.withColumn("cited", F.coalesce("quoted", F.lit(False)) | named)


def fit_context(turns: DataFrame, references: DataFrame, budget: int, most: int = 6) -> DataFrame:
    """H7, H8: (conv_id, turns, references): how many of the newest questions fit, and the chunks that fit beside them.

    ``turns(conv_id, query_id, recency, question)``, newest first from 0; ``references(conv_id, query_id,
    recency, rank, cited, chunk_id, filename, section)``. Questions count as a prefix; then references
    of these questions come in turn, cited ones first, then by recency and rank: each chunk once, ``most``
    at most, and one that is too large is passed over. Tokens are those of all that is sent, as one text.
    """
    by = Window.partitionBy("conv_id").orderBy("recency").rowsBetween(Window.unboundedPreceding, 0)
    t = turns.withColumn("b", F.sum(_breaks(F.col("question"))).over(by)).filter(_tokens(F.col("b")) <= budget)
    held = t.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("turns"), F.max("b").cast("int").alias("b"))
    r = references.join(t.select("conv_id", "query_id"), ["conv_id", "query_id"]).select("conv_id", F.struct((~F.col("cited")).alias("late"), "recency", "rank", "chunk_id", (_breaks(F.col("filename")) + _breaks(F.col("section"))).alias("n")).alias("r"))
    lists = r.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("refs"))  # a few questions' citations

    def step(s: Column, x: Column) -> Column:
        fits = (F.size(s["keep"]) < most) & ~F.array_contains(s["keep"], x["chunk_id"]) & (_tokens(s["b"] + x["n"]) <= budget)
        return F.when(fits, F.struct((s["b"] + x["n"]).alias("b"), F.concat(s["keep"], F.array(x["chunk_id"])).alias("keep"))).otherwise(s)

    none = F.array().cast("array<bigint>")
    kept = F.aggregate(F.coalesce("refs", F.array().cast(lists.schema["refs"].dataType)), F.struct("b", none.alias("keep")), step)["keep"]
    out = turns.select("conv_id").distinct().join(held, "conv_id", "left").join(lists, "conv_id", "left")
    return out.select("conv_id", F.coalesce("turns", F.lit(0)).alias("turns"), F.when(F.col("turns").isNull(), none).otherwise(kept).alias("references"))


def history(queries: DataFrame, citations: DataFrame, chunks: DataFrame, snippet: int = 300) -> DataFrame:
    """Queries with their outcome, why they were refused, and their sources nested by rank.

    ``queries(query_id, answer, refused, model, completion_tokens, outcome, outcome_reason)``,
    ``citations(query_id, rank, chunk_id, score, quotes)``, ``chunks(chunk_id, document_id, filename,
    section_path, page_start, page_end, content, access_label, chunk_index)``. A citation from before quotes
    were kept has null; where the answer names it, the sentences that fit its claims stand for them (G11).
    """
    # Of the chunks only the cited ones are kept. Citations meet their texts last, so a text goes to a query once at most.
    chunks = Scratch(queries.sparkSession, "history").keep(chunks.join(citations.select("chunk_id").distinct(), "chunk_id", "left_semi"), "cited")
    named = F.contains(F.coalesce("answer", F.lit("")), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")))
    c = citations.join(queries.select("query_id", "answer"), "query_id").withColumn("named", named)
    old = c.filter(F.col("quotes").isNull() & F.col("named")).join(chunks.select("chunk_id", "content"), "chunk_id")
    spans = resolve_quotes(old.select(F.col("query_id").alias("key"), F.col("answer").alias("body"), F.lit("").alias("quotes")).distinct(), old.select(F.col("query_id").alias("key"), F.col("rank").alias("n"), "content"))
    spans = spans.groupBy(F.col("key").alias("query_id"), F.col("n").alias("rank")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    derived = spans.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "spans"))).alias("derived"))  # a few citations of a query
    none = F.array().cast("array<struct<start:int,end:int>>")
    marks = F.coalesce("quotes", F.when(F.col("named"), F.coalesce(F.try_element_at("derived", F.col("rank")), none)))
    c = c.join(derived, "query_id", "left").withColumn("marks", marks).drop("answer", "named", "quotes", "derived").join(chunks, "chunk_id")
    pages = F.when(F.col("page_start").isNotNull(), F.array("page_start", F.coalesce("page_end", "page_start")))
    shown = F.when(F.col("marks").isNotNull(), F.col("content")).otherwise(F.left("content", F.lit(snippet)))
    part = F.struct(F.col("rank").alias("n"), "document_id", "filename", pages.alias("pages"), F.col("section_path").alias("section"), shown.alias("shown"), "score", "access_label", "chunk_id", "chunk_index", "marks")

    def source(x: Column) -> Column:
        quotes = F.transform(x["marks"], lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), x["shown"].substr(m["start"] + 1, m["end"] - m["start"]).alias("text")))
        kept = [x[k].alias(k) for k in ("n", "document_id", "filename", "pages", "section")]
        ids = [x[k].alias(k) for k in ("score", "access_label", "chunk_id", "chunk_index")]
        return F.struct(*kept, F.left(x["shown"], F.lit(snippet)).alias("snippet"), *ids, F.when(x["marks"].isNotNull(), x["shown"]).alias("content"), quotes.alias("quotes"))

    lists = c.select("query_id", part.alias("x")).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("x")), source).alias("sources"))
    reason = F.coalesce("outcome_reason", F.when(F.col("refused"), F.when(F.col("model").isNotNull() & (F.coalesce("completion_tokens", F.lit(0)) > 0), "empty_completion").otherwise("not_in_documents")))
    out = queries.join(lists, "query_id", "left")
    return out.select("query_id", "answer", "refused", reason.alias("reason"), F.coalesce("outcome", F.lit("legacy_unknown")).alias("outcome"), F.coalesce("sources", F.array().cast(lists.schema["sources"].dataType)).alias("sources"))
