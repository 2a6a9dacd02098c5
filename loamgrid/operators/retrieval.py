"""Retrieval over tables of questions (R1-R19): access-filtered top-k, fusion, gates and context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.documents import hard_split, token_count
from loamgrid.plans.session import Scratch

BLOCK = 1024  # rows of a block, on the average


def _top_k(k: int, keys: Callable[[np.ndarray], np.ndarray] | None = None):
    """For each Arrow row of (question ids, labels and vectors, chunk ids, labels and vectors): the best k per question.

    Vectors are read from the Arrow buffers as they are. Chunks that a role may not see are left out of its product.
    ``keys`` gives vectors a key for each of some tables; then only pairs with equal keys in one of them count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "chunk_id", "score", "access_label"]
        for batch in batches:
            for r in range(batch.num_rows):
                flat = {n: batch.column(n)[r].values for n in ("qi", "ci", "cl", "qv", "cv")}
                qi, ids = flat["qi"].to_numpy(zero_copy_only=False), flat["ci"].to_numpy(zero_copy_only=False)
                q, c = (flat[v].to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(i), -1) for v, i in (("qv", qi), ("cv", ids)))
                qk, ck = (keys(v) for v in (q, c)) if keys else (None, None)
                q, c = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (q, c))
                labels = flat["cl"]
                may = batch.column("ql")[r].as_py()
                for group in sorted({tuple(x) for x in may}):
                    mine = np.array([n for n, x in enumerate(may) if tuple(x) == group])
                    on = np.flatnonzero(pa.compute.is_in(labels, pa.array(group, pa.string())).to_numpy(zero_copy_only=False))
                    if not len(on):
                        continue
                    s = np.round(q[mine] @ c[on].T, 6)
                    if keys:
                        meet = np.zeros(s.shape, bool)
                        for a, b in zip(qk[:, mine], ck[:, on]):
                            meet |= a[:, None] == b
                        s[~meet] = -np.inf
                    least = -np.partition(-s, min(k, len(on)) - 1, axis=1)[:, min(k, len(on)) - 1]
                    for i, low in zip(range(len(mine)), least):
                        near = np.flatnonzero((s[i] >= low) & (s[i] > -np.inf))
                        best = near[np.lexsort((ids[on[near]], -s[i, near]))[:k]]
                        yield pa.record_batch([pa.array(np.full(len(best), qi[mine[i]], np.int64)), pa.array(ids[on[best]]), pa.array(s[i, best]), labels.take(pa.array(on[best]))], names=names)

    return run


def _blocks(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows packed into blocks of about ``BLOCK``, whatever their ids are."""
    n = 1 + df.count() // BLOCK
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("block")).agg(F.collect_list(F.struct(key, *columns)).alias("x"))


def _met(questions: DataFrame, chunks: DataFrame, role_labels: DataFrame, k: int, keys: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The k best chunks of a question, where every block of questions meets every block of chunks once."""
    may = role_labels.groupBy("role").agg(F.sort_array(F.collect_list("label")).alias("ql"))
    q = _blocks(questions.join(F.broadcast(may), "role").select("query_id", "ql", "embedding"), "query_id", "ql", "embedding").select(F.col("x").alias("q"))
    c = _blocks(chunks.select("chunk_id", "access_label", "embedding"), "chunk_id", "access_label", "embedding")
    both = q.join(c.repartition("block").select(F.col("x").alias("c")), how="cross").select(
        F.col("q.query_id").alias("qi"), F.col("q.ql").alias("ql"), F.flatten("q.embedding").alias("qv"), F.col("c.chunk_id").alias("ci"), F.col("c.access_label").alias("cl"), F.flatten("c.embedding").alias("cv")
    )
    part = both.mapInArrow(_top_k(k, keys), "query_id long, chunk_id long, score double, access_label string")
    return ranked(part, k)


def vector_top_k(questions: DataFrame, chunks: DataFrame, role_labels: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest chunks a role may see, by cosine, ids against ties; exact.

    Both sides are packed into blocks, and each meeting of two blocks gives at most k rows per question.
    The access filter sits below the product.
    """
    return _met(questions, chunks, role_labels, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def native_top_k(questions: DataFrame, chunks: DataFrame, role_labels: DataFrame, k: int = 10) -> DataFrame:
    """R1 as expressions, the plan that tests compare with."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = questions.join(role_labels.withColumnRenamed("label", "access_label"), "role").select("query_id", "access_label", F.col("embedding").alias("qe"))
    s = q.join(chunks.select("chunk_id", "access_label", "embedding"), "access_label")
    score = F.round(dot(F.col("qe"), F.col("embedding")) / F.sqrt(dot(F.col("qe"), F.col("qe")) * dot(F.col("embedding"), F.col("embedding"))), 6)
    return ranked(s.select("query_id", "chunk_id", score.alias("score"), "access_label"), k)


def lsh_top_k(questions: DataFrame, chunks: DataFrame, role_labels: DataFrame, k: int = 10, tables: int = 48, bits: int = 5, dim: int = 64, seed: int = 3) -> DataFrame:
    """R2: candidates that share a random-hyperplane bucket, scored exactly; labels are filtered first.

    Tables that reach recall 0.9 on vectors without clusters let most pairs share a bucket, so pairs are
    never rows: keys are made and compared where two blocks meet, and a meeting gives k rows per question.
    """
    if bits > 8:
        raise ValueError("a key has 8 bits at most")
    planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))

    def keys(v: np.ndarray) -> np.ndarray:
        on = (v @ planes > 0).reshape(len(v), tables, bits)
        return np.ascontiguousarray((on * (1 << np.arange(bits))).sum(2).T.astype(np.uint8))

    return _met(questions, chunks, role_labels, k, keys)


WORD = r"[\p{L}\p{N}\p{M}_]+"


def parse_query(text: Column) -> Column:
    """Items (grp, neg, words) of a query as people type it.

    Items of one group are all required, an ``OR`` between words begins another group, ``-`` before an
    item excludes it, and the words of a quoted item, or of one with signs inside, are a phrase. A query
    with quotes or exclusions and no ``OR`` may write it small; in a plain sentence "or" is a word.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))
    small = text.rlike(r'"|(^|\s)-\S') & ~F.array_contains(tokens, "OR")
    splits = lambda t: (t == "OR") | (small & (F.lower(t) == "or"))
    one = lambda t, i: F.struct(
        F.size(F.filter(F.slice(tokens, F.lit(1), i), splits)).alias("grp"), t.startswith("-").alias("neg"), F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)).alias("words"), splits(t).alias("mark")
    )
    items = F.filter(F.transform(tokens, one), lambda x: ~x["mark"] & (F.size(x["words"]) > 0))
    return F.array_distinct(F.transform(items, lambda x: F.struct(x["grp"].alias("grp"), x["neg"].alias("neg"), x["words"].alias("words"))))


def fulltext_top_k(queries: DataFrame, posts: DataFrame, k: int = 10, role_labels: DataFrame | None = None) -> DataFrame:
    """Chunks that fit a query (query_id, items, and role where ``role_labels`` are given), by cover density.

    ``posts(chunk_id, pos, term, access_label)`` lose all terms that no query has before anything is
    joined, and the labels a role may not see before any place is looked at. A cover is a stretch that holds
    every item of a group and no shorter one with the same left end; each adds one over one plus its
    other words. A group without a required item fits nothing. Ties go to the smaller chunk_id.
    """
    s = Scratch(posts.sparkSession, "fulltext")
    queries = s.keep(queries, "queries")
    word = queries.select("query_id", F.posexplode("items").alias("item", "i")).select("query_id", "item", F.col("i.grp").alias("grp"), F.col("i.neg").alias("neg"), F.size("i.words").alias("n"), F.posexplode("i.words").alias("k", "term"))
    posts = s.keep(posts.join(word.select("term").distinct(), "term", "left_semi"), "postings")
    held = posts.select("term", "chunk_id", *(["access_label"] if role_labels is not None else [])).distinct()
    # A chunk that fits a group holds its rarest word: only such chunks are looked at.
    often = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = word.filter("not neg").join(often, "term", "left").groupBy("query_id", "grp").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
    open_ = rare.select("query_id", "grp", F.col("r.term").alias("term")).join(held, "term")
    if role_labels is not None:
        may = queries.select("query_id", "role").join(F.broadcast(role_labels.withColumnRenamed("label", "access_label")), "role")
        open_ = open_.join(may, ["query_id", "access_label"])
    hits = open_.select("query_id", "grp", "chunk_id").join(word, ["query_id", "grp"]).join(posts.select("chunk_id", "term", "pos"), ["chunk_id", "term"])
    # Hits move once: all groups below hold these three columns.
    hits = hits.repartition("query_id", "chunk_id", "grp")
    # A phrase stands where all of its words follow each other.
    found = hits.groupBy("query_id", "chunk_id", "grp", "neg", "item", "n", (F.col("pos") - F.col("k")).alias("at")).agg(F.count_distinct("k").alias("have")).filter("have = n")
    kept = queries.select("query_id", F.explode("items").alias("i")).filter("not i.neg").groupBy("query_id", F.col("i.grp").alias("grp")).agg(F.count(F.lit(1)).alias("need"))
    one = found.groupBy("query_id", "chunk_id", "grp").agg(
        F.max("neg").alias("banned"), F.count_distinct(F.when(~F.col("neg"), F.col("item"))).alias("have"), F.sort_array(F.collect_list(F.when(~F.col("neg"), F.struct(F.col("at").alias("l"), (F.col("at") + F.col("n") - 1).alias("r"), "item", "n")))).alias("h")
    )
    fit = one.join(kept, ["query_id", "grp"]).filter("not banned and have = need")
    # Along the places of a chunk: the last place of each item; whenever the leftmost of them moves, a cover begins.
    start = F.struct(F.create_map().cast("map<int,int>").alias("last"), F.lit(-1).alias("left"), F.lit(0.0).alias("score"))
    size = F.aggregate(F.array_distinct(F.transform("h", lambda y: F.struct(y["item"].alias("item"), y["n"].alias("n")))), F.lit(0), lambda s, y: s + y["n"])

    def step(s: Column, y: Column) -> Column:
        last = F.map_concat(F.map_filter(s["last"], lambda i, _: i != y["item"]), F.create_map(y["item"], y["l"]))
        left = F.array_min(F.map_values(last))
        new = (F.size(last) == F.col("need")) & (left > s["left"])
        other = F.greatest(y["r"] - left + 1 - F.col("size"), F.lit(0))
        return F.struct(last.alias("last"), F.when(new, left).otherwise(s["left"]).alias("left"), (s["score"] + F.when(new, 1 / (1 + other)).otherwise(0.0)).alias("score"))

    # Of a single item every place is a cover without other words.
    score = F.when(F.col("need") == 1, F.size("h").cast("double")).otherwise(F.aggregate("h", start, step)["score"])
    scored = fit.withColumn("size", size).select("query_id", "chunk_id", score.alias("score"))
    total = scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score"))
    return s.finish(ranked(total, k))


def retrieve(questions: DataFrame, chunks: DataFrame, role_labels: DataFrame, threshold: float, k_vector: int = 40, k_text: int = 40, fused: int = 40, top: int = 8) -> DataFrame:
    """For every question (query_id, role, question, embedding) the passages it is answered from.

    Vector and full-text hits, each below the same access filter, are fused by rank; the ``top`` first
    keep their order (R7) with their share of the best; a question is refused without hits or with a
    best cosine under ``threshold``. ``chunks(chunk_id, access_label, content, embedding)``.
    query_id, chunk_id, rrf, fused_rank, relative, gate_score, refused; a question without hits has one row.
    """
    near, best = _fused(questions, chunks, role_labels, k_vector, k_text, fused)
    best = best.filter(F.col("fused_rank") <= top)
    first = F.first("rrf").over(Window.partitionBy("query_id").orderBy("fused_rank"))
    best = best.select("query_id", "chunk_id", "rrf", "fused_rank", F.round(F.col("rrf") / first, 9).alias("relative"))
    return refusal_gate(questions, near, threshold).join(best, "query_id", "left").select("query_id", "chunk_id", "rrf", "fused_rank", "relative", "gate_score", "refused")


def _fused(questions: DataFrame, chunks: DataFrame, role_labels: DataFrame, k_vector: int, k_text: int, fused: int) -> tuple[DataFrame, DataFrame]:
    """The vector hits of each question, and both kinds of hits fused by rank."""
    near = vector_top_k(questions, chunks, role_labels, k_vector)
    text = chunks.select("chunk_id", "access_label", F.posexplode(F.regexp_extract_all(F.lower("content"), F.lit(WORD), F.lit(0))).alias("pos", "term"))
    words = fulltext_top_k(questions.select("query_id", "role", parse_query(F.col("question")).alias("items")), text, k_text, role_labels)
    cols = ["query_id", "chunk_id", "rank", "score"]
    lists = near.select(*cols, F.lit(1).alias("list_no")).unionByName(words.select(*cols, F.lit(2).alias("list_no")))
    return near, reciprocal_rank_fusion(lists, fused)


def answer_contexts(
    questions: DataFrame, chunks: DataFrame, role_labels: DataFrame, threshold: float, scorer: Callable | None = None, top: int = 8, budget: int = 18_000, chunk_max: int = 512, k_vector: int = 100, k_text: int = 100, fused: int = 40
) -> tuple[DataFrame, DataFrame]:
    """R10 with a reranker: for every question its gate, and the numbered blocks that its prompt is made of.

    The fused hits are scored against the question (R8, or by an injected ``scorer`` of R9) and ordered
    anew, equal ones as they were fused; the best score is the gate's. Of questions that pass it the
    ``top`` first are packed within the budget (R16). (query_id, gate_score, refused) and
    (query_id, n, chunk_id, header, text, total).
    """
    s = Scratch(questions.sparkSession, "contexts")
    _, hits = _fused(questions, chunks, role_labels, k_vector, k_text, fused)
    own = ["chunk_id", "content", "filename", "section_path", "page_start", "page_end"]
    pairs = hits.select("query_id", "chunk_id", F.col("fused_rank").alias("rank")).join(questions.select("query_id", "question"), "query_id").join(chunks.select(*own), "chunk_id")
    order = s.keep(model_rerank(pairs, scorer or (lambda q, c: F.round(overlap_score(q, c), 9)), 4000).drop("question", "rank"), "reranked")
    gate = refusal_gate(questions, order.select("query_id", F.col("model_score").alias("score")), threshold)
    passed = order.filter(F.col("model_rank") <= top).join(gate.filter("not refused").select("query_id"), "query_id")
    return gate, pack_context(passed.withColumnRenamed("model_rank", "rank"), budget, chunk_max)


def reciprocal_rank_fusion(lists: DataFrame, top: int = 40, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over lists; the score of the first list is carried."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("rrf"), F.min_by("score", "list_no").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")
    return fused.withColumn("fused_rank", F.row_number().over(by)).filter(F.col("fused_rank") <= top)


def no_rerank(hits: DataFrame) -> DataFrame:
    """Order as it is, scores as shares of the first (1 where that is 0)."""
    top = F.first("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("relative", F.round(F.col("score") / F.when(top == 0, 1.0).otherwise(top), 9))


def overlap_score(question: Column, content: Column) -> Column:
    """Share of the question's words that the content has; 0 for none."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[a-zа-яёäöüß0-9]+"), F.lit(0)))
    return F.coalesce(F.size(F.array_intersect(words(question), words(content))) / F.nullif(F.size(words(question)), F.lit(0)), F.lit(0.0))


def model_rerank(pairs: DataFrame, scorer: Callable, cut: int = 1500) -> DataFrame:
    """Scores by an injected vectorised model over (question, content); null keeps the fused order."""
    scored = pairs.withColumn("model_score", scorer(F.col("question"), F.left("content", F.lit(cut))))
    by = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("model_score"), "rank")
    return scored.withColumn("model_rank", F.row_number().over(by))


def hidden_probe(questions: DataFrame, chunks: DataFrame, role_labels: DataFrame, visible: DataFrame, threshold: float, k: int = 10) -> DataFrame:
    """What a role may not see but would have ranked: passages, labels, and whether it beats the seen."""
    roles = role_labels.select("role").distinct().crossJoin(role_labels.select("label").distinct())  # roles by labels
    hidden = vector_top_k(questions, chunks, roles.join(role_labels, ["role", "label"], "left_anti"), k)
    best = visible.groupBy("query_id").agg(F.max("score").alias("best"))
    x = hidden.join(best, "query_id", "left").filter(F.col("score") >= F.greatest(F.lit(threshold), F.coalesce(F.col("best") - 0.05, F.lit(threshold))))
    return x.groupBy("query_id").agg(F.count(F.lit(1)).alias("passages"), F.array_join(F.array_sort(F.collect_set("access_label")), ",").alias("labels"), F.count_if(F.col("score") >= F.col("best")).alias("outranking"))


def resolve_roles(people: DataFrame, role_labels: DataFrame, default: str = "employee") -> DataFrame:
    """Labels of each person's role, the default for none; whether they see everything."""
    all_labels = role_labels.agg(F.count_distinct("label").alias("n"))
    have = role_labels.groupBy("role").agg(F.count_distinct("label").alias("labels"))
    return people.withColumn("role", F.coalesce("role", F.lit(default))).join(F.broadcast(have), "role", "left").crossJoin(F.broadcast(all_labels)).select("id", "role", "labels", (F.col("labels") == F.col("n")).alias("full_access"))


def refusal_gate(questions: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """Refused without hits or with a best score under the threshold."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("gate_score"))
    return questions.select("query_id").join(best, "query_id", "left").withColumn("refused", F.coalesce(F.col("gate_score") < threshold, F.lit(True)))


def valid_plan(raw: Column) -> Column:
    """The facets of a plan ``{"queries": [...]}``, or null if anything is wrong with it."""
    q = F.from_json(F.get_json_object(raw, "$.queries"), "array<string>")
    norm = F.transform(q, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    ok = (F.length(raw) <= 4096) & (F.json_object_keys(raw) == F.array(F.lit("queries"))) & F.size(q).between(1, 3) & F.forall(norm, lambda x: (F.length(x) > 0) & (F.length(x) <= 400)) & (F.size(F.array_distinct(norm)) == F.size(norm))
    return F.when(ok, q)


def round_robin(lists: DataFrame, limit: int) -> DataFrame:
    """By rank, then list; each chunk where it comes first."""
    one = lists.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank", "list_no"))).filter("n = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "list_no"))).filter(F.col("place") <= limit).select("query_id", "chunk_id", "place")


def block_header(n: Column, chunk: dict[str, Column]) -> Column:
    """Number, file, path of headings and pages of a block, as far as they are known."""
    pages = F.when(F.coalesce(chunk["page_end"], chunk["page_start"]) == chunk["page_start"], F.concat(F.lit("p. "), chunk["page_start"].cast("string"))).otherwise(F.concat(F.lit("p. "), chunk["page_start"].cast("string"), F.lit("–"), chunk["page_end"].cast("string")))
    path = F.when(F.length(chunk["section_path"]) > 0, F.concat(F.lit(" — "), chunk["section_path"]))
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), chunk["filename"], F.coalesce(path, F.lit("")), F.coalesce(F.concat(F.lit(" ("), pages, F.lit(")")), F.lit("")))


def pack_context(hits: DataFrame, budget: int, chunk_max: int = 512) -> DataFrame:
    """The longest prefix of ranked chunks whose headers and texts are within the budget; the first always stays.

    ``hits(query_id, rank, chunk_id, content, filename, section_path, page_start, page_end)``. A text over
    ``chunk_max`` tokens is cut to its first piece. query_id, n, chunk_id, header, text, total.
    """
    by = Window.partitionBy("query_id").orderBy("rank")
    x = hits.withColumn("n", F.row_number().over(by))
    x = x.withColumn("text", F.when(token_count(F.col("content")) > chunk_max, F.get(hard_split(F.col("content"), chunk_max), F.lit(0))).otherwise(F.col("content")))
    x = x.withColumn("header", block_header(F.col("n"), {c: F.col(c) for c in ("filename", "section_path", "page_start", "page_end")}))
    total = F.sum(token_count(F.col("header")) + token_count(F.col("text"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("total", total).filter((F.col("total") <= budget) | (F.col("n") == 1)).select("query_id", "n", "chunk_id", "header", "text", "total")


def render_prompt(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """The blocks of a question, its wording, and how a follow-up is to be understood, in one text."""
    block = F.concat("header", F.lit("\n"), "text")
    context = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", block.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
    x = context.join(questions.select("query_id", "question", "effective_question"), "query_id")
    plain = F.concat(F.lit("Question: "), "question")
    follow = F.concat(F.lit("Original user wording: "), "question", F.lit("\nStandalone retrieval interpretation: "), "effective_question")
    return x.select("query_id", F.concat(F.lit("Context blocks:\n\n"), "context", F.lit("\n\n"), F.when(F.col("effective_question").isNull(), plain).otherwise(follow)).alias("prompt"))


def model_guard(questions: DataFrame, collections: DataFrame) -> DataFrame:
    """Questions whose embedding model is not their collection's."""
    return questions.join(collections.withColumnRenamed("model", "collection_model"), "collection").filter(F.col("model") != F.col("collection_model")).select("query_id", "model", "collection_model")
