"""Golden questions of every kind, derived from a registry of facts, its documents, and questions written for them.

Tables: ``facts(fact_id, key, label, section, text_en, text_de, statement, family, current, in_table, buried,
stale_in)``, ``docs(doc_id, ord, title, lang, family, default_label, superseded, restricted)`` with a map from
section to label, ``held(doc_id, fact_id, ord)`` and ``mentions(doc_id, fact_id)``, and
``questions(item, n, question)``. What a question is written for is named by ``item``: a fact, ``document|fact``
for a mention or a German mirror, ``fact+fact`` for an open and a closed one, a topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.corpus import effective_label

# The role that unlocks a label, and one of about its rank that does not.
UNLOCKS = {"managers": "manager", "hr": "hr", "finance": "finance", "leadership": "leadership"}
SIBLING = {"managers": "employee", "hr": "finance", "finance": "hr", "leadership": "finance"}
_SOURCES = "array<struct<doc:string,section:int>>"


def _role(label: Column, of: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), label)


def _answer(lang: str = "en") -> Column:
    """The fact's sentence; a German answer leads with the German value, since sentences are English."""
    said = F.replace("statement", F.lit("{value}"), F.col("text_en"))
    return F.concat("text_de", F.lit(" — "), said) if lang == "de" else said


def _sources(*pairs: tuple[str, str | None]) -> Column:
    return F.array(*[F.struct(F.col(d).alias("doc"), (F.lit(None) if s is None else F.col(s)).cast("int").alias("section")) for d, s in pairs])


def _entry(category: Column | str, when: Column | None = None, role: Column | None = None, answer: Column | None = None, sources: Column | None = None, hidden: tuple[Column, Column, Column] | None = None, nth: int | None = None) -> Column:
    """What a golden question says besides its text, where ``when`` holds; without an answer a refusal is expected. ``nth``: of this question only."""
    texts = F.array().cast("array<string>")
    sources_, hidden_sources = (F.coalesce(x, F.array()).cast(_SOURCES) if x is not None else F.array().cast(_SOURCES) for x in (sources, hidden and hidden[0]))
    said = F.struct(
        (F.lit(category) if isinstance(category, str) else category).alias("category"), F.coalesce(role if role is not None else F.lit(None), F.lit("")).alias("role"), (answer if answer is not None else F.lit(None).cast("string")).alias("expected_answer"),
        F.lit(answer is None).alias("expected_refusal"), sources_.alias("expected_sources"), hidden_sources.alias("hidden_sources"),
        (F.array(hidden[1]) if hidden else texts).alias("hidden_labels"), (F.array(hidden[2]) if hidden else texts).alias("hidden_values"), F.lit(nth).cast("int").alias("nth"),
    )
    return said if when is None else F.when(when, said)


def _candidates(rows: DataFrame, item: Column, values: list[str], entries: list[Column], most: int = 2) -> DataFrame:
    """(item, values, most, entries): what golden questions of an item may say, how many it may have and the values these must not tell."""
    none = F.array().cast("array<string>")
    return rows.select(item.alias("item"), (F.array(*values) if values else none).alias("values"), F.lit(most).alias("most"), F.array_compact(F.array(*entries)).alias("entries"))


def asked(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entries of ``candidates`` with the first ``most`` questions of their item that give none of its values away, by text or by its digits.

    The questions of an item are few and come together once, whatever its kinds.
    """
    lists = questions.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "question"))), lambda q: q["question"]).alias("questions"))
    digits = lambda t: F.regexp_replace(t, r"[^\d]", "")
    tells = lambda q, v: F.contains(F.lower(q), F.lower(v)) | ((digits(v) != "") & F.contains(digits(q), digits(v)))
    fine = F.slice(F.filter("questions", lambda q: ~F.exists("values", lambda v: tells(q, v))), F.lit(1), F.col("most"))
    x = candidates.join(lists, "item").select("entries", F.posexplode(fine).alias("at", "question"))
    x = x.select((F.col("at") + 1).alias("at"), "question", F.explode("entries").alias("e"))
    return x.filter(F.col("e.nth").isNull() | (F.col("e.nth") == F.col("at"))).select("question", "e.*").drop("nth")


def category(family: Column, current: Column, label: Column, in_table: Column, buried: Column) -> Column:
    """V11 in full."""
    of = F.coalesce(family, F.lit(""))
    return (
        F.when(label != "all", "access").when(of.startswith("meeting:"), "as_of_date").when(of.startswith("version:") & ~current, "version_history").when(of.startswith("year:") & ~current, "version")
        .when(of.startswith("country:"), "distractor_country").when(in_table, "table").when(of.startswith("version:"), "version").when(buried, "buried").otherwise("direct")
    )


def placed_facts(facts: DataFrame, docs: DataFrame, held: DataFrame) -> DataFrame:
    """Each fact with the English document it is looked up in (the current one, the last of several, no FAQ) and its label there."""
    x = held.select("fact_id", "doc_id").join(docs.filter("lang = 'en' and family <> 'FAQ'").select("doc_id", F.col("ord").alias("doc_ord"), "superseded", "restricted", "default_label"), "doc_id")
    first = F.row_number().over(Window.partitionBy("fact_id").orderBy("superseded", F.desc("doc_ord")))
    x = x.withColumn("nth", first).filter("nth = 1").select("fact_id", "doc_id", "restricted", "default_label")
    return facts.drop("label").join(x, "fact_id").withColumn("label", effective_label(F.col("section"), F.col("restricted"), F.col("default_label"))).drop("restricted", "default_label")


def golden_questions(facts: DataFrame, docs: DataFrame, held: DataFrame, mentions: DataFrame, questions: DataFrame, topics: DataFrame) -> DataFrame:
    """Category, role, question, expected_answer, expected_refusal, expected_sources, hidden_sources, hidden_labels, hidden_values.

    ``topics(topic)`` are those that no document has (V7). Each question counts once per category and role,
    without case (V15).
    """
    placed = placed_facts(facts, docs, held)
    about = docs.withColumnsRenamed({"family": "doc_family", "ord": "doc_ord"})
    labelled = held.join(facts.drop("label"), "fact_id").join(about, "doc_id").withColumn("label", effective_label(F.col("section"), F.col("restricted"), F.col("default_label")))

    here = _sources(("doc_id", "section"))
    # An older FAQ still states the value that a current fact has replaced.
    stale = facts.filter("size(stale_in) > 0").select("key", F.lit(True).alias("stale")).distinct()
    own = placed.withColumn("category", category(F.col("family"), F.col("current"), F.col("label"), F.col("in_table"), F.col("buried"))).join(stale, "key", "left")
    closed = F.col("category") == "access"
    whole = _candidates(own, F.col("fact_id"), ["text_en"], [
        _entry(F.col("category"), ~closed, answer=_answer(), sources=here),
        _entry("access", closed, role=_role(F.col("label"), SIBLING), hidden=(here, F.col("label"), F.col("text_en"))),
        _entry("access", closed, role=_role(F.col("label"), UNLOCKS), answer=_answer(), sources=here),
        _entry("stale_faq", F.col("stale") & F.col("current") & ~closed, answer=_answer(), sources=here, nth=2),
    ])

    by = docs.filter("lang = 'en' and not superseded").select(F.col("doc_id").alias("source"))
    told = mentions.select(F.col("doc_id").alias("source"), "fact_id").join(by, "source").join(placed.filter("label = 'all'"), "fact_id").join(facts.filter("label = 'all'").select("fact_id"), "fact_id", "left_semi")
    whole = whole.unionByName(_candidates(told, F.concat_ws("|", "source", "fact_id"), ["text_en"], [_entry("multi_doc", answer=_answer(), sources=_sources(("doc_id", "section"), ("source", None)))]))

    english = labelled.filter("lang = 'en' and not superseded and default_label = 'all'").withColumn("answer", _answer())
    side = lambda which, name: english.filter(which).groupBy("doc_id").agg(F.min_by(F.struct("fact_id", "section", "text_en", "answer", "label"), "`ord`").alias(name))
    both = side("label = 'all'", "o").join(side("label <> 'all'", "c"), "doc_id")
    both = both.select("doc_id", F.concat_ws("+", "o.fact_id", "c.fact_id").alias("item"), F.col("o.text_en").alias("open_text"), F.col("c.text_en").alias("closed_text"), F.col("o.answer").alias("open_answer"), F.col("c.answer").alias("closed_answer"), F.col("o.section").alias("open_section"), F.col("c.section").alias("closed_section"), F.col("c.label").alias("label"))
    less = F.concat("open_answer", F.lit(" (the restricted part is not available at this access level)"))
    whole = whole.unionByName(_candidates(both, F.col("item"), ["closed_text", "open_text"], [
        _entry("partial", role=F.lit("employee"), answer=less, sources=_sources(("doc_id", "open_section")), hidden=(_sources(("doc_id", "closed_section")), F.col("label"), F.col("closed_text"))),
        _entry("partial", role=_role(F.col("label"), UNLOCKS), answer=F.concat_ws(" ", "open_answer", "closed_answer"), sources=_sources(("doc_id", "open_section"), ("doc_id", "closed_section"))),
    ]))

    mirror = labelled.filter("lang = 'de' and doc_family = 'DE' and label = 'all' and current")
    whole = whole.unionByName(_candidates(mirror, F.concat_ws("|", "doc_id", "fact_id"), ["text_de"], [_entry("german", answer=_answer("de"), sources=here)]))
    whole = asked(questions, whole.unionByName(_candidates(topics, F.col("topic"), [], [_entry("no_answer")], 4)))
    whole = whole.filter((F.col("category") != "no_answer") | ~F.col("question").rlike(r"\d"))
    ties = [F.to_json(c) for c in ("expected_sources", "hidden_sources", "hidden_labels", "hidden_values")]
    first = F.row_number().over(Window.partitionBy("category", "role", F.lower("question")).orderBy("question", "expected_answer", *ties))
    return whole.withColumn("nth", first).filter("nth = 1").select("category", "role", "question", "expected_answer", "expected_refusal", "expected_sources", "hidden_sources", "hidden_labels", "hidden_values")
