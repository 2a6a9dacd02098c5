"""Corpus validation and golden-set derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.plans.session import Scratch


def heading_sequence(blocks: DataFrame) -> DataFrame:
    """V2: documents whose numbered second-level headings are not 1..n in order."""
    n = F.regexp_extract("text", r"^(\d+)\.", 1).try_cast("int")
    x = blocks.filter("level = 2").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", n.alias("n")))), lambda s: s["n"]).alias("ns"))
    return x.select("doc_id", (F.col("ns") == F.sequence(F.lit(1), F.size("ns"))).alias("in_order"), F.size("ns").alias("headings"))


def heading_check(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """V2: (doc_id, numbers_ok, wrong_titles) against ``expected(doc_id, lang, titles)``.

    Headings like ``2. Title`` must be numbered from 1 as many as there are titles. In English documents
    each must have its number's title; those that differ are listed in order.
    """
    form = r"^(\d+)\.\s*(.+?)\s*$"
    h = blocks.filter("level = 2").withColumns({"n": F.regexp_extract("text", form, 1).try_cast("int"), "title": F.regexp_extract("text", form, 2)}).filter("n is not null")
    lists = h.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block", "n", "title"))).alias("h"))
    x = expected.join(lists, "doc_id", "left").withColumn("h", F.coalesce("h", F.array().cast(lists.schema["h"].dataType)))
    want = F.transform(F.sequence(F.lit(0), F.size("titles")), lambda i: i)
    numbers = F.transform("h", lambda y: y["n"]) == F.filter(want, lambda i: i > 0)
    wrong = F.filter("h", lambda y: (y["n"] >= 1) & (y["n"] <= F.size("titles")) & (F.get("titles", y["n"] - 1) != y["title"]))
    return x.select("doc_id", numbers.alias("numbers_ok"), F.when(F.col("lang") == "en", F.transform(wrong, lambda y: F.concat(y["n"].cast("string"), F.lit(" "), y["title"]))).otherwise(F.array().cast("array<string>")).alias("wrong_titles"))


def has_value(text: Column, value: Column) -> Column:
    """V4: the value stands in the text and is not part of a longer number or word."""
    return F.replace(text, value, F.lit("\x00")).rlike(r"(?<![\p{L}\p{N}_.,\x00])\x00(?![\p{L}\p{N}_]|[.,]\d)")


def fact_presence(facts: DataFrame, sections: DataFrame) -> DataFrame:
    """V4: whether each fact's value is in the section it belongs to: facts (doc_id, sec, value), sections (doc_id, sec, text)."""
    x = facts.join(sections.select("doc_id", "sec", "text"), ["doc_id", "sec"], "left")
    return x.select("fact_id", F.coalesce(has_value(F.col("text"), F.col("value")), F.lit(False)).alias("present"))


#: Words as has_value sees them: a number with its separators is one, and a mark glued in front belongs to the word.
VALUE_WORD = r"[.,]?[\p{L}\p{N}_]+(?:[.,]\p{N}+)*"


def values_held(values: DataFrame, docs: DataFrame) -> DataFrame:
    """V5: (doc_id, value) of documents and the distinct values they hold.

    A value of one word is found among the words of a document. Others are looked for by their longest
    word, and only those that meet it are compared with the text.
    """
    words = lambda t: F.regexp_extract_all(t, F.lit(VALUE_WORD), F.lit(0))
    bare = lambda t: F.ltrim(t, F.lit(".,"))
    # Words are dealt once, by what follows a mark in front; a value of one word must have the same mark.
    terms = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).withColumn("key", bare(F.col("term")))
    terms = terms.select("doc_id", "key", F.left("term", F.length("term") - F.length("key")).alias("mark"))
    x = values.select("value").distinct().withColumn("w", words(F.col("value"))).filter(F.size("w") > 0)
    longest = F.get(F.reverse(F.array_sort(F.transform("w", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))), F.lit(0))["t"]
    x = x.select("value", bare(longest).alias("key"), ((F.size("w") == 1) & (F.get("w", F.lit(0)) == F.col("value"))).alias("plain"))
    met = terms.join(x, "key").filter(~F.col("plain") | (F.concat("mark", "key") == F.col("value")))
    met = Scratch(docs.sparkSession, "values").keep(met.select("doc_id", "value", "plain"), "met")
    one, rest = met.filter("plain").select("doc_id", "value"), met.filter("not plain").select("doc_id", "value").distinct()
    if rest.isEmpty():
        return one
    return one.unionByName(rest.join(docs.select("doc_id", "text"), "doc_id").filter(has_value(F.col("text"), F.col("value"))).select("doc_id", "value"))


def foreign_values(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """V5: facts whose value other documents hold, and how many: all holders of the value but the fact's own document."""
    held = Scratch(docs.sparkSession, "values").keep(values_held(facts, docs), "held")  # read twice below
    holders = held.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    own = held.join(facts.select("doc_id", "value").distinct(), ["doc_id", "value"]).withColumn("own", F.lit(1))
    x = facts.select("fact_id", "doc_id", "value").join(holders, "value").join(own, ["doc_id", "value"], "left")
    return x.select("fact_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("documents")).filter("documents > 0")


def marker_placement(sections: DataFrame, expected: DataFrame) -> DataFrame:
    """V3: sections whose access label is not the registry's, or that only the registry or only the document has.

    ``sections(doc_id, title, access_label)`` of the documents, ``expected(doc_id, title, label)``.
    doc_id, title, fault (wrong_label, missing_section, unexpected_marker), found, wanted.
    """
    x = sections.join(expected, ["doc_id", "title"], "full_outer")
    fault = (
        F.when(F.col("access_label").isNull(), "missing_section")
        .when(F.col("label").isNull() & (F.col("access_label") != "all"), "unexpected_marker")
        .when(F.col("access_label") != F.col("label"), "wrong_label")
    )
    return x.select("doc_id", "title", fault.alias("fault"), F.col("access_label").alias("found"), F.col("label").alias("wanted")).filter("fault is not null")


# The line that restricts a document or section, by language and label.
MARKERS = {
    "en": {"managers": "Access: Managers only", "hr": "Access: People & Culture only", "finance": "Access: Finance only", "leadership": "Access: Leadership only"},
    "de": {"managers": "Zugriff: nur Führungskräfte", "hr": "Zugriff: nur People & Culture", "finance": "Zugriff: nur Finanzen", "leadership": "Zugriff: nur Geschäftsführung"},
}


def marker_faults(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """V3: (doc_id, section, wanted, found) where a marker is not where it must be.

    ``docs(doc_id, lang, default_label, restricted)``: a restricted document's first paragraph after its
    title (section 0) must be exactly its label's line, and so must the first one of each restricted
    section that the document has (``restricted``: label by section number). ``blocks`` are those of S1.
    """
    form = r"^(\d+)\.\s*(.+?)\s*$"
    by = Window.partitionBy("doc_id").orderBy("block")
    x = blocks.withColumns({"next": F.lead("text").over(by), "of": F.lead("level").over(by), "n": F.regexp_extract("text", form, 1).try_cast("int")})
    title = x.filter("level = 1").groupBy("doc_id").agg(F.min_by(F.struct("next", "of"), "block").alias("t")).select("doc_id", F.lit(0).alias("section"), F.coalesce("t.next", F.lit("")).alias("found"))
    # What follows a section's heading is its own up to the next heading of a section.
    part = x.filter("level = 2 and n is not null").groupBy("doc_id", F.col("n").alias("section")).agg(F.max_by(F.struct("next", F.coalesce(F.col("of") == 2, F.lit(False)).alias("ends")), "block").alias("t"))
    part = part.select("doc_id", "section", F.when(F.col("t.ends"), "").otherwise(F.coalesce("t.next", F.lit(""))).alias("found"))
    line = F.coalesce(*[F.when((F.col("lang") == g) & (F.col("label") == k), v) for g, of in MARKERS.items() for k, v in of.items()])
    label = F.when(F.col("section") == 0, F.nullif("default_label", F.lit("all"))).otherwise(F.try_element_at("restricted", F.col("section")))
    y = title.unionByName(part).join(docs, "doc_id").withColumn("label", label).filter("label is not null").withColumn("wanted", line)
    return y.filter(F.col("found") != F.col("wanted")).select("doc_id", "section", "wanted", "found")


def stray_digits(text: Column, allowed: list[str]) -> Column:
    """V6: numbers outside of the allowed patterns."""
    for p in allowed:
        text = F.regexp_replace(text, p, " ")
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))


def absent_topics(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """V7: topics (a short list of words) that no document has."""
    hit = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[\s.,;:!?|]+"))).alias("topic")).join(F.broadcast(topics), "topic", "left_semi").distinct()
    return topics.join(hit, "topic", "left_anti")


def length_bounds(text: Column, low: int, high: int) -> Column:
    """V8: words between 0.75 of the low and 1.3 of the high bound."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).between(0.75 * low, 1.3 * high)


def registry_faults(facts: DataFrame) -> DataFrame:
    """V9: values that several facts of one kind share, and repeated ids."""
    value = facts.groupBy("kind", "value").agg(F.count_distinct("fact_id").alias("n")).filter("n > 1").select(F.lit("shared_value").alias("fault"), F.concat_ws("/", F.col("kind").cast("string"), "value").alias("key"), "n")
    ids = facts.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated_id").alias("fault"), F.col("fact_id").cast("string").alias("key"), "n")
    return value.unionByName(ids)


def effective_label(section: Column, marker: Column, default: Column) -> Column:
    """The section's marker, else the document's label."""
    return F.coalesce(F.element_at(marker, section), default)


def fact_category(current: Column, restricted: Column, table: Column, variants: Column) -> Column:
    """The first category that fits."""
    return F.when(restricted, "access").when(~current, "version").when(table, "table").when(variants > 1, "variant").otherwise("direct")


def document_for_fact(mentions: DataFrame) -> DataFrame:
    """The current version of a document, the last one of several."""
    by = Window.partitionBy("fact_id").orderBy(F.desc(F.col("superseded_by").isNull()), F.desc("ord"))
    return mentions.withColumn("n", F.row_number().over(by)).filter("n = 1").select("fact_id", "doc_id")


def gives_away(question: Column, value: Column) -> Column:
    """The question has the value or its digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return question.contains(value) | ((digits != "") & F.regexp_replace(question, "[^0-9]", "").contains(digits))


def golden_assembly(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """For each restricted fact a refused and an unlocked question, for the others one that is answered."""
    x = facts.join(questions, "fact_id")
    open_ = x.filter("label = 'all'").select("fact_id", F.lit("direct").alias("category"), F.lit("employee").alias("role"), "question", F.lit(False).alias("expected_refusal"))
    refuse = x.filter("label <> 'all'").select("fact_id", F.lit("access").alias("category"), F.lit("employee").alias("role"), "question", F.lit(True).alias("expected_refusal"))
    unlock = x.filter("label <> 'all'").select("fact_id", F.lit("access").alias("category"), F.when(F.col("label") == "managers", "manager").otherwise(F.col("label")).alias("role"), "question", F.lit(False).alias("expected_refusal"))
    return open_.unionByName(refuse).unionByName(unlock)


def dedup_golden(golden: DataFrame) -> DataFrame:
    """One question per category, role and text without case, the first; counted by category."""
    return golden.groupBy("category", "role", F.lower("question").alias("q")).agg(F.min("fact_id").alias("first")).groupBy("category").agg(F.count(F.lit(1)).alias("questions"))


def rendered(value: Column, kind: str, lang: str) -> Column:
    """Money, per cent or a count as a text of either language should show it."""
    text = F.format_number(value, 2 if kind == "money" else 0)
    text = F.translate(text, ",.", ".,") if lang == "de" else text
    return {"money": F.concat(text, F.lit(" €")) if lang == "de" else F.concat(F.lit("€"), text), "percent": F.concat(text, F.lit(" %" if lang == "de" else "%"))}.get(kind, text)


# Units in both languages, German singulars, and months.
UNITS = {
    "days": "Tage", "calendar days": "Kalendertage", "working days": "Arbeitstage", "business days": "Werktage", "weeks": "Wochen", "months": "Monate", "years": "Jahre", "hours": "Stunden", "minutes": "Minuten", "ms": "ms",
    "requests per minute": "Anfragen pro Minute", "GB": "GB", "people": "Personen", "spaces": "Stellplätze", "slots": "Termine", "lines": "Zeilen", "per km": "pro km", "per month": "pro Monat", "per year": "pro Jahr", "per day": "pro Tag", "per night": "pro Nacht",
}
SINGULAR_DE = {
    "Tage": "Tag", "Kalendertage": "Kalendertag", "Arbeitstage": "Arbeitstag", "Werktage": "Werktag", "Wochen": "Woche", "Monate": "Monat", "Jahre": "Jahr", "Stunden": "Stunde", "Minuten": "Minute", "Personen": "Person",
    "Stellplätze": "Stellplatz", "Termine": "Termin", "Zeilen": "Zeile",
}
MONTHS = {
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
    "de": ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"],
}


def _word(text: Column, words: dict[str, str]) -> Column:
    """The other word where there is one, else the same."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), text), text)


def localised(kind: Column, unit: Column, value: Column, lang: str) -> Column:
    """A registry's value (text) as a text of a language should show it, by its kind; other kinds as they are.

    Whole money has no cents and may have a unit; a count has its unit, in the singular for one; a date is
    ``month-day``.
    """
    german = lang == "de"
    n, name = value.try_cast("double"), _word(unit, UNITS) if german else unit
    swap = lambda x: F.translate(x, ",.", ".,") if german else x
    number = F.when(n == F.floor(n), swap(F.format_number(n.cast("long"), 0))).otherwise(swap(F.format_number(n, 2)))
    money = F.concat(number, F.lit(" €")) if german else F.concat(F.lit("€"), number)
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", n), "0+$", ""), r"\.$", "")
    one = _word(name, SINGULAR_DE) if german else F.when(name.endswith("s") & (name != "ms") & ~name.endswith("per minute"), F.substring(name, 1, F.length(name) - 1)).otherwise(name)
    month, day = F.get(F.array(*map(F.lit, MONTHS[lang])), F.split_part(value, F.lit("-"), F.lit(1)).try_cast("int") - 1), F.split_part(value, F.lit("-"), F.lit(2)).try_cast("int").cast("string")
    return (
        F.when(kind == "money", F.concat_ws(" ", money, F.nullif(name, F.lit(""))))
        .when(kind == "percent", F.concat(F.replace(short, F.lit("."), F.lit(",")), F.lit(" %")) if german else F.concat(short, F.lit("%")))
        .when(kind == "count", F.concat(n.cast("long").cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(name)))
        .when(kind == "date", F.concat(day, F.lit(". "), month) if german else F.concat(month, F.lit(" "), day))
        .otherwise(value)
    )


def rendering_check(facts: DataFrame) -> DataFrame:
    """Facts whose text of a language is not their value's: fact_id, lang, text, expected."""
    rows = [F.struct(F.lit(x).alias("lang"), F.col(f"text_{x}").alias("text"), localised(F.col("kind"), F.col("unit"), F.col("value"), x).alias("expected")) for x in ("en", "de")]
    return facts.select("fact_id", F.explode(F.array(*rows)).alias("r")).select("fact_id", "r.*").filter(~F.col("text").eqNullSafe(F.col("expected")))
