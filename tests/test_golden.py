"""Golden questions of every kind against plain loops over the same tables."""

import re
from collections import Counter

from loamgrid.plans import queries_records

SF = "/root/testdata/sf0.001"


def brute(facts, docs, held, mentions, questions, topics):
    asked = {}
    for q in sorted(questions, key=lambda q: (q.item, q.n, q.question)):
        asked.setdefault(q.item, []).append(q.question)
    by, digits = {f.fact_id: f for f in facts}, lambda t: re.sub(r"[^\d]", "", t)
    docs = {x.doc_id: x for x in sorted(docs, key=lambda x: x.ord)}
    holds = {}
    for h in sorted(held, key=lambda h: (h.doc_id, h.ord)):
        holds.setdefault(h.doc_id, []).append(h.fact_id)
    unlock = {"managers": "manager", "hr": "hr", "finance": "finance", "leadership": "leadership"}
    sibling = {"managers": "employee", "hr": "finance", "finance": "hr", "leadership": "finance"}

    def clean(item, *values, most=2):
        return [q for q in asked.get(item, []) if not any(v.lower() in q.lower() or (digits(v) and digits(v) in digits(q)) for v in values)][:most]

    def label(f, doc):
        return docs[doc].restricted.get(f.section, docs[doc].default_label)

    def home(f):
        own = [x for x in docs.values() if f.fact_id in holds.get(x.doc_id, []) and x.lang == "en" and x.family != "FAQ"]
        return ([x for x in own if not x.superseded] or own or [None])[-1]

    def answer(f):
        return f.statement.replace("{value}", f.text_en)

    def kind(f, lab):
        fam = f.family or ""
        for name, yes in (("access", lab != "all"), ("as_of_date", fam.startswith("meeting:")), ("version_history", fam.startswith("version:") and not f.current), ("version", fam.startswith("year:") and not f.current), ("distractor_country", fam.startswith("country:")), ("table", f.in_table), ("version", fam.startswith("version:")), ("buried", f.buried)):
            if yes:
                return name
        return "direct"

    out = []

    def add(cat, role, q, ans, sources=(), hidden=(), labels=(), values=()):
        show = lambda v: ",".join(f"{d}#{'-' if s is None else s}" for d, s in v)
        out.append((cat, role, q, ans, ans is None, show(sources), show(hidden), ",".join(labels), ",".join(values)))

    stale = {f.key for f in facts if f.stale_in}
    for f in facts:
        doc = home(f)
        if doc is None:
            continue
        lab, qs = label(f, doc.doc_id), clean(f.fact_id, f.text_en)
        here = [(doc.doc_id, f.section)]
        for i, q in enumerate(qs):
            if lab != "all":
                add("access", sibling[lab], q, None, (), here, [lab], [f.text_en])
                add("access", unlock[lab], q, answer(f), here)
            else:
                add(kind(f, lab), "", q, answer(f), here)
                if i == 1 and f.current and f.key in stale:
                    add("stale_faq", "", q, answer(f), here)
    for m in mentions:
        d, f = docs[m.doc_id], by[m.fact_id]
        if d.lang != "en" or d.superseded or f.label != "all":
            continue
        target = home(f)
        if target is None or label(f, target.doc_id) != "all":
            continue
        for q in clean(f"{d.doc_id}|{f.fact_id}", f.text_en):
            add("multi_doc", "", q, answer(f), [(target.doc_id, f.section), (d.doc_id, None)])
    for d in docs.values():
        mine = [by[x] for x in holds.get(d.doc_id, [])]
        if d.lang == "en" and not d.superseded and d.default_label == "all":
            o, c = [f for f in mine if label(f, d.doc_id) == "all"], [f for f in mine if label(f, d.doc_id) != "all"]
            if o and c:
                o, c = o[0], c[0]
                lab = label(c, d.doc_id)
                for q in clean(f"{o.fact_id}+{c.fact_id}", c.text_en, o.text_en):
                    add("partial", "employee", q, answer(o) + " (the restricted part is not available at this access level)", [(d.doc_id, o.section)], [(d.doc_id, c.section)], [lab], [c.text_en])
                    add("partial", unlock[lab], q, answer(o) + " " + answer(c), [(d.doc_id, o.section), (d.doc_id, c.section)])
        if d.lang == "de" and d.family == "DE":
            for f in mine:
                if label(f, d.doc_id) == "all" and f.current:
                    for q in clean(f"{d.doc_id}|{f.fact_id}", f.text_de):
                        add("german", "", q, f"{f.text_de} — {answer(f)}", [(d.doc_id, f.section)])
    for t in topics:
        for q in clean(t.topic, most=4):
            if not re.search(r"\d", q):
                add("no_answer", "", q, None)
    return out


def test_golden_questions_of_every_kind(spark):
    tables = queries_records.golden_tables(spark, SF)
    every = brute(*[t.collect() for t in tables])
    got = [tuple(g) for g in queries_records.Q["v14_golden_questions"](spark, SF).collect()]
    key = lambda e: (e[0], e[1], e[2].lower())
    # One question of each category, role and text stays, one of those there are.
    assert Counter(map(key, got)) == Counter(set(map(key, every))) and set(got) <= set(every)
    assert {e[0] for e in got} == {"access", "as_of_date", "version_history", "version", "distractor_country", "table", "direct", "stale_faq", "multi_doc", "partial", "german", "no_answer"} | ({"buried"} if any(e[0] == "buried" for e in every) else set())
    alone = Counter(map(key, every))
    assert {e for e in every if alone[key(e)] == 1} <= set(got)


def test_questions_are_joined_once(spark, tmp_path):
    """Questions meet the items of all kinds in one join; each kind joined, sorted and numbered them anew."""
    facts, docs, held, mentions, questions, topics = queries_records.golden_tables(spark, SF)
    questions.write.parquet(f"{tmp_path}/q")
    out = queries_records.N.golden_questions(facts, docs, held, mentions, spark.read.parquet(f"{tmp_path}/q"), topics)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in x and "question#" in x for x in plan.splitlines()) == 1
