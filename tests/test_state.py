"""Ordered replays and streams with typed state: restarts, timers and literal cases."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import replay
from loamgrid.operators.replay import Ledger, Remembered
from loamgrid.plans.session import Scratch
from loamgrid.streaming import ops, state

T0 = datetime(2024, 5, 1, 10)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


class Stream:
    """A folder that rows come into file by file, and a query that starts anew for each."""

    def __init__(self, spark, path, schema, made):
        self.spark, self.path, self.schema, self.made, self.n = spark, path, schema, made, 0

    def send(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        out = self.made(self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in"))
        self.n += 1
        write = lambda df, k: df.write.mode("overwrite").parquet(f"{self.path}/out/batch={k}")
        with state.typed_state(self.spark):
            out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{self.path}/marks").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(out.schema).parquet(f"{self.path}/out").select(out.columns).collect()


def test_answers_go_on_after_a_restart_and_end_by_a_timer(spark, tmp_path):
    s = Stream(spark, str(tmp_path), "query_id long, seq long, ts timestamp, text string, last boolean", lambda d: state.answer_deltas(d, patience=600))
    got = s.send([(1, 0, at(0), "Employees get 27 days of leave a year [1].", False), (1, 1, at(1), "\n\nQUO", False), (2, 0, at(0), "NO_ANS", False), (3, 0, at(2), "An answer that nobody ends", False), (4, 0, at(2), "NO_", False)])
    assert {(g.query_id, g.seq) for g in got} == {(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)} and not any("QUO" in g.visible for g in got)
    got = s.send([(1, 2, at(3), "TES:\n[1] \"27 vacation days", False), (2, 1, at(3), "WER", True)])
    got = s.send([(1, 3, at(4), " per year\"\n", True), (9, 0, at(10_000), "later", True)])
    got = s.send([(9, 1, at(30_000), "much later", True)])
    text = lambda q: "".join(g.visible for g in sorted(got, key=lambda g: g.seq) if g.query_id == q)
    end = {g.query_id: g for g in got if g.ended and g.query_id < 9}
    assert text(1) == "Employees get 27 days of leave a year [1]." and end[1].section.strip() == '[1] "27 vacation days per year"'
    assert text(2) == "" and end[2].refused and end[2].ended == "last"
    assert text(3) == "An answer that nobody ends" and end[3].ended == "timeout" and end[3].seq == 1
    assert text(4) == "NO_" and end[4].ended == "timeout" and not end[4].refused


@pytest.mark.parametrize("marker", ["QUOTES:", "**QUOTES:**", "Quotes:", "QUOTES", "## quotes"])
def test_pieces_do_not_matter(marker):
    whole = f"The first sentence is long enough to be shown at once [1].\n\n{marker}\n[1] \"text after it\"\nmore"
    r = random.Random(4)
    for _ in range(60):
        cuts = sorted(r.sample(range(1, len(whole)), r.randint(0, 9)))
        parts = [whole[i:j] for i, j in zip([0, *cuts], [*cuts, len(whole)])]
        a = ops.DeltaAssembly()
        shown = "".join(a.feed(p, i == len(parts) - 1) for i, p in enumerate(parts))
        assert shown.rstrip() == "The first sentence is long enough to be shown at once [1]."
        assert a.section == "\n[1] \"text after it\"\nmore"
        b = ops.DeltaAssembly()  # as a stream does, through its stored fields
        again = ""
        for i, p in enumerate(parts):
            b = ops.DeltaAssembly(b.phase, b.held, b.section)
            again += b.feed(p, i == len(parts) - 1)
        assert (again, b.section) == (shown, a.section)


def test_similar_text_is_no_sentinel():
    for text, shown in (("NO answer here [1].", "NO answer here [1]."), ("NO_ANS", "NO_ANS"), ("  \nNO_ANSWER at all", ""), ("", "")):
        a = ops.DeltaAssembly()
        assert a.feed(text, True) == shown and a.refused == text.lstrip().startswith("NO_ANSWER")


def test_buckets_go_on_and_are_forgotten(spark, tmp_path):
    s = Stream(spark, str(tmp_path), "key string, id long, ts timestamp", lambda d: state.limited_requests(d, 2.0))
    first = {g.id: (g.admitted, g.retry_after) for g in s.send([("a", i, at(i)) for i in range(3)])}
    assert first == {0: (True, 0), 1: (True, 0), 2: (False, 28)}
    got = {g.id: g.admitted for g in s.send([("a", 3, at(3)), ("a", 4, at(40)), ("b", 5, at(5000))])}
    assert got[3] is False and got[4] is True
    got = {g.id: g.admitted for g in s.send([("b", 6, at(9000)), ("a", 7, at(9001)), ("a", 8, at(9002)), ("a", 9, at(9003))])}
    assert (got[7], got[8], got[9]) == (True, True, False)


def test_idempotent_windows_begin_at_requests(spark, tmp_path):
    day = 86400
    rows = [("k", 1, 0, "f", True), ("k", 2, 10, "f", False), ("k", 3, 20, "f", False), ("k", 4, 30, "g", False), ("k", 5, 40, None, False), ("k", 6, 9 + day, "f", False), ("k", 7, 10 + day, "g", False), ("k", 8, 11 + day, "f", False), ("j", 9, 5, None, False), ("j", 10, 6, "x", False)]
    want = {1: (1, "failed"), 2: (2, "first"), 3: (2, "replayed"), 4: (2, "conflict"), 5: (2, "replayed"), 6: (2, "replayed"), 7: (7, "first"), 8: (7, "conflict"), 9: (9, "first"), 10: (9, "conflict")}
    table = spark.createDataFrame(rows, "key string, id long, at long, fingerprint string, failed boolean").withColumn("at", F.col("at").cast("double"))
    assert {g.id: (g.first_id, g.outcome) for g in replay.idempotent_requests(table).collect()} == want
    s = Stream(spark, str(tmp_path), "key string, id long, ts timestamp, fingerprint string, failed boolean", state.idempotent_stream)
    timed = [(k, i, at(t), f, x) for k, i, t, f, x in rows]
    for part in (timed[:3], timed[3:5] + timed[8:], timed[5:7], timed[7:8]):
        got = s.send(part)
    assert {g.id: (g.first_id, g.outcome) for g in got} == want


def _day_by_day(events, most):
    """A plain ledger for each day, whatever ties scopes together."""
    books, out = {}, []
    for e in sorted(events, key=lambda e: (e[0], e[2], e[3] == "settle", e[1])):
        day, i, _, kind, ip, payer, units = e
        held = books.setdefault(day, [])
        if kind == "settle":
            row = next((h for h in held if h["id"] == i), None)
            if row is None:
                out.append((i, kind, "missing"))
            elif units is None:
                out.append((i, kind, "unknown"))
            elif row["done"]:
                out.append((i, kind, "repeated" if row["v"] == units else "conflict"))
            else:
                row["v"], row["done"] = units, True
                out.append((i, kind, "overrun" if units > row["r"] else "settled"))
            continue
        own = [h for h in held if payer and h["guest"] and h["ip"] == ip]
        users = lambda u: sum(h["v"] for h in held if u in h["users"] or h in own)  # noqa: E731, B023
        ok = sum(h["v"] for h in held if h["ip"] == ip) + units <= most and (payer is None or users(payer) + units <= most)
        if ok:
            for h in own:
                h["users"].add(payer)
            held.append({"id": i, "ip": ip, "guest": payer is None, "v": units, "r": units, "done": False, "users": {payer} - {None}})
        out.append((i, kind, "admitted" if ok else "denied"))
    return out


def _random_events(seed, n):
    r, out = random.Random(seed), []
    for i in range(n):
        day, t = r.randrange(2), r.randrange(80_000)
        out.append((date(2024, 5, 1) + timedelta(days=day), i, datetime(2024, 5, 1) + timedelta(days=day, seconds=t), "reserve", f"a{r.randrange(6)}", r.choice([None, *(f"u{k}" for k in range(6))]), r.randrange(1, 60)))
        for _ in range(r.choice([0, 1, 1, 2])):
            out.append((*out[i_at(out, i)][:2], out[i_at(out, i)][2] + timedelta(seconds=r.randrange(3000)), "settle", *out[i_at(out, i)][4:6], r.choice([None, 10, 30, 70])))
    return out


def i_at(rows, key):
    return next(k for k, x in enumerate(rows) if x[1] == key and x[3] == "reserve")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budgets_of_both_scopes(spark, seed):
    events = _random_events(seed, 250)
    df = spark.createDataFrame(events, "day date, id long, ts timestamp, kind string, ip string, payer string, units long").repartition(3)
    got = replay.budget_replay(df, 250 / replay.UNITS).collect()
    want = _day_by_day(events, 250)
    assert Counter(tuple(g) for g in got) == Counter(want)
    assert {"admitted", "denied", "settled", "overrun", "unknown", "missing"} <= {w[2] for w in want}


def test_budget_stream_goes_on_after_a_restart_and_forgets_the_day(spark, tmp_path):
    events = sorted(_random_events(5, 120), key=lambda e: (e[2], e[3] == "settle", e[1]))
    schema = "day date, id long, ts timestamp, kind string, ip string, payer string, units long, group string"
    s = Stream(spark, str(tmp_path), schema, lambda d: state.budget_decisions(d, 250 / replay.UNITS, late="2 hours"))
    for k in range(0, len(events), 60):
        got = s.send([(*e, "all") for e in events[k : k + 60]])
    assert Counter(tuple(g) for g in got) == Counter(_day_by_day(events, 250))
    long_after = datetime(2024, 5, 9)
    s.send([(long_after.date(), 9001, long_after, "reserve", "z", None, 1, "all")])
    before = s.send([(long_after.date(), 9002, long_after + timedelta(hours=9), "reserve", "z", None, 1, "all")])
    # What a day had admitted is forgotten with it; a settlement as late as this finds nothing.
    i = next(g.id for g in before if g.outcome == "admitted" and g.id < 9000)
    e = events[i_at(events, i)]
    after = s.send([(e[0], i, long_after + timedelta(hours=10), "settle", e[4], None, 5, "all")])
    assert list((Counter(tuple(g) for g in after) - Counter(tuple(g) for g in before)).elements()) == [(i, "settle", "missing")]


def test_denied_requests_import_no_guests():
    a = Ledger(100)
    assert a.reserve("g", "ip1", None, 60) == "admitted"
    assert a.reserve("x", "ip1", "u", 50) == "denied"
    assert a.reserve("y", "ip2", "u", 90) == "admitted"  # the guest's request is no part of the account yet
    assert a.reserve("z", "ip1", "u", 1) == "denied"  # now it would be: 90 + 60
    assert a.settle("g", 5) == "settled" and a.settle("g", 5) == "repeated" and a.settle("g", 6) == "conflict"
    assert a.reserve("z", "ip1", "u", 5) == "admitted" and a.totals["user:u"] == 100 and a.totals["ip:ip1"] == 10
    assert a.settle("y", 95) == "overrun" and a.totals["user:u"] == 105


def test_failed_requests_are_not_remembered():
    r = Remembered()
    assert r.ask(1, 0.0, "f", True, 10) == (1, "failed") and r.ask(2, 1.0, "g", False, 10) == (2, "first")
    assert r.ask(3, 10.9, "g", True, 10) == (2, "replayed") and r.ask(4, 11.0, "f", False, 10) == (4, "first")


def test_groups_of_long_chains(spark):
    """An address chain of forty links is one group; the next day it is not tied."""
    d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
    rows = [(d1, "reserve", f"a{i:02d}", f"u{i + j}") for i in range(40) for j in (0, 1)] + [(d2, "reserve", f"a{i:02d}", f"u{i}") for i in range(40)] + [(d2, "reserve", "a00", None)]
    got = replay.scope_groups(spark.createDataFrame(rows, "day date, kind string, ip string, payer string")).collect()
    assert {g.group for g in got if g.day == d1} == {"a00"} and len({g.group for g in got if g.day == d2}) == 40
    assert replay.scope_groups(spark.createDataFrame([], "day date, kind string, ip string, payer string")).count() == 0
    assert Scratch(spark, "t").root
