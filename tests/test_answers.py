"""Served answers, supervision and what is shown, on small written-out tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from stratalog.functions import display, layout
from stratalog.operators import answers, supervisor

OBJECTS = "id string, kind string, title string, body string, status string, n_evidence long, stale boolean, confidence double"


@pytest.fixture(scope="module")
def objects(spark):
    rows = [
        ("rule:a", "rule", "Discount for anvils", "five percent", "approved", 2, True, 0.9), ("term:b", "term", "Turnover", "counts yearly", "approved", 1, False, 0.7),
        ("rule:c", "rule", "Anvil returns", "open", "conflicted", 1, False, 0.4), ("rule:d", "rule", "Old anvils", "gone", "rejected", 1, False, 0.4), ("rule:e", "rule", "Bare", "anvils", "approved", 0, False, 0.2),
        ("fact:f", "fact", "Calendar", "a year", "approved", 1, False, 0.5), ("rule:g", "rule", "Delivery", "slow", "proposed", 1, False, 0.5),
    ]
    return spark.createDataFrame(rows, OBJECTS)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_areas_name_what_they_rest_on(spark, objects):
    edges = spark.createDataFrame([("term:b", "rule:a"), ("fact:f", "term:b"), ("rule:e", "rule:a")], "src string, dst string")
    hits = spark.createDataFrame([("rule:c", 1), ("rule:a", 2), ("rule:d", 3)], "id string, rank int")
    got = {x["id"]: (x["why"], x["stale"]) for x in answers.areas(objects, edges, hits).collect()}
    assert got == {"rule:a": ("matches what you asked", True), "term:b": ('"Discount for anvils" rests on this', False), "fact:f": ('"Discount for anvils" rests on this', False)}
    found = {x["id"]: x["why"] for x in answers.open_questions(objects, hits, "delivery of goods").collect()}
    assert found == {"rule:c": "two documents disagree and the owner has not chosen", "rule:g": "waiting for the owner to approve it"}


def test_answers_hold_sources_and_missing_foundations(spark, objects):
    items = spark.createDataFrame([("rule:a", "primary", None), ("term:b", "foundation", '"x" rests on this'), ("rule:c", "primary", None)], "id string, role string, why string")
    relations = spark.createDataFrame([("rule:a", "term:b", "depends_on"), ("rule:a", "fact:f", "depends_on"), ("term:b", "fact:f", "used_by")], "from_id string, to_id string, type string")
    evidence = spark.createDataFrame([("rule:a", "d1", "second", 6, 12, 4), ("rule:a", "d1", "first", 0, 5, 2), ("term:b", "gone", "q", 0, 1, 1)], "object_id string, document_id string, quote string, start_byte long, end_byte long, first_seen long")
    documents = spark.createDataFrame([("d1", "Prices.md", "first\nsecond", False)], "id string, name string, text string, gone boolean")
    blocks = spark.createDataFrame([("d1", 0, 0, 5), ("d1", 1, 6, 12)], "document_id string, ordinal long, start_byte long, end_byte long")
    got = {x["id"]: x for x in answers.answer(items, objects, relations, answers.with_sources(evidence, documents, blocks)).collect()}
    assert set(got) == {"rule:a", "term:b"}  # an open subject is not served
    assert got["rule:a"]["text"] == (
        "## Discount for anvils\n\nfive percent\n\nSource: Prices.md — line 1\n> first\n\nSource: Prices.md — line 2\n> second\n\nSomething this rests on has changed.\n\nAlso rests on: fact:f."
    )
    assert (got["rule:a"]["rests_on"], got["rule:a"]["confidence"], got["rule:a"]["source"]) == ("fact:f, term:b", "certain", "Prices.md — line 1 — first")
    assert got["term:b"]["text"].startswith('### Turnover (foundation) — "x" rests on this\n\ncounts yearly') and got["term:b"]["rests_on"] == ""
    around = {x["quote"]: x["passage"] for x in answers.passages(evidence, documents, 2).collect()}
    assert around == {"first": "first\ns", "second": "t\nsecond", "q": None}


def test_nothing_approved_is_said_plainly(spark, objects):
    weights = {"title": 4.0, "body": 1.0}
    got = answers.search_answer(objects, "returning anvils xyz", weights).collect()
    assert [(x["place"], x["id"]) for x in got] == [(1, "rule:a")]
    none = answers.search_answer(objects, "deliveries", weights).collect()
    assert len(none) == 1 and none[0]["place"] == 0 and none[0]["text"].startswith("This company has not approved") and none[0]["text"].endswith("not decided: Delivery.")
    assert answers.search_answer(objects, "qqq", weights).collect()[0]["text"] == answers.NOTHING
    access = {x["id"]: x["access"] for x in answers.access_answer(objects).collect()}
    assert access == {"rule:a": "full", "term:b": "full", "fact:f": "full", "rule:c": "name_only", "rule:g": "name_only", "rule:d": "withheld", "rule:e": "withheld"}


def test_cells_stand_under_their_columns(spark):
    rows = [(2, "old.csv", "2024-01-02T10:00:00", "row 4", ["a"], ["1", "2"], "1 | 2"), (1, "new.csv", "2025-01-02T10:00:00", "Sheet, row 9", ["a", "b"], ["1", "2"], "1 | 2")]
    schema = "place int, document string, modified string, locator string, columns array<string>, cells array<string>, line string"
    got = answers.cells_answer(spark.createDataFrame(rows, schema)).collect()[0]
    assert got["text"] == answers.MANY_FILES + "new.csv (2025-01-02) — Sheet, row 9\n  a: 1\n  b: 2\n\nold.csv (2024-01-02) — row 4\n  1 | 2\n\nThese are the figures as written.\n\nThey came from 2 different files. If two of them disagree, say so rather than choosing."
    assert answers.cells_answer(spark.createDataFrame(rows[:1], schema)).collect()[0]["text"].startswith(answers.ONE_FILE)
    assert answers.cells_answer(spark.createDataFrame([], schema)).collect() == []


def test_hash_of_the_map(spark):
    def reference(text, salt):
        h = 2166136261 ^ salt
        raw = text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2])) * 16777619 % 2**32
        h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
        h = (h ^ h >> 13) * 0xC2B2AE35 % 2**32
        return (h ^ h >> 16) / 2**32

    for text in ("", "rule:popust", "šđ 🎉", "x" * 300):
        for salt in (0, 1, 3):
            assert one(spark, layout.unit_hash(F.col("t"), salt), t=text) == reference(text, salt)


def test_what_is_shown(spark):
    t = F.col("t")
    cases = [
        (display.agent_slug(t), "Čaj & Šećer – a b c d", "caj-secer-a-b-c"), (display.prompt_slug(t), "—", "skill"), (display.prompt_slug(t), "Über Größe 1 2 3 4 5", "über-größe-1-2-3-4"), (display.cassette_slug(t), "Ab č-1", "ab---1"),
        (display.xml_escape(t), '<a & "b">', "&lt;a &amp; &quot;b&quot;&gt;"), (display.first_line(t), "\n  \n  x y \nz", "x y"), (display.first_line(t), "", ""), (display.first_line(t), "a" * 201, "a" * 200 + "…"),
        (display.procedure_line(t), "# head\n\n## two\n do it ", "do it"), (display.procedure_line(t), "# only", display.NO_PROCEDURE), (display.truncate(t, 5), "  a  b\ncd ", "a b c…"), (display.short(t), "é" * 60, "é" * 60),
        (display.complaint(t), "banner\nERROR a\nerror a\nERROR a\nx error: b", "ERROR a error a x error: b"), (display.complaint(t), " some\n text ", "some text"), (display.complaint(t), "z" * 301, "…" + "z" * 300), (display.complaint(t), "", ""),
        (display.error_envelope(t), "no", None), (display.error_envelope(t), 'x\n{"type": "error"}\n{"type": "turn.failed"}', '{"type": "error"}'), (display.error_envelope(t), '{"type": "result", "is_error": 1}', None),
        (display.error_envelope(t), '{"type":\n "result", "is_error": true}', '{"type":\n "result", "is_error": true}'),
    ]
    for column, text, want in cases:
        assert one(spark, column, t=text) == want, (text, want)
    now = F.lit(datetime.datetime(2024, 1, 1, 12, 0, 0))
    assert [one(spark, display.elapsed_seconds(t, now), t=x) for x in ("2024-01-01T11:59:00Z", "2024-01-01T13:59:00+02:00", "2025-01-01T00:00:00Z", "soon", None)] == [60, 60, 0, 0, 0]
    assert [one(spark, display.running_note(F.col("e"), F.col("p")), e=e, p=p) for e, p in (("x", ""), ("x", "2 min"), (None, ""), (None, "1 h"))] == ["x is running", "x · 2 min", "running", "running for 1 h"]


def test_the_quiz_asks_what_can_be_shown(spark, objects):
    documents = spark.createDataFrame([("d1", "alpha beta  alpha gamma", "n"), ("d2", "delta", "n")], "id string, text string, name string")
    asked = [
        (5, "d1", "q1", "gamma", "rule:g"), (3, "d1", "q1", "beta alpha", None), (4, "d1", "q2", "alpha", None), (6, "d1", "q3", " ", None), (7, "d2", "q1", "delta", "rule:a"), (8, "d2", "q1", "delta", "rule:g"), (9, "d3", "q9", "x", None), (2, "d2", "q4", "omega", None),
    ]
    df = spark.createDataFrame(asked, "ordinal long, document_id string, question string, quote string, object_id string")
    quiz = supervisor.quiz(df, documents, objects.where("status = 'proposed'"), "s")
    assert sorted(map(tuple, quiz.collect())) == [("s:0:3", "d1", "q1", "beta alpha", None), ("s:1:8", "d2", "q1", "delta", "rule:g")]
    yes = spark.createDataFrame([("rule:c",), ("rule:c",), ("nobody",)], "id string")
    after = {x["id"]: (x["status"], x["decided_by"]) for x in supervisor.confirm(objects, quiz, yes).collect()}
    assert after["rule:c"] == ("approved", "owner:quiz") and after["rule:g"] == ("rejected", "owner:quiz") and after["rule:a"] == ("approved", None) and len(after) == 7


def test_communities_and_sessions(spark):
    rows = [("1", "/a/Prodaja/Racun-1.PDF", "Racun-1.PDF"), ("2", "/a/Prodaja/x.csv", "x.csv"), ("3", "/b/Prodaja/y.pdf", "y.pdf"), ("4", "/a/Interno/z.md", "z.md"), ("5", "bare.md", "bare.md"), ("6", "/a/Prodaja/w.md", "w.md")]
    got = {x["document_id"]: (x["id"], x["label"]) for x in supervisor.communities(spark.createDataFrame(rows, "id string, path string, name string")).collect()}
    assert got == {"4": ("community:0", "Interno"), "6": ("community:1", "Prodaja"), "3": ("community:2", "Prodaja · PDF"), "1": ("community:3", "Prodaja · invoices"), "2": ("community:4", "Prodaja · spreadsheets"), "5": ("community:5", "documents")}
    turns = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 5)], "session string, at long")
    ends = spark.createDataFrame([("a", "failed", 1), ("a", "done", 3), ("b", "done", 4), ("c", "done", 9)], "session string, state string, at long")
    assert sorted(map(tuple, supervisor.sessions(turns, ends).collect())) == [("a", "done", 2, 1, 3), ("b", "active", 2, 1, None)]
