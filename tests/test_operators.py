"""Operators on small hand-made tables: the cases that the queries' data doesn't have."""

import io
import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalog.functions import packing, phrases, text
from stratalog.operators import evidence, graph, order, search, similar, transitions
from stratalog.operators.consolidate import consolidate
from stratalog.sources import files, replies
from stratalog.streaming import feeds


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("statement", "want"),
    [("Rabat 5% do 20.000,00 EUR", ["20000eur", "5%"]), ("u roku 24 sata, 5 posto", ["24sati", "5%"]), ("bez brojki", []), ("price 2,100 EUR", ["2.1eur"]), ("1.234.567 i 3,50", ["1234567", "3.5"])],
)
def test_figures(spark, statement, want):
    assert one(spark, text.figures(F.col("s")), s=statement) == want


def test_text_functions(spark):
    assert one(spark, text.slug(F.col("s")), s="  Čišćenje & Žbuka 2! ") == "ciscenje-zbuka-2"
    assert one(spark, text.normalise_quote(F.col("s")), s=' "Rok je\n 24  sata." ') == "rok je 24 sata"
    assert one(spark, text.strip_instances(F.col("s")), s="Invoice INV-010 for #12 anvils") == "Invoice for anvils"
    assert one(spark, text.passage(F.col("s"), F.lit(4), F.lit(6), 1), s="éé ab éé") == " ab"


def test_phrases(spark):
    assert [one(spark, phrases.human_bytes(F.lit(n))) for n in (5, 2048, 5 * 1024**2)] == ["5 B", "2.0 KB", "5.0 MB"]
    assert [one(spark, phrases.duration_phrase(F.lit(n))) for n in (9, 200, 7200)] == ["", "3 min", "2 h"]
    assert one(spark, phrases.spend_phrase(F.lit(1234), F.lit(12))) == "1,234 tokens · $0.12"
    assert [one(spark, phrases.is_old_version(F.lit(n))) for n in ("a (1).pdf", "price_old.xlsx", "plan v2.md", "golden.md")] == [True, True, True, False]
    names = (".env", "id_dsa", "ID_ECDSA", "ServiceAccount.json", "auth.json", "a.keystore", "b.jks", "prod.env", "x.env.production", "key.pem")
    assert all(one(spark, phrases.is_secret(F.lit(n))) and one(spark, phrases.is_noise(F.lit(n))) for n in names)
    assert not any(one(spark, phrases.is_secret(F.lit(n))) for n in ("my passwords.txt", "monkey.md", "env", "auth.json.md"))
    assert [one(spark, phrases.is_noise(F.lit(n))) for n in (".gitignore", "~$a.docx", "THUMBS.DB", "draft.tmp", "a.bak")] == [True, True, True, False, False]
    errors = ("Rate limit, try again", "HTTP 503", "credit balance is low", "reached your limit, 429", "please Log In", "login timed out", "bad json")
    assert [one(spark, phrases.classify_error(F.lit(e))) for e in errors] == ["transport", "transport", "unavailable_quota", "unavailable_quota", "unavailable_login", "unavailable_login", "refused"]
    reason = lambda name, body, table=False: one(spark, phrases.skip_reason(F.lit(name), F.lit(body), F.lit(table)))
    assert [reason(n, "x" * 40) for n in ("Plaća-05.xlsx", "PLAĆE.docx", "Ugovor-o-radu.docx", "bolovanje.pdf", "Šablona.docx", "predložak.md", "salary.md")] == ["personal"] * 4 + ["template"] * 2 + [None]
    assert [reason("a.md", "  \n" + "x" * 29), reason("a.csv", "x", True), reason("a.csv", "\n\t", True)] == ["too_short", None, "too_short"]
    assert one(spark, text.content_words(F.lit("Mora li Cijena biti čišćenje over 12345 this"))) == ["12345", "cijen", "cisce", "over", "this"]


def test_search_folds_accents(spark):
    docs = spark.createDataFrame([("a", "Cijéna čelika"), ("b", "plain"), ("c", "CIJENA"), ("d", "n"), ("e", "m"), ("f", "k")], "id string, text string")
    assert one(spark, search.terms(F.lit("Čaša, ÉTÉ Z\u030c đak Й1"))) == ["casa", "ete", "z", "đak", "и1"]
    assert {r["id"] for r in search.bm25(docs, "cijena", {"text": 1.0}).collect()} == {r["id"] for r in search.bm25(docs, "ČIJENÄ", {"text": 1.0}).collect()} == {"a", "c"}


def test_gate_on_bytes(spark):
    docs = spark.createDataFrame([("d", "é one  two\nthree one")], "id string, text string")
    spans = [(0, 2, "é", "ok"), (1, 2, "é", "not_a_boundary"), (3, 11, "one two", "ok"), (3, 11, "one", "mismatch"), (5, 99, "x", "out_of_range"), (-1, 2, "é", "out_of_range")]
    rows = spark.createDataFrame([("d", *s) for s in spans] + [("e", 0, 1, "x", "no_document")], "document_id string, start_byte long, end_byte long, quote string, want string")
    for r in evidence.verify(rows, docs).collect():
        assert r["verdict"] == r["want"], r
    quotes = spark.createDataFrame([("d", "one\ntwo"), ("d", "one"), ("d", "none")], "document_id string, quote string")
    assert {r["quote"]: (r["n_hits"], r["located"]) for r in evidence.locate(quotes, docs).collect()} == {"one\ntwo": (1, 2), "one": (2, None), "none": (0, None)}


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_graph(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w")])
    starts = spark.createDataFrame([("a",)], "start string")
    assert {(r["node"], r["distance"]) for r in graph.reach(e, starts).collect()} == {("b", 1), ("c", 1), ("d", 2)}
    assert {(r["node"], r["distance"]) for r in graph.reach(e, starts, most=1).collect()} == {("b", 1), ("c", 1)}
    assert {(r["node"], r["component"]) for r in graph.cycles(e).collect()} == {("c", "c"), ("d", "c"), ("x", "x"), ("y", "x"), ("z", "x")}
    tree = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    assert {(r["node"], r["level"]) for r in graph.levels(tree).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    proposed = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "a", "c"), (5, "q", "a")], "ordinal long, from_id string, to_id string")
    assert sorted(r["ordinal"] for r in graph.acyclic(proposed).collect()) == [1, 2, 4, 5]


def test_acyclic_against_brute_force(spark):
    r = random.Random(4)
    rows = [(k, f"n{r.randrange(12)}", f"n{r.randrange(12)}") for k in range(60)]
    kept, want = [], []
    for k, a, b in rows:
        reach, todo = set(), [b]
        while todo:
            n = todo.pop()
            if n not in reach:
                reach.add(n)
                todo += [y for x, y in kept if x == n]
        if a not in reach:
            kept.append((a, b))
            want.append(k)
    df = spark.createDataFrame([x for x in rows if x[1] != x[2]], "ordinal long, from_id string, to_id string")
    assert sorted(x["ordinal"] for x in graph.acyclic(df).collect()) == want


def test_consolidation(spark):
    claims = [(1, "rule", "Rok", "Rok je 48 sati", "a", 1, "q1", "rule:rok"), (2, "rule", "Rok", "Rok je 24 sati", "b", 2, "q2", "rule:rok"), (3, "rule", "rok", "odmah", "c", 1, "q2", "rule:rok"), (4, "rule", "Rok", "Rok je 24 sati", "d", 2, "q3", "rule:rok")]
    df = spark.createDataFrame(claims, "ordinal long, kind string, title string, statement string, document string, modified long, quote string, key string")
    got = consolidate(df).first()
    assert (got["body"], got["n_claims"], got["n_evidence"], got["n_disagree"], got["n_agree"]) == ("Rok je 24 sati", 4, 4, 1, 3)


def test_hints_lose_nothing_to_blocking(spark):
    r = random.Random(2)
    words = ["discount", "policy", "service", "invoice", "price", "anvil", "return", "terms"]
    rows = [(f"rule:{i}", "rule", " ".join(r.sample(words, r.randint(1, 3))), " ".join(r.sample(words, 4)), i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, kind string, title string, body string, n_disagree long")
    got = {(x["left_id"], x["right_id"]): x["score"] for x in similar.hints(df).collect()}

    def stems(s):
        return {w[:5] for w in s.split() if len(w) >= 4}

    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                ta, tb, ba, bb = stems(a[2]), stems(b[2]), stems(a[3]), stems(b[3])
                small = min(len(ta), len(tb))
                title = len(ta & tb) / small if small >= 2 else len(ta & tb) / len(ta | tb)
                score = round(0.65 * title + 0.35 * len(ba & bb) / len(ba | bb), 6)
                if score >= 0.5:
                    want[a[0], b[0]] = score
    assert got == pytest.approx(want)


def test_search_prefers_titles_and_ignores_unknown_words(spark):
    df = spark.createDataFrame([("a", "cold anvil", "iron"), ("b", "hot rod", "an anvil"), ("c", "gear", "wheel"), ("d", "ring", "gold"), ("e", "", None)], "id string, title string, body string")
    got = [r["id"] for r in search.top(search.bm25(df.fillna(""), "the ANVIL?", {"title": 4.0, "body": 1.0}), 5).collect()]
    assert got == ["a", "b"]
    assert search.bm25(df.fillna(""), "?", {"title": 4.0, "body": 1.0}).collect() == []


def test_transitions(spark):
    old = spark.createDataFrame([("a", "s1", 1), ("b", "s1", 1)], "id string, source string, n long")
    new = spark.createDataFrame([("b", "s2", 2), ("c", "s2", 2)], "id string, source string, n long")
    assert sorted(map(tuple, transitions.upsert(old, new, "id", ["source"]).collect())) == [("a", "s1", 1), ("b", "s1", 2), ("c", "s2", 2)]
    rel = spark.createDataFrame([("a", "b", "uses"), ("c", "b", "uses"), ("c", "a", "uses")], "from_id string, to_id string, type string")
    merged = transitions.merge_pairs(rel, spark.createDataFrame([("a", "b")], "keep string, drop string"))
    assert sorted(map(tuple, merged.collect())) == [("c", "a", "uses")]
    objects = spark.createDataFrame([("a", "proposed", "body", 1, 1), ("b", "proposed", "", 1, 1), ("c", "proposed", "x", 0, 1)], "id string, status string, body string, n_evidence long, version long")
    d = spark.createDataFrame([("a", "approve"), ("b", "approve"), ("c", "reject")], "id string, decision string")
    assert sorted((r["id"], r["status"], r["version"]) for r in transitions.approve(objects, d).collect()) == [("a", "approved", 2), ("b", "proposed", 1), ("c", "rejected", 1)]


def test_sources_cases_and_settings(spark):
    log = [("a", 0, "remove", None), ("a", 1, "put", "A"), ("a", 2, "pause", None), ("a", 3, "scanned", None), ("a", 4, "put", "B"), ("b", 1, "put", "x"), ("b", 2, "remove", None), ("b", 3, "scanned", None), ("c", 1, "put", "c"), ("c", 2, "scanned", None), ("c", 3, "remove", None), ("d", 1, "scanned", None)]
    got = transitions.fold_sources(spark.createDataFrame(log, "source_id string, seq long, command string, name string"))
    assert sorted(map(tuple, got.collect())) == [("a", "B", "paused", 3), ("b", "x", "active", 3), ("c", "c", "removed", 2)]
    log = [("k", 1, "close", None), ("k", 2, "open", None), ("k", 3, "record", "o"), ("k", 4, "close", None), ("k", 5, "close", None), ("k", 6, "open", None), ("k", 7, "record", "o"), ("m", 1, "record", "o")]
    got = transitions.fold_cases(spark.createDataFrame(log, "case_id string, seq long, command string, object string"))
    assert list(map(tuple, got.collect())) == [("k", 2, 4, 2, 1)]
    got = transitions.last_settings(spark.createDataFrame([("x", "1", 1), ("x", None, 2), ("y", "3", 1)], "key string, value string, seq long"))
    assert sorted(map(tuple, got.collect())) == [("x", None), ("y", "3")]


def test_approvals_in_order(spark):
    """c uses b and b uses a: each approval makes what rests on it stale, unless that was approved later."""
    o = spark.createDataFrame([(x, "t", "proposed", 1, 1, False, 5) for x in "abc"] + [("d", "t", "approved", 0, 1, True, 5)], "id string, body string, status string, n_evidence long, version long, stale boolean, updated long")
    r = spark.createDataFrame([("a", "b", "used_by"), ("b", "c", "used_by"), ("a", "d", "conflicts_with")], "from_id string, to_id string, type string")
    d = spark.createDataFrame([("a", "A", "me", 10), ("b", "B", "me", 20), ("c", " ", "me", 30), ("d", "D", "me", 30)], "id string, body string, decided_by string, decided_at long")
    got = sorted(tuple(x) for x in transitions.approve_all(o, r, d).select("id", "body", "status", "version", "stale_since").collect())
    assert got == [("a", "A", "approved", 2, None), ("b", "B", "approved", 2, None), ("c", "t", "proposed", 1, 10), ("d", "t", "approved", 1, 5)]
    assert sorted(x["object_id"] for x in transitions.snapshots(o, d).collect()) == ["a", "b"]


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def xlsx(rows):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}"' + (' t="inlineStr"><is><t>' + v + "</t></is></c>" if isinstance(v, str) else f"><v>{v}</v></c>") for k, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="Prices" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_folder_to_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    content = {
        "policy.md": "# Terms\n\nFirst line\nsecond line\n\n## Rates\n- five\n- ten é\n".encode(), "prices.csv": 'Item;Price;"Note"\n\nAnvil 5";2,50;"a ""b"" c"\nRod;3;\n'.encode(), "old.txt": "Žbuka".encode("cp1250"),
        "a.docx": docx([("Heading1", "Service"), (None, "Within 24 hours")]), "b.xlsx": xlsx([["Item", "Price"], ["Rod", "3.0"], ["Gear", 4.0]]), ".env": b"KEY=1", "~$a.docx": b"x", "empty.md": b"", "x.bin": b"1", "bad.docx": b"no zip",
    }
    for name, raw in content.items():
        (tmp_path / "in" / name).write_bytes(raw)
    walked = files.walk(spark, str(tmp_path / "in")).cache()
    assert {r["name"]: r["reason"] for r in walked.collect() if r["reason"]}.items() >= {"~$a.docx": "noise", "x.bin": "unsupported"}.items()
    blocks = files.extract(walked).collect()
    by = {}
    for b in blocks:
        by.setdefault(b["path"].rpartition("/")[2], []).append(b)
    assert [(b["locator"], b["kind"], b["text"]) for b in by["policy.md"]] == [("§1", "heading", "Terms"), ("§1 ¶1", "paragraph", "First line second line"), ("§1.1", "heading", "Rates"), ("§1.1 ¶1", "item", "five"), ("§1.1 ¶2", "item", "ten é")]
    assert [(b["locator"], b["cells"]) for b in by["prices.csv"]] == [("row 3", ['Anvil 5"', "2,50", 'a "b" c']), ("row 4", ["Rod", "3", ""])]
    assert by["old.txt"][0]["text"] == "Žbuka" and by["bad.docx"][0]["error"]
    assert [(b["locator"], b["text"]) for b in by["a.docx"]] == [("§1", "Service"), ("§1 ¶1", "Within 24 hours")]
    assert [b["cells"] for b in by["b.xlsx"]] == [["Rod", "3.0"], ["Gear", "4"]]
    for rows in by.values():
        whole = "\n\n".join(b["text"] for b in rows if b["text"]).encode()
        assert all(whole[b["start_byte"] : b["end_byte"]].decode() == b["text"] for b in rows if b["text"])
    assert {r["extension"]: r["files"] for r in files.inventory(files.walk(spark, str(tmp_path / "in"), with_content=False)).collect()}["md"] == 1


def test_replies(spark, tmp_path):
    assert replies.first_object('x {bad {"a": {"b": "}"}} y') == '{"a": {"b": "}"}}' and replies.first_object("none") is None
    (tmp_path / "candidates-0.txt").write_text('Sure {"candidates":[{"kind":"rule","title":"T","statement":"S","quotes":["q"," "]},{"kind":"rule","title":" ","quotes":["q"]}]}')
    got = replies.candidates(replies.replay(spark.createDataFrame([("candidates-0",), ("candidates-1",)], "key string"), replies.recorded(spark, str(tmp_path))))
    assert [(r["key"], r["title"], r["quotes"]) for r in got.collect()] == [("candidates-0", "T", ["q"])]


def is_inside(x, lines):
    rest = iter(lines)
    return all(t in rest for t in x)


def test_packing(spark):
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["a", "é", "🎉", "\n\n", " "]) for _ in range(r.randint(0, 60)))
        parts = packing.chunk_text(t, 9)
        assert "".join(parts) == t and all(0 < len(p.encode()) <= 9 for p in parts)
    assert packing.chunk_text("aaa\n\nbbbbb", 8) == ["aaa\n\nbbb", "bb"] and packing.chunk_text("aaaa\n\nbbbb", 8) == ["aaaa\n\nbb", "bb"] and packing.chunk_text("aaaaa\n\nbbb", 8) == ["aaaaa\n\n", "bbb"]
    assert packing.diff_lines("a\nb\nc", "a\nx\nc") == [("same", "a"), ("del", "b"), ("add", "x"), ("same", "c")]
    for _ in range(120):
        a, b = (["".join(r.choice("abc")) for _ in range(r.randint(0, 9))] for _ in range(2))
        out = packing.diff_lines("\n".join(a), "\n".join(b))
        assert [t for c, t in out if c != "add"] == (a or [""]) and [t for c, t in out if c != "del"] == (b or [""])
        longest = max(k for k in range(10) for x in itertools.combinations(a or [""], k) if is_inside(x, b or [""]))
        assert sum(c == "same" for c, _ in out) == longest
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 5, 5, 20, 1])] + [("h", 0, 3)], "source string, doc_id long, bytes long")
    got = {(x["source"], x["doc_id"]): x["batch"] for x in order.pack(df, "source", "doc_id", "bytes", 10).collect()}
    assert got == {("g", 0): 0, ("g", 1): 0, ("g", 2): 1, ("g", 3): 2, ("g", 4): 3, ("h", 0): 0}


def test_streams(spark, tmp_path):
    rows = [("e1", k, False) for k in range(6)] + [("e1", 30, True), ("e1", 70, True), ("e2", 1, False)]
    df = spark.createDataFrame(rows, "engine string, t long, ok boolean").select("engine", F.timestamp_seconds("t").alias("ts"), "ok")
    df.coalesce(1).write.parquet(f"{tmp_path}/calls")
    calls = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/calls")
    feeds.drain(feeds.breaker(calls), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r["engine"], r["t"]): r["state"] for r in spark.read.parquet(f"{tmp_path}/out").withColumn("t", F.unix_timestamp("ts")).collect()}
    assert got == {**{("e1", k): "closed" for k in range(4)}, ("e1", 4): "open", ("e1", 5): "open", ("e1", 30): "open", ("e1", 70): "closed", ("e2", 1): "closed"}
    feeds.drain(feeds.breaker(calls), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)
