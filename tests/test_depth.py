"""Order, identity, the queue, raw search, files and streams against sequential brute force and written-out expectations."""

import io
import os
import random
import zipfile
import zlib
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from stratalog.operators import graph, match, order, queue, usage
from stratalog.operators.consolidate import anchored
from stratalog.sources import files, folder, pdf
from stratalog.streaming import changes, feeds, incremental


def test_anchors_equal_the_sequential_rule(spark):
    r = random.Random(3)
    claims = [(k, f"key{r.randrange(30)}", f"d{r.randrange(3)}", [r.choice(["A b", "«a  B»", "č d", "C d.", f"q{r.randrange(25)}"]) for _ in range(r.randint(0, 3))]) for k in range(150)]
    norm = lambda q: " ".join(q.lower().replace("č", "c").split()).strip("«».")
    seen, want = {}, {}
    for k, key, d, quotes in claims:
        key = next((seen[d, norm(q)] for q in quotes if (d, norm(q)) in seen), key)
        for q in quotes:
            seen.setdefault((d, norm(q)), key)
        want[k] = key
    df = spark.createDataFrame(claims, "ordinal long, key string, document string, quotes array<string>")
    assert {x["ordinal"]: x["key"] for x in anchored(df).collect()} == want
    assert any(want[k] != key for k, key, _, _ in claims)
    chain = [(k, f"k{k}", "d", [f"s{k - 1}", f"s{k}"]) for k in range(1, 60)]
    df = spark.createDataFrame(chain, "ordinal long, key string, document string, quotes array<string>")
    assert {x["key"] for x in anchored(df).collect()} == {"k1"}
    assert anchored(df.limit(0)).collect() == []


def greedy(sizes, most):
    used = batch = 0
    out = []
    for n in sizes:
        if used + n > most and used:
            used, batch = 0, batch + 1
        used += n
        out.append(batch)
    return out


def test_packing_equals_the_greedy_fold(spark):
    r = random.Random(1)
    rows = [(g, k, r.choice([0, 0, 1, 3, 9, 10, 11, 25])) for g in "abc" for k in range(200)] + [("one", k, 1 + k % 5) for k in range(20_000)] + [("z", 0, 0), ("y", 0, 99)]
    df = spark.createDataFrame(rows, "source string, doc_id long, bytes long")
    got = defaultdict(dict)
    for x in order.pack(df, "source", "doc_id", "bytes", 10).collect():
        got[x["source"]][x["doc_id"]] = x["batch"]
    for g in {x[0] for x in rows}:
        own = sorted((k, n) for h, k, n in rows if h == g)
        assert [got[g][k] for k, _ in own] == greedy([n for _, n in own], 10), g
    assert order.pack(df.limit(0), "source", "doc_id", "bytes", 10).collect() == []


def test_running_sums_of_one_large_group(spark):
    df = spark.createDataFrame([("g", k, k % 7) for k in range(5000)] + [("h", 1, 5)], "g string, k long, n long")
    got = {(x["g"], x["k"]): (x["before"], x["row"]) for x in order.running(df, "g", "k", {"before": "n", "row": "1"}).collect()}
    total = 0
    for k in range(5000):
        assert got["g", k] == (total, k)
        total += k % 7
    assert got["h", 1] == (0, 0)


def test_locators_equal_the_counter(spark):
    r = random.Random(8)
    rows, want = [], {}
    for d in range(40):
        sections = files.Sections()
        for k in range(r.randint(1, 40)):
            level = r.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])
            rows.append((f"d{d}", k, level or (None if r.random() < 0.5 else 0)))
            want[f"d{d}", k] = sections.heading(level) if level else sections.paragraph()
    df = spark.createDataFrame(rows, "document_id string, ordinal long, level int")
    assert {(x["document_id"], x["ordinal"]): x["locator"] for x in order.locators(df).collect()} == want


def test_paths_are_shortest_and_take_the_smallest_parent(spark):
    r = random.Random(5)
    edges = sorted({(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(70)} | {(f"m{k:02}", f"m{k + 1:02}") for k in range(30)})
    after = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    want = {}
    for start in ("n01", "n07", "m00", "lone"):
        distance, todo = {start: 0}, deque([start])
        while todo:
            x = todo.popleft()
            for y in after[x]:
                if y not in distance:
                    distance[y] = distance[x] + 1
                    todo.append(y)
        for x, n in distance.items():
            path = [x]
            while path[0] != start:
                path.insert(0, min(a for a, b in edges if b == path[0] and distance.get(a) == distance[path[0]] - 1))
            if n:
                want[start, x] = (n, path)
    starts = spark.createDataFrame([("n01",), ("n07",), ("m00",), ("lone",)], "start string")
    got = graph.paths(graph.reach_with_parents(spark.createDataFrame(edges, "src string, dst string"), starts)).collect()
    assert {(x["start"], x["node"]): (x["distance"], x["path"]) for x in got} == want


def test_search_syntax(spark):
    a, b, c = (match.Atom((x,)) for x in "abc")
    assert match.parse("a b OR c") == ("or", ("and", a, b), c)
    assert match.parse("a AND b NOT c") == ("and", a, ("not", b, c)) and match.parse("(a OR b) NOT c") == ("not", ("or", a, b), c)
    assert match.parse('"A  b"* č-d') == ("and", match.Atom(("a", "b"), True), match.Atom(("c", "d")))
    for wrong in ("", "AND", "a OR", "(a", "a)", '"a', "NOT a", "a * b"):
        with pytest.raises(ValueError):
            match.parse(wrong)
    r = random.Random(4)
    texts = [(k, " ".join(r.choice(["Alpha", "alpine", "beta", "gámma", "delta,"]) for _ in range(r.randint(0, 9)))) for k in range(80)] + [(90, None)]
    docs = spark.createDataFrame(texts, "id long, text string")
    words = {k: [w.strip(",").lower().replace("á", "a") for w in (t or "").split()] for k, t in texts}
    runs = lambda k, *ws: any(words[k][i : i + len(ws)] == list(ws) for i in range(len(words[k])))
    cases = {
        "gamma": lambda k: "gamma" in words[k], "alp*": lambda k: any(w.startswith("alp") for w in words[k]), '"alpha beta"': lambda k: runs(k, "alpha", "beta"),
        '"beta alp"*': lambda k: any(x == "beta" and y.startswith("alp") for x, y in zip(words[k], words[k][1:])), "alpha NOT beta": lambda k: "alpha" in words[k] and "beta" not in words[k],
        '(delta OR "beta beta") gamma': lambda k: ("delta" in words[k] or runs(k, "beta", "beta")) and "gamma" in words[k],
    }
    for raw, holds in cases.items():
        got = {x["id"] for x in match.match(docs, raw).collect()}
        assert got == {k for k in words if holds(k)} and got, raw


def test_old_holders_are_refused(spark):
    log = [
        ("enqueue", 0, None), ("lease", 0, None), ("lease", 30, None), ("heartbeat", 50, 1), ("lease", 100, None), ("lease", 110, None), ("heartbeat", 111, 1), ("finish", 112, 1),
        ("heartbeat", 113, 2), ("hold", 114, 2), ("release", 115, None), ("lease", 115, None), ("defer", 116, 3), ("lease", 117, None), ("lease", 200, None), ("finish", 201, 4), ("enqueue", 202, None),
    ]
    taken = [True, True, False, True, False, True, False, False, True, True, True, True, True, False, True, True, False]
    df = spark.createDataFrame([(7, k, c, at, g, "e") for k, (c, at, g) in enumerate(log)] + [(8, k, "defer" if k % 2 else "lease", 100_000 * k, (k + 1) // 2, "down") for k in range(1, 20)] + [(8, 0, "enqueue", 0, None, None)], "job long, seq long, command string, at long, generation long, error string")
    df = df.withColumn("command", F.when(F.expr("job = 8 and seq > 0"), F.expr("if(seq % 2 = 1, 'lease', 'defer')")).otherwise(F.col("command"))).withColumn("generation", F.expr("if(job = 8 and seq > 0, (seq + 1) div 2, generation)"))
    folded = queue.fold(df).collect()
    assert [x["accepted"] for x in sorted(folded, key=lambda x: x["seq"]) if x["job"] == 7] == taken
    last = {x["job"]: x for x in queue.final(queue.fold(df)).collect()}
    assert (last[7]["state"], last[7]["attempts"], last[7]["generation"], last[7]["refused"]) == ("done", 3, 4, 6)
    assert (last[8]["state"], last[8]["attempts"], last[8]["last_error"]) == ("dead", 6, "down")
    now = [x for x in folded if x["job"] == 8 and x["seq"] == 2][0]
    assert now["run_after"] == 200_000 + 10 + 8 % 10


def test_claims_take_the_most_urgent(spark):
    rows = [(k, "queued", 0, 0, None, k, 1) for k in range(5)] + [(9, "leased", 1, 1, 50, 0, 0), (10, "leased", 1, 1, 500, 0, 0), (11, "done", 1, 1, None, 0, 0)]
    jobs = spark.createDataFrame(rows, "job long, state string, attempts long, generation long, lease_until long, run_after long, priority long")
    got = {x["job"]: (x["state"], x["generation"], x["lease_until"]) for x in queue.claim(jobs, 100, 3).collect()}
    assert got == {9: ("leased", 2, 160), 0: ("leased", 1, 160), 1: ("leased", 1, 160), 2: ("queued", 0, None), 3: ("queued", 0, None), 4: ("queued", 0, None), 10: ("leased", 1, 500), 11: ("done", 1, None)}


def test_usage_of_any_depth(spark):
    deep = '{"input_tokens": 3}'
    for _ in range(12):
        deep = '{"payload": ' + deep + "}"
    rows = [
        (1, deep, None), (2, '{"usage": {"output_tokens": 4}}\n{"usage": {"output_tokens": 6}}', '{"model": "ab"}'), (3, None, None), (4, '{"input_tokens": true, "model": 7}', "[]"),
        (5, '{\n "total_cost_usd": 0.5,\n "usage": {"cached_input_tokens": 2, "cache_tokens": 5}\n}', None), (6, '{"input_tokens": 1e2}', '{"input_tokens": -1, "prompt_tokens": 8}'),
    ]
    got = {x["id"]: tuple(x)[1:] for x in usage.scrape(spark.createDataFrame(rows, "id long, stdout string, stderr string")).collect()}
    assert got == {1: (3, None, None, None, None), 2: (None, 6, None, None, None), 5: (None, None, 7, 0.5, None), 6: (8, None, None, None, None)}


def test_a_batch_that_fails_is_repeated(spark, tmp_path):
    schema = "ordinal long, kind string, title string, statement string, document string, modified long, quote string, key string"
    claim = lambda k, d, m, t="t": (k, "fact", t, f"{k} eur", d, m, f"q{k}", f"fact:{k % 3}")
    parts = [[claim(k, "a", 1) for k in range(4)], [claim(k, "b", 2) for k in range(5)], [claim(k, "a", 3, "new") for k in range(2)]]
    failed = []

    def fail_once(number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("after writing")

    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        try:
            incremental.read_in(stream, f"{tmp_path}/store", f"{tmp_path}/state", fail_once)
        except Exception:
            incremental.read_in(stream, f"{tmp_path}/store", f"{tmp_path}/state", fail_once)
    assert failed == [1]
    rows = incremental.stored(spark, f"{tmp_path}/store", schema)
    assert sorted(map(tuple, rows.collect())) == sorted(parts[1] + parts[2])
    groups, n = incremental.settle(spark, f"{tmp_path}/store", schema)
    assert n == 7 and {x["id"]: x["n_claims"] for x in groups.collect()} == {"fact:0": 3, "fact:1": 3, "fact:2": 1}
    assert incremental.settle(spark, f"{tmp_path}/store", schema, n) == (None, 7)


def test_change_feed_is_the_same_when_replayed(spark, tmp_path):
    rows = [("a", 1, 1, "r1"), ("a", 2, 3, "r2"), ("a", 2, 2, "r9"), ("a", 5, 4, "r2"), ("a", 9, 5, "r3"), ("a", 13, 6, "r2"), ("b", 4, 7, "x"), ("b", 30, 8, "x"), ("", 1000, 9, "")]
    d = spark.createDataFrame(rows, "source string, t long, place long, revision string").select("source", F.timestamp_seconds("t").alias("ts"), "place", "revision")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    for turn in range(2):
        stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
        changes.with_rocks(spark, lambda s=stream, t=turn: feeds.drain(changes.notices(s), f"{tmp_path}/out{t}", f"{tmp_path}/state{t}"))
        out = spark.read.schema(changes.NOTICES).parquet(f"{tmp_path}/out{turn}").where("source <> ''")
        got.append(sorted((x["source"], x["t"], x["revision"]) for x in out.withColumn("t", F.unix_timestamp("at")).collect()))
    assert got[0] == got[1] == [("a", 4, "r2"), ("a", 12, "r3"), ("a", 16, "r2"), ("b", 4, "x")]


def test_watched_folders_and_quiet(spark, tmp_path):
    os.makedirs(f"{tmp_path}/docs/deep")
    for name, text in (("a.md", "x"), ("deep/b.txt", "yy")):
        with open(f"{tmp_path}/docs/{name}", "w") as f:
            f.write(text)
    listing = lambda: feeds.drain(feeds.watched_files(spark, f"{tmp_path}/docs"), f"{tmp_path}/seen", f"{tmp_path}/state")
    listing()
    with open(f"{tmp_path}/docs/c.md", "w") as f:
        f.write("zzz")
    listing()
    seen = spark.read.parquet(f"{tmp_path}/seen").collect()
    assert sorted((x["path"].rsplit("/", 1)[1], x["bytes"]) for x in seen) == [("a.md", 1), ("b.txt", 2), ("c.md", 3)]
    times = [("s", 0), ("s", 2), ("s", 4), ("s", 9), ("t", 1), ("end", 100)]
    d = spark.createDataFrame(times, "source string, t long").select("source", F.timestamp_seconds("t").alias("ts"))
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    feeds.drain(feeds.quiet_sessions(stream, late="0 seconds"), f"{tmp_path}/bursts", f"{tmp_path}/state2")
    out = spark.read.parquet(f"{tmp_path}/bursts").select("source", F.unix_timestamp("start").alias("a"), F.unix_timestamp("end").alias("b"), "changes").where("source <> 'end'")
    assert sorted(map(tuple, out.collect())) == [("s", 0, 7, 3), ("s", 9, 12, 1), ("t", 1, 4, 1)]
    listed = spark.createDataFrame([("old", 0), ("edge", 97), ("new", 98), ("future", 500)], "name string, t long").withColumn("modified", F.timestamp_seconds("t"))
    now = spark.range(1).select(F.timestamp_seconds(F.lit(100))).first()[0]
    assert {x["name"] for x in files.settled(listed, now).collect()} == {"old", "edge"}


# files


def make_zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = make_zip({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Naslov1"/></w:pPr><w:r><w:t>Uvjeti</w:t></w:r></w:p><w:p><w:r><w:t>Rok je</w:t><w:tab/><w:t>14 dana</w:t></w:r></w:p><w:p/></w:body></w:document>'})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = make_zip({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Cijene" r:id="r1"/><sheet name="Rabat" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Stavka</t></si><si><t>Pumpa</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>12.0</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Popust</t></is></c></row><row r="2"><c r="A2"><v>5.5</v></c></row></sheetData></worksheet>',
})


def make_pdf(*pages, extra=b"", packed=False):
    """Pages of content streams over a font with a table for two-byte codes (F2), and one with differences (F1)."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <010D> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (b" ".join(b"%d 0 R" % (6 + 2 * k) for k in range(len(pages))), len(pages)),
               b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /ccaron /zcaron /dcroat /Euro] >> >>", b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"]
    out = b"%PDF-1.5\n"
    if packed:
        heads, body = [], b""
        for k, o in enumerate(objects, 1):
            heads.append(b"%d %d" % (k, len(body)))
            body += o + b" "
        head = b" ".join(heads) + b" "
        z = zlib.compress(head + body)
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(objects), len(head), len(z), z)
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % (k, o) for k, o in enumerate(objects, 1))
    out += b"5 0 obj << /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    for k, content in enumerate(pages):
        z = zlib.compress(content)
        out += b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n%d 0 obj << /Filter /FlateDecode /Length 999 >>\nstream\n%s\nendstream endobj\n" % (6 + 2 * k, 7 + 2 * k, 7 + 2 * k, z)
    return out + b"trailer << /Root 1 0 R %s >>\n%%%%EOF" % extra


PAGES = (
    b"BT /F1 10 Tf 72 700 Td (Ponuda vrijedi) Tj 0 -12 Td [(14) -250 (da) 20 (na \\(od\\) izdavanja.)] TJ 0 -30 Td (Pla\\001anje) Tj 80 0 Td (<\\004 5) Tj ET",
    b"BT /F2 12 Tf 1 0 0 1 10 500 Tm <00010010> Tj <00110012> ' ET % note\nBT /F1 9 Tf 10 400 Td (caf\\351 \\\n\\\\) Tj ET",
)
PDF = [("page 1, ¶1", "Ponuda vrijedi 14 dana (od) izdavanja."), ("page 1, ¶2", "Plačanje <€ 5"), ("page 2, ¶1", "čabc"), ("page 2, ¶2", "café \\")]


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text(packed):
    out = files.parse_pdf(make_pdf(*PAGES, packed=packed))
    assert [(b["locator"], b["text"]) for b in out.blocks] == PDF
    assert all(out.text().encode()[b["start_byte"] : b["end_byte"]].decode() == b["text"] for b in out.blocks)
    for raw, why in ((make_pdf(b"0 0 m 5 5 l S"), "no_text"), (make_pdf(*PAGES, extra=b"/Encrypt << >>"), "encrypted"), (b"nothing", "not a PDF")):
        with pytest.raises(ValueError, match=why):
            files.parse("x.pdf", raw)
    assert pdf.letter("Zcaron") == "Ž" and pdf.letter("uni20AC") == "€" and pdf.letter("nosuch") == ""


def test_folder_source_gives_the_written_out_blocks(spark, tmp_path):
    root = f"{tmp_path}/in"
    content = {
        "a/Pravilnik.md": "uvod\n\n# Popusti\n\nRedovni kupci\nimaju 5%.\n\n### Iznimke\n- prva\n2) druga\n", "a/stari.txt": "Plaćanje odmah".encode("cp1250"), "b/cjenik.csv": 'Šifra;Stavka;Cijena\n\nA1;"Pumpa 3/4"" kratka";12,50\nA2; 1/2" koljeno ;3\n',
        "b/t.tsv": "x\ty\n1,5;2\t3\n", "c/uvjeti.docx": DOCX, "c/cijene.xlsx": XLSX, "c/ponuda.pdf": make_pdf(*PAGES), "c/bad.docx": b"no zip", "c/scan.pdf": make_pdf(b""), ".git": b"x", "~$a.docx": b"x", "id_rsa": b"x", "empty.md": b"", "pic.png": b"x",
    }
    rows = [(k, v.encode() if isinstance(v, str) else v) for k, v in content.items()]
    folder.write_files(spark.createDataFrame(rows, "path string, content binary"), root)
    got = sorted(folder.read_blocks(spark, root, partitionBytes=500).collect(), key=lambda x: (x["path"], x["ordinal"] or 0))
    want = [
        ("a/Pravilnik.md", "¶1", "paragraph", "uvod", 0), ("a/Pravilnik.md", "§1", "heading", "Popusti", 6), ("a/Pravilnik.md", "§1 ¶1", "paragraph", "Redovni kupci imaju 5%.", 15),
        ("a/Pravilnik.md", "§1.1.1", "heading", "Iznimke", 40), ("a/Pravilnik.md", "§1.1.1 ¶1", "item", "prva", 49), ("a/Pravilnik.md", "§1.1.1 ¶2", "item", "druga", 55),
        ("a/stari.txt", "¶1", "paragraph", "Plaćanje odmah", 0), ("b/cjenik.csv", "row 3", "row", 'A1 | Pumpa 3/4" kratka | 12,50', 0), ("b/cjenik.csv", "row 4", "row", 'A2 | 1/2" koljeno | 3', 32),
        ("b/t.tsv", "row 2", "row", "1,5;2 | 3", 0), ("c/bad.docx", None, None, None, None),
        ("c/cijene.xlsx", "Cijene row 3", "row", "Pumpa |  | 12", 0), ("c/cijene.xlsx", "Rabat row 2", "row", "5.5", 15),
        *(("c/ponuda.pdf", at, "paragraph", t, n) for (at, t), n in zip(PDF, (0, 40, 58, 65), strict=True)), ("c/scan.pdf", None, None, None, None),
        ("c/uvjeti.docx", "§1", "heading", "Uvjeti", 0), ("c/uvjeti.docx", "§1 ¶1", "paragraph", "Rok je\t14 dana", 8),
    ]
    assert [tuple(x[c] for c in ("path", "locator", "kind", "text", "start_byte")) for x in got] == want
    assert all(x["end_byte"] - x["start_byte"] == len(x["text"].encode()) for x in got if x["text"])
    assert [x["cells"] for x in got if x["path"] == "c/cijene.xlsx"] == [["Pumpa", "", "12"], ["5.5"]]
    skipped = folder.read_blocks(spark, root, skipped=True).where("id is null").select("path", "error").collect()
    assert {(x["path"], x["error"]) for x in skipped} == {(".git", "noise"), ("~$a.docx", "noise"), ("id_rsa", "secret"), ("empty.md", "empty"), ("pic.png", "unsupported")}
    parts = folder.BlockReader({"path": root, "partitionbytes": "500"}).partitions()
    assert len(parts) > 3 and sorted(n for p in parts for n, _ in p.names) == sorted(set(content) - {".git", "~$a.docx", "id_rsa", "empty.md", "pic.png"})


def test_file_sink_stays_below_its_folder_and_replaces(spark, tmp_path):
    one = lambda p, c: spark.createDataFrame([(p, c)], "path string, content string")
    folder.write_files(one("x/y.md", "first"), f"{tmp_path}/out")
    folder.write_files(one("x/y.md", "second"), f"{tmp_path}/out")
    assert [x["text"] for x in folder.read_blocks(spark, f"file://{tmp_path}/out").collect()] == ["second"]
    assert os.listdir(f"{tmp_path}/out/x") == ["y.md"]
    for path in ("../out.md", "/etc/x", "a/../../b"):
        with pytest.raises(Exception, match="below the folder"):
            folder.write_files(one(path, "x"), f"{tmp_path}/out")
