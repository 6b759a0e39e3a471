"""Embeddings, the archive, components and the pipeline."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import embeddings, warc
from stratalog.llm.common import Scratch, components


def test_embedding_links_and_components(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + r.standard_normal(16) * (0.25 if i % 2 else 0.5)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    rows += [(400 + i, rows[7][1], rows[7][2]) for i in range(30)]  # copies
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, rows[7][1], None), (505, [], 1), (506, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    got = {x["vec_id"]: x for x in embeddings.near_duplicates(spark, df).collect()}
    good = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in rows if i not in (500, 501, 502, 503, 504, 505, 506)]
    link = {i: {j for j, w, m in good if j != i and m == lab and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, v, lab in good}
    low = {i: i for i in link}
    for _ in range(len(low)):
        new = {i: min([low[i], *(low[j] for j in js)]) for i, js in link.items()}
        if new == low:
            break
        low = new
    assert len(got) == len(rows)
    for i, js in link.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(js), low[i], low[i] == i)
    for i in range(500, 507):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embeddings.near_duplicates(spark, df.limit(0)).collect() == []


def test_count_is_calibrated():
    least = embeddings.calibrated_count()
    r = np.random.default_rng(0)
    apart = np.sqrt(2 - 2 * 0.93)
    hits = (np.abs(r.standard_normal((200_000, embeddings.LINES)) * apart) <= embeddings.WINDOW_DEVIATIONS * apart).sum(1)
    assert (hits >= least).mean() >= 0.9999 and least > embeddings.LINES // 2


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (6001, 6000)]
    out = components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["component"] for r in out.collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {6000: 6000, 6001: 6000}


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(2)
    bodies = [None, "", "<p>é</p>", "same " * 10, *("".join(r.choice("abc <>\n") for _ in range(50)) for _ in range(20))]
    rows = [(i, None if i % 7 == 0 else f"http://x/{i}\r\nEvil: 1", bodies[i % len(bodies)] if i % 3 else "same " * 10, "clash") for i in range(120)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string")


def test_archive_round_trip(spark, pages):
    rows, df = pages
    got = {r["page_id"]: r for r in warc.archive_pages(spark, df).collect()}
    first = {}
    for i, _, html, _ in rows:
        first.setdefault(html or "", i)
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        kind = "response" if first[html or ""] == i else "revisit"
        assert tuple(got[i])[1:] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else first[html or ""])
    assert warc.archive_pages(spark, df.limit(0)).collect() == []


def test_archive_stores_once_and_rebuilds_records(spark, pages):
    rows, df = pages
    headers, payloads = warc.write_archive(spark, df, Scratch(spark, "test"))
    assert payloads.count() == len({h or "" for _, _, h, _ in rows})
    assert all(hashlib.sha256(gzip.decompress(p["body"])).hexdigest() == p["sha256"] for p in payloads.collect())
    made = warc.records(headers, payloads).collect()
    assert sum(r["times"] for r in made) == len(rows)
    for r in made:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert int(lines["Content-Length"]) == len(block) - 4 and "Evil" not in lines
        if lines["WARC-Type"] == "response":
            assert block[:-4] == (rows[int(lines["WARC-Record-ID"].split(":")[2])][2] or "").encode()


def test_damaged_payload_is_noticed(spark, pages):
    headers, payloads = warc.write_archive(spark, pages[1], Scratch(spark, "test"))
    bad = payloads.withColumn("body", F.lit(bytearray(gzip.compress(b"other"))))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(headers, bad, Scratch(spark, "test")).collect()
    wrong = headers.withColumn("headers", F.regexp_replace("headers", "Digest: sha1:.", "Digest: sha1:-"))
    with pytest.raises(Exception, match="headers"):
        warc.read_archive(wrong, payloads, Scratch(spark, "test")).collect()


def test_repeated_and_null_pages(spark):
    df = spark.createDataFrame([(2, "u", "x"), (2, "u", "x"), (1, "u", "y"), (None, "u", "x"), (None, None, "z")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or -1) for r in warc.archive_pages(spark, df).collect())
    assert got == [(-1, "response", -1), (-1, "revisit", 2), (1, "response", -1), (2, "response", -1), (2, "response", -1)]


def test_many_records_of_one_payload(spark):
    """Records without ids, and one id at many addresses, share a payload that no task has all of."""
    rows = [(None, f"u{i}", "lost") for i in range(300)] + [(4, f"v{i}", "four") for i in range(300)] + [(4, "v0", "four")] * 300 + [(5, "w", "x" * 3_000_000), (6, "w", "four")]
    out = warc.archive_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    kinds = sorted({(r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in out})
    assert kinds == [(0, 4, "response", 0), (4, 4, "response", 0), (5, 3_000_000, "response", 0), (6, 4, "revisit", 4)]


def test_links_of_very_large_and_small_numbers(spark):
    rows = [(1, [1e200, 1e190]), (2, [1e200, 0.0]), (3, [1e-200, 1e-210]), (4, [0.0, 1e-320]), (5, [1e308, 1e308]), (5, [1e308, 1e308])]
    out = embeddings.near_duplicates(spark, spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, label string"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 1, 5), (5, 1, 5)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioubcdlmnr") for _ in range(r.randint(2, 8)))
    vocabulary = [word() for _ in range(500)]
    rows, labels = [], []
    for i in range(240):
        ws = [r.choice(vocabulary) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                ws.insert(r.randrange(50), r.choice(["wretch", "blockhead", "goofball"]))
        rows.append((i, " ".join(ws), "en" if i % 3 else "fr", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    clean = [x for x in rows if x[0] % 4]
    rows += [(1000 + i, x[1], "en", "s", 0) for i, x in enumerate(clean[:20])]
    rows += [(2000, None, "en", "s", None), (2001, "", None, None, 0), (2002, "write to ann@example.org today please", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = docs.collect()
        if k < 4:
            assert docs.columns == corpus_pipeline.NAMES
    ids = {n: {x["doc_id"] for x in v} for n, v in kept.items()}
    assert ids["toxicity"] == {x[0] for x in rows if not (x[0] < 240 and x[0] % 4 == 0)}
    assert ids["simhash_near_dup"] == {x[0] for x in clean} | {2000, 2002}
    assert next(x["text"] for x in kept["personal_data"] if x["doc_id"] == 2002) == "write to [EMAIL] today please"
    assert ids["mixing"] == ids["bpe_encode"] == ids["simhash_near_dup"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.select("doc_id", "ids_sha256").collect())) == sorted(str(x) for x in spark.read.parquet(f"{tmp_path}/out4").select("doc_id", "ids_sha256").collect())
