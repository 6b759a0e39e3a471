"""What the third review found: each of these failed before."""

from __future__ import annotations

from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F
from stratalog.lake import Lake
from stratalog.operators import match, scan, search, usage
from stratalog.plans import analytics, answers, folders, scans
from stratalog.sources import files, folder
from stratalog.streaming import changes

OBJECT = "id string, kind string, title string, body string, status string, n_evidence long, updated long"


@pytest.fixture
def unsettled(spark):
    """A lake in which nothing is approved."""
    rows = [("fact:a", "fact", "large anvil", "costs 5 eur", "conflicted", 2, 7), ("rule:b", "rule", "cold bolt", "costs 9 eur", "proposed", 1, 8)]
    return SimpleNamespace(spark=spark, objects=spark.createDataFrame(rows, OBJECT))


def test_export_of_nothing_is_an_empty_folder(unsettled):
    assert folders.export_files(unsettled).collect() == []


def test_search_titles_gives_titles_alone(unsettled):
    assert answers.search_titles(unsettled).collect() == []


def test_revision_of_nothing_is_null(unsettled):
    assert analytics.servable_revision(unsettled).collect()[0]["revision"] is None


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_by(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    return spark.read.parquet(f"{tmp_path}/in")


def test_raw_search_reads_texts_once_and_moves_none(spark, tmp_path):
    docs = read_by(spark, tmp_path, [(1, "a a a b"), (2, "A-a"), (3, ""), (4, None)], "id long, text string")
    parsed = match.parse('"a a" OR b')
    counts = match.counted(docs, {a: f"f{k}" for k, a in enumerate(match.atoms(parsed))})
    assert "Exchange" not in plan_of(counts)
    assert sorted(map(tuple, counts.collect())) == [(1, 4, 2, 1), (2, 2, 1, 0), (3, 0, 0, 0), (4, None, None, None)]
    assert "FileScan" not in plan_of(match.match(docs, '"a a" OR b'))


def test_prefixes_are_counted_in_the_scan(spark, tmp_path):
    docs = read_by(spark, tmp_path, [(1, "Licence to license; under"), (2, "unlicensed und"), (3, "licen")], "id long, text string")
    found = match.match(docs, "licen* und*")
    assert [x["id"] for x in found.collect()] == [1] and "FileScan" not in plan_of(found)


def test_revisions_of_an_interval_meet_before_python(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = changes.notices(spark.readStream.schema("source string, ts timestamp, place long, revision string").parquet(f"{tmp_path}/in"))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.index("TransformWithState") < plan.index("max_by")


def test_usage_is_read_where_it_is(spark):
    rows = [(1, '{"input_tokens": 1, "input_tokens": 2}', None), (2, '{"cost_usd": NaN}', '{"model": "abc"}'), (3, '\t{"payload": {"usage": null, "output_tokens": 3}} end', None)]
    got = usage.scrape(spark.createDataFrame(rows, "id long, stdout string, stderr string"))
    assert "Exchange" not in plan_of(got)
    assert sorted(map(tuple, got.collect())) == [(2, None, None, None, None, "abc"), (3, None, 3, None, None, None)]


def test_claims_are_made_over_all_tasks(spark):
    plan = plan_of(Lake(spark, "/root/testdata/sf0.001").claims)
    assert "REPARTITION_BY_NUM" in plan and plan.index("BroadcastHashJoin") < plan.index("REPARTITION_BY_NUM")


def test_words_are_counted_by_their_spaces(spark):
    texts = spark.createDataFrame([("",), (" ..\n",), ("one",), ("The  Čas,\nv2-b!",), (None,)], "text string").coalesce(1)
    words = texts.select(search.spaced(F.col("text")).alias("w"))
    assert [tuple(r) for r in words.select("w", search.n_words(F.col("w"))).collect()] == [("  ", 0), ("  ", 0), (" one ", 1), (" the cas v2 b ", 4), (None, None)]


def test_listing_is_what_sparks_reader_lists(spark, tmp_path):
    root = tmp_path / "in"
    for path in ("a.md", "d 1/č%20é.TXT", "d 1/e/f (1).csv", "d 1/e/empty.md", ".hidden/x.md", "d 1/_out/y.md", "_z=1/k.md", "d 1/.g.md", "nothing"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"" if "empty" in path else b"abc")
    (root / "bare/empty").mkdir(parents=True)
    listed, read = files.walk(spark, f"file://{root}", with_content=False), files.walk(spark, f"file://{root}").drop("content")
    assert "FileScan" not in plan_of(listed) and listed.dtypes == read.dtypes
    ms = F.date_trunc("millisecond", "modified")
    assert sorted(map(repr, listed.withColumn("modified", ms).collect())) == sorted(map(repr, read.withColumn("modified", ms).collect()))
    assert listed.count() == 5


def test_inventory_goes_through_the_listing_once(spark, tmp_path):
    rows = [("a (1).md", 3, 1), ("A (1).MD", 3, 2), ("b.exe", 9, 3), ("~$c.md", 1, 4)]
    found = read_by(spark, tmp_path, rows, "name string, bytes long, modified long")
    got = scan.inventory(found)
    assert plan_of(got).count("FileScan") == 1
    assert [r.asDict() for r in got.collect()] == [{"files": 3, "readable": 2, "bytes": 6, "duplicates": 1, "old_versions": 2, "newest": 2}]


def test_folder_to_walk_is_written_in_one_pass(spark, monkeypatch):
    written = []
    monkeypatch.setattr(folder, "write_files", lambda df, root: written.append(df))
    scans._written(Lake(spark, "/root/testdata/sf0.001"))
    assert plan_of(written[0]).count("FileScan") == 1
    names = [r["path"] for r in written[0].select("path").collect()]
    assert len(set(names)) == len(names) and 0 < sum(n.startswith("copies/") for n in names) < len(names) / 2


def test_types_open_no_file_and_list_none_on_the_driver(spark, tmp_path):
    for name in ("a.md", "B.MD", "c.exe", "plain"):
        (tmp_path / name).write_bytes(b"abc")
    got = scan.types(files.walk(spark, str(tmp_path), with_content=False))
    assert "FileScan" not in plan_of(got)
    assert sorted(map(tuple, got.collect())) == [("EXE", False, 1, 3), ("MD", True, 2, 6), ("no extension", False, 1, 3)]


def test_ranked_search_reads_texts_once_and_moves_none(spark, tmp_path):
    rows = [(1, "The ápple, the end", "x"), (2, "apple", "the"), (3, "nothing here", "at all"), (4, "", ""), (None, "apple", "y"), (6, None, "the")]
    docs = read_by(spark, tmp_path, rows, "id long, body string, title string")
    found = search.bm25(docs, "the apple", {"title": 2.0, "body": 1.0})
    assert "FileScan" not in plan_of(found)
    assert {r["id"] for r in found.collect()} == {1, 2, None, 6}
    assert search.bm25(docs, "a", {"title": 2.0, "body": 1.0}).collect() == []
    table = f"(SELECT * FROM '{tmp_path}/in/*.parquet' WHERE id IS NOT NULL)"
    want = duckdb.sql(f"SELECT * FROM {search.bm25_sql(table, 'the apple', {'title': 2.0, 'body': 1.0})}").fetchall()
    got = search.bm25(docs.where("id is not null"), "the apple", {"title": 2.0, "body": 1.0}).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
