"""Queries over real files: folders written from the lake's tables and read through the data source."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.graph import shared_folder
from stratalog.plans.registry import query
from stratalog.sources import folder


def _new_folder(lake) -> str:
    return f"{shared_folder(lake.spark).rstrip('/')}/folder-{uuid.uuid4().hex}"


#: Parts of one file.
ROWS = 200


def _parts(lake) -> DataFrame:
    p = lake.raw("part").select("p_partkey", "p_name", "p_brand", "p_type", F.floor(F.col("p_partkey") / ROWS).alias("file"))
    return p.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand", "p_type"))).alias("rows"))  # ROWS each at most


def _lines(each) -> Column:
    return F.array_join(F.transform("rows", each), "\n")


def _markdown(lake) -> DataFrame:
    """A heading, a section for each part under it, and a note before the first: every block kind of prose."""
    part = lambda x: F.concat(F.lit("\n## "), x["p_name"], F.lit("\n\n"), x["p_brand"], F.lit("\nis "), x["p_type"], F.lit("\n\n- number "), x["p_partkey"].cast("string"))
    text = F.concat(F.lit("a note\n\n# Parts "), F.col("file").cast("string"), F.lit("\n"), _lines(part), F.lit("\n"))
    return _parts(lake).select(F.concat(F.lit("notes/parts-"), F.col("file").cast("string"), F.lit(".md")).alias("path"), text.alias("content"))


def _tables(lake) -> DataFrame:
    row = lambda x: F.concat(x["p_partkey"].cast("string"), F.lit(';"'), x["p_name"], F.lit('; ""'), x["p_brand"], F.lit('"""; '), x["p_type"])
    text = F.concat(F.lit("key;name;type\n"), _lines(row), F.lit("\n\n"))
    return _parts(lake).select(F.concat(F.lit("tables/"), (F.col("file") % 10).cast("string"), F.lit("/parts-"), F.col("file").cast("string"), F.lit(".csv")).alias("path"), text.alias("content"))


FOLDER_SQL = f"""WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, p_partkey // {ROWS} AS file FROM part),
prose AS (SELECT file, -2 AS key, 0 AS k, 'a note' AS text, '¶1' AS locator, 'paragraph' AS kind FROM (SELECT DISTINCT file FROM p)
  UNION ALL SELECT file, -1, 0, 'Parts ' || file, '§1', 'heading' FROM (SELECT DISTINCT file FROM p)
  UNION ALL SELECT file, p_partkey, 0, p_name, '§1.' || n, 'heading' FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p_partkey) AS n FROM p)
  UNION ALL SELECT file, p_partkey, 1, p_brand || ' is ' || p_type, '§1.' || n || ' ¶1', 'paragraph' FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p_partkey) AS n FROM p)
  UNION ALL SELECT file, p_partkey, 2, 'number ' || p_partkey, '§1.' || n || ' ¶2', 'item' FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p_partkey) AS n FROM p)),
cells AS (SELECT file, p_partkey AS key, 0 AS k, p_partkey || ' | ' || p_name || '; "' || p_brand || '" | ' || p_type AS text, 'row ' || (1 + row_number() OVER (PARTITION BY file ORDER BY p_partkey)) AS locator, 'row' AS kind FROM p),
blocks AS (SELECT 'notes/parts-' || file || '.md' AS path, * FROM prose UNION ALL SELECT 'tables/' || file % 10 || '/parts-' || file || '.csv', * FROM cells),
placed AS (SELECT *, row_number() OVER w - 1 AS ordinal, sum(strlen(text) + 2) OVER w - strlen(text) - 2 AS start_byte FROM blocks WINDOW w AS (PARTITION BY path ORDER BY key, k ROWS UNBOUNDED PRECEDING))
SELECT path, ordinal, locator, kind, text, start_byte::BIGINT AS start_byte, (start_byte + strlen(text))::BIGINT AS end_byte FROM placed"""


@query("folder_blocks", FOLDER_SQL)
def folder_blocks(lake):
    """Markdown files and tables on disk, written by Spark, and their blocks by the real parsers."""
    root = _new_folder(lake)
    noise = lake.raw("region").select(F.concat(F.lit("notes/~$"), F.col("r_regionkey").cast("string"), F.lit(".md")).alias("path"), F.lit("lock").alias("content"))
    secret = lake.raw("region").select(F.concat(F.lit("keys/"), F.col("r_regionkey").cast("string"), F.lit(".pem")).alias("path"), F.lit("secret").alias("content"))
    folder.write_files(_markdown(lake).unionByName(_tables(lake)).unionByName(noise).unionByName(secret), root)
    return folder.read_blocks(lake.spark, root, partitionBytes=1 << 20).select("path", "ordinal", "locator", "kind", "text", "start_byte", "end_byte")


@query("folder_skips", "SELECT error AS reason, count(*) AS files FROM (SELECT unnest(['noise', 'secret', 'unsupported', 'no_text', 'empty']) AS error FROM region) GROUP BY 1")
def folder_skips(lake):
    """Why files aren't read: by their names, by their size, or because nothing is in them."""
    root = _new_folder(lake)
    names = (("~$a-{}.docx", "x"), ("b-{}.env", "x"), ("c-{}.bin", "x"), ("d-{}.md", "\n \n"), ("e-{}.txt", ""))
    rows = lake.raw("region").select(F.explode(F.array(*[F.struct(F.replace(F.lit(n), F.lit("{}"), F.col("r_regionkey").cast("string")).alias("path"), F.lit(c).alias("content")) for n, c in names])).alias("f")).select("f.*")
    folder.write_files(rows, root)
    return folder.read_blocks(lake.spark, root, skipped=True).groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("files"))


@query("documents_on_disk", "SELECT 'texts/' || doc_id || '.txt' AS path, 'doc:' || substr(sha256(text), 1, 16) AS id FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0")
def documents_on_disk(lake):
    """Every document as a text file; what is read back knows it by the same id."""
    root = _new_folder(lake)
    folder.write_files(lake.raw("documents").select(F.concat(F.lit("texts/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content")), root)
    return folder.read_blocks(lake.spark, root).where("error is null").select("path", "id").distinct()


@query("export_files", "SELECT o.kind, count(*) AS files, sum(1 + (length(trim(o.body)) > 0)::INT)::BIGINT AS blocks FROM lake_objects o WHERE o.status = 'approved' AND o.n_evidence > 0 GROUP BY o.kind")
def export_files(lake):
    """Approved objects with evidence as Markdown files, counted by what is then in the folder."""
    from stratalog.plans.knowledge import export_markdown

    root = _new_folder(lake)
    folder.write_files(export_markdown(lake), root)
    found = folder.read_blocks(lake.spark, root)
    return found.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("kind")).agg(F.count_distinct("path").alias("files"), F.count("*").alias("blocks"))
