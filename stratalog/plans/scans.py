"""Queries over walks of real folders and over writing: inventories, rescans, documents put, the gate, reviews with their sides."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalog.functions import text
from stratalog.operators import put, scan, search
from stratalog.operators.graph import shared_folder
from stratalog.plans.registry import query
from stratalog.sources import files, folder

NAMES = "'d' || num % 10 || '/' || name"
EXTRA = "CASE WHEN num % 7 = 0 THEN 'copies/' || name END"


def _written(lake, where: str = "true", copies: bool = True) -> str:
    """A new folder with the lake's documents under their names, some of them twice."""
    root = f"{shared_folder(lake.spark).rstrip('/')}/scan-{uuid.uuid4().hex}"
    d = lake.documents.where(where)
    own, again = F.concat(F.lit("d"), (F.col("num") % 10).cast("string"), F.lit("/"), "name"), F.when(F.col("num") % 7 == 0, F.concat(F.lit("copies/"), "name"))
    # one pass makes both, so that documents are found once
    folder.write_files(d.select(F.explode(F.array_compact(F.array(own, again))).alias("path"), F.col("text").alias("content")) if copies else d.select(own.alias("path"), F.col("text").alias("content")), root)
    return root


LISTED = "listed AS (SELECT num, name, kind, byte_len FROM lake_documents UNION ALL SELECT num, name, kind, byte_len FROM lake_documents WHERE num % 7 = 0)"


@query("folder_inventory", f"WITH RECURSIVE {LISTED} SELECT count(*) AS files, count(*) AS readable, sum(byte_len)::BIGINT AS bytes, count(*) - count(DISTINCT (lower(name), byte_len)) AS duplicates, count(*) FILTER (name LIKE '% (1).%') AS old_versions FROM listed WHERE byte_len > 0")
def folder_inventory(lake):
    """A folder's profile from its listing; no file is opened."""
    return scan.inventory(files.walk(lake.spark, _written(lake), with_content=False)).drop("newest")


@query("folder_types", f"WITH RECURSIVE {LISTED} SELECT upper(kind) AS label, true AS readable, count(*) AS files, sum(byte_len)::BIGINT AS bytes FROM listed WHERE byte_len > 0 GROUP BY kind")
def folder_types(lake):
    return scan.types(files.walk(lake.spark, _written(lake), with_content=False))


TEXTS = "kind IN ('md', 'txt') AND length(regexp_replace(text, '\\s', '', 'g')) > 0"


@query("rescan_digest", f"SELECT count(*) FILTER (num % 5 <> 1 AND num % 3 <> 0) AS changed, count(*) FILTER (num % 5 <> 1 AND num % 3 = 0 AND NOT gone) AS unchanged, count(*) FILTER (num % 5 <> 1 AND num % 3 = 0 AND gone) AS back, count(*) FILTER (num % 5 = 1 AND num % 3 = 0) AS gone FROM lake_documents WHERE {TEXTS}")
def rescan_digest(lake):
    """A second walk against what the first one stored: some files have gone since, others have come or come back."""
    d = lake.documents.where("kind in ('md', 'txt')")
    stored = d.where("num % 3 = 0").where(F.length(F.regexp_replace("text", r"\s", "")) > 0).select("id", F.col("name").alias("path"), "gone")
    found = folder.read_blocks(lake.spark, _written(lake, "kind in ('md', 'txt') and num % 5 <> 1")).where("error is null").select("id", "path").distinct()
    fates = scan.compare(found, stored)
    return fates.agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("changed", "unchanged", "back", "gone")])


@query("put_documents", "SELECT id, CASE WHEN num % 3 <> 0 THEN source_id ELSE 'walk' END AS source_id, CASE WHEN num % 2 = 0 THEN 'new/' || name ELSE name END AS path, CASE WHEN num % 3 <> 0 THEN byte_len ELSE byte_len + 1 END AS bytes, CASE WHEN num % 2 = 0 THEN false ELSE gone END AS gone, (SELECT count(*) FROM lake_blocks b WHERE b.document_id = d.id AND (num % 2 = 1 OR b.ordinal % 2 = 0)) AS blocks FROM lake_documents d WHERE num % 3 <> 0 OR num % 2 = 0")
def put_documents(lake):
    """Documents and blocks after a walk: first source and size stay, found ones are back, their blocks are replaced."""
    d, b = lake.documents, lake.blocks.select("document_id", "ordinal", "text")
    stored = d.where("num % 3 <> 0").select("id", "source_id", F.col("name").alias("path"), F.col("byte_len").alias("bytes"), "modified", "gone")
    found = d.where("num % 2 = 0").select("id", F.lit("walk").alias("source_id"), F.concat(F.lit("new/"), "name").alias("path"), (F.col("byte_len") + 1).alias("bytes"), (F.col("modified") + 1).alias("modified"))
    of = lambda docs: b.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    documents, blocks = scan.put_documents(stored, of(stored), found, of(found).where("ordinal % 2 = 0"))
    n = blocks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("blocks"))
    return documents.join(n, "id", "left").select("id", "source_id", "path", "bytes", "gone", F.coalesce("blocks", F.lit(0)).alias("blocks"))


# writing objects

BAD = "e.first_seen % 5 = 2"
DRAFTED = "num % 2 = 0"


def _put(lake):
    columns = ["id", "kind", "title", "body", "status", "version"]
    stored = lake.objects.where("num % 3 <> 0").select(*columns)
    drafts = lake.objects.where(DRAFTED).select("id", "kind", F.upper("title").alias("title"), "body", F.lit("proposed").alias("status"), F.lit(1).cast("long").alias("version"))
    spans = lake.evidence.select("object_id", "document_id", (F.col("start_byte") + F.when(F.col("first_seen") % 5 == 2, 1).otherwise(0)).alias("start_byte"), "end_byte", "quote")
    at = lambda df: spans.join(df.select(F.col("id").alias("object_id")), "object_id", "left_semi")
    relations = lake.relations.select("from_id", "to_id", "type", F.when(F.col("type") == "used_by", put.STRUCTURAL).otherwise("proposed").alias("origin"))
    old = put.Stored(
        stored, at(stored).withColumn("verified_against", F.lit("before")), search.postings(stored, {"title": 4.0, "body": 1.0}).select("id", "term", "frequency", "length"),
        relations,
    )
    uses = lake.relations.where("type = 'used_by'").select("from_id", F.reverse("to_id").alias("to_id"), "type")
    return old, drafts, at(drafts), uses


SAID = "TRY(decode(encode(d.text)[p.s + 1:p.end_byte]))"
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
WROTE = f"""spans AS (SELECT e.*, CASE WHEN {BAD} THEN e.start_byte + 1 ELSE e.start_byte END AS s FROM lake_evidence e),
judged AS (SELECT p.object_id, p.document_id, p.quote, CASE WHEN {SAID} IS NULL THEN 'not_a_boundary' WHEN {FLAT.format(SAID)} <> {FLAT.format("p.quote")} THEN 'mismatch' ELSE 'ok' END AS verdict
  FROM spans p JOIN lake_documents d ON d.id = p.document_id WHERE p.object_id IN (SELECT id FROM lake_objects WHERE {DRAFTED})),
bad AS (SELECT DISTINCT object_id FROM judged WHERE verdict <> 'ok'), good AS (SELECT id FROM lake_objects WHERE {DRAFTED} AND id NOT IN (SELECT object_id FROM bad))"""


@query("write_refusals", f"WITH RECURSIVE {WROTE} SELECT object_id, document_id, quote, verdict FROM judged WHERE verdict <> 'ok'")
def write_refusals(lake):
    """The spans that keep drafts from being written, and why."""
    _, _, evidence, _ = _put(lake)
    return put.refused(evidence, lake.documents)


@query("write_gate", f"""WITH RECURSIVE {WROTE} SELECT o.id, CASE WHEN g.id IS NOT NULL THEN upper(title) ELSE title END AS title, CASE WHEN g.id IS NOT NULL THEN 'proposed' ELSE status END AS status,
  (SELECT count(*) FROM lake_evidence e WHERE e.object_id = o.id) AS spans, (SELECT count(*) FROM lake_evidence e WHERE e.object_id = o.id AND g.id IS NOT NULL) AS checked FROM lake_objects o LEFT JOIN good g ON g.id = o.id WHERE num % 3 <> 0 OR g.id IS NOT NULL""")
def write_gate(lake):
    """Stored objects after drafts were put: a draft with one false span changes nothing, others replace text and evidence."""
    new = put.put(*_put(lake), lake.documents)
    n = new.evidence.groupBy(F.col("object_id").alias("id")).agg(F.count("*").alias("spans"), F.count_if(F.col("verified_against") != "before").alias("checked"))
    return new.objects.join(n, "id", "left").select("id", "title", "status", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("checked", F.lit(0)).alias("checked"))


@query("write_edges", f"WITH RECURSIVE {WROTE} SELECT from_id, to_id, type, CASE WHEN type = 'used_by' THEN 'structural' ELSE 'proposed' END AS origin FROM lake_relations WHERE type <> 'used_by' OR from_id NOT IN (SELECT id FROM good) UNION SELECT from_id, reverse(to_id), type, 'structural' FROM lake_relations WHERE type = 'used_by' AND from_id IN (SELECT id FROM good)")
def write_edges(lake):
    """Edges after the same: those that the text gave are made anew with their object, proposed ones stay."""
    return put.put(*_put(lake), lake.documents).relations.distinct()


# reviews

SIDES = """own AS (SELECT c.key AS id, c.document, max(modified) AS modified, arg_max(ordinal, (modified, -ordinal)) AS ordinal, arg_max(statement, (modified, -ordinal)) AS statement, arg_max(quote, (modified, -ordinal)) AS quote FROM lake_claims c JOIN lake_objects o ON o.id = c.key WHERE o.status IN ('proposed', 'conflicted') GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modified DESC, ordinal) AS side FROM own)"""


@query("review_items", f"WITH RECURSIVE {SIDES} SELECT p.id, CASE WHEN o.num % 2 = 0 THEN 'v2 ' || o.title END AS before, o.body AS after, p.side, d.name AS document, (p.ordinal % 7 * 5) || 'eur' AS value, p.statement, p.quote, p.side = 1 AS current FROM placed p JOIN lake_objects o ON o.id = p.id LEFT JOIN lake_documents d ON d.id = p.document WHERE o.status = 'conflicted' OR p.side = 1")
def review_items(lake):
    """What is open, what it said before, and each document's side of it with figure and quote."""
    claims = lake.claims.withColumn("value", text.first_figure(F.col("statement")))
    version = lambda k: lake.objects.where("num % 2 = 0").select(F.col("id").alias("object_id"), F.lit(k).alias("version"), F.concat(F.lit(f"v{k} "), "title").alias("body"))
    return put.review(lake.objects, claims, version(1).unionByName(version(2)), lake.documents.select(F.col("id").alias("document"), "name"))


CARD = 24


@query("company_resources", f"""WITH RECURSIVE parts AS (SELECT 'term' AS part, id, title FROM lake_objects WHERE status = 'approved' AND n_evidence > 0 AND kind = 'term'
UNION ALL SELECT 'rule', id, title FROM lake_objects WHERE status = 'approved' AND n_evidence > 0 AND kind = 'rule' AND id NOT IN (SELECT from_id FROM lake_relations)
UNION ALL SELECT 'open', id, title FROM lake_objects WHERE status IN ('proposed', 'conflicted') UNION ALL SELECT 'document', id, name FROM lake_documents WHERE NOT gone)
SELECT part, id, title FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) AS k FROM parts) WHERE k <= CASE part WHEN 'document' THEN 200 ELSE {CARD} END""")
def company_resources(lake):
    """The company's card: terms, standing rules, open questions, and documents, the first of each."""
    ok = lake.objects.where("status = 'approved' and n_evidence > 0")
    part = lambda name, df, title="title": df.select(F.lit(name).alias("part"), "id", F.col(title).alias("title"))
    rules = ok.where("kind = 'rule'").join(lake.relations.select(F.col("from_id").alias("id")), "id", "left_anti")
    cut = lambda df, k: df.orderBy("id").limit(k)
    parts = [(part("term", ok.where("kind = 'term'")), CARD), (part("rule", rules), CARD), (part("open", lake.objects.where("status in ('proposed', 'conflicted')")), CARD), (part("document", lake.documents.where("not gone"), "name"), 200)]
    out = [cut(df, k) for df, k in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
