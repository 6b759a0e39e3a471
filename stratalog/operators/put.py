"""Writing objects with their evidence: every span is checked first, and one bad span refuses the whole object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators import search, transitions
from stratalog.operators.evidence import verify

#: Fixed value: where edges come from that the text itself gives; such edges are made anew with their object.
STRUCTURAL = "structural"


@dataclass
class Stored:
    objects: DataFrame  # id, kind, title, body, status, version
    evidence: DataFrame  # object_id, document_id, start_byte, end_byte, quote, verified_against
    postings: DataFrame  # id, term, frequency, length
    relations: DataFrame  # from_id, to_id, type, origin


def refused(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(object_id, document_id, quote, verdict) of the spans that keep their objects from being written."""
    return verify(evidence, documents).where("verdict <> 'ok'").select("object_id", "document_id", "quote", "verdict")


def put(old: Stored, drafts: DataFrame, evidence: DataFrame, relations: DataFrame, documents: DataFrame) -> Stored:
    """``old`` after ``drafts`` whose spans are all true are written; the others leave everything as it was.

    An object's evidence and postings are replaced, and of its outgoing edges those from the text; edges that were proposed or drawn
    stay.  What was checked is noted by the digest of the document's text.
    """
    bad = refused(evidence, documents).select(F.col("object_id").alias("id")).distinct()
    good = drafts.join(bad, "id", "left_anti")
    ids = good.select(F.col("id").alias("object_id"))
    digests = documents.select(F.col("id").alias("document_id"), F.sha2("text", 256).alias("verified_against"))
    spans = evidence.join(ids, "object_id", "left_semi").join(digests, "document_id").select(*old.evidence.columns)
    kept = old.relations.join(good.select(F.col("id").alias("from_id"), F.lit(STRUCTURAL).alias("origin")), ["from_id", "origin"], "left_anti").select(*old.relations.columns)
    fresh = relations.join(ids.withColumnRenamed("object_id", "from_id"), "from_id", "left_semi").withColumn("origin", F.lit(STRUCTURAL)).select(*old.relations.columns)
    return Stored(
        transitions.put_objects(old.objects, good),
        old.evidence.join(ids, "object_id", "left_anti").select(*old.evidence.columns).unionByName(spans),
        old.postings.join(good.select("id"), "id", "left_anti").unionByName(search.postings(good, {"title": 4.0, "body": 1.0}).select(*old.postings.columns)),
        kept.unionByName(fresh.join(kept, ["from_id", "to_id", "type"], "left_anti").select(*old.relations.columns)),
    )


def review(objects: DataFrame, claims: DataFrame, versions: DataFrame, names: DataFrame) -> DataFrame:
    """(id, before, after, side, document, value, statement, quote, current) of open objects, a row for each side.

    Sides are a conflict's documents, newest first, each with its newest claim; claims are (key, document, modified, ordinal, statement,
    quote, value), ``versions`` (object_id, version, body) what the object said before, and ``names`` (document, name).
    """
    open_ = objects.where("status in ('proposed', 'conflicted')").select("id", "status", F.col("body").alias("after"))
    before = versions.groupBy(F.col("object_id").alias("id")).agg(F.max_by("body", "version").alias("before"))
    newest = F.max_by(F.struct("modified", "ordinal", "statement", "quote", "value"), F.struct("modified", -F.col("ordinal"))).alias("c")
    own = claims.join(open_.select(F.col("id").alias("key")), "key", "left_semi").groupBy(F.col("key").alias("id"), "document").agg(newest).join(names, "document", "left")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("c.modified"), "c.ordinal")).alias("side")  # documents of one object
    sides = own.select("id", place, F.coalesce("name", "document").alias("document"), "c.value", "c.statement", "c.quote")
    joined = open_.join(sides, "id").where("status = 'conflicted' or side = 1").join(before, "id", "left")
    return joined.select("id", "before", "after", "side", "document", "value", "statement", "quote", (F.col("side") == 1).alias("current"))
