"""What supervises a build: communities of documents, the owner's quiz and its outcome, when relating may begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.evidence import locate
from stratalog.operators.order import running

#: Parts of names of invoices, and who decides by the quiz.
INVOICES, OWNER = ("inv", "invoice", "racun"), "owner:quiz"


def community_label(path: Column, name: Column) -> Column:
    """The folder that a document is in, and the class that its name shows."""
    parents = F.split(path, "/")
    parent = F.when(F.size(parents) >= 2, F.element_at(parents, F.size(parents) - 1)).otherwise("")
    low = F.lower(name)
    invoice = F.contains(low, F.lit(INVOICES[0]))
    for word in INVOICES[1:]:
        invoice = invoice | F.contains(low, F.lit(word))
    kind = F.when(invoice, " · invoices").when(F.endswith(low, F.lit(".xlsx")) | F.endswith(low, F.lit(".csv")), " · spreadsheets").when(F.endswith(low, F.lit(".pdf")), " · PDF")
    return F.concat(F.when(parent == "", "documents").otherwise(parent), F.coalesce(kind, F.lit("")))


def communities(documents: DataFrame) -> DataFrame:
    """(document_id, id, label) of documents (id, path, name); labels are numbered in their order."""
    labelled = documents.select(F.col("id").alias("document_id"), community_label(F.col("path"), F.col("name")).alias("label"))
    numbered = running(labelled.select("label").distinct().withColumn("all_", F.lit(0)), "all_", "label", {"k": "1"})
    return labelled.join(numbered.select("label", F.concat(F.lit("community:"), F.col("k").cast("string")).alias("id")), "label").select("document_id", "id", "label")


def quiz(proposed: DataFrame, documents: DataFrame, eligible: DataFrame, session: str) -> DataFrame:
    """(id, document_id, question, quote, object_id) of questions (ordinal, document_id, question, quote, object_id) that may be asked.

    The quote must stand in its document once, what is proposed must be open (``eligible`` has id), and a question is asked once
    a document: the first.  Questions are numbered in their order, without gaps.
    """
    there = locate(proposed.where(F.trim("quote") != ""), documents).where("located is not null").drop("n_hits", "located")
    able = eligible.select(F.col("id").alias("object_id"), F.lit(True).alias("able"))
    fit = there.join(able, "object_id", "left").where(F.col("object_id").isNull() | F.col("able"))
    columns = ("ordinal", "quote", "object_id")
    first = fit.groupBy("document_id", "question").agg(F.min_by(F.struct(*columns), "ordinal").alias("q")).select("document_id", "question", "q.*")
    placed = running(first.withColumn("all_", F.lit(0)), "all_", "ordinal", {"k": "1"})
    return placed.select(F.concat_ws(":", F.lit(session), F.col("k").cast("string"), F.col("ordinal").cast("string")).alias("id"), "document_id", "question", "quote", "object_id")


def confirm(objects: DataFrame, asked: DataFrame, approved: DataFrame) -> DataFrame:
    """``objects`` after the owner's answers: approved ids are approved, other ids that were asked about (object_id) and open are rejected."""
    yes = approved.select("id").distinct().withColumn("yes", F.lit(True))
    no = asked.where("object_id is not null").select(F.col("object_id").alias("id")).distinct().withColumn("no", F.lit(True))
    joined = objects.join(yes, "id", "left").join(no, "id", "left")
    chosen = F.coalesce("yes", F.lit(False))
    refused = ~chosen & F.coalesce("no", F.lit(False)) & (F.col("status") == "proposed")
    status = F.when(chosen, "approved").when(refused, "rejected").otherwise(F.col("status"))
    return joined.withColumn("decided_by", F.when(chosen | refused, OWNER)).withColumn("status", status).drop("yes", "no")


def may_relate(after_build: Column, phase: Column, quiz_state: Column) -> Column:
    """Whether relating may be queued: at once, or when the build is complete, by its phase or, before it has one, by its quiz."""
    return F.when(~after_build, True).when(phase.isNotNull(), phase == "complete").otherwise(F.coalesce(quiz_state == "confirmed", F.lit(False)))


def sessions(turns: DataFrame, finished: DataFrame) -> DataFrame:
    """(id, state, turn_count, started_at, finished_at) from turns (session, at) and endings (session, state, at); the last ending counts."""
    own = turns.groupBy(F.col("session").alias("id")).agg(F.count("*").alias("turn_count"), F.min("at").alias("started_at"), F.max("at").alias("last_at"))
    ends = finished.groupBy(F.col("session").alias("id")).agg(F.max_by(F.struct("state", F.col("at").alias("finished_at")), "at").alias("e"))
    joined = own.join(ends, "id", "left")
    ended = F.coalesce(F.col("e.finished_at") >= F.col("last_at"), F.lit(False))
    return joined.select("id", F.when(ended, F.col("e.state")).otherwise("active").alias("state"), "turn_count", "started_at", F.when(ended, F.col("e.finished_at")).alias("finished_at"))
