"""What an agent is told: areas a question touches, whole answers with their sources, rows of tables cell by cell.

Only approved objects with evidence are served.  Open subjects are named and never answered, and what rests on something that
has changed says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions import phrases, text
from stratalog.operators import search
from stratalog.operators.evidence import block_at
from stratalog.operators.graph import reach

#: Why an object is named but not served.
UNSETTLED = {"conflicted": "two documents disagree and the owner has not chosen", "proposed": "waiting for the owner to approve it"}
#: Sentences of answers.
MATCHES = "matches what you asked"
NOTHING = "This company has not approved anything about that. Say so plainly — that answer is useful, because it tells the owner what is missing."
NEARBY = "\n\nThere is an unsettled question nearby, which the owner has not decided: "
MANY_FILES = (
    "Read from the company's own tables, cell by cell. More than one file has a row for this, newest file first — check with the owner which one is current before quoting an older one:\n\n"
)
ONE_FILE = "Read from the company's own table, cell by cell:\n\n"
#: Hits looked at, steps down to foundations, bytes around a quote.
HITS, STEPS, MARGIN = 16, 3, 240


def served(objects: DataFrame) -> DataFrame:
    return objects.where(phrases.gate(F.col("status"), F.col("n_evidence")) == "full")


def why_unsettled(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, why in UNSETTLED.items():
        out = F.when(status == name, why).otherwise(out)
    return out


def ranked_hits(objects: DataFrame, question: str, weights: dict[str, float], k: int = HITS) -> DataFrame:
    """(id, rank) of the k best hits."""
    best = search.top(search.bm25(objects, question, weights), k)
    return best.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))  # k rows


def areas(objects: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, title, kind, why, stale): hits that are served, and what they rest on within STEPS steps.

    What several hits rest on is given under the best of them.
    """
    good = served(objects)
    direct = hits.join(good.select("id", "title"), "id")
    below = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), direct.select(F.col("id").alias("start")), most=STEPS)
    under = below.join(direct.select(F.col("id").alias("start"), "rank", "title"), "start").groupBy(F.col("node").alias("id")).agg(F.min_by("title", "rank").alias("above"))
    found = direct.select("id", F.lit(MATCHES).alias("why")).unionByName(under.join(direct.select("id"), "id", "left_anti").select("id", F.concat(F.lit('"'), "above", F.lit('" rests on this')).alias("why")))
    return good.select("id", "title", "kind", "stale").join(found, "id")


def open_questions(objects: DataFrame, hits: DataFrame, question: str) -> DataFrame:
    """(id, subject, why) of unsettled objects that are hits or share a word with the question."""
    rows = objects.withColumn("why", why_unsettled(F.col("status"))).where("why is not null").join(hits.select("id", F.lit(True).alias("hit")), "id", "left")
    near = F.coalesce("hit", F.lit(False)) | F.coalesce(text.overlaps(F.lit(question), F.col("title")), F.lit(False))
    return rows.where(near).select("id", F.col("title").alias("subject"), "why")


def with_sources(evidence: DataFrame, documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, sources): each object's quotes with the document's name and the line that the quote begins on."""
    offsets = evidence.select("document_id", F.col("start_byte").alias("offset")).distinct()
    lines = block_at(offsets, blocks).groupBy("document_id", "offset").agg(F.min("ordinal").alias("line"))
    named = evidence.join(documents.select(F.col("id").alias("document_id"), "name"), "document_id", "left").withColumn("offset", F.col("start_byte")).join(lines, ["document_id", "offset"], "left")
    locator = F.concat(F.lit("line "), (F.coalesce("line", F.lit(-1)) + 1).cast("string"))
    one = F.struct("first_seen", F.coalesce("name", "document_id").alias("document"), locator.alias("locator"), "quote")
    return named.groupBy(F.col("object_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("sources"))


def answer(items: DataFrame, objects: DataFrame, relations: DataFrame, sources: DataFrame) -> DataFrame:
    """Items (id, role, why) as they are served: (id, title, kind, role, why, rests_on, stale, confidence, source, text).

    ``rests_on`` has the direct foundations; those of a primary that are not items themselves are named in its text.
    """
    below = relations.where("type in ('depends_on', 'derived_from')").select(F.col("from_id").alias("id"), F.col("to_id").alias("on")).distinct()
    held = items.select(F.col("id").alias("on"), F.lit(True).alias("held"))
    rests = below.join(held, "on", "left").groupBy("id").agg(F.array_sort(F.collect_list("on")).alias("rests_on"), F.array_sort(F.collect_list(F.when(F.col("held").isNull(), F.col("on")))).alias("missing"))
    o = items.join(served(objects), "id").join(rests, "id", "left").join(sources, "id", "left")
    primary = F.col("role") == "primary"
    head = F.when(primary, F.concat(F.lit("## "), "title")).otherwise(F.concat(F.lit("### "), "title", F.lit(" ("), "role", F.lit(") — "), F.coalesce("why", F.lit(""))))
    quoted = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("Source: "), s["document"], F.lit(" — "), s["locator"], F.lit("\n> "), s["quote"])), "\n\n")
    parts = [
        head, F.trim("body"), F.when(F.size("sources") > 0, quoted), F.when(F.col("stale"), "Something this rests on has changed."),
        F.when(primary & (F.size("missing") > 0), F.concat(F.lit("Also rests on: "), F.array_join("missing", ", "), F.lit("."))),
    ]
    first = F.element_at("sources", 1)
    return o.select(
        "id", "title", "kind", "role", "why", F.array_join(F.coalesce("rests_on", F.array().cast("array<string>")), ", ").alias("rests_on"), "stale",
        phrases.confidence_phrase(F.col("confidence")).alias("confidence"), F.concat_ws(" — ", first["document"], first["locator"], first["quote"]).alias("source"), F.concat_ws("\n\n", *parts).alias("text"),
    )


def nothing_found(objects: DataFrame, question: str) -> DataFrame:
    """One row: the sentence for a question that nothing approved answers, with unsettled subjects nearby."""
    near = objects.where(why_unsettled(F.col("status")).isNotNull() & F.coalesce(text.overlaps(F.lit(question), F.col("title")), F.lit(False)))
    names = near.select("title").distinct().agg(F.array_join(F.array_sort(F.collect_list("title")), ", ").alias("names"))
    return names.select(F.concat(F.lit(NOTHING), F.when(F.col("names") != "", F.concat(F.lit(NEARBY), "names", F.lit("."))).otherwise("")).alias("text"))


def search_answer(objects: DataFrame, question: str, weights: dict[str, float], limit: int = 5) -> DataFrame:
    """(place, id, text): titles found, best first; or, at place 0, the sentence that there is nothing."""
    hits = ranked_hits(objects, question, weights, 3 * limit).join(served(objects).select("id", "title"), "id").orderBy("rank").limit(limit)
    hits = hits.select(F.row_number().over(W.orderBy("rank")).alias("place"), "id", F.col("title").alias("text"))  # limit rows
    none = nothing_found(objects, question).select(F.lit(0).alias("place"), F.lit(None).cast("string").alias("id"), "text")
    counted = none.crossJoin(F.broadcast(hits.agg(F.count("*").alias("found"))))
    return hits.unionByName(counted.where("found = 0").drop("found"))


def access_answer(objects: DataFrame) -> DataFrame:
    """(id, access, text): the body of what is served, a sentence for what is not."""
    access = phrases.gate(F.col("status"), F.col("n_evidence"))
    quoted = F.concat(F.lit('"'), "title", F.lit('"'))
    open_ = F.concat(quoted, F.lit(" is not settled: "), why_unsettled(F.col("status")), F.lit(". Tell whoever asked that this is an open question at this company, and do not answer it yourself."))
    withheld = F.concat(quoted, F.lit(" is not something this company serves — it was replaced or refused."))
    return objects.select("id", access.alias("access"), F.when(access == "full", F.col("body")).when(access == "name_only", open_).otherwise(withheld).alias("text"))


def passages(evidence: DataFrame, documents: DataFrame, margin: int = MARGIN) -> DataFrame:
    """(object_id, document, quote, passage): each quote with the bytes around it, or none where the document is gone."""
    d = documents.select(F.col("id").alias("document_id"), F.col("name").alias("document"), "text", "gone")
    around = text.passage(F.col("text"), F.col("start_byte"), F.col("end_byte"), margin)
    return evidence.join(d, "document_id", "left").select("object_id", "document", "quote", F.when(~F.col("gone"), around).alias("passage"))


def cells_answer(rows: DataFrame) -> DataFrame:
    """One row for rows (place, document, modified, locator, columns, cells, line) of tables: the text with every cell under its column.

    Cells without as many column names are given as the line; rows of several files are told to be so.
    """
    cell = F.array_join(F.zip_with("columns", "cells", lambda c, v: F.concat(F.lit("  "), c, F.lit(": "), v, F.lit("\n"))), "")
    fits = (F.size("columns") == F.size("cells")) & (F.size("columns") > 0)
    piece = F.concat("document", F.lit(" ("), F.split_part(F.col("modified").cast("string"), F.lit("T"), F.lit(1)), F.lit(") — "), "locator", F.lit("\n"), F.when(fits, cell).otherwise(F.concat(F.lit("  "), "line", F.lit("\n"))))
    g = rows.agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"), F.count_distinct("document").alias("files"))
    files = F.when(F.col("files") > 1, F.concat(F.lit("\n\nThey came from "), F.col("files").cast("string"), F.lit(" different files. If two of them disagree, say so rather than choosing."))).otherwise("")
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p["piece"], F.lit("\n"))), "")
    return g.where("size(pieces) > 0").select("files", F.size("pieces").cast("long").alias("found"), F.concat(F.when(F.col("files") > 1, MANY_FILES).otherwise(ONE_FILE), body, F.lit("These are the figures as written."), files).alias("text"))
