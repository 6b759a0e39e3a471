"""Bounded samples of labelled rows, from which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import held_out


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, rows: int, stratified: bool) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``rows`` pairs (whole text, 0 or 1) and how many labelled documents each class has.

    Rows whose crc32(doc_id as text) leaves 1 modulo 3 are never taken.  The sample is the first by a hash of
    the id, so it is the same in every run; ``stratified`` takes half of it from each class.  A document with
    several labels has the largest, one with several texts the least of them; null ids, labels and texts are left out.
    Labels and texts are brought down to one row an id before they are joined or collected, so what the driver gets
    is bounded however often an id is repeated.
    """
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
        .join(ids, "doc_id", "left_semi")
    )
    of = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    if stratified:
        picked = known.where("y = 1").orderBy(*order).limit(rows // 2).unionByName(known.where("y = 0").orderBy(*order).limit(rows // 2))
    else:
        picked = known.orderBy(*order).limit(rows)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])], of
