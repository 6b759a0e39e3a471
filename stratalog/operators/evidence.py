"""The evidence gate: quotes must be the bytes they claim to be, or occur exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import hits, normalise, slice_bytes


def verdict(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """``ok`` or why a span is refused: unknown document, range, a cut character, other words."""
    raw = slice_bytes(text, start, end)
    said = F.make_valid_utf8(raw.cast("string"))
    return (
        F.when(text.isNull(), "no_document")
        .when((start < 0) | (end < start) | (end > F.octet_length(text)), "out_of_range")
        .when(~F.is_valid_utf8(raw.cast("string")), "not_a_boundary")
        .when(normalise(said) != normalise(quote), "mismatch")
        .otherwise("ok")
    )


def beside_text(spans: DataFrame, documents: DataFrame, text: Column, judge, how: str) -> DataFrame:
    """``spans`` with the columns that ``judge(text, span)`` names.

    A document's spans meet its text in one row, so a text is moved once however many spans it has, and is gone before
    spans are rows again.
    """
    own = [c for c in spans.columns if c != "document_id"]
    groups = spans.groupBy("document_id").agg(F.collect_list(F.struct(*own)).alias("spans"))
    texts = documents.select(F.col("id").alias("document_id"), text.alias("text_"))
    met = groups.join(texts, "document_id", how)
    judged = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in own], *judge(F.col("text_"), s)))
    return met.select("document_id", F.explode(judged).alias("s")).select("document_id", "s.*")


def verify(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """``evidence`` (document_id, start_byte, end_byte, quote, ...) with its ``verdict``."""
    return beside_text(evidence, documents, F.col("text"), lambda t, s: [verdict(t, s["start_byte"], s["end_byte"], s["quote"]).alias("verdict")], "left")


def locate(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """Occurrences of (document_id, quote) with white space collapsed, and the place of one that occurs once.

    ``located`` is the character position in the collapsed text, from 0, or null unless there is exactly one.
    """
    found = beside_text(quotes, documents, normalise(F.col("text")), lambda flat, s: [hits(flat, s["quote"]).alias("n_hits"), (F.instr(flat, normalise(s["quote"])) - 1).alias("at_")], "inner")
    return found.withColumn("located", F.when(F.col("n_hits") == 1, F.col("at_")).cast("long")).drop("at_")


def block_at(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block whose bytes hold each (document_id, offset): an equi-join on the document, then the range."""
    b = blocks.select("document_id", "ordinal", "start_byte", "end_byte")
    return offsets.join(b, "document_id").where((F.col("offset") >= F.col("start_byte")) & (F.col("offset") < F.col("end_byte")))
