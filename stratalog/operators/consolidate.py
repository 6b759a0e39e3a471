"""Consolidation: claims of one key become a group with a current statement, agreement and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import figures, normalise_quote
from stratalog.operators.graph import keep


def newest(claims: DataFrame) -> DataFrame:
    """key and its current claim: the newest, of equally new ones the first in order."""
    best = F.max_by(F.struct("kind", "title", "statement", "document", "modified", F.col("figures").alias("current_figures")), F.struct(F.col("modified"), -F.col("ordinal")))
    return claims.groupBy("key").agg(best.alias("now")).select("key", "now.*")


def disagrees(current_document, document, current_figures, own):
    """Other documents whose figures differ where both have some."""
    return (current_document != document) & (F.size(current_figures) > 0) & (F.size(own) > 0) & (current_figures != own)


def consolidate(claims: DataFrame) -> DataFrame:
    """One row a key: current title and body, counts of claims, documents, quotes, agreement and disagreement."""
    marked = claims.withColumn("figures", figures(F.col("statement")))
    now = newest(marked).select("key", F.col("kind").alias("now_kind"), F.col("title").alias("now_title"), F.col("statement").alias("body"), F.col("document").alias("now_document"), F.col("modified").alias("now_modified"), "current_figures")
    both = marked.join(now, "key")
    other = F.col("document") != F.col("now_document")
    against = disagrees(F.col("now_document"), F.col("document"), F.col("current_figures"), F.col("figures"))
    return both.groupBy(F.col("key").alias("id")).agg(
        F.first("now_kind").alias("kind"), F.first("now_title").alias("title"), F.first("body").alias("body"), F.first("now_modified").alias("modified"), F.count("*").alias("n_claims"),
        F.count_distinct("document").alias("n_evidence"), F.count_distinct("quote").alias("n_quotes"), F.count_distinct(F.when(against, F.col("document"))).alias("n_disagree"),
        (1 + F.count_distinct(F.when(other & ~against, F.col("document")))).alias("n_agree"),
    )


def anchored(claims: DataFrame) -> DataFrame:
    """Claims (ordinal, key, document, quotes) with the key under which they are grouped in place of their own.

    Two claims that cite one sentence of one document are the same claim.  Claims are taken in their order: the first to
    cite a sentence owns it, and a claim takes the key of the owner of the first of its quotes that an earlier claim has
    cited.  So every claim has one claim before it, or none, whose key it takes; these links are followed to their roots
    by steps that double.
    """
    cited = claims.select("ordinal", "document", F.posexplode("quotes").alias("place", "quote")).withColumn("quote", normalise_quote(F.col("quote")))
    owners = cited.groupBy("document", "quote").agg(F.min("ordinal").alias("owner"))
    earlier = cited.join(owners, ["document", "quote"]).where("owner < ordinal")
    links = keep(earlier.groupBy("ordinal").agg(F.min_by("owner", "place").alias("to")))
    while True:
        after = links.select(F.col("ordinal").alias("to"), F.col("to").alias("next"))
        links = keep(links.join(after, "to", "left").select("ordinal", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
    keys = claims.select(F.col("ordinal").alias("to"), F.col("key").alias("taken"))
    taken = links.select("ordinal", "to").join(keys, "to").select("ordinal", "taken")
    return claims.join(taken, "ordinal", "left").withColumn("key", F.coalesce("taken", "key")).drop("taken")
