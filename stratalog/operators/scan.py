"""What a walk of a folder finds and changes: an inventory from names and sizes, new, changed, unchanged and gone documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.phrases import is_noise, is_old_version
from stratalog.sources.files import KINDS


def labelled(files: DataFrame) -> DataFrame:
    """Files (path, name, bytes, modified) worth counting, with the label of their type and whether it can be read."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    label = F.when(ext == "", "no extension").otherwise(F.upper(ext))
    return files.where(~is_noise(F.col("name"))).select("*", label.alias("label"), ext.isin(*KINDS).alias("readable"))


def types(files: DataFrame) -> DataFrame:
    """(label, readable, files, bytes) by type."""
    return labelled(files).groupBy("label", "readable").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def inventory(files: DataFrame) -> DataFrame:
    """One row: files, readable, bytes of these, duplicates by name and size, old versions, newest; from the listing alone."""
    groups = labelled(files).groupBy(F.lower("name").alias("name"), "bytes", "readable").agg(F.count("*").alias("n"), F.count_if(is_old_version(F.col("name"))).alias("old"), F.max("modified").alias("newest"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("readable"), c)), F.lit(0))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"), of(F.col("n")).alias("readable"), of(F.col("n") * F.col("bytes")).alias("bytes"), of(F.col("n") - 1).alias("duplicates"), of(F.col("old")).alias("old_versions"),
        F.max(F.when(F.col("readable"), F.col("newest"))).alias("newest"),
    )


def compare(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, path, fate) of documents found (id, path) and stored (id, path, gone): changed, unchanged, back or gone.

    Identity is content: a file moved or copied is unchanged, a changed one is another document, and the one that it was
    is gone.  Of equal files the first path names the document.
    """
    one = found.groupBy("id").agg(F.min("path").alias("path"))
    old = stored.select("id", F.col("path").alias("old_path"), F.col("gone").alias("was_gone"))
    fate = F.when(F.col("old_path").isNull(), "changed").when(F.col("path").isNull(), "gone").when(F.col("was_gone"), "back").otherwise("unchanged")
    return one.join(old, "id", "full").select("id", F.coalesce("path", "old_path").alias("path"), fate.alias("fate"))


def put_documents(stored: DataFrame, blocks: DataFrame, found: DataFrame, new_blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (id, source_id, path, bytes, modified, gone) and their blocks after found ones are put.

    The first source and size stay, path and time are the new ones, and what is found is not gone; the blocks of found
    documents replace those that were stored.
    """
    o, n = stored.alias("o"), found.alias("n")
    seen = F.col("n.id").isNotNull()
    newer = lambda c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    first = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    documents = o.join(n, F.col("o.id") == F.col("n.id"), "full").select(first("id"), first("source_id"), newer("path"), first("bytes"), newer("modified"), F.when(seen, False).otherwise(F.col("o.gone")).alias("gone"))
    kept = blocks.join(found.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(*new_blocks.columns)
    return documents, kept.unionByName(new_blocks)
