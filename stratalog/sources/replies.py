"""Recorded model replies as a source, so that stages which ask a model run offline and alike each time."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CANDIDATES = "struct<candidates:array<struct<kind:string,title:string,statement:string,subtype:string,quotes:array<string>>>>"


def reply_key(stage: Column, instruction: Column, schema: Column, prompt: Column) -> Column:
    """``{stage}-`` and 16 hex digits of the SHA-256 of all four, with null bytes between them."""
    return F.concat(stage, F.lit("-"), F.substring(F.sha2(F.concat_ws("\u0000", stage, instruction, schema, prompt), 256), 1, 16))


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object in text that may have prose around it."""
    text = text or ""
    at = text.find("{")
    while at >= 0:
        try:
            _, end = json.JSONDecoder().raw_decode(text, at)
            return text[at:end]
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def first_object_udf(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """key and reply of every file in a folder of recordings."""
    files = spark.read.option("wholetext", True).text(folder).select("value", F.input_file_name().alias("path"))
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[a-z]+)?$", 1).alias("key"), F.col("value").alias("reply"))


def replay(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests (key, ...) with their recorded reply; ``missing`` marks those that were never recorded."""
    return requests.join(replies, "key", "left").withColumn("missing", F.col("reply").isNull())


def candidates(replied: DataFrame) -> DataFrame:
    """One row for each claim of each reply, those without a title or any quote left out."""
    parsed = replied.withColumn("parsed", F.from_json(first_object_udf("reply"), CANDIDATES))
    rows = parsed.select(*replied.columns, F.posexplode("parsed.candidates").alias("ordinal", "claim")).select(*replied.columns, "ordinal", "claim.*")
    kept = rows.withColumn("quotes", F.filter("quotes", lambda q: F.trim(q) != ""))
    return kept.where((F.trim("title") != "") & (F.size("quotes") > 0))
