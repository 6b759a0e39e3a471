"""A corpus pipeline of five stages over ``documents``: toxicity, near-duplicates, personal data, mixing, encoding.

Every stage takes what its predecessor kept, as (spark, docs, sf_dir), and returns the columns of documents, but
for the last, which returns token ids.  Null and empty texts pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import bpe, mixing, pii, simhash, toxicity
from stratalog.llm.common import HOT_SHARE, Scratch, table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model, COLUMNS).where("predicted = 0").select(*NAMES)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest id.

    Rows without an id are all kept; of rows that share an id and a fingerprint one stays.  Fingerprints are linked, not
    ids: texts that share an id each stay or go with the group of their own text.
    """
    scratch = Scratch(spark, "near")
    found = scratch.save(simhash.survivors(spark, docs), "found")
    ids = found.groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"), F.count("*").alias("n"), F.max("kept").alias("kept"))
    ids = scratch.save(ids, "ids")
    rows, repeated, several = ids.agg(F.sum("n"), F.sum(F.expr("kept and a = b and n > 1").cast("long")), F.sum(F.expr("kept and a <> b").cast("long"))).first()
    # an id with at least HOT_SHARE of the rows is one of few; its rows aren't shuffled before they have collapsed
    hot = max(2, int((rows or 0) * HOT_SHARE))
    cold = docs.join(F.broadcast(ids.where(f"n >= {hot}").select("doc_id")), "doc_id", "left_anti")
    # ids grow with the documents, so texts meet them in a shuffle, at every size alike
    only = lambda part: ids.where(f"kept and {part}").select("doc_id").hint("merge")
    kept = cold.join(only(f"a = b and n = 1 and n < {hot}"), "doc_id", "left_semi").select(*NAMES)
    if repeated:
        frequent = F.broadcast(ids.where(f"kept and a = b and n >= {hot}").select("doc_id"))
        for part in (docs.join(frequent, "doc_id", "left_semi"), cold.join(only(f"a = b and n > 1 and n < {hot}"), "doc_id", "left_semi")):
            kept = kept.unionByName(part.dropDuplicates(["doc_id"]).select(*NAMES))
    if several:
        # of these few ids the texts are hashed again, to tell which rows are meant
        own = found.where("kept").select("doc_id", "fingerprint").distinct()
        again = simhash.with_fingerprint(docs.join(ids.where("kept and a <> b").select("doc_id"), "doc_id", "left_semi").select(*NAMES), COLUMNS)
        kept = kept.unionByName(again.join(own, ["doc_id", "fingerprint"], "left_semi").dropDuplicates(["doc_id", "fingerprint"]).select(*NAMES))
    return kept.unionByName(docs.where("doc_id is null").select(*NAMES))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind."""
    return pii.redact_documents(docs, COLUMNS)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the languages' token totals meet flattened targets; each stays at least once."""
    return mixing.mix(spark, docs.select(*NAMES))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and digests of each document that was mixed in."""
    keep = ["doc_id", "lang", "source"]
    return bpe.encode_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_languages),
    ("bpe_encode", encode),
]

#: No stage but the joins between them can be said in DuckDB's SQL (hashes, trained models, tokenizers).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
