"""Ranked full-text retrieval: an inverted index as a table and BM25 as joins and one aggregation."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.graph import keep

#: Fixed values of the ranking.
K1, B, LEAST_IDF, MOST_TERMS = 1.2, 0.75, 1e-6, 24


def plain(text: str) -> str:
    """Lower case, without the marks that letters carry."""
    return "".join(ch for ch in unicodedata.normalize("NFD", text.lower()) if not unicodedata.category(ch).startswith("M"))


#: Letters that carry marks, and what they are without: by rule, every one up to U+1FFF whose decomposition is one letter.
MARKED = [c for c in map(chr, range(0xC0, 0x2000)) if len(plain(c)) == 1 and plain(c) != c.lower() and c == c.lower()]
MARKS = r"[\u0300-\u036f]"


def unaccented(c: Column) -> Column:
    """Lower case without marks; only texts with characters beyond ASCII are looked at letter by letter."""
    lowered = F.lower(c)
    bare = F.translate(F.regexp_replace(lowered, MARKS, ""), "".join(MARKED), "".join(map(plain, MARKED)))
    return F.when(F.octet_length(lowered) == F.char_length(lowered), lowered).otherwise(bare)


def terms(c: Column) -> Column:
    """Runs of letters and digits in lower case, without accents."""
    return F.filter(F.split(unaccented(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spaced(c: Column) -> Column:
    """The same words as one text, with single spaces between them and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(unaccented(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def n_words(c: Column) -> Column:
    """How many words a spaced text has: one less than its spaces, so that no word is cut out to be counted."""
    rest = F.replace(c, F.lit(" "), F.lit(""))
    return F.when(rest == "", 0).otherwise(F.octet_length(c) - F.octet_length(rest) - 1)


def _weighed(words: Column, weight: float) -> Column:
    return F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(float(weight)).alias("weight")))


def postings(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, term, frequency, length): frequency weighs each column, length counts the words of all of them."""
    cols = [terms(F.col(c)) for c in weights]
    length = sum((F.size(c) for c in cols[1:]), F.size(cols[0])).cast("double")
    words = F.concat(*[_weighed(c, k) for c, k in zip(cols, weights.values(), strict=True)])
    rows = docs.select("id", length.alias("length"), F.explode(words).alias("w"))
    return rows.groupBy("id", F.col("w.term").alias("term")).agg(F.sum("w.weight").alias("frequency"), F.first("length").alias("length"))


def query_terms(question: str) -> list[str]:
    """Words of two letters or more, each once, no more than the index is asked for."""
    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", plain(question)) if len(w) >= 2))[:MOST_TERMS]


def bm25(docs: DataFrame, question: str, weights: dict[str, float]) -> DataFrame:
    """(id, score) of documents that hold a term of the question; a higher score is better.

    Texts are read once and shuffled never: a document that holds a term is one row with its length and a frequency for
    each term, and all others of a task are one row together, which counts them.
    """
    asked = query_terms(question)
    names = [f"f{k}" for k in range(len(asked))]
    texts = docs.select("id", *[spaced(F.col(c)).alias(f"words{i}_") for i, c in enumerate(weights)])
    one_of = F.lit(f" ({'|'.join(asked)})(?= )") if asked else F.lit("(?!)()")
    rows = texts.select(
        "id", sum((n_words(F.col(f"words{i}_")) for i in range(1, len(weights))), n_words(F.col("words0_"))).cast("double").alias("length"),
        *[F.coalesce(F.regexp_extract_all(f"words{i}_", one_of, F.lit(1)), F.array().cast("array<string>")).alias(f"held{i}_") for i in range(len(weights))],
    )
    times = lambda held, w: F.size(held) - F.size(F.array_remove(held, w))
    counts = [sum(times(F.col(f"held{i}_"), w) * float(k) for i, k in enumerate(weights.values())).alias(n) for w, n in zip(asked, names, strict=True)]
    held = reduce(lambda x, y: x | y, [F.size(f"held{i}_") > 0 for i in range(len(weights))])
    rows = rows.select("id", "length", held.alias("hit"), *counts)
    by_id = keep(
        rows.groupBy("hit", F.when(F.col("hit"), F.col("id")).alias("id"))
        .agg(F.count("*").alias("n"), F.count("length").alias("known"), F.sum("length").alias("words"), F.first("length").alias("length"), *[F.sum(n).alias(n) for n in names])
    )
    stats = by_id.agg(F.sum("n").alias("all"), (F.sum("words") / F.nullif(F.sum("known"), F.lit(0))).alias("mean"), *[F.count_if(F.col(n) > 0).alias(f"n_{n}") for n in names])
    score = F.lit(0.0)
    for n in names:
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("all") - F.col(f"n_{n}") + 0.5) / (F.col(f"n_{n}") + 0.5)))
        score += F.when(F.col(n) > 0, idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("length") / F.col("mean")))).otherwise(0.0)
    return by_id.where("hit").crossJoin(F.broadcast(stats)).select("id", F.round(score, 6).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


def bm25_sql(table: str, question: str, weights: dict[str, float], where: str = "true") -> str:
    """The same ranking as a SQL sub-select with columns id and score."""
    split = lambda c: f"[w FOR w IN regexp_split_to_array(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}]+') IF w <> '']"
    asked = "[" + ", ".join(f"'{w}'" for w in query_terms(question)) + "]"
    parts = " UNION ALL ".join(f"SELECT id, unnest({split(c)}) AS term, {k}::DOUBLE AS weight FROM {table} WHERE {where}" for c, k in weights.items())
    length = " + ".join(f"len({split(c)})" for c in weights)
    return f"""(WITH hit AS (SELECT id, term, sum(weight) AS f FROM ({parts}) WHERE list_contains({asked}, term) GROUP BY ALL),
len AS (SELECT id, ({length})::DOUBLE AS length FROM {table} WHERE {where}), stats AS (SELECT count(*) AS n_all, avg(length) AS mean FROM len),
df AS (SELECT term, count(*) AS n FROM hit GROUP BY term)
SELECT id, round(sum(greatest({LEAST_IDF}, ln((n_all - n + 0.5) / (n + 0.5))) * f * {K1 + 1} / (f + {K1} * ({1 - B} + {B} * length / mean))), 6) AS score
FROM hit JOIN df USING (term) JOIN len USING (id), stats GROUP BY id)"""
