"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions.  Two words at distance one share a key: either one of them
is a deletion of the other, or both lose the letter that they differ in.  Keys are 64-bit hashes, made in time
linear in the word by cutting one letter out of a polynomial; with a deletion go the first and last place that it can
be made at.  Of words that share a deletion only those whose places overlap are a pair (others are two edits apart), so
a key's words don't all meet.  Every pair's distance is verified on the words themselves.

A word's form is its near word of most occurrences, if it has at least RATIO times its own; forms are followed to
their roots by joins that double the steps taken.

Behaviour: a null text has no words; a document without an id has the id '' in the edit's hash; repeated rows count
again; words of any length are taken whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import SLICE_ROWS, Scratch

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many (document, run) pairs loses a letter, which plants variants.
EDIT = 31
#: Words, and their letters, that a task counts before it hands them on.
HELD_WORDS, HELD_LETTERS = 200_000, 8_000_000
#: Letters whose deletions are hashed at once, unless one word has more.
PIECE_LETTERS = 1 << 18
#: An odd base of polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def edited(doc_id: str, run: str) -> str:
    """The run, or for one in EDIT (document, run) pairs the run without one letter."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % EDIT else run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """word, n over all documents (doc_id, text), for words of at least ``least`` letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
        held, letters = Counter(), 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for cut in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(cut, SLICE_ROWS)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    # bytes.lower() changes A-Z alone
                    for found, n in Counter(runs.findall((text or "").encode().lower().decode())).items():
                        word = edited("" if doc is None else doc, found)
                        if len(word) >= least:
                            if word not in held:
                                letters += len(word)
                            held[word] += n
                    if len(held) > HELD_WORDS or letters > HELD_LETTERS:
                        yield flush()
                        held, letters = Counter(), 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(ids: list[int], words: list[str]) -> list[np.ndarray]:
    """key, id, first, last for each word (-1, -1) and each of its distinct deletions."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(letters)) - start[word]
    longest = int(size.max())
    power, inverse = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(longest, b, np.uint64))]) for b in (BASE, INVERSE))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * power[at])])
    whole = total[start + size] - total[start]
    # equal neighbours give the same deletion: one for each run of them
    head = np.flatnonzero((at == 0) | (np.concatenate([[0], letters[:-1]]) != letters))
    tail = np.concatenate([head[1:], [len(letters)]]) - 1
    of = word[head]
    cut = (total[head] - total[start[of]]) + (total[start[of] + size[of]] - total[head + 1]) * inverse[1]
    none = np.full(len(words), -1)
    named = np.array(ids, np.int64)
    return [np.concatenate([whole, cut]).astype(np.int64), np.concatenate([named, named[of]]), np.concatenate([none, at[head]]), np.concatenate([none, at[tail]])]


def delete_keys(words: DataFrame) -> DataFrame:
    """key, id, first, last of every word (id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            rows = list(zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True))
            for k, (i, w) in enumerate(rows):
                ids.append(i)
                texts.append(w)
                size += len(w)
                if size > PIECE_LETTERS or k == len(rows) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _keys(ids, texts)], names=["key", "id", "first", "last"])
                    ids, texts, size = [], [], 0

    return words.select("id", "word").mapInArrow(run, "key long, id long, first long, last long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: ids of words (id, word) that differ by exactly one letter, a < b, each pair once."""
    keys = delete_keys(words)
    left, right = keys.select("key", *(F.col(c).alias(f"{c}_a") for c in ("id", "first", "last"))), keys.select("key", *(F.col(c).alias(f"{c}_b") for c in ("id", "first", "last")))
    # one is the other's deletion, or both lose the same place
    meet = F.expr("id_a < id_b and ((first_a < 0) <> (first_b < 0) or (first_a >= 0 and first_b >= 0 and first_a <= last_b and first_b <= last_a))")
    pairs = left.join(right, "key").where(meet).select("id_a", "id_b").distinct()
    named = lambda side: words.select(F.col("id").alias(f"id_{side}"), F.col("word").alias(f"word_{side}"))
    return pairs.join(named("a"), "id_a").join(named("b"), "id_b").where(F.levenshtein("word_a", "word_b", 1) == 1).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def group_spellings(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least LEAST_COUNT occurrences."""
    scratch = Scratch(spark, "spelling")
    counted = count_words(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    words = scratch.save(counted.where(F.col("n") >= LEAST_COUNT).withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = both.join(words.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n")), "other")
    # the fewest below zero is the most; strings compare by code point
    best = near.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= RATIO * F.col("n")
    formed = words.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    formed = scratch.save(formed, "formed")
    scratch.drop("words")
    links = formed.where("form is not null").select("word", F.col("form").alias("to"))
    turn = 0
    while True:
        # each link is followed by the one that its end has: steps double, as n grows RATIO times with each they end soon
        after = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        links = scratch.save(links.join(after, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), f"links{turn}")
        if links.where("moved").isEmpty():
            break
        scratch.drop(f"links{turn - 1}")
        turn += 1
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 by bytes, from a table made by its rule.
SPELLING_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM runs, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {EDIT} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
keys AS (SELECT word, n, word AS key, -1 AS i FROM words UNION ALL SELECT word, n, left(word, i) || substr(word, i + 2), i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word AND (a.i = b.i OR a.i < 0 OR b.i < 0)),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
roots AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT r.word, r.next, f.form FROM roots r JOIN formed f ON f.word = r.next)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM roots WHERE next IS NULL) USING (word)"""
