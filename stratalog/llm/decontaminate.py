"""Benchmark decontamination by a prefix-filtered set join.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case.  An item's
windows are its runs of WINDOW consecutive words; an item of fewer words is one window.  A document word inside any
occurrence of a window is hit.

* A window is taken as its shingles of SHINGLE words (a shorter window is one shingle).  Shingles are ordered by how
  often all documents have them.  As an occurrence holds every shingle of its window, its rarest one is all the prefix
  that the join needs; windows with a shingle that no document has are gone before it.
* Documents send only the places of such prefix shingles, with the few words around them.  They are found with a bitmap
  of fixed size at most, whose false positives the join drops.
* A shingle's place and its offset in a window say where the window would start: that must lie in the document
  (positional bound) and have enough words after it (length bound).  What stands there is joined to the windows' own
  words, so matches are exact.

Texts are read twice, once to count and once to look, and are never shuffled.  Shingles and windows of many
occurrences go through ``join_hot``; documents with the same windows share one list of items.

Behaviour: a null or wordless text has no words; a null or wordless item has no windows; items that share an id
count as one and hit together; an item without an id hits words but is neither counted nor listed; rows
that share a doc_id, or have none, each give a row; without items every document is clean; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.llm.common import SLICE_ROWS, Scratch, join_hot

WINDOW, SHINGLE = 10, 3
#: Bits of the bitmap for each shingle, and the most it may have: 16 MiB, which any number of shingles shares.
BITS_EACH, MOST_BITS = 64, 1 << 27
#: Bytes hashed at once, and shingles counted at once in a task.
PIECE, HELD = 1 << 22, 1 << 20
#: What parts words, as a class of characters; the bytes of a word, A-Z being lowered before.
NO_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: An odd base of polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words(text: Column) -> Column:
    """The words of a text as an array."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"[^{NO_WORD}]+"), F.lit(0))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values whose every bit depends on all bits of ``x``."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes words and shingles of UTF-8 texts, with tables of powers that grow to the longest piece."""

    def __init__(self):
        self.power, self.inverse = self._tables(PIECE // 64)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (BASE, INVERSE))

    def _piece(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(piece) >= len(self.power):
            self.power, self.inverse = self._tables(2 * len(piece))
        inside = np.zeros(len(piece) + 2, np.int8)
        inside[1:-1] = WORD_BYTE[piece]
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[::2], edges[1::2]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * self.power[: len(piece)], out=total[1:])
        return start, end, mixed((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word of ``data``, in lower case, starts and ends, and its hash."""
        raw = np.frombuffer(data, np.uint8)
        found, at = [], 0
        while at < len(raw) or not found:
            to = min(len(raw), at + PIECE)
            while to < len(raw) and WORD_BYTE[raw[to]]:
                to += 1  # a word isn't cut
            start, end, hashed = self._piece(raw[at:to])
            found.append((start + at, end + at, hashed))
            at = to
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    @staticmethod
    def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
        """The hash of each run of ``width`` words, by its first word."""
        n = len(hashed) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * np.uint64(BASE) + hashed[k : k + n]
        return mixed(out)


def _slots(token: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(token >> np.uint64(shift)) % np.uint64(bits) for shift in (0, 32)]


class Bitmap:
    """Shingles that may be meant, of the widths that occur: false positives are few, negatives are sure."""

    def __init__(self, tokens: DataFrame):
        """``tokens`` has distinct (token, width); what comes to the driver is the bitmap, of MOST_BITS at most."""
        sizes = {r["width"]: r["n"] for r in tokens.groupBy("width").agg(F.count("*").alias("n")).collect()}  # as many as SHINGLE
        self.widths = sorted(sizes)
        self.bits = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(BITS_EACH * max(1, sum(sizes.values()))))))
        bits = self.bits

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = np.concatenate(_slots(batch.column("token").to_numpy().astype(np.uint64), bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot >> 5), pa.array(np.int64(1) << (slot & 31))], names=["part", "bit"])

        parts = tokens.mapInArrow(slots, "part long, bit long").groupBy("part").agg(F.bit_or("bit").alias("bit")).toPandas()
        self.parts = np.zeros(bits >> 5, np.uint32)
        self.parts[parts["part"].to_numpy()] = parts["bit"].to_numpy().astype(np.uint32)


    def has(self, token: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(self.parts[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) for slot in _slots(token, self.bits)])


def _encoded(part: pa.RecordBatch) -> list[bytes]:
    # bytes.lower() changes A-Z alone
    return [(x or "").encode().lower() for x in part.column("text").to_pylist()]


def window_tokens(windows: DataFrame) -> DataFrame:
    """wid, token, width, offset of each shingle of each window (wid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Words()
        for batch in batches:
            out = [[], [], [], []]
            for wid, data in zip(batch.column("wid").to_pylist(), _encoded(batch), strict=True):
                hashed = hasher(data)[2]
                width = min(SHINGLE, len(hashed))
                token = hasher.shingles(hashed, width).astype(np.int64)
                for column, x in zip(out, (np.full(len(token), wid), token, np.full(len(token), width), np.arange(len(token))), strict=True):
                    column.append(x)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["wid", "token", "width", "offset"])

    return windows.select("wid", "text").mapInArrow(run, "wid long, token long, width long, offset long")


def count_tokens(docs: DataFrame, bitmap) -> DataFrame:
    """token, n: how often all documents have each shingle that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Words(), [], 0

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for data in _encoded(batch):
                hashed = hasher(data)[2]
                for width in bitmap.value.widths:
                    token = hasher.shingles(hashed, width)
                    held.append(token[bitmap.value.has(token)])
                    size += len(held[-1])
                if size > HELD:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


#: The words before a shingle that a window may begin with, and those from it on.
BEFORE, AFTER = WINDOW - SHINGLE, WINDOW
FOUND = "doc_id long, n_words long, places array<struct<token:long,at:long,before:long,around:string>>"


def find_places(docs: DataFrame, bitmap) -> DataFrame:
    """For each document its words' number and the places of shingles that the bitmap lets through."""
    place = pa.struct([("token", pa.int64()), ("at", pa.int64()), ("before", pa.int64()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Words()
        for batch in batches:
            for cut in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(cut, SLICE_ROWS)
                n_words, places = [], []
                for data in _encoded(part):
                    start, end, hashed = hasher(data)
                    n_words.append(len(hashed))
                    mine = []
                    for width in bitmap.value.widths:
                        token = hasher.shingles(hashed, width)
                        for at in np.flatnonzero(bitmap.value.has(token)).tolist():
                            before = min(at, BEFORE)
                            span = range(at - before, min(at + AFTER, len(start)))
                            around = b" ".join(data[start[i] : end[i]] for i in span).decode()
                            mine.append((int(token[at].astype(np.int64)), at, before, around))
                    places.append(mine)
                ids = part.column("doc_id")
                columns = [ids, pa.array(n_words, pa.int64()), pa.array([[dict(zip(("token", "at", "before", "around"), x, strict=True)) for x in m] for m in places], pa.list_(place))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    scratch = Scratch(spark, "decontaminate")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # items of the same words are one class; its windows are cut once
    item = scratch.save(items.select(F.col(item_col).alias("item_id"), F.array_join(words(F.col(item_text)), " ").alias("text")).where("text <> ''"), "items")
    cut = F.split("text", " ")
    slices = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cut) - WINDOW + 1, F.lit(1))), lambda i: F.array_join(F.slice(cut, i, WINDOW), " "))
    own = scratch.save(item.select("text").distinct().select(F.sha2("text", 256).alias("class"), F.explode(F.array_distinct(slices)).alias("window")), "own")
    windows = scratch.save(own.groupBy(F.col("window").alias("text")).agg(F.count("*").alias("classes")).withColumn("wid", F.monotonically_increasing_id()), "windows")

    # rarity over all documents; a window without one of its shingles there can't occur
    tokens = scratch.save(window_tokens(windows), "tokens")
    used = tokens.groupBy("token", "width").agg(F.count("*").alias("windows"))
    every = spark.sparkContext.broadcast(Bitmap(used))
    df = scratch.save(used.join(count_tokens(texts, every), "token", "left").select("token", "width", "windows", F.coalesce("n", F.lit(0)).alias("n")), "counts")
    ranked = join_hot(tokens.drop("width"), df, "token", "windows", tokens.count())
    prefix = ranked.groupBy("wid").agg(F.min(F.struct("n", "token", "width", "offset")).alias("p")).where("p.n > 0").select("wid", "p.*")
    prefix = scratch.save(prefix.join(windows, "wid").select("wid", "text", "n", "token", "width", "offset"), "prefix")

    for name in ("tokens", "counts"):
        scratch.drop(name)

    rare = spark.sparkContext.broadcast(Bitmap(prefix.select("token", "width").distinct()))
    found = scratch.save(find_places(texts, rare).withColumn("uid", F.monotonically_increasing_id()), "found")
    places = found.where("size(places) > 0").select("uid", F.explode("places").alias("p")).select("uid", "p.*")
    shape = F.struct("offset", F.size(F.split("text", " ")).alias("length"))
    shapes = prefix.groupBy("token").agg(F.first("n").alias("n"), F.collect_set(shape).alias("shapes"))  # a window's few offsets and lengths
    total = prefix.select("token", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    starts = join_hot(places, shapes, "token", "n", total).select("uid", "at", "before", F.split("around", " ").alias("around"), F.explode("shapes").alias("s"))
    bound = (F.col("at") >= F.col("s.offset")) & (F.size("around") >= F.col("before") - F.col("s.offset") + F.col("s.length"))
    stands = F.array_join(F.slice("around", (F.col("before") - F.col("s.offset") + 1).cast("int"), F.col("s.length")), " ")
    candidates = starts.where(bound).select("uid", (F.col("at") - F.col("s.offset")).alias("start"), F.col("s.length").alias("length"), stands.alias("text"))
    hits = join_hot(candidates, prefix.select("text", "wid", "n"), "text", "n", total).select("uid", "wid", "start", (F.col("start") + F.col("length")).alias("end"))

    # the words that windows cover, each once, and the windows themselves
    before = F.max("end").over(W.partitionBy("uid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    of_doc = hits.select("uid", "wid", fresh.alias("fresh")).groupBy("uid").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("wid")).alias("wids"))
    of_doc = scratch.save(of_doc.withColumn("set", F.sha2(F.array_join(F.col("wids").cast("array<string>"), ","), 256)), "hits")

    # documents with the same windows have the same items
    listed = of_doc.groupBy("set").agg(F.first("wids").alias("wids"), F.count("*").alias("docs")).select("set", "docs", F.explode("wids").alias("wid"))
    classes = listed.join(own.join(prefix.select("wid", F.col("text").alias("window")), "window").select("wid", "class"), "wid").select("set", "class").distinct()
    named = item.where("item_id is not null").select(F.sha2("text", 256).alias("class"), F.col("item_id").cast("string").alias("item_id"))
    lists = classes.join(named, "class").groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    lists = scratch.save(lists.select("set", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "lists")
    counts = listed.groupBy("set").agg(F.first("docs").alias("docs")).join(lists, "set", "left")
    known = join_hot(of_doc.select("uid", "n_hit", "set"), counts, "set", "docs", of_doc.count())
    none = F.sha2(F.lit(""), 256)
    return found.select("uid", "doc_id", "n_words").join(known, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


DECONTAMINATE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{NO_WORD}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{NO_WORD}]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s : s + {WINDOW - 1}], ' ') AS text
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
places AS (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
stands AS (SELECT uid, n, s, array_to_string(w[s : s + n - 1], ' ') AS text FROM places),
hits AS (SELECT uid, s, n, item_id FROM stands JOIN windows USING (n, text)),
words AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT uid, s, n FROM hits)) GROUP BY uid),
items AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT uid, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0, false) AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)"""
