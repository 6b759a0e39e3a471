"""Order-independent document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line that is not blank) hashes to a wide vector and a document is the sum of its paragraphs'
vectors modulo powers of two.  Adding or taking away a paragraph adds or subtracts its vector, the order of
paragraphs does not matter, and equal multisets of paragraphs have equal sums.  The vector has two parts:

* STRONG lanes of 64 bits from a keyed digest of the paragraph, modulo 2**64, for equality;
* SKETCH lanes of 32 bits, modulo 2**32: every three-word shingle of the paragraph adds +1 or -1 to each lane by
  a bit of its hash.  The squared difference of two sums estimates in how many shingles the documents differ,
  which gives a likeness from 0 to 1.  A lane is read as a signed number, which holds for documents of fewer
  than 2**31 shingles, more than a string of Spark's can have.

Behaviour: a null text is an empty one, whose fingerprint is all zeros; two empty ones are alike (1); rows that
share an id, or have none, are ordered by a hash of their texts, then by the texts; a single row is its own next
document; a row without an id comes last; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import SLICE_ROWS, partitions

STRONG, SKETCH, WIDTH = 4, 128, 3
#: Shingles hashed at once.
STEP = 1 << 14


def paragraph_vector(paragraph: str) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of one paragraph's vector."""
    from xxhash import xxh3_128_digest

    strong = np.frombuffer(hashlib.blake2b(paragraph.encode(), digest_size=STRONG * 8).digest(), dtype="<u8")
    words = paragraph.split()
    n = max(1, len(words) - WIDTH + 1)
    ones = np.zeros(SKETCH, dtype=np.int64)
    for at in range(0, n, STEP):
        upto = min(n, at + STEP)
        parts = [words] if len(words) <= WIDTH else zip(*(words[at + k : upto + k] for k in range(WIDTH)), strict=True)
        raw = b"".join([xxh3_128_digest(" ".join(p)) for p in parts])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, SKETCH).sum(axis=0, dtype=np.int64)
    return strong, (2 * ones - n).astype(np.int64)


class MultisetHash:
    """A sum of paragraph vectors; ``add`` and ``remove`` are exact inverses."""

    def __init__(self, strong: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.strong = np.zeros(STRONG, dtype=np.uint64) if strong is None else strong
        self.sketch = np.zeros(SKETCH, dtype=np.uint32) if sketch is None else sketch

    @classmethod
    def of(cls, text: str | None) -> MultisetHash:
        out = cls()
        for p in (text or "").split("\n"):
            out.add(p)
        return out

    def add(self, paragraph: str) -> None:
        if paragraph.strip():
            strong, sketch = paragraph_vector(paragraph)
            self.strong = self.strong + strong
            self.sketch = self.sketch + sketch.astype(np.uint32)

    def remove(self, paragraph: str) -> None:
        if paragraph.strip():
            strong, sketch = paragraph_vector(paragraph)
            self.strong = self.strong - strong
            self.sketch = self.sketch - sketch.astype(np.uint32)

    def hex(self) -> str:
        return self.strong.astype("<u8").tobytes().hex() + self.sketch.astype("<u4").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> MultisetHash:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[: STRONG * 8], dtype="<u8").astype(np.uint64), np.frombuffer(raw[STRONG * 8 :], dtype="<u4").astype(np.uint32))

    def likeness(self, other: MultisetHash) -> float:
        """1 for equal sums, near 0 for documents that share no shingle: 1 - |x - y|^2 / (|x|^2 + |y|^2)."""
        if (self.strong == other.strong).all():
            return 1.0
        x, y = self.sketch.view(np.int32).astype(np.float64), other.sketch.view(np.int32).astype(np.float64)
        d = (self.sketch - other.sketch).view(np.int32).astype(np.float64)
        whole = x @ x + y @ y
        return float(min(1.0, max(0.0, 1 - d @ d / whole))) if whole else 0.0


def edited(text: str, other: str, own: MultisetHash) -> tuple[str, MultisetHash]:
    """``text`` with its last third replaced by as many characters from the start of ``other``, and its sums.

    These are the text's own, less the paragraphs from the one that is cut on, and with those that take their place.
    """
    k = len(text) // 3
    cut = len(text) - k
    new = text[:cut] + other[:k]
    start = text.rfind("\n", 0, cut) + 1
    after = MultisetHash(own.strong, own.sketch)
    for p in text[start:].split("\n"):
        after.remove(p)
    for p in new[start:].split("\n"):
        after.add(p)
    return new, after


@dataclass
class Buckets:
    """Contiguous parts of the order by descending id: ids up to a cut and above the one before, largest first, and
    at the end rows without an id.  A part of one frequent id, or of none, is ``pieces`` ranges of the texts' hash."""

    cuts: np.ndarray
    pieces: np.ndarray  # of each part in the order

    @classmethod
    def of(cls, quantiles: list[float], nulls: int, each: float) -> Buckets:
        """From quantiles of the ids (repeated where an id is frequent), rows without one, and rows to aim for."""
        times = Counter(int(q) for q in quantiles)
        cuts = sorted({*times, *(q - 1 for q, n in times.items() if n > 1)})
        own = {len(cuts) - 1 - i: times[q] for i, q in enumerate(cuts) if times[q] > 1}
        pieces = [own.get(p - 1, 1) for p in range(len(cuts) + 1)]
        return cls(np.array(cuts, dtype=np.int64), np.array([*pieces, max(1, math.ceil(nulls / each))], dtype=np.int64))

    def number(self, ids: pa.Array, ties: pa.Array) -> np.ndarray:
        part = len(self.cuts) - np.searchsorted(self.cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        part[ids.is_null().to_numpy(zero_copy_only=False)] = len(self.cuts) + 1
        up = (ties.to_numpy(zero_copy_only=False).astype(np.float64) + 2.0**63) / 2.0**64
        inside = np.minimum(self.pieces[part] - 1, (up * self.pieces[part]).astype(np.int64))
        return ((np.cumsum(self.pieces) - self.pieces)[part] + inside).astype(np.int32)


def _with_bucket(batches: Iterator[pa.RecordBatch], buckets: Buckets) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number = buckets.number(batch.column("doc_id"), batch.column("tie"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "bucket"])


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and place in the order; the last of a bucket is a guest, the next bucket's first."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    out: list[tuple] = []
    held: tuple | None = None  # bucket, doc_id, text, fingerprint
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for bucket, doc_id, text, guest in zip(*(part.column(n).to_pylist() for n in ("bucket", "doc_id", "text", "guest")), strict=True):
                text = text or ""
                own = MultisetHash.of(text)
                if held is not None and held[0] == bucket:
                    new, after = edited(held[2], text, held[3])
                    out.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), held[3].hex(), after.hex(), held[3].likeness(after), held[3].likeness(own)))
                held = None if guest else (bucket, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []


def fingerprint_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text, and their likenesses.

    The order is by descending id, then by a hash of the text.  Quantiles of the ids cut it into buckets, and the
    hash cuts ids that fill several; a bucket's last row meets a guest, the first row of the next bucket that has
    rows (the first of all follows the last).  Texts are shuffled once; only one row for each bucket is
    handled as a table of guests.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    wanted = partitions(spark) * 4
    quantiles = rows.select("doc_id").approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.2 / wanted)
    total, named = rows.agg(F.count("*"), F.count("doc_id")).first()
    shared = spark.sparkContext.broadcast(Buckets.of(quantiles, total - named, max(1.0, total / wanted)))
    slim = rows.select("doc_id", "tie").mapInArrow(lambda it: _with_bucket(it, shared.value), "doc_id long, tie long, bucket int")
    place = F.struct(F.bitwise_not("doc_id").alias("below"), "tie")
    heads = slim.groupBy("bucket").agg(F.min(place).alias("x")).select("bucket", F.bitwise_not("x.below").alias("doc_id"), "x.tie").orderBy("bucket").collect()
    if not heads:
        return spark.createDataFrame([], OUT)
    # one row for each bucket: its head, which is a guest of the bucket before
    ends = [(h["doc_id"], h["tie"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]
    ends = spark.createDataFrame(ends, "head long, head_tie long, bucket int")
    first = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")))
    # rows that agree in id and hash have the same text but for collisions
    guests = first.groupBy("bucket").agg(F.first("doc_id").alias("doc_id"), F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("tie").alias("tie"))
    guests = guests.select("doc_id", "text", "tie", "bucket", F.lit(True).alias("guest"))
    own = rows.mapInArrow(lambda it: _with_bucket(it, shared.value), "doc_id long, text string, tie long, bucket int").withColumn("guest", F.lit(False))
    dealt = own.unionByName(guests).repartition(partitions(spark), "bucket")
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("text")]
    return dealt.sortWithinPartitions("bucket", "guest", *order).drop("tie").mapInArrow(_compare, OUT)
