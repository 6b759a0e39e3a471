"""Byte-level BPE by a rank queue under a hierarchical bitmap.

A pre-token's bytes form a linked list of positions.  Every adjacent pair that is a vocabulary entry waits in
the bucket of its merge rank, and a bitmap of three levels over the ranks tells the lowest bucket in use by
find-first-set.  Merging there may leave entries behind whose pair is gone; they are skipped when met.  Each
merge costs a constant number of word operations plus the bucket's heap, so a pre-token of a million bytes
takes near-linear time.

Behaviour: a null text is an empty one; an empty text has no ids; every byte string decodes back exactly.
Repeated rows are encoded like any other; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import regex
from pyspark.sql import DataFrame, SparkSession

from stratalog.llm.common import map_texts

#: A worker remembers the ids of this many pre-tokens, twice over (recent ones and those before them), if they
#: have no more characters than this.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 32


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def splitter(pattern: str) -> regex.Pattern:
    """The public pattern with white space as Unicode's property, which is what its own library means by it."""
    space = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(space)


class Encoder:
    """Encodes and decodes by one vocabulary.

    ``low`` has a bit for each rank with a bucket, ``mid`` one for each word of ``low`` that is not zero, and
    the integer ``top`` one for each word of ``mid``; all are zero again when a pre-token is done.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, splitter(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.low = [0] * ((max(ranks.values(), default=0) >> 6) + 1)
        self.mid = [0] * ((len(self.low) >> 6) + 1)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, get, low, mid, top = self.ranks, self.ranks.get, self.low, self.mid, 0
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(piece[i : i + 2], -1) for i in range(n)]  # the rank at which a position merges with the next; -1: never
        pair[-1] = -1
        buckets: dict[int, list[int]] = {}
        new = enumerate(pair)
        while True:
            for i, rank in new:
                if rank < 0:
                    continue
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 6] |= 1 << (rank & 63)
                    mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                    top |= 1 << (rank >> 12)
            # find-first-set on each level, past entries whose pair has gone
            i = -1
            while top and i < 0:
                b = (top & -top).bit_length() - 1
                a = b << 6 | (mid[b] & -mid[b]).bit_length() - 1
                rank = a << 6 | (low[a] & -low[a]).bit_length() - 1
                bucket = buckets[rank]
                i = heappop(bucket)
                if not bucket:
                    del buckets[rank]
                    low[a] &= low[a] - 1
                    if not low[a]:
                        mid[b] &= mid[b] - 1
                        if not mid[b]:
                            top &= top - 1
                if pair[i] != rank:
                    i = -1
            if i < 0:
                return [ranks[x] for x in part if x]
            j = after[i]
            k = after[i] = after[j]
            joined = part[i] = part[i] + part[j]
            pair[j], part[j] = -1, b""
            if k < n:
                before[k] = i
                pair[i] = get(joined + part[k], -1)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = get(part[h] + joined, -1)
                new = ((h, pair[h]), (i, pair[i]))
            else:
                new = ((i, pair[i]),)

    def encode(self, text: str) -> list[int]:
        known, out = self.young.get, []
        put = out.extend
        for piece in self.find(text):
            ids = known(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    ids = tuple(self.merge(piece.encode()))
                if len(piece) <= CACHE_CHARS:
                    self.young[piece] = ids
                    if len(self.young) >= CACHE_ENTRIES:
                        self.young, self.old = {}, self.young
                        known = self.young.get
            put(ids)
        return out

    def spell(self, ids: list[int]) -> str:
        """The decimal ids joined by single spaces."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(ranks: dict[bytes, int], pattern: str, key: str) -> Encoder:
    """One encoder for each vocabulary in a worker process, kept from task to task with its bounded cache."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of each row's text.

    The rank file is read once by the driver and broadcast; its size is that of a fixed public vocabulary.
    """
    keep = keep or ["doc_id"]
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    kinds = {"bigint": "long", "int": "int", "string": "string", "double": "double"}
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[types[c]]}" for c in keep), "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>"] * with_ids])

    def start():
        coder = encoder(ranks.value, pattern, vocabulary)

        def work(part: dict) -> dict:
            out = {c: part[c] for c in keep} | {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for text in part["text"]:
                ids = coder.encode(text or "")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(coder.spell(ids).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
                out["ids"].append(ids if with_ids else None)
            return out

        return work

    return map_texts(docs.select(*keep, "text"), schema, start)
