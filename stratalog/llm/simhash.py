"""SimHash near-duplicates by vantage-point trees.

Fingerprints at most three bits apart differ in at most one bit in one of their two halves.  So each half has a
vantage-point tree with balls of radius one.  A node has a point of its own, drawn from its path, and a radius: the
median of the distances of a bounded sample at that node, or the middle of the space below what the sample reaches.
Fingerprints within the radius go to the inner branch, others to the outer one.  Beyond its home a fingerprint
visits, as a guest, each other branch that its ball reaches by the triangle bound and that a member of the ball is in;
of two fingerprints one bit apart only the one that lacks the bit asks.  Leaves are the shards: guests and homes are compared over all 64 bits.  The
tree grows with the number of fingerprints, without a limit of its depth; a leaf that stays large is dealt into blocks
that meet in several tasks, and inside a task branches of a large block are pruned by the triangle bound.  A task
gives back a spanning forest of its links, never all pairs, and connected components finish the job.

Copies collapse first: a fingerprint takes part once, with the smallest id that has it.

Behaviour: a null text is an empty one; texts without words have fingerprint zero and link like others; rows
without an id take no part in links and get no component; repeated rows and rows that share an id are one
node; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import Scratch, components, grouped, join_hot, map_texts, partitions

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Hamming distance up to which fingerprints link.
RADIUS = 3
#: Pairs that one comparison holds in memory; fingerprints to aim for in a leaf; those of a larger leaf in a block.
BLOCK_PAIRS, LEAF_ROWS, BLOCK_ROWS = 1 << 21, 1024, 16_384
#: Fingerprints that radii are measured on, about; the fewest that a median is taken of; the radius without one.
SAMPLE_ROWS, LEAST_SAMPLE, MIDDLE = 1 << 16, 32, 16
#: A step takes so many shingles at once, so that a very long text stays small.
STEP = 1 << 14


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if over half the shingles' XXH64 (seed 42) have it."""
    from xxhash import xxh64_intdigest

    words = WORDS.findall((text or "").translate(LOWER) if not (text or "").isascii() else (text or "").lower())
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        upto = min(n, at + STEP)
        if len(words) <= width:
            shingles = [" ".join(words)]
        else:
            shingles = map(" ".join, zip(*(words[at + k : upto + k] for k in range(width)), strict=True))
        h = np.array([xxh64_intdigest(s, 42) for s in shingles], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def start():
        def work(part: dict) -> dict:
            fps = [fingerprint(t) for t in part["text"]]
            return {"doc_id": part["doc_id"], "fp": [x - (1 << 64) if x >> 63 else x for x in fps]}

        return work

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, fp long", start)


def with_fingerprint(docs: DataFrame, keep: str) -> DataFrame:
    """The columns ``keep`` (a DDL list with text) and the fingerprint in hexadecimal."""
    names = [x.split()[0] for x in keep.split(",")]

    def start():
        return lambda part: {c: part[c] for c in names} | {"fingerprint": [f"{fingerprint(t):016x}" for t in part["text"]]}

    return map_texts(docs.select(*names), f"{keep}, fingerprint string", start)


def vantage_points(paths: np.ndarray) -> np.ndarray:
    """A point of 32 bits for each node, mixed from its path (1 for a root; then 2p inside and 2p + 1 outside)."""
    x = paths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFF)


@dataclass
class Tree:
    """Radii by path, sorted, of nodes that the sample reaches; -1 for a leaf.  Others split at MIDDLE down to ``depth``."""

    depth: int
    paths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    radii: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def radius(self, paths: np.ndarray, level: int) -> np.ndarray:
        out = np.full(len(paths), MIDDLE if level < self.depth else -1, dtype=np.int64)
        if len(self.paths):
            at = np.minimum(np.searchsorted(self.paths, paths), len(self.paths) - 1)
            known = self.paths[at] == paths
            out[known] = self.radii[at[known]]
        return out

    def visits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) of every leaf where a value is at home or a member of its ball of radius one is.

        Of two values one bit apart the one that lacks the bit asks, so the members are the value with each bit that it
        lacks.  A node keeps a mask of those that are in it.  By the triangle bound only a node whose radius is within one of
        the value's distance can part them: there the members that come nearer (their bit is one of the
        difference) go inside.  A branch without a member is not visited, so a value never has more than 33 leaves.
        """
        row, path, home = np.arange(len(values)), np.ones(len(values), np.int64), np.ones(len(values), bool)
        mask = ~values & np.uint64(0xFFFFFFFF)
        none = np.uint64(0)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(self.depth + 1):
            r = self.radius(path, level)
            ends = r < 0
            done.append((row[ends], path[ends], home[ends]))
            go = ~ends
            row, path, home, mask, r = row[go], path[go], home[go], mask[go], r[go]
            apart = values[row] ^ vantage_points(path)
            d = np.bitwise_count(apart).astype(np.int64)
            nearer = np.where(d < r, mask, np.where(d <= r + 1, mask & apart, none))
            further = mask & ~nearer
            inner, outer = home & (d <= r), home & (d > r)
            a, b = inner | (nearer != none), outer | (further != none)
            row, path, home = np.concatenate([row[a], row[b]]), np.concatenate([path[a] * 2, path[b] * 2 + 1]), np.concatenate([inner[a], outer[b]])
            mask = np.concatenate([nearer[a], further[b]])
        row, path, home = (np.concatenate(x) for x in zip(*done, strict=True))
        return row, path, home


def half_of(fp: np.ndarray, half: int) -> np.ndarray:
    return fp >> np.uint64(32) if half else fp & np.uint64(0xFFFFFFFF)


def plant(sample: np.ndarray, distinct: int, leaf_rows: int = LEAF_ROWS) -> list[Tree]:
    """Both halves' trees for ``distinct`` fingerprints, with radii measured on a sample of them."""
    depth = max(0, int(distinct / leaf_rows).bit_length()) + 1
    each = distinct / max(1, len(sample))
    trees = []
    for half in (0, 1):
        values, path = half_of(sample, half), np.ones(len(sample), np.int64)
        paths, radii = [], []
        for _ in range(depth):
            order = np.argsort(path, kind="stable")
            nodes, first, n = np.unique(path[order], return_index=True, return_counts=True)
            d = np.bitwise_count(values ^ vantage_points(path)).astype(np.int64)
            radius = np.full(len(nodes), MIDDLE)
            for i, (at, size) in enumerate(zip(first, n, strict=True)):
                if size * each <= leaf_rows and (each == 1 or size >= LEAST_SAMPLE / 4):
                    radius[i] = -1
                elif size >= LEAST_SAMPLE:
                    # the cut nearest to halves
                    radius[i] = int(np.median(d[order[at : at + size]]))
            known = (n >= LEAST_SAMPLE) | (radius < 0)
            paths.append(nodes[known])
            radii.append(radius[known])
            r = radius[np.searchsorted(nodes, path)]
            keep = r >= 0
            values, path, d, r = values[keep], path[keep], d[keep], r[keep]
            path = path * 2 + (d > r)
        p, r = np.concatenate(paths), np.concatenate(radii)
        order = np.argsort(p)
        trees.append(Tree(depth, p[order].astype(np.int64), r[order].astype(np.int64)))
    return trees


def to_leaves(batches: Iterator[pd.DataFrame], trees: list[Tree]) -> Iterator[pd.DataFrame]:
    """A row for the home of each fingerprint and one for each leaf where it is a guest, in both trees."""
    for pdf in batches:
        for at in range(0, len(pdf), 4096):
            part = pdf.iloc[at : at + 4096]
            fp, doc = part["fp"].to_numpy().astype(np.uint64), part["doc"].to_numpy()
            for half, tree in enumerate(trees):
                row, leaf, home = tree.visits(half_of(fp, half))
                yield pd.DataFrame({"half": np.int32(half), "leaf": leaf, "fp": fp[row].astype(np.int64), "doc": doc[row], "home": home})


class Forest:
    """Union-find over positions; a merge keeps the smaller position as the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(self, i: int, others: np.ndarray) -> None:
        heads = {self.find(int(x)) for x in np.unique(self.root[others])} | {self.find(i)}
        low = min(heads)
        for h in heads:
            self.root[h] = low
        self.root[others] = low
        self.root[i] = low


def link_within(fp: np.ndarray, a: np.ndarray, b: np.ndarray, forest: Forest) -> None:
    """Joins in ``forest`` all positions of ``a`` and ``b`` whose fingerprints are within RADIUS of each other."""
    if len(a) * len(b) > BLOCK_PAIRS:
        pivot = fp[a[len(a) // 2]]
        da, db = np.bitwise_count(fp[a] ^ pivot), np.bitwise_count(fp[b] ^ pivot)
        branches = [(a[da == d], b[np.abs(db.astype(np.int16) - int(d)) <= RADIUS]) for d in np.unique(da)]
        if sum(len(x) * len(y) for x, y in branches) <= 0.8 * len(a) * len(b):
            for x, y in branches:
                if len(x) and len(y):
                    link_within(fp, x, y, forest)
            return
    step = max(1, BLOCK_PAIRS // max(1, len(b)))
    for at in range(0, len(a), step):
        rows, cols = np.nonzero(np.bitwise_count(fp[a[at : at + step], None] ^ fp[b]) <= RADIUS)
        if not len(rows):
            continue
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for s, e in zip(starts, [*starts[1:], len(rows)], strict=True):
            if e - s > 1 or b[cols[s]] != a[at + rows[s]]:
                forest.join(int(a[at + rows[s]]), b[cols[s:e]])


def link_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) of a spanning forest for each shard: rows that ask, then homes that answer, of one leaf or two of its blocks."""
    for leaf in grouped(batches, ["half", "leaf", "one", "two"]):
        answers = leaf["answers"].to_numpy()
        if len(leaf) < 2 or not answers.any():
            continue
        fp, doc = leaf["fp"].to_numpy().astype(np.uint64), leaf["doc"].to_numpy()
        forest = Forest(len(fp))
        link_within(fp, np.flatnonzero(leaf["asks"].to_numpy()), np.flatnonzero(answers), forest)
        tails = np.flatnonzero(forest.root != np.arange(len(fp)))
        if len(tails):
            a, b = doc[tails], doc[[forest.find(i) for i in tails]]
            yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def shards(placed: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of ``placed`` by shard (half, leaf, one, two): a leaf as a whole, or block ``one`` asking block ``two``.

    ``large`` has the number of blocks of each leaf that is too large for one task.  There every row asks each block
    and every home answers each, so no task has more than two blocks.
    """
    block, every, answers = F.col("block"), F.sequence(F.lit(0), F.col("blocks") - 1), F.col("home")
    role = lambda one, two, asks, answers: F.struct(one.alias("one"), two.alias("two"), asks.alias("asks"), answers.alias("answers"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    # of two blocks of homes the earlier one asks; guests ask all
    ask = F.transform(F.filter(every, lambda o: ~answers | (block <= o)), lambda o: role(block, o, yes, no))
    answer = F.transform(F.filter(every, lambda o: answers), lambda o: role(o, block, no, yes))
    meets = F.when(F.col("blocks") == 1, F.array(role(zero, zero, yes, answers))).otherwise(F.concat(ask, answer))
    dealt = placed.join(large, ["half", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int")).select("half", "leaf", "fp", "doc", F.explode(meets).alias("m"))
    return dealt.select("half", "leaf", "m.one", "m.two", "fp", "doc", "m.asks", "m.answers")


def linked(spark: SparkSession, scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(node, component) of the fingerprints ``nodes`` (fp, doc) that link with others, named by their ``doc``."""
    distinct = nodes.count()
    one_in = max(1, distinct // SAMPLE_ROWS)
    sample = nodes.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(one_in)) == 0).select("fp").toPandas()["fp"]
    trees = spark.sparkContext.broadcast(plant(sample.to_numpy().astype(np.int64).astype(np.uint64), distinct))
    even = nodes.repartition(partitions(spark))
    placed = even.mapInPandas(lambda it: to_leaves(it, trees.value), "half int, leaf long, fp long, doc long, home boolean")
    placed = scratch.save(placed, "placed")
    # homes and guests count; written, so that the planner knows the size
    sizes = placed.groupBy("half", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK_ROWS)
    large = scratch.save(sizes.select("half", "leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "large")
    keys = ["half", "leaf", "one", "two"]
    dealt = shards(placed, large).repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    reached = components(scratch, dealt.mapInPandas(link_leaves, "a long, b long"))
    scratch.drop("placed")
    scratch.drop("large")
    return reached


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; rows that share an id are one node."""
    scratch = Scratch(spark, "simhash")
    marked = scratch.save(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "groups")
    reached = linked(spark, scratch, groups.where("doc is not null").select("fp", "doc"))
    named = groups.join(reached.withColumnRenamed("node", "doc"), "doc", "left").select(
        "fp", "n", F.coalesce("component", "doc").alias("component_id")
    )
    named = scratch.save(named, "named")
    return join_hot(marked, named, "fp", "n", marked.count()).select(
        "doc_id", hexed(F.col("fp")), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint")


def survivors(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, kept) for every row of ``docs`` with an id: whether its text stands for its near copies.

    Fingerprints are the nodes, whatever ids they have, so texts that share an id but are unlike each other are apart.  Of
    linked fingerprints the one of the smallest id stays, and under that id the smallest fingerprint.
    """
    scratch = Scratch(spark, "simhash")
    marked = scratch.save(fingerprints(docs, "doc_id", "text").where("doc_id is not null"), "fingerprints")
    groups = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    reached = linked(spark, scratch, groups.select("fp", F.col("fp").alias("doc")))
    whole = groups.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = whole.groupBy("component").agg(F.min(F.struct("first", "fp")).alias("best")).select("best.fp", F.col("best.first").alias("stays"))
    named = scratch.save(groups.join(best, "fp", "left").select("fp", "n", "stays"), "named")
    kept = F.coalesce(F.col("doc_id") == F.col("stays"), F.lit(False)).alias("kept")
    return join_hot(marked, named, "fp", "n", marked.count()).select("doc_id", hexed(F.col("fp")), kept)
