"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random lines.  A pair at cosine c lies sqrt(2 - 2c) apart, so on a line with
standard normal coefficients its projections differ by a normal variable of that deviation; two values collide if
they differ by at most the window.  A pair whose collisions reach a count is verified by its exact cosine in
double precision.  The count is calibrated: the largest at which a pair right on the threshold is missed with a
chance of no more than MISS, by the binomial law of its collisions.

Vectors that are equal collapse to one before, with a multiplicity.  Vectors of one label are dealt into blocks,
every two of which meet in one task; there each projection of a block is sorted once and a query's window in it is
a slice.  Tasks return a number of links for each vector and a spanning forest, never pairs, so what leaves a task
is linear in its rows.  The pairs looked at still grow with the square of a label's distinct vectors, as
one-dimensional windows keep a fixed share of them at any width that finds the true ones.

Behaviour: a vector links with nothing and keeps itself if its label is null, or if it is null, empty, zero or
has a null or non-finite component; vectors of unequal length do not link; a row without an id takes no part;
rows that share an id are one node; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import Scratch, components, grouped, join_hot, partitions
from stratalog.llm.simhash import Forest

LINES, WINDOW_DEVIATIONS, MISS = 24, 2.0, 1e-6
#: Distinct vectors of a label that one block holds: a sixteenth of them, within these bounds.  Every vector is sent
#: once for each block of its label, so large labels have large blocks.
LEAST_BLOCK, MOST_BLOCK = 1024, 8192


def calibrated_count(lines: int = LINES, deviations: float = WINDOW_DEVIATIONS, miss: float = MISS) -> int:
    """The most collisions to ask for so that a pair on the threshold has them but for a chance of ``miss``."""
    p = math.erf(deviations / math.sqrt(2))
    tail = 0.0
    for k in range(lines + 1):
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail > miss:
            return k
    return lines


class Block:
    """Unit vectors with their projections, each projection sorted."""

    def __init__(self, rows: pd.DataFrame):
        self.ids = rows["node"].to_numpy()
        self.times = rows["times"].to_numpy().astype(np.int64)
        raw = np.array(rows["vector"].tolist(), dtype=np.float64)
        # scaled by a power of two, which is exact, so that no square overflows or vanishes
        self.raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])
        self.length = np.sqrt((self.raw * self.raw).sum(1))
        unit = self.raw / self.length[:, None]
        axes = np.random.default_rng(unit.shape[1]).standard_normal((unit.shape[1], LINES))
        self.value = unit @ axes
        self.order = np.argsort(self.value, axis=0)
        self.sorted = np.take_along_axis(self.value, self.order, axis=0)

    def candidates(self, query: np.ndarray, width: float, least: int) -> np.ndarray:
        """Positions whose projections collide with those of one query at least so often."""
        count = np.zeros(len(self.ids), dtype=np.int16)
        for line in range(LINES):
            lo, hi = np.searchsorted(self.sorted[:, line], (query[line] - width, query[line] + width))
            count[self.order[lo:hi, line]] += 1
        return np.flatnonzero(count >= least)


def meet(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows grouped by label, dimension and pair of blocks to links (node, n) and a forest (node, other)."""
    width, least = WINDOW_DEVIATIONS * math.sqrt(2 - 2 * threshold), calibrated_count()
    for group in grouped(batches, ["label", "dim", "one", "two"]):
        same = group["one"].iloc[0] == group["two"].iloc[0]
        left = Block(group[group["block"] == group["one"]])
        right = left if same else Block(group[group["block"] == group["two"]]) if (group["block"] == group["two"]).any() else None
        if right is None or not len(left.ids):
            continue
        n = [np.zeros(len(left.ids), np.int64), np.zeros(len(right.ids), np.int64)]
        # over left then right positions
        forest = Forest(len(left.ids) + (0 if same else len(right.ids)))
        shift = 0 if same else len(left.ids)
        for i in range(len(left.ids)):
            near = right.candidates(left.value[i], width, least)
            if same:
                near = near[near > i]
            if not len(near):
                continue
            cosine = right.raw[near] @ left.raw[i] / (right.length[near] * left.length[i])
            near = near[cosine >= threshold]
            if len(near):
                n[0][i] += right.times[near].sum()
                np.add.at(n[1] if not same else n[0], near, left.times[i])
                forest.join(i, near + shift)
        ids = left.ids if same else np.concatenate([left.ids, right.ids])
        n = n[0] if same else np.concatenate(n)
        linked = np.flatnonzero(n)
        if len(linked):
            yield pd.DataFrame({"node": ids[linked], "n": n[linked], "other": ids[[forest.find(int(i)) for i in linked]]})


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    # -0.0 and 0.0 are equal numbers
    key = F.when(sound, F.sha2(F.concat_ws(" ", F.col("label").cast("string"), F.concat_ws(",", F.transform("vector", lambda x: (x + 0.0).cast("string")))), 256))
    marked = scratch.save(rows.select("vec_id", "label", F.when(sound, F.col("vector")).alias("vector"), key.alias("key")), "marked")
    usable = marked.where("key is not null")
    classes = usable.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = scratch.save(classes, "classes")
    sizes = classes.groupBy("label").agg(F.count("*").alias("rows"))
    distinct = classes.count()
    dealt = join_hot(classes, sizes.withColumn("blocks", F.ceil(F.col("rows") / F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.col("rows") / 16))).cast("int")), "label", "rows", distinct).select(
        "label", F.size("vector").alias("dim"), "node", F.col("n").alias("times"), "vector", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    )
    # every block meets itself and each later one
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    met = dealt.select("label", "dim", "node", "times", "vector", "block", other).select(
        "label", "dim", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("two"), "block", "node", "times", "vector"
    )
    n = partitions(spark)
    keys = ["label", "dim", "one", "two"]
    found = met.repartition(n, *keys).sortWithinPartitions(*keys, "node").mapInPandas(lambda it: meet(it, threshold), "node long, n long, other long")
    found = scratch.save(found, "found")
    links = found.groupBy("node").agg(F.sum("n").alias("links"))
    reached = components(scratch, found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = (
        classes.select("key", "node", "n").join(links, "node", "left").join(reached, "node", "left")
        .select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    named = scratch.save(named, "named")
    out = ["vec_id", "n_links", "component_id"]
    linked = join_hot(usable.select("vec_id", "key"), named, "key", "n", usable.count()).select(*out)
    alone = marked.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
