"""Graph operators over an edge table: reach with distances, order by levels, cycles, acyclic selection.

Every loop works on the frontier alone and stops when it is empty; a round's result goes to a reliable
checkpoint, so a lost executor costs no more than that round.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; on one machine one of its own where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp()


def keep(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder of the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def impact_edges(relations: DataFrame) -> DataFrame:
    """(src, dst): what a change of src reaches.  Foundations point the other way; conflicts carry nothing."""
    r = relations.where("type <> 'conflicts_with'")
    turned = F.col("type").isin("depends_on", "derived_from")
    return r.select(F.when(turned, F.col("to_id")).otherwise(F.col("from_id")).alias("src"), F.when(turned, F.col("from_id")).otherwise(F.col("to_id")).alias("dst")).distinct()


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, distance) for all nodes that ``starts`` (start) reach, themselves excluded.

    Breadth first: a round joins the last frontier to the edges, which are settled once for all rounds, and drops
    what has been seen.
    """
    edges = keep(edges)
    seen = keep(starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("distance")).distinct())
    frontier, hop = seen, 0
    while most is None or hop < most:
        hop += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = keep(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(hop).cast("long")))
        if frontier.isEmpty():
            break
        seen = keep(seen.unionByName(frontier))
    return seen.where("distance > 0")


def reach_with_parents(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, distance, parent) of all nodes that ``starts`` (start) reach, themselves excluded.

    Of several ways of the same length the parent is the smallest node one step nearer.
    """
    edges = keep(edges)
    seen = keep(starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("distance"), F.lit(None).cast("string").alias("parent")).distinct())
    frontier, hop = seen, 0
    while not frontier.isEmpty():
        hop += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy("start", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        fresh = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = keep(fresh.select("start", "node", F.lit(hop).cast("long").alias("distance"), "parent"))
        seen = keep(seen.unionByName(frontier))
    return seen.where("distance > 0")


def paths(reached: DataFrame) -> DataFrame:
    """(start, node, distance, path): the nodes from the start to each node of ``reach_with_parents``.

    Every row holds the end of its path and the node before that end.  A round puts that node's own end in front, so
    ends double and the rounds are the logarithm of the longest distance.
    """
    longest = reached.agg(F.max("distance")).first()[0] or 0
    ends = keep(reached.select("start", "node", "distance", F.col("parent").alias("before"), F.array("node").alias("path")))
    size = 1
    while size < longest:
        front = ends.select("start", F.col("node").alias("before"), F.col("before").alias("earlier"), F.col("path").alias("front"))
        joined = ends.join(front, ["start", "before"], "left")
        ends = keep(joined.select(
            "start", "node", "distance", F.when(F.col("front").isNull(), F.col("before")).otherwise(F.col("earlier")).alias("before"),
            F.concat(F.coalesce("front", F.array().cast("array<string>")), "path").alias("path"),
        ))
        size *= 2
    return ends.select("start", "node", "distance", F.concat(F.array("start"), "path").alias("path"))


#: Rounds after which what has been found is brought together, so that plans stay short.
GATHER = 16


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) by the longest path from a source; nodes on or behind a cycle have none and are missing.

    A node is free once all edges to it have been followed.  A round follows those from the nodes that the last one
    freed and counts them for their ends; only ends that some but not all edges have come to are carried along.
    """
    edges = keep(edges)
    due = keep(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("due")))
    sources = edges.select(F.col("src").alias("node")).distinct().join(due, "node", "left_anti")
    free, waiting, level = keep(sources.withColumn("level", F.lit(0).cast("long"))), None, 0
    out = free
    while not free.isEmpty():
        level += 1
        met = free.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
        met = met if waiting is None else met.unionByName(waiting).groupBy("node").agg(F.sum("n").alias("n"))
        met = keep(met.join(due, "node"))
        free, waiting = met.where("n = due").select("node", F.lit(level).cast("long").alias("level")), met.where("n < due").select("node", "n")
        out = out.unionByName(free)
        out = keep(out) if level % GATHER == 0 else out
    return out


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without a way in or without a way out are taken away again and again."""
    core, n = keep(edges), -1
    while (now := core.count()) != n:
        n = now
        ins, outs = core.select(F.col("dst").alias("src")).distinct(), core.select(F.col("src").alias("dst")).distinct()
        core = keep(core.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
    return core


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches it, itself included, spread along edges until nothing changes."""
    colour = keep(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
    fresh = colour
    while not fresh.isEmpty():
        sent = fresh.join(edges, fresh["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("better"))
        after = keep(colour.join(sent, "node", "left").select("node", F.least("colour", "better").alias("colour"), (F.col("better") < F.col("colour")).alias("moved")))
        colour, fresh = after.select("node", "colour"), after.where("moved").select("node", "colour")
    return colour


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more, named by their smallest node.

    What no cycle can hold is trimmed.  Every node then takes the colour of the smallest node that reaches it; the
    nodes of a colour that reach back to it within the colour are its component, and the rest goes round again.
    """
    rest, found = _trimmed(edges.where("src <> dst").distinct()), []
    while not rest.isEmpty():
        colour = _colours(rest)
        at_src, at_dst = colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("d"))
        inside = keep(rest.join(at_src, "src").join(at_dst, "dst").where("c = d").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.where("node = colour").select(F.col("node").alias("start"))
        back = reach(inside, roots).select("node", F.col("start").alias("component"))
        part = keep(back.unionByName(back.select(F.col("component").alias("node"), "component")).distinct())
        found.append(part)
        done = part.select("node").union(roots.select("start")).distinct()
        rest = _trimmed(rest.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return union_all(found) if found else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)


def edge_pairs(foundations: DataFrame) -> DataFrame:
    """Each accepted (from_id, to_id) as a depends_on and a used_by edge."""
    both = F.array(
        F.struct(F.col("from_id"), F.col("to_id"), F.lit("depends_on").alias("type")),
        F.struct(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("used_by").alias("type")),
    )
    return foundations.select(F.explode(both).alias("e")).select("e.*").withColumn("confidence", F.lit(0.75))


def usable(proposed: DataFrame, objects: DataFrame) -> DataFrame:
    """Proposed (from_id, to_id) without self loops, unknown ends and repeats."""
    ids = objects.select("id")
    ok = proposed.where("from_id <> to_id").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return ok.select("from_id", "to_id").distinct()


def acyclic(proposed: DataFrame) -> DataFrame:
    """Proposed (ordinal, from_id, to_id) that close no cycle, taken in their order.

    Only edges within a cycle of the whole proposal can close one; the others are kept as they are.  Each
    strongly connected component is then decided in order by itself.
    """
    edges = proposed.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    part = cycles(edges)
    inside = proposed.join(part.select(F.col("node").alias("from_id"), F.col("component").alias("c1")), "from_id", "left").join(part.select(F.col("node").alias("to_id"), F.col("component").alias("c2")), "to_id", "left")
    inside = keep(inside.withColumn("component", F.when(F.col("c1") == F.col("c2"), F.col("c1"))).select("ordinal", "from_id", "to_id", "component"))

    def decide(pdf):
        kept, after = [], {}
        for row in pdf.sort_values("ordinal").itertuples(index=False):
            todo, seen, closes = [row.to_id], set(), row.from_id == row.to_id
            while todo and not closes:
                n = todo.pop()
                if n in seen:
                    continue
                seen.add(n)
                closes = n == row.from_id
                todo.extend(after.get(n, ()))
            if not closes:
                after.setdefault(row.from_id, []).append(row.to_id)
                kept.append(row)
        return pdf.iloc[0:0][["ordinal", "from_id", "to_id"]] if not kept else type(pdf)(kept)[["ordinal", "from_id", "to_id"]]

    schema = ", ".join(f"{n} {t}" for n, t in proposed.select("ordinal", "from_id", "to_id").dtypes)
    return inside.where("component is null").select("ordinal", "from_id", "to_id").unionByName(inside.where("component is not null").groupBy("component").applyInPandas(decide, schema))


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
