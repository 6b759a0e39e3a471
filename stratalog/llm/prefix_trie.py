"""A trie of conversations by their turns, built in parts.

A node is a distinct sequence of turns (role, text) that conversations begin with; the root is the empty one.

* Turns are taken as SHA-256 digests before anything is shuffled.  Conversations of the same turns collapse to one
  sequence, so a copied conversation costs no more than one.
* Sequences are dealt by the digest of their first turn.  A first turn whose sequences have more turns than a task
  should hold becomes a node by itself, and its sequences are dealt again by their next turn, round by round.
* A task builds the tries of its first turns as dictionaries from digests to nodes and sums them up in postorder,
  without recursion.  Their tops are then added up to the nodes above, from the deepest round to the root.
* A part that holds a single sequence doesn't branch: its nodes are its turns, and sums over them are made in blocks.

Ids that end at a node are hashed in ascending order, from strings of up to 2**CHUNK_BITS neighbouring ids each, so a
conversation that a third of all ids share is streamed.  Conversations with at least HOT_SHARE of the turns are
numbered in ranges.

Behaviour: turns of a conversation come by ``turn`` (null first), those of equal turn by their digest, repeated
rows each count; null role or text is empty; rows without a conversation id belong to none; an empty table
gives no rows, not even a root; extra columns are ignored.  Several very long sequences that share a long beginning are
dealt a turn a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.llm.common import HOT_SHARE, Scratch, join_hot, partitions

#: Turns that a part may have: at most MOST_TURNS, and beyond LEAST_TURNS no more than an even share of all.
LEAST_TURNS, MOST_TURNS = 1_000, 100_000
#: Ids in one string of ids, and turns in one block of a lone sequence, as powers of two.
CHUNK_BITS, BLOCK_BITS = 16, 16
NOTHING = hashlib.sha256().hexdigest()

PART = "top string, depth long, parent long, seq long, pos long, digest binary, chars long, n long"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long, top string"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest, chars of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))


def number_turns(scratch: Scratch, turns: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """Adds i, from 0 in the order of a conversation; ``sizes`` has (conv, m)."""
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    inside = lambda df: df.withColumn("i", F.row_number().over(W.partitionBy("conv").orderBy(*order)).cast("long") - 1)
    hot = [r["conv"] for r in sizes.where(F.col("m") >= max(LEAST_TURNS, int(total * HOT_SHARE))).select("conv").collect()]  # 1 / HOT_SHARE at most
    if not hot:
        return inside(turns)
    # a hot conversation's turns are ranges; each counts from where those before it end
    ranges = turns.where(F.col("conv").isin(hot)).repartitionByRange(partitions(turns.sparkSession), "conv", *order).sortWithinPartitions("conv", *order)
    ranges = scratch.save(ranges.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranges")
    counts = ranges.groupBy("conv", "range").agg(F.count("*").alias("n"))
    before = counts.select("conv", "range", F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = ranges.withColumn("k", F.row_number().over(W.partitionBy("conv", "range").orderBy("at")) - 1)
    placed = own.join(F.broadcast(before), ["conv", "range"]).select("conv", "turn", "digest", "chars", (F.col("before") + F.col("k")).alias("i"))  # a row for each hot conversation and range
    return inside(turns.where(~F.col("conv").isin(hot))).unionByName(placed)


def swap_beginnings(scratch: Scratch, conversations: DataFrame, hundred: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv, size) and their turns (conv, pos, digest, chars), each conversation c begun by another's turns.

    The first h turns are those of conversation c - c % hundred (all if it has fewer), h being crc32(c) % most; c's own turns
    after its first h follow.
    """
    turns = scratch.save(turn_digests(conversations), "turns")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("m"))
    total = turns.count()
    numbered = scratch.save(number_turns(scratch, turns, sizes, total), "numbered")
    base = numbered.where((F.col("conv") % hundred == 0) & (F.col("i") < most)).select(F.col("conv").alias("base"), "i", "digest", "chars")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    begun = sizes.select("conv", "m", h, (F.col("conv") - F.col("conv") % hundred).alias("base"))
    begun = begun.join(base.groupBy("base").agg(F.count("*").alias("offered")), "base", "left")
    begun = begun.withColumn("k", F.least("h", F.coalesce("offered", F.lit(0))))
    begun = scratch.save(begun.select("conv", "m", "h", "base", "k", (F.col("k") + F.greatest(F.col("m") - F.col("h"), F.lit(0))).alias("size")), "begun")
    first = begun.where("k > 0").join(base, "base").where("i < k").select("conv", F.col("i").alias("pos"), "digest", "chars")
    own = join_hot(numbered.where("i >= 0"), begun.select("conv", "m", "h", "k"), "conv", "m", total).where("i >= h")
    own = own.select("conv", (F.col("i") - F.col("h") + F.col("k")).alias("pos"), "digest", "chars")
    rebuilt = scratch.save(first.unionByName(own), "rebuilt")
    for name in ("turns", "ranges", "numbered"):
        scratch.drop(name)
    return begun.select("conv", "size"), rebuilt


def sequences(scratch: Scratch, convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, size, n) of each distinct sequence, seq being its smallest conversation, and (seq, ends): the hashes of their ids."""
    # a sequence's key sums four parts of a digest of each turn and its place, so no task needs a whole conversation
    hexed = F.sha2(F.concat(F.col("digest"), F.col("pos").cast("string").cast("binary")), 256)
    lanes = [F.sum(F.conv(F.substring(hexed, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    keys = turns.groupBy("conv").agg(F.concat_ws(":", *lanes).alias("key"))
    keyed = scratch.save(convs.join(keys, "conv", "left").select("conv", "size", F.coalesce("key", F.lit("")).alias("key")), "keyed")
    found = scratch.save(keyed.groupBy("key", "size").agg(F.min("conv").alias("seq"), F.count("*").alias("n")), "sequences")
    # strings of neighbouring ids first; those of one sequence are then hashed in their order
    chunk = F.shiftright("conv", CHUNK_BITS).alias("chunk")
    chunks = keyed.groupBy("key", "size", chunk).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    named = chunks.join(found.select("key", "size", "seq"), ["key", "size"])
    ordered = named.select("seq", "chunk", "ids").repartition(partitions(found.sparkSession), "seq").sortWithinPartitions("seq", "chunk")
    return found.select("seq", "size", "n"), ordered.mapInArrow(_hash_runs, "seq long, ends string")


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the comma-joined strings of each run of equal ``seq``."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["seq", "ends"])
    now, state = None, None
    for batch in batches:
        done = []
        for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if state is not None and seq == now:
                state.update(b",")
            else:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = seq, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield made(done)
    if state is not None:
        yield made([(now, state.hexdigest())])


def build_tries(part: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of one task's tops (rows of PART)."""
    rows = part.sort_values(["top", "seq", "pos"])
    tops: dict[str, int] = {}
    children: list[dict[bytes, int]] = []
    first, depth, up, named, count, chars, ended = [], [], [], [], [], [], []

    def node(into: dict, key, level: int, parent: int, name: str | None, size: int) -> int:
        into[key] = len(children)
        children.append({})
        for column, x in zip((first, depth, up, named, count, chars, ended), (None, level, parent, name, 0, size, None), strict=True):
            column.append(x)
        return into[key]

    parents: dict[int, int | None] = {}
    at, seq_now, top_now = -1, None, None
    for top, level, parent, seq, digest, size, n in zip(*(rows[c].tolist() for c in ("top", "depth", "parent", "seq", "digest", "chars", "n")), strict=True):
        if (top, seq) != (top_now, seq_now):
            if at >= 0:
                ended[at] = seq_now
            at = tops.get(top, -1)
            if at < 0:
                at = node(tops, top, level, -1, top, size)
                parents[at] = parent
            top_now, seq_now = top, seq
        else:
            digest = bytes(digest)
            at = children[at][digest] if digest in children[at] else node(children[at], digest, depth[at] + 1, at, None, size)
        count[at] += n
        first[at] = seq if first[at] is None else min(first[at], seq)
    if at >= 0:
        ended[at] = seq_now
    leaves, saved = [0] * len(children), [0] * len(children)
    stack = [(t, False) for t in tops.values()]
    while stack:
        i, done = stack.pop()
        if not done:
            stack.append((i, True))
            stack.extend((c, False) for c in children[i].values())
            continue
        leaves[i] += not children[i]
        saved[i] += (count[i] - 1) * chars[i]
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    out = {
        "conv_id": first, "depth": depth, "parent_conv_id": [parents[i] if u < 0 else first[u] for i, u in enumerate(up)], "n_convs": count, "n_children": [len(c) for c in children],
        "n_leaves": leaves, "saved_tokens": saved, "ended": pd.array(ended, dtype="Int64"), "top": named,
    }
    return pd.DataFrame(out)


def lone_nodes(part: DataFrame) -> DataFrame:
    """The nodes of tops that hold a single sequence (rows of PART): its turns, with what those after them save."""
    own, block = (F.col("n") - 1) * F.col("chars"), F.shiftright("pos", BLOCK_BITS)
    rows = part.withColumn("own", own).withColumn("block", block)
    later = W.partitionBy("top").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("top", "block").agg(F.sum("own").alias("sum"), F.max("pos").alias("last")).select("top", "block", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("later"), F.coalesce(F.max("last").over(later), "last").alias("end"))
    inside = W.partitionBy("top", "block").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("own").over(inside)).join(blocks, ["top", "block"])
    top, end = F.col("pos") == F.col("depth") - 1, F.col("pos") == F.col("end")
    return rows.select(
        F.col("seq").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (F.col("inside") + F.col("later")).alias("saved_tokens"),
        F.when(end, F.col("seq")).alias("ended"), F.when(top, F.col("top")).alias("top"),
    )


def trie(spark: SparkSession, scratch: Scratch, convs: DataFrame, turns: DataFrame, part_turns: int | None = None) -> DataFrame:
    """Every node of the trie of conversations (conv, size) with turns (conv, pos, digest, chars)."""
    found, ends = sequences(scratch, convs, turns)
    totals = found.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("turns"), F.min("seq").alias("first"), F.sum("n").alias("n"), F.min(F.when(F.col("size") == 0, F.col("seq"))).alias("ended")).first()
    if not totals["n"]:
        return spark.createDataFrame([], NODES.replace("ended long, top string", "ends_sha256 string"))
    tasks = partitions(spark)
    most = part_turns or min(MOST_TURNS, max(LEAST_TURNS, totals["turns"] // tasks))
    # the root, and then every node whose sequences are dealt again: key, above, conv_id, ... by round
    root = (spark.range(1).select(
        F.lit("").alias("key"), F.lit(None).cast("string").alias("above"), F.lit(totals["first"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(totals["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"), F.lit(totals["ended"]).cast("long").alias("ended"),
    ))
    rounds, parts, tops = [root], [], []
    active = turns.withColumnRenamed("conv", "seq")
    members = found.where("size > 0").select("seq", "n", "size", F.lit("").alias("key"), F.lit(totals["first"]).cast("long").alias("parent"))
    level, left = 0, totals["turns"]
    while left:
        heads = members.join(active.where(F.col("pos") == level).select("seq", "digest", "chars"), "seq")
        heads = scratch.save(heads.select("seq", "n", "size", "key", "parent", "chars", F.sha2(F.concat(F.col("key").cast("binary"), "digest"), 256).alias("top")), f"heads{level}")
        rest = F.sum(F.col("size") - level)
        ended = F.max(F.when(F.col("size") == level + 1, F.col("seq")))
        groups = heads.groupBy("top").agg(
            F.first("key").alias("above"), F.min("seq").alias("conv_id"), F.first("parent").alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.first("chars").alias("chars"),
            ended.alias("ended"), rest.alias("rest"), F.count("*").alias("seqs"),
        )
        groups = scratch.save(groups, f"groups{level}")
        tops.append(groups.select("top", "above"))
        fate = F.when(F.col("rest") <= most, "built").when(F.col("seqs") == 1, "lone").otherwise("dealt")
        fates = groups.select("top", "conv_id", "seqs", fate.alias("fate"))
        named = join_hot(heads.select("seq", "n", "size", "parent", "top"), fates, "top", "seqs", heads.count())
        placed = join_hot(active, named.withColumn("rows", F.col("size") - level), "seq", "rows", left)
        placed = placed.select("fate", "top", F.lit(level + 1).cast("long").alias("depth"), "parent", "conv_id", "seq", "pos", "digest", "chars", "n", "size")
        placed = scratch.save(placed, f"placed{level}")
        columns = [x.split()[0] for x in PART.split(", ")]
        buckets = max(1, min(tasks, -(-left // LEAST_TURNS)), -(-2 * left // MOST_TURNS))
        built = placed.where("fate = 'built'").select(*columns, F.pmod(F.xxhash64("top"), F.lit(buckets)).alias("bucket"))
        parts += [built.groupBy("bucket").applyInPandas(build_tries, NODES)]
        lone = placed.where("fate = 'lone'").select(*columns)
        if not lone.isEmpty():
            parts += [lone_nodes(lone)]
        dealt = placed.where("fate = 'dealt'")
        rounds += [groups.where(fate == "dealt").select(F.col("top").alias("key"), "above", "conv_id", F.lit(level + 1).cast("long").alias("depth"), "parent_conv_id", "n_convs", "chars", "ended")]
        members = dealt.where((F.col("pos") == level) & (F.col("size") > level + 1)).select("seq", "n", "size", F.col("top").alias("key"), F.col("conv_id").alias("parent"))
        active = dealt.where(F.col("pos") > level).select("seq", "pos", "digest", "chars")
        level += 1
        left = active.count()
    whole = spark.createDataFrame([], NODES.replace("top string", "above string"))
    below = whole.select("above", "n_leaves", "saved_tokens")
    if parts:
        nodes = scratch.save(reduce(DataFrame.unionByName, parts), "nodes")
        below = nodes.join(reduce(DataFrame.unionByName, tops), "top").select("above", "n_leaves", "saved_tokens")
        whole = nodes.withColumnRenamed("top", "above")
        for k in range(level):
            scratch.drop(f"placed{k}")
            scratch.drop(f"heads{k}")
    for k, upper in reversed(list(enumerate(rounds))):
        sums = below.groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        own = (F.col("n_convs") - 1) * F.col("chars")
        done = scratch.save(upper.join(sums, "key", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved_tokens", F.lit(0)) + own).alias("saved_tokens"), "ended", "above",
        ), f"upper{k}")
        below = below.unionByName(done.where("above is not null").select("above", "n_leaves", "saved_tokens"))
        whole = whole.unionByName(done)
    out = [x.split()[0] for x in NODES.split(", ")][:-2]
    none = whole.where("ended is null").select(*out, F.lit(NOTHING).alias("ends_sha256"))
    return none.unionByName(whole.where("ended is not null").join(ends.withColumnRenamed("seq", "ended"), "ended").select(*out, F.col("ends").alias("ends_sha256")))


def conversation_trie(spark: SparkSession, conversations: DataFrame, part_turns: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node over rebuilt conversations."""
    scratch = Scratch(spark, "trie")
    convs, turns = swap_beginnings(scratch, conversations)
    return trie(spark, scratch, convs, turns, part_turns)


#: crc32 by bytes, from a table made by its rule.
TRIE_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS i, digest, chars
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (SELECT c.conv_id, t.i, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL SELECT c.conv_id, t.i, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h),
whole AS (SELECT conv_id, coalesce(list(digest ORDER BY i) FILTER (digest IS NOT NULL), []) AS path, coalesce(list(chars ORDER BY i) FILTER (digest IS NOT NULL), []) AS chars FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
steps AS (SELECT conv_id, path, chars, unnest(range(0, len(path) + 1)) AS depth FROM whole),
nodes AS (SELECT path[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(chars[depth]), 0) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256 FROM steps GROUP BY 1, 2),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (SELECT path[1:up] AS path, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM known) GROUP BY 1)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM known k JOIN sums s USING (path) LEFT JOIN known p ON k.depth > 0 AND p.path = k.path[1:k.depth - 1]"""
