"""State transitions as functions from snapshots to snapshots: upserts, approvals, merges, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.graph import reach


def upsert(old: DataFrame, new: DataFrame, key: str, first: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` under one key; columns in ``first`` keep their oldest value."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(f"o.{c}", f"n.{c}") if c in first else F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[c.alias(x) for c, x in zip(cols, old.columns, strict=True)])


def changed(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of ``new`` whose key and digest ``old`` doesn't have."""
    return new.join(old.select(key, digest), [key, digest], "left_anti")


def put_objects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Objects of ``old`` and ``new``: a new draft overwrites all but the kind, and an approved skill stays approved."""
    kept = (F.col("o.status") == "approved") & (F.coalesce("o.kind", "n.kind") == "skill") & (F.col("n.status") == "proposed")
    drafted = F.col("n.id").isNotNull()
    pick = {
        "id": F.coalesce("o.id", "n.id"), "kind": F.coalesce("o.kind", "n.kind"),
        "status": F.when(kept, "approved").when(drafted, F.col("n.status")).otherwise(F.col("o.status")),
    }
    cols = [pick.get(c, F.when(drafted, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in old.columns]
    return old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full").select(*cols)


def accepted(objects: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, body, decided_by, decided_at) that may take effect: the object is there, has evidence, and the text isn't blank."""
    there = objects.where("n_evidence > 0").select("id")
    return decisions.where(F.trim("body") != "").join(there, "id", "left_semi")


def snapshots(objects: DataFrame, decisions: DataFrame) -> DataFrame:
    """The versions that approvals put out of effect, as they were."""
    now = accepted(objects, decisions).select("id", "decided_by", "decided_at")
    return objects.join(now, "id").select(
        F.col("id").alias("object_id"), "version", "body", "status", F.col("updated").alias("valid_from"), F.col("decided_at").alias("valid_to"), "decided_by"
    )


def affected(objects: DataFrame, relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """(start, node, decided_at): what uses an approved object, directly or not, with the moment of the approval."""
    ok = accepted(objects, decisions).select(F.col("id").alias("start"), "decided_at")
    uses = relations.where("type = 'used_by'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return reach(uses, ok.select("start")).select("start", "node").join(ok, "start")


def approve_all(objects: DataFrame, relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Objects after ``decisions`` (id, body, decided_by, decided_at; one an object), with ``stale_since`` in place of ``stale``.

    An approval sets the text, raises the version and clears staleness; what uses the object is stale from the
    earliest approval on that came after its own.
    """
    own = accepted(objects, decisions).select("id", F.col("body").alias("new_body"), F.col("decided_at").alias("own_at"))
    o = objects.join(own, "id", "left")
    hits = affected(objects, relations, decisions).select(F.col("node").alias("id"), "decided_at").join(own.select("id", "own_at"), "id", "left")
    hits = hits.where("own_at is null or decided_at > own_at").groupBy("id").agg(F.min("decided_at").alias("hit"))
    ok = F.col("own_at").isNotNull()
    return o.join(hits, "id", "left").select(
        "id", F.coalesce("new_body", "body").alias("body"), F.when(ok, "approved").otherwise(F.col("status")).alias("status"), (F.col("version") + ok.cast("long")).alias("version"),
        F.coalesce(F.when(~ok & F.col("stale"), F.col("updated")), "hit").alias("stale_since"),
    )


def suggest_edits(objects: DataFrame, edits: DataFrame) -> DataFrame:
    """Objects after ``edits`` (id, body, decided_by, decided_at): the new text waits for approval, out of what is served."""
    e = accepted(objects, edits).select("id", F.col("body").alias("edit"))
    new = F.col("edit").isNotNull()
    both = objects.join(e, "id", "left")
    return both.withColumn("body", F.coalesce("edit", "body")).withColumn("status", F.when(new, "proposed").otherwise(F.col("status"))).withColumn("stale", F.col("stale") & ~new).drop("edit")


def approve(objects: DataFrame, decisions: DataFrame) -> DataFrame:
    """Objects after ``decisions`` (id, decision): an approval needs evidence and a body and raises the version."""
    d = objects.join(decisions, "id", "left")
    ok = (F.col("decision") == "approve") & (F.col("n_evidence") > 0) & (F.length("body") > 0)
    status = F.when(ok, "approved").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status"))
    return d.withColumn("status", status).withColumn("version", F.when(ok, F.col("version") + 1).otherwise(F.col("version"))).drop("decision")


def merge_pairs(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """Relations after each (keep, drop) of ``merges``: what named the dropped object names the kept one, self loops and
    repeats go.  Edges that leave the dropped object stay with it."""
    to = merges.select(F.col("drop").alias("to_id"), F.col("keep").alias("new_to"))
    moved = relations.join(to, "to_id", "left").select("from_id", F.coalesce("new_to", "to_id").alias("to_id"), "type")
    return moved.where("from_id <> to_id").distinct()


def merge_evidence(evidence: DataFrame, merges: DataFrame) -> DataFrame:
    """Evidence after ``merges``: the kept object rests on what the dropped one rests on, too, each span once."""
    moved = evidence.join(merges.withColumnRenamed("drop", "object_id"), "object_id").drop("object_id").withColumnRenamed("keep", "object_id")
    return evidence.unionByName(moved.select(*evidence.columns)).distinct()


def merged(objects: DataFrame, merges: DataFrame) -> DataFrame:
    """Objects after ``merges``: the dropped one is superseded, the kept one says by ``supersedes`` which it replaced
    (of several the greatest id)."""
    gone = merges.select(F.col("drop").alias("id")).distinct().withColumn("gone", F.lit(True))
    took = merges.groupBy(F.col("keep").alias("id")).agg(F.max("drop").alias("supersedes"))
    both = objects.join(gone, "id", "left").join(took, "id", "left")
    return both.withColumn("status", F.when(F.col("gone"), "superseded").otherwise(F.col("status"))).drop("gone")


def hint_states(hints: DataFrame, merges: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(left_id, right_id, state) of canonical pairs: merged before dismissed before open."""
    named = lambda df, a, b, as_: df.select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")).distinct().withColumn(as_, F.lit(True))
    keys = ["left_id", "right_id"]
    both = hints.join(named(merges, "keep", "drop", "m"), keys, "left").join(named(dismissed, "left_id", "right_id", "d"), keys, "left")
    return both.select(*keys, F.when(F.col("m"), "merged").when(F.col("d"), "dismissed").otherwise("open").alias("state"))


def canonical_pairs(hints: DataFrame) -> DataFrame:
    """Each unordered pair once, the smaller id first."""
    return hints.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()


def upsert_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both; where both have one, what the new one leaves open stays."""
    keys = ["from_id", "to_id", "type"]
    joined = old.withColumnRenamed("confidence", "c_old").join(new.withColumnRenamed("confidence", "c_new"), keys, "full")
    return joined.select(*keys, F.coalesce("c_new", "c_old").alias("confidence"))


def missing_files(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """Documents (id, name, gone) after a listing (name): what it lacks is gone, what it has again is back."""
    seen = listing.select("name").distinct().withColumn("seen", F.lit(True))
    return documents.join(seen, "name", "left").withColumn("gone", F.col("seen").isNull()).drop("seen")


def gone_reviews(documents: DataFrame, evidence: DataFrame, resolved: DataFrame) -> DataFrame:
    """(object_id, document_id) that rest on a gone document and that nobody has resolved."""
    gone = documents.where("gone").select(F.col("id").alias("document_id"))
    return evidence.join(gone, "document_id", "left_semi").select("object_id", "document_id").distinct().join(resolved, ["object_id", "document_id"], "left_anti")


def replace_for(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and of ``old`` under keys that ``new`` doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both, of equal keys the old row only."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def fold_sources(commands: DataFrame) -> DataFrame:
    """Sources after ``commands`` (source_id, seq, command, name): put, pause, resume, remove, scanned, in order of seq.

    What comes before a source's first put does nothing.  A later put renames and leaves the status.  A scan makes a
    source active unless it is paused.  The result has source_id, name, status and last_scan, with one row a source.
    """
    first = commands.where("command = 'put'").groupBy("source_id").agg(F.min("seq").alias("first"))
    c = commands.join(first, "source_id").where("seq >= first")
    sets = F.col("command").isin("pause", "resume", "remove") | (F.col("seq") == F.col("first"))
    scan = F.when(F.col("command") == "scanned", F.col("seq"))
    folded = c.groupBy("source_id").agg(
        F.max_by("name", F.when(F.col("command") == "put", F.col("seq"))).alias("name"), F.max_by("command", F.when(sets, F.col("seq"))).alias("last"),
        F.max(F.when(sets, F.col("seq"))).alias("set_at"), F.max(scan).alias("last_scan"),
    )
    status = F.when(F.col("last") == "pause", "paused").when((F.col("last") == "remove") & ~F.coalesce(F.col("last_scan") > F.col("set_at"), F.lit(False)), "removed").otherwise("active")
    return folded.select("source_id", "name", status.alias("status"), "last_scan")


def fold_cases(commands: DataFrame) -> DataFrame:
    """Cases after ``commands`` (case_id, seq, command, object): open, record, close, in order of seq.

    The first open counts, and the first close after it; a read is recorded whenever it comes.
    """
    opened = commands.where("command = 'open'").groupBy("case_id").agg(F.min("seq").alias("opened"))
    closing = F.when((F.col("command") == "close") & (F.col("seq") > F.col("opened")), F.col("seq"))
    read = F.when(F.col("command") == "record", F.col("object"))
    return commands.join(opened, "case_id").groupBy("case_id", "opened").agg(F.min(closing).alias("closed"), F.count(read).alias("reads"), F.count_distinct(read).alias("objects"))


def last_settings(writes: DataFrame) -> DataFrame:
    """(key, value) after ``writes`` (key, value, seq): the last write of each key, null values included."""
    return writes.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("last")).select("key", "last.value")
