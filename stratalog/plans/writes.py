"""What drafts, decisions, merges and commands leave of the lake."""

from pyspark.sql import functions as F

from stratalog.functions import phrases
from stratalog.operators import transitions
from stratalog.plans.knowledge import MERGES
from stratalog.plans.registry import query

STORED = "SELECT id, CASE kind WHEN 'process' THEN 'skill' ELSE kind END AS kind, title, body, status, version, num FROM lake_objects"


@query("put_objects", f"SELECT coalesce(o.id, n.id) AS id, coalesce(o.kind, n.kind) AS kind, coalesce(n.title, o.title) AS title, coalesce(n.body, o.body) AS body, CASE WHEN o.status = 'approved' AND o.kind = 'skill' AND n.id IS NOT NULL THEN 'approved' WHEN n.id IS NOT NULL THEN 'proposed' ELSE o.status END AS status, coalesce(n.version, o.version) AS version FROM ({STORED}) o FULL JOIN (SELECT CASE WHEN num % 7 = 0 THEN id || '-new' ELSE id END AS id, kind, upper(title) AS title, body || ' (draft)' AS body, 1::BIGINT AS version FROM ({STORED}) WHERE num % 3 = 0 OR num % 7 = 0) n ON n.id = o.id")
def put_objects(lake):
    """Drafts over stored objects: some replace one, some are new."""
    columns = ["id", "kind", "title", "body", "status", "version"]
    stored = lake.objects.withColumn("kind", F.when(F.col("kind") == "process", "skill").otherwise(F.col("kind")))
    drafts = stored.where("num % 3 = 0 or num % 7 = 0").select(
        F.when(F.col("num") % 7 == 0, F.concat("id", F.lit("-new"))).otherwise(F.col("id")).alias("id"), "kind", F.upper("title").alias("title"), F.concat("body", F.lit(" (draft)")).alias("body"),
        F.lit("proposed").alias("status"), F.lit(1).cast("long").alias("version"),
    )
    return transitions.put_objects(stored.select(*columns), drafts)


DECISIONS = "SELECT id, CASE WHEN num % 12 = 0 THEN ' ' ELSE body || ' (final)' END AS body, 'owner' AS decided_by, 2000 + num AS decided_at FROM lake_objects WHERE num % 4 = 0 OR num % 7 = 0"
ACCEPTED = f"SELECT d.* FROM ({DECISIONS}) d JOIN lake_objects o ON o.id = d.id WHERE o.n_evidence > 0 AND trim(d.body) <> ''"
AFFECTED = f"ok AS ({ACCEPTED}), walk AS (SELECT id AS start, id AS node FROM ok UNION SELECT w.start, r.to_id FROM walk w JOIN lake_relations r ON r.from_id = w.node WHERE r.type = 'used_by'), aff AS (SELECT start, node, ok.decided_at FROM walk JOIN ok ON ok.id = start WHERE start <> node)"


def _decisions(lake):
    body = F.when(F.col("num") % 12 == 0, " ").otherwise(F.concat("body", F.lit(" (final)")))
    return lake.objects.where("num % 4 = 0 or num % 7 = 0").select("id", body.alias("body"), F.lit("owner").alias("decided_by"), (2000 + F.col("num")).alias("decided_at"))


@query("approve_objects", f"WITH RECURSIVE {AFFECTED}, hits AS (SELECT a.node AS id, min(a.decided_at) AS hit FROM aff a LEFT JOIN ok ON ok.id = a.node WHERE ok.decided_at IS NULL OR a.decided_at > ok.decided_at GROUP BY 1) SELECT o.id, coalesce(ok.body, o.body) AS body, CASE WHEN ok.id IS NOT NULL THEN 'approved' ELSE o.status END AS status, o.version + CASE WHEN ok.id IS NOT NULL THEN 1 ELSE 0 END AS version, CASE WHEN ok.id IS NULL AND o.stale THEN o.updated ELSE hit END AS stale_since FROM lake_objects o LEFT JOIN ok ON ok.id = o.id LEFT JOIN hits h ON h.id = o.id")
def approve_objects(lake):
    return transitions.approve_all(lake.objects, lake.relations, _decisions(lake))


@query("approval_affects", f"WITH RECURSIVE {AFFECTED} SELECT start, node, decided_at FROM aff")
def approval_affects(lake):
    return transitions.affected(lake.objects, lake.relations, _decisions(lake)).select("start", "node", "decided_at")


@query("version_snapshots", f"SELECT o.id AS object_id, o.version, o.body, o.status, o.updated AS valid_from, d.decided_at AS valid_to, d.decided_by FROM lake_objects o JOIN ({ACCEPTED}) d ON d.id = o.id")
def version_snapshots(lake):
    return transitions.snapshots(lake.objects, _decisions(lake))


@query("suggest_edits", f"SELECT o.id, coalesce(d.body, o.body) AS body, CASE WHEN d.id IS NOT NULL THEN 'proposed' ELSE o.status END AS status, o.stale AND d.id IS NULL AS stale FROM lake_objects o LEFT JOIN ({ACCEPTED}) d ON d.id = o.id")
def suggest_edits(lake):
    return transitions.suggest_edits(lake.objects, _decisions(lake)).select("id", "body", "status", "stale")


def _merges(lake):
    a = lake.objects.where("num % 10 = 0").select(F.col("id").alias("keep"), (F.col("num") + 1).alias("num"))
    return a.join(lake.objects.select(F.col("id").alias("drop"), "num"), "num").select("keep", "drop")


@query("merge_evidence", f"SELECT object_id, document_id, quote, first_seen FROM lake_evidence UNION SELECT m.keep, e.document_id, e.quote, e.first_seen FROM lake_evidence e JOIN ({MERGES}) m ON m.drop = e.object_id")
def merge_evidence(lake):
    return transitions.merge_evidence(lake.evidence.select("object_id", "document_id", "quote", "first_seen"), _merges(lake))


@query("merged_objects", f"SELECT o.id, CASE WHEN d.drop IS NOT NULL THEN 'superseded' ELSE o.status END AS status, k.drop AS supersedes FROM lake_objects o LEFT JOIN ({MERGES}) d ON d.drop = o.id LEFT JOIN ({MERGES}) k ON k.keep = o.id")
def merged_objects(lake):
    return transitions.merged(lake.objects.select("id", "status"), _merges(lake))


def _beside(k: int) -> str:
    return f"SELECT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id FROM lake_objects a JOIN lake_objects b ON b.num = a.num + {k}"


@query("merge_hint_states", f"SELECT h.left_id, h.right_id, CASE WHEN m.keep IS NOT NULL THEN 'merged' WHEN length(h.left_id) % 3 = 0 THEN 'dismissed' ELSE 'open' END AS state FROM ({_beside(1)} UNION {_beside(2)}) h LEFT JOIN ({MERGES}) m ON least(m.keep, m.drop) = h.left_id AND greatest(m.keep, m.drop) = h.right_id")
def merge_hint_states(lake):
    o = lake.objects.select("id", "num")
    pairs = [o.select(F.col("id").alias("left_id"), (F.col("num") + k).alias("num")).join(o.withColumnRenamed("id", "right_id"), "num").select("left_id", "right_id") for k in (1, 2)]
    hints = transitions.canonical_pairs(pairs[0].unionByName(pairs[1]))
    return transitions.hint_states(hints, _merges(lake), hints.where(F.length("left_id") % 3 == 0))


COMMANDS = "['put','scanned','pause','resume','remove','scanned','put']"
SOURCE_LOG = f"SELECT 'source-' || (user_id % 500) AS source_id, event_id AS seq, {COMMANDS}[(event_id % 7 + 1)::INT] AS command, 'name-' || event_id AS name FROM events"


def _source_log(lake):
    names = [x.strip("'") for x in COMMANDS[1:-1].split(",")]
    command = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    key = F.concat(F.lit("source-"), (F.col("user_id") % 500).cast("string"))
    return lake.raw("events").select(key.alias("source_id"), F.col("event_id").alias("seq"), command.alias("command"), F.concat(F.lit("name-"), F.col("event_id").cast("string")).alias("name"))


SOURCES = f"""SELECT source_id, (SELECT arg_max(name, seq) FROM ({SOURCE_LOG}) p WHERE p.source_id = s.source_id AND command = 'put') AS name,
  CASE state WHEN 'pause' THEN 'paused' WHEN 'remove' THEN 'removed' ELSE 'active' END AS status, last_scan
FROM (SELECT source_id, seq, last_value(CASE WHEN command = 'scanned' AND kept = 'pause' THEN 'pause' WHEN command = 'put' AND seq > first THEN CASE WHEN kept_scan > kept_at AND kept <> 'pause' THEN 'resume' ELSE kept END ELSE command END) OVER w AS state,
    max(CASE WHEN command = 'scanned' THEN seq END) OVER w AS last_scan, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS back
  FROM (SELECT *, last_value(CASE WHEN command IN ('pause', 'resume', 'remove') OR seq = first THEN command END IGNORE NULLS) OVER w AS kept,
      max(CASE WHEN command IN ('pause', 'resume', 'remove') OR seq = first THEN seq END) OVER w AS kept_at, max(CASE WHEN command = 'scanned' THEN seq END) OVER w AS kept_scan
    FROM (SELECT *, min(CASE WHEN command = 'put' THEN seq END) OVER (PARTITION BY source_id) AS first FROM ({SOURCE_LOG})) WHERE seq >= first WINDOW w AS (PARTITION BY source_id ORDER BY seq))
  WINDOW w AS (PARTITION BY source_id ORDER BY seq)) s WHERE back = 1"""


@query("source_states", SOURCES)
def source_states(lake):
    """Sources after a log of commands; the SQL walks the log command by command."""
    return transitions.fold_sources(_source_log(lake))


@query("watched_roots", f"SELECT e.source_id, count(*) AS events FROM (SELECT 'source-' || (user_id % 500) AS source_id, ['create','modify','remove','access','other'][(event_id % 5 + 1)::INT] AS change FROM events) e JOIN ({SOURCES}) s ON s.source_id = e.source_id WHERE s.status = 'active' AND change IN ('create', 'modify', 'remove') GROUP BY 1")
def watched_roots(lake):
    """Changes that matter, under folders that are active."""
    change = F.element_at(F.array(*map(F.lit, ("create", "modify", "remove", "access", "other"))), (F.col("seq") % 5 + 1).cast("int"))
    seen = _source_log(lake).select("source_id", change.alias("change")).where(F.col("change").isin("create", "modify", "remove")).groupBy("source_id").agg(F.count("*").alias("events"))
    return seen.join(transitions.fold_sources(_source_log(lake)).where("status = 'active'").select("source_id"), "source_id", "left_semi")


CASE_LOG = "SELECT 'case-' || (user_id % 700) AS case_id, event_id AS seq, ['open','record','record','close','record'][(event_id % 5 + 1)::INT] AS command, (props ->> '$.k')::BIGINT AS object FROM events"


@query("case_log", f"SELECT c.case_id, opened, (SELECT min(seq) FROM ({CASE_LOG}) x WHERE x.case_id = c.case_id AND command = 'close' AND seq > opened) AS closed, count(*) FILTER (command = 'record') AS reads, count(DISTINCT object) FILTER (command = 'record') AS objects FROM ({CASE_LOG}) c JOIN (SELECT case_id, min(seq) AS opened FROM ({CASE_LOG}) WHERE command = 'open' GROUP BY 1) o ON o.case_id = c.case_id GROUP BY c.case_id, opened")
def case_log(lake):
    command = F.element_at(F.array(*map(F.lit, ("open", "record", "record", "close", "record"))), (F.col("event_id") % 5 + 1).cast("int"))
    log = lake.raw("events").select(
        F.concat(F.lit("case-"), (F.col("user_id") % 700).cast("string")).alias("case_id"), F.col("event_id").alias("seq"), command.alias("command"), F.get_json_object("props", "$.k").cast("long").alias("object")
    )
    return transitions.fold_cases(log)


@query("settings_after", "SELECT key, value FROM (SELECT 'k' || (user_id % 90) AS key, CASE WHEN event_id % 8 <> 0 THEN 'v' || event_id END AS value, row_number() OVER (PARTITION BY user_id % 90 ORDER BY event_id DESC) AS back FROM events) WHERE back = 1")
def settings_after(lake):
    value = F.when(F.col("event_id") % 8 != 0, F.concat(F.lit("v"), F.col("event_id").cast("string")))
    writes = lake.raw("events").select(F.concat(F.lit("k"), (F.col("user_id") % 90).cast("string")).alias("key"), value.alias("value"), F.col("event_id").alias("seq"))
    return transitions.last_settings(writes)


@query("block_by_locator", "SELECT b.document_id, b.ordinal, b.start_byte, b.end_byte FROM (SELECT document_id, ordinal, start_byte, end_byte, 'line ' || (ordinal + 1) AS locator FROM lake_blocks) b JOIN (SELECT id, 'line ' || (num % 4 + 1) AS locator FROM lake_documents) w ON w.id = b.document_id AND w.locator = b.locator")
def block_by_locator(lake):
    """The block that a locator names, for a locator in each document."""
    line = lambda c: F.concat(F.lit("line "), (c + 1).cast("string")).alias("locator")
    wanted = lake.documents.select(F.col("id").alias("document_id"), line(F.col("num") % 4))
    return lake.blocks.select("document_id", "ordinal", "start_byte", "end_byte", line(F.col("ordinal"))).join(wanted, ["document_id", "locator"]).drop("locator")


NOTES = "SELECT *, payload ->> '$.document' AS subject, CASE id % 5 WHEN 1 THEN 'started' WHEN 2 THEN (payload ->> '$.document') || ': reading' WHEN 3 THEN 'x: y' END AS note FROM lake_jobs"


@query("work_lines", f"SELECT id, CASE WHEN id % 6 = 0 THEN CASE kind WHEN 'relate' THEN 'Connections between everything' ELSE 'Your company' END ELSE subject END AS about, CASE WHEN starts_with(coalesce(note, last_error, 'started'), subject || ': ') THEN substr(coalesce(note, last_error, 'started'), length(subject) + 3) ELSE coalesce(note, last_error, 'started') END AS line FROM ({NOTES})")
def work_lines(lake):
    """What a line of the work list says: a note, else the error, without the subject that stands before it."""
    subject = F.get_json_object("payload", "$.document")
    note = F.when(F.col("id") % 5 == 1, "started").when(F.col("id") % 5 == 2, F.concat(subject, F.lit(": reading"))).when(F.col("id") % 5 == 3, "x: y")
    jobs = lake.jobs.select("id", "kind", "last_error", F.when(F.col("id") % 6 != 0, subject).alias("about"), subject.alias("subject"), note.alias("note"))
    return jobs.select("id", F.coalesce("about", phrases.whole_lake(F.col("kind"))).alias("about"), phrases.work_line(F.col("note"), F.col("last_error"), F.col("subject")).alias("line"))
