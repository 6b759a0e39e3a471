"""Queries over names, lines, notes and errors, skills and back, supervision, coverage and health."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions import display, phrases
from stratalog.operators import supervisor
from stratalog.plans.registry import query

# names and lines

TITLE = "'  ' || p_name || ' — Čaj & Ünit #' || p_partkey || ', ' || p_type"
KEBAB = "array_to_string([w FOR w IN string_split(regexp_replace(translate(lower({0}), 'čćžšđ', 'cczsd'), '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '-') IF w <> ''][1:{1}], '-')"


@query("slugs", f"SELECT p_partkey, {KEBAB.format('t', 5)} AS agent, CASE WHEN p_partkey % 10 = 0 THEN 'skill' ELSE {KEBAB.format('t', 6)} END AS prompt, lower(regexp_replace(t, '[^A-Za-z0-9]', '-', 'g')) AS cassette, replace(replace(t, '&', '&amp;'), '\"', '&quot;') AS xml FROM (SELECT p_partkey, {TITLE} AS t FROM part)")
def slugs(lake):
    """A title as an agent's fact, a prompt, a recorded reply and inside markup are named; a prompt without words is a skill."""
    t = F.concat(F.lit("  "), "p_name", F.lit(" — Čaj & Ünit #"), F.col("p_partkey").cast("string"), F.lit(", "), "p_type")
    prompt = F.when(F.col("p_partkey") % 10 == 0, "— !").otherwise(t)
    return lake.raw("part").select("p_partkey", display.agent_slug(t).alias("agent"), display.prompt_slug(prompt).alias("prompt"), display.cassette_slug(t).alias("cassette"), display.xml_escape(t).alias("xml"))


CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE substr({0}, 1, {1}) || '…' END"
FLAT = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')"
LINES = r"[regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN regexp_split_to_array({0}, '\r?\n')]"


@query("shown_lines", f"SELECT doc_id, {CUT.format('first', 200)} AS first, {CUT.format('flat', 80)} AS flat, {CUT.format('text', 60)} AS short, substr(coalesce(said, 'A procedure this company approved.'), 1, 160) AS procedure FROM (SELECT doc_id, text, coalesce([x FOR x IN l IF x <> ''][1], '') AS first, {FLAT} AS flat, [x FOR x IN l IF x <> '' AND NOT starts_with(x, '#')][1] AS said FROM (SELECT doc_id, text, {LINES.format('text')} AS l FROM documents))")
def shown_lines(lake):
    t = F.col("text")
    return lake.raw("documents").select("doc_id", display.first_line(t).alias("first"), display.truncate(t, 80).alias("flat"), display.short(t).alias("short"), display.procedure_line(t).alias("procedure"))


PHRASE = "CASE WHEN s < 60 THEN '' WHEN s < 3600 THEN s // 60 || ' min' ELSE s // 3600 || ' h' END"


@query("running_notes", f"SELECT id, CASE WHEN engine IS NOT NULL AND p = '' THEN engine || ' is running' WHEN engine IS NOT NULL THEN engine || ' · ' || p WHEN p = '' THEN 'running' ELSE 'running for ' || p END AS note, CASE WHEN attempts = 1 THEN '1 try' ELSE attempts || ' tries' END AS tries FROM (SELECT id, attempts, engine, {PHRASE} AS p FROM (SELECT id, attempts, CASE WHEN id % 3 = 0 THEN 'engine-' || id % 2 END AS engine, CASE WHEN id % 11 = 0 THEN 0 ELSE greatest(0, (id * 37) % 9000 - 500) END AS s FROM lake_jobs))")
def running_notes(lake):
    """What is shown beside a running job: who runs it and for how long; starts that can't be read count from now."""
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    at = F.when(F.col("id") % 11 == 0, "soon").otherwise(F.date_format(F.timestamp_seconds(F.lit(1_700_000_500) - F.col("id") * 37 % 9000), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    engine = F.when(F.col("id") % 3 == 0, F.concat(F.lit("engine-"), (F.col("id") % 2).cast("string")))
    phrase = phrases.duration_phrase(display.elapsed_seconds(at, now))
    return lake.jobs.select("id", display.running_note(engine, phrase).alias("note"), display.plural(F.col("attempts"), "try", "tries").alias("tries"))


SAID = ("banner 1.0\nError: rate limit\nError: rate limit\n  fatal:  no   net  ", "just  one\nline", "noise " * 80 + "the end", "x error: low\nERROR top\nok")
OUT = ('{"type":"result","is_error":true,"result":"limit"}', 'log\n{"type":"turn.failed","n":1}\n{"type":"error"}', '{"type":"result","is_error":"true"}', 'plain\n{"type":"result","is_error":false}')


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


@query("error_said", rf"""SELECT id, {_sql_list(('Error: rate limit fatal: no net', 'just one line', '…' + ('noise ' * 80 + 'the end')[-300:], 'x error: low ERROR top'))}[(id % 4 + 1)::INT] || ' #' || id AS complaint,
CASE id % 4 WHEN 0 THEN '{OUT[0]}' WHEN 1 THEN '{{"type":"turn.failed","n":1}}' END AS envelope FROM lake_jobs""")
def error_said(lake):
    """What engines said when they failed: the complaint, each line once and the end of long ones; and the record that says so."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % 4 + 1).cast("int"))
    return lake.jobs.select("id", F.concat(display.complaint(pick(SAID)), F.lit(" #"), F.col("id").cast("string")).alias("complaint"), display.error_envelope(pick(OUT)).alias("envelope"))


# skills and back

BELOW = "SELECT from_id AS id, to_id, row_number() OVER (PARTITION BY from_id ORDER BY to_id) - 1 AS place FROM (SELECT DISTINCT from_id, to_id FROM lake_relations WHERE type = 'depends_on')"


def _skills(lake):
    """Processes as skills: what they rest on goes in, what uses them comes out, with two steps between."""
    ways = lambda a, b, kind: lake.relations.where(F.col("type") == kind).groupBy(F.col(a).alias("id")).agg(F.array_sort(F.collect_set(b)).alias(kind))
    o = lake.objects.where("kind = 'process'").select("id", "title", "body").join(ways("from_id", "to_id", "depends_on"), "id", "left").join(ways("from_id", "to_id", "used_by"), "id", "left")
    items = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x, F.lit(" — what "), x, F.lit(" says — now"), F.lit("\n")))
    part = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(items(F.col(c)), ""), F.lit("\n"))).otherwise("")
    text = F.concat("title", F.lit("\n"), "body", F.lit("\n\n"), part("**Before you start**\n\n", "depends_on"), F.lit("**Steps**\n\n1. read\n2. write\n\n"), part("**Result**\n\n", "used_by"))
    return o.select("id", text.alias("markdown"))


@query("skill_fields", f"SELECT b.id, place, to_id AS name, 'what ' || to_id || ' says — now' AS description FROM ({BELOW}) b JOIN lake_objects o ON o.id = b.id WHERE o.kind = 'process'")
def skill_fields(lake):
    """What a skill needs before it starts, read back out of its Markdown."""
    lines = _skills(lake).select("id", F.posexplode(F.split("markdown", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    upto = W.partitionBy("id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    under = lines.withColumn("under", F.last(F.when(F.startswith("line", F.lit("**")), F.col("line")), ignorenulls=True).over(upto))
    item = under.where((F.col("under") == "**Before you start**") & F.startswith("line", F.lit("- "))).withColumn("item", F.substr("line", F.lit(3)))
    place = F.row_number().over(W.partitionBy("id").orderBy("n")) - 1
    name = F.split("item", " — ", 2)
    return item.select("id", place.cast("long").alias("place"), F.trim(name[0]).alias("name"), F.trim(F.coalesce(F.get(name, 1), F.lit(""))).alias("description"))


@query("skill_descriptions", "SELECT id, title || ' ' || body AS description FROM lake_objects WHERE kind = 'process'")
def skill_descriptions(lake):
    """What stands before a skill's first heading, as one line."""
    head = F.filter(display.lines(F.split_part("markdown", F.lit("**"), F.lit(1))), lambda x: x != "")
    return _skills(lake).select("id", F.array_join(head, " ").alias("description"))


# supervision

ASKED = "SELECT ordinal, document AS document_id, 'Is ' || title || ' right?' AS question, CASE WHEN ordinal % 9 = 0 THEN ' ' ELSE quote END AS quote, CASE WHEN ordinal % 4 <> 0 THEN key END AS object_id FROM lake_claims"
QUIZ = f"""asked AS ({ASKED}),
flat AS (SELECT id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM lake_documents WHERE id IN (SELECT document_id FROM asked)),
there AS (SELECT a.*, trim(regexp_replace(a.quote, '\\s+', ' ', 'g')) AS q, flat FROM asked a JOIN flat f ON f.id = a.document_id WHERE trim(a.quote) <> ''),
fit AS (SELECT * FROM there WHERE length(q) > 0 AND (length(flat) - length(replace(flat, q, ''))) // length(q) = 1 AND (object_id IS NULL OR object_id IN (SELECT id FROM lake_objects WHERE status = 'proposed'))),
firsts AS (SELECT document_id, question, min(ordinal) AS ordinal, arg_min(quote, ordinal) AS quote, (array_agg(object_id ORDER BY ordinal))[1] AS object_id FROM fit GROUP BY ALL),
quiz AS (SELECT 's1:' || (row_number() OVER (ORDER BY ordinal) - 1) || ':' || ordinal AS id, document_id, question, quote, object_id FROM firsts)"""


def _quiz(lake):
    asked = lake.claims.select(
        "ordinal", F.col("document").alias("document_id"), F.concat(F.lit("Is "), "title", F.lit(" right?")).alias("question"), F.when(F.col("ordinal") % 9 == 0, " ").otherwise(F.col("quote")).alias("quote"),
        F.when(F.col("ordinal") % 4 != 0, F.col("key")).alias("object_id"),
    )
    return supervisor.quiz(asked, lake.documents, lake.objects.where("status = 'proposed'"), "s1")


@query("quiz_questions", f"WITH RECURSIVE {QUIZ} SELECT id, document_id, question, quote, object_id FROM quiz")
def quiz_questions(lake):
    """The owner's quiz: questions whose quotes stand in their documents and whose proposals are still open."""
    return _quiz(lake)


@query("quiz_confirmed", f"WITH RECURSIVE {QUIZ}, yes AS (SELECT id FROM lake_objects WHERE num % 7 = 0) SELECT o.id, CASE WHEN y.id IS NOT NULL THEN 'approved' WHEN status = 'proposed' AND o.id IN (SELECT object_id FROM quiz WHERE object_id IS NOT NULL) THEN 'rejected' ELSE status END AS status, CASE WHEN y.id IS NOT NULL OR status = 'proposed' AND o.id IN (SELECT object_id FROM quiz WHERE object_id IS NOT NULL) THEN 'owner:quiz' END AS decided_by FROM lake_objects o LEFT JOIN yes y ON y.id = o.id")
def quiz_confirmed(lake):
    """Objects after the owner has approved every seventh and with that refused the rest that was asked about."""
    return supervisor.confirm(lake.objects.select("id", "status"), _quiz(lake), lake.objects.where("num % 7 = 0"))


@query("may_relate", "SELECT id, CASE WHEN id % 2 = 0 THEN true WHEN phase IS NOT NULL THEN phase = 'complete' ELSE coalesce(quiz = 'confirmed', false) END AS may FROM (SELECT id, [NULL, 'quiz_pending', 'complete', NULL][(id % 4 + 1)::INT] AS phase, [NULL, 'confirmed', 'open'][(id % 3 + 1)::INT] AS quiz FROM lake_jobs)")
def may_relate(lake):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int"))
    return lake.jobs.select("id", supervisor.may_relate(F.col("id") % 2 != 0, pick((None, "quiz_pending", "complete", None)), pick((None, "confirmed", "open"))).alias("may"))


@query("supervisor_sessions", "SELECT conv_id AS id, CASE WHEN last_end IS NOT NULL AND last_end >= last_at THEN CASE WHEN last_end % 2 = 0 THEN 'done' ELSE 'failed' END ELSE 'active' END AS state, n AS turn_count, first_at AS started_at, CASE WHEN last_end >= last_at THEN last_end END AS finished_at FROM (SELECT conv_id, count(*) AS n, min(turn) AS first_at, max(turn) AS last_at, max(turn) FILTER (role = 'assistant') AS last_end FROM conversations GROUP BY conv_id)")
def supervisor_sessions(lake):
    """Sessions by their turns; an ending that no turn comes after closes one."""
    c = lake.raw("conversations")
    ends = c.where("role = 'assistant'").select(F.col("conv_id").alias("session"), F.when(F.col("turn") % 2 == 0, "done").otherwise("failed").alias("state"), F.col("turn").alias("at"))
    return supervisor.sessions(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("at")), ends)


# coverage and health


@query("coverage_report", """WITH RECURSIVE offered AS (SELECT id, unnest(areas) AS num FROM lake_cases), seen AS (SELECT DISTINCT case_id AS id, num FROM lake_reads WHERE case_id IS NOT NULL),
judged AS (SELECT o.id, o.num, coalesce(b.title, o.num::VARCHAR) AS title, s.num IS NOT NULL AS looked FROM offered o LEFT JOIN seen s ON s.id = o.id AND s.num = o.num LEFT JOIN lake_objects b ON b.num = o.num)
SELECT id, count(*) FILTER (NOT looked) = 0 AS complete, CASE WHEN count(*) FILTER (NOT looked) = 0 THEN 'covered' ELSE 'incomplete' END AS verdict,
CASE WHEN count(*) FILTER (NOT looked) = 0 THEN 'You looked at all ' || count(*) || ' things this company has decided about that.' ELSE 'You read ' || count(*) FILTER (looked) || ' of ' || count(*) || '. You did not look at: ' || string_agg(title || ' (id: ' || num || ')', ', ' ORDER BY num) FILTER (NOT looked) END AS text,
any_value(coalesce(c.closed, c.last)) AS closed FROM judged JOIN lake_cases c USING (id) GROUP BY id""")
def coverage_report(lake):
    """What was read of what each case offered, in words; asking closes a case that is open."""
    offered = lake.cases.select("id", F.explode("areas").alias("num"), F.coalesce("closed", "last").alias("closed"))
    seen = lake.reads.where("case_id is not null").select(F.col("case_id").alias("id"), "num").distinct().withColumn("looked", F.lit(True))
    titles = lake.objects.select("num", "title")
    judged = offered.join(seen, ["id", "num"], "left").join(titles, "num", "left").withColumn("looked", F.coalesce("looked", F.lit(False)))
    missed = F.array_sort(F.collect_list(F.when(~F.col("looked"), F.struct("num", F.concat(F.coalesce("title", F.col("num").cast("string")), F.lit(" (id: "), F.col("num").cast("string"), F.lit(")")).alias("line")))))
    g = judged.groupBy("id").agg(F.count("*").alias("n"), F.count_if("looked").alias("read"), missed.alias("missed"), F.first("closed").alias("closed"))
    whole = F.size("missed") == 0
    text = F.when(whole, F.concat(F.lit("You looked at all "), F.col("n").cast("string"), F.lit(" things this company has decided about that."))).otherwise(
        F.concat(F.lit("You read "), F.col("read").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(". You did not look at: "), F.array_join(F.transform("missed", lambda m: m["line"]), ", "))
    )
    return g.select("id", whole.alias("complete"), F.when(whole, "covered").otherwise("incomplete").alias("verdict"), text.alias("text"), "closed")


@query("health_message", "SELECT status, CASE status WHEN 'empty' THEN 'This company has not approved anything yet. Say so plainly — do not answer from general knowledge.' WHEN 'compiling' THEN 'Knowledge is still being compiled (' || c || ' documents, ' || s || ' settle jobs queued).' END AS message FROM (SELECT CASE WHEN n = 0 THEN 'empty' WHEN c + s > 0 THEN 'compiling' ELSE 'ready' END AS status, c, s FROM (SELECT (SELECT count(*) FROM lake_objects WHERE status = 'approved' AND n_evidence > 0) AS n, (SELECT count(*) FROM lake_jobs WHERE state = 'pending' AND kind = 'compile') AS c, (SELECT count(*) FROM lake_jobs WHERE state = 'pending' AND kind = 'relate') AS s))")
def health_message(lake):
    """Whether there is anything to serve yet, by what may be served and what is queued, and the sentence for it."""
    n = lake.objects.agg(F.count_if(phrases.gate(F.col("status"), F.col("n_evidence")) == "full").alias("n"))
    queued = lake.jobs.where("state = 'pending'").agg(F.count_if(F.col("kind") == "compile").alias("c"), F.count_if(F.col("kind") == "relate").alias("s"))
    status = F.when(F.col("n") == 0, "empty").when(F.col("c") + F.col("s") > 0, "compiling").otherwise("ready")
    message = F.when(status == "empty", "This company has not approved anything yet. Say so plainly — do not answer from general knowledge.").when(
        status == "compiling", F.concat(F.lit("Knowledge is still being compiled ("), F.col("c").cast("string"), F.lit(" documents, "), F.col("s").cast("string"), F.lit(" settle jobs queued)."))
    )
    return n.crossJoin(queued).select(status.alias("status"), message.alias("message"))
