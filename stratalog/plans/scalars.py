"""Scalar functions applied to whole tables."""

from pyspark.sql import functions as F

from stratalog.functions import phrases, text
from stratalog.lake import SLUG
from stratalog.plans.registry import query

CANON = r"coalesce(regexp_replace(regexp_replace(printf('%.2f', TRY_CAST(replace(regexp_replace({0}, '\.([0-9]{{3}})([^0-9]|$)', '\1\2', 'g'), ',', '.') AS DOUBLE)), '0+$', ''), '\.$', ''), {0})"


@query("fold_text", "SELECT doc_id, sha256(translate(lower(text), 'čćžšđ', 'cczsd')) AS folded FROM documents")
def fold_text(lake):
    return lake.raw("documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query("slugify", f"SELECT p_partkey, {SLUG.format('p_name')} AS slug FROM part")
def slugify(lake):
    return lake.raw("part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("normalise_quote", r"SELECT c_custkey, regexp_replace(trim(regexp_replace(lower('«  ' || c_name || ' / ' || c_mktsegment || ' .» '), '\s+', ' ', 'g')), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS quote FROM customer")
def normalise_quote(lake):
    raw = F.concat(F.lit("«  "), "c_name", F.lit(" / "), "c_mktsegment", F.lit(" .» "))
    return lake.raw("customer").select("c_custkey", text.normalise_quote(raw).alias("quote"))


@query("canonical_number", rf"SELECT l_orderkey, l_linenumber, {CANON.format('raw')} AS number FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 1000 // 7) || CASE l_linenumber % 3 WHEN 0 THEN '.000' WHEN 1 THEN ',50' ELSE '' END AS raw FROM lineitem)")
def canonical_number(lake):
    tail = F.when(F.col("l_linenumber") % 3 == 0, ".000").when(F.col("l_linenumber") % 3 == 1, ",50").otherwise("")
    raw = F.concat(F.floor(F.col("l_partkey") * 1000 / 7).cast("string"), tail)
    return lake.raw("lineitem").select("l_orderkey", "l_linenumber", text.canonical_number(raw).alias("number"))


@query("figures", "SELECT ordinal, list_aggregate(list_sort(list_distinct([(ordinal % 7 * 5) || 'eur', split_part(split_part(statement, ' within ', 2), ' ', 1) || 'dana'])), 'string_agg', ' ') AS figures FROM lake_claims")
def figures(lake):
    return lake.claims.select("ordinal", F.array_join(text.figures(F.col("statement")), " ").alias("figures"))


@query("first_figure", "SELECT ordinal, (ordinal % 7 * 5) || 'eur' AS figure FROM lake_claims")
def first_figure(lake):
    return lake.claims.select("ordinal", text.first_figure(F.col("statement")).alias("figure"))


#: Of the stop words, those with the four letters that a word must have.
STOP = "['koji','koja','koje','kojih','kada','nije','moze','mora','treba','biti','bude','svaki','svaka','ovaj']"
WORDS = "list_sort(list_distinct([substr(w, 1, 5) FOR w IN regexp_split_to_array(translate(lower({0}), 'čćžšđ', 'cczsd'), '[^\\p{{L}}\\p{{N}}]+') IF length(w) >= 4 AND NOT list_contains(" + STOP + ", w)]))"


@query("content_words", f"SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS words FROM documents")
def content_words(lake):
    return lake.raw("documents").select("doc_id", F.array_join(text.content_words(F.col("text")), " ").alias("words"))


@query("strip_instances", r"SELECT c_custkey, array_to_string([w FOR w IN string_split(c_name || ' INV-' || c_custkey || ' for ' || c_nationkey, ' ') IF NOT regexp_full_match(w, '(#[0-9]+|[A-Za-z]+[-#][0-9]+|[0-9]+)')], ' ') AS title FROM customer")
def strip_instances(lake):
    title = F.concat("c_name", F.lit(" INV-"), F.col("c_custkey").cast("string"), F.lit(" for "), F.col("c_nationkey").cast("string"))
    return lake.raw("customer").select("c_custkey", text.strip_instances(title).alias("title"))


@query("overlaps", f"SELECT ordinal, list_has_any({WORDS.format('title')}, {WORDS.format('quote')}) AS shared FROM lake_claims")
def overlaps(lake):
    return lake.claims.select("ordinal", F.coalesce(text.overlaps(F.col("title"), F.col("quote")), F.lit(False)).alias("shared"))


@query("duration_phrase", "SELECT id, CASE WHEN s < 60 THEN '' WHEN s < 3600 THEN s // 60 || ' min' ELSE s // 3600 || ' h' END AS phrase FROM (SELECT id, id * 37 % 20000 AS s FROM lake_jobs)")
def duration_phrase(lake):
    return lake.jobs.select("id", phrases.duration_phrase(F.col("id") * 37 % 20000).alias("phrase"))


@query("human_bytes", "SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n * 10 / 1024) / 10) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', floor(n * 10 / 1048576) / 10) || ' MB' ELSE printf('%.1f', floor(n * 10 / 1073741824) / 10) || ' GB' END AS size FROM (SELECT id, byte_len * (num % 3 * 1000 + 1) AS n FROM lake_documents)")
def human_bytes(lake):
    return lake.documents.select("id", phrases.human_bytes(F.col("byte_len") * (F.col("num") % 3 * 1000 + 1)).alias("size"))


@query("spend_phrase", "SELECT id, part, format('{:,}', coalesce(input_tokens, 1)) || CASE WHEN coalesce(input_tokens, 1) = 1 THEN ' token' ELSE ' tokens' END || CASE WHEN cost_cents IS NULL THEN '' ELSE ' · $' || cost_cents // 100 || '.' || lpad((cost_cents % 100)::VARCHAR, 2, '0') END AS phrase FROM lake_runs")
def spend_phrase(lake):
    return lake.runs.select("id", "part", phrases.spend_phrase(F.coalesce("input_tokens", F.lit(1)), F.col("cost_cents")).alias("phrase"))


@query("confidence_phrase", "SELECT id, CASE WHEN confidence >= 0.85 THEN 'certain' WHEN confidence >= 0.6 THEN 'likely' WHEN confidence >= 0.35 THEN 'uncertain' ELSE 'doubtful' END AS phrase FROM lake_objects")
def confidence_phrase(lake):
    return lake.objects.select("id", phrases.confidence_phrase(F.col("confidence")).alias("phrase"))


@query("confidence_score", "SELECT id, confidence FROM lake_objects")
def confidence_score(lake):
    return lake.objects.select("id", "confidence")


@query("wire_status", "SELECT id, CASE status WHEN 'proposed' THEN 'draft' WHEN 'conflicted' THEN 'conflict' ELSE status END AS wire FROM lake_objects")
def wire_status(lake):
    return lake.objects.select("id", phrases.wire_status(F.col("status")).alias("wire"))


PAYLOAD_KEYS = ("document_id", "source_id", "id", "root", "other")


@query("job_subject", f"SELECT id, coalesce(p ->> '$.document_id', p ->> '$.source_id', p ->> '$.id', p ->> '$.root') AS subject FROM (SELECT id, replace(payload, 'document', {list(PAYLOAD_KEYS)}[(id % 5 + 1)::INT]) AS p FROM lake_jobs)")
def job_subject(lake):
    key = F.element_at(F.array(*map(F.lit, PAYLOAD_KEYS)), (F.col("id") % len(PAYLOAD_KEYS) + 1).cast("int"))
    jobs = lake.jobs.select("id", F.replace("payload", F.lit("document"), key).alias("payload"))
    return jobs.select("id", phrases.job_subject(F.col("payload")).alias("subject"))


@query("attribute_app", "SELECT c_custkey, CASE WHEN n LIKE '%codex%' THEN 'codex' WHEN n LIKE '%cursor%' THEN 'cursor' WHEN regexp_matches(n, 'claude[- ]code') OR n = 'claude_code' THEN 'claude_code' WHEN n LIKE '%claude%' THEN 'claude_desktop' ELSE 'none' END AS app FROM (SELECT c_custkey, lower(['Codex CLI','cursor-vscode','Claude-Code/2','claude_code','my claude_code','Claude','phone'][(c_custkey % 7 + 1)::INT]) AS n FROM customer)")
def attribute_app(lake):
    names = ("Codex CLI", "cursor-vscode", "Claude-Code/2", "claude_code", "my claude_code", "Claude", "phone")
    client = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int"))
    return lake.raw("customer").select("c_custkey", F.coalesce(phrases.attribute_app(client), F.lit("none")).alias("app"))


@query("wants_rows", "SELECT id, regexp_matches(lower(body), '€|eur|price|cijena|cjenik|costs') AS rows FROM lake_objects")
def wants_rows(lake):
    return lake.objects.select("id", phrases.wants_rows(F.col("body")).alias("rows"))


@query("build_state", "SELECT id, CASE WHEN state = 'held' THEN 'waiting' WHEN state = 'done' THEN 'ready' WHEN attempts > 0 THEN 'retrying' ELSE 'queued' END AS build FROM lake_jobs")
def build_state(lake):
    build = F.when(F.col("state") == "held", "waiting").when(F.col("state") == "done", "ready").when(F.col("attempts") > 0, "retrying").otherwise("queued")
    return lake.jobs.select("id", build.alias("build"))


@query("rescan_due", "SELECT id, (now - created) // 3600 >= 6 AS due, created // 21600 AS bucket FROM (SELECT id, created, (SELECT max(created) FROM lake_jobs) AS now FROM lake_jobs)")
def rescan_due(lake):
    now = lake.jobs.agg(F.max("created").alias("now"))
    return lake.jobs.crossJoin(F.broadcast(now)).select("id", (F.floor((F.col("now") - F.col("created")) / 3600) >= 6).alias("due"), F.floor(F.col("created") / 21600).alias("bucket"))


@query("backoff_delay", "SELECT id, CASE WHEN attempts >= 6 THEN -1 ELSE 5 * (1 << attempts)::BIGINT + id % (5 * (1 << attempts)::BIGINT) END AS delay FROM lake_jobs")
def backoff_delay(lake):
    return lake.jobs.select("id", phrases.backoff_seconds(F.col("attempts"), F.col("id")).alias("delay"))


ERRORS = ("HTTP 429", "Rate limit reached", "usage limit", "insufficient credits", "You hit your limit, sign in again", "Please log in", "401", "login timeout", "host unreachable", "model overloaded", "503", "bad json", "quota")


@query("classify_error", rf"""SELECT id, CASE WHEN regexp_matches(e, 'insufficient_quota|exceeded your current quota|usage limit|out of credits|insufficient credits|credit balance|(hit|reached) your limit|quota exceeded') THEN 'unavailable_quota'
WHEN regexp_matches(e, 'not logged in|sign in|login|unauthorized|401|no credentials|expired token|authentication(_error| failed)|please log in') THEN 'unavailable_login'
WHEN regexp_matches(e, 'rate limit|429|timeout|timed out|connection|network|unreachable|temporarily unavailable|50[23]|overloaded') THEN 'transport' ELSE 'refused' END AS class
FROM (SELECT id, lower(coalesce(last_error, {list(ERRORS)}[(id % {len(ERRORS)} + 1)::INT])) AS e FROM lake_jobs)""")
def classify_error(lake):
    """Errors of jobs, and for jobs without one a message of each class."""
    other = F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("id") % len(ERRORS) + 1).cast("int"))
    return lake.jobs.select("id", phrases.classify_error(F.coalesce("last_error", other)).alias("class"))


@query("policy_clamps", "SELECT id, greatest(1, least(4, attempts)) AS workers, greatest(1, least(20, priority * attempts)) AS batch FROM lake_jobs")
def policy_clamps(lake):
    clamp = lambda c, hi: F.greatest(F.lit(1), F.least(F.lit(hi), c)).cast("long")
    return lake.jobs.select("id", clamp(F.col("attempts"), 4).alias("workers"), clamp(F.col("priority") * F.col("attempts"), 20).alias("batch"))


@query("decode_enums", "SELECT id, CASE WHEN kind IN ('md','txt','csv') THEN kind ELSE 'text' END AS document_kind, CASE WHEN gone THEN 'gone' ELSE 'present' END AS state FROM lake_documents")
def decode_enums(lake):
    return lake.documents.select("id", F.when(F.col("kind").isin("md", "txt", "csv"), F.col("kind")).otherwise("text").alias("document_kind"), F.when(F.col("gone"), "gone").otherwise("present").alias("state"))


@query("source_id", f"SELECT s_suppkey, {SLUG.format('s_name')} || '-' || substr(sha256(s_name), 1, 8) AS source_id FROM supplier")
def source_id(lake):
    return lake.raw("supplier").select("s_suppkey", F.concat(text.slug(F.col("s_name")), F.lit("-"), F.substring(F.sha2("s_name", 256), 1, 8)).alias("source_id"))


@query("cassette_key", "SELECT ordinal, 'candidates-' || substr(sha256('candidates' || chr(1) || title || chr(1) || statement), 1, 16) AS key FROM lake_claims")
def cassette_key(lake):
    return lake.claims.select("ordinal", F.concat(F.lit("candidates-"), F.substring(F.sha2(F.concat_ws("\u0001", F.lit("candidates"), "title", "statement"), 256), 1, 16)).alias("key"))


@query("object_path", "SELECT id, CASE kind WHEN 'fact' THEN 'facts/' WHEN 'rule' THEN 'rules/' WHEN 'process' THEN 'processes/' ELSE 'terms/' END || replace(split_part(id, ':', 2), '.', '/') || '.md' AS path FROM lake_objects")
def object_path(lake):
    folder = F.when(F.col("kind") == "fact", "facts/").when(F.col("kind") == "rule", "rules/").when(F.col("kind") == "process", "processes/").otherwise("terms/")
    return lake.objects.select("id", F.concat(folder, F.replace(F.split_part("id", F.lit(":"), F.lit(2)), F.lit("."), F.lit("/")), F.lit(".md")).alias("path"))


@query("idempotency_keys", "SELECT key, count(*) AS n, min(id) AS first_id FROM (SELECT id, kind || ':' || CASE WHEN kind = 'compile' THEN substr(sha256(payload), 1, 16) ELSE (created // 21600)::VARCHAR END AS key FROM lake_jobs) GROUP BY key")
def idempotency_keys(lake):
    tail = F.when(F.col("kind") == "compile", F.substring(F.sha2("payload", 256), 1, 16)).otherwise(F.floor(F.col("created") / 21600).cast("string"))
    return lake.jobs.groupBy(F.concat_ws(":", "kind", tail).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("catalogue", "SELECT kind, id, id || ' — ' || title AS line FROM lake_objects")
def catalogue(lake):
    """A line for each object: the catalogue of a kind is its lines in the order of ids, collected nowhere."""
    return lake.objects.select("kind", "id", F.concat("id", F.lit(" — "), "title").alias("line"))


@query("skill_figures_guard", "SELECT a.id, array_to_string(list_sort([x FOR x IN a.f IF NOT list_contains(b.f, x)]), ' ') AS invented FROM (SELECT id, regexp_extract_all(body, '[0-9]+') AS f FROM lake_objects) a JOIN (SELECT key, list(DISTINCT (ordinal % 7 * 5)::VARCHAR) AS f FROM lake_claims GROUP BY key) b ON a.id = b.key")
def skill_figures_guard(lake):
    allowed = lake.claims.groupBy(F.col("key").alias("id")).agg(F.collect_set((F.col("ordinal") % 7 * 5).cast("string")).alias("allowed"))
    found = F.regexp_extract_all("body", F.lit("[0-9]+"), 0)
    return lake.objects.join(allowed, "id").select("id", F.array_join(F.array_sort(F.filter(found, lambda x: ~F.array_contains("allowed", x))), " ").alias("invented"))


@query("skill_markdown", "SELECT id, '# ' || title || chr(10) || chr(10) || body || chr(10) || chr(10) || '- ' || quotes AS markdown FROM lake_objects JOIN (SELECT object_id, string_agg(quote, chr(10) || '- ' ORDER BY quote, document_id) AS quotes FROM lake_evidence GROUP BY 1) ON object_id = id WHERE kind = 'process'")
def skill_markdown(lake):
    quotes = lake.evidence.groupBy(F.col("object_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("quote")), "\n- ").alias("quotes"))
    return lake.objects.where("kind = 'process'").join(quotes, "id").select("id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n\n- "), "quotes").alias("markdown"))
