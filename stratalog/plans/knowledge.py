"""Sources, evidence, joins, graph, retrieval, served answers and state transitions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions import phrases, text
from stratalog.operators import evidence as gate
from stratalog.operators import graph, search, similar, transitions
from stratalog.plans.registry import query

QUESTION = "large anvil costs for cold bolt and hot gear"


# sources


@query("scan_digest", "SELECT count(*) AS walked, count(DISTINCT num) FILTER (NOT gone) AS readable, count(*) FILTER (gone) AS missing, sum(copies - 1)::BIGINT AS duplicates FROM lake_documents")
def scan_digest(lake):
    return lake.documents.agg(F.count("*").alias("walked"), F.count_if(~F.col("gone")).alias("readable"), F.count_if("gone").alias("missing"), F.sum(F.col("copies") - 1).alias("duplicates"))


SKIP = r"CASE WHEN regexp_matches(strip_accents(lower(name)), 'place|placa|payroll|zaposlenici|ugovor-o-radu|bolovanje') THEN 'personal' WHEN regexp_matches(strip_accents(lower(name)), 'predlozak|template|obrazac|sablona') THEN 'template' WHEN strlen(regexp_replace(text, '^\s+|\s+$', '', 'g')) < CASE WHEN kind IN ('csv', 'xlsx') THEN 1 ELSE 30 END THEN 'too_short' ELSE 'read' END"


@query("structural_skip", f"SELECT id, {SKIP} AS reason FROM lake_documents")
def structural_skip(lake):
    return lake.documents.select("id", F.coalesce(phrases.skip_reason(F.col("name"), F.col("text"), F.col("kind").isin("csv", "xlsx")), F.lit("read")).alias("reason"))


@query("scan_skip_reasons", f"SELECT {SKIP} AS reason, count(*) AS n FROM lake_documents GROUP BY 1")
def scan_skip_reasons(lake):
    return lake.documents.groupBy(F.coalesce(phrases.skip_reason(F.col("name"), F.col("text"), F.col("kind").isin("csv", "xlsx")), F.lit("read")).alias("reason")).agg(F.count("*").alias("n"))


@query("inventory_types", "SELECT kind, count(*) AS files, sum(byte_len)::BIGINT AS bytes, max(modified) AS newest FROM lake_documents GROUP BY kind")
def inventory_types(lake):
    return lake.documents.groupBy("kind").agg(F.count("*").alias("files"), F.sum("byte_len").alias("bytes"), F.max("modified").alias("newest"))


@query("document_identity", "SELECT doc_id, 'doc:' || substr(sha256(text), 1, 16) AS id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents")
def document_identity(lake):
    return lake.raw("documents").select("doc_id", F.concat(F.lit("doc:"), F.substring(F.sha2("text", 256), 1, 16)).alias("id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("prose_blocks", "SELECT document_id, ordinal, kind, start_byte, end_byte FROM lake_blocks")
def prose_blocks(lake):
    return lake.blocks.select("document_id", "ordinal", "kind", "start_byte", "end_byte")


@query("rendition_offsets", "SELECT document_id, count(*) AS blocks, max(end_byte) AS bytes, sum(end_byte - start_byte)::BIGINT AS content FROM lake_blocks GROUP BY 1")
def rendition_offsets(lake):
    return lake.blocks.groupBy("document_id").agg(F.count("*").alias("blocks"), F.max("end_byte").alias("bytes"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("content"))


@query("section_numbers", "SELECT conv_id, turn, s || '.' || sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, s ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS s FROM conversations)")
def section_numbers(lake):
    """Two-level numbers with a reset: user turns open a section, the others number within it; turns that repeat are all kept."""
    order, all_before = ["turn", "role", "text"], (W.unboundedPreceding, 0)
    opens = F.when(F.col("role") == "user", 1).otherwise(0)
    marked = lake.raw("conversations").withColumn("s", F.sum(opens).over(W.partitionBy("conv_id").orderBy(*order).rowsBetween(*all_before)))
    inner = F.sum(1 - opens).over(W.partitionBy("conv_id", "s").orderBy(*order).rowsBetween(*all_before))
    return marked.select("conv_id", "turn", F.concat_ws(".", F.col("s").cast("string"), inner.cast("string")).alias("section"))


@query("table_rows", "SELECT document_id, ordinal, len(string_split(text, ' | ')) AS cells, trim(string_split(text, ' | ')[1]) AS first_cell FROM lake_blocks WHERE kind = 'row'")
def table_rows(lake):
    cells = F.split("text", r" \| ")
    return lake.blocks.where("kind = 'row'").select("document_id", "ordinal", F.size(cells).cast("long").alias("cells"), F.trim(cells[0]).alias("first_cell"))


FILES = "['.env','~$lock.docx','report (2).pdf','price_old.xlsx','notes v3.md','id_rsa','passwords.txt','plan.md','draft.tmp','Thumbs.db','kopija ugovora.docx','rev-2 plan.docx','id_ecdsa','ServiceAccount.json','auth.json','server.KEYSTORE','app.jks','prod.env','web.env.local','.gitignore','monkey.md','secrets.json.md','Desktop.INI','cert.p12']"
NAMES = tuple(x.strip("'") for x in FILES[1:-1].split(","))


def _names(lake):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("o_orderkey") % len(NAMES) + 1).cast("int"))
    return lake.raw("orders").select("o_orderkey", name.alias("name"))


def _names_sql(expr: str) -> str:
    return f"SELECT o_orderkey, {expr} FROM (SELECT o_orderkey, {FILES}[(o_orderkey % {len(NAMES)} + 1)::INT] AS name FROM orders)"


IS_SECRET = r"regexp_full_match(lower(name), 'id_(rsa|dsa|ecdsa|ed25519)|(credentials|serviceaccount|secrets|auth)\.json|.*\.(pem|key|pfx|p12|keystore|jks|env|env\.local|env\.production)')"


@query("filter_noise", _names_sql(f"({IS_SECRET} OR name LIKE '~$%' OR name LIKE '.%' OR lower(name) IN ('thumbs.db', 'desktop.ini')) AS noise, {IS_SECRET} AS secret"))
def filter_noise(lake):
    return _names(lake).select("o_orderkey", phrases.is_noise(F.col("name")).alias("noise"), phrases.is_secret(F.col("name")).alias("secret"))


@query("old_versions", _names_sql("regexp_matches(stem, '\\([0-9]+\\)$') OR list_has_any(string_split_regex(stem, '[ _-]'), ['old','backup','copy','kopija','stari','stara','staro','archive']) OR regexp_matches(stem, '(^|[ _-])(v|ver|rev)[ ._-]?[0-9]+$') AS old").replace("AS name FROM orders)", "AS name, regexp_replace(lower(name), '\\.[a-z0-9]+$', '') AS stem FROM orders)"))
def old_versions(lake):
    return _names(lake).select("o_orderkey", phrases.is_old_version(F.col("name")).alias("old"))


@query("upsert_documents", "SELECT coalesce(n.id, o.id) AS id, coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN n.id IS NOT NULL THEN n.modified ELSE o.modified END AS modified FROM (SELECT id, source_id, modified FROM lake_documents WHERE num % 3 <> 0) o FULL JOIN (SELECT id, 'new' AS source_id, modified + 1 AS modified FROM lake_documents WHERE num % 2 = 0) n ON n.id = o.id")
def upsert_documents(lake):
    old = lake.documents.where("num % 3 <> 0").select("id", "source_id", "modified")
    new = lake.documents.where("num % 2 = 0").select("id", F.lit("new").alias("source_id"), (F.col("modified") + 1).alias("modified"))
    return transitions.upsert(old, new, "id", first=["source_id"])


@query("incremental_changed", "SELECT n.name, n.sha256 FROM lake_documents n ANTI JOIN (SELECT name, CASE WHEN num % 4 = 0 THEN 'old' ELSE sha256 END AS sha256 FROM lake_documents WHERE num % 3 = 0) o ON o.name = n.name AND o.sha256 = n.sha256")
def incremental_changed(lake):
    seen = lake.documents.where("num % 3 = 0").select("name", F.when(F.col("num") % 4 == 0, "old").otherwise(F.col("sha256")).alias("sha256"))
    return transitions.changed(lake.documents.select("name", "sha256"), seen, "name", "sha256")


@query("documents_by_source", "SELECT source_id, id, num, n FROM lake_documents JOIN (SELECT source_id, count(*) AS n FROM lake_documents GROUP BY source_id) USING (source_id)")
def documents_by_source(lake):
    """A row for each document beside its source's number of them: no source is collected."""
    sizes = lake.documents.groupBy("source_id").agg(F.count("*").alias("n"))
    return lake.documents.select("source_id", "id", "num").join(sizes, "source_id")


@query("export_markdown", "SELECT id, kind || '/' || replace(id, ':', '-') || '.md' AS path, '# ' || title || chr(10) || chr(10) || body || chr(10) AS content FROM lake_objects WHERE status = 'approved' AND n_evidence > 0")
def export_markdown(lake):
    o = lake.objects.where("status = 'approved' and n_evidence > 0")
    return o.select("id", F.concat("kind", F.lit("/"), F.replace("id", F.lit(":"), F.lit("-")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n")).alias("content"))


@query("scan_targets", "SELECT source_id, min(num) AS first_num FROM lake_documents WHERE NOT gone GROUP BY source_id")
def scan_targets(lake):
    return lake.documents.where("not gone").groupBy("source_id").agg(F.min("num").alias("first_num"))


@query("document_index", "SELECT id, name, kind FROM lake_documents WHERE gone")
def document_index(lake):
    return lake.documents.where("gone").select("id", "name", "kind")


@query("source_for_path", "SELECT d.id, arg_max(s.root, length(s.root)) AS source FROM (SELECT id, '/data/' || source_id || '/' || kind || '/' || name AS path FROM lake_documents) d JOIN (SELECT DISTINCT '/data/' || source_id AS root FROM lake_documents UNION SELECT DISTINCT '/data/' || source_id || '/' || kind FROM lake_documents WHERE num % 2 = 0) s ON starts_with(d.path, s.root || '/') GROUP BY d.id")
def source_for_path(lake):
    """The deepest watched folder above each file: a file's few parents are looked up, no prefix is compared."""
    d = lake.documents.select("id", "source_id", "kind", "num")
    top = F.concat(F.lit("/data/"), "source_id")
    roots = d.select(top.alias("root")).union(d.where("num % 2 = 0").select(F.concat(top, F.lit("/"), "kind"))).distinct()
    parents = d.select("id", F.explode(F.array(top, F.concat(top, F.lit("/"), "kind"))).alias("root"))
    return parents.join(roots, "root").groupBy("id").agg(F.max_by("root", F.length("root")).alias("source"))


# evidence

SPANS = """SELECT b.document_id, b.ordinal, b.text AS quote,
  CASE WHEN (d.num + b.ordinal) % 5 = 1 THEN b.start_byte + 1 ELSE b.start_byte END AS start_byte,
  CASE WHEN (d.num + b.ordinal) % 7 = 2 THEN b.end_byte + 1 WHEN (d.num + b.ordinal) % 7 = 3 THEN b.end_byte - 2 ELSE b.end_byte END AS end_byte
  FROM lake_blocks b JOIN lake_documents d ON d.id = b.document_id WHERE b.end_byte - b.start_byte >= 8"""


def _spans(lake):
    b = lake.blocks.where("end_byte - start_byte >= 8").join(lake.documents.select(F.col("id").alias("document_id"), "num"), "document_id")
    k = F.col("num") + F.col("ordinal")
    return b.select(
        "document_id", "ordinal", F.col("text").alias("quote"), F.when(k % 5 == 1, F.col("start_byte") + 1).otherwise(F.col("start_byte")).alias("start_byte"),
        F.when(k % 7 == 2, F.col("end_byte") + 1).when(k % 7 == 3, F.col("end_byte") - 2).otherwise(F.col("end_byte")).alias("end_byte"),
    )


NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
VERDICT = f"""SELECT s.document_id, s.ordinal, CASE WHEN s.end_byte > strlen(d.text) THEN 'out_of_range' WHEN TRY(decode(encode(d.text)[s.start_byte + 1:s.end_byte])) IS NULL THEN 'not_a_boundary'
  WHEN {NORM.format("TRY(decode(encode(d.text)[s.start_byte + 1:s.end_byte]))")} <> {NORM.format("s.quote")} THEN 'mismatch' ELSE 'ok' END AS verdict
  FROM ({SPANS}) s JOIN lake_documents d ON d.id = s.document_id"""


@query("evidence_verify", VERDICT)
def evidence_verify(lake):
    return gate.verify(_spans(lake), lake.documents).select("document_id", "ordinal", "verdict")


@query("evidence_recheck", f"SELECT verdict, count(*) AS spans FROM ({VERDICT}) WHERE verdict <> 'ok' GROUP BY verdict")
def evidence_recheck(lake):
    return gate.verify(_spans(lake), lake.documents).where("verdict <> 'ok'").groupBy("verdict").agg(F.count("*").alias("spans"))


@query("evidence_locate", f"SELECT document_id, ordinal, n AS n_hits, CASE WHEN n = 1 THEN strpos(flat, q) - 1 ELSE -1 END AS located FROM (SELECT *, (length(flat) - length(replace(flat, q, ''))) // length(q) AS n FROM (SELECT b.document_id, b.ordinal, {NORM.format('d.text')} AS flat, {NORM.format('b.text')} AS q FROM lake_blocks b JOIN lake_documents d ON d.id = b.document_id WHERE b.end_byte > b.start_byte) WHERE length(q) > 0)")
def evidence_locate(lake):
    quotes = lake.blocks.where("end_byte > start_byte").select("document_id", "ordinal", F.col("text").alias("quote")).where(F.length(text.normalise(F.col("quote"))) > 0)
    return gate.locate(quotes, lake.documents).select("document_id", "ordinal", "n_hits", F.coalesce("located", F.lit(-1)).alias("located"))


@query("block_at", "SELECT o.document_id, o.offset_byte AS offset, b.ordinal FROM (SELECT id AS document_id, byte_len // 2 AS offset_byte FROM lake_documents) o JOIN lake_blocks b ON b.document_id = o.document_id AND o.offset_byte >= b.start_byte AND o.offset_byte < b.end_byte")
def block_at(lake):
    offsets = lake.documents.select(F.col("id").alias("document_id"), F.floor(F.col("byte_len") / 2).alias("offset"))
    return gate.block_at(offsets, lake.blocks).select("document_id", "offset", "ordinal")


@query("passage", "SELECT item_id, coalesce(TRY(decode(encode(text)[13:48])), TRY(decode(encode(text)[14:48])), TRY(decode(encode(text)[13:47])), TRY(decode(encode(text)[14:47]))) AS passage FROM benchmark")
def passage(lake):
    return lake.raw("benchmark").select("item_id", text.passage(F.col("text"), F.lit(20), F.lit(40), 8).alias("passage"))


@query("gate_access", "SELECT id, CASE WHEN status = 'approved' AND n_evidence > 0 THEN 'full' WHEN status IN ('proposed', 'conflicted') THEN 'name_only' ELSE 'withheld' END AS access FROM lake_objects")
def gate_access(lake):
    return lake.objects.select("id", phrases.gate(F.col("status"), F.col("n_evidence")).alias("access"))


@query("unsettled", "SELECT id, title FROM lake_objects WHERE status IN ('proposed', 'conflicted')")
def unsettled(lake):
    return lake.objects.where(phrases.gate(F.col("status"), F.col("n_evidence")) == "name_only").select("id", "title")


@query("clean_candidates", "SELECT ordinal, array_to_string([q FOR q IN quotes IF trim(q) <> ''], '|') AS quotes FROM (SELECT ordinal, CASE WHEN ordinal % 6 = 0 THEN ' ' ELSE title END AS title, CASE WHEN ordinal % 5 = 0 THEN ['', ' '] ELSE [quote, '', document] END AS quotes FROM lake_claims) WHERE trim(title) <> '' AND len([q FOR q IN quotes IF trim(q) <> '']) > 0")
def clean_candidates(lake):
    raw = lake.claims.select("ordinal", F.when(F.col("ordinal") % 6 == 0, " ").otherwise(F.col("title")).alias("title"), F.when(F.col("ordinal") % 5 == 0, F.array(F.lit(""), F.lit(" "))).otherwise(F.array("quote", F.lit(""), "document")).alias("quotes"))
    kept = raw.withColumn("quotes", F.filter("quotes", lambda q: F.trim(q) != "")).where((F.trim("title") != "") & (F.size("quotes") > 0))
    return kept.select("ordinal", F.array_join("quotes", "|").alias("quotes"))


@query("stale_ids", "SELECT id, title FROM lake_objects WHERE stale")
def stale_ids(lake):
    return lake.objects.where("stale").select("id", "title")


# joins


@query("pending_per_source", "SELECT e.document_id, o.status, count(DISTINCT o.id) AS objects FROM lake_objects o JOIN lake_evidence e ON e.object_id = o.id WHERE o.status IN ('proposed', 'conflicted') GROUP BY ALL")
def pending_per_source(lake):
    o = lake.objects.where("status in ('proposed', 'conflicted')").select(F.col("id").alias("object_id"), "status")
    return lake.evidence.join(o, "object_id").groupBy("document_id", "status").agg(F.count_distinct("object_id").alias("objects"))


@query("objects_quoting", "SELECT DISTINCT o.id, o.title FROM lake_objects o JOIN lake_evidence e ON e.object_id = o.id WHERE e.document_id = (SELECT document FROM lake_claims ORDER BY ordinal LIMIT 1)")
def objects_quoting(lake):
    """What quotes the document of the first claim."""
    asked = lake.claims.agg(F.min_by("document", "ordinal").alias("document_id"))  # one row
    quoted = lake.evidence.join(F.broadcast(asked), "document_id", "left_semi").select(F.col("object_id").alias("id"))
    return lake.objects.join(quoted, "id", "left_semi").select("id", "title")


@query("brain_edges", "SELECT r.from_id, r.to_id, r.type FROM lake_relations r WHERE r.from_id IN (SELECT id FROM lake_objects WHERE status = 'approved') AND r.to_id IN (SELECT id FROM lake_objects WHERE status = 'approved')")
def brain_edges(lake):
    ok = lake.objects.where("status = 'approved'").select("id")
    r = lake.relations.join(ok.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ok.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return r.select("from_id", "to_id", "type")


@query("brain_nodes", "SELECT id, kind AS sort FROM lake_objects WHERE status <> 'rejected' UNION SELECT document_id, 'document' FROM lake_evidence")
def brain_nodes(lake):
    return lake.objects.where("status <> 'rejected'").select("id", F.col("kind").alias("sort")).unionByName(lake.evidence.select(F.col("document_id").alias("id"), F.lit("document").alias("sort")).distinct())


@query("brain_visible", "SELECT id FROM lake_objects WHERE kind = 'rule' UNION SELECT document_id FROM lake_evidence WHERE object_id IN (SELECT id FROM lake_objects WHERE kind = 'rule')")
def brain_visible(lake):
    rules = lake.objects.where("kind = 'rule'").select("id")
    near = lake.evidence.join(rules.withColumnRenamed("id", "object_id"), "object_id", "left_semi").select(F.col("document_id").alias("id"))
    return rules.unionByName(near).distinct()


@query("build_snapshot", "SELECT type, count(*) AS edges FROM (SELECT from_id, to_id, type FROM lake_relations UNION ALL SELECT object_id, document_id, 'quoted_in' FROM lake_evidence) GROUP BY type")
def build_snapshot(lake):
    quoted = lake.evidence.select(F.col("object_id").alias("from_id"), F.col("document_id").alias("to_id"), F.lit("quoted_in").alias("type"))
    return lake.relations.select("from_id", "to_id", "type").unionByName(quoted).groupBy("type").agg(F.count("*").alias("edges"))


@query("review_affects", "SELECT r.to_id AS id, count(*) AS affects, string_agg(r.from_id, ',' ORDER BY r.from_id, r.type) AS who FROM lake_relations r JOIN lake_objects o ON o.id = r.to_id WHERE o.status IN ('proposed', 'conflicted') GROUP BY r.to_id")
def review_affects(lake):
    open_ones = lake.objects.where("status in ('proposed', 'conflicted')").select(F.col("id").alias("to_id"))
    who = F.array_join(F.array_sort(F.collect_list("from_id")), ",")
    return lake.relations.join(open_ones, "to_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("affects"), who.alias("who"))


@query("supersedes", "SELECT a.id, min(b.id) AS superseded FROM lake_objects a JOIN lake_objects b ON a.title = b.title AND a.updated > b.updated GROUP BY a.id")
def supersedes(lake):
    """The least id among older objects of the same title; one row for each title and moment goes through the window."""
    moments = lake.objects.groupBy("title", "updated").agg(F.min("id").alias("least"))
    older = W.partitionBy("title").orderBy("updated").rowsBetween(W.unboundedPreceding, -1)
    found = moments.withColumn("superseded", F.min("least").over(older)).where("superseded is not null")
    return lake.objects.select("id", "title", "updated").join(found, ["title", "updated"]).select("id", "superseded")


@query("superseded_by", "SELECT b.id, max(a.id) AS successor FROM lake_objects a JOIN lake_objects b ON a.title = b.title AND a.updated > b.updated GROUP BY b.id")
def superseded_by(lake):
    """The other way: the greatest id among newer objects of the same title."""
    moments = lake.objects.groupBy("title", "updated").agg(F.max("id").alias("most"))
    newer = W.partitionBy("title").orderBy("updated").rowsBetween(1, W.unboundedFollowing)
    found = moments.withColumn("successor", F.max("most").over(newer)).where("successor is not null")
    return lake.objects.select("id", "title", "updated").join(found, ["title", "updated"]).select("id", "successor")


@query("uses_edges", "SELECT a.id AS from_id, b.id AS to_id FROM lake_objects a JOIN lake_objects b ON a.id <> b.id AND length(b.title) >= 6 AND contains(' ' || a.body || ' ' || a.title || ' ', ' ' || b.title || ' ')")
def uses_edges(lake):
    """Objects whose text holds another's title: met on the title's first word, then compared."""
    whole = F.concat(F.lit(" "), "body", F.lit(" "), "title", F.lit(" "))
    a = lake.objects.select(F.col("id").alias("from_id"), whole.alias("whole")).withColumn("word", F.explode(F.array_distinct(F.split("whole", " "))))
    b = lake.objects.where(F.length("title") >= 6).select(F.col("id").alias("to_id"), F.col("title").alias("other"), F.split("title", " ")[0].alias("word"))
    holds = F.contains("whole", F.concat(F.lit(" "), "other", F.lit(" ")))
    return a.join(b, "word").where((F.col("from_id") != F.col("to_id")) & holds).select("from_id", "to_id").distinct()


@query("batch_resolve", "SELECT c.ordinal, coalesce(a.id, b.id) AS object_id FROM (SELECT ordinal, CASE WHEN ordinal % 2 = 0 THEN key ELSE title END AS said FROM lake_claims) c LEFT JOIN (SELECT id FROM lake_objects) a ON a.id = c.said LEFT JOIN (SELECT title, min(id) AS id FROM lake_objects GROUP BY title) b ON b.title = c.said WHERE coalesce(a.id, b.id) IS NOT NULL")
def batch_resolve(lake):
    said = lake.claims.select("ordinal", F.when(F.col("ordinal") % 2 == 0, F.col("key")).otherwise(F.col("title")).alias("said"))
    by_id = lake.objects.select(F.col("id").alias("said"), F.col("id").alias("a"))
    by_name = lake.objects.groupBy(F.col("title").alias("said")).agg(F.min("id").alias("b"))
    return said.join(by_id, "said", "left").join(by_name, "said", "left").select("ordinal", F.coalesce("a", "b").alias("object_id")).where("object_id is not null")


HINTS = """(WITH w AS (SELECT id, kind, n_disagree, {t} AS t, {b} AS b FROM lake_objects),
p AS (SELECT l.id AS left_id, r.id AS right_id, l.n_disagree > 0 OR r.n_disagree > 0 AS differ, l.t AS lt, r.t AS rt, len(list_intersect(l.t, r.t)) AS ti, len(list_distinct(list_concat(l.t, r.t))) AS tu, len(list_intersect(l.b, r.b)) AS bi, len(list_distinct(list_concat(l.b, r.b))) AS bu
  FROM w l JOIN w r ON l.kind = r.kind AND l.id < r.id)
SELECT left_id, right_id, round(0.65 * CASE WHEN least(len(lt), len(rt)) >= 2 THEN ti / least(len(lt), len(rt)) WHEN tu > 0 THEN ti / tu ELSE 0 END + 0.35 * CASE WHEN bu > 0 THEN bi / bu ELSE 0 END, 6) AS score, differ FROM p)"""


def _words_sql(c: str) -> str:
    from stratalog.plans.scalars import WORDS

    return WORDS.format(c)


@query("similar_hints", f"SELECT left_id, right_id, score, differ FROM {HINTS.format(t=_words_sql('title'), b=_words_sql('body'))} WHERE score >= 0.5")
def similar_hints(lake):
    return similar.hints(lake.objects)


@query("open_merge_hints", f"SELECT h.left_id, h.right_id, l.title AS left_title, r.title AS right_title, h.score FROM {HINTS.format(t=_words_sql('title'), b=_words_sql('body'))} h JOIN lake_objects l ON l.id = left_id JOIN lake_objects r ON r.id = right_id WHERE score >= 0.5 AND l.status <> 'rejected' AND r.status <> 'rejected' ORDER BY h.differ DESC, score DESC, left_id, right_id LIMIT 50")
def open_merge_hints(lake):
    h = similar.hints(lake.objects)
    o = lake.objects.where("status <> 'rejected'").select("id", "title")
    l, r = o.select(F.col("id").alias("left_id"), F.col("title").alias("left_title")), o.select(F.col("id").alias("right_id"), F.col("title").alias("right_title"))
    joined = h.join(l, "left_id").join(r, "right_id").orderBy(F.desc("differ"), F.desc("score"), "left_id", "right_id").limit(50)
    return joined.select("left_id", "right_id", "left_title", "right_title", "score")


PREFERRED = "SELECT h.left_id, h.right_id, CASE WHEN (l.n_evidence, l.updated) > (r.n_evidence, r.updated) OR (l.n_evidence, l.updated) = (r.n_evidence, r.updated) AND l.id <= r.id THEN l.id ELSE r.id END AS keep_id FROM {hints} h JOIN lake_objects l ON l.id = left_id JOIN lake_objects r ON r.id = right_id WHERE score >= 0.5"


@query("preferred_sides", PREFERRED.format(hints=HINTS.format(t=_words_sql('title'), b=_words_sql('body'))))
def preferred_sides(lake):
    """Which side of a hint a merge keeps: more evidence, then the more recent, then the lower id."""
    side = lambda s: lake.objects.select(F.col("id").alias(f"{s}_id"), F.struct("n_evidence", "updated").alias(s))
    both = similar.hints(lake.objects).select("left_id", "right_id").join(side("left"), "left_id").join(side("right"), "right_id")
    ahead = (F.col("left") > F.col("right")) | ((F.col("left") == F.col("right")) & (F.col("left_id") <= F.col("right_id")))
    return both.select("left_id", "right_id", F.when(ahead, F.col("left_id")).otherwise(F.col("right_id")).alias("keep_id"))


@query("merge_hint_counts", f"SELECT differ, count(*) AS hints FROM {HINTS.format(t=_words_sql('title'), b=_words_sql('body'))} WHERE score >= 0.5 GROUP BY differ")
def merge_hint_counts(lake):
    return similar.hints(lake.objects).groupBy("differ").agg(F.count("*").alias("hints"))


# graph

IMPACT = """SELECT DISTINCT CASE WHEN type = 'depends_on' THEN to_id ELSE from_id END AS src, CASE WHEN type = 'depends_on' THEN from_id ELSE to_id END AS dst FROM lake_relations WHERE type <> 'conflicts_with'"""
REACH = """WITH RECURSIVE e AS ({e}), walk AS (SELECT {start} AS node, 0 AS distance UNION SELECT e.{b}, distance + 1 FROM walk JOIN e ON e.{a} = walk.node WHERE distance < {most}),
best AS (SELECT node, min(distance)::BIGINT AS distance FROM walk GROUP BY node) SELECT node, distance FROM best WHERE distance > 0"""
FIRST = "(SELECT min(id) FROM lake_objects)"


def _first(lake):
    return lake.objects.agg(F.min("id").alias("start"))


@query("impact_edges", IMPACT)
def impact_edges(lake):
    return graph.impact_edges(lake.relations)


@query("impact", REACH.format(e=IMPACT, start=FIRST, a="src", b="dst", most=40))
def impact(lake):
    return graph.reach(graph.impact_edges(lake.relations), _first(lake)).select("node", "distance")


@query("what_breaks_if", REACH.format(e=IMPACT, start=FIRST, a="src", b="dst", most=40) + " ORDER BY distance, node LIMIT 12")
def what_breaks_if(lake):
    return graph.reach(graph.impact_edges(lake.relations), _first(lake)).orderBy("distance", "node").limit(12).select("node", "distance")


@query("foundations", REACH.format(e=IMPACT, start="(SELECT max(id) FROM lake_objects)", a="dst", b="src", most=40))
def foundations(lake):
    turned = graph.impact_edges(lake.relations).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(turned, lake.objects.agg(F.max("id").alias("start"))).select("node", "distance")


@query("stale_cascade", f"WITH RECURSIVE s AS (SELECT id FROM lake_objects WHERE stale UNION SELECT r.to_id FROM s JOIN lake_relations r ON r.from_id = s.id WHERE r.type = 'used_by') SELECT id FROM s")
def stale_cascade(lake):
    edges = lake.relations.where("type = 'used_by'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    stale = lake.objects.where("stale").select(F.col("id").alias("start"))
    return stale.withColumnRenamed("start", "id").unionByName(graph.reach(edges, stale).select(F.col("node").alias("id"))).distinct()


TREE = "SELECT to_id AS src, from_id AS dst FROM lake_relations WHERE type = 'depends_on'"


@query("topo_levels", f"WITH RECURSIVE e AS ({TREE}), walk AS (SELECT DISTINCT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM walk JOIN e ON e.src = walk.node) SELECT node, max(level)::BIGINT AS level FROM walk GROUP BY node")
def topo_levels(lake):
    return graph.levels(lake.relations.where("type = 'depends_on'").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")))


MOVES = "SELECT DISTINCT tool AS src, next AS dst FROM (SELECT tool, lead(tool) OVER (PARTITION BY app, num ORDER BY moment, id) AS next FROM lake_reads WHERE app IS NOT NULL) WHERE next IS NOT NULL AND next <> tool"


def _moves(lake):
    from pyspark.sql import Window as W

    r = lake.reads.where("app is not null").withColumn("dst", F.lead("tool").over(W.partitionBy("app", "num").orderBy("moment", "id")))
    return r.where("dst is not null and dst <> tool").select(F.col("tool").alias("src"), "dst").distinct()


@query("cycles", f"WITH RECURSIVE e AS ({MOVES}), c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b) SELECT c.a AS node, least(min(c.b), c.a) AS component FROM c JOIN c d ON d.a = c.b AND d.b = c.a WHERE c.a <> c.b GROUP BY c.a")
def cycles(lake):
    return graph.cycles(_moves(lake))


@query("orphans", "SELECT id FROM lake_objects WHERE id NOT IN (SELECT from_id FROM lake_relations UNION SELECT to_id FROM lake_relations)")
def orphans(lake):
    ends = lake.relations.select(F.col("from_id").alias("id")).union(lake.relations.select("to_id"))
    return lake.objects.select("id").join(ends, "id", "left_anti")


@query("graph_counts", f"SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT src FROM ({IMPACT}) UNION SELECT dst FROM ({IMPACT}))) AS nodes FROM ({IMPACT})")
def graph_counts(lake):
    e = graph.impact_edges(lake.relations)
    nodes = e.select("src").union(e.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    return e.agg(F.count("*").alias("edges")).crossJoin(nodes)


PROPOSED = "SELECT ordinal, key AS from_id, lead_key AS to_id FROM (SELECT ordinal, key, coalesce(lead(key) OVER (PARTITION BY document ORDER BY ordinal), 'unknown') AS lead_key FROM lake_claims)"


def _proposed(lake):
    from pyspark.sql import Window as W

    return lake.claims.select("ordinal", F.col("key").alias("from_id"), F.coalesce(F.lead("key").over(W.partitionBy("document").orderBy("ordinal")), F.lit("unknown")).alias("to_id"))


@query("usable_edges", f"SELECT DISTINCT from_id, to_id FROM ({PROPOSED}) WHERE from_id <> to_id AND to_id IN (SELECT id FROM lake_objects) AND from_id IN (SELECT id FROM lake_objects)")
def usable_edges(lake):
    return graph.usable(_proposed(lake), lake.objects)


@query("edge_pairs", "SELECT from_id, to_id, 'depends_on' AS type, 0.75::DOUBLE AS confidence FROM lake_relations WHERE type = 'depends_on' UNION ALL SELECT to_id, from_id, 'used_by', 0.75 FROM lake_relations WHERE type = 'depends_on'")
def edge_pairs(lake):
    return graph.edge_pairs(lake.relations.where("type = 'depends_on'").select("from_id", "to_id"))


@query("acyclic_edges")
def acyclic_edges(lake):
    first = _proposed(lake).where("from_id <> to_id and to_id <> 'unknown'").groupBy("from_id", "to_id").agg(F.min("ordinal").alias("ordinal"))
    return graph.acyclic(first.select("ordinal", "from_id", "to_id"))


@query("relation_upsert", "SELECT coalesce(o.from_id, n.from_id) AS from_id, coalesce(o.to_id, n.to_id) AS to_id, coalesce(o.type, n.type) AS type, coalesce(n.confidence, o.confidence) AS confidence FROM lake_relations o FULL JOIN (SELECT from_id, to_id, type, CASE WHEN confidence < 0.5 THEN 0.9::DOUBLE END AS confidence FROM lake_relations WHERE type = 'used_by' UNION ALL SELECT to_id, from_id, 'derived_from', 1.0 FROM lake_relations WHERE type = 'used_by') n ON n.from_id = o.from_id AND n.to_id = o.to_id AND n.type = o.type")
def relation_upsert(lake):
    used = lake.relations.where("type = 'used_by'")
    new = used.select("from_id", "to_id", "type", F.when(F.col("confidence") < 0.5, 0.9).alias("confidence")).unionByName(used.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("derived_from").alias("type"), F.lit(1.0).alias("confidence")))
    return transitions.upsert_relations(lake.relations, new)


# retrieval

WEIGHTS = {"title": 4.0, "body": 1.0}


@query("inverted_index", "SELECT term, count(DISTINCT id) AS documents, sum(w)::DOUBLE AS weight FROM (SELECT id, unnest([w FOR w IN regexp_split_to_array(strip_accents(lower(title)), '[^\\p{L}\\p{N}]+') IF w <> '']) AS term, 4.0::DOUBLE AS w FROM lake_objects UNION ALL SELECT id, unnest([w FOR w IN regexp_split_to_array(strip_accents(lower(body)), '[^\\p{L}\\p{N}]+') IF w <> '']), 1.0 FROM lake_objects) GROUP BY term")
def inverted_index(lake):
    return search.postings(lake.objects, WEIGHTS).groupBy("term").agg(F.count("*").alias("documents"), F.sum("frequency").alias("weight"))


@query("search_objects", f"SELECT id, score FROM {search.bm25_sql('lake_objects', QUESTION, WEIGHTS)} ORDER BY score DESC, id LIMIT 16")
def search_objects(lake):
    return search.top(search.bm25(lake.objects, QUESTION, WEIGHTS), 16)


ACCENTED = "(SELECT id, replace(replace(replace(title, 'c', 'č'), 'e', 'é'), 's', 'Š') AS title FROM lake_objects)"


@query("search_accented", f"SELECT id, score FROM {search.bm25_sql(ACCENTED, 'lârge ânvil čosťs', {'title': 1.0})} ORDER BY score DESC, id LIMIT 16")
def search_accented(lake):
    """Accents tell no words apart, neither in texts nor in questions."""
    title = F.translate("title", "ces", "čéŠ")
    return search.top(search.bm25(lake.objects.select("id", title.alias("title")), "lârge ânvil čosťs", {"title": 1.0}), 16)


@query("search_blocks", f"SELECT id, score FROM {search.bm25_sql('(SELECT document_id || chr(35) || ordinal AS id, text FROM lake_blocks)', 'license the version of and apache', {'text': 1.0})} ORDER BY score DESC, id LIMIT 10")
def search_blocks(lake):
    b = lake.blocks.select(F.concat("document_id", F.lit("#"), F.col("ordinal").cast("string")).alias("id"), "text")
    return search.top(search.bm25(b, "license the version of and apache", {"text": 1.0}), 10)


PART_ROWS = "(SELECT p_partkey AS id, p_name || ' | ' || p_brand || ' | ' || p_type AS line, p_partkey % 1000 AS modified FROM part)"


@query("lookup_value", f"SELECT h.id, p.line, h.score, p.modified FROM {search.bm25_sql(PART_ROWS, 'large anvil promo', {'line': 1.0})} h JOIN {PART_ROWS} p USING (id) ORDER BY p.modified DESC, h.score DESC, h.id LIMIT 6")
def lookup_value(lake):
    rows = lake.raw("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" | ", "p_name", "p_brand", "p_type").alias("line"), (F.col("p_partkey") % 1000).alias("modified"))
    hit = search.bm25(rows, "large anvil promo", {"line": 1.0})
    return hit.join(rows, "id").orderBy(F.desc("modified"), F.desc("score"), "id").limit(6).select("id", "line", "score", "modified")


@query("search_context", f"SELECT h.id, o.title, h.score FROM (SELECT * FROM {search.bm25_sql('lake_objects', QUESTION, WEIGHTS)} ORDER BY score DESC, id LIMIT 24) h JOIN lake_objects o USING (id) WHERE o.status = 'approved' AND o.n_evidence > 0 ORDER BY h.score DESC, h.id LIMIT 8")
def search_context(lake):
    """Three times the wanted hits are ranked before the gate, then cut."""
    served = lake.objects.where(phrases.gate(F.col("status"), F.col("n_evidence")) == "full").select("id", "title")
    return search.top(search.bm25(lake.objects, QUESTION, WEIGHTS), 24).join(served, "id").orderBy(F.desc("score"), "id").limit(8).select("id", "title", "score")


@query("relevant_context", f"WITH RECURSIVE h AS (SELECT x.id FROM (SELECT * FROM {search.bm25_sql('lake_objects', QUESTION, WEIGHTS)} ORDER BY score DESC, id LIMIT 16) x JOIN lake_objects o USING (id) WHERE o.status = 'approved'), e AS ({IMPACT}), walk AS (SELECT id AS node, 0 AS distance FROM h UNION SELECT e.src, distance + 1 FROM walk JOIN e ON e.dst = walk.node WHERE distance < 3) SELECT node AS id, min(distance)::BIGINT AS distance FROM walk GROUP BY node")
def relevant_context(lake):
    hit = search.top(search.bm25(lake.objects, QUESTION, WEIGHTS), 16)
    starts = hit.join(lake.objects.where("status = 'approved'").select("id"), "id", "left_semi").select(F.col("id").alias("start"))
    turned = graph.impact_edges(lake.relations).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = graph.reach(turned, starts, most=3).select(F.col("node").alias("id"), "distance").unionByName(starts.select(F.col("start").alias("id"), F.lit(0).cast("long").alias("distance")))
    return found.groupBy("id").agg(F.min("distance").alias("distance"))


#: The least confidence at which an edge is followed from a primary.
EDGE_LEAST = 0.7


def weak_edges(relations):
    weak = relations.where((F.col("type") == "depends_on") & (F.col("confidence") < EDGE_LEAST))
    return weak.select(F.col("from_id").alias("start"), F.col("to_id").alias("node")).distinct()


@query("edge_lookup", "SELECT from_id, to_id, max(confidence) AS confidence, max(confidence) >= 0.7 AS followed FROM lake_relations WHERE type = 'depends_on' GROUP BY from_id, to_id")
def edge_lookup(lake):
    """Each pair of an object and one that it depends on, with the edge's confidence and whether it is followed."""
    found = lake.relations.where("type = 'depends_on'").groupBy("from_id", "to_id").agg(F.max("confidence").alias("confidence"))
    return found.withColumn("followed", F.col("confidence") >= EDGE_LEAST)


TASK = f"""WITH RECURSIVE h AS (SELECT id, 1.0 AS base FROM (SELECT * FROM {search.bm25_sql('lake_objects', QUESTION, WEIGHTS)} ORDER BY score DESC, id LIMIT 16)),
ov AS (SELECT id, 0.8 AS base FROM lake_objects WHERE list_has_any({_words_sql('title')}, {_words_sql("'" + QUESTION + "'")})),
s AS (SELECT id, sum(base) AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM ov) GROUP BY id),
nb AS (SELECT a AS id, sum(0.15 * s.score) AS extra FROM (SELECT src AS a, dst AS b FROM ({IMPACT}) UNION SELECT dst, src FROM ({IMPACT})) JOIN s ON s.id = b GROUP BY a),
ranked AS (SELECT coalesce(s.id, nb.id) AS id, round(coalesce(score, 0) + coalesce(extra, 0), 6) AS score FROM s FULL JOIN nb ON nb.id = s.id),
prim AS (SELECT id, score FROM ranked ORDER BY score DESC, id LIMIT 8), e AS ({IMPACT}),
walk AS (SELECT id AS start, id AS node, 0 AS distance FROM prim UNION SELECT start, e.src, distance + 1 FROM walk JOIN e ON e.dst = walk.node WHERE distance < 3),
it AS (SELECT node AS id, min(distance) AS distance FROM walk WHERE NOT EXISTS (SELECT 1 FROM lake_relations r WHERE r.type = 'depends_on' AND r.from_id = start AND r.to_id = node AND r.confidence < 0.7) GROUP BY node)
SELECT it.id, CASE WHEN distance = 0 THEN 'primary' ELSE 'foundation' END AS role, distance::BIGINT AS distance FROM it JOIN lake_objects o ON o.id = it.id WHERE o.status = 'approved' ORDER BY (distance = 0), it.id LIMIT 12"""


@query("task_context", TASK)
def task_context(lake):
    """Scored hits, shared words and neighbours; the best eight, their foundations first, twelve in all.

    What a primary depends on by an edge of less than EDGE_LEAST isn't taken along for it.
    """
    hit = search.top(search.bm25(lake.objects, QUESTION, WEIGHTS), 16).select("id", F.lit(1.0).alias("base"))
    shared = lake.objects.where(text.overlaps(F.col("title"), F.lit(QUESTION))).select("id", F.lit(0.8).alias("base"))
    score = hit.unionByName(shared).groupBy("id").agg(F.sum("base").alias("score"))
    e = graph.impact_edges(lake.relations)
    ways = e.select(F.col("src").alias("a"), F.col("dst").alias("id")).union(e.select("dst", "src")).distinct()
    extra = ways.join(score, "id").groupBy(F.col("a").alias("id")).agg(F.sum(0.15 * F.col("score")).alias("extra"))
    ranked = score.join(extra, "id", "full").select("id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0)), 6).alias("score"))
    starts = graph.keep(ranked.orderBy(F.desc("score"), "id").limit(8).select(F.col("id").alias("start")))
    below = graph.reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, most=3)
    below = below.join(weak_edges(lake.relations), ["start", "node"], "left_anti").select(F.col("node").alias("id"), "distance")
    items = below.unionByName(starts.select(F.col("start").alias("id"), F.lit(0).cast("long").alias("distance"))).groupBy("id").agg(F.min("distance").alias("distance"))
    items = items.join(lake.objects.where("status = 'approved'").select("id"), "id", "left_semi")
    role = F.when(F.col("distance") == 0, "primary").otherwise("foundation")
    return items.select("id", role.alias("role"), "distance").orderBy(F.col("distance") == 0, "id").limit(12)


# served answers and reviews


@query("get_context", f"SELECT o.id, o.title, o.body, coalesce(f.below, '') AS foundations FROM lake_objects o LEFT JOIN (SELECT from_id, string_agg(to_id, ',' ORDER BY to_id) AS below FROM lake_relations WHERE type = 'depends_on' GROUP BY 1) f ON f.from_id = o.id WHERE o.status = 'approved'")
def get_context(lake):
    below = lake.relations.where("type = 'depends_on'").groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("to_id")), ",").alias("foundations"))
    return lake.objects.where("status = 'approved'").join(below, "id", "left").select("id", "title", "body", F.coalesce("foundations", F.lit("")).alias("foundations"))


@query("source_evidence", "SELECT object_id, document_id, quote, first_seen FROM lake_evidence WHERE object_id IN (SELECT id FROM lake_objects WHERE status = 'approved')")
def source_evidence(lake):
    served = lake.objects.where("status = 'approved'").select(F.col("id").alias("object_id"))
    return lake.evidence.join(served, "object_id", "left_semi").select("object_id", "document_id", "quote", "first_seen")


@query("get_process", f"SELECT id, title FROM lake_objects WHERE kind = 'process' AND status = 'approved' AND list_has_any({_words_sql('title')}, {_words_sql(chr(39) + QUESTION + chr(39))}) ORDER BY id LIMIT 8")
def get_process(lake):
    return lake.objects.where("kind = 'process' and status = 'approved'").where(text.overlaps(F.col("title"), F.lit(QUESTION))).orderBy("id").limit(8).select("id", "title")


@query("get_skill", "SELECT id, CASE WHEN lower(title) = 'large anvil' THEN 0 WHEN id = 'large anvil' THEN 1 ELSE 2 END AS match FROM lake_objects WHERE kind = 'term' AND contains(lower(title), 'anvil')")
def get_skill(lake):
    rank = F.when(F.lower("title") == "large anvil", 0).when(F.col("id") == "large anvil", 1).otherwise(2)
    return lake.objects.where("kind = 'term'").where(F.contains(F.lower("title"), F.lit("anvil"))).select("id", rank.alias("match"))


@query("list_pending", "SELECT id, 'unsettled' AS why FROM lake_objects WHERE status IN ('proposed', 'conflicted') UNION ALL SELECT id, 'stale' FROM lake_objects WHERE status = 'approved' AND stale")
def list_pending(lake):
    return lake.objects.where("status in ('proposed', 'conflicted')").select("id", F.lit("unsettled").alias("why")).unionByName(lake.objects.where("status = 'approved' and stale").select("id", F.lit("stale").alias("why")))


@query("propose_change", f"SELECT item_id, document_id FROM (SELECT i.item_id, d.id AS document_id, (length(d.flat) - length(replace(d.flat, i.q, ''))) // length(i.q) AS n FROM (SELECT item_id, {NORM.format('text')} AS q FROM benchmark) i JOIN (SELECT id, {NORM.format('text')} AS flat FROM lake_documents) d ON contains(d.flat, i.q)) WHERE n = 1")
def propose_change(lake):
    """Quotes accepted where they occur exactly once: a quote meets only documents that hold its rarest long word."""
    words = lambda c: F.array_distinct(F.split(text.normalise(c), " "))
    asked = lake.raw("benchmark").select("item_id", F.col("text").alias("quote"), F.explode(words(F.col("text"))).alias("word"))
    docs = lake.documents.select(F.col("id").alias("document_id"), F.explode(words(F.col("text"))).alias("word"))
    wanted = asked.select("word").distinct()
    often = docs.join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    # the first and last words of a quote may be parts of longer ones in a document
    inner = F.slice(words(F.col("text")), 2, F.greatest(F.size(words(F.col("text"))) - 2, F.lit(0)))
    probe = lake.raw("benchmark").select("item_id", F.explode(inner).alias("word")).join(often, "word").groupBy("item_id").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    pairs = docs.join(probe, "word").select("item_id", "document_id").join(lake.raw("benchmark").select("item_id", F.col("text").alias("quote")), "item_id")
    return gate.locate(pairs, lake.documents).where("n_hits = 1").select("item_id", "document_id")


@query("served_pack", "SELECT o.id, o.title, e.quotes, coalesce(r.links, 0) AS links, o.stale FROM lake_objects o JOIN (SELECT object_id, string_agg(document_id || ': ' || quote, ' / ' ORDER BY document_id) AS quotes FROM lake_evidence GROUP BY 1) e ON e.object_id = o.id LEFT JOIN (SELECT from_id, count(*) AS links FROM lake_relations GROUP BY 1) r ON r.from_id = o.id WHERE o.status = 'approved'")
def served_pack(lake):
    quotes = lake.evidence.groupBy(F.col("object_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_id", "quote"))), lambda x: F.concat(x["document_id"], F.lit(": "), x["quote"])), " / ").alias("quotes"))
    links = lake.relations.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("links"))
    return lake.objects.where("status = 'approved'").join(quotes, "id").join(links, "id", "left").select("id", "title", "quotes", F.coalesce("links", F.lit(0)).alias("links"), "stale")


@query("company_card", "SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS rank FROM lake_objects WHERE status = 'approved' AND (kind = 'term' OR kind = 'rule' AND id NOT IN (SELECT from_id FROM lake_relations WHERE type = 'used_by'))) WHERE rank <= 24")
def company_card(lake):
    from pyspark.sql import Window as W

    used = lake.relations.where("type = 'used_by'").select(F.col("from_id").alias("id"))
    ok = lake.objects.where("status = 'approved'")
    rows = ok.where("kind = 'term'").unionByName(ok.where("kind = 'rule'").join(used, "id", "left_anti").select(*ok.columns))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy("id"))).where("rank <= 24").select("kind", "id")


@query("prompts", "SELECT 'ask' AS name, 'built-in' AS origin UNION ALL SELECT 'review', 'built-in' UNION ALL SELECT 'plan', 'built-in' UNION ALL SELECT split_part(id, ':', 2), 'process' FROM lake_objects WHERE kind = 'process' AND status = 'approved'")
def prompts(lake):
    own = lake.spark.createDataFrame([("ask", "built-in"), ("review", "built-in"), ("plan", "built-in")], "name string, origin string")
    return own.unionByName(lake.objects.where("kind = 'process' and status = 'approved'").select(F.split_part("id", F.lit(":"), F.lit(2)).alias("name"), F.lit("process").alias("origin")))


@query("review_queue", "SELECT o.id, o.status, count(DISTINCT e.document_id) AS sources, count(DISTINCT r.from_id) AS affects FROM lake_objects o LEFT JOIN lake_evidence e ON e.object_id = o.id LEFT JOIN lake_relations r ON r.to_id = o.id WHERE o.status IN ('proposed', 'conflicted') GROUP BY ALL")
def review_queue(lake):
    sources = lake.evidence.groupBy(F.col("object_id").alias("id")).agg(F.count_distinct("document_id").alias("sources"))
    affects = lake.relations.groupBy(F.col("to_id").alias("id")).agg(F.count_distinct("from_id").alias("affects"))
    o = lake.objects.where("status in ('proposed', 'conflicted')").join(sources, "id", "left").join(affects, "id", "left")
    return o.select("id", "status", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("affects", F.lit(0)).alias("affects"))


@query("gone_reviews", "SELECT e.object_id, e.document_id, d.name FROM lake_evidence e JOIN lake_documents d ON d.id = e.document_id WHERE d.gone")
def gone_reviews(lake):
    """Evidence whose document is gone, with the document's name."""
    gone = lake.documents.where("gone").select(F.col("id").alias("document_id"), "name")
    return lake.evidence.join(gone, "document_id").select("object_id", "document_id", "name")


@query("skills_list", "SELECT o.id, coalesce(a.n, 0) AS requires, coalesce(b.n, 0) AS affects FROM lake_objects o LEFT JOIN (SELECT from_id, count(*) AS n FROM lake_relations WHERE type = 'depends_on' GROUP BY 1) a ON a.from_id = o.id LEFT JOIN (SELECT to_id, count(*) AS n FROM lake_relations WHERE type = 'depends_on' GROUP BY 1) b ON b.to_id = o.id WHERE o.kind = 'process' AND o.status <> 'rejected'")
def skills_list(lake):
    d = lake.relations.where("type = 'depends_on'")
    requires, affects = d.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("requires")), d.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("affects"))
    o = lake.objects.where("kind = 'process' and status <> 'rejected'").join(requires, "id", "left").join(affects, "id", "left")
    return o.select("id", F.coalesce("requires", F.lit(0)).alias("requires"), F.coalesce("affects", F.lit(0)).alias("affects"))


@query("skill_sources", "SELECT r.from_id AS id, r.to_id AS foundation FROM lake_relations r JOIN lake_objects p ON p.id = r.from_id JOIN lake_objects f ON f.id = r.to_id WHERE r.type = 'depends_on' AND p.kind = 'process' AND f.status = 'approved'")
def skill_sources(lake):
    r = lake.relations.where("type = 'depends_on'").select(F.col("from_id").alias("id"), F.col("to_id").alias("foundation"))
    ok = lake.objects.where("status = 'approved'").select(F.col("id").alias("foundation"))
    return r.join(lake.objects.where("kind = 'process'").select("id"), "id", "left_semi").join(ok, "foundation", "left_semi").select("id", "foundation")


@query("skill_evidence", "SELECT r.from_id AS id, count(DISTINCT (e.document_id, e.first_seen)) AS evidence, min(f.confidence) AS confidence FROM lake_relations r JOIN lake_objects p ON p.id = r.from_id JOIN lake_objects f ON f.id = r.to_id JOIN lake_evidence e ON e.object_id = f.id WHERE r.type = 'depends_on' AND p.kind = 'process' GROUP BY r.from_id")
def skill_evidence(lake):
    r = lake.relations.where("type = 'depends_on'").select(F.col("from_id").alias("id"), F.col("to_id").alias("object_id")).join(lake.objects.where("kind = 'process'").select("id"), "id", "left_semi")
    e = lake.evidence.join(lake.objects.select(F.col("id").alias("object_id"), F.col("confidence")), "object_id")
    return r.join(e, "object_id").groupBy("id").agg(F.count_distinct("document_id", "first_seen").alias("evidence"), F.min("confidence").alias("confidence"))


@query("source_documents", "SELECT document_id, count(DISTINCT object_id) AS quoted_by FROM lake_evidence GROUP BY 1")
def source_documents(lake):
    return lake.evidence.groupBy("document_id").agg(F.count_distinct("object_id").alias("quoted_by"))


@query("suggested_questions", "SELECT kind, 'What about ' || arg_min(title, id) || '?' AS question FROM lake_objects WHERE status = 'approved' GROUP BY kind")
def suggested_questions(lake):
    return lake.objects.where("status = 'approved'").groupBy("kind").agg(F.concat(F.lit("What about "), F.min_by("title", "id"), F.lit("?")).alias("question"))


@query("doctor", f"SELECT (SELECT count(*) FROM ({VERDICT}) WHERE verdict <> 'ok') AS broken_spans, (SELECT count(*) FROM lake_jobs WHERE state = 'held') AS held, (SELECT count(*) FROM lake_objects WHERE n_evidence = 0) AS without_evidence")
def doctor(lake):
    broken = gate.verify(_spans(lake), lake.documents).where("verdict <> 'ok'").agg(F.count("*").alias("broken_spans"))
    held = lake.jobs.where("state = 'held'").agg(F.count("*").alias("held"))
    return broken.crossJoin(held).crossJoin(lake.objects.where("n_evidence = 0").agg(F.count("*").alias("without_evidence")))


@query("browse", "SELECT id, title FROM lake_objects WHERE status = 'approved' AND (contains(lower(title), 'an') OR contains(lower(body), 'promo')) AND NOT (kind = 'process' AND title IN (SELECT title FROM lake_objects WHERE kind = 'term'))")
def browse(lake):
    hidden = lake.objects.where("kind = 'term'").select("title", F.lit("process").alias("kind"))
    hit = F.contains(F.lower("title"), F.lit("an")) | F.contains(F.lower("body"), F.lit("promo"))
    return lake.objects.where("status = 'approved'").where(hit).join(hidden, ["title", "kind"], "left_anti").select("id", "title")


@query("objects_nested", "SELECT o.id, coalesce(e.n, 0) AS evidence, coalesce(r.links, '') AS links FROM lake_objects o LEFT JOIN (SELECT object_id, count(*) AS n FROM lake_evidence GROUP BY 1) e ON e.object_id = o.id LEFT JOIN (SELECT r.from_id, string_agg(r.type || '>' || coalesce(t.title, r.to_id), ';' ORDER BY r.type, r.to_id) AS links FROM lake_relations r LEFT JOIN lake_objects t ON t.id = r.to_id GROUP BY 1) r ON r.from_id = o.id")
def objects_nested(lake):
    evidence = lake.evidence.groupBy(F.col("object_id").alias("id")).agg(F.count("*").alias("evidence"))
    named = lake.relations.join(lake.objects.select(F.col("id").alias("to_id"), "title"), "to_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("type", "to_id", F.coalesce("title", "to_id").alias("name"))))
    links = named.groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.transform(parts, lambda x: F.concat(x["type"], F.lit(">"), x["name"])), ";").alias("links"))
    return lake.objects.join(evidence, "id", "left").join(links, "id", "left").select("id", F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("links", F.lit("")).alias("links"))


@query("objects_api", "SELECT id, kind, title, CASE status WHEN 'proposed' THEN 'draft' WHEN 'conflicted' THEN 'conflict' ELSE status END AS status FROM lake_objects WHERE status <> 'rejected'")
def objects_api(lake):
    return lake.objects.where("status <> 'rejected'").select("id", "kind", "title", phrases.wire_status(F.col("status")).alias("status"))


@query("evidence_rows", "SELECT b.document_id || '-' || b.start_byte || '-' || b.end_byte AS id, b.ordinal FROM lake_blocks b WHERE b.kind = 'row'")
def evidence_rows(lake):
    return lake.blocks.where("kind = 'row'").select(F.concat_ws("-", "document_id", F.col("start_byte").cast("string"), F.col("end_byte").cast("string")).alias("id"), "ordinal")


@query("entities", "SELECT source AS name, count(*) AS mentions FROM documents GROUP BY source ORDER BY mentions DESC, name LIMIT 10")
def entities(lake):
    return lake.raw("documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(10)


DECIDED = "SELECT id, CASE WHEN num % 3 = 0 THEN 'approve' WHEN num % 5 = 0 THEN 'reject' END AS decision FROM lake_objects WHERE status IN ('proposed', 'conflicted')"


@query("quiz_decisions", f"SELECT o.id, CASE WHEN decision = 'approve' AND n_evidence > 0 AND length(body) > 0 THEN 'approved' WHEN decision = 'reject' THEN 'rejected' ELSE status END AS status, CASE WHEN decision = 'approve' AND n_evidence > 0 AND length(body) > 0 THEN version + 1 ELSE version END AS version FROM lake_objects o LEFT JOIN ({DECIDED}) d ON d.id = o.id")
def quiz_decisions(lake):
    decision = F.when(F.col("num") % 3 == 0, "approve").when(F.col("num") % 5 == 0, "reject")
    d = lake.objects.where("status in ('proposed', 'conflicted')").select("id", decision.alias("decision"))
    return transitions.approve(lake.objects, d).select("id", "status", "version")


@query("supervisor_objects", "SELECT ordinal, 'proposed' AS status, 0.85::DOUBLE AS confidence, document AS locator FROM lake_claims WHERE trim(quote) <> ''")
def supervisor_objects(lake):
    return lake.claims.where(F.trim("quote") != "").select("ordinal", F.lit("proposed").alias("status"), F.lit(0.85).alias("confidence"), F.col("document").alias("locator"))


MERGES = "SELECT a.id AS keep, b.id AS drop FROM lake_objects a JOIN lake_objects b ON b.num = a.num + 1 WHERE a.num % 10 = 0"


@query("merge_objects", f"SELECT DISTINCT r.from_id, coalesce(m.keep, r.to_id) AS to_id, type FROM lake_relations r LEFT JOIN ({MERGES}) m ON m.drop = r.to_id WHERE r.from_id <> coalesce(m.keep, r.to_id)")
def merge_objects(lake):
    a = lake.objects.where("num % 10 = 0").select(F.col("id").alias("keep"), (F.col("num") + 1).alias("num"))
    return transitions.merge_pairs(lake.relations, a.join(lake.objects.select(F.col("id").alias("drop"), "num"), "num").select("keep", "drop"))


@query("stale_warning", "SELECT id, CASE WHEN stale THEN 'Something this rests on changed on ' || split_part('2026-01-' || lpad((updated % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00Z', 'T', 1) || '.' ELSE '' END AS warning FROM lake_objects")
def stale_warning(lake):
    since = F.when(F.col("stale"), F.concat(F.lit("2026-01-"), F.lpad((F.col("updated") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z")))
    return lake.objects.select("id", F.coalesce(phrases.stale_warning(since), F.lit("")).alias("warning"))


@query("may_run_ai", "SELECT id, CASE ['always','never','mains'][(id % 3 + 1)::INT] WHEN 'always' THEN true WHEN 'never' THEN false ELSE attempts <= 3 END AS run FROM lake_jobs")
def may_run_ai(lake):
    policy = F.element_at(F.array(*map(F.lit, ("always", "never", "mains"))), (F.col("id") % 3 + 1).cast("int"))
    return lake.jobs.select("id", phrases.may_run(policy, F.col("attempts") > 3).alias("run"))


@query("missing_files", "SELECT id, name, num % 4 = 1 AS gone FROM lake_documents")
def missing_files(lake):
    listing = lake.documents.where("num % 4 <> 1").select("name")
    return transitions.missing_files(lake.documents.select("id", "name", "gone"), listing).select("id", "name", "gone")


@query("open_gone_reviews", "SELECT DISTINCT e.object_id, e.document_id FROM lake_evidence e JOIN lake_documents d ON d.id = e.document_id WHERE d.gone AND e.first_seen % 2 = 1")
def open_gone_reviews(lake):
    """Objects that rest on a gone document, without those already resolved."""
    resolved = lake.evidence.where("first_seen % 2 <> 1").select("object_id", "document_id")
    return transitions.gone_reviews(lake.documents.select("id", "gone"), lake.evidence, resolved)


@query("quotes_verified", "SELECT e.object_id, e.document_id, 'ok' AS verdict FROM lake_evidence e")
def quotes_verified(lake):
    """Every stored quote against the bytes of its document."""
    return gate.verify(lake.evidence, lake.documents).select("object_id", "document_id", "verdict")


@query("replace_candidates", "SELECT ordinal, document, statement FROM lake_claims WHERE document NOT IN (SELECT document FROM lake_claims WHERE ordinal % 97 = 0) UNION ALL SELECT ordinal, document, upper(statement) FROM lake_claims WHERE ordinal % 97 = 0")
def replace_candidates(lake):
    claims = lake.claims.select("ordinal", "document", "statement")
    return transitions.replace_for(claims, claims.where("ordinal % 97 = 0").withColumn("statement", F.upper("statement")), "document")


@query("put_merge_hints", "SELECT DISTINCT least(a, b) AS left_id, greatest(a, b) AS right_id FROM (SELECT o.id AS a, p.id AS b FROM lake_objects o JOIN lake_objects p ON p.num = o.num + 1 UNION ALL SELECT p.id, o.id FROM lake_objects o JOIN lake_objects p ON p.num = o.num + 2)")
def put_merge_hints(lake):
    """Pairs in canonical order; those already there stay as they are."""
    o = lake.objects.select("id", "num")

    def apart(k, a, b):
        return o.select(F.col("id").alias(a), (F.col("num") + k).alias("num")).join(o.select(F.col("id").alias(b), "num"), "num").select("left_id", "right_id")

    old = transitions.canonical_pairs(apart(1, "left_id", "right_id"))
    new = transitions.canonical_pairs(apart(2, "right_id", "left_id").unionByName(apart(1, "right_id", "left_id")))
    return transitions.insert_new(old, new, ["left_id", "right_id"])
