"""The knowledge lake's tables, derived from the synthetic tables, as DataFrames and as SQL.

``Lake`` gives each table as a DataFrame; ``SQL_TABLES`` says the same in SQL for the comparison runs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions import phrases, text
from stratalog.operators.order import running

#: How many objects the reads refer to by number.
READ_NUMBERS = 100
#: Brands of parts, numbered from 1, and characters of a quote.
BRANDS, QUOTE = 25, 24
#: Characters from one piece of a quoted text to the next.
PIECE = 256


def epoch(c: Column) -> Column:
    """Whole seconds since 1970 of a wall-clock time, in any session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds num, the position from 0 in the order of ``key``: inside ranges of it, plus what the ranges before hold."""
    return running(df.withColumn("all_", F.lit(0)), "all_", key, {"num": "1"}).drop("all_")


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table of many small rows over all tasks: few bytes of it are much work, and a file of them is one task otherwise."""
        return self.raw(name).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)

    @cached_property
    def documents(self) -> DataFrame:
        """Content-addressed: exact copies collapse to the one with the smallest number."""
        rows = self.raw("documents").select("doc_id", "source", "lang", "text", F.sha2("text", 256).alias("sha256"))
        one = rows.groupBy("sha256").agg(
            F.min("doc_id").alias("num"), F.min_by("source", "doc_id").alias("source_id"), F.min_by("lang", "doc_id").alias("lang"), F.count("*").alias("copies"), F.min_by("text", "doc_id").alias("text")
        )
        ext = F.element_at(F.array(*map(F.lit, ("md", "txt", "csv", "docx", "pdf"))), (F.col("num") % 5 + 1).cast("int"))
        name = F.concat(
            F.when(F.col("num") % 41 == 0, "payroll-").when(F.col("num") % 43 == 0, "template-").otherwise("file-"), F.col("num").cast("string"),
            F.when(F.col("num") % 19 == 0, " (1)").otherwise(""), F.lit("."), ext,
        )
        return one.select(
            F.concat(F.lit("doc:"), F.substring("sha256", 1, 16)).alias("id"), "num", "source_id", "lang", "copies", "text", "sha256", name.alias("name"), ext.alias("kind"),
            F.octet_length("text").cast("long").alias("byte_len"), (F.col("num") % 1000).alias("modified"), (F.col("num") % 17 == 0).alias("gone"),
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """Lines with their byte offsets."""
        lines = self.documents.select(F.col("id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
        before = W.partitionBy("document_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
        size = F.octet_length("text")
        start = F.coalesce(F.sum(size + 1).over(before), F.lit(0))
        return lines.select(
            "document_id", F.col("ordinal").cast("long").alias("ordinal"), "text", start.cast("long").alias("start_byte"), (start + size).cast("long").alias("end_byte"),
            F.when(F.col("text").contains(" | "), "row").when(F.col("text").startswith("#"), "heading").otherwise("paragraph").alias("kind"),
        )

    @cached_property
    def claims(self) -> DataFrame:
        """What a model proposed: a claim for each part, quoting QUOTE characters of the document that its brand numbers."""
        p = self.spread("part", "p_partkey").withColumn("brand", F.substring("p_brand", 7, 9).cast("long"))
        d = self.raw("documents").where(F.col("doc_id").between(1, BRANDS)).groupBy(F.col("doc_id").alias("brand")).agg(F.min("text").alias("text"))
        # once for each of these texts: its id, its length, and overlapping pieces, so that no claim goes through the text
        piece = lambda k: F.struct(F.substr("text", (k * PIECE + 1).cast("int"), F.lit(PIECE + QUOTE)).alias("piece"), F.octet_length(F.substr("text", F.lit(1), (k * PIECE).cast("int"))).alias("start"))
        d = d.select(
            "brand", F.concat(F.lit("doc:"), F.substring(F.sha2("text", 256), 1, 16)).alias("document"), F.length("text").alias("chars"),
            F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / PIECE).cast("int")), piece).alias("pieces"),
        )
        kind = F.element_at(F.array(*map(F.lit, ("fact", "rule", "process", "term"))), (F.col("p_size") % 4 + 1).cast("int"))
        at = (F.col("p_partkey") * 37 % F.greatest(F.col("chars") - QUOTE, F.lit(1))).cast("int")
        held, inside = F.get("pieces", F.floor(F.col("at") / PIECE).cast("int")), F.col("at") % PIECE
        met = p.join(F.broadcast(d), "brand").withColumn("at", at).withColumn("held", held)  # BRANDS rows
        quote = F.substr("held.piece", inside + 1, F.lit(QUOTE))
        before = (F.col("held.start") + F.octet_length(F.substr("held.piece", F.lit(1), inside))).cast("long")
        return met.select(
            F.col("p_partkey").alias("ordinal"), kind.alias("kind"), F.col("p_name").alias("title"),
            F.concat(F.col("p_type"), F.lit(" costs "), (F.col("p_partkey") % 7 * 5).cast("string"), F.lit(" eur within "), F.col("p_size").cast("string"), F.lit(" dana")).alias("statement"),
            "document", (F.col("p_partkey") % 1000).alias("modified"), quote.alias("quote"),
            F.concat(kind, F.lit(":"), text.slug(F.col("p_name"))).alias("key"), before.alias("start_byte"), (before + F.octet_length(quote)).alias("end_byte"),
        )

    @cached_property
    def objects(self) -> DataFrame:
        """Claims consolidated by kind and title: the newest is current, others agree or conflict.

        This is a table that the engine stores, so it is written once and read by all that a query does with it.
        """
        from stratalog.operators.consolidate import consolidate
        from stratalog.operators.graph import keep

        g = consolidate(self.claims)
        status = (
            F.when(F.col("n_disagree") > 2, "conflicted").when(F.length("id") % 4 == 0, "proposed").when(F.length("id") % 9 == 0, "rejected").otherwise("approved")
        )
        return g.select(
            "id", "kind", "title", "body", status.alias("status"), F.col("n_evidence"), "n_disagree", (F.col("n_claims") % 3 + 1).alias("version"), F.col("modified").alias("updated"),
            phrases.confidence(F.col("n_agree"), F.col("n_quotes"), F.col("n_disagree") > 0).alias("confidence"), (F.col("n_claims") % 5 == 0).alias("stale"),
        ).transform(lambda o: keep(numbered(o, "id")))

    @cached_property
    def evidence(self) -> DataFrame:
        """The first quote of each object in each document, with its bytes there."""
        first = F.min_by(F.struct("quote", "start_byte", "end_byte"), "ordinal").alias("q")
        found = self.claims.groupBy(F.col("key").alias("object_id"), F.col("document").alias("document_id")).agg(first, F.min("ordinal").alias("first_seen"))
        return found.select("object_id", "document_id", "q.*", "first_seen")

    @cached_property
    def relations(self) -> DataFrame:
        """Edges between objects by number: a tree of foundations, uses and a few conflicts."""
        o = self.objects.select("id", "num")
        pairs = o.select(F.col("id").alias("from_id"), "num").select(
            "from_id", F.explode(F.array(
                F.struct(F.floor(F.col("num") / 2).cast("long").alias("to_num"), F.lit("depends_on").alias("type")),
                F.struct((F.col("num") + 7).alias("to_num"), F.when(F.col("num") % 3 == 0, "used_by").alias("type")),
                F.struct((F.col("num") + 1).alias("to_num"), F.when(F.col("num") % 11 == 0, "conflicts_with").alias("type")),
            )).alias("e"), "num",
        ).select("from_id", "num", "e.*").where("type is not null and num <> to_num")
        return pairs.join(o.select(F.col("id").alias("to_id"), F.col("num").alias("to_num")), "to_num").select("from_id", "to_id", "type", ((F.col("num") % 10) / 10).alias("confidence"))

    @cached_property
    def reads(self) -> DataFrame:
        """The append log of served reads."""
        e = self.raw("events")
        k = F.get_json_object("props", "$.k").cast("long")
        return e.select(
            F.col("event_id").alias("id"), (k % READ_NUMBERS).alias("num"), F.col("event_type").alias("tool"), epoch(F.col("ts")).alias("moment"),
            F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("app-"), (F.col("user_id") % 7).cast("string"))).alias("app"),
            F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("case-"), (F.col("user_id") % 53).cast("string"))).alias("case_id"),
        )

    @cached_property
    def cases(self) -> DataFrame:
        """Questions with the areas that were offered for them."""
        r = self.reads.where("case_id is not null")
        return r.groupBy(F.col("case_id").alias("id")).agg(
            F.array_sort(F.collect_set(F.col("num") * 7 % READ_NUMBERS)).alias("areas"), F.min("moment").alias("opened"), F.max("moment").alias("last"), F.count("*").alias("n")
        ).withColumn("closed", F.when(F.col("n") % 2 == 0, F.col("last")))

    @cached_property
    def jobs(self) -> DataFrame:
        o = self.raw("orders")
        created = epoch(F.col("o_orderdate"))
        state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("held")
        kind = F.element_at(F.array(*map(F.lit, ("compile", "relate", "rescan", "skills"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
        error = F.element_at(F.array(*map(F.lit, ("Usage limit reached", "Please log in again", "Connection reset", "I cannot help"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
        return o.select(
            F.col("o_orderkey").alias("id"), kind.alias("kind"), state.alias("state"), F.left("o_orderpriority", F.lit(1)).cast("long").alias("priority"), created.alias("created"),
            F.when(state == "done", created + F.col("o_custkey") % 100).alias("finished"), (F.col("o_custkey") % 8).alias("attempts"), F.when(state == "held", error).alias("last_error"),
            F.concat(F.lit('{"document":"d'), F.col("o_custkey").cast("string"), F.lit('"}')).alias("payload"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Calls of engines with token counts that may be unknown."""
        x = self.raw("lineitem")
        stage = F.element_at(F.array(*map(F.lit, ("candidates", "relations", "skill", "supervise"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
        return x.select(
            F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("part"), F.col("l_returnflag").alias("engine"), stage.alias("stage"), epoch(F.col("l_shipdate")).alias("moment"),
            F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("long")).alias("input_tokens"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("output_tokens"),
            F.when(F.col("l_linenumber") < 5, F.floor(F.col("l_quantity") * 3)).cast("long").alias("cost_cents"), F.col("l_linestatus").alias("model"),
        )


SLUG = r"trim(regexp_replace(translate(lower({0}), 'čćžšđ', 'cczsd'), '[^a-z0-9]+', '-', 'g'), '-')"

SQL_TABLES = {
    "documents": r"""
SELECT 'doc:' || substr(sha256, 1, 16) AS id, num, source_id, lang, copies, text, sha256,
  (CASE WHEN num % 41 = 0 THEN 'payroll-' WHEN num % 43 = 0 THEN 'template-' ELSE 'file-' END) || num || (CASE WHEN num % 19 = 0 THEN ' (1)' ELSE '' END) || '.' || ['md','txt','csv','docx','pdf'][(num % 5 + 1)::INT] AS name,
  ['md','txt','csv','docx','pdf'][(num % 5 + 1)::INT] AS kind, strlen(text)::BIGINT AS byte_len, num % 1000 AS modified, num % 17 = 0 AS gone
FROM (SELECT sha256(text) AS sha256, min(doc_id) AS num, arg_min(source, doc_id) AS source_id, arg_min(lang, doc_id) AS lang, count(*) AS copies, arg_min(text, doc_id) AS text FROM documents GROUP BY 1)""",
    "blocks": r"""
SELECT document_id, ordinal, text, start_byte, start_byte + strlen(text)::BIGINT AS end_byte,
  CASE WHEN contains(text, ' | ') THEN 'row' WHEN starts_with(text, '#') THEN 'heading' ELSE 'paragraph' END AS kind
FROM (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte
  FROM (SELECT id AS document_id, unnest(range(len(l)))::BIGINT AS ordinal, unnest(l) AS text FROM (SELECT id, string_split(text, chr(10)) AS l FROM lake_documents)))""",
    "claims": rf"""
SELECT p_partkey AS ordinal, kind, p_name AS title, p_type || ' costs ' || (p_partkey % 7 * 5) || ' eur within ' || p_size || ' dana' AS statement, 'doc:' || substr(sha256(text), 1, 16) AS document,
  p_partkey % 1000 AS modified, substr(text, q_at + 1, {QUOTE}) AS quote, kind || ':' || {SLUG.format("p_name")} AS key,
  strlen(left(text, q_at))::BIGINT AS start_byte, strlen(left(text, q_at + {QUOTE}))::BIGINT AS end_byte
FROM (SELECT *, ['fact','rule','process','term'][(p_size % 4 + 1)::INT] AS kind, p_partkey * 37 % greatest(length(text) - {QUOTE}, 1) AS q_at
  FROM part JOIN (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id BETWEEN 1 AND {BRANDS} GROUP BY doc_id) ON doc_id = substr(p_brand, 7)::BIGINT)""",
    "groups": r"""
SELECT key AS id, any_value(kind) AS kind, any_value(cur.title) AS title, any_value(cur.statement) AS body, any_value(cur.modified) AS modified, count(*) AS n_claims,
  count(DISTINCT document) AS n_evidence, count(DISTINCT quote) AS n_quotes,
  count(DISTINCT document) FILTER (document <> cur.document AND statement_figures <> cur.statement_figures) AS n_disagree,
  1 + count(DISTINCT document) FILTER (document <> cur.document AND statement_figures = cur.statement_figures) AS n_agree
FROM (SELECT *, first_value(s) OVER (PARTITION BY key ORDER BY modified DESC, ordinal) AS cur
  FROM (SELECT *, {'title': title, 'statement': statement, 'modified': modified, 'document': document, 'statement_figures': statement_figures} AS s
    FROM (SELECT *, (ordinal % 7 * 5) || 'eur' || '|' || split_part(split_part(statement, ' within ', 2), ' ', 1) || 'dana' AS statement_figures FROM lake_claims)))
GROUP BY key""",
    "objects": r"""
SELECT id, kind, title, body, CASE WHEN n_disagree > 2 THEN 'conflicted' WHEN length(id) % 4 = 0 THEN 'proposed' WHEN length(id) % 9 = 0 THEN 'rejected' ELSE 'approved' END AS status,
  n_evidence, n_disagree, n_claims % 3 + 1 AS version, modified AS updated,
  round(greatest(0.05, least(0.98, 0.68 + 0.12 * least(greatest(n_agree - 1, 0), 2) + CASE WHEN n_quotes > 1 THEN 0.04 ELSE 0 END - CASE WHEN n_disagree > 0 THEN 0.35 ELSE 0 END))::DOUBLE, 6) AS confidence,
  n_claims % 5 = 0 AS stale, row_number() OVER (ORDER BY id) - 1 AS num
FROM lake_groups""",
    "evidence": "SELECT key AS object_id, document AS document_id, arg_min(quote, ordinal) AS quote, arg_min(start_byte, ordinal) AS start_byte, arg_min(end_byte, ordinal) AS end_byte, min(ordinal) AS first_seen FROM lake_claims GROUP BY ALL",
    "relations": r"""
SELECT e.from_id, t.id AS to_id, e.type, (e.num % 10) / 10.0::DOUBLE AS confidence FROM (
  SELECT id AS from_id, num, num // 2 AS to_num, 'depends_on' AS type FROM lake_objects
  UNION ALL SELECT id, num, num + 7, 'used_by' FROM lake_objects WHERE num % 3 = 0
  UNION ALL SELECT id, num, num + 1, 'conflicts_with' FROM lake_objects WHERE num % 11 = 0) e JOIN lake_objects t ON t.num = e.to_num WHERE e.num <> e.to_num""",
    "reads": r"""
SELECT event_id AS id, (props ->> '$.k')::BIGINT % 100 AS num, event_type AS tool, floor(epoch(ts))::BIGINT AS moment, CASE WHEN user_id % 7 <> 0 THEN 'app-' || (user_id % 7) END AS app,
  CASE WHEN user_id % 5 <> 0 THEN 'case-' || (user_id % 53) END AS case_id FROM events""",
    "cases": r"""
SELECT *, CASE WHEN n % 2 = 0 THEN last END AS closed FROM (SELECT case_id AS id, list_sort(list(DISTINCT num * 7 % 100)) AS areas, min(moment) AS opened, max(moment) AS last, count(*) AS n
  FROM lake_reads WHERE case_id IS NOT NULL GROUP BY case_id)""",
    "jobs": r"""
SELECT o_orderkey AS id, ['compile','relate','rescan','skills'][(o_orderkey % 4 + 1)::INT] AS kind, state, left(o_orderpriority, 1)::BIGINT AS priority, epoch(o_orderdate)::BIGINT AS created,
  CASE WHEN state = 'done' THEN epoch(o_orderdate)::BIGINT + o_custkey % 100 END AS finished, o_custkey % 8 AS attempts,
  CASE WHEN state = 'held' THEN ['Usage limit reached','Please log in again','Connection reset','I cannot help'][(o_orderkey % 4 + 1)::INT] END AS last_error, '{"document":"d' || o_custkey || '"}' AS payload
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'held' END AS state FROM orders)""",
    "runs": r"""
SELECT l_orderkey AS id, l_linenumber::BIGINT AS part, l_returnflag AS engine, ['candidates','relations','skill','supervise'][(l_linenumber % 4 + 1)::INT] AS stage, epoch(l_shipdate)::BIGINT AS moment,
  CASE WHEN l_linenumber <> 7 THEN l_quantity::BIGINT END AS input_tokens, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS output_tokens,
  CASE WHEN l_linenumber < 5 THEN floor(l_quantity * 3)::BIGINT END AS cost_cents, l_linestatus AS model FROM lineitem""",
}
