"""Queries over text cutting, recorded replies, streams and the end-to-end build."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalog.functions import packing
from stratalog.operators import order
from stratalog.operators.consolidate import consolidate
from stratalog.operators.graph import shared_folder
from stratalog.lake import epoch
from stratalog.plans.registry import query
from stratalog.sources import replies
from stratalog.streaming import feeds


def _shared(lake) -> str:
    """A new folder among the shared ones."""
    return f"{shared_folder(lake.spark).rstrip('/')}/feeds-{uuid.uuid4().hex}"


@query("chunk_text")
def chunk_text(lake):
    docs = lake.raw("documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return packing.chunks(docs, 2000).select("id", "part", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("pack_batches", """WITH RECURSIVE d AS (SELECT source, doc_id, strlen(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
w AS (SELECT source, doc_id, rn, n AS used, 0::BIGINT AS batch FROM d WHERE rn = 1
UNION ALL SELECT d.source, d.doc_id, d.rn, CASE WHEN w.used + d.n > 48000 AND w.used > 0 THEN d.n ELSE w.used + d.n END, w.batch + CASE WHEN w.used + d.n > 48000 AND w.used > 0 THEN 1 ELSE 0 END FROM w JOIN d ON d.source = w.source AND d.rn = w.rn + 1)
SELECT source, doc_id, batch FROM w""")  # fmt: skip
def pack_batches(lake):
    docs = lake.raw("documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return order.pack(docs, "source", "doc_id", "bytes", 48_000).select("source", "doc_id", "batch")


@query("compile_batches")
def compile_batches(lake):
    """Calls of at most 48,000 bytes a source, filled with pieces of documents of at most 24,000."""
    docs = lake.raw("documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    pieces = packing.chunks(docs, 24_000).select(F.col("id").cast("long").alias("doc_id"), "part", F.octet_length("text").cast("long").alias("bytes"))
    placed = pieces.join(lake.raw("documents").select("doc_id", "source"), "doc_id").withColumn("place", F.struct("doc_id", "part"))
    return order.pack(placed, "source", "place", "bytes", 48_000).select("source", "doc_id", "part", "bytes", "batch")


@query("line_diff")
def line_diff(lake):
    """What changes when a conversation's turn is followed by the next one."""
    from pyspark.sql import Window as W

    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    t = lake.raw("conversations").withColumn("after", after).where("after is not null")
    versions = t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("before"), "after")
    return packing.line_diff(versions).groupBy("id").agg(F.count_if(F.col("change") == "same").alias("same"), F.count_if(F.col("change") == "del").alias("removed"), F.count_if(F.col("change") == "add").alias("added"))


def _replies(lake):
    """Recorded replies of eight claims each, JSON with prose around it."""
    claim = F.struct("kind", "title", "statement", F.lit(None).cast("string").alias("subtype"), F.array("quote", F.lit(" ")).alias("quotes"))
    g = lake.claims.groupBy("document", F.floor(F.col("ordinal") / 8).alias("batch")).agg(F.collect_list(claim).alias("candidates"))
    prompt = F.concat_ws("/", "document", F.col("batch").cast("string"))
    key = replies.reply_key(F.lit("candidates"), F.lit("propose"), F.lit(replies.CANDIDATES), prompt)
    return g.select("document", "batch", key.alias("key"), F.concat(F.lit("Here it is: "), F.to_json(F.struct("candidates")), F.lit(" Done.")).alias("reply"))


@query("parse_reply", "SELECT document, kind, title, statement, quote FROM lake_claims")
def parse_reply(lake):
    r = _replies(lake)
    replied = replies.replay(r.select("document", "key"), r.select("key", "reply"))
    return replies.candidates(replied).select("document", "kind", "title", "statement", F.col("quotes")[0].alias("quote"))


@query("compile_report", "SELECT (SELECT count(*) FROM lake_claims) AS claims, count(*) AS groups, count(*) FILTER (n_disagree > 0) AS conflicts, sum(n_evidence)::BIGINT AS evidence FROM lake_groups")
def compile_report(lake):
    """Requests, their recorded replies, claims, groups: counted at the end."""
    r = _replies(lake)
    claims = replies.candidates(replies.replay(r.select("document", "key"), r.select("key", "reply")))
    n = claims.agg(F.count("*").alias("claims"))
    g = consolidate(lake.claims)
    return n.crossJoin(g.agg(F.count("*").alias("groups"), F.count_if(F.col("n_disagree") > 0).alias("conflicts"), F.sum("n_evidence").alias("evidence")))


@query("usage_scrape", "SELECT event_id, (props ->> '$.k')::BIGINT AS tokens, CASE WHEN event_id % 3 = 0 THEN 'flat' WHEN event_id % 3 = 1 THEN 'nested' ELSE 'payload' END AS form FROM events")
def usage_scrape(lake):
    """Token counts from records of three shapes: the first alias that is there."""
    k = F.get_json_object("props", "$.k")
    form = F.when(F.col("event_id") % 3 == 0, "flat").when(F.col("event_id") % 3 == 1, "nested").otherwise("payload")
    line = F.concat(F.when(form == "flat", '{"input_tokens":').when(form == "nested", '{"usage":{"prompt_tokens":').otherwise('{"payload":{"info":{"total_token_usage":{"input_tokens":'), k, F.when(form == "flat", "}").when(form == "nested", "}}").otherwise("}}}}"))
    paths = ("$.input_tokens", "$.usage.input_tokens", "$.usage.prompt_tokens", "$.payload.info.total_token_usage.input_tokens")
    rows = lake.raw("events").select("event_id", line.alias("line"), form.alias("form"))
    return rows.select("event_id", F.coalesce(*[F.get_json_object("line", p) for p in paths]).cast("long").alias("tokens"), "form")


def _stream(lake):
    schema = lake.raw("events").schema
    rows = lake.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(lake.sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_use_by_app", "SELECT epoch(ts)::BIGINT // 86400 * 86400 AS start, user_id % 7 AS app, count(*) AS reads FROM (SELECT *, date_trunc('second', ts) AS t FROM events) GROUP BY ALL".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def stream_use_by_app(lake):
    """Running usage of the event stream, every window as it stands when all input has been read."""
    root = _shared(lake)
    feeds.each_batch(feeds.use_by_app(_stream(lake)), f"{root}/state", lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out"), mode="complete")
    return lake.spark.read.parquet(f"{root}/out").select(epoch(F.col("start")).alias("start"), "app", "reads")


@query("stream_dedup", "SELECT event_type, count(DISTINCT floor(epoch(ts))::BIGINT // 21600) AS windows FROM events GROUP BY event_type")
def stream_dedup(lake):
    """Requests taken once for each kind and tumbling window."""
    root = _shared(lake)
    feeds.drain(feeds.once_per_window(_stream(lake), late="3650 days").select("event_type", "key"), f"{root}/out", f"{root}/state")
    return lake.spark.read.schema("event_type string, key string").parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("windows"))


@query("breaker_state")
def breaker_state(lake):
    root = _shared(lake)
    calls = _stream(lake).select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("engine"), "ts", (F.col("value") < 60).alias("ok"))
    feeds.drain(feeds.breaker(calls), f"{root}/out", f"{root}/state")
    out = lake.spark.read.schema("engine string, ts timestamp, state string").parquet(f"{root}/out")
    return out.groupBy("engine", "state").agg(F.count("*").alias("calls"))
