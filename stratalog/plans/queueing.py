"""Queries over the work queue, raw search, usage records and incremental reading."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalog.lake import epoch
from stratalog.operators import match, queue, search, usage
from stratalog.operators.graph import keep, shared_folder
from stratalog.plans.registry import query
from stratalog.streaming import changes, feeds, incremental

# the queue

COMMANDS = ("enqueue", "lease", "heartbeat", "lease", "finish", "defer", "lease", "fail", "hold", "release", "lease", "defer")
LOG = f"""log AS (SELECT user_id % 300 AS job, row_number() OVER (PARTITION BY user_id % 300 ORDER BY event_id) - 1 AS seq, floor(epoch(ts))::BIGINT // 40 AS moment, event_id % 4 + 1 AS generation, 'error ' || event_id % 3 AS error,
  CASE WHEN row_number() OVER (PARTITION BY user_id % 300 ORDER BY event_id) = 1 THEN 'enqueue' ELSE {list(COMMANDS)}[((props ->> '$.k')::BIGINT % {len(COMMANDS)} + 1)::INT] END AS command FROM events)"""
FOLD = f"""{LOG},
fold AS (SELECT job, seq, true AS accepted, 'queued' AS state, 0::BIGINT AS attempts, 0::BIGINT AS generation, NULL::BIGINT AS lease_until, moment AS run_after, NULL::VARCHAR AS last_error, NULL::BIGINT AS finished_at FROM log WHERE seq = 0
UNION ALL SELECT job, seq, ok, CASE WHEN NOT ok THEN state ELSE CASE command WHEN 'lease' THEN 'leased' WHEN 'heartbeat' THEN 'leased' WHEN 'release' THEN 'queued' WHEN 'finish' THEN 'done' WHEN 'hold' THEN 'held' WHEN 'fail' THEN 'failed' ELSE CASE WHEN attempts >= 6 THEN 'dead' ELSE 'queued' END END END,
  CASE WHEN ok AND command = 'lease' THEN attempts + 1 WHEN ok AND command = 'hold' THEN greatest(attempts - 1, 0) ELSE attempts END, CASE WHEN ok AND command = 'lease' THEN generation + 1 ELSE generation END,
  CASE WHEN NOT ok OR command = 'release' THEN lease_until WHEN command IN ('lease', 'heartbeat') THEN moment + 60 END,
  CASE WHEN ok AND command = 'release' THEN moment WHEN ok AND command = 'defer' AND attempts < 6 THEN moment + wait + job % wait ELSE run_after END,
  CASE WHEN ok AND command = 'release' THEN NULL WHEN ok AND command IN ('defer', 'fail', 'hold') THEN error ELSE last_error END, CASE WHEN ok AND (command IN ('finish', 'fail') OR command = 'defer' AND attempts >= 6) THEN moment ELSE finished_at END
FROM (SELECT l.job, l.seq, l.command, l.moment, l.error, f.state, f.attempts, f.generation, f.lease_until, f.run_after, f.last_error, f.finished_at, 5 * (1 << f.attempts)::BIGINT AS wait,
  CASE l.command WHEN 'enqueue' THEN false WHEN 'lease' THEN f.state = 'queued' AND f.run_after <= l.moment OR f.state = 'leased' AND f.lease_until <= l.moment WHEN 'release' THEN f.state = 'held' ELSE f.state = 'leased' AND f.generation = l.generation END AS ok
  FROM fold f JOIN log l ON l.job = f.job AND l.seq = f.seq + 1)),
jobs AS (SELECT job, n AS refused, state, attempts, generation, lease_until, run_after, last_error, finished_at FROM (SELECT *, count(*) FILTER (NOT accepted) OVER (PARTITION BY job) AS n, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS r FROM fold) WHERE r = 1)"""


def _log(lake):
    from pyspark.sql import Window as W

    k = F.get_json_object("props", "$.k").cast("long")
    job = (F.col("user_id") % 300).alias("job")
    rows = lake.raw("events").select(job, "event_id", F.floor(epoch(F.col("ts")) / 40).alias("at"), (F.col("event_id") % 4 + 1).alias("generation"), F.concat(F.lit("error "), (F.col("event_id") % 3).cast("string")).alias("error"), k.alias("k"))
    seq = F.row_number().over(W.partitionBy("job").orderBy("event_id")) - 1
    named = F.when(F.col("seq") == 0, "enqueue").otherwise(F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("k") % len(COMMANDS) + 1).cast("int")))
    return rows.withColumn("seq", seq.cast("long")).withColumn("command", named)


@query("lease_log", f"WITH RECURSIVE {FOLD} SELECT job, seq, accepted, state, attempts, generation FROM fold")
def lease_log(lake):
    """Every command of the log, whether the queue took it, and the job after it."""
    return queue.fold(_log(lake)).select("job", "seq", "accepted", "state", "attempts", "generation")


@query("lease_states", f"WITH RECURSIVE {FOLD} SELECT * FROM jobs")
def lease_states(lake):
    return queue.final(queue.fold(_log(lake)))


@query("lease_claims", f"WITH RECURSIVE {FOLD}, moment AS (SELECT max(run_after) AS now FROM jobs), chosen AS (SELECT job FROM jobs, moment WHERE state = 'queued' AND run_after <= now OR state = 'leased' AND lease_until <= now ORDER BY job % 3, run_after, job LIMIT 20) SELECT j.job, CASE WHEN c.job IS NOT NULL THEN 'leased' ELSE state END AS state, generation + (c.job IS NOT NULL)::INT AS generation, CASE WHEN c.job IS NOT NULL THEN now + 60 ELSE lease_until END AS lease_until FROM jobs j CROSS JOIN moment LEFT JOIN chosen c USING (job)")
def lease_claims(lake):
    """The queue after its 20 most urgent due jobs are claimed at once."""
    jobs = keep(queue.final(queue.fold(_log(lake))).withColumn("priority", F.col("job") % 3))
    now = jobs.agg(F.max("run_after")).first()[0]
    return queue.claim(jobs, now or 0, 20).select("job", "state", "generation", "lease_until")


# raw search

TEXTS = "(SELECT doc_id AS id, text FROM documents)"


def _matched(name: str, raw: str, doc: str) -> None:
    def run(lake):
        return match.match(lake.raw("documents").select(F.col("doc_id").alias("id"), "text"), raw)

    run.__doc__ = doc
    query(name, f"SELECT id, score FROM {match.match_sql(TEXTS, raw)}")(run)


_matched("match_phrase", '"apache license"', "Documents with two words in a row.")
_matched("match_prefix", "licen* und*", "Documents with words that begin so, both of them.")
_matched("match_not", "license NOT version", "Documents with one word and without another.")
_matched("match_nested", '("under the" OR "version 2") AND licen* NOT (copyright OR "mit lic"*)', "Phrases, prefixes and operators in brackets.")


@query("match_blocks", f"SELECT id, score FROM {match.match_sql('(SELECT document_id || chr(35) || ordinal AS id, text FROM lake_blocks)', 'licen* OR apache')} ORDER BY score DESC, id LIMIT 12")
def match_blocks(lake):
    """The best lines for a search."""
    b = lake.blocks.select(F.concat("document_id", F.lit("#"), F.col("ordinal").cast("string")).alias("id"), "text")
    return search.top(match.match(b, "licen* OR apache"), 12)


# usage records

_K = "(props ->> '$.k')::BIGINT"


def _outputs(lake):
    """What engines print, in seven forms: plain, nested, over lines, as payloads of payloads, with noise and wrong types."""
    k = F.get_json_object("props", "$.k").cast("long")
    n = lambda by, plus=0: (k * by + plus).cast("string")
    forms = [
        (F.concat(F.lit('{"input_tokens":'), n(1), F.lit(',"model":"m-large","total_cost_usd":0.25}')), None),
        (F.concat(F.lit('{"result":"ok","usage":{"prompt_tokens":'), n(2), F.lit(',"cache_read_input_tokens":'), n(1), F.lit(',"cache_creation_input_tokens":7}}')), None),
        (F.concat(F.lit('starting\n{"input_tokens":1}\n{"payload":{"payload":{"info":{"total_token_usage":{"input_tokens":'), n(3), F.lit(',"output_tokens":5}}}}}\ndone')), F.lit('{"model":"m"}')),
        (F.concat(F.lit('{"info":{"last_token_usage":{"inputTokens":'), n(4), F.lit('}},"last_token_usage":{"outputTokens":9}}')), F.concat(F.lit('warn\n{"output_tokens":'), n(5), F.lit("}"))),
        (F.concat(F.lit('{"input_tokens":"'), n(6), F.lit('","prompt_tokens":-4,"output_tokens":2.0,"cost_usd":1}')), F.lit("[1, 2]")),
        (F.lit("no record"), None),
        (F.concat(F.lit('{"usage":null,"total_token_usage":{"completion_tokens":'), n(7, 1), F.lit('},"payload":{"usage":{"output_tokens":1.5,"cache_tokens":3},"model":"deep-one"}}')), None),
    ]
    pick = F.col("event_id") % len(forms)
    chain = lambda j: F.coalesce(*[F.when(pick == i, f[j]) for i, f in enumerate(forms) if f[j] is not None])
    return lake.spread("events", "event_id").select(F.col("event_id").alias("id"), chain(0).alias("stdout"), chain(1).alias("stderr"))


@query("usage_records", f"""SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN {_K} WHEN 1 THEN {_K} * 2 WHEN 2 THEN {_K} * 3 WHEN 3 THEN {_K} * 4 END AS input_tokens,
CASE event_id % 7 WHEN 2 THEN 5 WHEN 3 THEN {_K} * 5 WHEN 4 THEN 2 WHEN 6 THEN {_K} * 7 + 1 END AS output_tokens, CASE event_id % 7 WHEN 1 THEN {_K} + 7 WHEN 6 THEN 3 END AS cache_tokens,
CASE event_id % 7 WHEN 0 THEN 0.25 WHEN 4 THEN 1 END::DOUBLE AS cost_usd, CASE event_id % 7 WHEN 0 THEN 'm-large' WHEN 6 THEN 'deep-one' END AS model FROM events WHERE event_id % 7 <> 5""")
def usage_records(lake):
    return usage.scrape(_outputs(lake))


# incremental reading

CLAIMS = "ordinal long, kind string, title string, statement string, document string, modified long, quote string, key string"
_FIRST = "substr(document, 5, 1) < '8'"
_AGAIN = "substr(document, 5, 1) < '4'"


@query("incremental_compile", f"""WITH RECURSIVE again AS (SELECT * REPLACE (CASE WHEN {_AGAIN} THEN 'Now ' || title ELSE title END AS title, CASE WHEN {_AGAIN} THEN modified + 1000 ELSE modified END AS modified) FROM lake_claims)
SELECT key AS id, arg_max(title, (modified, -ordinal)) AS title, max(modified) AS modified, count(*) AS n_claims, count(DISTINCT document) AS n_evidence, count(DISTINCT quote) AS n_quotes FROM again GROUP BY key""")
def incremental_compile(lake):
    """Three batches as they arrive, the last reading some documents again; settled in the end as one run over the last state is."""
    root = f"{shared_folder(lake.spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    claims = lake.claims.select(*[x.split()[0] for x in CLAIMS.split(", ")])
    again = claims.where(_AGAIN).withColumn("title", F.concat(F.lit("Now "), "title")).withColumn("modified", F.col("modified") + 1000)
    for part in (claims.where(_FIRST), claims.where(f"not {_FIRST}"), again):
        part.write.mode("append").parquet(f"{root}/in")
        incremental.read_in(lake.spark.readStream.schema(CLAIMS).parquet(f"{root}/in"), f"{root}/store", f"{root}/state")
    groups, _ = incremental.settle(lake.spark, f"{root}/store", CLAIMS)
    return groups.select("id", "title", "modified", "n_claims", "n_evidence", "n_quotes")


# the change feed

LOOK = 21_600


@query("change_feed", f"""WITH RECURSIVE looks AS (SELECT event_type AS source, ceil(epoch_ms(ts) / {LOOK}000.0)::BIGINT * {LOOK} AS moment, arg_max('r' || {_K} % 3, (epoch_ms(ts), event_id)) AS revision FROM events GROUP BY ALL)
SELECT source, moment, revision FROM (SELECT *, lag(revision) OVER (PARTITION BY source ORDER BY moment) AS told FROM looks) WHERE revision IS DISTINCT FROM told""")
def change_feed(lake):
    """A notice for each revision of a source that was not told yet, looked at every six hours of the events' time."""
    root = f"{shared_folder(lake.spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    e = lake.raw("events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("place"), F.concat(F.lit("r"), (F.get_json_object("props", "$.k").cast("long") % 3).cast("string")).alias("revision"))
    # what comes after all others closes the last interval
    end = e.agg((F.max("ts") + F.make_dt_interval(F.lit(2))).alias("ts")).select(F.lit("").alias("source"), "ts", F.lit(0).cast("long").alias("place"), F.lit("").alias("revision"))
    e.unionByName(end).write.parquet(f"{root}/in")
    stream = lake.spark.readStream.schema(e.schema).parquet(f"{root}/in")
    changes.with_rocks(lake.spark, lambda: feeds.drain(changes.notices(stream, LOOK), f"{root}/out", f"{root}/state"))
    out = lake.spark.read.schema(changes.NOTICES).parquet(f"{root}/out")
    return out.where("source <> ''").select("source", epoch(F.col("at")).alias("moment"), "revision")
