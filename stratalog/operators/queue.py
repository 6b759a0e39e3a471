"""The work queue: a log of commands folded to the state of each job, claims of what is due.

A claim carries a generation.  It lasts for LEASE_SECONDS unless its holder renews it; then the job is due again, and
what the former holder still sends is refused, because its generation is old.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of a claim, attempts before a job is dead, seconds that waiting starts from.
LEASE_SECONDS, MAX_ATTEMPTS, WAIT = 60, 6, 5

STATES = "job long, seq long, accepted boolean, state string, attempts long, generation long, lease_until long, run_after long, last_error string, finished_at long"


@dataclass(frozen=True)
class Job:
    state: str
    run_after: int
    attempts: int = 0
    generation: int = 0
    lease_until: int | None = None
    last_error: str | None = None
    finished_at: int | None = None


def step(job: int, now: Job | None, command: str, at: int, generation: int | None, error: str | None) -> Job | None:
    """The job after a command, or None where it is refused."""
    if command == "enqueue":
        return Job("queued", at) if now is None else None
    if now is None:
        return None
    if command == "lease":
        due = now.state == "queued" and now.run_after <= at or now.state == "leased" and now.lease_until <= at
        return replace(now, state="leased", lease_until=at + LEASE_SECONDS, attempts=now.attempts + 1, generation=now.generation + 1) if due else None
    if command == "release":
        return replace(now, state="queued", run_after=at, last_error=None) if now.state == "held" else None
    if now.state != "leased" or now.generation != generation:
        return None  # not the holder any more
    if command == "heartbeat":
        return replace(now, lease_until=at + LEASE_SECONDS)
    free = replace(now, lease_until=None)
    if command == "finish":
        return replace(free, state="done", finished_at=at)
    if command == "hold":
        return replace(free, state="held", last_error=error, attempts=max(now.attempts - 1, 0))
    if command == "fail" or now.attempts >= MAX_ATTEMPTS:
        return replace(free, state="failed" if command == "fail" else "dead", last_error=error, finished_at=at)
    wait = WAIT * 2 ** min(now.attempts, 10)
    return replace(free, state="queued", run_after=at + wait + job % wait, last_error=error)


def fold(log: DataFrame) -> DataFrame:
    """Every command of ``log`` (job, seq, command, at, generation, error) with whether it was accepted and the job after it.

    A job's commands are read in their order as sorted batches, with one state in memory, however many they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, now = None, None
        for pdf in batches:
            out = []
            for j, seq, command, at, generation, error in zip(*(pdf[c].tolist() for c in ("job", "seq", "command", "at", "generation", "error")), strict=True):
                if j != job:
                    job, now = j, None
                after = step(j, now, command, at, None if pd.isna(generation) else int(generation), error)
                now = after or now
                state = (now.state, now.attempts, now.generation, now.lease_until, now.run_after, now.last_error, now.finished_at) if now else (None,) * 7
                out.append((j, seq, after is not None, *state))
            made = pd.DataFrame(out, columns=[x.split()[0] for x in STATES.split(", ")])
            yield made.astype({c: "Int64" for c in ("attempts", "generation", "lease_until", "run_after", "finished_at")})

    return log.repartition("job").sortWithinPartitions("job", "seq").mapInPandas(run, STATES)


def final(folded: DataFrame) -> DataFrame:
    """Each job as its last command left it."""
    columns = [x.split()[0] for x in STATES.split(", ")][3:]
    return folded.groupBy("job").agg(F.max_by(F.struct(*columns), "seq").alias("s"), F.count_if(~F.col("accepted")).alias("refused")).select("job", "refused", "s.*").where("state is not null")


def due(jobs: DataFrame, now: int) -> DataFrame:
    """Jobs that may be claimed: waiting ones whose time has come, and those whose claim has run out."""
    return jobs.where(F.expr(f"(state = 'queued' and run_after <= {now}) or (state = 'leased' and lease_until <= {now})"))


def claim(jobs: DataFrame, now: int, k: int) -> DataFrame:
    """``jobs`` after the k most urgent due ones are claimed: lowest priority number, then longest due, then first."""
    chosen = F.broadcast(due(jobs, now).orderBy("priority", "run_after", "job").limit(k).select("job", F.lit(True).alias("chosen")))  # k rows
    taken = F.coalesce("chosen", F.lit(False))
    new = {
        "state": F.when(taken, "leased").otherwise(F.col("state")), "lease_until": F.when(taken, F.lit(now + LEASE_SECONDS)).otherwise(F.col("lease_until")),
        "attempts": F.col("attempts") + taken.cast("long"), "generation": F.col("generation") + taken.cast("long"),
    }
    return jobs.join(chosen, "job", "left").select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns])
