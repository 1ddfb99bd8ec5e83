"""The job log: states folded from events, in batch and as a stream.

Events have (job_id, ts, event) with event one of submit, claim, heartbeat, complete, fail, cancel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.blocks import BLOCK, ordered

# From which states an event moves a job, and where to.
MOVES = {
    "submit": (("",), "queued"),
    "claim": (("queued",), "running"),
    "complete": (("running",), "complete"),
    "fail": (("running",), "failed"),
    "cancel": (("queued", "running"), "cancelled"),
    "resume": (("interrupted", "cancelled", "partial", "failed"), "queued"),
    "recover": (("queued", "running", "cancelling"), "interrupted"),
}
TERMINAL = ("complete", "failed", "cancelled", "partial")


def step(state: str, event: str) -> str:
    """Compare and set: the next state, or the same one if the event does not apply."""
    allowed, target = MOVES.get(event, ((), state))
    return target if state in allowed else state


def final_states(events: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(job, state, attempts): all events of a job folded in order.

    Moves only depend on the state before, and there are few states.  So each block of events is folded from every
    state it could begin in, and a job follows its blocks; no task holds all events of a job.
    """
    states = sorted({"", *(target for _, target in MOVES.values()), *(s for allowed, _ in MOVES.values() for s in allowed)})
    rows = ordered(events.select(job, *order, "event"), [job, *order])
    listed = rows.groupBy(job, BLOCK).agg(F.array_sort(F.collect_list(F.struct(*order, "event"))).alias("es"))

    def fold(acc, e):
        state = acc["state"]
        new = state
        for name, (allowed, target) in MOVES.items():
            new = F.when((e["event"] == name) & state.isin(*allowed), F.lit(target)).otherwise(new)
        claimed = (e["event"] == "claim") & (state == "queued")
        return F.struct(new.alias("state"), (acc["attempts"] + F.when(claimed, 1).otherwise(0)).alias("attempts"))

    def begin(state: str):
        return F.struct(F.lit(state).alias("state"), F.lit(0).alias("attempts"))

    leads = F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*(F.aggregate("es", begin(s), fold) for s in states)))
    blocks = listed.select(job, F.struct(BLOCK, leads.alias("leads")).alias("b")).groupBy(job).agg(F.array_sort(F.collect_list(F.struct(F.col(f"b.{BLOCK}").alias("n"), F.map_entries("b.leads").alias("leads")))).alias("bs"))

    def follow(acc, b):
        to = F.map_from_entries(b["leads"])[acc["state"]]
        return F.struct(to["state"].alias("state"), (acc["attempts"] + to["attempts"]).alias("attempts"))

    return blocks.select(job, F.aggregate("bs", begin(""), follow).alias("s")).select(job, "s.state", "s.attempts")


def claim_order(jobs: DataFrame, created: str = "created", ident: str = "job_id", status: str = "status") -> DataFrame:
    """Queued jobs, oldest first."""
    return jobs.where(F.col(status) == "queued").orderBy(created, ident)


def attempts(events: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, attempts, first_claim, last_claim)."""
    return events.where("event = 'claim'").groupBy(job).agg(F.count("*").alias("attempts"), F.min("ts").alias("first_claim"), F.max("ts").alias("last_claim"))


def expired(jobs: DataFrame, now, ttl_seconds: int, status: str = "status", updated: str = "updated") -> DataFrame:
    """Jobs in a final state whose last change is older than the time to live, to the microsecond; now is a time or a column."""
    return jobs.where(F.col(status).isin(*TERMINAL) & (F.col(updated) < F.lit(now) - F.make_dt_interval(secs=F.lit(ttl_seconds))))


def idempotency(events: DataFrame, key: str = "key_hash", fingerprint: str = "fingerprint", order: str = "event_id") -> DataFrame:
    """Each submission with outcome: new for the first of a key, same for equal content, conflict for other content."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.first(fingerprint).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("outcome", F.when(F.row_number().over(w) == 1, "new").when(F.col(fingerprint) == first, "same").otherwise("conflict"))


class JobProcessor(StatefulProcessor):
    """The same moves on a stream: one value of state for each job, dropped ttl_ms after its last change."""

    def __init__(self, ttl_ms: int = 7 * 24 * 3600 * 1000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "state string, attempts int", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state, count = self.state.get() if self.state.exists() else ("", 0)
        for event in pd.concat(list(rows)).sort_values(["ts", "event_id"])["event"]:
            new = step(state, event)
            count += event == "claim" and state == "queued"
            state = new
        self.state.update((state, int(count)))
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "attempts": [int(count)]})

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, ttl_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """A stream of (job_id, state, attempts) after each batch of events."""
    return events.groupBy("job_id").transformWithStateInPandas(JobProcessor(ttl_ms), "job_id string, state string, attempts int", "Update", "ProcessingTime")


def deduplicated(events: DataFrame, delay: str = "1 hour", key: str = "key_hash") -> DataFrame:
    """A stream of submissions without repeats of a key inside the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
