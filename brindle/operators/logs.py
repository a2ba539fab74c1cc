"""Append-only logs: retention, throttles, breakers, states."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.snapshots import shared_root

SEGMENT_ROWS = 500_000


def newest(log: DataFrame, n: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The newest n rows, of each key if by is given. order: columns, latest last."""
    latest = [F.desc(c) for c in order]
    if not by:
        return log.orderBy(*latest).limit(n)
    w = Window.partitionBy(*by).orderBy(*latest)
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


UNFINISHED = ("queued", "running")
FINISHED_KEPT = 10_000  # finished tasks kept that may be listed and sent to all executors


def retained_jobs(jobs: DataFrame, now: float, days: float = 30, newest_n: int = 199) -> DataFrame:
    """The jobs (id, status, created_at, updated_at; in seconds) that stay: unfinished ones, and of finished ones the newest_n created last (of equal times the
    larger id) if they changed within so many days. The newest are a list of newest_n, found by tasks that keep as many each."""
    if not 0 <= newest_n <= FINISHED_KEPT:
        raise ValueError("too many finished jobs to list")
    open_ = F.coalesce(F.col("status").isin(*UNFINISHED), F.lit(False))
    last = newest(jobs.where(~open_), newest_n, ["created_at", "id"]).where(F.col("updated_at") >= now - days * 86400).select(F.col("id").alias("__kept"))
    return jobs.where(open_).unionByName(jobs.where(~open_).join(F.broadcast(last), F.col("id") == F.col("__kept"), "left_semi"))


def live_sessions(sessions: DataFrame, now: float, newest_n: int = 10) -> DataFrame:
    """The sessions (user, id, expires in seconds) of which none has expired, the newest_n of each user that end last."""
    return newest(sessions.where(F.col("expires") >= now), newest_n, ["expires", "id"], by=["user"])


def breaker(calls: DataFrame, most: int = 16, failures: int = 3) -> DataFrame:
    """calls (key, idx from 0, ok) with status complete, failed or skipped: after so many failures in a row, or most calls, no more are made.
    Nothing resets a breaker that has opened, so its place is the end of the first such run."""
    w = Window.partitionBy("key").orderBy("idx")
    run = F.sum((~F.col("ok")).cast("int")).over(w.rowsBetween(1 - failures, 0))
    opened = calls.withColumn("__open", F.when((run == failures) & (F.col("idx") >= failures - 1), F.col("idx")))
    first = F.min("__open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    skipped = (F.col("idx") >= most) | F.coalesce(F.col("idx") > first, F.lit(False))
    return opened.select("key", "idx", F.when(skipped, "skipped").when(F.col("ok"), "complete").otherwise("failed").alias("status"))


def admitted_in(times: list[float], accepted: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """For attempts in order, given the accepted ones before: which are accepted, and the accepted ones that still count."""
    out = []
    for t in times:
        accepted = [x for x in accepted if t - x < window]
        out.append(len(accepted) < limit)
        if out[-1]:
            accepted.append(t)
    return out, accepted


def throttle(attempts: DataFrame, limit: int = 10, window: float = 300.0) -> DataFrame:
    """attempts (key, at in seconds, id) with accepted: at most `limit` accepted ones in any window. Rows come sorted by key and time, and
    only the accepted ones of one key that still count are held."""
    rows = attempts.select("key", "at", "id").repartition("key").sortWithinPartitions("key", "at", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for b in batches:
            out = []
            for k, part in b.groupby("key", sort=False):
                if k != key:
                    key, held = k, []
                ok, held = admitted_in(part["at"].tolist(), held, limit, window)
                out.append(part.assign(accepted=ok))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, at double, id bigint, accepted boolean")


def concurrency(log: DataFrame, cap: int) -> DataFrame:
    """log (owner, at, id, change +1 or -1) with running, and whether it exceeds the cap."""
    running = F.sum("change").over(Window.partitionBy("owner").orderBy("at", "id"))
    return log.withColumn("running", running).withColumn("over", F.col("running") > cap)


def admitted(log: DataFrame, per_owner: int = 6, in_all: int = 24, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """log (owner, at, id, change: +1 asks to start a task, -1 ends one) with admitted and running (the owner's tasks after the row). A start is refused while its owner has per_owner tasks or all have
    in_all; refused ones do not count, and an end without a running task changes nothing.

    Both limits hold in the order of time, so one task's decision depends on all before it, but only through who is running, at most in_all owners. The log
    lies in segments of time. All are folded at once from a guessed start (nobody runs); then each segment whose start differs from what the one before
    it ended with is folded again, until none does. Folds from different starts soon end alike, as a full house or an empty one forgets how it began; in the worst case a
    round settles one more segment.
    """
    spark, kinds = log.sparkSession, dict(log.dtypes)
    path = f"{shared_root(spark)}/log-{uuid.uuid4().hex}"
    n = max(1, -(-log.count() // segment_rows))
    rows = log.select("owner", "at", "id", "change").repartitionByRange(n, "at", "id").withColumn("segment", F.spark_partition_id())
    rows.write.partitionBy("segment").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)

    def folded(starts: dict[int, dict], ends: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, held = None, Counter()
            for b in batches:
                out = []
                for segment, part in b.groupby("segment", sort=False):
                    if segment != at:
                        if ends and at is not None:
                            yield _held(at, held)
                        at, held = segment, Counter(starts.get(segment, {}))
                    done = _fold(part["owner"].tolist(), part["change"].tolist(), held, per_owner, in_all)
                    out.append(part[["owner", "at", "id", "change"]].assign(admitted=[x[0] for x in done], running=[x[1] for x in done]))
                if out and not ends:
                    yield pd.concat(out)
            if ends and at is not None:
                yield _held(at, held)

        return run

    def _held(segment: int, held: Counter) -> pd.DataFrame:
        return pd.DataFrame({"segment": [segment] * (len(held) + 1), "owner": [*held, None], "n": [*held.values(), 0]}).astype({"owner": "object"})

    def in_order(segments: list[int] | None) -> DataFrame:
        some = rows if segments is None else rows.where(F.col("segment").isin(segments))
        return some.repartition(n, "segment").sortWithinPartitions("segment", "at", "id")

    starts: dict[int, dict] = {}
    found: dict[int, dict] = {}
    again = None
    while n > 1:  # at most in_all rows of each segment reach the driver
        for k in range(n) if again is None else again:
            found[k] = {}
        for r in in_order(again).mapInPandas(folded(starts, True), f"segment int, owner {kinds['owner']}, n bigint").collect():
            if r["n"]:
                found[r["segment"]][r["owner"]] = r["n"]
        there = sorted(k for k in range(n))
        new = {b: found[a] for a, b in zip(there, there[1:], strict=False)}
        again = [k for k in there if new.get(k, {}) != starts.get(k, {})]
        starts = new
        if not again:
            break
    return in_order(None).mapInPandas(folded(starts, False), f"owner {kinds['owner']}, at {kinds['at']}, id {kinds['id']}, change int, admitted boolean, running bigint")


def _fold(owners: list, changes: list[int], held: Counter, per_owner: int, in_all: int) -> list[tuple[bool, int]]:
    """Whether each row took effect, and its owner's tasks after it. held (running tasks by owner) is carried on."""
    out, total = [], sum(held.values())
    for owner, change in zip(owners, changes, strict=True):
        now = held.get(owner, 0)
        ok = now < per_owner and total < in_all if change > 0 else now > 0
        if ok:
            now, total = (now + 1, total + 1) if change > 0 else (now - 1, total - 1)
            if now:
                held[owner] = now
            else:
                del held[owner]
        out.append((ok, now))
    return out


def latest_state(events: DataFrame) -> DataFrame:
    """task, status of events (task, status, at, id)."""
    return events.groupBy("task").agg(F.max_by("status", F.struct("at", "id")).alias("status"))


def after_restarts(states: DataFrame, restarts: DataFrame) -> DataFrame:
    """states (task, status, at) when services have restarted (at): a task that was unfinished at a restart after its last event has failed, as nothing goes on with
    it. Only the last restart can tell."""
    last = F.broadcast(restarts.agg(F.max("at").alias("__restart")))
    lost = F.coalesce(F.col("status").isin(*UNFINISHED) & (F.col("at") < F.col("__restart")), F.lit(False))
    return states.join(last).select("task", F.when(lost, "failed").otherwise(F.col("status")).alias("status"), F.when(lost, F.col("__restart")).otherwise(F.col("at")).alias("at"), lost.alias("interrupted"))
