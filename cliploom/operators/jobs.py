"""Job and call logs in batch: stuck jobs, forecasts, cool-downs, the burst breaker."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom import schema as S


def _seconds(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp")) / 1e6


def stuck_jobs(events: DataFrame, now: Column) -> DataFrame:
    """Jobs whose last event is older than max(900 s, the stage's limit) and not terminal.

    An event without a stage is a sign of life of the worker: it counts for the time only.
    """
    stage = F.max_by("stage", F.when(F.col("stage").isNotNull(), F.struct("ts", "event_id")))
    last = events.groupBy("job_id").agg(stage.alias("stage"), F.max("ts").alias("ts")).where("stage is not null")
    limits = F.create_map(*[x for k, v in S.STAGE_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    limit = F.greatest(F.lit(S.STUCK_SECONDS), F.coalesce(F.try_element_at(limits, F.col("stage")), F.lit(0.0)))
    idle = _seconds(now) - _seconds("ts")
    return last.where(~F.col("stage").isin(*S.TERMINAL)).where(idle > limit).select("job_id", "stage", F.round(idle, 3).alias("idle_s"))


def resumable_jobs(events: DataFrame, now: Column) -> DataFrame:
    last = events.groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("ts"))
    return last.where(~F.col("stage").isin(*S.TERMINAL)).where(_seconds(now) - _seconds("ts") <= 86400)


def remaining_time(jobs: DataFrame, ceiling: float = 45.0, history: DataFrame | None = None) -> DataFrame:
    """Seconds left per job (job_id, stage, clip_s, variations, elapsed, and mode if there is one): later stages and the rest of this.

    A stage's prior is scaled by the clip's length; with ``history`` (stage, seconds: one row a stage) it is 0.6 of the mean
    and 0.4 of the prior.  Jobs in mode ``manual`` do not select.
    """
    order = list(S.STAGE_SECONDS)
    factor = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("clip_s") / 20.0))
    manual = F.col("mode") == "manual" if "mode" in jobs.columns else F.lit(False)
    known = F.lit(None).cast("map<string,double>")
    if history is not None:
        entries = history.where(F.col("stage").isin(*order)).groupBy("stage").agg(F.avg("seconds").alias("seconds"))
        known = entries.agg(F.map_from_entries(F.collect_list(F.struct("stage", "seconds")))).scalar()
    jobs = jobs.withColumn("_known", known)
    times = []
    for i, stage in enumerate(order):
        own = F.lit(S.STAGE_SECONDS[stage]) * factor
        if stage == "rendering":
            own = own * F.greatest(F.lit(1.0), F.col("variations").cast("double"))
        if stage == "broll_recovery":
            own = F.least(own, F.lit(ceiling))
        mean = F.try_element_at(F.col("_known"), F.lit(stage))
        own = F.coalesce(0.6 * mean + 0.4 * own, own)
        times.append(F.struct(F.lit(i).alias("i"), (F.when(manual, 0.0).otherwise(own) if stage == "selecting" else own).alias("p")))
    table = F.array(*times)
    at = F.array_position(F.array(*map(F.lit, order)), F.col("stage")) - 1
    later = F.aggregate(F.filter(table, lambda x: x["i"] > at), F.lit(0.0), lambda a, x: a + x["p"])
    here = F.aggregate(F.filter(table, lambda x: x["i"] == at), F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), x["p"] - F.col("elapsed")))
    return jobs.select("job_id", "stage", F.when(at < 0, 0.0).otherwise(F.greatest(F.lit(1.0), later + here)).alias("eta_s"))


def cool_downs(calls: DataFrame, seconds: float) -> DataFrame:
    """Every call with whether its provider is cooling down from an earlier 401, 402 or 429."""
    bad = F.when(F.col("status").isin(401, 402, 429), _seconds("ts"))
    before = W.partitionBy("provider").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return calls.withColumn("cooling", F.coalesce(_seconds("ts") < F.max(bad).over(before) + seconds, F.lit(False)))


class Breaker:
    """Five 429s in a row within 60 s of the first open it for 120 s; then one probe decides."""

    LIMIT, WITHIN, OPEN, LOST = 5, 60.0, 120.0, 180.0

    def __init__(self, state: str = "closed", count: int = 0, first: float = 0.0, since: float = 0.0):
        self.state, self.count, self.first, self.since = state, count, first, since

    def call(self, at: float, status: int) -> str | None:
        """Feed one call; the new state if it changed."""
        before = self.state
        if self.state == "open":
            if at < self.since + self.OPEN:
                return None
            self.state, self.since = "probe", at
        elif self.state == "probe" and at >= self.since + self.LOST:
            self.since = at
        if status == 429:
            if self.state == "probe":
                self.state, self.since, self.count = "open", at, 0
            else:
                if self.count == 0 or at - self.first > self.WITHIN:
                    self.count, self.first = 0, at
                self.count += 1
                if self.count >= self.LIMIT:
                    self.state, self.since, self.count = "open", at, 0
        else:
            self.state, self.count = "closed", 0
        return self.state if self.state != before else None


def breaker_changes(calls: DataFrame) -> DataFrame:
    """State changes of each provider's breaker, in time order; rows are read one by one."""
    dealt = calls.select("provider", _seconds("ts").alias("at"), "event_id", "status").repartition("provider").sortWithinPartitions("provider", "at", "event_id")

    def run(batches):
        provider, breaker = None, Breaker()
        for frame in batches:
            out = []
            for p, at, event, status in frame.itertuples(index=False):
                if p != provider:
                    provider, breaker = p, Breaker()
                if (state := breaker.call(at, status)) is not None:
                    out.append((p, at, event, state))
            yield pd.DataFrame(out, columns=["provider", "at", "event_id", "state"])

    return dealt.mapInPandas(run, "provider long, at double, event_id long, state string")


def failure_cutoff(log: DataFrame, run: int = 4) -> DataFrame:
    """From the end of the first ``run`` failures in a row on, later rows are seeded, not tagged."""
    order = W.partitionBy("run_id").orderBy("pos")
    island = log.withColumn("g", F.sum(F.col("ok").cast("int")).over(order))
    streak = F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("run_id", "g").orderBy("pos"))
    hit = island.withColumn("hit", (streak >= run).cast("int"))
    return hit.withColumn("seeded", F.coalesce(F.max("hit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1).drop("g", "hit")
