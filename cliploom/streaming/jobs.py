"""Job and call logs as Structured Streaming jobs; each has a batch twin in ``operators.jobs``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cliploom import schema as S
from cliploom.operators.aggregates import placements
from cliploom.operators.jobs import Breaker
from cliploom.sources.snapshots import Snapshots

#: The state store that ``transformWithState`` needs: set it as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark, path: str, schema, watermark: str = "1 hour") -> DataFrame:
    """Events of a Parquet folder as a stream with event time (the files hold local timestamps)."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def breaker_stream(calls: DataFrame) -> DataFrame:
    """State changes of each provider's breaker; the four numbers of its state are kept."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(*state.get) if state.exists else Breaker()
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, event, status in zip(rows["at"], rows["event_id"], rows["status"]):
            if (changed := breaker.call(at, status)) is not None:
                out.append((key[0], at, event, changed))
        state.update((breaker.state, breaker.count, breaker.first, breaker.since))
        yield pd.DataFrame(out, columns=["provider", "at", "event_id", "state"])

    rows = calls.select("provider", (F.unix_micros("ts") / 1e6).alias("at"), "event_id", "status")
    return rows.groupBy("provider").applyInPandasWithState(
        update, "provider long, at double, event_id long, state string", "state string, count int, first double, since double", "append", GroupStateTimeout.NoTimeout
    )


class StageClock(StatefulProcessor):
    """State of one job: events not yet in order, the open stage, and the running mean of each stage.

    Events wait in a list until the watermark has passed them, then close the stage before them in the order of
    (ts, event_id); so the result does not depend on the order of arrival.  Events behind the watermark are dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, event_id long, stage string")
        self.open = handle.getValueState("open", "us long, event_id long, stage string")
        self.mean = handle.getMapState("mean", "stage string", "seconds double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(us), int(event), stage) for frame in rows for us, event, stage in zip(frame["us"], frame["event_id"], frame["stage"])]
        self.held.appendList(new)
        for ms in sorted({us // 1000 + 1 for us, _, _ in new}):
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted(tuple(x) for x in self.held.get()) if self.held.exists() else []
        ready, rest = [x for x in held if x[0] < due], [x for x in held if x[0] >= due]
        if not ready:
            return
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        out, before = [], tuple(self.open.get()) if self.open.exists() else None
        for us, event, stage in ready:
            if before is not None:
                seconds = (us - before[0]) / 1e6
                name = (before[2],)
                mean = 0.7 * self.mean.getValue(name)[0] + 0.3 * seconds if self.mean.containsKey(name) else seconds
                self.mean.updateValue(name, (mean,))
                out.append((key[0], before[1], before[2], round(seconds, 3), round(mean, 3)))
            before = (us, event, stage)
        self.open.update(before)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "event_id", "stage", "seconds", "average"])

    def close(self) -> None:
        pass


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("us", F.unix_micros("ts"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Each stage as it is closed by its job's next event, with the job's running mean (0.7 old + 0.3 new) of that stage.

    ``events``: job_id, event_id, stage, ts with a watermark.  Needs the RocksDB state store.
    """
    rows = _timed(events).select("job_id", "event_id", "stage", "ts", "us")
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=StageClock(), outputStructType="job_id long, event_id long, stage string, seconds double, average double", outputMode="Append", timeMode="EventTime"
    )


class Watchdog(StatefulProcessor):
    """State of one job: its last stage and time, and one event-time timer that each event moves.

    An event without a stage is a sign of life of the job's worker: it moves the timer and leaves the
    stage.  A terminal stage clears the state; the timer that fires is the alert, once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, stage string, alive_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, stage, alive = tuple(self.last.get()) if self.last.exists() else (-1, "", -1)
        for frame in rows:
            for at, name in zip(frame["us"], frame["stage"]):
                alive = max(alive, int(at))
                if name is not None and at >= us:
                    us, stage = int(at), name
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stage in S.TERMINAL:
            self.last.clear()
            return iter(())
        self.last.update((us, stage, alive))
        limit = max(S.STUCK_SECONDS, S.STAGE_LIMITS.get(stage, 0.0))
        self.handle.registerTimer(max(alive // 1000 + int(limit * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            us, stage, _ = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "last_us": [us]})

    def close(self) -> None:
        pass


def stuck_alerts(events: DataFrame) -> DataFrame:
    """One alert per job that gives no sign for longer than max(900 s, its stage's limit) of event time.

    ``events``: job_id, stage (null: a sign of life only), ts with a watermark.  Needs the RocksDB state store.
    """
    rows = _timed(events).select("job_id", "stage", "ts", "us")
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Watchdog(), outputStructType="job_id long, stage string, last_us long", outputMode="Append", timeMode="EventTime")


def stage_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per stage and hour, late ones dropped after the watermark."""
    return events.groupBy(F.window("ts", width), "stage").agg(F.count(F.lit(1)).alias("n"))


def profile_update(state: DataFrame | None, spans: DataFrame) -> DataFrame:
    """The running profile with the references of ``spans`` (ref, n, start_s, end_s, query, duration) added.

    One table of counters: (kind, name, count, total).  ``average`` rows hold the number of references and the sums
    that averages are made of; ``query`` and ``placement`` rows count.  All are sums, so the order of references does
    not matter and nothing is pruned; ``aggregates.top_counts`` reports the most frequent.
    """
    rows = spans.where("duration > 0").withColumn("key", F.trim(F.coalesce("query", F.lit(""))))
    order = W.partitionBy("ref").orderBy("n")
    gap = F.lead("start_s").over(order) - F.col("end_s")
    each = rows.withColumn("gap", gap).groupBy("ref").agg(
        (F.count(F.lit(1)) / F.first("duration") * 30.0).alias("per_30s"), F.avg(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))).alias("length"),
        F.min_by("start_s", "n").alias("first_start"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap"),
    )
    counter = lambda kind, name, total: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(1).cast("long").alias("count"), total.alias("total"))
    averages = each.select(F.explode(F.array(*[counter("average", F.lit(c), F.col(c).cast("double")) for c in ("per_30s", "length", "first_start", "gap")])).alias("c"))
    counts = rows.select(F.explode(F.filter(F.array(counter("query", F.col("key"), F.lit(0.0)), counter("placement", placements(rows, "duration"), F.lit(0.0))), lambda c: c["name"] != "")).alias("c"))
    made = averages.unionByName(counts).select("c.*")
    every = made if state is None else state.select("kind", "name", "count", "total").unionByName(made)
    return every.groupBy("kind", "name").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def profile_stream(spans: DataFrame, root: str):
    """Keep a running profile below ``root``, one snapshot per micro-batch: a query that is not yet started.

    The snapshot names the batch that made it.  A batch that is run again, after a crash behind its snapshot,
    finds its number there and changes nothing; one that crashed before it finds the old snapshot, whole.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        store = Snapshots(batch.sparkSession, root)
        live = store.live()
        if live is not None and live["tag"] >= number:
            return
        store.publish(profile_update(None if live is None else store.read(live), batch), tag=number)

    return spans.writeStream.foreachBatch(upsert)


def index_stream(files: DataFrame, read_index, extract, append):
    """Keep a clip index up with a stream of catalog rows (path, mtime, size): a query that is not yet started.

    In each micro-batch only rows that are new or changed against ``read_index()`` go through ``extract`` and
    on to ``append``; a batch that is run again finds its rows indexed and adds nothing.
    """
    from cliploom.sources.catalog import index_actions

    def upsert(batch: DataFrame, number: int) -> None:
        missed = index_actions(batch.dropDuplicates(["path"]), read_index()).where("action <> 'hit'").drop("action")
        append(extract(missed))

    return files.writeStream.foreachBatch(upsert)
