"""Streams against their batch twins."""

import random
import uuid

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.operators import aggregates as A
from cliploom.operators import search as R
from cliploom.operators.jobs import breaker_changes
from cliploom.sources.snapshots import Snapshots
from cliploom.streaming import jobs as J


def _run(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("calls"))
    rows = [(p, 1000 + 10 * p + i * s, i, 429 if (i % 9) < 6 else 200) for p, s in ((1, 5), (2, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "provider long, s long, event_id long, status int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def test_breaker_stream_equals_batch(spark, calls):
    batch, path = calls
    stream = J.event_stream(spark, path, batch.schema)
    got = sorted(map(tuple, _run(J.breaker_stream(stream), "breaker").collect()))
    assert got == sorted(map(tuple, breaker_changes(batch).collect())) and got


@pytest.fixture(scope="module")
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _events(spark, rows, path):
    df = spark.createDataFrame(rows, "job_id long, event_id long, s double, stage string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.mode("append").parquet(str(path))
    return df


def test_alerts_and_counts(stateful, tmp_path):
    spark = stateful
    rows = [
        (1, 1, 1_000_000.0, "analyzing"), (2, 2, 1_000_100.0, "failed"), (3, 3, 1_000_200.0, "broll_recovery"), (4, 4, 1_200_000.0, "rendering"),
        # A worker of job 5 gives signs of life; job 6 did so, too, and then fell silent.
        *[(5, 10 + i, 1_000_300.0 + 600 * i, "analyzing" if i == 0 else None) for i in range(330)], (6, 400, 1_000_000.0, "titling"), (6, 401, 1_000_800.0, None),
    ]
    _events(spark, rows, tmp_path / "e")
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    counts = _run(J.stage_counts(J.event_stream(spark, str(tmp_path / "e"), schema)), "counts", "complete")
    assert counts.agg(F.sum("n")).head()[0] == len(rows)
    alerts = _run(J.stuck_alerts(J.event_stream(spark, str(tmp_path / "e"), schema)), "alerts")
    # Job 2 has ended and job 4 is not yet silent; the time of job 4's event lets the timers of the others fire.
    assert sorted((r.job_id, r.stage) for r in alerts.collect()) == [(1, "analyzing"), (3, "broll_recovery"), (6, "titling")]


def _batch_durations(events):
    order = W.partitionBy("job_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c)
    closed = events.withColumn("s", (us(F.lead("ts").over(order)) - us("ts")) / 1e6).where("s is not null")
    means, out = {}, []
    for r in closed.orderBy("job_id", "ts", "event_id").collect():
        key = (r.job_id, r.stage)
        means[key] = 0.7 * means[key] + 0.3 * r.s if key in means else r.s
        out.append((r.job_id, r.event_id, r.stage, round(r.s, 3), round(means[key], 3)))
    return sorted(out)


def test_stage_durations_out_of_order_late_and_restarted(stateful, tmp_path):
    """Two runs on one checkpoint; files hold events in any order; the last file brings one behind the watermark."""
    spark = stateful
    rnd = random.Random(5)
    start, stages = 2_000_000.0, ["analyzing", "titling", "rendering"]
    rows = [(j, 100 * j + i, start + i * 300 + rnd.random() * 900, rnd.choice(stages)) for j in (1, 2, 3) for i in range(30)]
    source, check, out = tmp_path / "e", str(tmp_path / "check"), str(tmp_path / "out")
    rnd.shuffle(rows)

    def run():
        stream = J.event_stream(spark, str(source), schema, "2 hours")
        query = J.stage_durations(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(180)

    early = [r for r in rows if r[2] < start + 3000]
    _events(spark, early, source)
    schema = spark.read.parquet(str(source)).schema
    run()
    _events(spark, [r for r in rows if r[2] >= start + 3000], source)
    _events(spark, [(9, 9000, start + 90_000, "rendering"), (9, 9001, start + 90_001, "titling")], source)
    run()
    _events(spark, [(1, 9999, start - 50_000, "analyzing")], source)  # far behind the watermark: dropped
    _events(spark, [(9, 9002, start + 190_000, "rendering")], source)
    run()
    got = sorted(map(tuple, spark.read.parquet(out).where("job_id < 9").collect()))
    assert got == _batch_durations(spark.read.parquet(str(source)).where("job_id < 9 and event_id <> 9999")) and len(got) == 87


SPANS = "ref long, n int, start_s double, end_s double, query string, duration double"


def _spans(spark, refs, path=None):
    rnd = random.Random(7)
    rows = [(r, i, 3.0 * i, 3.0 * i + rnd.choice([0.5, 1.0, 2.0]), rnd.choice(["city", " city ", "sea", "", None]), 20.0 if r % 5 else 0.0) for r in refs for i in range(r % 4 + 1)]
    df = spark.createDataFrame(rows, SPANS)
    if path is not None:
        df.coalesce(1).write.mode("append").parquet(str(path))
    return df


def test_profile_stream_equals_batch_and_survives_a_crash(spark, tmp_path):
    source, root, check = tmp_path / "s", f"file://{tmp_path}/profile", str(tmp_path / "check")
    parts = [range(1, 9), range(9, 30), range(30, 44)]

    def run():
        stream = spark.readStream.schema(SPANS).parquet(str(source))
        J.profile_stream(stream, root).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)

    whole = None
    for part in parts:
        df = _spans(spark, part, source)
        whole = df if whole is None else whole.unionByName(df)
        run()
    store = Snapshots(spark, root)
    # The crash behind a snapshot: the commit of the last batch is lost, so it is run again.
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) == 3
    before = store.live()
    for p in (tmp_path / "check" / "commits").glob(f"*{commits[-1].name}*"):
        p.unlink()
    run()
    assert store.live() == before and before["tag"] == 2
    rounded = lambda df: sorted((r.kind, r.name, r["count"], round(r.total, 9)) for r in df.collect())
    got = rounded(store.read(before))
    assert got == rounded(J.profile_update(None, whole)) and got
    # The averages of the batch report (AG6) and the counts of AG7 are read off the table.
    batch = A.running_profile(A.placement_profile(whole.select(F.col("ref").alias("job_id"), F.col("n").alias("span_idx"), "start_s", "end_s", "duration"), F.col("duration"))).head()
    for name in ("per_30s", "length", "first_start", "gap"):
        kind, _, count, total = next(r for r in got if r[:2] == ("average", name))
        assert count == batch.samples and round(total / count, 6) == batch[name]
    assert next(r[2] for r in got if r[:2] == ("query", "city")) == whole.where("duration > 0 and trim(query) = 'city'").count()


def test_snapshots(spark, tmp_path):
    """Readers are pinned, a crash before the swap leaves the old rows live, invalidation tells what was there."""
    store = Snapshots(spark, f"file://{tmp_path}/index")
    assert store.live() is None
    rows = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, mtime long")
    store.publish(rows("a", "b", "c"))
    pinned = store.read(store.live())
    store.stage(rows("x"))  # died before the swap
    assert store.live()["number"] == 1
    gone = store.invalidate(spark.createDataFrame([("b",), ("z",), ("b",)], "path string"))
    assert sorted(map(tuple, gone.collect())) == [("b", True), ("z", False)]
    assert sorted(r.path for r in store.read(store.live()).collect()) == ["a", "c"] and sorted(r.path for r in pinned.collect()) == ["a", "b", "c"]
    assert Snapshots(spark, f"file://{tmp_path}/index", schema_version=2).live() is None
    assert Snapshots(spark, f"file://{tmp_path}/other").invalidate(rows("a")).collect()[0].was_there is False


def test_chooser_asks_once(spark, tmp_path):
    asked = spark.createDataFrame([(i, q, p) for i, (q, p) in enumerate([("q", ["a", "b"]), ("q", ["a", "b"]), ("fails", ["c"]), ("far", ["d"]), ("none", ["e"])])], "i int, query string, paths array<string>")
    log = tmp_path / "asked"
    log.mkdir()

    def hook(frame):
        (log / uuid.uuid4().hex).write_text(",".join(frame["query"]))
        if "fails" in set(frame["query"]):
            raise ValueError("no answer")
        return [{"q": 1, "far": 7}.get(q) for q in frame["query"]]

    store = Snapshots(spark, f"file://{tmp_path}/picks")
    none = spark.createDataFrame([], "digest string, value string")

    def save(new):
        live = store.live()
        held = store.publish(new.coalesce(1) if live is None else store.read(live).unionByName(new))
        return store.read(held)

    first = R.chosen(asked.where("query <> 'fails'"), none, "m", hook, save).collect()
    assert sorted((r.i, r.pick, r.outcome) for r in first) == [(0, "b", "picked"), (1, "b", "picked"), (3, None, "none"), (4, None, "none")]
    count = len(list(log.iterdir()))
    cache = store.read(store.live())
    again = R.chosen(asked.where("query <> 'fails'"), cache, "m", hook, lambda new: spark.createDataFrame(new.collect(), new.schema))
    assert sorted((r.i, r.pick, r.outcome) for r in again.collect()) == sorted((r.i, r.pick, r.outcome) for r in first)
    assert len(list(log.iterdir())) == count and sorted(",".join(p.read_text() for p in log.iterdir()).split(",")) == ["far", "none", "q"]
    failed = R.chosen(asked, cache, "m", hook, lambda new: spark.createDataFrame(new.collect(), new.schema)).where("query = 'fails'").collect()
    assert [(r.pick, r.outcome) for r in failed] == [(None, "none")]
