"""Rules at their edges, the index stream, and the repository without its training-data part."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cliploom.functions import features as X
from cliploom.functions import text as T
from cliploom.operators import search as R
from cliploom.sources import catalog
from cliploom.streaming import jobs as J


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def test_alignment_of_empty_lengths(spark):
    at = lambda s, e, ref, clip: one(spark, *X.aligned(*map(F.lit, (s, e, ref, clip))))
    assert at(1.0, 2.0, 0.0, 0.0) == (1.0, 2.0) and at(3.0, 2.0, 9.0, 0.0) == (3.0, 3.0)
    assert at(1.0, 12.0, 0.0, 10.0) == (1.0, 10.0) and at(11.0, 11.0, 20.0, 10.0) == (11.0, 10.0)
    assert at(1.2, 1.3, 15.0, 15.0) == (1.2, 1.3)
    start, end = at(8.0, 12.0, 12.0, 10.0)
    assert round(start, 4) == 6.6667 and end == 10.0


def test_unique_strings_and_names(spark):
    words = F.array(*map(F.lit, (" a", "B", "A", "", "b ", "c")))
    assert one(spark, T.unique_strings(words)) == (["a", "B", "c"],)
    text = F.lit("then Jeff Bezos's plan met JEFF BEZOS and Elon Musk. The Company Rule was Elon Musk's.")
    assert one(spark, T.name_phrases(text)) == (["Jeff Bezos", "Elon Musk"],)


def test_odd_limits_keep_half_rounded_down(spark):
    rows = [(f"p{i}", 100 - i, "same") for i in range(8)] + [("q", 1, "other")]
    got = R.diverse_newest(spark.createDataFrame(rows, "path string, mtime long, name_key string"), 5).collect()
    assert [r.path for r in got] == ["p0", "p1", "q"]


def test_missing_roots_have_no_files(spark, tmp_path):
    (tmp_path / "a.MP4").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert catalog.media_files(spark, str(tmp_path / "none")).count() == 0
    assert [r["size"] for r in catalog.media_files(spark, str(tmp_path / "none"), str(tmp_path)).collect()] == [1]


def test_index_stream_extracts_only_what_changed(spark, tmp_path):
    schema = "path string, mtime long, size long"
    index, files = str(tmp_path / "index"), str(tmp_path / "files")
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema).write.parquet(index)
    spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], schema).write.parquet(files)
    added = str(tmp_path / "added")
    query = J.index_stream(spark.readStream.schema(schema).parquet(files), lambda: spark.read.parquet(index), lambda rows: rows.withColumn("done", F.lit(True)), lambda rows: rows.write.mode("append").parquet(added))
    started = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    started.awaitTermination(120)
    assert sorted((r.path, r.done) for r in spark.read.parquet(added).collect()) == [("b", True), ("c", True)]


def test_pick_cache_names_ignore_the_order_of_paths(spark):
    asked = spark.createDataFrame([(1, "q", ["b", "a"]), (2, "q", ["a", "b"]), (3, "other", ["a"])], "id int, query string, paths array<string>")
    cache = asked.where("id = 1").select(R.digest("query", "paths", "m").alias("digest"), F.lit("1").alias("value"))
    got = {r.id: (r.pick, r.outcome) for r in R.cached_picks(asked, cache, "m").collect()}
    assert got == {1: ("a", "picked"), 2: ("b", "picked"), 3: (None, "ask")}


def test_match_notes_round_the_double_itself(spark):
    """0.715 is a little less than it reads, 0.125 a true tie (to the even digit)."""
    scores = [i / 1000 for i in range(1001)] + [0.125, 0.375, 0.714999, 0.715001]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select("s", X.match_note(F.col("s"), F.lit(1.0)).alias("note")).collect()
    name = lambda s: "strong" if s >= 0.8 else "good" if s >= 0.6 else "weak" if s >= 0.4 else "poor"
    assert [r.note for r in rows] == [f"{name(r.s)} match ({r.s:.2f})" for r in rows] and len(rows) == len(scores)


@pytest.mark.parametrize("first", ["cliploom.plans.clip_queries", "cliploom.plans.registry"])
def test_query_modules_import_in_any_order(first):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", f"import {first}"], cwd=root, check=True, timeout=120)


def test_the_rest_works_without_the_training_data_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "__pycache__", ".pytest_cache")])
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'wn13_best_window' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q) and set(o) <= set(q)"
    for _ in range(2):  # with corpus_pipeline.py left behind, then without it
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
        if (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()


def test_job_timings_are_differences_of_seconds(spark, monkeypatch):
    """Times half a tenth apart, of which the difference of the doubles is a little less or more."""
    from cliploom.plans import source_queries as Q

    first = 1_704_067_211_172_425
    pairs = [(first + 977 * i, first + 977 * i + 50_000) for i in range(40)]
    rows = [(j, j * 10 + n, t, stage) for j, pair in enumerate(pairs) for n, (t, stage) in enumerate(zip(pair, ("analyzing", "rendering")))]
    events = spark.createDataFrame(rows, "job_id long, event_id long, us long, stage string").selectExpr("job_id", "event_id", "timestamp_micros(us) as ts", "stage")
    spans = spark.createDataFrame([(0, 0)], "job_id long, span_idx int")
    monkeypatch.setattr(Q, "view", lambda s, d, name: {"job_events": events, "spans": spans}[name])
    want = {j: f"analyzing={0.0 if b / 1e6 - a / 1e6 < 0.05 else 0.1}" for j, (a, b) in enumerate(pairs)}
    assert len(set(want.values())) == 2
    assert {r.job_id: r.timings for r in Q.pr34_job_summaries(spark, "").collect()} == want
