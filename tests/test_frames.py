"""Frame search by wide bands and leader clusters carried over batches, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import search as R
from cliploom.operators import spans as P
from cliploom.plans import media_queries as Q
from cliploom.plans.views import view


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("most", [8, 3, 0])
def test_near_frames_equal_brute_force(spark, most):
    rnd = random.Random(most)
    base = [rnd.getrandbits(64) for _ in range(30)]
    flip = lambda x, n: x ^ sum(1 << i for i in rnd.sample(range(64), n))
    left = [(i, _signed(x)) for i, x in enumerate(base + base[:2])]
    right = [(i, _signed(flip(rnd.choice(base), rnd.randint(0, 12)))) for i in range(150)] + [(900, left[0][1])]
    got = R.near_frames(spark.createDataFrame(left, "a_id int, a_hash long"), spark.createDataFrame(right, "b_id int, b_hash long"), most)
    want = sorted((a, b, (x ^ y & (1 << 64) - 1).bit_count() if x >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count()) for a, x in left for b, y in right if ((x ^ y) & (1 << 64) - 1).bit_count() <= most)
    assert sorted((r.a_id, r.b_id, r.distance) for r in got.collect()) == [(a, b, d) for a, b, d in want] and want


def test_pairs_tested_per_frame_stay_flat(spark):
    made = {}
    for n in (500, 4000):
        rows = spark.range(n).select(F.xxhash64("id").alias("a_hash"))
        made[n] = R.frame_candidates(rows, rows.withColumnRenamed("a_hash", "b_hash")).count() / n
    # Each meets itself; unrelated hashes add 718 in two million each.
    assert made[500] < 1.4 and made[4000] < 2.6


def test_correlation(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.random(8).tolist(), rng.random(8).tolist()) for _ in range(5)] + [([1.0] * 8, rng.random(8).tolist())]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(R.correlation("a", "b")).collect()]
    assert np.allclose(got[:5], [np.corrcoef(a, b)[0, 1] for a, b in rows[:5]]) and got[5] == 1.0


def plain_centre(feats):
    clusters = []
    for i, f in enumerate(feats):
        gaps = [np.linalg.norm(f - c["centre"]) for c in clusters]
        if gaps and min(gaps) < P.NEAR:
            c = clusters[int(np.argmin(gaps))]
            c["at"].append(i)
            mean = feats[c["at"]].mean(axis=0)
            c["centre"] = mean / (np.linalg.norm(mean) or 1)
        else:
            clusters.append({"at": [i], "centre": f.copy()})
    return max(clusters, key=lambda c: len(c["at"]))["centre"]


@pytest.mark.parametrize("batch", [7, 10_000])
def test_primary_flags_equal_brute_force(spark, data, batch):
    """Also with batches far shorter than a video, so that its state is carried."""
    frames = view(spark, data, "frames")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.video_id, r.frame_idx): r.is_primary for r in P.primary_flags(frames).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    videos = {}
    for r in frames.orderBy("video_id", "frame_idx").collect():
        videos.setdefault(r.video_id, []).append((r.frame_idx, r.feat))
    assert len(videos) > 10
    for video, rows in videos.items():
        feats = np.array([f for _, f in rows], np.float64)
        near = np.linalg.norm(feats - plain_centre(feats), axis=1) <= P.NEAR
        assert [got[video, i] for i, _ in rows] == near.tolist()
    assert 0 < sum(got.values()) < len(got)


def test_window_centres(spark):
    ask = [(3.0, 5.0), (20.0, 10.0), (4.0, 1.0), (1000.0, 8.0)]
    got = [r[0] for r in spark.createDataFrame(ask, "a double, b double").select(R.window_centres(F.col("a"), F.col("b"))).collect()]
    assert got[0] == [1.5] and got[1] == [5.0, 10.0, 15.0] and got[2] == [0.5, 2.5] and len(got[3]) == 12


def test_second_pass_reads_the_winners_frames_only(spark):
    """A source that the first pass ranks fourth is not probed, though it holds the reference."""
    bins = [1.0, 2.0, 3.0]
    frames = [(s, t, _signed((1 << 40) - 1 if s == 4 and t == 0 else (1 << s) - 1), bins) for s in range(1, 5) for t in range(10)]
    frames = spark.createDataFrame([(s, t, h ^ (0xFFFFF << 40) if s == 4 and t else h, b) for s, t, h, b in frames], "source long, second int, hash long, bins array<double>")
    refs = spark.createDataFrame([(99, 4.0)], "ref long, duration double")
    keys = spark.createDataFrame([(99, 0, 0, bins)], "ref long, frame int, hash long, bins array<double>")
    sources = spark.createDataFrame([(s, 10.0) for s in range(1, 5)] + [(5, 1.0)], "source long, duration double")
    got = R.found_sources(refs, keys, sources, frames, F.lit(1)).collect()
    assert [(r.ref, r.source, r.start_s, r.end_s) for r in got] == [(99, 1, 0.0, 4.0)] and got[0].score >= 0.92
    assert R.found_sources(refs, keys, sources.where("source = 5"), frames, F.lit(1)).count() == 0


def test_excerpts_are_found_where_they_were_cut(spark, data):
    rows = Q.jn13_two_pass_sources(spark, data).collect()
    assert rows and all(-1 - r.ref == r.source and r.score >= 0.92 for r in rows)


def test_rows_of_a_hash_stay_few(spark, monkeypatch):
    """A hash has 67 rows on one side and 67 on the other, and a pair is met once."""
    rows = spark.range(50).selectExpr("xxhash64(id) as a_hash", "xxhash64(id) ^ 5 as b_hash")
    made = []
    flips = R._flips
    monkeypatch.setattr(R, "_flips", lambda width, most: made.append(len(flips(width, most))) or flips(width, most))
    found = R.frame_candidates(rows.select("a_hash"), rows.select("b_hash"))
    assert sum(made) == 2 * 67
    pairs = [tuple(r) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) >= 50


def test_hashes_work_out_their_numbers_once(spark, data):
    plan = Q.pr32_gradient_hash(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "embedding" not in plan.split("Generate", 1)[0]
