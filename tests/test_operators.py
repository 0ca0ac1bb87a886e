"""Operators on literal tables with values worked out from their formulas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cliploom.functions import features as X
from cliploom.functions import text as T
from cliploom.operators import aggregates as A
from cliploom.operators import assign as G
from cliploom.operators import jobs as K
from cliploom.operators import scoring as J
from cliploom.operators import search as R
from cliploom.operators import spans as P
from cliploom.operators import transcripts as V
from cliploom.sources import catalog as C

CLIP = "clip_id long, category string, subjects array<string>, setting array<string>, mood array<string>, lighting string, energy string, shot_type string, camera_motion string, depth_of_field string"


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).head()[0]


def test_clip01_guards_nan_and_infinity(spark):
    rows = spark.createDataFrame([(math.nan,), (math.inf,), (-1.0,), (2.0,), (0.25,), (None,)], "v double")
    assert [r[0] for r in rows.select(X.clip01(F.col("v"))).collect()] == [0, 0, 0, 1, 0.25, 0]


def test_alignment(spark):
    got = {}
    for start, end, ref, clip in [(1.2, 1.3, 15.0, 15.0), (8.0, 12.0, 12.0, 10.0), (11.0, 12.0, 12.0, 10.0)]:
        row = spark.createDataFrame([(start, end, ref, clip)], "a double, b double, r double, c double").select(*X.aligned(*map(F.col, "abrc"))).head()
        got[start] = (round(row[0], 4), round(row[1], 4))
    assert got[1.2] == (1.2, 1.3) and got[8.0] == (6.6667, 10.0) and got[11.0][1] == 10.0


def test_acceptance_scores(spark):
    """The six fixed clips against one span: base .625, with vibe and cinema as worked out by hand."""
    span = (0, "movie", ["a", "b"], [], ["epic"], "low-key", "high", "wide", "static", "deep")
    same = (1, "movie", ["a", "b"], [], ["epic"], "low-key", "high", "wide", "dolly", "deep")
    other = (2, "movie", ["a", "b"], [], ["calm"], "neon", "low", "close-up", "static", "shallow")
    clips = spark.createDataFrame([same, other], CLIP)
    rows = J.paired(spark.createDataFrame([span], CLIP), clips).select("b_clip_id", J.base_score(), J.vibe_score(), J.cinema_score(), J.intelligent(J.base_score(), J.vibe_score(), J.cinema_score()))
    got = {r[0]: [round(x, 6) for x in r[1:]] for r in rows.collect()}
    assert got[1][:3] == [0.625, 1.0, 1.0] and got[1][3] == pytest.approx(0.75625)
    assert got[2][1] == 0.05 and got[2][2] == round((0.25 + 0.4 + 0.2) / 3, 6)


def test_keyword_scores_need_no_cross_product(spark):
    a = spark.createDataFrame([(1, "x", ["p", "p", "q"], ["s"])], "ref_id long, category string, subjects array<string>, setting array<string>")
    b = spark.createDataFrame([(7, "x", ["q"], ["s"]), (8, "y", ["z"], [])], "clip_id long, category string, subjects array<string>, setting array<string>")
    scores = J.keyword_scores(a, b)
    assert [tuple(r) for r in scores.collect()] == [(1, 7, 0.625)]
    assert "NestedLoop" not in scores._jdf.queryExecution().toString() and "Cartesian" not in scores._jdf.queryExecution().toString()


def test_shot_spans(spark):
    flags = [False] * 30 + [True] * 21 + [False] * 19 + [True] * 20
    cuts = {18, 30, 51, 60, 70}
    rows = spark.createDataFrame([(0, i, i in cuts, f, True) for i, f in enumerate(flags)], "video_id int, frame_idx int, is_cut boolean, primary boolean, visual boolean")
    assert [(r.start_s, r.end_s) for r in P.segment_spans(rows).orderBy("n").collect()] == [(0.0, 1.8), (1.8, 3.0), (5.1, 6.0), (6.0, 7.0)]


def test_gap_fill_and_runs(spark):
    frames = lambda flags: spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "video_id int, frame_idx int, ok boolean")
    assert [(r.start_s, r.end_s) for r in P.flag_spans(frames([True, False, True, True]), "ok").collect()] == [(0.0, 0.4)]
    assert P.flag_spans(frames([False] * 5), "ok").count() == 0


def test_ordered_mode_prefers_the_first(spark):
    rows = spark.createDataFrame([("j", 0, "b"), ("j", 1, "a"), ("j", 2, "a"), ("j", 3, "b"), ("j", 4, "")], "job_id string, span_idx int, v string")
    assert A.ordered_modes(rows, "job_id", "span_idx", ["v"]).head().v == "b"


def test_placement_profile(spark):
    rows = spark.createDataFrame([(1, 0, 3.0, 5.0), (1, 1, 12.0, 14.0)], "job_id long, span_idx int, start_s double, end_s double")
    got = A.placement_profile(rows, F.lit(30.0)).head()
    assert (got.per_30s, got.length, got.first_start, got.gap) == (2.0, 2.0, 3.0, 7.0)


def test_greedy_takes_each_clip_once_and_in_span_order(spark):
    random.seed(3)
    rows = [(j, s, c, random.randint(1, 9) / 10) for j in range(5) for s in range(6) for c in range(20)]
    got = {(r.job_id, r.span_idx, r.rank): r.clip_id for r in G.greedy(spark.createDataFrame(rows, "job_id long, span_idx int, clip_id long, score double"), 2).collect()}
    want = {}
    for j in range(5):
        used = set()
        for s in range(6):
            free = [c for _, c in sorted((-v, c) for a, b, c, v in rows if (a, b) == (j, s)) if c not in used][:2]
            used.update(free)
            want.update({(j, s, i + 1): c for i, c in enumerate(free)})
    assert got == want


def test_overlap_join_equals_brute_force(spark):
    random.seed(5)
    wins = [(a, lo, lo + random.random() * 40) for a in range(3) for lo in [random.random() * 50 for _ in range(12)]]
    items = [(a, p, s, s + random.random() * 30) for a in range(3) for p, s in enumerate(random.random() * 60 for _ in range(40))]
    got = V.overlapping(spark.createDataFrame(wins, "asset_id int, lo double, hi double"), spark.createDataFrame(items, "asset_id int, pos int, start_s double, end_s double"), 7.0)
    want = sorted((a, lo, p) for a, lo, hi in wins for b, p, s, e in items if a == b and e > lo and s < hi)
    assert sorted((r.asset_id, r.lo, r.pos) for r in got.collect()) == want


def test_caption_cues_equal_a_plain_loop(spark):
    random.seed(7)
    at, words = 0.0, []
    for i in range(60):
        at += random.choice([0.1, 0.2, 1.5])
        words.append((1, i, random.choice(["a", "b c", "d"]), at, at + 0.3))
        at += 0.3
    cues, group = [], []
    for w in words:
        if group and (sum(len(x[2].split()) for x in group) + len(w[2].split()) > 3 or w[3] - group[-1][4] > 1.0):
            cues.append(group)
            group = []
        group.append(w)
    cues.append(group)
    got = V.caption_cues(spark.createDataFrame(words, "asset_id int, pos int, word string, start_s double, end_s double")).orderBy("cue").collect()
    assert [r.text for r in got] == [" ".join(x[2] for x in g) for g in cues]
    assert all(a.end <= b.start for a, b in zip(got, got[1:]))


def test_near_frames_find_every_pair_within_eight_bits(spark):
    random.seed(9)
    base = [random.getrandbits(63) for _ in range(6)]
    left, right = [(i, h) for i, h in enumerate(base)], []
    for i, h in enumerate(base):
        for k in range(0, 12, 2):
            right.append((i * 100 + k, h ^ sum(1 << b for b in random.sample(range(63), k))))
    got = R.near_frames(spark.createDataFrame(left, "a_id int, a_hash long"), spark.createDataFrame(right, "b_id int, b_hash long"))
    want = sorted((a, b) for a, x in left for b, y in right if bin(x ^ y).count("1") <= 8)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == want


def test_breaker():
    b = K.Breaker()
    changes = [b.call(t, 429) for t in range(5)]
    assert changes == [None] * 4 + ["open"] and b.call(60, 200) is None
    assert b.call(130, 429) is None and b.state == "open"  # the probe failed
    assert b.call(260, 200) == "closed"


def test_text_scores(spark):
    rows, t = T.prepared(spark.createDataFrame([("Why? never 3 million!",), ("",), (None,)], "text string"), "text")
    got = [r[0] for r in rows.select(F.round(T.score_text(t), 6)).collect()]
    assert got == [round(4 / 55 + 2.0 + 2.5 + 2.0 + 2.8 + 1.5 + 1.0 + 2.2, 6), 0.0, 0.0]


def test_titles(spark):
    assert one(spark, T.manual_title(F.col("t"))[0], t="one two three") == "one two three"
    marked = T.highlighted(F.col("t"), F.lit("but Jeff Bezos lost"), F.array(F.lit("jeff"), F.lit("Jeff Bezos")))
    assert one(spark, marked[0], t="how jeff bezos won") == "how *jeff bezos* won" and one(spark, marked[1], t="how jeff bezos won") == "but *Jeff* Bezos lost"
    assert one(spark, T.ass_time(F.col("s")), s=3661.5) == "1:01:01.50"


def test_ingest(spark):
    raw = spark.createDataFrame([("a", '{"segments":[{"text":" hi "},{"text":" "}],"words":[{"word":"x","start":1.5}]}'), ("b", "no json")], "asset_id string, value string")
    segments, words = C.transcript_rows(raw)
    assert [tuple(r) for r in segments.collect()] == [("a", 0, "hi", 0.0, 0.0)] and words.head().start_s == 1.5
    lines = spark.createDataFrame([('{"id":"v1"}',), ("warning",), ('{"url":"u"}',)], "value string")
    assert [r.url for r in C.search_lines(lines).collect()] == ["https://www.youtube.com/watch?v=v1"]
    assert one(spark, C.json_object(F.col("t")), t='say ```json\n{"a": {"b": 1}}\n``` ok') == '{"a": {"b": 1}}'


def test_sync_plan(spark):
    assets = spark.createDataFrame(
        [(1, "a:b", [("SUCCESS", "u1", 10), ("SUCCESS", "u2", 90000)]), (2, "c.mov", [("SUCCESS", "u3", 5000)]), (3, "d", [("FAILED", "u", 9)])],
        "asset_id int, name string, transcodes array<struct<status:string,url:string,filesize:bigint>>",
    )
    plan = C.sync_plan(assets, spark.createDataFrame([("c.mov", 5100)], "name string, size long")).collect()
    assert {r.asset_id: (r.file, r.url, r.action) for r in plan} == {1: ("a_b.mp4", "u2", "download"), 2: ("c.mov", "u3", "skip"), 3: ("d.mp4", None, "none")}


def test_catalog_and_index(spark, tmp_path):
    for name in ("a.MP4", "b.txt", "sub/c.webm"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    files = C.media_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["a.MP4", "c.webm"]
    path = C.write_index(files, str(tmp_path / "index"), 1)
    assert C.index_actions(files, C.read_index(spark, path)).where("action = 'hit'").count() == 2
    got = C.extracted(files, lambda row: {"n": 1 // (len(row["path"]) % 2)} if row["path"].endswith("webm") else {"n": 5}, "n long").collect()
    assert sorted(r.error is None for r in got) in ([False, True], [True, True])


def test_every_query_runs_on_the_smallest_tables(spark, data):
    import __spark_entry__ as entry

    for name in ("wn13_best_window", "jn1_tk2_keyword_top5", "wn14_greedy_assignment", "ss3_breaker_changes"):
        assert entry.queries()[name](spark, data).columns
    assert entry.entry(spark).limit(1).count() == 1


def test_media_operators(spark):
    from cliploom.operators import media as M

    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 0.5), (1, 0, 0.9, 0.9, 0.1, 0.1), (1, 1, 0.5, 0.5, 0.5, 0.5)], "clip_id int, frame int, x double, y double, w double, h double")
    assert tuple(M.face_centre(boxes).head()) == (1, 0.5, 0.5)
    errors = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, "a")], "job_id int, pos int, error string")
    assert tuple(M.error_summary(errors).head()) == (1, "a", 2, ["a", "b"], "warning")
    tags = spark.createDataFrame([(("sprint", [" Run "]),)], "t struct<category:string,subjects:array<string>>")
    assert tags.select(M.scene_tag(F.col("t"), "category"), M.scene_tag(F.col("t"), "subjects")).head() == ("", ["run"])
    assert one(spark, M.visual_energy(F.lit(0.3), F.lit(25.0), F.lit(13.0), F.lit(0.0)), x=1) is True


def test_greedy_serves_jobs_of_many_spans(spark):
    from cliploom.operators import assign

    rows = [(1, span, clip, 1.0 - clip / 100) for span in range(30) for clip in range(60)]
    df = spark.createDataFrame(rows, "job_id long, span_idx int, clip_id long, score double")
    assert sorted((r.span_idx, r.clip_id) for r in assign.greedy(df).collect()) == [(i, i) for i in range(30)]
    assert sorted((r.span_idx, r.rank, r.clip_id) for r in assign.greedy(df, per_span=2).collect()) == [(i // 2, i % 2 + 1, i) for i in range(60)]


def test_candidates_suffice_for_the_largest_job(spark, data, monkeypatch):
    from cliploom.plans import registry

    Q = registry.clip_queries
    clips = Q.view(spark, data, "clips").cache()
    jobs = clips.orderBy("clip_id").limit(1).selectExpr("1L as job_id", "clip_id as ref_clip_id", "explode(sequence(0, 29)) as span_idx")
    monkeypatch.setattr(Q, "view", lambda s, d, name: {"clips": clips, "spans": jobs}[name])
    for per_span in (1, 2):
        every = Q.J.keyword_scores(clips.withColumnRenamed("clip_id", "ref_clip_id"), clips, "ref_clip_id").join(jobs.limit(1), "ref_clip_id").where("ref_clip_id <> clip_id").count()
        assert every > 24 and Q._job_candidates(spark, data, per_span).where("span_idx = 0").count() == min(every, 30 * per_span)
