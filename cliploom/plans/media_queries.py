"""Queries over frames, levels, job events and call logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom import schema as S
from cliploom.functions.features import gradient_bits
from cliploom.operators import jobs as K
from cliploom.operators import search as R
from cliploom.operators import spans as P
from cliploom.operators import transcripts as T
from cliploom.operators.aggregates import stage_averages
from cliploom.plans.registration import query
from cliploom.plans.views import duck, view

_CUT = duck("frames") + """, c AS (SELECT video_id, frame_idx, has_face, visual, coalesce(list_distance(feat::double[], (lag(feat) OVER (PARTITION BY video_id ORDER BY frame_idx))::double[]) >= 0.85, false) AS is_cut FROM frames)"""


@query(_CUT + " SELECT video_id, frame_idx FROM c WHERE is_cut")
def wn1_hard_cuts(spark, sf_dir):
    return P.shot_cuts(view(spark, sf_dir, "frames")).where("is_cut").select("video_id", "frame_idx")


@query()
def wn2_primary_shot(spark, sf_dir):
    return P.primary_flags(view(spark, sf_dir, "frames"))


@query()
def wn2_wn3_shot_spans(spark, sf_dir):
    frames = view(spark, sf_dir, "frames")
    flags = P.shot_cuts(frames).join(P.primary_flags(frames).withColumnRenamed("is_primary", "primary"), ["video_id", "frame_idx"])
    return P.segment_spans(flags).select("video_id", "n", "start_s", "end_s")


@query(_CUT + """, g AS (SELECT *, sum(is_cut::int) OVER (PARTITION BY video_id ORDER BY frame_idx) AS seg FROM c), s AS (SELECT video_id, seg, avg(has_face::int) AS p, avg(visual::int) AS v, min(frame_idx) AS a, max(frame_idx) + 1 AS b FROM g GROUP BY 1, 2),
 k AS (SELECT video_id, a / 10.0 AS start_s, b / 10.0 AS end_s FROM s WHERE p <= 0.45 AND v >= 0.5) SELECT video_id, n, start_s, end_s FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS n FROM k WHERE end_s - start_s >= 0.08) WHERE n <= 24""")
def wn3_face_segments(spark, sf_dir):
    flags = P.shot_cuts(view(spark, sf_dir, "frames")).withColumn("primary", F.col("has_face"))
    return P.segment_spans(flags).select("video_id", "n", "start_s", "end_s")


@query(duck("frames") + """, f AS (SELECT video_id, frame_idx, visual OR (coalesce(lag(visual) OVER w, false) AND coalesce(lead(visual) OVER w, false)) AS ok FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
 i AS (SELECT video_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM f WHERE ok), s AS (SELECT video_id, min(frame_idx) / 10.0 AS start_s, (max(frame_idx) + 1) / 10.0 AS end_s FROM i GROUP BY video_id, g)
 SELECT video_id, n, start_s, end_s FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS n FROM s WHERE end_s - start_s >= 0.08) WHERE n <= 24""")
def wn4_wn5_visual_runs(spark, sf_dir):
    return P.flag_spans(view(spark, sf_dir, "frames"), "visual").select("video_id", "n", "start_s", "end_s")


@query(duck("levels") + """, i AS (SELECT asset_id, sec, sec - row_number() OVER (PARTITION BY asset_id ORDER BY sec) AS g FROM levels WHERE level > 0.3), r AS (SELECT asset_id, min(sec) AS run_start, count(*) AS run_length FROM i GROUP BY asset_id, g)
 SELECT asset_id, run_start, run_length FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY run_length DESC, run_start) AS r FROM r) WHERE r = 1""")
def wn6_longest_loud_run(spark, sf_dir):
    return P.longest_run(view(spark, sf_dir, "levels"), "asset_id", "sec", F.col("level") > 0.3)


@query(duck("frames") + """, l AS (SELECT video_id, feat, lag(feat) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM frames) SELECT video_id, round(avg(list_sum([abs(feat[i]::double - p[i]::double) for i in range(1, len(feat) + 1)]) / len(feat)) FILTER (p IS NOT NULL), 6) AS motion FROM l GROUP BY 1""")
def ag11_motion(spark, sf_dir):
    return P.motion(view(spark, sf_dir, "frames"))


@query(_CUT + """, g AS MATERIALIZED (SELECT video_id, frame_idx, has_face, sum(is_cut::int) OVER (PARTITION BY video_id ORDER BY frame_idx) AS seg FROM c), s AS (SELECT video_id, seg, min(frame_idx) AS a, max(frame_idx) + 1 AS b FROM g GROUP BY 1, 2),
 x AS (SELECT DISTINCT video_id, seg, unnest([floor(a + (b - a) * 0.25), floor(a + (b - a) * 0.5), floor(a + (b - a) * 0.75)])::int AS frame_idx FROM s) SELECT x.video_id, x.seg, x.frame_idx, c.has_face FROM x JOIN g AS c ON c.video_id = x.video_id AND c.frame_idx = x.frame_idx""")
def jn16_sampled_frames(spark, sf_dir):
    frames = view(spark, sf_dir, "frames")
    segs = P.shot_cuts(frames).withColumn("seg", F.sum(F.col("is_cut").cast("int")).over(P.W.partitionBy("video_id").orderBy("frame_idx")))
    spans = segs.groupBy("video_id", "seg").agg((F.min("frame_idx") / 10.0).alias("start_s"), ((F.max("frame_idx") + 1) / 10.0).alias("end_s"))
    return P.sampled_frames(spans, frames).select("video_id", "seg", "frame_idx", "has_face")


def _hashed(spark, sf_dir):
    """64 sign bits of each embedding's neighbouring numbers, as a frame hash."""
    size = F.greatest(F.size("embedding"), F.lit(1))
    grey = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor(F.get("embedding", (i % size).cast("int")) * 1000).cast("int"))
    # Behind a generator: else the numbers are worked out again for each of the bits.
    vectors = view(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.array(grey)).alias("grey"))
    return vectors.select("vec_id", "label", gradient_bits("grey").alias("hash"))


#: 64-bit signed hashes in SQL: bit i is set where grey value i is above its right neighbour in a grid of nine columns.
_HASHED = """e AS (SELECT vec_id, label, [floor(embedding[(i % len(embedding)) + 1]::double * 1000)::int for i in range(0, 72)] AS grey FROM embeddings),
 u AS (SELECT vec_id, label, list_sum([CASE WHEN grey[(i // 8) * 9 + i % 8 + 1] > grey[(i // 8) * 9 + i % 8 + 2] THEN 1::hugeint << i ELSE 0::hugeint END for i in range(0, 64)])::hugeint AS big FROM e),
 h AS (SELECT vec_id, label, (CASE WHEN big >= 9223372036854775808::hugeint THEN big - 18446744073709551616::hugeint ELSE big END)::bigint AS hash FROM u)"""


@query("WITH " + _HASHED + " SELECT vec_id, label, hash FROM h")
def pr32_gradient_hash(spark, sf_dir):
    return _hashed(spark, sf_dir)


@query("WITH " + _HASHED + """, r AS (SELECT vec_id, xor(xor(hash, 1::bigint << (vec_id % 61)::int), CASE WHEN vec_id % 3 = 0 THEN 4095::bigint << (vec_id % 40)::int ELSE 5::bigint END) AS hash FROM h)
 SELECT a.vec_id AS a_id, b.vec_id AS b_id, bit_count(xor(a.hash, b.hash))::int AS distance FROM h a JOIN r b ON bit_count(xor(a.hash, b.hash)) <= 8""")
def jn11_near_frames(spark, sf_dir):
    """Frames against copies of them with a few bits flipped, in a third of them more than may differ."""
    rows = _hashed(spark, sf_dir)
    flipped = F.expr("hash ^ shiftleft(1L, cast(vec_id % 61 as int)) ^ case when vec_id % 3 = 0 then shiftleft(4095L, cast(vec_id % 40 as int)) else 5L end")
    left = rows.select(F.col("vec_id").alias("a_id"), F.col("hash").alias("a_hash"))
    right = rows.select(F.col("vec_id").alias("b_id"), flipped.alias("b_hash"))
    return R.near_frames(left, right).select("a_id", "b_id", "distance")


def _corr(a: str, b: str) -> str:
    """Pearson correlation of two lists in SQL; 1 where one is flat."""
    n, x, y = f"len({a})", f"{a}::double[]", f"{b}::double[]"
    spread = f"((list_dot_product({x}, {x}) - list_sum({x}) * list_sum({x}) / {n}) * (list_dot_product({y}, {y}) - list_sum({y}) * list_sum({y}) / {n}))"
    return f"(CASE WHEN {spread} > 2.220446049250313e-16 THEN (list_dot_product({x}, {y}) - list_sum({x}) * list_sum({y}) / {n}) / sqrt({spread}) ELSE 1.0 END)"


@query("WITH " + _HASHED + f""", p AS (SELECT l.label AS ref, r.label AS candidate, l.vec_id AS frame, bit_count(xor(l.hash, r.hash)) AS d, {_corr('le.embedding', 're.embedding')} AS hist
   FROM h l JOIN h r ON l.vec_id % 50 = 0 AND r.label <> l.label JOIN embeddings le ON le.vec_id = l.vec_id JOIN embeddings re ON re.vec_id = r.vec_id),
 b AS (SELECT ref, candidate, frame, max(least(1.0, greatest(greatest(0.0, 1.0 - d / 32.0), 0.6 * greatest(0.0, 1.0 - d / 32.0) + 0.4 * greatest(0.0, hist)))) AS best, sum((d <= 8)::int) AS exact FROM p GROUP BY 1, 2, 3),
 m AS (SELECT ref, candidate, avg(best) AS score, sum(exact) AS exact, count(*) AS frames FROM b GROUP BY 1, 2)
 SELECT ref, candidate, round(CASE WHEN exact >= greatest(1, frames // 2) THEN greatest(score, 0.92) ELSE score END, 6) AS score, exact, CASE WHEN exact >= greatest(1, frames // 2) THEN 'exact_frame' WHEN score >= 0.72 THEN 'same_setup' ELSE 'rejected' END AS verdict FROM m""")
def jn12_frame_set_scores(spark, sf_dir):
    """Frames of the stated references against all others; the numbers of a vector stand for its histogram bins."""
    rows = _hashed(spark, sf_dir).join(view(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id")
    left = rows.where("vec_id % 50 = 0").select(F.col("label").alias("ref"), F.col("vec_id").alias("frame"), F.col("hash").alias("a"), F.col("v").alias("av"))
    small = left.count() <= 100_000
    right = rows.select(F.col("label").alias("candidate"), F.col("hash").alias("b"), F.col("v").alias("bv")).repartition(2 * spark.sparkContext.defaultParallelism)
    pairs = right.join(F.broadcast(left) if small else left, F.col("candidate") != F.col("ref"))
    histogram = R.correlation("av", "bv")
    distance = R.hamming("a", "b")
    scored = pairs.select("ref", "candidate", "frame", R.frame_score(distance, histogram).alias("score"), (distance <= 8).cast("int").alias("exact"))
    return R.frame_set_scores(scored)


#: Sources of some twenty frames, a frame a second, out of the embeddings; every other second shows the source's first
#: frame again.  References are excerpts of that recurring shot with two bits of the hash changed.
_SOURCES = _HASHED + """, g AS (SELECT h.label::bigint * 1000000 + h.vec_id // 200 AS source, h.vec_id, row_number() OVER (PARTITION BY h.label, h.vec_id // 200 ORDER BY h.vec_id) - 1 AS second, h.hash, e.embedding AS bins FROM h JOIN embeddings e ON e.vec_id = h.vec_id),
 f AS (SELECT g.source, g.second, CASE WHEN g.second % 2 = 0 THEN z.hash ELSE g.hash END AS hash, CASE WHEN g.second % 2 = 0 THEN z.bins ELSE g.bins END AS bins FROM g JOIN g z ON z.source = g.source AND z.second = 0),
 s AS (SELECT source, count(*)::double AS duration FROM f GROUP BY 1), x AS (SELECT source, -1 - source AS ref, duration * 0.5 AS target FROM s WHERE source % 50 = 0),
 k AS (SELECT x.ref, i AS frame, xor(f.hash, 5::bigint) AS hash, f.bins FROM (SELECT *, unnest(range(0, 5)) AS i FROM x) x JOIN f ON f.source = x.source AND f.second = 2 * floor(greatest(0.1, target) * (i + 0.5) / 5 / 2)::int)"""


def _passed(probes: str, keys: str) -> str:
    """Scores of probes (ref, source, second, ...) against the key frames of their reference."""
    return f"""SELECT {keys}, round(CASE WHEN sum(exact) >= greatest(1, count(*) // 2) THEN greatest(avg(v), 0.92) ELSE avg(v) END, 6) AS score FROM (
  SELECT p.*, (d <= 8)::int AS exact, least(1.0, greatest(greatest(0.0, 1.0 - d / 32.0), 0.6 * greatest(0.0, 1.0 - d / 32.0) + 0.4 * greatest(0.0, c))) AS v FROM (
  SELECT {', '.join('p.' + k.strip() for k in keys.split(','))}, bit_count(xor(f.hash, k.hash)) AS d, {_corr('k.bins', 'f.bins')} AS c FROM {probes} p JOIN f ON f.source = p.source AND f.second = p.second JOIN k ON k.ref = p.ref) p) GROUP BY {keys}"""


@query("WITH " + _SOURCES + f""", l AS (SELECT x.ref, s.source, x.target, s.duration FROM x JOIN s ON s.duration >= 0.8 * x.target),
 o AS (SELECT *, floor(greatest(0.0, least(duration - 0.1, duration * 0.2)))::int AS second FROM l), a AS ({_passed('o', 'ref, source')}), w AS (SELECT ref, source FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, source) AS r FROM a) WHERE r <= 3),
 c AS (SELECT l.*, unnest(CASE WHEN duration <= target OR greatest(0.5, target / 2) > duration - greatest(0.5, target / 2) THEN [duration / 2] ELSE [greatest(0.5, target / 2) + i * greatest(2.0, target / 2) for i in range(0, 12) if greatest(0.5, target / 2) + i * greatest(2.0, target / 2) <= duration - greatest(0.5, target / 2) + 1e-9] END) AS centre FROM l JOIN w ON w.ref = l.ref AND w.source = l.source),
 q AS (SELECT *, floor(centre)::int AS second FROM c), b AS ({_passed('q', 'ref, source, target, duration, centre')})
 SELECT ref, source, greatest(0.0, centre - target / 2) AS start_s, least(duration, greatest(0.0, centre - target / 2) + target) AS end_s, score FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, source, centre) AS r FROM b) WHERE r = 1 AND score >= 0.65""")
def jn13_two_pass_sources(spark, sf_dir):
    """Excerpts of the stated sources (id divisible by 50) among all sources; the second pass reads the winners' frames only."""
    rows = _hashed(spark, sf_dir).join(view(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("bins")), "vec_id")
    rows = rows.withColumn("source", F.col("label").cast("long") * 1_000_000 + F.floor(F.col("vec_id") / 200))
    order = P.W.partitionBy("source").orderBy("vec_id")
    second = F.row_number().over(order) - 1
    held = lambda c: F.when(F.col("second") % 2 == 0, F.first(c).over(order)).otherwise(F.col(c)).alias(c)
    frames = rows.withColumn("second", second).select("source", "second", held("hash"), held("bins"))
    sources = frames.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("duration"))
    excerpts = sources.where("source % 50 = 0").select("source", (-1 - F.col("source")).alias("ref"), (F.col("duration") * 0.5).alias("duration"))
    times = excerpts.select("source", "ref", F.posexplode(R.key_times(F.lit(0.0), F.col("duration"))).alias("frame", "at"))
    shown = times.withColumn("second", (2 * F.floor(F.col("at") / 2)).cast("int")).join(frames, ["source", "second"])
    keyframes = shown.select("ref", "frame", F.col("hash").bitwiseXOR(F.lit(5).cast("long")).alias("hash"), "bins")
    refs = excerpts.select("ref", "duration")
    return R.found_sources(refs, keyframes, sources, frames, F.get(R.sample_times(F.col("duration")), F.lit(0)))


@query(duck("levels") + """, r AS (SELECT asset_id, sec - 10 AS i, level AS r FROM levels WHERE sec BETWEEN 10 AND 19), k AS (SELECT asset_id, count(*) AS k FROM r GROUP BY 1),
 d AS (SELECT l.asset_id, l.sec - r.i AS off, round(sum(l.level * r.r), 4) AS dot, count(*) AS n FROM levels l JOIN r ON r.asset_id = l.asset_id AND l.sec >= r.i GROUP BY 1, 2),
 e AS (SELECT d.asset_id, off, dot, avg(dot) OVER (PARTITION BY d.asset_id) AS mean, row_number() OVER (PARTITION BY d.asset_id ORDER BY dot DESC, off) AS p FROM d JOIN k ON k.asset_id = d.asset_id AND d.n = k.k)
 SELECT e.asset_id, off AS "offset", least(off + k.k, (SELECT max(sec) + 1 FROM levels l WHERE l.asset_id = e.asset_id)) AS end_s, dot, NOT (dot < 1.5 * mean AND dot < 50) AS accepted FROM e JOIN k ON k.asset_id = e.asset_id WHERE p = 1""")
def jn14_profile_alignment(spark, sf_dir):
    return T.profile_alignment(view(spark, sf_dir, "levels"))


_STUCK = ", ".join(f"('{k}', {max(v, S.STUCK_SECONDS)})" for k, v in S.STAGE_LIMITS.items())
_LAST = duck("job_events") + ", l AS (SELECT job_id, arg_max(stage, (ts, event_id)) AS stage, max(ts) AS ts FROM job_events GROUP BY 1), now AS (SELECT max(ts) AS now FROM job_events)"


@query(_LAST + f", m(stage, limit_s) AS (VALUES {_STUCK}) SELECT job_id, l.stage, round(epoch_us(now) / 1e6 - epoch_us(ts) / 1e6, 3) AS idle_s FROM l CROSS JOIN now LEFT JOIN m ON m.stage = l.stage WHERE l.stage <> 'failed' AND epoch_us(now) / 1e6 - epoch_us(ts) / 1e6 > coalesce(limit_s, 900.0)")
def ss1_stuck_jobs(spark, sf_dir):
    events = view(spark, sf_dir, "job_events")
    return K.stuck_jobs(events, _now(events))


def _now(events):
    return F.lit(events.agg(F.max("ts").alias("now")).head()["now"])


@query(_LAST + " SELECT job_id, stage, ts FROM l CROSS JOIN now WHERE stage <> 'failed' AND epoch_us(now) - epoch_us(ts) <= 86400 * 1000000::bigint")
def fl9_resumable_jobs(spark, sf_dir):
    events = view(spark, sf_dir, "job_events")
    return K.resumable_jobs(events, _now(events)).select("job_id", "stage", "ts")


_ETA_CASE = lambda i, name, sec: f"(CASE WHEN p < {i} THEN {sec} * f{' * greatest(1.0, v)' if name == 'rendering' else ''} WHEN p = {i} THEN greatest(0.0, {sec} * f{' * greatest(1.0, v)' if name == 'rendering' else ''} - e) ELSE 0 END)" if name != "broll_recovery" else f"(CASE WHEN p < {i} THEN least(45.0, {sec} * f) WHEN p = {i} THEN greatest(0.0, least(45.0, {sec} * f) - e) ELSE 0 END)"


@query(_LAST + f""", o(stage, p) AS (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(S.STAGE_SECONDS))}), j AS (SELECT job_id, l.stage, coalesce(p, -1) AS p, greatest(0.5, least(2.0, (job_id % 60) / 20.0)) AS f, (job_id % 4)::double AS v, (job_id % 9)::double AS e FROM l LEFT JOIN o ON o.stage = l.stage)
 SELECT job_id, stage, round(CASE WHEN p < 0 THEN 0.0 ELSE greatest(1.0, {' + '.join(_ETA_CASE(i, n, x) for i, (n, x) in enumerate(S.STAGE_SECONDS.items()))}) END, 6) AS eta_s FROM j""")
def ss2_remaining_time(spark, sf_dir):
    last = view(spark, sf_dir, "job_events").groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"))
    jobs = last.select("job_id", "stage", (F.col("job_id") % 60).cast("double").alias("clip_s"), (F.col("job_id") % 4).alias("variations"), (F.col("job_id") % 9).cast("double").alias("elapsed"))
    return K.remaining_time(jobs).withColumn("eta_s", F.round("eta_s", 6))


#: The breaker as a fold: (event, time, state, 429s in a row, time of the first, time of the last change, changes so far).
_BREAKER = """list_reduce(list_prepend({'event_id': 0::bigint, 'at': 0.0::double, 'status': 0, 'state': 'closed', 'n': 0, 'first': 0.0::double, 'since': 0.0::double, 'out': ''}, list({'event_id': event_id, 'at': epoch_us(ts) / 1e6, 'status': status, 'state': '', 'n': 0, 'first': 0.0::double, 'since': 0.0::double, 'out': ''} ORDER BY ts, event_id)),
  lambda a, x: CASE WHEN a.state = 'open' AND x.at < a.since + 120.0 THEN a
   WHEN x.status <> 429 THEN {'event_id': x.event_id, 'at': x.at, 'status': x.status, 'state': 'closed', 'n': 0, 'first': a.first, 'since': CASE WHEN a.state = 'open' OR (a.state = 'probe' AND x.at >= a.since + 180.0) THEN x.at ELSE a.since END, 'out': a.out || CASE WHEN a.state <> 'closed' THEN ',' || x.event_id || ':closed' ELSE '' END}
   WHEN a.state IN ('open', 'probe') THEN {'event_id': x.event_id, 'at': x.at, 'status': x.status, 'state': 'open', 'n': 0, 'first': a.first, 'since': x.at, 'out': a.out || CASE WHEN a.state = 'probe' THEN ',' || x.event_id || ':open' ELSE '' END}
   WHEN a.n > 0 AND x.at - a.first <= 60.0 AND a.n + 1 >= 5 THEN {'event_id': x.event_id, 'at': x.at, 'status': x.status, 'state': 'open', 'n': 0, 'first': a.first, 'since': x.at, 'out': a.out || ',' || x.event_id || ':open'}
   WHEN a.n > 0 AND x.at - a.first <= 60.0 THEN {'event_id': x.event_id, 'at': x.at, 'status': x.status, 'state': 'closed', 'n': a.n + 1, 'first': a.first, 'since': a.since, 'out': a.out}
   ELSE {'event_id': x.event_id, 'at': x.at, 'status': x.status, 'state': 'closed', 'n': 1, 'first': x.at, 'since': a.since, 'out': a.out} END).out"""


@query(duck("calls") + f""", o AS (SELECT provider, {_BREAKER} AS out FROM calls GROUP BY 1), e AS (SELECT provider, unnest([x for x in string_split(out, ',') if x <> '']) AS c FROM o),
 k AS (SELECT provider, split_part(c, ':', 1)::bigint AS event_id, split_part(c, ':', 2) AS state FROM e) SELECT k.provider, round(epoch_us(ts) / 1e6, 3) AS at, k.event_id, state FROM k JOIN calls ON calls.provider = k.provider AND calls.event_id = k.event_id""")
def ss3_breaker_changes(spark, sf_dir):
    return K.breaker_changes(view(spark, sf_dir, "calls")).withColumn("at", F.round("at", 3))


@query(duck("calls") + ", b AS (SELECT provider, event_id, ts, status, max(CASE WHEN status IN (401, 402, 429) THEN epoch_us(ts) / 1e6 END) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM calls) SELECT provider, event_id, coalesce(epoch_us(ts) / 1e6 < bad + 300, false) AS cooling FROM b")
def ss4_cool_downs(spark, sf_dir):
    return K.cool_downs(view(spark, sf_dir, "calls"), 300.0).select("provider", "event_id", "cooling")


@query(duck("job_events") + """, d AS (SELECT job_id, event_id, stage, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS s FROM job_events) SELECT job_id, event_id, stage, round(s, 3) AS seconds FROM d WHERE s IS NOT NULL""")
def ss7_stage_durations(spark, sf_dir):
    order = P.W.partitionBy("job_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = view(spark, sf_dir, "job_events").withColumn("seconds", F.round(us(F.lead("ts").over(order)) / 1e6 - us(F.col("ts")) / 1e6, 3))
    return rows.where("seconds is not null").select("job_id", "event_id", "stage", "seconds")


@query(duck("job_events") + """, d AS (SELECT job_id, event_id, ts, stage, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS s FROM job_events)
 SELECT job_id, stage, round(list_reduce(list(s ORDER BY ts, event_id), lambda a, x: 0.7 * a + 0.3 * x), 3) AS seconds FROM d WHERE s IS NOT NULL GROUP BY 1, 2""")
def ag16_stage_averages(spark, sf_dir):
    return stage_averages(view(spark, sf_dir, "job_events"))


@query(duck("calls") + """, o AS (SELECT provider, event_id, row_number() OVER (PARTITION BY provider ORDER BY ts, event_id) AS pos, status = 200 AS ok FROM calls), g AS (SELECT *, sum(ok::int) OVER (PARTITION BY provider ORDER BY pos) AS g FROM o),
 s AS (SELECT *, sum((NOT ok)::int) OVER (PARTITION BY provider, g ORDER BY pos) >= 4 AS hit FROM g) SELECT provider, event_id, coalesce(max(hit::int) OVER (PARTITION BY provider ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seeded FROM s""")
def wn22_failure_cutoff(spark, sf_dir):
    order = P.W.partitionBy("run_id").orderBy("ts", "event_id")
    calls = view(spark, sf_dir, "calls").withColumnRenamed("provider", "run_id")
    log = calls.select("run_id", "event_id", F.row_number().over(order).alias("pos"), (F.col("status") == 200).alias("ok"))
    return K.failure_cutoff(log).select(F.col("run_id").alias("provider"), "event_id", "seeded")


@query(duck("clips") + """, k AS (SELECT path, mtime, array_to_string(subjects, ' ') AS name_key FROM clips), r AS (SELECT *, row_number() OVER (ORDER BY mtime DESC, path) - 1 AS pos0, row_number() OVER (PARTITION BY name_key ORDER BY mtime DESC, path) AS first FROM k)
 SELECT path, mtime, name_key FROM r WHERE pos0 < 30 // 2 OR first = 1 ORDER BY pos0 LIMIT 30""")
def wn21_diverse_newest(spark, sf_dir):
    files = view(spark, sf_dir, "clips").select("path", "mtime", F.array_join("subjects", " ").alias("name_key"))
    return R.diverse_newest(files, 30)
