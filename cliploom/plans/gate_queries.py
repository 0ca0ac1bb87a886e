"""Queries over gates, caches, packs and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.functions import text as X
from cliploom.functions import titles as T
from cliploom.operators import aggregates as A
from cliploom.operators import scoring as J
from cliploom.operators import search as R
from cliploom.plans.clip_queries import _BASE_SQL
from cliploom.plans.registration import query
from cliploom.plans.views import duck, view


@query(duck("search_rows") + " SELECT query_id, pos, id, duration FROM search_rows WHERE duration >= 0.8 * (query_id + 1) * 40.0")
def fl3_long_candidates(spark, sf_dir):
    rows = view(spark, sf_dir, "search_rows")
    references = rows.select("query_id", ((F.col("query_id") + 1) * 40.0).alias("reference_s")).distinct()
    return R.long_enough(rows, references, "query_id").select("query_id", "pos", "id", "duration")


@query(duck("search_rows") + """, w AS (SELECT pos, string_split(title || ' ' || lower(title), ' ') AS l FROM search_rows), e AS (SELECT pos, unnest(range(0, len(l))) AS i, trim(unnest(l)) AS v FROM w),
 f AS (SELECT pos, lower(v) AS k, min(i) AS i, min_by(v, i) AS v FROM e WHERE v <> '' GROUP BY 1, 2) SELECT pos, string_agg(v, '|' ORDER BY i) AS words FROM f GROUP BY 1""")
def so3_unique_words(spark, sf_dir):
    words = F.split(F.concat("title", F.lit(" "), F.lower("title")), " ")
    rows = view(spark, sf_dir, "search_rows").select("pos", X.unique_strings(words).alias("l"))
    return rows.where(F.size("l") > 0).select("pos", F.array_join("l", "|").alias("words"))


@query(duck("spans") + """, j AS (SELECT DISTINCT job_id, ['frameio', 'youtube', 'both'][job_id % 3 + 1] AS mode FROM spans), s(source, kind, rung) AS (VALUES ('share', 'share', 0), ('second share', 'share', 1), ('search', 'search', 2))
 SELECT job_id, source, rung FROM j JOIN s ON (mode <> 'youtube' AND kind = 'share') OR (mode <> 'frameio' AND kind = 'search')""")
def fl10_source_gating(spark, sf_dir):
    modes = F.array(*map(F.lit, ("frameio", "youtube", "both")))
    jobs = view(spark, sf_dir, "spans").select("job_id").distinct().withColumn("mode", F.get(modes, (F.col("job_id") % 3).cast("int")))
    sources = spark.createDataFrame([("share", "share", 0), ("second share", "share", 1), ("search", "search", 2)], "source string, kind string, rung int")
    return R.gated(jobs, sources)


@query(duck("clips") + ", " + _BASE_SQL + """, t AS (SELECT ref_id, clip_id, row_number() OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS rank FROM base WHERE ref_id % 50 = 0),
 l AS (SELECT t.ref_id, list(c.path ORDER BY rank) AS paths, any_value(r.subjects[1]) AS query FROM t JOIN clips c ON c.clip_id = t.clip_id JOIN clips r ON r.clip_id = t.ref_id WHERE rank <= 3 GROUP BY 1),
 d AS (SELECT *, sha1(query || '|' || array_to_string(list_sort(paths), '|') || '|m1') AS digest, ref_id // 50 % 6 AS v FROM l), c AS (SELECT digest, max(v) AS v FROM d GROUP BY 1)
 SELECT ref_id, CASE WHEN c.v BETWEEN 1 AND 3 THEN paths[c.v] END AS pick, CASE WHEN c.v = 0 THEN 'ask' WHEN c.v <= 3 THEN 'picked' ELSE 'none' END AS outcome FROM d JOIN c USING (digest)""")
def jn15_pick_cache(spark, sf_dir):
    """Stored picks of a sixth each: not stored, positions 0 to 2, beyond the list, and none."""
    clips = view(spark, sf_dir, "clips")
    refs = clips.where("clip_id % 50 = 0").withColumnRenamed("clip_id", "ref_id")
    best = J.best_matches(refs, clips, 3).join(clips.select("clip_id", "path"), "clip_id")
    paths = best.groupBy("ref_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    asked = paths.join(refs.select("ref_id", F.get("subjects", F.lit(0)).alias("query")), "ref_id")
    stored = asked.select(R.digest("query", "paths", "m1").alias("digest"), F.floor(F.col("ref_id") / 50 % 6).alias("v")).groupBy("digest").agg(F.max("v").alias("v"))
    value = F.when(F.col("v") == 5, "").when(F.col("v") == 4, "9").otherwise((F.col("v") - 1).cast("string"))
    return R.cached_picks(asked, stored.where("v > 0").select("digest", value.alias("value")), "m1").select("ref_id", "pick", "outcome")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'pattern' WHEN 3 THEN 'fixed' ELSE CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN 'generated' ELSE 'fixed' END END AS route FROM documents")
def pr33_title_routes(spark, sf_dir):
    modes = F.array(*map(F.lit, ("manual", "replicate", "auto", "auto")))
    docs = view(spark, sf_dir, "documents").withColumn("mode", F.get(modes, (F.col("doc_id") % 4).cast("int")))
    text = F.when(F.col("doc_id") % 4 == 3, "").otherwise(F.col("text"))
    return docs.select("doc_id", T.route(F.col("mode"), F.col("lang"), text).alias("route"))


@query(duck("clips", "spans") + """, n AS (SELECT job_id, max(span_idx) + 1 AS frames FROM spans GROUP BY 1), a AS (SELECT job_id, [x for x in [floor(frames * 0.8 * 0.33)::int, floor(frames * 0.8 * 0.66)::int] if x < frames] AS l FROM n),
 w AS (SELECT job_id, unnest(range(0, len(l))) AS place, unnest(l) AS span_idx FROM a), t AS (SELECT w.job_id, place, c.subjects, c.setting, c.category FROM w JOIN spans s ON s.job_id = w.job_id AND s.span_idx = w.span_idx JOIN clips c ON c.clip_id = s.ref_clip_id),
 u AS (SELECT job_id, v, min(place * 100 + i) AS f FROM (SELECT job_id, place, unnest(range(0, len(subjects))) AS i, unnest(subjects) AS v FROM t) WHERE v <> '' GROUP BY 1, 2), su AS (SELECT job_id, string_agg(v, '|' ORDER BY f) AS subjects FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY f) AS r FROM u) WHERE r <= 4 GROUP BY 1)
 SELECT su.job_id, su.subjects, g.category FROM su JOIN (SELECT job_id, category, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, min(place)) AS r FROM t GROUP BY 1, 2) g ON g.job_id = su.job_id AND g.r = 1""")
def ag19_hook_descriptions(spark, sf_dir):
    clips = view(spark, sf_dir, "clips").withColumnRenamed("clip_id", "ref_clip_id")
    frames = view(spark, sf_dir, "spans").join(clips, "ref_clip_id").select("job_id", F.col("span_idx").alias("frame_idx"), "subjects", "setting", "category")
    hooks = frames.groupBy("job_id").agg((F.max("frame_idx") + 1).alias("frames")).withColumn("length_s", F.col("frames") * 0.08)
    return A.hook_description(frames, hooks, "job_id").select("job_id", F.array_join("subjects", "|").alias("subjects"), "category")


@query(duck("spans") + " SELECT job_id, to_json({'job_id': job_id, 'items': list({'span_idx': span_idx, 'ref_clip_id': ref_clip_id} ORDER BY span_idx)})::varchar AS pack FROM spans GROUP BY 1")
def io11_result_packs(spark, sf_dir):
    from cliploom.sources.catalog import result_packs

    return result_packs(view(spark, sf_dir, "spans").select("job_id", "span_idx", "ref_clip_id"), "job_id", "span_idx")


@query(duck("clips") + """, v AS (SELECT clip_id, list_concat([(shot_type = x)::int::double for x in ['wide', 'medium', 'close-up', 'extreme-close-up', 'aerial', 'overhead', 'two-shot']], list_concat([(camera_motion = x)::int::double for x in ['static', 'pan', 'tilt', 'dolly', 'handheld', 'tracking', 'zoom']], list_concat([(depth_of_field = 'deep')::int::double, (depth_of_field = 'shallow')::int::double],
  [len([m for m in mood if m IN ('energetic', 'aggressive', 'epic', 'dramatic', 'tense')]) / 2.0, len([m for m in mood if m IN ('calm', 'melancholic', 'romantic', 'nostalgic', 'neutral')]) / 2.0, len([m for m in mood if m IN ('joyful', 'uplifting', 'playful')]) / 2.0]))) AS l FROM clips),
 s AS (SELECT a.clip_id AS ref_id, b.clip_id, round(list_dot_product(a.l, b.l) / (sqrt(list_dot_product(a.l, a.l)) * sqrt(list_dot_product(b.l, b.l))), 6) AS similarity FROM v a JOIN v b ON a.clip_id % 50 = 0 AND a.clip_id <> b.clip_id AND a.l <> b.l)
 SELECT ref_id, clip_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY similarity DESC, clip_id) AS rank FROM s) WHERE rank <= 3""")
def ag13_ag14_near_styles(spark, sf_dir):
    """The clips most alike in style, but not equal, by all 19 numbers; only distinct vectors are compared."""
    clips = view(spark, sf_dir, "clips").select("clip_id", A.style_vector().alias("v"))
    # Three smallest ids of each vector, and one more: enough for the three best of any reference.
    nth = F.row_number().over(J.W.partitionBy("v").orderBy("clip_id"))
    styles = clips.withColumn("nth", nth).where("nth <= 4").groupBy("v").agg(F.array_sort(F.collect_list("clip_id")).alias("ids"))
    refs = clips.where("clip_id % 50 = 0").select(F.col("clip_id").alias("ref_id"), F.col("v").alias("a"))
    asked = refs.select("a").distinct()
    small = asked.count() <= J.BROADCAST_ROWS
    pairs = styles.repartition(2 * spark.sparkContext.defaultParallelism).join(F.broadcast(asked) if small else asked, F.col("a") != F.col("v")).select("a", "ids", F.round(A.cosine("a", "v"), 6).alias("similarity"))
    near = J.top_k(pairs.withColumn("first", F.get("ids", F.lit(0))), "a", "similarity", 4, F.col("first")).drop("rank")
    each = refs.join(near, "a").select("ref_id", F.explode("ids").alias("clip_id"), "similarity").where("ref_id <> clip_id")
    return J.top_k(each, "ref_id", "similarity", 3, F.col("clip_id")).select("ref_id", "clip_id", "similarity", "rank")
