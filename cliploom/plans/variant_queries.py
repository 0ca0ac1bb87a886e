"""Queries over the further forms of operators: keys of files, notes, packs with features, name keys, windows of segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.functions import features as X
from cliploom.operators import pairs as Q
from cliploom.operators import search as R
from cliploom.operators import transcripts as T
from cliploom.plans.clip_queries import _JN4, _SIDE
from cliploom.plans.registration import query
from cliploom.plans.text_queries import _SILENT
from cliploom.plans.views import duck, view
from cliploom.sources.catalog import result_packs


@query(duck("clips") + """ SELECT clip_id, substr(sha256(path || '|' || size || '|' || mtime), 1, 24) AS path_key, md5('size:' || strlen(path) || chr(10) || path) AS file_key FROM clips""")
def pr13_file_and_path_keys(spark, sf_dir):
    """Keys of files; a path's bytes stand for a short file's content (longer ones in the tests)."""
    clips = view(spark, sf_dir, "clips")
    return clips.select("clip_id", X.path_key("path", "size", "mtime").alias("path_key"), X.file_key(F.col("path").cast("binary")).alias("file_key"))


_FIELDS = ["CASE WHEN clip_id % 2 = 0 THEN '' ELSE category END", "energy", "lighting", "CASE WHEN clip_id % 3 = 0 THEN ' ' ELSE shot_type END", "camera_motion", "depth_of_field", "path"]


@query(duck("clips") + f""" SELECT clip_id, round(0.5 * ({" + ".join(f"(trim({c}) <> '')::int" for c in _FIELDS)} + (len(subjects) > 0)::int + 1 + 1 + (len(mood) > 0 AND clip_id % 5 <> 0)::int + 1) / 12.0 + 0.5 * (CASE WHEN clip_id % 7 = 0 THEN 0.5 ELSE 1.0 END), 6) AS confidence FROM clips""")
def pr7_whole_confidence(spark, sf_dir):
    """All twelve tag fields, some of them empty, and six metrics, of which every seventh clip lacks one."""
    none = F.array().cast("array<string>")
    rows = view(spark, sf_dir, "clips").withColumns({
        "category": F.when(F.col("clip_id") % 2 == 0, "").otherwise(F.col("category")), "shot_type": F.when(F.col("clip_id") % 3 == 0, " ").otherwise(F.col("shot_type")),
        "mood": F.when(F.col("clip_id") % 5 == 0, none).otherwise(F.col("mood")), "contrast": F.when(F.col("clip_id") % 7 != 0, F.col("contrast")), "query": F.col("path"),
    })
    texts = ["category", "energy", "lighting", "shot_type", "camera_motion", "depth_of_field", "query"]
    metrics = ["palette_warmth", "palette_saturation", "palette_brightness", "contrast", "edge_density", "motion_intensity"]
    return rows.select("clip_id", F.round(X.confidence(texts, ["subjects", "setting", "action", "mood", "color_palette"], metrics), 6).alias("confidence"))


@query(_SIDE + f""", s AS (SELECT ref_id, clip_id, round({_JN4}, 6) AS score, b.confidence AS c FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, clip_id) AS rank FROM s)
 SELECT ref_id, clip_id, CASE WHEN c <= 0 THEN 'empty-sentinel fallback' ELSE (CASE WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'weak' ELSE 'poor' END) || ' match (' || printf('%.2f', score) || ')' END AS note FROM t WHERE rank <= 5""")
def pr30_jn17_match_notes(spark, sf_dir):
    """Notes on the five best clips of each stated reference."""
    clips = view(spark, sf_dir, "clips")
    best = Q.best_pairs(clips.where("clip_id % 50 = 0"), clips, Q.Component(), 5, carry={"c": F.col("confidence")})
    return best.select("ref_id", "clip_id", X.match_note(F.col("score"), F.col("c")).alias("note"))


@query(duck("spans", "clips") + """, i AS (SELECT job_id, list({'span_idx': span_idx, 'ref_clip_id': ref_clip_id} ORDER BY span_idx) AS items, count(*) AS n, min_by(ref_clip_id, span_idx) AS first FROM spans GROUP BY 1)
 SELECT i.job_id, to_json({'job_id': i.job_id, 'items': items, 'reference': {'category': c.category, 'mood': c.mood}, 'diagnostics': {'spans': n}})::varchar AS pack FROM i JOIN clips c ON c.clip_id = i.first""")
def io11_packs_with_features(spark, sf_dir):
    """Packs with the features of the first span's reference and the number of spans."""
    spans = view(spark, sf_dir, "spans").select("job_id", "span_idx", "ref_clip_id")
    first = spans.groupBy("job_id").agg(F.min_by("ref_clip_id", "span_idx").alias("clip_id"), F.count(F.lit(1)).alias("spans"))
    features = first.join(view(spark, sf_dir, "clips").select("clip_id", "category", "mood"), "clip_id").select("job_id", "category", "mood")
    return result_packs(spans, "job_id", "span_idx", features, first.select("job_id", "spans"))


@query(duck("clips") + r""", k AS (SELECT path, mtime, array_to_string([w for w in string_split(regexp_replace(regexp_replace(lower(regexp_extract(path, '[^/]*$', 0)), '\.[^./]*$', ''), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ') if w <> ''][1:4], ' ') AS name_key FROM (SELECT replace(path, '_', ' ') AS path, mtime FROM clips)),
 r AS (SELECT *, row_number() OVER (ORDER BY mtime DESC, path) - 1 AS pos0, row_number() OVER (PARTITION BY name_key ORDER BY mtime DESC, path) AS first FROM k) SELECT path, mtime, name_key FROM r WHERE pos0 < 30 // 2 OR first = 1 ORDER BY pos0 LIMIT 30""")
def wn21_diverse_names(spark, sf_dir):
    """Newest clips by the first four words of their file names."""
    files = view(spark, sf_dir, "clips").select(F.replace("path", F.lit("_"), F.lit(" ")).alias("path"), "mtime")
    return R.diverse_newest(files.withColumn("name_key", X.name_key("path")), 30)


@query(duck("words", "segments") + f""", seg AS (SELECT asset_id + {_SILENT} AS asset_id, seg_idx AS pos, start_s, end_s, trim(text) AS word FROM segments WHERE trim(text) <> ''), items AS (SELECT asset_id, pos, start_s, end_s, word FROM words UNION ALL SELECT * FROM seg)
 SELECT asset_id, string_agg(word, ' ' ORDER BY pos) AS text FROM items WHERE end_s > 3.0 AND start_s < 14.0 GROUP BY 1""")
def jn10_words_else_segments(spark, sf_dir):
    """Texts of seconds 3 to 14 of all transcripts: by words, and by segments where an asset has no words."""
    segments = view(spark, sf_dir, "segments")
    segments = segments.unionByName(segments.withColumn("asset_id", F.col("asset_id") + _SILENT))
    items = T.transcript_items(view(spark, sf_dir, "words"), segments).withColumnRenamed("text", "word")
    windows = items.select("asset_id").distinct().withColumns({"lo": F.lit(3.0), "hi": F.lit(14.0)})
    return T.window_texts(windows, items, ["asset_id"])
