"""Queries over the clip catalog: features, scores, ranks, sets, index upkeep."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom import schema as S
from cliploom.functions import features as X
from cliploom.operators import aggregates as A
from cliploom.operators import assign as G
from cliploom.operators import pairs as Q
from cliploom.operators import scoring as J
from cliploom.plans.registration import query
from cliploom.plans.views import duck, view


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _pairs(a: str, b: str, pairs) -> str:
    return "(" + " or ".join(f"({a} = '{p}' and {b} = '{q}') or ({a} = '{q}' and {b} = '{p}')" for p, q in pairs) + ")"


_RAW = """select p_partkey as clip_id, list_value(' ' || upper(p_name), '', lower(p_brand), p_type) as subjects, list_value(upper(p_type), p_name, p_brand) as setting,
 case p_size % 4 when 0 then ' MOVIE ' when 1 then '' when 2 then lower(p_type) else 'tech' end as category, case p_size % 3 when 0 then '' when 1 then ' High' else 'huge' end as energy,
 '  ' || p_name || '   ' || p_brand || ' ' as query, p_size / 25.0e0 - 0.3e0 as contrast, p_retailprice / 1000.0e0 - 1.0e0 as palette_warmth from part"""


def _raw(spark, sf_dir):
    text = _RAW.replace("list_value(", "array(").replace("from part", "from {part}")
    return spark.sql(text, part=view(spark, sf_dir, "part"))


@query(f"""WITH raw AS ({_RAW}) SELECT clip_id, array_to_string([lower(trim(s)) for s in subjects[1:3] if trim(s) <> ''], '|') AS subjects,
 array_to_string([lower(trim(s)) for s in setting[1:2] if trim(s) <> ''], '|') AS setting, CASE WHEN trim(category) = '' THEN 'other' ELSE lower(trim(category)) END AS category,
 CASE WHEN trim(energy) = '' THEN 'medium' ELSE lower(trim(energy)) END AS energy, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS query,
 round(greatest(0.0, least(1.0, contrast)), 6) AS contrast, round(greatest(0.0, least(1.0, palette_warmth)), 6) AS palette_warmth FROM raw""")
def pr1_normalise(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    made = raw.select("clip_id", *[c.alias(n) for n, c in X.normalised(raw.columns).items()])
    flat = {"subjects": F.array_join("subjects", "|"), "setting": F.array_join("setting", "|"), "contrast": F.round("contrast", 6), "palette_warmth": F.round("palette_warmth", 6)}
    return made.withColumns(flat).select("clip_id", "subjects", "setting", "category", "energy", "query", "contrast", "palette_warmth")


@query(f"""WITH raw AS ({_RAW}) SELECT clip_id, (category NOT IN {_in(S.CATEGORIES)})::int + (energy NOT IN {_in(S.ENERGY)})::int + (len(subjects) > 3)::int + (len(setting) > 2)::int
 + (contrast < 0 OR contrast > 1)::int + (palette_warmth < 0 OR palette_warmth > 1)::int AS n_errors FROM raw""")
def pr2_validate(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select("clip_id", F.size(X.errors(raw.columns)).alias("n_errors"))


@query(f"""WITH raw AS ({_RAW}) SELECT clip_id, round(0.5 * ((trim(category) <> '')::int + (trim(energy) <> '')::int + (trim(query) <> '')::int + (len(subjects) > 0)::int + (len(setting) > 0)::int) / 5.0 + 0.5, 6) AS confidence FROM raw""")
def pr7_confidence(spark, sf_dir):
    return _raw(spark, sf_dir).select("clip_id", F.round(X.confidence(["category", "energy", "query"], ["subjects", "setting"], ["contrast", "palette_warmth"]), 6).alias("confidence"))


@query(duck("clips") + """, q AS (SELECT clip_id, list_value(subjects[1] || ' ' || action[1], subjects[1] || ' ' || mood[1], subjects[1] || ' ' || lighting, subjects[1] || ' ' || array_to_string(setting[1:2], ' '), subjects[1] || ' ' || color_palette[1]) AS l FROM clips),
 e AS (SELECT clip_id, unnest(range(1, 6)) AS pos, unnest(l) AS query FROM q), f AS (SELECT clip_id, query, min(pos) AS p FROM e GROUP BY 1, 2)
 SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY p) - 1 AS pos, query FROM f""")
def pr9_expanded_queries(spark, sf_dir):
    return view(spark, sf_dir, "clips").select("clip_id", F.posexplode(X.expanded_queries()).alias("pos", "query"))


@query("SELECT page_id, unnest(CASE WHEN trim(t) = '' THEN [] WHEN lower(trim(t)) LIKE '%b roll' THEN [trim(t)] ELSE [trim(t), trim(t) || ' b roll'] END) AS query FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)")
def pr11_wide_queries(spark, sf_dir):
    pages = view(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    return pages.select("page_id", F.explode(X.wide_queries("t")).alias("query"))


_FOLDERED = "CASE category WHEN 'movie' THEN 'The_Good_Stuff/' WHEN 'sports' THEN 'NBA finals/' WHEN 'tech' THEN 'ronaldo/good stuff/' ELSE '' END || replace(path, '_', '_of_')"


@query(duck("clips") + f""", p AS (SELECT clip_id, {_FOLDERED} AS path FROM clips), t AS (SELECT clip_id, path, regexp_extract_all(lower(replace(regexp_replace(regexp_extract(path, '([^/]*/)?[^/]*$', 0), '\\.[^./]*$', ''), '_', ' ')), '[a-z0-9$]+') AS l FROM p),
 e AS (SELECT clip_id, unnest(range(0, len(l))) AS i, unnest(l) AS tok FROM t), f AS (SELECT clip_id, tok, min(i) AS i FROM e WHERE len(tok) >= 2 AND tok NOT IN {_in(S.PATH_STOP_WORDS)} GROUP BY 1, 2),
 g AS (SELECT clip_id, list(tok ORDER BY i) AS l FROM f GROUP BY 1), c AS (SELECT clip_id, list_reverse(string_split(replace(lower(path), '_', ' '), '/'))[2:] AS up FROM p),
 k AS (SELECT clip_id, coalesce([x for x in [CASE WHEN contains(u, 'good stuff') THEN 'movie' WHEN contains(u, 'nba') OR contains(u, 'ronaldo') THEN 'sports' END for u in up] if x IS NOT NULL][1], 'other') AS category FROM c)
 SELECT g.clip_id, array_to_string(l[1:4], '|') AS subjects, category, array_to_string(l[1:8], ' ') AS query FROM g JOIN k ON k.clip_id = g.clip_id""")
def pr12_path_tags(spark, sf_dir):
    folder = F.when(F.col("category") == "movie", "The_Good_Stuff/").when(F.col("category") == "sports", "NBA finals/").when(F.col("category") == "tech", "ronaldo/good stuff/").otherwise("")
    clips = view(spark, sf_dir, "clips").select("clip_id", F.concat(folder, F.replace("path", F.lit("_"), F.lit("_of_"))).alias("path"))
    return clips.select("clip_id", X.path_tags("path").alias("t")).select("clip_id", F.array_join("t.subjects", "|").alias("subjects"), "t.category", "t.query")


@query("SELECT page_id, substr(sha256(lower(trim(url)) || '|8'), 1, 24) AS key, md5(html) AS page_md5, sha256(html) AS page_sha256 FROM pages")
def pr13_content_keys(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", X.cache_key("url", 8).alias("key"), F.md5("html").alias("page_md5"), F.sha2("html", 256).alias("page_sha256"))


@query(duck("levels") + """ SELECT asset_id, sec, round(CASE WHEN level * -40 <= -90 OR level - 30 <= -90 THEN 0.18 ELSE greatest(0.05, least(1.5, pow(10.0, ((level - 30) - (level * -40)) / 20))) END, 6) AS gain FROM levels""")
def pr26_gain(spark, sf_dir):
    return view(spark, sf_dir, "levels").select("asset_id", "sec", F.round(X.gain(F.col("level") * -40, F.col("level") - 30), 6).alias("gain"))


@query(duck("spans") + """, s AS (SELECT *, 12.0 AS clip, 20.0 AS ref FROM spans) SELECT job_id, span_idx, round(CASE WHEN end_s <= clip THEN start_s ELSE greatest(0.0, clip - greatest(0.08, least(1.0, (end_s - start_s) / ref) * clip)) END, 6) AS start_s,
 round(CASE WHEN end_s <= clip THEN end_s ELSE clip END, 6) AS end_s FROM s""")
def pr27_aligned_spans(spark, sf_dir):
    start, end = X.aligned(F.col("start_s"), F.col("end_s"), F.lit(20.0), F.lit(12.0))
    return view(spark, sf_dir, "spans").select("job_id", "span_idx", F.round(start, 6).alias("start_s"), F.round(end, 6).alias("end_s"))


@query(duck("search_rows") + f""" SELECT query_id, pos, id, duration FROM search_rows WHERE NOT contains(url, '/shorts/') AND NOT ({' OR '.join(f"contains(lower(title), '{t}')" for t in S.JUNK_TERMS)}) AND (duration = 0 OR duration BETWEEN 3 AND 150)""")
def fl1_fl2_kept_results(spark, sf_dir):
    from cliploom.operators.search import kept_results

    return kept_results(view(spark, sf_dir, "search_rows")).select("query_id", "pos", "id", "duration")


@query(duck("search_rows") + f""", k AS (SELECT * FROM search_rows WHERE NOT contains(url, '/shorts/') AND NOT ({' OR '.join(f"contains(lower(title), '{t}')" for t in S.JUNK_TERMS)}) AND (duration = 0 OR duration BETWEEN 3 AND 150)),
 d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_id, pos) AS r FROM k), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS q FROM d WHERE r = 1)
 SELECT query_id, pos, id FROM c WHERE q <= 20 ORDER BY query_id, pos LIMIT 60""")
def so1_tk3_first_by_id(spark, sf_dir):
    from cliploom.operators.search import first_by_id, kept_results

    return first_by_id(kept_results(view(spark, sf_dir, "search_rows")), 20, 60).select("query_id", "pos", "id")


@query(duck("clips") + " SELECT clip_id, confidence FROM clips WHERE confidence > 0 AND path <> ''")
def fl6_usable_clips(spark, sf_dir):
    return view(spark, sf_dir, "clips").where("confidence > 0 and path <> ''").select("clip_id", "confidence")


_BASE_SQL = """k AS (SELECT clip_id, 'category' AS kind, category AS value, 3.0e0 AS weight FROM clips UNION ALL SELECT clip_id, 'subject', s, 1.0e0 FROM (SELECT DISTINCT clip_id, unnest(subjects) AS s FROM clips)
 UNION ALL SELECT clip_id, 'setting', s, 1.0e0 FROM (SELECT DISTINCT clip_id, unnest(setting) AS s FROM clips)),
 base AS (SELECT a.clip_id AS ref_id, b.clip_id AS clip_id, least(1.0, sum(a.weight) / 8.0) AS base FROM k a JOIN k b ON a.kind = b.kind AND a.value = b.value AND a.clip_id <> b.clip_id GROUP BY 1, 2)"""


@query(duck("clips") + ", " + _BASE_SQL + """ SELECT ref_id, clip_id, base, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS rank FROM base) WHERE rank <= 5""")
def jn1_tk2_keyword_top5(spark, sf_dir):
    clips = view(spark, sf_dir, "clips")
    return J.best_matches(clips.withColumnRenamed("clip_id", "ref_id"), clips, 5)


_SIDE = duck("clips") + """, p AS (SELECT a.clip_id AS ref_id, b.clip_id AS clip_id, a AS a, b AS b FROM clips a JOIN clips b ON a.clip_id % 50 = 0 AND a.clip_id <> b.clip_id)"""
_JAC = lambda n: f"(CASE WHEN len(list_distinct(list_concat(a.{n}, b.{n}))) > 0 THEN len(list_intersect(a.{n}, b.{n})) / len(list_distinct(list_concat(a.{n}, b.{n}))) ELSE 0 END)"
_NEAR = lambda n, pairs, part, other=0.0: f"(CASE WHEN a.{n} = b.{n} THEN 1.0 WHEN {_pairs(f'a.{n}', f'b.{n}', pairs)} THEN {part} ELSE {other} END)"
_VIBE = f"(0.4 * {_JAC('mood')} + " + " + ".join(f"{w} * {_NEAR(n, S.VIBE_NEIGHBOURS, 0.5)}" for n, w in (("lighting", 0.2), ("energy", 0.15), ("shot_type", 0.15), ("depth_of_field", 0.1))) + ")"
_CINEMA = f"""greatest(0.18, ((CASE WHEN a.shot_type = b.shot_type THEN 1.0 WHEN (a.shot_type IN {_in(S.WIDE_SHOTS)} AND b.shot_type IN {_in(S.WIDE_SHOTS)}) OR (a.shot_type IN {_in(S.TIGHT_SHOTS)} AND b.shot_type IN {_in(S.TIGHT_SHOTS)}) THEN 0.6 ELSE 0.25 END)
 + (CASE WHEN a.camera_motion = b.camera_motion THEN 0.4 WHEN {_pairs('a.camera_motion', 'b.camera_motion', S.MOTION_CONTRASTS)} THEN 1.0 WHEN {_pairs('a.camera_motion', 'b.camera_motion', (('pan', 'tilt'),))} THEN 0.4 ELSE 0.0 END)
 + (CASE WHEN a.depth_of_field = b.depth_of_field THEN 1.0 ELSE 0.2 END)) / 3)"""
_BASE_PAIR = "least(1.0, ((CASE WHEN a.category = b.category THEN 3.0 ELSE 0.0 END) + len(list_intersect(a.subjects, b.subjects)) + len(list_intersect(a.setting, b.setting))) / 8.0)"


def _best(spark, sf_dir, formula, k=5, **more):
    """The best clips of the stated references."""
    clips = view(spark, sf_dir, "clips")
    return Q.best_pairs(clips.where("clip_id % 50 = 0"), clips, formula, k, **more).select("ref_id", "clip_id", "score", "rank")


def _top_sql(score: str, k: int = 5) -> str:
    return _SIDE + f""", s AS (SELECT ref_id, clip_id, round({score}, 6) AS score FROM p) SELECT ref_id, clip_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, clip_id) AS rank FROM s) WHERE rank <= {k}"""


@query(_top_sql(f"greatest(0.0, least(1.0, {_BASE_PAIR} + 0.35 * {_VIBE} * (1.0 - {_BASE_PAIR}) + CASE WHEN {_CINEMA} < 0.6 THEN 0.5 * ({_CINEMA} - 0.6) ELSE 0.0 END))"))
def jn2_intelligent_top5(spark, sf_dir):
    return _best(spark, sf_dir, Q.Intelligent())


@query(_top_sql(_VIBE))
def jn3_vibe_top5(spark, sf_dir):
    return _best(spark, sf_dir, Q.Vibe())


def _renorm(parts) -> str:
    total = " + ".join(f"(CASE WHEN {had} THEN {w} ELSE 0 END)" for _, w, had in parts)
    value = " + ".join(f"(CASE WHEN {had} THEN ({s}) * {w} ELSE 0 END)" for s, w, had in parts)
    return f"(CASE WHEN ({total}) > 0 THEN ({value}) / ({total}) ELSE 0 END)"


def _group(side: str) -> str:
    table = "MAP {" + ", ".join(f"'{m}': [{', '.join(repr(x) for x in pair)}]" for pair in S.MOOD_GROUPS for m in pair) + "}"
    return f"list_distinct(flatten([coalesce({table}[m], [m]) for m in {side}.mood]))"


_TONES = ("palette_warmth", "palette_saturation", "palette_brightness")
_JN4 = _renorm([
    (f"0.4 * {_NEAR('category', S.CATEGORY_PAIRS, 0.5)} + 0.4 * {_JAC('subjects')} + 0.2 * {_JAC('setting')}", 0.3, "true"),
    (_renorm([
        (f"len(list_intersect({_group('a')}, {_group('b')})) / len(list_distinct(list_concat({_group('a')}, {_group('b')})))", 0.3, "true"),
        (f"1.0 - ({' + '.join(f'abs(a.{t} - b.{t})' for t in _TONES)}) / 3.0", 0.2, f"NOT (({' AND '.join(f'a.{t} = 0' for t in _TONES)}) OR ({' AND '.join(f'b.{t} = 0' for t in _TONES)}))"),
        (_NEAR("lighting", S.LIGHTING_PAIRS, 0.4), 0.15, "true"),
        ("1.0 - abs(a.motion_intensity - b.motion_intensity)", 0.2, "a.motion_intensity <> 0 AND b.motion_intensity <> 0"),
        ("1.0 - abs(a.contrast - b.contrast)", 0.15, "a.contrast <> 0 AND b.contrast <> 0"),
    ]), 0.45, "true"),
    (f"0.4 * {_NEAR('shot_type', S.SHOT_PAIRS, 0.5)} + 0.3 * {_NEAR('camera_motion', S.MOTION_PAIRS, 0.4)} + 0.3 * (a.depth_of_field = b.depth_of_field)::int", 0.15, "true"),
    ("1.0 - abs((CASE a.energy WHEN 'low' THEN 0.0 WHEN 'high' THEN 1.0 ELSE 0.5 END) - (CASE b.energy WHEN 'low' THEN 0.0 WHEN 'high' THEN 1.0 ELSE 0.5 END))", 0.1, "true"),
])


@query(_top_sql(_JN4))
def jn4_component_top5(spark, sf_dir):
    return _best(spark, sf_dir, Q.Component())


_CAUCHY = lambda n, g: f"(1.0 / (1.0 + ((a.{n} - b.{n}) / {g}) * ((a.{n} - b.{n}) / {g})))"
_HUES = "['warm', 'cool', 'neutral', 'earthy', 'monochrome', 'neon', 'pastel']"
_VA, _VB = (f"list_intersect({s}.color_palette[1:3], {_HUES})" for s in "ab")
_JN5 = f"""0.25 * (0.4 * {_JAC('subjects')} + 0.25 * {_JAC('setting')} + 0.2 * (a.category = b.category)::int + 0.15 * {_JAC('action')})
 + 0.3 * (0.35 * {_JAC('mood')} + 0.15 * {_NEAR('energy', (('low', 'medium'), ('medium', 'high')), 0.5)} + 0.15 * {_NEAR('lighting', S.LIGHTING_PAIRS, 0.4)}
  + 0.15 * (1.0 - (len([x for x in {_VA} if NOT list_contains({_VB}, x)]) + len([x for x in {_VB} if NOT list_contains({_VA}, x)])) / 7.0)
  + 0.1 * {_CAUCHY('palette_warmth', 0.2)} + 0.05 * {_CAUCHY('palette_saturation', 0.2)} + 0.05 * {_CAUCHY('palette_brightness', 0.2)})
 + 0.2 * (0.45 * {_NEAR('shot_type', S.SHOT_NEIGHBOURS, 0.7, 0.3)} + 0.35 * (CASE WHEN a.camera_motion = b.camera_motion THEN 1.0 WHEN a.camera_motion = 'static' OR b.camera_motion = 'static' THEN 0.4 ELSE 0.0 END) + 0.2 * (CASE WHEN a.depth_of_field = b.depth_of_field THEN 1.0 ELSE 0.5 END))
 + 0.25 * (0.55 * {_CAUCHY('motion_intensity', 0.25)} + 0.25 * {_CAUCHY('contrast', 0.3)} + 0.2 * {_CAUCHY('edge_density', 0.3)})"""


@query(_top_sql(_JN5))
def jn5_composite_top5(spark, sf_dir):
    return _best(spark, sf_dir, Q.Composite())


@query(_SIDE + """, s AS (SELECT ref_id, clip_id, (CASE WHEN contains(lower(b.path), lower(a.mood[1])) THEN 10 ELSE 0 END) + (CASE WHEN len([x for x in b.subjects if contains(lower(x), lower(a.mood[1])) OR contains(lower(a.mood[1]), lower(x))]) > 0 THEN 5 ELSE 0 END)
 + 2 * len(list_intersect(a.subjects, b.subjects)) + (a.category = b.category)::int AS score FROM p) SELECT ref_id, clip_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, clip_id) AS rank FROM s WHERE score > 0) WHERE rank = 1""")
def jn6_hook_match(spark, sf_dir):
    clips = view(spark, sf_dir, "clips")
    refs = clips.where("clip_id % 50 = 0").withColumn("personality", F.get("mood", F.lit(0)))
    return Q.best_pairs(refs, clips, Q.Hook(), 1, least=0.0).select("ref_id", "clip_id", F.col("score").cast("int").alias("score"), "rank")


@query(_SIDE + f""", s AS (SELECT ref_id, clip_id, round({_JN4}, 6) AS score, (b.confidence > 0)::int AS ok FROM p) SELECT ref_id, clip_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, ok DESC, clip_id) AS rank FROM s) WHERE rank <= 3""")
def tk1_signal_first(spark, sf_dir):
    return _best(spark, sf_dir, Q.Component(), 3, ties={"ok": (F.col("confidence") > 0).cast("int")})


@query(duck("clips") + """, idx AS (SELECT path, CASE WHEN clip_id % 7 = 0 THEN mtime - 5 ELSE mtime END AS mtime, CASE WHEN clip_id % 11 = 0 THEN size + 1 ELSE size END AS size FROM clips WHERE clip_id % 5 <> 0)
 SELECT c.clip_id, CASE WHEN i.path IS NULL THEN 'new' WHEN i.mtime = c.mtime AND i.size = c.size THEN 'hit' ELSE 'changed' END AS action FROM clips c LEFT JOIN idx i ON i.path = c.path""")
def jn7_index_actions(spark, sf_dir):
    from cliploom.sources.catalog import index_actions

    clips = view(spark, sf_dir, "clips")
    return index_actions(clips, _older_index(clips)).select("clip_id", "action")


def _older_index(clips):
    changed = clips.withColumns({"mtime": F.when(F.col("clip_id") % 7 == 0, F.col("mtime") - 5).otherwise(F.col("mtime")), "size": F.when(F.col("clip_id") % 11 == 0, F.col("size") + 1).otherwise(F.col("size"))})
    return changed.where("clip_id % 5 <> 0").select("path", "mtime", "size")


@query(duck("clips") + """, idx AS (SELECT path, CASE WHEN clip_id % 7 = 0 THEN mtime - 5 ELSE mtime END AS mtime, CASE WHEN clip_id % 11 = 0 THEN size + 1 ELSE size END AS size FROM clips WHERE clip_id % 5 <> 0)
 SELECT count(*) AS total, count(*) FILTER (i.mtime = c.mtime AND i.size = c.size) AS hits, count(*) - count(*) FILTER (i.mtime = c.mtime AND i.size = c.size) AS extracted FROM clips c LEFT JOIN idx i ON i.path = c.path""")
def ag10_index_report(spark, sf_dir):
    from cliploom.sources.catalog import index_actions, index_report

    clips = view(spark, sf_dir, "clips")
    return index_report(index_actions(clips, _older_index(clips)))


@query(duck("clips") + " SELECT path FROM clips WHERE clip_id % 5 <> 0 EXCEPT SELECT path FROM clips WHERE clip_id % 3 <> 0")
def so4_removed_files(spark, sf_dir):
    clips = view(spark, sf_dir, "clips")
    return clips.where("clip_id % 5 <> 0").select("path").join(clips.where("clip_id % 3 <> 0").select("path"), "path", "left_anti")


@query(duck("clips", "spans") + """, t AS (SELECT s.job_id, s.span_idx, c.mood, c.energy, c.lighting FROM spans s JOIN clips c ON c.clip_id = s.ref_clip_id),
 m AS (SELECT job_id, value, min((span_idx, i)) AS f FROM (SELECT job_id, span_idx, unnest(range(0, len(mood))) AS i, unnest(mood) AS value FROM t) GROUP BY 1, 2),
 l AS (SELECT job_id, string_agg(value, '|' ORDER BY f) AS mood FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY f) AS r FROM m) WHERE r <= 3 GROUP BY 1),
 e AS (SELECT job_id, energy, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, min(span_idx)) AS r FROM t GROUP BY 1, 2),
 g AS (SELECT job_id, lighting, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, min(span_idx)) AS r FROM t GROUP BY 1, 2)
 SELECT l.job_id, l.mood, e.energy, g.lighting FROM l JOIN e ON e.job_id = l.job_id AND e.r = 1 JOIN g ON g.job_id = l.job_id AND g.r = 1""")
def ag1_ag2_ag4_house_style(spark, sf_dir):
    tags = _span_tags(spark, sf_dir)
    return A.house_style(tags).select("job_id", F.array_join("mood", "|").alias("mood"), "energy", "lighting")


def _span_tags(spark, sf_dir):
    clips = view(spark, sf_dir, "clips").withColumnRenamed("clip_id", "ref_clip_id")
    return view(spark, sf_dir, "spans").join(clips, "ref_clip_id")


@query(duck("clips", "spans") + """, t AS (SELECT s.job_id, s.span_idx, CASE WHEN s.span_idx % 2 = 1 THEN '' ELSE c.energy END AS energy FROM spans s JOIN clips c ON c.clip_id = s.ref_clip_id),
 e AS (SELECT job_id, energy, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, min(span_idx)) AS r FROM t WHERE energy <> '' GROUP BY 1, 2)
 SELECT t.job_id, t.span_idx, CASE WHEN t.energy <> '' THEN t.energy ELSE coalesce(e.energy, '') END AS energy FROM t LEFT JOIN e ON e.job_id = t.job_id AND e.r = 1""")
def ag5_back_filled(spark, sf_dir):
    tags = _span_tags(spark, sf_dir).withColumn("energy", F.when(F.col("span_idx") % 2 == 1, "").otherwise(F.col("energy")))
    return A.back_filled(tags, A.house_style(tags)).select("job_id", "span_idx", "energy")


@query(duck("spans") + """, s AS (SELECT *, lead(start_s) OVER (PARTITION BY job_id ORDER BY span_idx) - end_s AS gap, max(end_s) OVER (PARTITION BY job_id) + 2.0 AS duration FROM spans),
 r AS (SELECT job_id, count(*) / max(duration) * 30.0 AS per_30s, avg(greatest(0.0, end_s - start_s)) AS length, min_by(start_s, span_idx) AS first_start, coalesce(avg(gap), 0.0) AS gap FROM s GROUP BY 1)
 SELECT count(*) AS samples, round(avg(per_30s), 6) AS per_30s, round(avg(length), 6) AS length, round(avg(first_start), 6) AS first_start, round(avg(gap), 6) AS gap FROM r""")
def ag6_placement_profile(spark, sf_dir):
    return A.running_profile(A.placement_profile(_timed(spark, sf_dir), F.col("total")))


def _timed(spark, sf_dir):
    spans = view(spark, sf_dir, "spans")
    return spans.join(spans.groupBy("job_id").agg((F.max("end_s") + 2.0).alias("total")), "job_id")


@query(duck("clips") + """, v AS (SELECT clip_id, list_concat([(shot_type = x)::int::double for x in ['wide', 'medium', 'close-up', 'extreme-close-up', 'aerial', 'overhead', 'two-shot']], list_concat([(camera_motion = x)::int::double for x in ['static', 'pan', 'tilt', 'dolly', 'handheld', 'tracking', 'zoom']], [(depth_of_field = 'deep')::int::double, (depth_of_field = 'shallow')::int::double])) AS l FROM clips)
 SELECT a.clip_id AS ref_id, b.clip_id, round(list_sum([a.l[i] * b.l[i] for i in range(1, 17)]) / 3.0, 6) AS similarity FROM v a JOIN v b ON a.clip_id % 50 = 0 AND a.clip_id <> b.clip_id AND a.l = b.l""")
def ag13_ag14_same_style(spark, sf_dir):
    clips = view(spark, sf_dir, "clips").withColumn("v", F.slice(A.style_vector(), 1, 16))
    # Vectors of a pair are equal, so the similarity belongs to the reference.
    left = clips.where("clip_id % 50 = 0").select(F.col("clip_id").alias("ref_id"), F.col("v").alias("a"), F.round(A.cosine("v", "v"), 6).alias("similarity"))
    count = left.count()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-count * clips.count() // (16 * J.TASK_PAIRS)))
    left = F.broadcast(left) if count <= J.BROADCAST_ROWS else left
    pairs = clips.select("clip_id", F.col("v").alias("b")).repartition(tasks).join(left, F.col("a") == F.col("b")).where("ref_id <> clip_id")
    return pairs.select("ref_id", "clip_id", "similarity")


def _styled(clips):
    """Clips with their style vector, an id of it, and an id of its one-hot part."""
    look = F.concat_ws("|", "shot_type", "camera_motion", "depth_of_field")
    return clips.withColumn("vector", A.style_vector()).withColumns({"style": F.xxhash64("vector"), "look": look})


def _job_candidates(spark, sf_dir, per_span=1, styled=False):
    """Candidates of every span: of its reference clip's best, as many as the largest job of that clip can take."""
    clips, spans = view(spark, sf_dir, "clips"), view(spark, sf_dir, "spans").select("job_id", "span_idx", "ref_clip_id")
    sizes = spans.groupBy("job_id").agg((F.countDistinct("span_idx") * per_span).alias("bound"))
    bounds = spans.join(sizes, "job_id").groupBy("ref_clip_id").agg(F.max("bound").alias("bound"))
    asked = clips.withColumnRenamed("clip_id", "ref_clip_id").join(bounds, "ref_clip_id")
    best = J.candidates(asked, _styled(clips) if styled else clips, "bound", "ref_clip_id", "clip_id", *(("style", "look") if styled else ()))
    return spans.join(best, "ref_clip_id")


def _job_lists(spark, sf_dir, per_span=1):
    """Spans with the candidates of each in one list, as many as their job can take; the lists stay one for all equal references."""
    clips, spans = view(spark, sf_dir, "clips"), view(spark, sf_dir, "spans").select("job_id", "span_idx", "ref_clip_id")
    spans = spans.withColumn("bound", (F.count(F.lit(1)).over(W.partitionBy("job_id")) * per_span).cast("int"))
    asked = clips.withColumnRenamed("clip_id", "ref_clip_id").join(spans.groupBy("ref_clip_id").agg(F.max("bound").alias("bound")), "ref_clip_id")
    own, lists = J.candidate_lists(asked, clips, "bound", "ref_clip_id")
    dealt = spans.join(own, "ref_clip_id").repartition("job_id").join(lists, "tags")
    others = F.filter("list", lambda e: e["clip_id"] != F.col("ref_clip_id"))
    return dealt.select("job_id", "span_idx", F.slice(others, F.lit(1), F.col("bound")).alias("list")).where(F.size("list") > 0)


def _greedy_sql(per_span: int) -> str:
    """Picks of every span: a fold over the spans of a job, each with as many candidates as the job can take."""
    return duck("clips", "spans") + ", " + _BASE_SQL + f""", top AS (SELECT ref_id, list(clip_id ORDER BY base DESC, clip_id) AS l FROM base GROUP BY 1), j AS (SELECT job_id, count(*) AS n FROM spans GROUP BY 1),
 f AS (SELECT s.job_id, list_reduce(list_prepend({{'s': -1, 'c': []::bigint[], 'used': []::bigint[], 'out': []::bigint[][]}}, list({{'s': s.span_idx, 'c': l[1:j.n * {per_span}], 'used': []::bigint[], 'out': []::bigint[][]}} ORDER BY s.span_idx)),
   lambda a, x: {{'s': x.s, 'c': x.c, 'used': list_concat(a.used, list_filter(x.c, lambda y: NOT list_contains(a.used, y))[1:{per_span}]), 'out': list_append(a.out, list_filter(x.c, lambda y: NOT list_contains(a.used, y))[1:{per_span}])}}).out AS picks,
   list(s.span_idx ORDER BY s.span_idx) AS places FROM spans s JOIN j ON j.job_id = s.job_id JOIN top ON top.ref_id = s.ref_clip_id GROUP BY 1),
 g AS (SELECT job_id, unnest(places) AS span_idx, unnest(picks) AS clips FROM f), pick AS (SELECT g.job_id, g.span_idx, unnest(range(1, len(clips) + 1))::int AS rank, unnest(clips) AS clip_id FROM g)"""


@query(_greedy_sql(1) + """ SELECT pick.job_id, pick.span_idx, rank, pick.clip_id, base AS score FROM pick JOIN spans s ON s.job_id = pick.job_id AND s.span_idx = pick.span_idx JOIN base ON base.ref_id = s.ref_clip_id AND base.clip_id = pick.clip_id""")
def wn14_greedy_assignment(spark, sf_dir):
    return G.greedy_lists(_job_lists(spark, sf_dir))


@query()
def wn14_wn16_continuous_assignment(spark, sf_dir):
    """The tax on repeated looks decides the picks; the penalty column says which picks were made in spite of it."""
    styles = _styled(view(spark, sf_dir, "clips")).select("style", "vector")
    return G.continuous(_job_candidates(spark, sf_dir, 2, styled=True), styles, per_span=2)


_STYLE_SQL = """list_concat([(shot_type = x)::int::double for x in ['wide', 'medium', 'close-up', 'extreme-close-up', 'aerial', 'overhead', 'two-shot']], list_concat([(camera_motion = x)::int::double for x in ['static', 'pan', 'tilt', 'dolly', 'handheld', 'tracking', 'zoom']], list_concat([(depth_of_field = 'deep')::int::double, (depth_of_field = 'shallow')::int::double],
  [len([m for m in mood if m IN ('energetic', 'aggressive', 'epic', 'dramatic', 'tense')]) / 2.0, len([m for m in mood if m IN ('calm', 'melancholic', 'romantic', 'nostalgic', 'neutral')]) / 2.0, len([m for m in mood if m IN ('joyful', 'uplifting', 'playful')]) / 2.0])))"""


@query(_greedy_sql(1) + f""", v AS (SELECT p.job_id, p.span_idx, p.clip_id, {_STYLE_SQL} AS v FROM pick p JOIN clips c ON c.clip_id = p.clip_id), b AS (SELECT *, lag(v) OVER w AS one FROM v WINDOW w AS (PARTITION BY job_id ORDER BY span_idx)),
 r AS (SELECT *, sum(CASE WHEN one IS NULL OR v <> one THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY span_idx) AS run FROM b), u AS (SELECT job_id, run, any_value(v) AS v FROM r GROUP BY 1, 2),
 h AS (SELECT r.*, lag(run) OVER (PARTITION BY job_id ORDER BY span_idx) AS before FROM r), m AS (SELECT h.job_id, h.span_idx, h.clip_id, h.v, one IS NOT NULL AS known, [(coalesce(one, h.v)[i] + coalesce(u.v, one, h.v)[i]) / 2 for i in range(1, 20)] AS mean FROM h LEFT JOIN u ON u.job_id = h.job_id AND u.run = h.before - 1)
 SELECT job_id, span_idx, clip_id, CASE WHEN known AND round(list_dot_product(v, mean) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(mean, mean))), 9) >= 0.92 THEN -0.08 ELSE 0.0 END AS penalty FROM m""")
def wn16_continuity(spark, sf_dir):
    clips = view(spark, sf_dir, "clips").select("clip_id", A.style_vector().alias("v"))
    picks = G.greedy_lists(_job_lists(spark, sf_dir)).join(clips, "clip_id")
    return G.continuity_penalty(picks, "v").select("job_id", "span_idx", "clip_id", "penalty")


@query(_greedy_sql(2) + """, l AS (SELECT job_id, span_idx, list(clip_id ORDER BY rank) AS l FROM pick GROUP BY 1, 2) SELECT job_id, span_idx, unnest(range(0, 3))::int AS variation, unnest([l[least(i + 1, len(l))] for i in range(0, 3)]) AS clip_id FROM l""")
def wn18_wn19_variations(spark, sf_dir):
    return G.variations(G.greedy_lists(_job_lists(spark, sf_dir, per_span=2), per_span=2), ["job_id", "span_idx"], 3)


_TWO = duck("clips") + ", " + _BASE_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS rank, lead(base) OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS second FROM base)"""


@query(_TWO + """ SELECT ref_id, clip_id, base AS score, CASE WHEN base < 0.35 THEN 'none' WHEN base >= 0.45 OR round(base - coalesce(second, 0.0), 9) >= 0.05 THEN 'clear' ELSE 'ask' END AS decision FROM r WHERE rank = 1""")
def wn15_confident_pick(spark, sf_dir):
    clips = view(spark, sf_dir, "clips")
    return G.confident(J.best_matches(clips.withColumnRenamed("clip_id", "ref_id"), clips, 2).withColumnRenamed("base", "score"), "ref_id")


@query(duck("clips") + ", " + _BASE_SQL + """, one AS (SELECT ref_id, clip_id, rank, 0 AS rung FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS rank FROM base) WHERE rank <= 2 AND base >= 0.5),
 two AS (SELECT ref_id, clip_id, rank, 1 AS rung FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS rank FROM base WHERE base < 0.5) WHERE rank <= 3), u AS (SELECT * FROM one UNION ALL SELECT * FROM two)
 SELECT ref_id, clip_id, rung, place FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY rung, rank, clip_id) AS place FROM u) WHERE place <= 3""")
def wn17_ladder_fill(spark, sf_dir):
    """Strong matches first, then the best of the weaker ones, up to three rows."""
    clips = view(spark, sf_dir, "clips")
    refs = clips.withColumnRenamed("clip_id", "ref_id")
    rungs = [J.best_matches(refs, clips, 2, least=0.5), J.best_matches(refs, clips, 3, below=0.5)]
    return G.ladder([r.select("ref_id", "clip_id", "rank") for r in rungs], "ref_id", 3).select("ref_id", "clip_id", "rung", "place")
