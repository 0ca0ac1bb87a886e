"""Queries over titles, ranges, parsed documents, caches and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom import schema as S
from cliploom.functions import features as X
from cliploom.functions import titles as T
from cliploom.operators import pairs as Q
from cliploom.operators import scoring as J
from cliploom.operators import search as R
from cliploom.plans.clip_queries import _BASE_SQL, _JN4, _SIDE, _VIBE, _best
from cliploom.plans.registration import query
from cliploom.plans.views import duck, view


_KEYS_SQL = _BASE_SQL.split(",\n base AS")[0]


def _titles(spark, sf_dir):
    pages = view(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    words = F.filter(F.split("t", " "), lambda w: w != "")
    return pages.select("page_id", F.array_join(F.slice(words, 1, 4), " ").alias("a"), F.array_join(F.slice(words, 5, 30), " ").alias("b"), F.slice(words, 2, 3).alias("h"))


_T = "t AS (SELECT page_id, [w for w in string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') if w <> ''] AS w FROM pages), s AS (SELECT page_id, array_to_string(w[1:4], ' ') AS a, array_to_string(w[5:34], ' ') AS b FROM t)"
_CLEAN = lambda x: f"trim(regexp_replace(replace({x}, '.', ''), '\\s+', ' ', 'g'))"


@query(f"""WITH {_T}, c AS (SELECT page_id, {_CLEAN('a')} AS a, {_CLEAN('b')} AS b FROM s), w AS (SELECT *, [x for x in string_split(concat_ws(' ', a, b), ' ') if x <> ''] AS l, len([x for x in string_split(a, ' ') if x <> '']) AS na FROM c),
 k AS (SELECT *, len(l) AS n, greatest(5, (len(l) + 1) // 2) AS cut FROM w)
 SELECT page_id, CASE WHEN n BETWEEN 1 AND 5 THEN left(array_to_string(l, ' '), 48) WHEN b <> '' AND na < 5 THEN array_to_string(l[1:cut], ' ') ELSE a END AS line1,
 CASE WHEN n BETWEEN 1 AND 5 THEN '' WHEN b <> '' AND na < 5 THEN array_to_string(l[cut + 1:], ' ') ELSE b END AS line2 FROM k""")
def pr22_layout(spark, sf_dir):
    return _titles(spark, sf_dir).select("page_id", T.layout(F.col("a"), F.col("b"), F.col("h")).alias("x")).select("page_id", "x.line1", "x.line2")


@query()
def pr23_pr24_highlights(spark, sf_dir):
    """Titles as a model might answer them, under all rules."""
    rows = T.finished(_titles(spark, sf_dir).withColumnsRenamed({"a": "line1", "b": "line2", "h": "highlights"}))
    return rows.select("page_id", "line1", "line2", F.array_join("highlights", "|").alias("highlights"), "hook_word")


@query()
def pr20_templated_titles(spark, sf_dir):
    rows = T.templated_rows(view(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "title.*")
    return T.finished(rows).select("doc_id", "line1", "line2", F.array_join("highlights", "|").alias("highlights"), "hook_word")


@query()
def pr33_routed_titles(spark, sf_dir):
    """A quarter each: typed by hand, after a reference's title, generated with an answer, and without any text."""
    modes = F.array(*map(F.lit, ("manual", "replicate", "auto", "auto")))
    docs = view(spark, sf_dir, "documents").withColumn("kind", (F.col("doc_id") % 4).cast("int"))
    first = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 9)
    docs = docs.select(
        "doc_id", F.get(modes, F.col("kind")).alias("mode"), F.array_join(first, " ").alias("manual"), F.col("lang").alias("pattern"),
        F.when(F.col("kind") == 3, "").otherwise(F.col("text")).alias("text"), F.when(F.col("kind") == 2, F.array_join(F.slice(first, 1, 4), " ")).alias("one"), F.array_join(F.slice(first, 5, 5), " ").alias("two"),
    )
    return T.routed(docs, "mode", "manual", "pattern", "text", "one", "two").select("doc_id", "route", "line1", "line2", F.array_join("highlights", "|").alias("highlights"), "hook_word")


@query(duck("spans") + """, s AS (SELECT job_id, span_idx, start_s, end_s * 1.7 AS end_s, 40.0e0 AS d FROM spans), f AS (SELECT *, greatest(0.0, least(start_s, greatest(0.0, d - 8.0))) AS a FROM s), g AS (SELECT *, greatest(a, least(end_s, d)) AS b FROM f),
 h AS (SELECT *, least(d, greatest(0.0, a + (b - a) / 2 - 7.5) + 15.0) AS w FROM g)
 SELECT job_id, span_idx, round_even(CASE WHEN b - a < 8 THEN greatest(0.0, w - 15.0) ELSE a END, 2) AS start_s, round_even(CASE WHEN b - a < 8 THEN w WHEN b - a > 30 THEN least(d, a + 30.0) ELSE b END, 2) AS end_s FROM h""")
def pr28_widened_ranges(spark, sf_dir):
    start, end = X.widened(F.col("start_s"), F.col("end_s") * 1.7, F.lit(40.0))
    return view(spark, sf_dir, "spans").select("job_id", "span_idx", start.alias("start_s"), end.alias("end_s"))


@query(duck("spans") + """, d AS (SELECT job_id, span_idx, end_s - start_s AS d FROM spans) SELECT job_id, span_idx, round(unnest(CASE WHEN d <= 1.5 THEN [0.0, d * 0.5, greatest(0.0, d - 0.05)] ELSE [d * 0.25, d * 0.5, d * 0.75] END), 6) AS at FROM d""")
def pr29_sample_times(spark, sf_dir):
    rows = view(spark, sf_dir, "spans").select("job_id", "span_idx", F.explode(X.sample_times(F.col("end_s") - F.col("start_s"))).alias("at"))
    return rows.withColumn("at", F.round("at", 6))


@query(_SIDE + f", s AS (SELECT ref_id, clip_id, round({_JN4}, 6) AS score FROM p) SELECT CASE WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'weak' ELSE 'poor' END AS label, count(*) AS n FROM s GROUP BY 1")
def pr30_match_labels(spark, sf_dir):
    clips = view(spark, sf_dir, "clips")
    return Q.label_counts(clips.where("clip_id % 50 = 0"), clips, Q.Component(), X.MATCH_LABELS, X.NO_MATCH)


_STDERR = "(CASE event_type WHEN 'error' THEN 'ERROR: HTTP Error 429' WHEN 'view' THEN 'Sign in to confirm you are not a bot' WHEN 'click' THEN 'could not copy the cookie database' WHEN 'signup' THEN 'cookies are expired' ELSE 'getaddrinfo failed' END)"


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'rate limit' WHEN 'view' THEN 'bot check' WHEN 'click' THEN 'cookie extraction' WHEN 'signup' THEN 'cookie invalid' ELSE 'network' END AS reason FROM events")
def pr31_failure_reasons(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", X.failure_reason(F.expr(_STDERR)).alias("reason"))


@query(duck("clips") + f""" SELECT clip_id, category, CASE WHEN energy = 'low' THEN 'medium' ELSE energy END AS energy, array_to_string([m for m in mood if m <> 'calm'], '|') AS mood, round(contrast, 6) AS contrast, 0.5::double AS motion_intensity FROM clips""")
def pr3_pr4_tolerant_documents(spark, sf_dir):
    """Feature documents written as fenced chat answers, found, parsed and read tolerantly."""
    from cliploom.sources.catalog import json_object

    energy = F.when(F.col("energy") == "low", "tiny").otherwise(F.concat(F.lit(" "), F.upper("energy")))
    mood = F.transform("mood", lambda m: F.when(m == "calm", "serene").otherwise(m))
    clips = view(spark, sf_dir, "clips").select("clip_id", F.to_json(F.struct("category", energy.alias("energy"), mood.alias("mood"), "contrast", F.lit("x").alias("extra"))).alias("j"))
    answers = clips.select("clip_id", F.concat(F.lit("Here:\n```json\n"), "j", F.lit("\n``` done")).alias("answer"))
    kind = "category string, energy string, mood array<string>, contrast double, motion_intensity double"
    parsed = answers.select("clip_id", F.from_json(json_object(F.col("answer")), kind).alias("d"))
    out = {c: X.tolerant(F.col("d"), c) for c in ("category", "energy", "mood", "contrast", "motion_intensity")}
    out["mood"], out["contrast"] = F.array_join(out["mood"], "|"), F.round(out["contrast"], 6)
    return parsed.select("clip_id", *[v.alias(k) for k, v in out.items()])


@query("SELECT conv_id, turn, unnest(range(0, len(l))) AS part, unnest(l) AS body FROM (SELECT conv_id, turn, [trim(x) for x in regexp_split_to_array(role || chr(10) || '---' || chr(10) || text || chr(10) || '###' || chr(10) || role, '\\n\\n---\\n\\n|\\n---\\n|\\n###\\n') if trim(x) <> ''] AS l FROM conversations)")
def pr5_frame_answers(spark, sf_dir):
    from cliploom.sources.catalog import frame_answers

    rows = view(spark, sf_dir, "conversations").withColumn("raw", F.concat("role", F.lit("\n---\n"), "text", F.lit("\n###\n"), "role"))
    return rows.select("conv_id", "turn", F.posexplode(frame_answers(F.col("raw"))).alias("part", "body"))


@query(duck("search_rows") + """, k AS (SELECT DISTINCT substr(sha256(lower(trim(title)) || '|8'), 1, 24) AS key FROM search_rows), c AS (SELECT DISTINCT substr(sha256(lower(trim(title)) || '|8'), 1, 24) AS key FROM search_rows WHERE duration % 2 = 0 AND duration > 0 AND pos % 20 <= 7)
 SELECT k.key, c.key IS NOT NULL AS hit FROM k LEFT JOIN c ON c.key = k.key""")
def io7_jn15_cached_searches(spark, sf_dir):
    rows = view(spark, sf_dir, "search_rows").withColumn("key", X.cache_key("title", 8))
    cache = rows.where("duration % 2 = 0").select("key", (1_000_000_000 - F.col("pos") % 20 * 86400).alias("cached_at"), F.col("duration").alias("results"))
    return R.cached_searches(rows.select("key").distinct(), cache, 1_000_000_000)


@query(_SIDE + f""", {_KEYS_SQL},
 base AS (SELECT a.clip_id AS ref_id, b.clip_id AS clip_id, least(1.0, sum(a.weight) / 8.0) AS base FROM k a JOIN k b ON a.kind = b.kind AND a.value = b.value AND a.clip_id <> b.clip_id WHERE a.clip_id % 50 = 0 GROUP BY 1, 2),
 o AS (SELECT ref_id, clip_id, row_number() OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS rank FROM base WHERE base >= 0.35), v AS (SELECT ref_id, clip_id, round({_VIBE}, 6) AS score FROM p), w AS (SELECT ref_id, clip_id, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, clip_id) AS rank FROM v)
 SELECT coalesce(o.ref_id, w.ref_id) AS ref_id, coalesce(o.rank, w.rank) AS rank, o.clip_id AS old_clip, w.clip_id AS new_clip FROM (SELECT * FROM o WHERE rank <= 3) o FULL OUTER JOIN (SELECT * FROM w WHERE rank <= 3) w ON w.ref_id = o.ref_id AND w.rank = o.rank""")
def jn17_old_and_new(spark, sf_dir):
    clips = view(spark, sf_dir, "clips")
    refs = clips.where("clip_id % 50 = 0").withColumnRenamed("clip_id", "ref_id")
    old = J.best_matches(refs, clips, 3, least=0.35).select("ref_id", "rank", F.col("clip_id").alias("old_clip"))
    new = _best(spark, sf_dir, Q.Vibe(), 3).select("ref_id", "rank", F.col("clip_id").alias("new_clip"))
    return old.join(new, ["ref_id", "rank"], "full_outer")


@query(duck("clips", "spans") + """, t AS (SELECT s.job_id, s.span_idx, c.category FROM spans s JOIN clips c ON c.clip_id = s.ref_clip_id) SELECT job_id, span_idx, CASE WHEN span_idx % 3 = 2 THEN 'other' ELSE category END AS category FROM t""")
def jn18_zipped_tags(spark, sf_dir):
    """Parallel lists of spans and tags, one of them with gaps, zipped back to rows."""
    from cliploom.plans.clip_queries import _span_tags

    tags = _span_tags(spark, sf_dir).withColumn("tag", F.when(F.col("span_idx") % 3 == 2, "").otherwise(F.col("category")))
    lists = tags.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("span_idx", "tag"))).alias("l"))
    zipped = lists.select("job_id", F.posexplode(F.arrays_zip(F.transform("l", lambda x: x["span_idx"]).alias("i"), F.transform("l", lambda x: x["tag"]).alias("c"))).alias("span_idx", "z"))
    return zipped.select("job_id", "span_idx", F.coalesce(F.nullif("z.c", F.lit("")), F.lit("other")).alias("category"))


@query(duck("clips", "spans") + """, t AS (SELECT s.job_id, s.span_idx, CASE WHEN s.span_idx % 2 = 0 THEN '' ELSE c.path END AS q, count(*) OVER (PARTITION BY s.job_id) AS n FROM spans s JOIN clips c ON c.clip_id = s.ref_clip_id)
 SELECT job_id, coalesce(max(q) FILTER (span_idx = n // 2 AND q <> ''), min_by(q, span_idx) FILTER (q <> '')) AS query FROM t GROUP BY 1""")
def ag3_representative(spark, sf_dir):
    from cliploom.plans.clip_queries import _span_tags

    tags = _span_tags(spark, sf_dir).withColumn("q", F.when(F.col("span_idx") % 2 == 0, "").otherwise(F.col("path")))
    lists = tags.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "q"))), lambda x: x["q"]).alias("l"))
    middle = F.nullif(F.get("l", F.floor(F.size("l") / 2).cast("int")), F.lit(""))
    return lists.select("job_id", F.coalesce(middle, F.get(F.filter("l", lambda q: q != ""), F.lit(0))).alias("query"))


@query(duck("clips") + " SELECT clip_id, 'mood=' || array_to_string(mood[1:2], ',') || ' / light=' || lighting || ' / palette=' || array_to_string(color_palette[1:2], ',') || ' / shot=' || shot_type || ' / motion=' || camera_motion AS summary FROM clips")
def pr30_vibe_summary(spark, sf_dir):
    part = lambda key, value: F.when(value != "", F.concat(F.lit(f"{key}="), value))
    lists = lambda c: F.array_join(F.slice(c, 1, 2), ",")
    parts = [part("mood", lists("mood")), part("light", F.col("lighting")), part("palette", lists("color_palette")), part("shot", F.col("shot_type")), part("motion", F.col("camera_motion"))]
    return view(spark, sf_dir, "clips").select("clip_id", F.concat_ws(" / ", *parts).alias("summary"))


@query(duck("job_events") + f", c AS (SELECT stage, count(*) AS n FROM job_events GROUP BY 1) SELECT stage, n FROM c WHERE stage NOT IN {tuple(S.TERMINAL)}")
def fl10_open_stage_counts(spark, sf_dir):
    events = view(spark, sf_dir, "job_events").where(~F.col("stage").isin(*S.TERMINAL))
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
