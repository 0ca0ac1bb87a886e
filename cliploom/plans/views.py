"""Derived views over the given tables: the engine's inputs, in Spark SQL and in DuckDB SQL.

Every view reads its whole table.  The two dialects differ in a few names only, so one text serves
both where it can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CLIPS = """
select p_partkey as clip_id, concat('lib/', lower(p_type), '/', replace(p_name, ' ', '_'), '_', cast(p_partkey as string), '.mp4') as path,
  case p_type when 'ECONOMY' then 'movie' when 'SMALL' then 'sports' when 'MEDIUM' then 'tech' when 'LARGE' then 'lifestyle' when 'PROMO' then 'money' else 'other' end as category,
  split(p_name, ' ') as subjects, array(concat('set', cast(p_size % 7 as string))) as setting, array(concat('act', cast(p_size % 5 as string))) as action,
  case p_partkey % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as energy,
  case p_partkey % 6 when 0 then 'low-key' when 1 then 'high-key' when 2 then 'natural' when 3 then 'neon' when 4 then 'golden-hour' else 'mixed' end as lighting,
  case p_size % 7 when 0 then 'wide' when 1 then 'medium' when 2 then 'close-up' when 3 then 'extreme-close-up' when 4 then 'aerial' when 5 then 'overhead' else 'two-shot' end as shot_type,
  case p_partkey % 7 when 0 then 'static' when 1 then 'pan' when 2 then 'tilt' when 3 then 'dolly' when 4 then 'handheld' when 5 then 'tracking' else 'zoom' end as camera_motion,
  case p_size % 2 when 0 then 'deep' else 'shallow' end as depth_of_field,
  array(case p_partkey % 8 when 0 then 'tense' when 1 then 'uplifting' when 2 then 'mysterious' when 3 then 'epic' when 4 then 'melancholic' when 5 then 'energetic' when 6 then 'calm' else 'aggressive' end,
    case p_size % 8 when 0 then 'romantic' when 1 then 'nostalgic' when 2 then 'ominous' when 3 then 'joyful' when 4 then 'neutral' when 5 then 'dramatic' when 6 then 'playful' else 'sinister' end) as mood,
  array(case p_size % 3 when 0 then 'warm' when 1 then 'cool' else 'neon' end) as color_palette,
  (p_size % 11) / 10.0e0 as palette_warmth, (p_partkey % 11) / 10.0e0 as palette_saturation, (p_partkey % 9) / 10.0e0 as palette_brightness,
  (p_size % 5) / 4.0e0 as motion_intensity, (p_partkey % 5) / 4.0e0 as contrast, (p_size % 4) / 3.0e0 as edge_density, (p_partkey % 17) / 16.0e0 as confidence,
  cast(p_size as bigint) * 1000 as size, 1700000000 + p_partkey as mtime from part
"""
_SPANS = """
select l_orderkey as job_id, cast(n - 1 as int) as span_idx, (n - 1) * 3.0e0 as start_s, (n - 1) * 3.0e0 + 0.5e0 + (cast(l_quantity as int) % 4) as end_s, l_partkey as ref_clip_id
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem) t
"""
_WORDS = """
select doc_id as asset_id, pos, case when pos % 37 = 5 then case (doc_id + pos) % 6 when 0 then 'secret' when 1 then 'why' when 2 then 'never' when 3 then 'million' when 4 then '$3' else 'truth' end else tok end as word,
  pos * 0.4e0 + (pos div 12) * 1.6e0 as start_s, pos * 0.4e0 + (pos div 12) * 1.6e0 + 0.3e0 as end_s from TOKENS where tok <> ''
"""
_SEGMENTS = "select conv_id as asset_id, turn as seg_idx, turn * 6.0e0 as start_s, turn * 6.0e0 + 5.0e0 as end_s, text from conversations"
_FRAMES = """
select video_id, cast(g * 10 + r as int) as frame_idx, case when g % 2 = 0 then first_e else embedding end as feat, (g % 2 = 0) as has_face, (g % 5 <> 3) as visual
from (select video_id, embedding, row_number() over (partition by video_id order by vec_id) - 1 as g, first_value(embedding) over (partition by video_id order by vec_id) as first_e from (select cast(label as bigint) * 1000000 + vec_id div 400 as video_id, vec_id, embedding from embeddings) v) t cross join (RANGE10) rr
"""
_SEARCH = """
select page_id % 5 as query_id, page_id as pos, concat('v', cast(page_id % 120 as string)) as id, case when page_id % 13 = 0 then concat(url, '/shorts/') else url end as url,
  case when page_id % 7 = 0 then concat('Podcast ', regexp_extract(html, '<title>([^<]*)</title>', 1)) else regexp_extract(html, '<title>([^<]*)</title>', 1) end as title, page_id % 200 as duration from pages
"""
_JOB_EVENTS = """
select user_id as job_id, event_id, ts, case event_type when 'signup' then 'ingested' when 'view' then 'analyzing' when 'click' then 'transcribing' when 'purchase' then 'rendering' else 'failed' end as stage from events
"""
_CALLS = """
select user_id as provider, event_id * 10 + r as event_id, ts + r * interval '5' second as ts, case when event_type in ('error', 'signup') then 429 else 200 end as status
from (select * from events) t cross join (RANGE10) rr where r = 0 or (event_type = 'error' and r < 7)
"""
_LEVELS = "select user_id as asset_id, row_number() over (partition by user_id order by ts, event_id) - 1 as sec, value / 100.0e0 as level from events"

TEXTS = {
    "clips": _CLIPS, "spans": _SPANS, "words": _WORDS, "segments": _SEGMENTS, "frames": _FRAMES,
    "search_rows": _SEARCH, "job_events": _JOB_EVENTS, "calls": _CALLS, "levels": _LEVELS,
}
_BASE = {
    "clips": "part", "spans": "lineitem", "words": "documents", "segments": "conversations", "frames": "embeddings",
    "search_rows": "pages", "job_events": "events", "calls": "events", "levels": "events",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a given table of that name."""
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = _BASE[name]
    text = TEXTS[name].replace("TOKENS", "(select doc_id, p as pos, tok from {documents} lateral view posexplode(split(text, '[ \\n]+')) x as p, tok) t")
    text = text.replace("RANGE10", "select explode(sequence(0, 9)) as r")
    text = text.replace(f"from {base}", "from {" + base + "}")
    return spark.sql(text, **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def duck(*names: str) -> str:
    """``WITH`` list of the named views for DuckDB; a query's own tables may follow after a comma."""
    return "WITH " + ", ".join(f"{n} AS ({_duck(TEXTS[n])})" for n in names)


def _duck(text: str) -> str:
    text = text.replace("TOKENS", r"(select doc_id, unnest(range(0, len(l))) as pos, unnest(l) as tok from (select doc_id, regexp_split_to_array(text, '[ \n]+') as l from documents)) t")
    text = text.replace("RANGE10", "select unnest(range(0, 10)) as r").replace("as string)", "as varchar)").replace(" div ", " // ")
    return text.replace("array(", "list_value(").replace("regexp_split_to_list_value(", "regexp_split_to_array(").replace("split(p_name", "string_split(p_name")
