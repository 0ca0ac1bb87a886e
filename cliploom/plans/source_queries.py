"""Queries over sources, indexes, ladders, detections and job summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom import schema as S
from cliploom.operators import ladder as L
from cliploom.operators import media as M
from cliploom.operators import scoring as J
from cliploom.operators import search as R
from cliploom.operators import spans as P
from cliploom.operators import transcripts as T
from cliploom.plans.clip_queries import _BASE_SQL, _older_index
from cliploom.plans.registration import query
from cliploom.plans.views import duck, view
from cliploom.sources import catalog as C
from cliploom.sources.snapshots import Snapshots, shared_folder
from cliploom.streaming import jobs as K


@query()
def io1_so2_media_catalog(spark, sf_dir):
    """The table files below the data folder, named twice and listed once; no file is opened."""
    return C.media_files(spark, sf_dir, sf_dir, suffix=r"\.parquet$").where(~F.col("path").contains("/_")).select("path", "size")


@query(duck("clips") + " SELECT path, mtime, size, clip_id % 6 = 0 AS was_there FROM clips WHERE clip_id % 2 = 1 OR clip_id % 6 = 0")
def io2_io3_io4_index_snapshot(spark, sf_dir):
    """An index of odd clips and of every sixth is published; the paths of all even ones are invalidated, which tells which were there."""
    clips = view(spark, sf_dir, "clips").select("path", "mtime", "size", "clip_id")
    store = Snapshots(spark, shared_folder(spark, "index"), C.INDEX_VERSION)
    store.publish(clips.where("clip_id % 2 = 1 or clip_id % 6 = 0").drop("clip_id"))
    before = store.read(store.live())
    gone = store.invalidate(clips.where("clip_id % 2 = 0").select("path"))
    kept = store.read(store.live()).withColumn("was_there", F.lit(False))
    return kept.unionByName(before.join(gone.where("was_there"), "path"))


@query(duck("segments") + r""", t AS (SELECT asset_id, seg_idx, trim(text) AS text, start_s, end_s FROM segments WHERE trim(text) <> '' AND asset_id % 2 = 0),
 w AS (SELECT asset_id, seg_idx, start_s, greatest(0.1, end_s - start_s) AS l, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM (SELECT *, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] AS w FROM t)),
 c AS (SELECT *, sum(len(word)) OVER (PARTITION BY asset_id, seg_idx ORDER BY pos) AS upto, sum(len(word)) OVER (PARTITION BY asset_id, seg_idx) AS every FROM w),
 s AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY seg_idx, pos) - 1 AS pos, word, round(start_s + l * (upto - len(word)) / every, 5) AS start_s, round(start_s + l * upto / every, 5) AS end_s FROM c),
 o AS (SELECT asset_id, seg_idx AS pos, string_split(trim(text), ' ')[1] AS word, round(start_s, 5) AS start_s, round(end_s, 5) AS end_s FROM segments WHERE asset_id % 2 = 1 AND trim(string_split(trim(text), ' ')[1]) <> '') SELECT * FROM s UNION ALL SELECT * FROM o""")
def io5_wn9_transcript_ingest(spark, sf_dir):
    """Transcripts as JSON, half of them with words; the others' words are timed from their segments."""
    rows = view(spark, sf_dir, "segments")
    segment = F.struct("text", F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    first = F.get(F.split(F.trim("text"), " "), F.lit(0))
    word = F.when(F.col("asset_id") % 2 == 1, F.struct(first.alias("word"), F.col("start_s").alias("start"), F.col("end_s").alias("end")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", c.alias("x")))), lambda v: v["x"])
    made = rows.groupBy("asset_id").agg(ordered(segment).alias("segments"), F.filter(ordered(word), lambda w: w.isNotNull()).alias("words"))
    raw = made.select("asset_id", F.to_json(F.struct("segments", "words")).alias("value"))
    timed = C.timed_words(*C.transcript_rows(raw))
    return timed.select("asset_id", F.col("pos").cast("long").alias("pos"), "word", F.round("start_s", 5).alias("start_s"), F.round("end_s", 5).alias("end_s"))


@query(duck("search_rows") + " SELECT pos, id, CASE pos % 3 WHEN 0 THEN url WHEN 1 THEN 'w' || url ELSE 'https://www.youtube.com/watch?v=' || id END AS url, title, duration::double AS duration FROM search_rows WHERE pos % 10 <> 9")
def io6_search_lines(spark, sf_dir):
    """Search results as JSON lines: urls under three names or none, every tenth line broken."""
    rows = view(spark, sf_dir, "search_rows").withColumn("n", F.col("pos") % 3)
    fields = F.struct("id", F.when(F.col("n") == 0, F.col("url")).alias("url"), F.when(F.col("n") == 1, F.concat(F.lit("w"), "url")).alias("webpage_url"), "title", F.col("duration").cast("double").alias("duration"))
    value = F.when(F.col("pos") % 10 == 9, F.lit("warning: {")).otherwise(F.to_json(fields))
    # The position travels inside the title, for lines have no other key.
    lines = rows.select(F.replace(value, F.lit('"title":"'), F.concat(F.lit('"title":"'), F.col("pos").cast("string"), F.lit("\t".encode("unicode_escape").decode()))).alias("value"))
    parts = F.split("title", "\t", 2)
    return C.search_lines(lines).select(F.get(parts, F.lit(0)).cast("long").alias("pos"), "id", "url", F.get(parts, F.lit(1)).alias("title"), "duration")


@query(duck("job_events") + " SELECT job_id, arg_max(stage, (ts, event_id)) AS status, count(*) AS events FROM job_events GROUP BY 1")
def io8_job_documents(spark, sf_dir):
    """Job documents written as JSON and read back, a broken one among them."""
    jobs = view(spark, sf_dir, "job_events").groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("events"))
    path = shared_folder(spark, "jobs")
    text = jobs.select(F.to_json(F.struct("job_id", "status", "events")).alias("value"))
    text.unionByName(jobs.limit(1).select(F.lit('{"job_id": broken').alias("value"))).write.text(path)
    return C.job_documents(spark, path, "job_id long, status string, events long")


_ASSETS = """a AS (SELECT clip_id AS asset_id, path, size, CASE WHEN clip_id % 4 = 0 THEN 'b/c:' || clip_id ELSE 'f' || clip_id || '.MOV' END AS name FROM clips)"""


@query(duck("clips") + ", " + _ASSETS + """, d AS (SELECT *, asset_id % 9 AS share FROM a), o AS (SELECT * FROM d WHERE share % 3 <> 1),
 f AS (SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'b_c_' || asset_id || '.mp4' ELSE name END AS file, CASE WHEN asset_id % 5 = 0 THEN NULL ELSE 'big' || asset_id END AS url, size * 10 AS big FROM o)
 SELECT asset_id, file, url, CASE WHEN url IS NULL THEN 'none' WHEN asset_id % 2 = 0 AND abs(big - (big + asset_id % 3 * 1000)) < 1024 THEN 'skip' ELSE 'download' END AS action FROM f""")
def io9_share_sync(spark, sf_dir):
    """Nine shares, of which those synced an hour ago are left alone; of each asset the largest ready transcode."""
    clips = view(spark, sf_dir, "clips")
    shares = clips.select((F.col("clip_id") % 9).alias("share")).distinct().withColumn("synced_at", F.when(F.col("share") % 3 == 0, F.lit(None)).when(F.col("share") % 3 == 1, 1_700_000_000 - 3600).otherwise(1_700_000_000 - 43200))
    due = C.due_shares(shares, 1_700_000_000)
    item = lambda status, url, size: F.struct(F.lit(status).alias("status"), url.alias("url"), size.cast("long").alias("filesize"))
    none = F.lit(None).cast("string")
    failed = F.array(item("FAILED", F.lit("x"), F.col("size") * 99), item("SUCCESS", none, F.col("size") * 98))
    ready = F.concat(failed, F.array(item("SUCCESS", F.concat(F.lit("small"), "clip_id"), F.col("size")), item("SUCCESS", F.concat(F.lit("big"), "clip_id"), F.col("size") * 10)))
    name = F.when(F.col("clip_id") % 4 == 0, F.concat(F.lit("b/c:"), "clip_id")).otherwise(F.concat(F.lit("f"), "clip_id", F.lit(".MOV")))
    assets = clips.withColumn("share", F.col("clip_id") % 9).join(due, "share", "left_semi").select(F.col("clip_id").alias("asset_id"), name.alias("name"), F.when(F.col("clip_id") % 5 == 0, failed).otherwise(ready).alias("transcodes"))
    safe = F.when(F.col("clip_id") % 4 == 0, F.concat(F.lit("b_c_"), "clip_id", F.lit(".mp4"))).otherwise(name)
    local = clips.where("clip_id % 2 = 0").select(safe.alias("name"), (F.col("size") * 10 + F.col("clip_id") % 3 * 1000).alias("size"))
    return C.sync_plan(assets, local)


@query(duck("clips") + """ SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN '' ELSE lighting END AS lighting, category, array_to_string([lower(trim(x)) for x in subjects if trim(x) <> ''][1:3], '|') AS subjects, array_to_string([m for m in mood if clip_id % 2 = 0][1:3], '|') AS mood FROM clips""")
def pr6_scene_tags(spark, sf_dir):
    """Tag answers with odd spellings and unknown words; a mood that came as one word is a list of it."""
    clips = view(spark, sf_dir, "clips")
    fields = F.struct(
        F.when(F.col("clip_id") % 3 == 0, "moonlight").otherwise(F.concat(F.lit(" "), F.upper("lighting"))).alias("lighting"), F.upper("category").alias("category"),
        F.concat(F.array(F.lit(" ")), F.transform("subjects", lambda s: F.concat(s, F.lit(" ")))).alias("subjects"),
        F.when(F.col("clip_id") % 2 == 0, F.transform("mood", lambda m: F.upper(m))).otherwise(F.array(F.lit("sleepy"))).alias("mood"),
    )
    rows = clips.select("clip_id", fields.alias("f"))
    tag = lambda n: M.scene_tag(F.col("f"), n)
    return rows.select("clip_id", tag("lighting").alias("lighting"), tag("category").alias("category"), F.array_join(tag("subjects"), "|").alias("subjects"), F.array_join(tag("mood"), "|").alias("mood"))


@query(duck("clips") + """ SELECT clip_id, array_to_string([w for w in string_split(CASE WHEN clip_id % 3 = 0 THEN CASE WHEN category = 'other' THEN 'b roll' ELSE category END || ' ' || array_to_string(action, ' ') ELSE array_to_string(subjects[1:3], ' ') || ' ' || array_to_string(setting[1:2], ' ') || ' query text' END, ' ') if w <> ''][1:8], ' ') AS query FROM clips""")
def pr10_legacy_queries(spark, sf_dir):
    empty = F.array().cast("array<string>")
    bare = F.col("clip_id") % 3 == 0
    rows = view(spark, sf_dir, "clips").withColumns({"query": F.when(bare, "").otherwise("query text"), "subjects": F.when(bare, empty).otherwise(F.col("subjects")), "setting": F.when(bare, empty).otherwise(F.col("setting"))})
    return rows.select("clip_id", M.legacy_query().alias("query"))


@query(duck("spans", "job_events") + """, d AS (SELECT job_id, stage, ts, event_id, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS s FROM job_events),
 t AS (SELECT job_id, string_agg(stage || '=' || printf('%.1f', s), ',' ORDER BY stage) AS timings FROM (SELECT job_id, stage, round(sum(s), 1) AS s FROM d WHERE s IS NOT NULL GROUP BY 1, 2) GROUP BY 1), l AS (SELECT job_id, arg_max(stage, (ts, event_id)) AS status FROM job_events GROUP BY 1),
 i AS (SELECT job_id, string_agg('/outputs/' || job_id || '/' || span_idx || '_1.mp4', ',' ORDER BY span_idx) AS urls FROM spans GROUP BY 1)
 SELECT l.job_id, status, coalesce(urls, '') AS urls, array_to_string(['/outputs/' || l.job_id || '/v' || v || '.mp4' for v in range(1, l.job_id % 4 + 1)], ',') AS variation_urls, CASE WHEN status = 'failed' THEN 0.0 ELSE 7.5 END AS eta_s, coalesce(timings, '') AS timings FROM l LEFT JOIN i ON i.job_id = l.job_id LEFT JOIN t ON t.job_id = l.job_id""")
def pr34_job_summaries(spark, sf_dir):
    events = view(spark, sf_dir, "job_events")
    order = P.W.partitionBy("job_id").orderBy("ts", "event_id")
    # A difference of seconds, as in the SQL: it may fall on the other side of half a tenth than one of microseconds.
    at = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    seconds = at(F.lead("ts").over(order)) - at(F.col("ts"))
    spent = events.withColumn("s", seconds).where("s is not null").groupBy("job_id", "stage").agg(F.sum("s").alias("s"))
    timings = spent.groupBy("job_id").agg(F.collect_list(F.struct("stage", F.col("s").alias("seconds"))).alias("timings"))
    last = events.groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("status"))
    items = view(spark, sf_dir, "spans").groupBy("job_id").agg(F.collect_list(F.struct(F.col("span_idx").alias("span_index"), F.lit(1).alias("rank"))).alias("items"))
    none = F.array().cast("array<struct<span_index:int,rank:int>>")
    jobs = last.join(items, "job_id", "left").join(timings, "job_id", "left").withColumns({"items": F.coalesce("items", none), "timings": F.coalesce("timings", F.array().cast("array<struct<stage:string,seconds:double>>")), "variations": (F.col("job_id") % 4).cast("int"), "eta_s": F.lit(7.5), "warning": F.lit(None).cast("string")})
    made = M.job_summary(jobs)
    entries = F.array_sort(F.transform(F.map_entries("timings"), lambda e: F.format_string("%s=%.1f", e["key"], e["value"])))
    return made.select("job_id", "status", F.array_join("urls", ",").alias("urls"), F.array_join("variation_urls", ",").alias("variation_urls"), "eta_s", F.array_join(entries, ",").alias("timings"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ab' || page_id || '-X' WHEN 1 THEN 'q' || page_id WHEN 2 THEN 'p' || page_id END AS share FROM pages")
def pr35_share_ids(spark, sf_dir):
    tail = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/share/ab"), "page_id", F.lit("-X/reviews"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/r/q"), "page_id")).when(F.col("page_id") % 4 == 2, F.concat(F.lit("/presentations/p"), "page_id", F.lit("?x=1"))).otherwise("/folder/z")
    return view(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://host.example"), tail).alias("url")).select("page_id", C.share_id("url").alias("share"))


_LOCAL = _BASE_SQL + """, loc AS (SELECT s.job_id, s.span_idx, b.clip_id, b.base, row_number() OVER (PARTITION BY s.job_id, s.span_idx ORDER BY b.base DESC, b.clip_id) AS rank FROM spans s JOIN base b ON b.ref_id = s.ref_clip_id),
 sr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM (SELECT query_id, id, min(pos) AS pos FROM search_rows WHERE duration = 0 OR duration BETWEEN 3 AND 150 GROUP BY 1, 2)),
 sp AS (SELECT job_id, span_idx, ref_clip_id, end_s - start_s AS length_s FROM spans)"""


def _rungs(spark, sf_dir, k, least):
    """Spans with their lengths, the best library clips of each, and a search by the span's query."""
    clips = view(spark, sf_dir, "clips")
    spans = view(spark, sf_dir, "spans").withColumn("length_s", F.col("end_s") - F.col("start_s")).select("job_id", "span_idx", "ref_clip_id", "length_s")
    best = J.best_matches(clips.withColumnRenamed("clip_id", "ref_clip_id"), clips, k, "ref_clip_id", least=least)
    local = spans.join(best, "ref_clip_id").select("job_id", "span_idx", F.concat(F.lit("clip"), "clip_id").alias("item"), "rank", F.col("base").alias("score"))
    ok = view(spark, sf_dir, "search_rows").where("duration = 0 or duration between 3 and 150").groupBy("query_id", F.col("id").alias("item")).agg(F.min("pos").alias("pos"))
    results = ok.withColumn("rank", F.row_number().over(P.W.partitionBy("query_id").orderBy("pos"))).where(F.col("rank") <= k)

    def search(open_):
        asked = open_.select("job_id", "span_idx").join(spans, ["job_id", "span_idx"]).withColumn("query_id", F.col("ref_clip_id") % 5)
        return asked.join(results, "query_id").select("job_id", "span_idx", "item", "rank")

    return spans, local, search


@query(duck("clips", "spans", "search_rows") + ", " + _LOCAL + """, m AS (SELECT * FROM loc WHERE base >= 0.6 AND rank <= 3), n AS (SELECT sp.*, count(m.clip_id) AS have FROM sp LEFT JOIN m ON m.job_id = sp.job_id AND m.span_idx = sp.span_idx GROUP BY ALL),
 u AS (SELECT job_id, span_idx, 0 AS step, rank, 'clip' || clip_id AS item, 'local' AS rung FROM m UNION ALL SELECT n.job_id, n.span_idx, 1, sr.rank, sr.id, 'search' FROM n JOIN sr ON sr.query_id = n.ref_clip_id % 5 AND sr.rank <= 3 - have WHERE have < 3 AND length_s >= 1.0
  UNION ALL SELECT job_id, span_idx, 2, 1, 'crop', 'reference_crop' FROM sp), r AS (SELECT *, row_number() OVER (PARTITION BY job_id, span_idx ORDER BY step, rank) AS place FROM u) SELECT job_id, span_idx, place AS rank, item, rung FROM r WHERE place <= 3""")
def wn17_wn19_packs(spark, sf_dir):
    spans, local, search = _rungs(spark, sf_dir, 3, 0.6)
    return L.pack(spans.select("job_id", "span_idx", "length_s"), local, search, 3, ["job_id", "span_idx"])


@query(duck("clips", "spans", "search_rows") + ", " + _LOCAL + """, t AS (SELECT * FROM loc WHERE rank <= 2), g AS (SELECT job_id, span_idx, max(base) AS best, count(*) AS have FROM t GROUP BY 1, 2 HAVING max(base) >= 0.45),
 m AS (SELECT t.* FROM t JOIN g ON g.job_id = t.job_id AND g.span_idx = t.span_idx), n AS (SELECT sp.*, coalesce(g.have, 0) AS have, coalesce(g.best, 0.0) AS best FROM sp LEFT JOIN g ON g.job_id = sp.job_id AND g.span_idx = sp.span_idx),
 x AS (SELECT n.job_id, n.span_idx, sr.id FROM n JOIN sr ON sr.query_id = n.ref_clip_id % 5 AND sr.rank = 1 WHERE have < 3 AND length_s >= 1.0 AND best < 0.45 * 1.5),
 u AS (SELECT job_id, span_idx, 0 AS step, rank, 'clip' || clip_id AS item, 'local' AS rung FROM m UNION ALL SELECT job_id, span_idx, 1, 1, id, 'search' FROM x UNION ALL SELECT n.job_id, n.span_idx, 2, 1, 'crop', 'reference_crop' FROM n LEFT JOIN x ON x.job_id = n.job_id AND x.span_idx = n.span_idx WHERE have = 0 AND x.id IS NULL),
 l AS (SELECT job_id, span_idx, list([item, rung] ORDER BY step, rank) AS l FROM u GROUP BY 1, 2) SELECT job_id, span_idx, unnest(range(1, 4))::int AS rank, unnest([l[least(i, len(l))][1] for i in range(1, 4)]) AS item, unnest([l[least(i, len(l))][2] for i in range(1, 4)]) AS rung FROM l""")
def wn17_wn18_pools(spark, sf_dir):
    spans, local, search = _rungs(spark, sf_dir, 2, 0.0)
    return L.pool(spans.select("job_id", "span_idx", "length_s"), local, search, 3, ["job_id", "span_idx"], threshold=0.45)


@query(duck("clips", "search_rows") + ", " + _BASE_SQL + """, one AS (SELECT ref_id, 'clip' || clip_id AS item, base AS score, 'library' AS rung FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS r FROM base) WHERE r <= 5 AND base >= 0.55),
 open1 AS (SELECT clip_id AS ref_id, category FROM clips WHERE clip_id NOT IN (SELECT ref_id FROM one)), two AS (SELECT ref_id, item, score, 'search' AS rung FROM (SELECT ref_id, id AS item, round(CASE WHEN pos % 2 = 0 THEN 0.9 ELSE 0.3 END, 6) AS score, row_number() OVER (PARTITION BY ref_id ORDER BY pos) AS r FROM open1 JOIN (SELECT query_id, id, min(pos) AS pos FROM search_rows GROUP BY 1, 2) s ON s.query_id = ref_id % 7) WHERE r <= 2 AND score >= 0.5)
 SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT ref_id, NULL, 0.0, 'reference_crop' FROM open1 WHERE ref_id NOT IN (SELECT ref_id FROM two)""")
def fl4_wn17_first_rung(spark, sf_dir):
    """Library matches from 0.55, else search results from 0.50, else a placeholder; queries 5 and 6 find nothing."""
    clips = view(spark, sf_dir, "clips")
    rows = view(spark, sf_dir, "search_rows").groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    first = rows.withColumn("r", F.row_number().over(P.W.partitionBy("query_id").orderBy("pos"))).where("r <= 2")

    def library(open_):
        refs = clips.withColumnRenamed("clip_id", "ref_id").join(open_, "ref_id", "left_semi")
        return J.best_matches(refs, clips, 5).select("ref_id", F.concat(F.lit("clip"), "clip_id").alias("item"), F.col("base").alias("score"))

    def search(open_):
        asked = open_.withColumn("query_id", F.col("ref_id") % 7)
        return asked.join(first, "query_id").select("ref_id", F.col("id").alias("item"), F.when(F.col("pos") % 2 == 0, 0.9).otherwise(0.3).alias("score"))

    return L.first_rung(clips.select(F.col("clip_id").alias("ref_id")), "ref_id", [("library", 0.55, library), ("search", 0.50, search)])


@query(duck("clips", "spans") + ", " + _BASE_SQL.replace("FROM clips", "FROM free").replace("k AS (", "used AS (SELECT DISTINCT ref_clip_id AS clip_id FROM spans WHERE job_id % 10 = 1), free AS (SELECT * FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM used)), k AS (", 1) + " SELECT ref_id, clip_id, base, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS rank FROM base) WHERE rank <= 3")
def fl5_unused_matches(spark, sf_dir):
    """Best matches among clips that no earlier job has used; used ones are left out before anything is scored."""
    used = view(spark, sf_dir, "spans").where("job_id % 10 = 1").select(F.col("ref_clip_id").alias("clip_id")).distinct()
    free = view(spark, sf_dir, "clips").join(used, "clip_id", "left_anti")
    return J.best_matches(free.withColumnRenamed("clip_id", "ref_id"), free, 3)


_METRICS = """m AS (SELECT vec_id, label, abs(embedding[1]::double) * 4 AS lit, abs(embedding[2]::double) * 200 AS mean, abs(embedding[3]::double) * 100 AS std, abs(embedding[4]::double) / 10 AS edges FROM embeddings)"""


def _metrics(spark, sf_dir):
    at = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    return view(spark, sf_dir, "embeddings").select("vec_id", "label", (at(0) * 4).alias("lit"), (at(1) * 200).alias("mean"), (at(2) * 100).alias("std"), (at(3) / 10).alias("edges"))


@query("WITH " + _METRICS + " SELECT vec_id, (lit > 0.28 AND mean > 20 AND (std > 12 OR edges > 0.01)) OR (lit > 0.1 AND std > 14 AND edges > 0.018) AS energetic FROM m")
def fl7_visual_energy(spark, sf_dir):
    return _metrics(spark, sf_dir).select("vec_id", M.visual_energy(*[F.col(c) for c in ("lit", "mean", "std", "edges")]).alias("energetic"))


@query(duck("spans") + " SELECT job_id, span_idx FROM spans WHERE least(end_s, 9.0) - start_s >= 0.08 AND start_s < 9.0")
def fl8_renderable_cuts(spark, sf_dir):
    return view(spark, sf_dir, "spans").where(M.renderable(F.col("start_s"), F.col("end_s"), F.lit(9.0))).select("job_id", "span_idx")


@query(duck("clips") + " SELECT clip_id FROM clips WHERE clip_id % 4 = 3")
def jn8_live_tags(spark, sf_dir):
    """Tags of four prompt versions, of which the last is live."""
    tags = view(spark, sf_dir, "clips").select("clip_id", (F.col("clip_id") % 4).alias("prompt_version"))
    return M.live_tags(tags, 3).select("clip_id")


@query("""WITH b AS (SELECT label AS clip_id, vec_id // 2 AS frame, vec_id, abs(embedding[1]::double) AS x, abs(embedding[2]::double) AS y, abs(embedding[3]::double) + 0.01 AS w, abs(embedding[4]::double) + 0.01 AS h FROM embeddings),
 l AS (SELECT clip_id, frame, arg_max({'x': x, 'y': y, 'w': w, 'h': h}, w * h) AS b FROM b GROUP BY 1, 2)
 SELECT clip_id, round(least(1.0, greatest(0.0, sum((b.x + b.w / 2) * b.w * b.h) / sum(b.w * b.h))), 6) AS x, round(least(1.0, greatest(0.0, sum((b.y + b.h / 2) * b.w * b.h) / sum(b.w * b.h))), 6) AS y FROM l GROUP BY 1""")
def ag12_face_centres(spark, sf_dir):
    at = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    boxes = view(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), F.floor(F.col("vec_id") / 2).alias("frame"), at(0).alias("x"), at(1).alias("y"), (at(2) + 0.01).alias("w"), (at(3) + 0.01).alias("h"))
    return M.face_centre(boxes).select("clip_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(duck("job_events") + """, e AS (SELECT job_id, 'error ' || event_id % 4 AS error, min((ts, event_id)) AS pos FROM job_events WHERE stage = 'failed' GROUP BY 1, 2)
 SELECT job_id, arg_min(error, pos) AS first_error, count(*) AS different, string_agg(error, '|' ORDER BY pos) AS errors, 'warning' AS outcome FROM e GROUP BY 1""")
def ag15_error_summaries(spark, sf_dir):
    failed = view(spark, sf_dir, "job_events").where("stage = 'failed'")
    errors = failed.select("job_id", F.concat(F.lit("error "), F.col("event_id") % 4).alias("error"), F.struct("ts", "event_id").alias("pos"))
    return M.error_summary(errors).withColumn("errors", F.array_join("errors", "|"))


@query("WITH " + _METRICS + """, g AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE lit END AS lit, CASE WHEN vec_id % 5 = 0 THEN mean / 40 END AS mean, std / 50 AS std, edges * 20 AS edges, CASE WHEN label < 0 THEN lit END AS none FROM m)
 SELECT label AS video_id, round(least(1.0, coalesce(avg(lit), 0.0)), 6) AS lit, round(least(1.0, coalesce(avg(mean), 0.0)), 6) AS mean, round(least(1.0, coalesce(avg(std), 0.0)), 6) AS std, round(least(1.0, coalesce(avg(edges), 0.0)), 6) AS edges, round(coalesce(avg(none), 0.0), 6) AS none FROM g GROUP BY 1""")
def ag11_metric_means(spark, sf_dir):
    """Five metrics, two of them absent in many frames and one in all."""
    rows = _metrics(spark, sf_dir).select(
        F.col("label").alias("video_id"), F.when(F.col("vec_id") % 3 != 0, F.col("lit")).alias("lit"), F.when(F.col("vec_id") % 5 == 0, F.col("mean") / 40).alias("mean"),
        (F.col("std") / 50).alias("std"), (F.col("edges") * 20).alias("edges"), F.when(F.col("label") < 0, F.col("lit")).alias("none"),
    )
    return P.metric_means(rows, ["lit", "mean", "std", "edges", "none"])


@query("""WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS r, unnest(embedding)::double * 400 + CASE WHEN vec_id % 4 = 0 THEN 500 ELSE 0 END AS m FROM embeddings), i AS (SELECT vec_id, r, r - row_number() OVER (PARTITION BY vec_id ORDER BY r) AS g FROM e WHERE m > 20),
 q AS (SELECT vec_id, min(r) AS a, count(*) AS n FROM i GROUP BY vec_id, g), b AS (SELECT vec_id, a, n, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, a) AS k FROM q), h AS (SELECT vec_id AS clip_id, a / 64.0 AS top, n / 64.0 AS height FROM b WHERE k = 1)
 SELECT clip_id, round(top, 4) AS top, round(height, 4) AS height FROM h WHERE height >= 0.1 AND NOT (height >= 0.9 AND top <= 0.05)""")
def wn6_content_bands(spark, sf_dir):
    """Row means of pictures of 64 rows; every fourth is bright all over and has no bars."""
    rows = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.posexplode("embedding").alias("row", "v"))
    mean = F.col("v").cast("double") * 400 + F.when(F.col("clip_id") % 4 == 0, 500).otherwise(0)
    return P.content_band(rows.select("clip_id", "row", mean.alias("mean")), least=0.1)


@query(duck("clips") + """, idx AS (SELECT path, CASE WHEN clip_id % 7 = 0 THEN mtime - 5 ELSE mtime END AS mtime, CASE WHEN clip_id % 11 = 0 THEN size + 1 ELSE size END AS size FROM clips WHERE clip_id % 5 <> 0),
 a AS (SELECT c.clip_id, coalesce(i.mtime = c.mtime AND i.size = c.size, false) AS hit FROM clips c LEFT JOIN idx i ON i.path = c.path)
 SELECT count(*) AS total, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit AND clip_id % 3 = 0) AS extracted, count(*) FILTER (hit OR clip_id % 3 = 0) AS indexed, count(*) FILTER (NOT hit AND clip_id % 3 = 1) AS skipped, count(*) FILTER (NOT hit AND clip_id % 3 = 2) AS failed FROM a""")
def ag10_ud1_index_report(spark, sf_dir):
    """What an extractor made of the misses: a third came back, a third was left out, a third failed."""
    clips = view(spark, sf_dir, "clips")
    actions = C.index_actions(clips, _older_index(clips))
    misses = actions.where("action <> 'hit'").select("path", "clip_id")
    made = misses.where("clip_id % 3 <> 1").select("path", F.when(F.col("clip_id") % 3 == 2, "no frame").alias("error"))
    return C.index_report(actions, made)


@query(duck("clips") + ", " + _BASE_SQL + """, t AS (SELECT ref_id, clip_id, row_number() OVER (PARTITION BY ref_id ORDER BY base DESC, clip_id) AS rank FROM base WHERE ref_id % 50 = 0),
 l AS (SELECT t.ref_id, list(c.path ORDER BY rank) AS paths FROM t JOIN clips c ON c.clip_id = t.clip_id WHERE rank <= 3 GROUP BY 1)
 SELECT ref_id, CASE WHEN len(paths[1]) % 4 = 0 THEN NULL ELSE paths[list_position([len(p) for p in paths], list_min([len(p) for p in paths]))] END AS pick, CASE WHEN len(paths[1]) % 4 = 0 THEN 'none' ELSE 'picked' END AS outcome FROM l""")
def ud1_jn15_chosen(spark, sf_dir):
    """A chooser that takes the shortest path, or none; asked once per query and paths, its answers stored."""
    clips = view(spark, sf_dir, "clips")
    refs = clips.where("clip_id % 50 = 0").withColumnRenamed("clip_id", "ref_id")
    best = J.best_matches(refs, clips, 3).join(clips.select("clip_id", "path"), "clip_id")
    paths = best.groupBy("ref_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    asked = paths.join(refs.select("ref_id", F.col("path").alias("query")), "ref_id")
    store = Snapshots(spark, shared_folder(spark, "picks"))

    def shortest(frame):
        return [None if len(p[0]) % 4 == 0 else int(min(range(len(p)), key=lambda i: (len(p[i]), i))) for p in frame["paths"]]

    none = spark.createDataFrame([], "digest string, value string")
    return R.chosen(asked, none, "m1", shortest, lambda new: store.read(store.publish(new))).select("ref_id", "pick", "outcome")


_PROFILE = """x AS (SELECT job_id, span_idx, start_s, end_s, max(end_s) OVER (PARTITION BY job_id) + 2.0 AS duration, CASE WHEN span_idx % 3 = 0 THEN '' ELSE 'q' || ref_clip_id % 20 END AS query FROM spans)"""


@query(duck("spans") + ", " + _PROFILE + """, g AS (SELECT *, lead(start_s) OVER (PARTITION BY job_id ORDER BY span_idx) - end_s AS gap FROM x),
 r AS (SELECT job_id, count(*) / max(duration) * 30.0 AS per_30s, avg(greatest(0.0, end_s - start_s)) AS length, min_by(start_s, span_idx) AS first_start, coalesce(avg(gap), 0.0) AS gap FROM g GROUP BY 1)
 SELECT 'average' AS kind, 'per_30s' AS name, count(*) AS count, round(sum(per_30s), 4) AS total FROM r UNION ALL SELECT 'average', 'length', count(*), round(sum(length), 4) FROM r UNION ALL SELECT 'average', 'first_start', count(*), round(sum(first_start), 4) FROM r UNION ALL SELECT 'average', 'gap', count(*), round(sum(gap), 4) FROM r
 UNION ALL SELECT 'query', query, count(*), 0.0 FROM x WHERE query <> '' GROUP BY 2 UNION ALL SELECT 'placement', printf('%.2f', round_even(least(1.0, start_s / duration), 2)) || ',' || printf('%.2f', round_even(least(1.0, (end_s - start_s) / duration), 2)), count(*), 0.0 FROM x GROUP BY 2""")
def ss5_profile_upsert(spark, sf_dir):
    """The running profile after two batches of jobs, each published as a snapshot."""
    spans = view(spark, sf_dir, "spans")
    spans = spans.join(spans.groupBy("job_id").agg((F.max("end_s") + 2.0).alias("duration")), "job_id")
    query_ = F.when(F.col("span_idx") % 3 == 0, "").otherwise(F.concat(F.lit("q"), F.col("ref_clip_id") % 20))
    rows = spans.select(F.col("job_id").alias("ref"), F.col("span_idx").alias("n"), "start_s", "end_s", query_.alias("query"), "duration")
    store = Snapshots(spark, shared_folder(spark, "profile"))
    store.publish(K.profile_update(None, rows.where("ref % 2 = 0")), tag=0)
    live = store.live()
    store.publish(K.profile_update(store.read(live), rows.where("ref % 2 = 1")), tag=1)
    return store.read(store.live()).withColumn("total", F.round("total", 4))


@query(duck("clips") + " SELECT clip_id, path FROM clips WHERE clip_id % 5 = 0 OR clip_id % 7 = 0 OR clip_id % 11 = 0")
def ss6_index_stream(spark, sf_dir):
    """A stream over the catalog's file against an older index: only new and changed clips come out."""
    clips = view(spark, sf_dir, "clips")
    old, out, check = _older_index(clips), shared_folder(spark, "extracted"), shared_folder(spark, "checkpoint")
    files = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/part.parquet").schema).option("pathGlobFilter", "part.parquet").parquet(sf_dir)
    listed = files.selectExpr("p_partkey as clip_id").join(clips.select("clip_id", "path", "mtime", "size"), "clip_id")
    query_ = K.index_stream(listed, lambda: old, lambda rows: rows, lambda rows: rows.select("clip_id", "path").write.mode("append").parquet(out))
    query_.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("clip_id long, path string").parquet(out)


@query(duck("words") + """, d AS (SELECT asset_id, max(end_s) + CASE WHEN asset_id % 2 = 0 THEN 9.0 ELSE 0.2 END AS duration FROM words GROUP BY 1), a AS (SELECT asset_id, start_s, end_s, pos, 0 AS last FROM words UNION ALL SELECT asset_id, duration, duration, NULL, 1 FROM d),
 g AS (SELECT asset_id, coalesce(max(end_s) OVER (PARTITION BY asset_id ORDER BY last, start_s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS gap_start, start_s AS gap_end FROM a)
 SELECT asset_id, round(gap_start, 6) AS gap_start, round(gap_end, 6) AS gap_end FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY round(gap_end - gap_start, 6) DESC, gap_start) AS r FROM g WHERE gap_end - gap_start >= 1.5) WHERE r = 1""")
def wn7_gaps_with_tails(spark, sf_dir):
    """Longest gaps when every other asset goes on for nine seconds behind its last word."""
    words = view(spark, sf_dir, "words")
    lengths = words.groupBy("asset_id").agg(F.max("end_s").alias("e")).select("asset_id", (F.col("e") + F.when(F.col("asset_id") % 2 == 0, 9.0).otherwise(0.2)).alias("duration"))
    return T.longest_gap(words, lengths=lengths).select("asset_id", F.round("gap_start", 6).alias("gap_start"), F.round("gap_end", 6).alias("gap_end"))


@query(duck("words", "segments") + """, d AS (SELECT asset_id, max(end_s) AS duration FROM segments GROUP BY 1), f AS (SELECT asset_id, min(start_s + 0.7) AS first FROM words WHERE asset_id % 2 = 0 GROUP BY 1)
 SELECT d.asset_id, CASE WHEN first IS NULL THEN least(duration, 3.5) WHEN first BETWEEN 0.5 AND 3.5 THEN round(first, 6) END AS lead_end FROM d LEFT JOIN f ON f.asset_id = d.asset_id""")
def wn8_lead_in_without_words(spark, sf_dir):
    """Lead-ins of all conversations; those with odd ids have no words."""
    words = view(spark, sf_dir, "words").where("asset_id % 2 = 0").withColumn("start_s", F.col("start_s") + 0.7)
    lengths = view(spark, sf_dir, "segments").groupBy("asset_id").agg(F.max("end_s").alias("duration"))
    return T.lead_in(words, lengths).select("asset_id", F.round("lead_end", 6).alias("lead_end"))


@query(duck("job_events") + """, l AS (SELECT job_id, arg_max(stage, (ts, event_id)) AS stage FROM job_events GROUP BY 1), d AS (SELECT stage, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS s FROM job_events),
 h AS (SELECT stage, avg(s) AS seconds FROM d WHERE s IS NOT NULL GROUP BY 1), o(stage, p, prior) AS (VALUES """ + ", ".join(f"('{s}', {i}, {v})" for i, (s, v) in enumerate(S.STAGE_SECONDS.items())) + """),
 j AS (SELECT l.job_id, l.stage, coalesce(o.p, -1) AS cur, greatest(0.5, least(2.0, (l.job_id % 60) / 20.0)) AS f, (l.job_id % 4)::double AS v, (l.job_id % 9)::double AS e, l.job_id % 3 = 0 AS manual FROM l LEFT JOIN o ON o.stage = l.stage),
 q AS (SELECT j.job_id, j.stage, cur, e, o.p, CASE WHEN o.stage = 'selecting' AND manual THEN 0.0 ELSE coalesce(0.6 * h.seconds + 0.4 * own, own) END AS p_s FROM (SELECT j.*, o.stage AS os, o.p AS op, CASE o.stage WHEN 'rendering' THEN prior * f * greatest(1.0, v) WHEN 'broll_recovery' THEN least(45.0, prior * f) ELSE prior * f END AS own FROM j CROSS JOIN o) j JOIN o ON o.stage = j.os LEFT JOIN h ON h.stage = o.stage)
 SELECT job_id, stage, round(CASE WHEN any_value(cur) < 0 THEN 0.0 ELSE greatest(1.0, sum(CASE WHEN p > cur THEN p_s WHEN p = cur THEN greatest(0.0, p_s - e) ELSE 0.0 END)) END, 4) AS eta_s FROM q GROUP BY 1, 2""")
def ss2_forecast_with_history(spark, sf_dir):
    """Forecasts that blend the mean seconds of each stage in the log; a third of the jobs are manual."""
    from cliploom.operators.jobs import remaining_time

    events = view(spark, sf_dir, "job_events")
    order = P.W.partitionBy("job_id").orderBy("ts", "event_id")
    seconds = (F.unix_micros(F.lead("ts").over(order).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    history = events.select("stage", seconds.alias("seconds")).where("seconds is not null")
    last = events.groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"))
    jobs = last.select("job_id", "stage", (F.col("job_id") % 60).cast("double").alias("clip_s"), (F.col("job_id") % 4).alias("variations"), (F.col("job_id") % 9).cast("double").alias("elapsed"), F.when(F.col("job_id") % 3 == 0, "manual").otherwise("auto").alias("mode"))
    return remaining_time(jobs, history=history).withColumn("eta_s", F.round("eta_s", 4))


@query(duck("frames") + """, v AS (SELECT video_id, max(frame_idx) AS final FROM frames GROUP BY 1), s AS (SELECT video_id, unnest(range(0, 4)) AS n, final FROM v), p AS (SELECT video_id, n, final, n * (final + 20) / 40.0 AS start_s, (n + 1) * (final + 20) / 40.0 AS end_s FROM s),
 q AS (SELECT video_id, n, final, least(floor(start_s * 10), final) AS a, least(floor(end_s * 10), final + 1) AS b FROM p) SELECT video_id, n, least(floor(a + (b - a) * 0.5), final)::int AS frame_idx FROM q""")
def jn16_middle_frames(spark, sf_dir):
    """Middle frames of four spans a video, of which the last goes on behind the last frame."""
    frames = view(spark, sf_dir, "frames").select("video_id", "frame_idx")
    ends = frames.groupBy("video_id").agg(F.max("frame_idx").alias("final"))
    each = ends.select("video_id", "final", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"))
    spans = each.select("video_id", "n", (F.col("n") * (F.col("final") + 20) / 40.0).alias("start_s"), ((F.col("n") + 1) * (F.col("final") + 20) / 40.0).alias("end_s"))
    return P.middle_frames(spans, frames).select("video_id", "n", "frame_idx")
