"""Queries over transcripts and documents: text scores, windows, captions, learned terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom import schema as S
from cliploom.functions import features as V
from cliploom.functions import text as X
from cliploom.functions import titles as L
from cliploom.operators import aggregates as A
from cliploom.operators import transcripts as T
from cliploom.plans.registration import query
from cliploom.plans.views import duck, view

_MAP = lambda table: "MAP {" + ", ".join(f"'{k.replace(chr(39), chr(39) * 2)}': {v}::double" for k, v in table.items()) + "}"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_NUM = r"\$?[0-9][0-9,.]*(?:k|m|b|%|x|\+)?"


def _normal(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9$%+.'' -]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tokens(t: str) -> str:
    return f"regexp_extract_all({_normal(t)}, '[a-z0-9$%+-]+')"


def _marks(t: str) -> str:
    return f"(1.5 * (len({t}) - len(replace({t}, '?', ''))) + (len({t}) - len(replace({t}, '!', ''))))"


def _text_score(t: str) -> str:
    tok, norm = _tokens(t), _normal(t)
    phrases = " + ".join(f"(CASE WHEN contains({norm}, '{p.replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END)" for p, w in S.PHRASE_WEIGHTS.items())
    return f"""(CASE WHEN len({tok}) = 0 THEN 0.0 ELSE least(len({tok}), 80) / 55.0 + coalesce(list_sum([coalesce({_MAP(S.TERM_WEIGHTS)}[x], 0.0) for x in {tok}]), 0.0) + {phrases} + 2.8 * len(regexp_extract_all({norm}, '{_NUM}')) + {_marks(t)}
 + (CASE WHEN len([x for x in {tok} if x IN ('but', 'however', 'actually', 'instead')]) > 0 THEN 1.6 ELSE 0 END) + (CASE WHEN len([x for x in {tok} if x IN ('never', 'wrong', 'bullshit')]) > 0 THEN 2.2 ELSE 0 END) END)"""


def _window(t: str) -> str:
    return f"regexp_replace(lower({t}), '[^a-z0-9$%+ ]', ' ', 'g')"


def _window_tokens(t: str) -> str:
    return f"[x for x in regexp_split_to_array({_window(t)}, ' +') if x <> '']"


def _viral(t: str) -> str:
    tok = _window_tokens(t)
    return f"(len({tok}) / 50.0 + 2.0 * len([x for x in {tok} if x IN {_IN(S.HOOK_WORDS)}]) + 2.5 * len(regexp_extract_all({_window(t)}, '{_NUM}')) + {_marks(t)} + {_text_score(t)})"


def _hooked(t: str) -> str:
    return f"(len([x for x in {_window_tokens(t)}[1:8] if x IN {_IN(S.HOOK_WORDS)}]) > 0 OR regexp_matches(array_to_string({_window_tokens(t)}[1:8], ' '), '{_NUM}'))"


@query("SELECT doc_id, array_to_string([w for w in regexp_split_to_array(text, '\\s+') if w <> ''][1:8], ' ') AS short, array_to_string([w for w in regexp_split_to_array(replace(replace(text, '\"', ''), '''', ''), '\\s+') if w <> ''][1:8], ' ') AS plain FROM documents")
def pr8_truncated(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", V.first_words(F.col("text")).alias("short"), V.first_words(F.col("text"), drop_quotes=True).alias("plain"))


@query(f"SELECT doc_id, len({_tokens('text')}) AS profile_tokens, len({_window_tokens('text')}) AS window_tokens, len(regexp_extract_all(lower(text), '[a-z0-9$%+-]+')) AS learning_tokens FROM documents")
def pr14_token_rules(spark, sf_dir):
    text = F.col("text")
    learning = F.regexp_extract_all(F.lower(text), F.lit(X.WORD), F.lit(0))
    return view(spark, sf_dir, "documents").select("doc_id", F.size(X.profile_tokens(text)).alias("profile_tokens"), F.size(X.window_tokens(text)).alias("window_tokens"), F.size(learning).alias("learning_tokens"))


@query(f"SELECT doc_id, round({_text_score('text')}, 6) AS text_score, round({_viral('text')}, 6) AS viral_score, {_hooked('text')} AS hooked FROM documents")
def pr15_pr17_pr18_text_scores(spark, sf_dir):
    rows, t = X.prepared(view(spark, sf_dir, "documents"), "text")
    return rows.select("doc_id", F.round(X.score_text(t), 6).alias("text_score"), F.round(X.viral_score(t), 6).alias("viral_score"), X.starts_with_hook(t).alias("hooked"))


@query(f"SELECT doc_id, regexp_extract(text, '(?i){S.TITLE_NUMBER}') AS number FROM documents WHERE regexp_matches(text, '[0-9]')")
def pr19_first_number(spark, sf_dir):
    return view(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", X.first_number(F.col("text")).alias("number"))


@query()
def pr19_name_phrases(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", F.explode(X.name_phrases(F.col("text"))).alias("name"))


@query()
def pr21_pr25_titles(spark, sf_dir):
    """Typed titles in two lines, with the markup of their highlights."""
    pages = view(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    one, two = X.manual_title(F.col("t"))
    lines = pages.select("page_id", one.alias("line1"), two.alias("line2")).withColumn("highlights", L.heuristic_highlights(F.concat("line1", F.lit(" "), "line2")))
    made = L.finished(lines)
    first, second = X.highlighted(F.col("line1"), F.col("line2"), F.col("highlights"))
    return made.select("page_id", first.alias("line1"), second.alias("line2"))


_NEAR = duck("words", "segments") + """, n AS (SELECT asset_id, pos, word, start_s, end_s, row_number() OVER (PARTITION BY asset_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY asset_id) AS n, max(end_s) OVER (PARTITION BY asset_id) AS duration FROM words),
 st AS (SELECT DISTINCT asset_id, duration, round_even(least(start_s, greatest(0.0, duration - 15.0)), 2) AS lo FROM n WHERE (i - 1) % greatest(1, n // 80) = 0 UNION SELECT asset_id, duration, 0.0 FROM n WHERE i = 1
  UNION SELECT n.asset_id, duration, round_even(greatest(0.0, least(s.start_s, greatest(0.0, duration - 15.0))), 2) FROM n JOIN segments s ON s.asset_id = n.asset_id WHERE i = 1)"""


@query(_NEAR + " SELECT asset_id, lo FROM st")
def wn12_candidate_starts(spark, sf_dir):
    return T.candidate_starts(view(spark, sf_dir, "words"), 15.0, view(spark, sf_dir, "segments")).select("asset_id", "lo")


_PART_COUNTS = {"terms": (1, 80, 45, 1.5, 0.35, 8, 2.5), "phrases": (2, 120, 35, 2.0, 0.5, 6, 2.0), "opening_terms": (1, 80, 35, 1.2, 0.45, 8, 1.8), "opening_phrases": (2, 100, 25, 1.8, 0.55, 6, 1.6)}


def _learned_sql() -> str:
    """Named tables ``p_terms`` to ``p_opening_phrases``(gram, n, weight) of a profile learned from the documents."""
    stop = _IN(S.STOP_WORDS)
    first = "array_to_string([w for w in regexp_split_to_array(text, '\\s+') if w <> ''][1:28], ' ')"
    tables = [f"lw AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9$%+-]+') AS l FROM documents)", f"lo AS (SELECT regexp_extract_all(lower(coalesce({first}, '')), '[a-z0-9$%+-]+') AS l FROM documents)"]
    for name, (size, take, keep, base, step, cap, bonus) in _PART_COUNTS.items():
        source = "lo" if name.startswith("opening") else "lw"
        if size == 1:
            grams, met = f"SELECT unnest(l) AS gram FROM {source}", f"gram NOT IN {stop}"
            seeded, kept = f"gram IN {_IN(S.SEED_WORDS)} OR regexp_full_match(gram, '{_NUM}')", f"len(gram) > 2 OR regexp_full_match(gram, '{_NUM}')"
        else:
            each = lambda k: f"SELECT array_to_string(l[i:i + {k - 1}], ' ') AS gram, l[i] AS a, l[i + {k - 1}] AS z FROM (SELECT l, unnest(range(1, len(l) - {k - 2})) AS i FROM {source})"
            grams, met = f"{each(2)} UNION ALL {each(3)}", f"a NOT IN {stop} AND z NOT IN {stop}"
            seeded = " OR ".join(f"contains(gram, '{w}')" for w in S.SEED_WORDS)
            kept = f"n >= 2 OR {seeded}"
        tables += [
            f"c_{name} AS (SELECT gram, count(*) AS n FROM ({grams}) WHERE {met} GROUP BY 1 ORDER BY n DESC, gram LIMIT {take})",
            f"p_{name} AS (SELECT gram, n, round_even({base} + least(n, {cap}) * {step} + CASE WHEN {seeded} THEN {bonus} ELSE 0 END, 2) AS weight FROM c_{name} WHERE {kept} ORDER BY weight DESC, n DESC, gram LIMIT {keep})",
        ]
    return ", ".join(tables)


@query(f"WITH {_learned_sql()} " + " UNION ALL ".join(f"SELECT '{name}' AS part, gram, n, weight FROM p_{name}" for name in _PART_COUNTS))
def ag8_ag9_learned_profile(spark, sf_dir):
    return A.learned_profile(view(spark, sf_dir, "documents")).select("part", "gram", "n", "weight")


@query(f"""WITH r AS (SELECT regexp_extract_all({_normal("array_to_string([w for w in regexp_split_to_array(text, '\\s+') if w <> ''][1:28], ' ')")}, '[a-z0-9$%+-]+') AS l FROM documents),
 c AS (SELECT gram, count(*) AS n FROM (SELECT unnest(l) AS gram FROM r) WHERE gram NOT IN {_IN(S.STOP_WORDS)} GROUP BY 1 ORDER BY n DESC, gram LIMIT 80),
 t AS (SELECT gram, n, round_even(1.2 + least(n, 8) * 0.45 + CASE WHEN gram IN {_IN(S.TERM_WEIGHTS)} OR regexp_full_match(gram, '{_NUM}') THEN 1.8 ELSE 0 END, 2) AS weight FROM c WHERE len(gram) > 2 OR regexp_full_match(gram, '{_NUM}') ORDER BY weight DESC, n DESC, gram LIMIT 35),
 g AS (SELECT l[i] || ' ' || l[i + 1] AS gram, l[i] AS a, l[i + 1] AS z FROM (SELECT l, unnest(range(1, len(l))) AS i FROM r) UNION ALL SELECT l[i] || ' ' || l[i + 1] || ' ' || l[i + 2], l[i], l[i + 2] FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM r)),
 d AS (SELECT gram, count(*) AS n FROM g WHERE a NOT IN {_IN(S.STOP_WORDS)} AND z NOT IN {_IN(S.STOP_WORDS)} GROUP BY 1 ORDER BY n DESC, gram LIMIT 80),
 p AS (SELECT gram, n, round_even(1.8 + least(n, 6) * 0.55 + CASE WHEN {" OR ".join(f"contains(gram, '{w}')" for w in S.TERM_WEIGHTS)} THEN 1.6 ELSE 0 END, 2) AS weight FROM d WHERE n >= 2 OR {" OR ".join(f"contains(gram, '{w}')" for w in S.TERM_WEIGHTS)} ORDER BY weight DESC, n DESC, gram LIMIT 25)
 SELECT 'opening_terms' AS part, gram, n, weight FROM t UNION ALL SELECT 'opening_phrases', gram, n, weight FROM p""")
def ag17_openings_from_records(spark, sf_dir):
    """The opening maps of a profile that kept its records only: the first 28 words of each text."""
    opening = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, A.OPENING_WORDS), " ")
    return A.opening_from_records(view(spark, sf_dir, "documents").select(opening.alias("opening"))).select("part", "gram", "n", "weight")


#: Transcripts of two kinds: documents have words, conversations (under ids of their own, too) segments only.
_SILENT = 1_000_000_000
_HEARD = duck("words", "segments") + f""", seg AS (SELECT * FROM segments UNION ALL SELECT asset_id + {_SILENT}, seg_idx, start_s, end_s, text FROM segments),
 items AS (SELECT asset_id, pos, start_s, end_s, trim(word) AS word FROM words WHERE trim(word) <> '' UNION ALL SELECT asset_id, seg_idx, start_s, end_s, trim(text) FROM seg WHERE trim(text) <> '' AND asset_id NOT IN (SELECT asset_id FROM words)),
 len AS (SELECT asset_id, max(end_s) AS duration FROM items GROUP BY 1), num AS (SELECT asset_id, start_s, row_number() OVER (PARTITION BY asset_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY asset_id) AS n FROM words),
 beg AS (SELECT asset_id, start_s FROM num WHERE (i - 1) % greatest(1, n // 80) = 0 UNION ALL SELECT asset_id, start_s FROM seg),
 st AS (SELECT asset_id, duration, 0.0 AS lo FROM len UNION SELECT beg.asset_id, duration, round_even(greatest(0.0, least(start_s, greatest(0.0, duration - 15.0))), 2) FROM beg JOIN len ON len.asset_id = beg.asset_id)"""


def _opening_sql(t: str) -> str:
    """Opening score with the learned terms and phrases in ``m``."""
    return f"""(CASE WHEN len({_tokens(t)}) = 0 THEN 0.0 ELSE coalesce(list_sum([coalesce(m.terms[x], 0.0) for x in {_tokens(t)}]), 0.0) + coalesce(list_sum([CASE WHEN contains({_normal(t)}, g) THEN m.phrases[g] ELSE 0.0 END for g in map_keys(m.phrases)]), 0.0) + 0.65 * {_text_score(t)} END)"""


@query(_HEARD + f""", {_learned_sql()}, m AS (SELECT (SELECT map(list(gram), list(weight)) FROM p_opening_terms) AS terms, (SELECT map(list(gram), list(weight)) FROM p_opening_phrases) AS phrases),
 w AS (SELECT asset_id, lo, least(duration, lo + 15.0) AS hi FROM st), o AS (SELECT asset_id, lo, hi, least(hi, lo + greatest(2.5, least(4.0, (hi - lo) * 0.35))) AS mid FROM w),
 whole AS (SELECT o.asset_id, o.lo, string_agg(x.word, ' ' ORDER BY x.pos) AS t FROM o JOIN items x ON x.asset_id = o.asset_id AND x.end_s > o.lo AND x.start_s < o.hi GROUP BY 1, 2),
 op AS (SELECT o.asset_id, o.lo, string_agg(x.word, ' ' ORDER BY x.pos) AS t FROM o JOIN items x ON x.asset_id = o.asset_id AND x.end_s > o.lo AND x.start_s < o.mid GROUP BY 1, 2),
 sc AS (SELECT o.asset_id, o.lo, o.hi, round(CASE WHEN whole.t IS NULL THEN 0.0 ELSE {_viral('whole.t')} END + CASE WHEN op.t IS NULL THEN 0.0 ELSE 1.15 * {_viral('op.t')} + 1.65 * {_opening_sql('op.t')}
   + (CASE WHEN {_hooked('op.t')} OR len([x for x in {_window_tokens('op.t')}[1:8] if list_contains(map_keys(m.terms), x)]) > 0 THEN 4.0 ELSE 0.0 END) END, 6) AS score
  FROM o CROSS JOIN m LEFT JOIN whole ON whole.asset_id = o.asset_id AND whole.lo = o.lo LEFT JOIN op ON op.asset_id = o.asset_id AND op.lo = o.lo)
 SELECT asset_id, lo, hi, score FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, lo) AS r FROM sc) WHERE r = 1""")
def wn13_best_window(spark, sf_dir):
    """Strongest windows of all transcripts under a profile whose openings are learned from the documents."""
    segments = view(spark, sf_dir, "segments")
    segments = segments.unionByName(segments.withColumn("asset_id", F.col("asset_id") + _SILENT))
    learned = A.learned_profile(view(spark, sf_dir, "documents")).where("part like 'opening%'")
    return T.best_windows(view(spark, sf_dir, "words"), segments=segments, profile=X.Profile.of(learned))


@query(duck("words") + """, d AS (SELECT asset_id, max(end_s) AS duration FROM words GROUP BY 1), w AS (SELECT asset_id, duration / 3 AS lo, duration / 3 + 10.0 AS hi FROM d)
 SELECT x.asset_id, x.pos, round(greatest(0.0, x.start_s - lo), 6) AS rel_start, round(least(hi - lo, x.end_s - lo), 6) AS rel_end FROM w JOIN words x ON x.asset_id = w.asset_id AND x.end_s > lo AND x.start_s < hi""")
def jn9_sliced_transcript(spark, sf_dir):
    words = view(spark, sf_dir, "words")
    windows = words.groupBy("asset_id").agg((F.max("end_s") / 3).alias("lo")).withColumn("hi", F.col("lo") + 10.0)
    return T.sliced(windows, words).select("asset_id", "pos", F.round("rel_start", 6).alias("rel_start"), F.round("rel_end", 6).alias("rel_end"))


@query(duck("segments") + """ SELECT s.asset_id, min(t.seg_idx) AS seg_idx, string_agg(t.text, ' ' ORDER BY t.seg_idx) AS text FROM (SELECT DISTINCT asset_id, 0.0 AS lo, 14.0 AS hi FROM segments) s JOIN segments t ON t.asset_id = s.asset_id AND t.end_s > lo AND t.start_s < hi GROUP BY 1""")
def jn10_window_text(spark, sf_dir):
    segments = view(spark, sf_dir, "segments")
    windows = segments.select("asset_id").distinct().withColumns({"lo": F.lit(0.0), "hi": F.lit(14.0)})
    items = segments.withColumnsRenamed({"seg_idx": "pos", "text": "word"})
    first = T.overlapping(windows, items, 15.0).groupBy("asset_id").agg(F.min("pos").alias("seg_idx"))
    return T.window_texts(windows, items, ["asset_id"]).join(first, "asset_id").select("asset_id", "seg_idx", "text")


@query(duck("words") + """, g AS (SELECT asset_id, coalesce(max(end_s) OVER (PARTITION BY asset_id ORDER BY start_s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS gap_start, start_s AS gap_end FROM words)
 SELECT asset_id, round(gap_start, 6) AS gap_start, round(gap_end, 6) AS gap_end FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY round(gap_end - gap_start, 6) DESC, gap_start) AS r FROM g WHERE gap_end - gap_start >= 1.5) WHERE r = 1""")
def wn7_longest_gap(spark, sf_dir):
    return T.longest_gap(view(spark, sf_dir, "words")).select("asset_id", F.round("gap_start", 6).alias("gap_start"), F.round("gap_end", 6).alias("gap_end"))


@query(duck("words") + " SELECT asset_id, CASE WHEN min(start_s + 0.7) BETWEEN 0.5 AND 3.5 THEN round(min(start_s + 0.7), 6) END AS lead_end FROM words WHERE word <> 'the' GROUP BY 1")
def wn8_lead_in(spark, sf_dir):
    words = view(spark, sf_dir, "words").where("word <> 'the'").withColumn("start_s", F.col("start_s") + 0.7)
    return T.lead_in(words).select("asset_id", F.round("lead_end", 6).alias("lead_end"))


@query(duck("segments") + """, t AS (SELECT asset_id, seg_idx, start_s, greatest(0.1, end_s - start_s) AS l, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM (SELECT *, [x for x in regexp_split_to_array(text, '\\s+') if x <> ''] AS w FROM segments)),
 c AS (SELECT *, sum(len(word)) OVER (PARTITION BY asset_id, seg_idx ORDER BY pos) AS upto, sum(len(word)) OVER (PARTITION BY asset_id, seg_idx) AS every FROM t)
 SELECT asset_id, seg_idx, pos, word, round(start_s + l * (upto - len(word)) / every, 5) AS start_s, round(start_s + l * upto / every, 5) AS end_s FROM c""")
def wn9_word_timing(spark, sf_dir):
    made = T.words_from_segments(view(spark, sf_dir, "segments"))
    return made.select("asset_id", "seg_idx", "pos", "word", F.round("start_s2", 5).alias("start_s"), F.round("end_s2", 5).alias("end_s"))


#: Words of the view are single tokens, so cues are runs without a long gap cut into threes.
_CUES = duck("words") + """, b AS (SELECT *, start_s - lag(end_s) OVER w > 1.0 AS gap, max(end_s) OVER (PARTITION BY asset_id) AS duration FROM words WINDOW w AS (PARTITION BY asset_id ORDER BY start_s, pos)),
 i AS (SELECT *, sum(coalesce(gap, false)::int) OVER (PARTITION BY asset_id ORDER BY start_s, pos) AS run FROM b WHERE start_s < duration), r AS (SELECT *, (row_number() OVER (PARTITION BY asset_id, run ORDER BY start_s, pos) - 1) // 3 AS part FROM i),
 g AS (SELECT asset_id, run, part, min(start_s) AS s, least(any_value(duration), greatest(arg_max(end_s, (start_s, pos)), min(start_s) + 0.3)) AS e, string_agg(trim(translate(word, '{}\\', '()/')), ' ' ORDER BY start_s, pos) AS text FROM r GROUP BY 1, 2, 3),
 q AS (SELECT asset_id, row_number() OVER w - 1 AS cue, s AS "start", coalesce(least(e, lead(s) OVER w), e) AS "end", text FROM g WHERE e > s WINDOW w AS (PARTITION BY asset_id ORDER BY run, part)), cues AS (SELECT * FROM q WHERE "end" > "start")"""


@query(_CUES + ' SELECT asset_id, cue, "start", "end", text FROM cues')
def wn10_wn11_caption_cues(spark, sf_dir):
    return T.caption_cues(view(spark, sf_dir, "words"))


_ASS = lambda t: f"printf('%d:%02d:%05.2f', floor({t} / 3600)::int, floor(({t} % 3600) / 60)::int, {t} % 60)"


@query(_CUES + f""", l AS (SELECT asset_id, cue, 'Dialogue: 0,' || {_ASS('"start"')} || ',' || {_ASS('"end"')} || ',Caption,,0,0,0,,' || text AS line FROM cues
  UNION ALL SELECT doc_id, -1, 'Dialogue: 1,0:00:00.00,' || {_ASS("d.duration")} || ',Title,,0,0,0,,*' || lang || '* title' FROM documents JOIN (SELECT asset_id, max(end_s) AS duration FROM words GROUP BY 1) d ON d.asset_id = doc_id)
 SELECT asset_id, string_agg(line, chr(10) ORDER BY cue) AS value FROM l GROUP BY 1""")
def io10_caption_files(spark, sf_dir):
    """Caption files, each with a title line whose first word is highlighted."""
    words = view(spark, sf_dir, "words")
    lengths = words.groupBy("asset_id").agg(F.max("end_s").alias("duration"))
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id"), F.concat("lang", F.lit(" title")).alias("line1"), F.lit("").alias("line2"), F.array("lang").alias("highlights"))
    return T.caption_file(T.caption_cues(words), docs.join(lengths, "asset_id"))


@query(duck("segments") + " SELECT asset_id, left(string_agg(printf('[%.2f-%.2f] ', start_s, end_s) || trim(text), chr(10) ORDER BY seg_idx), 12000) || CASE WHEN len(string_agg(printf('[%.2f-%.2f] ', start_s, end_s) || trim(text), chr(10) ORDER BY seg_idx)) > 12000 THEN chr(10) || '[cut]' ELSE '' END AS outline FROM segments GROUP BY 1")
def ag18_outline(spark, sf_dir):
    return T.outline(view(spark, sf_dir, "segments"))


_GRAMS = f"t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9$%+-]+') AS l FROM documents)"  # noqa: F541
_STOP = _IN(S.STOP_WORDS)


@query(f"WITH {_GRAMS}, g AS (SELECT unnest(l) AS gram FROM t) SELECT gram, count(*) AS n FROM g WHERE gram NOT IN {_STOP} GROUP BY 1")
def ag8_term_counts(spark, sf_dir):
    return A.ngram_counts(_learning(spark, sf_dir), 1)


def _learning(spark, sf_dir):
    return view(spark, sf_dir, "documents").select(F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0)).alias("tokens"))


@query(f"WITH {_GRAMS}, g AS (SELECT l, unnest(range(1, len(l))) AS i FROM t) SELECT l[i] || ' ' || l[i + 1] AS gram, count(*) AS n FROM g WHERE l[i] NOT IN {_STOP} AND l[i + 1] NOT IN {_STOP} GROUP BY 1")
def ag8_phrase_counts(spark, sf_dir):
    return A.ngram_counts(_learning(spark, sf_dir), 2)


_TOP80 = f"""WITH {_GRAMS}, g AS (SELECT unnest(l) AS gram FROM t), c AS (SELECT gram, count(*) AS n FROM g WHERE gram NOT IN {_STOP} GROUP BY 1 ORDER BY n DESC, gram LIMIT 80),
 w AS (SELECT gram, n, round_even(1.5 + least(n, 8) * 0.35 + CASE WHEN gram IN {_IN(S.SEED_WORDS)} OR regexp_full_match(gram, '{_NUM}') THEN 2.5 ELSE 0 END, 2) AS weight FROM c WHERE len(gram) > 2 OR regexp_full_match(gram, '{_NUM}'))"""


@query(_TOP80 + " SELECT gram, n, weight FROM w ORDER BY weight DESC, n DESC, gram LIMIT 45")
def ag9_weighted_terms(spark, sf_dir):
    return A.weighted_terms(A.ngram_counts(_learning(spark, sf_dir), 1))


@query(_TOP80 + f""", l AS (SELECT gram AS term, weight FROM w ORDER BY weight DESC, n DESC, gram LIMIT 45), d AS (SELECT unnest(map_keys(m)) AS term, unnest(map_values(m)) AS weight FROM (SELECT {_MAP(S.TERM_WEIGHTS)} AS m))
 SELECT coalesce(l.term, d.term) AS term, coalesce(l.weight, d.weight) AS weight FROM l FULL OUTER JOIN d ON l.term = d.term""")
def ag17_merged_dictionary(spark, sf_dir):
    learned = A.weighted_terms(A.ngram_counts(_learning(spark, sf_dir), 1)).select(F.col("gram").alias("term"), "weight")
    defaults = spark.createDataFrame(list(S.TERM_WEIGHTS.items()), "term string, weight double")
    return A.merged_dictionary(defaults, learned)


@query(duck("spans") + """, s AS (SELECT *, max(end_s) OVER (PARTITION BY job_id) + 2.0 AS total FROM spans) SELECT printf('%.2f', round_even(least(1.0, start_s / total), 2)) || ',' || printf('%.2f', round_even(least(1.0, (end_s - start_s) / total), 2)) AS value, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, value LIMIT 40""")
def ag7_top_placements(spark, sf_dir):
    from cliploom.plans.clip_queries import _timed

    return A.top_counts(_timed(spark, sf_dir), A.placements(_timed(spark, sf_dir), "total"), 40)


@query(duck("spans", "words", "search_rows") + """, x AS (SELECT *, max(end_s) OVER (PARTITION BY job_id) + 2.0 AS total FROM spans), r AS (SELECT job_id, count(*) / max(total) * 30.0 AS per_30s FROM x GROUP BY 1), per AS (SELECT round(avg(per_30s), 6) AS per FROM r),
 c AS (SELECT printf('%.2f', round_even(least(1.0, start_s / total), 2)) || ',' || printf('%.2f', round_even(least(1.0, (end_s - start_s) / total), 2)) AS value, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, value LIMIT 20), pl AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) - 1 AS i, count(*) OVER () AS np FROM c),
 k AS (SELECT id AS value, count(*) AS n FROM search_rows GROUP BY 1 ORDER BY n DESC, value LIMIT 50), q AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) - 1 AS j, count(*) OVER () AS nq FROM k), d AS (SELECT asset_id AS key, max(end_s) AS duration FROM words GROUP BY 1),
 e AS (SELECT key, duration, unnest(range(0, round_even(per * duration / 30.0, 0)::int)) AS n FROM d CROSS JOIN per), f AS (SELECT key, e.n, duration, greatest(0.0, least(duration, split_part(pl.value, ',', 1)::double * duration)) AS start_s, split_part(pl.value, ',', 2)::double * duration AS len, q.value AS query FROM e JOIN pl ON e.n % np = i JOIN q ON e.n % nq = j)
 SELECT key, n, round(start_s, 6) AS start_s, round(least(duration, start_s + len), 6) AS end_s, query FROM f WHERE least(duration, start_s + len) - start_s >= 0.4""")
def wn20_synthesised_spans(spark, sf_dir):
    from cliploom.operators.assign import synthesised
    from cliploom.plans.clip_queries import _timed

    spans = _timed(spark, sf_dir)
    profile = A.running_profile(A.placement_profile(spans, F.col("total")))
    top = A.top_counts(spans, A.placements(spans, "total"), 20).orderBy(F.desc("n"), "value")
    order = F.row_number().over(A.W.orderBy(F.desc("n"), "value")) - 1  # twenty rows
    places = top.select(order.alias("i"), F.split("value", ",").alias("p")).select("i", F.get("p", F.lit(0)).cast("double").alias("start_part"), F.get("p", F.lit(1)).cast("double").alias("length_part"))
    queries = A.top_counts(view(spark, sf_dir, "search_rows"), F.col("id"), 50).select((F.row_number().over(A.W.orderBy(F.desc("n"), "value")) - 1).alias("j"), F.col("value").alias("query"))
    durations = view(spark, sf_dir, "words").groupBy(F.col("asset_id").alias("key")).agg(F.max("end_s").alias("duration"))
    return synthesised(profile, places, queries, durations).select("key", "n", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "query")
