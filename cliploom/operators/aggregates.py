"""Ordered aggregates: capped unions, modes with a tie rule, house style, profiles, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom import schema as S
from cliploom.functions.text import WORD, profile_text

MERGE_CAPS = {"subjects": 4, "setting": 2, "action": 2, "mood": 3, "color_palette": 3}


def ordered_union(values: str, order: str, cap: int) -> Column:
    """First-seen distinct elements of an array column over the group, in ``order``, at most ``cap``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v"))))
    return F.slice(F.array_distinct(F.filter(F.flatten(F.transform(rows, lambda r: r["v"])), lambda v: v != "")), 1, cap)


def ordered_modes(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Most frequent non-blank value of each column per key; ties go to the one seen first.

    Two aggregate levels, so a hot key is counted before it is gathered.
    """
    long = rows.select(key, order, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x")).where("x.value <> ''")
    counted = long.groupBy(key, F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(key, "field").agg(F.max_by("value", F.struct(F.col("n"), -F.col("first"))).alias("value"))
    return best.groupBy(key).pivot("field", columns).agg(F.first("value"))


def house_style(tags: DataFrame, key: str = "job_id", order: str = "span_idx") -> DataFrame:
    """Per job: union of moods and palettes, modes of the five style fields."""
    lists = tags.groupBy(key).agg(ordered_union("mood", order, 3).alias("mood"), ordered_union("color_palette", order, 3).alias("color_palette"))
    return lists.join(ordered_modes(tags, key, order, ["energy", "lighting", "shot_type", "camera_motion", "depth_of_field"]), key)


def back_filled(tags: DataFrame, house: DataFrame, key: str = "job_id") -> DataFrame:
    """Span fields completed by the house style: lists united and capped, strings where blank."""
    h = house.select(key, *[F.col(c).alias(f"h_{c}") for c in house.columns if c != key])
    out = tags.join(h, key, "left")
    for c in ("mood", "color_palette"):
        out = out.withColumn(c, F.slice(F.array_distinct(F.concat(c, F.coalesce(F.col(f"h_{c}"), F.array().cast("array<string>")))), 1, 3))
    for c in ("energy", "lighting", "shot_type", "camera_motion", "depth_of_field"):
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"h_{c}"), F.lit("")))
    return out.drop(*[c for c in out.columns if c.startswith("h_")])


def placement_profile(spans: DataFrame, duration: Column, key: str = "job_id") -> DataFrame:
    """One row per reference: spans per 30 s, mean length, first start and mean gap."""
    order = W.partitionBy(key).orderBy("span_idx")
    each = spans.withColumns({"gap": F.lead("start_s").over(order) - F.col("end_s"), "duration": duration})
    return each.groupBy(key).agg(
        (F.count(F.lit(1)) / F.max("duration") * 30.0).alias("per_30s"), F.avg(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))).alias("length"),
        F.min_by("start_s", "span_idx").alias("first_start"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap"), F.max("duration").alias("duration"),
    )


def running_profile(references: DataFrame) -> DataFrame:
    """Averages over all references that count: the running mean is algebraic, so order is free."""
    ok = references.where("duration > 0")
    return ok.agg(F.count(F.lit(1)).alias("samples"), *[F.round(F.avg(c), 6).alias(c) for c in ("per_30s", "length", "first_start", "gap")])


def top_counts(rows: DataFrame, value: Column, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def placements(spans: DataFrame, duration: str) -> Column:
    part = lambda x: F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / F.col(duration))), 2)
    return F.concat_ws(",", F.format_string("%.2f", part(F.col("start_s"))), F.format_string("%.2f", part(F.col("end_s") - F.col("start_s"))))


def ngram_counts(tokens: DataFrame, size: int, key: str = "asset_id") -> DataFrame:
    """Counts of n-grams that neither start nor end with a stop word (single terms: no stop words).

    ``tokens``: key and an array column ``tokens``; counted in the map side before the shuffle.
    """
    grams = F.when(F.size("tokens") >= size, F.transform(F.sequence(F.lit(1), F.size("tokens") - size + 1), lambda i: F.slice("tokens", i, size)))
    stop = list(S.STOP_WORDS)
    each = tokens.select(F.explode(grams).alias("g"))
    ends = each.where(~F.get("g", F.lit(0)).isin(stop) & ~F.get("g", F.lit(size - 1)).isin(stop))
    return ends.groupBy(F.array_join("g", " ").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def weighted_terms(counts: DataFrame, take: int = 80, keep: int = 45, base: float = 1.5, step: float = 0.35, bonus: float = 2.5, cap: int = 8, seeds: tuple[str, ...] = S.SEED_WORDS) -> DataFrame:
    """Weights of the most frequent terms; short terms that are no numbers drop out."""
    number = F.col("gram").rlike(r"^\$?[0-9][0-9,.]*(?:k|m|b|%|x|\+)?$")
    top = counts.orderBy(F.desc("n"), "gram").limit(take).where((F.length("gram") > 2) | number)
    weight = base + F.least(F.col("n"), F.lit(cap)) * step + F.when(F.col("gram").isin(*seeds) | number, bonus).otherwise(0.0)
    return top.select("gram", "n", F.bround(weight, 2).alias("weight")).orderBy(F.desc("weight"), F.desc("n"), "gram").limit(keep)


def weighted_phrases(counts: DataFrame, take: int = 120, keep: int = 35, base: float = 2.0, step: float = 0.5, bonus: float = 2.0, cap: int = 6, seeds: tuple[str, ...] = S.SEED_WORDS) -> DataFrame:
    """Weights of the most frequent phrases; one that was met once stays only if it holds a seed word."""
    seeded = F.greatest(*[F.col("gram").contains(seed) for seed in seeds])
    top = counts.orderBy(F.desc("n"), "gram").limit(take).where((F.col("n") >= 2) | seeded)
    weight = base + F.least(F.col("n"), F.lit(cap)) * step + F.when(seeded, bonus).otherwise(0.0)
    return top.select("gram", "n", F.bround(weight, 2).alias("weight")).orderBy(F.desc("weight"), F.desc("n"), "gram").limit(keep)


#: Words of a text that count as its opening when a profile is learned.
OPENING_WORDS = 28


def learned_profile(texts: DataFrame, text: str = "text") -> DataFrame:
    """(part, gram, n, weight): terms, phrases, opening_terms and opening_phrases of a corpus.

    Phrases have two or three tokens; openings are the first 28 words.  At most 45, 35, 35 and 25 rows.
    """
    opening = F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, OPENING_WORDS), " ")
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    whole, first = (texts.select(tokens(c).alias("tokens")) for c in (F.coalesce(F.col(text), F.lit("")), F.coalesce(opening, F.lit(""))))
    phrases = lambda rows: ngram_counts(rows, 2).unionByName(ngram_counts(rows, 3))
    parts = {
        "terms": weighted_terms(ngram_counts(whole, 1)), "phrases": weighted_phrases(phrases(whole)),
        "opening_terms": weighted_terms(ngram_counts(first, 1), 80, 35, 1.2, 0.45, 1.8), "opening_phrases": weighted_phrases(phrases(first), 100, 25, 1.8, 0.55, 1.6),
    }
    return reduce(lambda a, b: a.unionByName(b), [rows.withColumn("part", F.lit(name)) for name, rows in parts.items()])


def opening_from_records(records: DataFrame, opening: str = "opening") -> DataFrame:
    """(part, gram, n, weight) of the two opening parts, rebuilt from the openings kept in a profile's records."""
    tokens = records.select(F.regexp_extract_all(profile_text(F.coalesce(F.col(opening), F.lit(""))), F.lit(WORD), F.lit(0)).alias("tokens"))
    known = tuple(S.TERM_WEIGHTS)
    terms = weighted_terms(ngram_counts(tokens, 1), 80, 35, 1.2, 0.45, 1.8, seeds=known).withColumn("part", F.lit("opening_terms"))
    phrases = weighted_phrases(ngram_counts(tokens, 2).unionByName(ngram_counts(tokens, 3)), 80, 25, 1.8, 0.55, 1.6, seeds=known)
    return terms.unionByName(phrases.withColumn("part", F.lit("opening_phrases")))


def merged_dictionary(defaults: DataFrame, learned: DataFrame) -> DataFrame:
    """Default weights overridden key by key by the learned ones."""
    a, b = defaults.select(F.lower("term").alias("term"), F.col("weight").alias("d")), learned.select(F.lower("term").alias("term"), F.col("weight").alias("l"))
    return a.join(b, "term", "full_outer").select("term", F.coalesce("l", "d").alias("weight"))


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b)))
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col(a), F.col(b)) / size))).otherwise(0.0)


def style_vector() -> Column:
    """One-hot shot, motion and depth, and the shares of three mood groups: 19 numbers."""
    hot = lambda c, values: F.array(*[F.when(F.col(c) == v, 1.0).otherwise(0.0) for v in values])
    groups = (("energetic", "aggressive", "epic", "dramatic", "tense"), ("calm", "melancholic", "romantic", "nostalgic", "neutral"), ("joyful", "uplifting", "playful"))
    share = lambda g: F.when(F.size("mood") > 0, F.size(F.filter("mood", lambda m: m.isin(*g))) / F.size("mood")).otherwise(0.0)
    return F.concat(hot("shot_type", S.SHOT_TYPES), hot("camera_motion", S.CAMERA_MOTION), hot("depth_of_field", S.DEPTH_OF_FIELD), F.array(*[share(g) for g in groups]))


def stage_averages(events: DataFrame) -> DataFrame:
    """Seconds credited to each stage as it is left, folded per (job, stage): 0.7 old + 0.3 new."""
    order = W.partitionBy("job_id").orderBy("ts", "event_id")
    secs = F.unix_micros(F.lead("ts").over(order).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    spent = events.select("job_id", "stage", "ts", "event_id", (secs / 1e6).alias("s")).where("s is not null")
    runs = spent.groupBy("job_id", "stage").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "s"))).alias("r"))
    fold = F.aggregate("r", F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x["s"]).otherwise(0.7 * a + 0.3 * x["s"]))
    return runs.select("job_id", "stage", F.round(fold, 3).alias("seconds"))


def hook_description(frames: DataFrame, hooks: DataFrame, key: str = "key") -> DataFrame:
    """Tags of the frames a third and two thirds into each hook, lists united and category by mode.

    ``frames``: key, frame_idx, subjects, setting, category; ``hooks``: key, length_s, frames (their number).
    Frames beyond the last are left out; if none is left, the first one serves.
    """
    at = F.transform(F.array(F.lit(0.33), F.lit(0.66)), lambda share: F.floor(F.col("length_s") * 10 * share).cast("int"))
    inside = F.filter(at, lambda i: (i >= 0) & (i < F.col("frames")))
    wanted = hooks.where("length_s > 0 and frames > 0").select(key, F.posexplode(F.when(F.size(inside) > 0, inside).otherwise(F.array(F.lit(0)))).alias("place", "frame_idx"))
    tags = wanted.join(frames, [key, "frame_idx"])
    lists = tags.groupBy(key).agg(*[ordered_union(c, "place", MERGE_CAPS[c]).alias(c) for c in ("subjects", "setting")])
    return lists.join(ordered_modes(tags, key, "place", ["category"]), key, "left")
