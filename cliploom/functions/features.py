"""Column functions over feature rows: normalising, validating, keys and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliploom import schema as S

MEDIA_SUFFIX = r"\.(mp4|mov|mkv|webm|m4v)$"


def clip01(value: Column) -> Column:
    """Into [0, 1]; NaN and infinities become 0 (Spark orders NaN above every number)."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def tidy_list(values: str, cap: int) -> Column:
    """Cap first, then trim, lower-case and drop blanks: a blank among the first uses up a slot."""
    return F.filter(F.transform(F.slice(values, 1, cap), lambda s: F.lower(F.trim(s))), lambda s: s != "")


def enum_or(value: str, allowed: tuple[str, ...], default: str) -> Column:
    low = F.lower(F.trim(F.col(value)))
    return F.when(low.isin(*allowed), low).otherwise(F.lit(default))


def normalised(columns: list[str]) -> dict[str, Column]:
    """The normal form of those feature columns that are present."""
    out: dict[str, Column] = {}
    for name in columns:
        if name in S.LIST_CAPS:
            out[name] = tidy_list(name, S.LIST_CAPS[name])
        elif name in S.ENUM_DEFAULTS:
            low = F.lower(F.trim(F.col(name)))
            out[name] = F.when(low == "", S.ENUM_DEFAULTS[name]).otherwise(low)
        elif name in S.NUMERICS:
            out[name] = clip01(F.col(name))
        elif name == "query":
            out[name] = F.trim(F.regexp_replace(F.col(name), r"\s+", " "))
    return out


def errors(columns: list[str]) -> Column:
    """Messages of a feature row: closed enums, mood words, list caps, numbers out of [0, 1]."""
    found = []
    for name in columns:
        if name in S.ENUMS:
            found.append(F.when(~F.col(name).isin(*S.ENUMS[name]), F.concat(F.lit(f"{name}: "), F.col(name))))
        if name == "source":
            found.append(F.when(~F.col(name).isin(*S.SOURCES), F.lit("source")))
        if name == "mood":
            found.append(F.when(F.size(F.array_except("mood", F.array(*map(F.lit, S.MOODS)))) > 0, F.lit("mood: unknown word")))
        if name in S.LIST_CAPS:
            found.append(F.when(F.size(name) > S.LIST_CAPS[name], F.lit(f"{name}: too many")))
        if name in S.NUMERICS:
            value = F.col(name)
            found.append(F.when(value.isNull() | F.isnan(value) | (value < 0) | (value > 1), F.lit(f"{name}: not in [0, 1]")))
    return F.array_compact(F.array(*found))


def strict(columns: list[str]) -> Column:
    """An error column that raises when there is any message."""
    every = errors(columns)
    return F.when(F.size(every) > 0, F.raise_error(F.array_join(every, "; ")))


def confidence(texts: list[str], lists: list[str], numerics: list[str]) -> Column:
    """Half the share of filled tag fields plus half for all (1) or not all (0.5) metrics."""
    filled = [F.when(F.trim(F.col(c)) != "", 1).otherwise(0) for c in texts] + [F.when(F.size(c) > 0, 1).otherwise(0) for c in lists]
    tags = sum(filled[1:], filled[0]) / float(len(filled))
    whole = F.when(F.lit(True) if not numerics else F.expr(" and ".join(f"{c} is not null" for c in numerics)), 1.0).otherwise(0.5)
    return clip01(0.5 * tags + 0.5 * whole)


def first_words(text: Column, count: int = 8, drop_quotes: bool = False) -> Column:
    plain = F.regexp_replace(text, "[\"']", "") if drop_quotes else text
    return F.array_join(F.slice(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), 1, count), " ")


def expanded_queries() -> Column:
    """Five search queries of a reference, repeated ones dropped in order."""
    lead = lambda name, other: F.when(F.size(name) > 0, F.get(F.col(name), F.lit(0))).otherwise(F.lit(other))
    subject, setting, action = lead("subjects", "broll"), F.array_join(F.slice("setting", 1, 2), " "), lead("action", "scene")
    mood = F.when(F.size("mood") > 0, F.get(F.col("mood"), F.lit(0))).otherwise(F.coalesce(F.nullif(F.col("energy"), F.lit("")), F.lit("cinematic")))
    palette = lead("color_palette", "cinematic")
    made = [(subject, action), (subject, mood), (subject, F.col("lighting")), (subject, setting), (subject, palette)]
    return F.array_distinct(F.array(*[first_words(F.concat_ws(" ", *pair)) for pair in made]))


def wide_queries(query: str) -> Column:
    """The query and its b-roll form; nothing for an empty one."""
    trimmed = F.trim(F.col(query))
    wide = F.when(F.lower(trimmed).endswith("b roll"), trimmed).otherwise(F.concat(trimmed, F.lit(" b roll")))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(trimmed, wide)))


def path_tokens(path: str) -> Column:
    """Distinct lower-case tokens of the parent folder and the stem, in order, two signs at least, no stop words."""
    tail = F.regexp_extract(F.col(path), r"([^/]*/)?[^/]*$", 0)
    stem = F.regexp_replace(F.regexp_replace(tail, r"\.[^./]*$", ""), "_", " ")
    tokens = F.regexp_extract_all(F.lower(stem), F.lit(r"[a-z0-9$]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*S.PATH_STOP_WORDS)))


def folder_category(path: str) -> Column:
    """The category of the nearest folder above a file whose name stands for one, else other."""
    folders = F.reverse(F.split(F.regexp_replace(F.lower(F.col(path)), "_", " "), "/"))
    above = F.slice(folders, 2, F.greatest(F.lit(0), F.size(folders) - 1))

    def named(folder: Column) -> Column:
        found = F.lit(None).cast("string")
        for mark, category in reversed(S.FOLDER_CATEGORIES):
            found = F.when(folder.contains(mark), category).otherwise(found)
        return found

    return F.coalesce(F.get(F.filter(F.transform(above, named), lambda c: c.isNotNull()), F.lit(0)), F.lit("other"))


def path_tags(path: str) -> Column:
    """Struct of subjects (four tokens), setting (none), category (of the folders) and query (eight tokens, or the stem)."""
    tokens = path_tokens(path)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.col(path), "[^/]*$", 0), r"\.[^./]*$", ""), "_", " ")
    text = F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(stem)
    return F.struct(F.slice(tokens, 1, 4).alias("subjects"), F.array().cast("array<string>").alias("setting"), folder_category(path).alias("category"), first_words(text).alias("query"))


def cache_key(query: str, per_query: int) -> Column:
    """24 hex digits that name a search: the trimmed lower-case query and the number of results."""
    return F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim(F.col(query))), F.lit(str(per_query))), 256), 1, 24)


def is_junk(url: str, title: str) -> Column:
    low = F.lower(F.col(title))
    hits = [low.contains(t) for t in S.JUNK_TERMS]
    every = hits[0]
    for hit in hits[1:]:
        every = every | hit
    return F.col(url).contains("/shorts/") | every


def aligned(start: Column, end: Column, reference: Column, clip: Column) -> tuple[Column, Column]:
    """A reference span on a clip's time line: as is if it ends inside, else moved to the end.

    Without a clip length the span stays; without a reference length, or if empty, only its end moves.
    """
    length = F.greatest(F.lit(0.08), F.least(F.lit(1.0), (end - start) / F.nullif(reference, F.lit(0.0))) * clip)
    moved = F.when((reference <= 0) | (end <= start), start).otherwise(F.greatest(F.lit(0.0), clip - length))
    inside = end <= clip
    return F.when(inside | (clip <= 0), start).otherwise(moved), F.when(clip <= 0, F.greatest(start, end)).when(inside, end).otherwise(clip)


def widened(start: Column, end: Column, duration: Column, target: float = 15.0, least: float = 8.0, most: float = 30.0) -> tuple[Column, Column]:
    """A clip range inside its source: widened around its centre to the target if shorter than the
    least, cut if longer than the most, rounded half-even to two places."""
    goal = F.when(duration > 0, F.least(F.lit(target), duration)).otherwise(F.lit(target))
    low = F.least(F.lit(least), goal, F.when(duration != 0, duration).otherwise(goal))
    high = F.least(F.lit(most), F.when(duration != 0, duration).otherwise(F.lit(most)))
    first = F.greatest(F.lit(0.0), F.least(start, F.greatest(F.lit(0.0), duration - low)))
    last = F.greatest(first, F.least(end, duration))
    length = last - first
    wide_end = F.least(duration, F.greatest(F.lit(0.0), first + length / 2 - goal / 2) + goal)
    new_first = F.when(length < low, F.greatest(F.lit(0.0), wide_end - goal)).otherwise(first)
    new_last = F.when(length < low, wide_end).when(length > high, F.least(duration, first + high)).otherwise(last)
    new_last = F.when(new_last <= new_first, F.least(duration, new_first + goal)).otherwise(new_last)
    return F.bround(new_first, 2), F.bround(new_last, 2)


def sample_times(duration: Column) -> Column:
    """A quarter, half and three quarters; start, middle and end of very short clips."""
    long = F.array(duration * 0.25, duration * 0.5, duration * 0.75)
    short = F.array(F.lit(0.0), duration * 0.5, F.greatest(F.lit(0.0), duration - 0.05))
    return F.when(duration <= 0, F.array(F.lit(0.0))).when(duration <= 1.5, short).otherwise(long)


def tolerant(fields: Column, name: str) -> Column:
    """One field of a parsed document, read tolerantly: unknown or missing values become defaults."""
    value = fields.getField(name)
    if name in S.LIST_CAPS:
        clean = F.filter(F.transform(value, lambda v: F.lower(F.trim(v))), lambda v: v != "")
        if name == "mood":
            clean = F.array_distinct(F.array_intersect(clean, F.array(*map(F.lit, S.MOODS))))
        return F.coalesce(F.slice(clean, 1, S.LIST_CAPS[name]), F.array().cast("array<string>"))
    if name in S.NUMERICS:
        return F.when(value.isNull() | F.isnan(value), 1.0 if name == "confidence" else 0.5).otherwise(clip01(value))
    low = F.lower(F.trim(value))
    allowed = S.SOURCES if name == "source" else S.ENUMS[name]
    return F.coalesce(F.when(low.isin(*allowed), low), F.lit(S.ENUM_DEFAULTS[name]))


def gain(source_db: Column, target_db: Column) -> Column:
    unknown = source_db.isNull() | target_db.isNull() | (source_db <= -90) | (target_db <= -90)
    return F.when(unknown, 0.18).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.5), F.pow(F.lit(10.0), (target_db - source_db) / 20))))


def failure_reason(text: Column) -> Column:
    """What stopped a search, by the first rule whose words occur; '' for none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    some = lambda *words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    return (
        F.when(some("sign in to confirm", "not a bot", "captcha"), "bot check")
        .when(some("cookie") & some("could not copy", "failed to decrypt", "extract"), "cookie extraction")
        .when(some("cookie") & some("invalid", "expired"), "cookie invalid")
        .when(some("http error 429", "too many requests"), "rate limit")
        .when(some("unable to download", "network", "getaddrinfo"), "network")
        .otherwise("")
    )


def file_key(content: Column, block: int = 1 << 20) -> Column:
    """md5 of a file's size and its first and last MiB (once, if the file is shorter than that)."""
    size = F.octet_length(content)
    head = F.concat(F.concat(F.lit("size:"), size.cast("string"), F.lit("\n")).cast("binary"), F.substring(content, 1, block))
    tail = F.substring(content, F.greatest(F.lit(1), size - block + 1).cast("int"), F.lit(block))
    return F.md5(F.when(size > block, F.concat(head, tail)).otherwise(head))


def path_key(path: str, size: str, mtime: str) -> Column:
    """24 hex digits that name one state of a file: path, size and whole seconds."""
    return F.substring(F.sha2(F.concat_ws("|", F.col(path), F.col(size).cast("string"), F.floor(mtime).cast("string")), 256), 1, 24)


def match_note(score: Column, confidence: Column) -> Column:
    """A label with its score, or why there is none: no features (null), or a sentinel without confidence.

    The two places are those of the double itself: ``format_string`` would round its shortest decimal form, 0.715 to 0.72.
    """
    places = F.call_function("format_number", score, F.lit("0.00"))
    text = F.concat(match_label(score), F.lit(" match ("), places, F.lit(")"))
    return F.when(confidence.isNull(), "no preview features available").when(confidence <= 0, "empty-sentinel fallback").otherwise(text)


def name_key(path: str, words: int = 4) -> Column:
    """The first words of a file's name, lower case, without extension and other signs."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(F.col(path), "[^/]*$", 0), r"\.[^./]*$", ""))
    kept = F.filter(F.split(F.regexp_replace(stem, r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")
    return F.array_join(F.slice(kept, 1, words), " ")


#: Labels of scores from a limit on, and that of all others.
MATCH_LABELS, NO_MATCH = [("strong", 0.8), ("good", 0.6), ("weak", 0.4)], "poor"


def match_label(score: Column) -> Column:
    (name, least), *others = MATCH_LABELS
    found = F.when(score >= least, name)
    for name, least in others:
        found = found.when(score >= least, name)
    return found.otherwise(NO_MATCH)


def gradient_bits(grey: str, width: int = 9, height: int = 8) -> Column:
    """64 difference bits of a grey grid, row by row: left brighter than right, bit 0 first."""

    def bit(i: Column) -> Column:
        at = (F.floor(i / (width - 1)) * width + i % (width - 1)).cast("int")
        higher = F.get(F.col(grey), at) > F.get(F.col(grey), at + 1)
        return F.when(higher, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))

    steps = F.sequence(F.lit(0), F.lit((width - 1) * height - 1))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i)))
