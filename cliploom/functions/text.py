"""Text scores of transcripts and titles as column expressions.

Three ways to normalise are kept apart: the profile's (keeps . ' - $ % +), the window's (keeps
$ % + only) and plain lower-casing for learning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import schema as S

NUMBER = r"\$?[0-9][0-9,.]*(?:k|m|b|%|x|\+)?"
WORD = r"[a-z0-9$%+-]+"


def profile_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9$%+.' -]", " "), r"\s+", " "))


def profile_tokens(text: Column) -> Column:
    return F.regexp_extract_all(profile_text(text), F.lit(WORD), F.lit(0))


def window_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9$%+ ]", " ")


def window_tokens(text: Column) -> Column:
    return F.filter(F.split(window_text(text), " +"), lambda t: t != "")


def marks(text: Column) -> Column:
    count = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    return 1.5 * count("?") + 1.0 * count("!")


def numbers(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def _weights(table: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def term_sum(tokens: Column, table: dict[str, float]) -> Column:
    if not table:
        return F.lit(0.0)
    known = _weights(table)
    # Few tokens are in the dictionary: a hashed filter first, then the look-ups.
    tokens = F.filter(tokens, lambda t: t.isin(*table))
    return _sum(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), F.lit(0.0))))


def phrase_sum(normal: Column, table: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for phrase, weight in table.items():
        total = total + F.when(normal.contains(phrase), weight).otherwise(0.0)
    return total


@dataclass(frozen=True)
class Prepared:
    """A text with its normal forms and tokens as columns that are evaluated once per row."""

    text: Column
    normal: Column
    tokens: Column
    window: Column
    window_tokens: Column


def prepared(df: DataFrame, text: str) -> tuple[DataFrame, Prepared]:
    """Add the forms of a text column.

    They stand behind a generator: the optimizer would otherwise copy the regular expressions into
    every place, and every lambda, that uses them.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    forms = F.struct(
        body.alias("text"), profile_text(body).alias("normal"), profile_tokens(body).alias("tokens"),
        window_text(body).alias("window"), window_tokens(body).alias("window_tokens"),
    )
    name = f"forms_of_{text}"
    out = df.withColumn(name, F.explode(F.array(forms)))
    return out, Prepared(*[F.col(f"{name}.{c}") for c in ("text", "normal", "tokens", "window", "window_tokens")])


@dataclass(frozen=True)
class Profile:
    """Weights of terms and phrases: the defaults overridden by learned ones, and learned openings."""

    terms: dict[str, float] = field(default_factory=lambda: dict(S.TERM_WEIGHTS))
    phrases: dict[str, float] = field(default_factory=lambda: dict(S.PHRASE_WEIGHTS))
    opening_terms: dict[str, float] = field(default_factory=dict)
    opening_phrases: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, learned: DataFrame) -> Profile:
        """From ``aggregates.learned_profile``: (part, gram, weight), 140 rows at most."""
        parts: dict[str, dict[str, float]] = {}
        for r in learned.select("part", "gram", "weight").orderBy("part", "gram").collect():
            parts.setdefault(r["part"], {})[r["gram"].lower()] = float(r["weight"])
        known = lambda name: parts.get(name, {})
        return cls(dict(S.TERM_WEIGHTS) | known("terms"), dict(S.PHRASE_WEIGHTS) | known("phrases"), known("opening_terms"), known("opening_phrases"))


def score_text(t: Prepared, terms: dict[str, float] = S.TERM_WEIGHTS, phrases: dict[str, float] = S.PHRASE_WEIGHTS) -> Column:
    """Dictionary score of a text; 0 without tokens.  A token has no apostrophe, so "don't" never counts."""
    some = lambda *words: F.arrays_overlap(t.tokens, F.array(*map(F.lit, words)))
    score = (
        F.least(F.size(t.tokens), F.lit(80)) / 55.0 + term_sum(t.tokens, terms) + phrase_sum(t.normal, phrases) + 2.8 * numbers(t.normal)
        + marks(t.text) + F.when(some("but", "however", "actually", "instead"), 1.6).otherwise(0.0)
        + F.when(some("never", "wrong", "bullshit"), 2.2).otherwise(0.0)
    )
    return F.when(F.size(t.tokens) > 0, score).otherwise(0.0)


def score_opening(t: Prepared, terms: dict[str, float] | None = None, phrases: dict[str, float] | None = None) -> Column:
    score = term_sum(t.tokens, terms or {}) + phrase_sum(t.normal, phrases or {}) + 0.65 * score_text(t)
    return F.when(F.size(t.tokens) > 0, score).otherwise(0.0)


def viral_score(t: Prepared, dictionary: Column | None = None) -> Column:
    """Window score; ``dictionary`` is the text's dictionary score if it is at hand."""
    hooks = F.size(F.filter(t.window_tokens, lambda w: w.isin(*S.HOOK_WORDS)))
    return F.size(t.window_tokens) / 50.0 + 2.0 * hooks + 2.5 * numbers(t.window) + marks(t.text) + (score_text(t) if dictionary is None else dictionary)


def starts_with_hook(t: Prepared, opening_terms: tuple[str, ...] = ()) -> Column:
    first = F.slice(t.window_tokens, 1, 8)
    return F.exists(first, lambda w: w.isin(*S.HOOK_WORDS, *opening_terms)) | F.array_join(first, " ").rlike(NUMBER)


def first_number(text: Column) -> Column:
    """The first number of a title: also hours and times of day."""
    return F.regexp_extract(text, f"(?i){S.TITLE_NUMBER}", 0)


def name_phrases(text: Column) -> Column:
    """Pairs of neighbouring capitalised words, possessives stripped, none a stop word, first seen first."""
    return unique_strings(_name_pairs(text))


def first_name(text: Column) -> Column:
    """The first of ``name_phrases``, or null; nothing has to be made distinct for it."""
    return F.get(F.filter(F.transform(_name_pairs(text), lambda p: F.trim(p)), lambda p: p != ""), F.lit(0))


def _name_pairs(text: Column) -> Column:
    token = r"\b[A-Z][A-Za-z'.-]+\b"
    pairs = F.regexp_extract_all(text, F.lit(rf"(?=({token}\s+{token}))"), F.lit(1))
    plain = F.transform(pairs, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?:'s|')(?=\s|$)", ""), r"\s+", " "))
    stop = F.array(*map(F.lit, S.NAME_STOP_WORDS))
    return F.filter(plain, lambda p: p.rlike(r"^[A-Z][A-Za-z'.-]+ [A-Z][A-Za-z'.-]+$") & ~F.arrays_overlap(F.split(p, " "), stop))


def unique_strings(values: Column) -> Column:
    """Trimmed non-blank elements in order, the first of those that differ in case only."""
    plain = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    low = F.transform(plain, lambda v: F.lower(v))
    return F.filter(plain, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def manual_title(text: Column) -> tuple[Column, Column]:
    """Up to three words in one line; else line one grows while it stays within half the length."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    half = F.length(text) / 2
    fits = F.aggregate(
        words,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open")),
        lambda a, w: F.when(
            a["open"] & ((a["n"] == 0) | (a["size"] + 1 + F.length(w) <= half)),
            F.struct((a["n"] + 1).alias("n"), (a["size"] + F.when(a["n"] > 0, 1).otherwise(0) + F.length(w)).alias("size"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["n"].alias("n"), a["size"].alias("size"), F.lit(False).alias("open"))),
        lambda a: a["n"],
    )
    cut = F.when(F.size(words) <= 3, F.size(words)).otherwise(fits)
    clean = lambda part: F.trim(F.regexp_replace(F.replace(F.array_join(part, " "), F.lit("."), F.lit("")), r"\s+", " "))
    line = lambda part: F.substring(clean(part), 1, 40)
    return line(F.slice(words, F.lit(1), cut)), line(F.slice(words, cut + 1, F.greatest(F.lit(0), F.size(words) - cut)))


def _marked(line: Column, highlights: Column) -> tuple[Column, Column]:
    """A line with its longest highlight, the first of equally long, between asterisks; and that highlight."""
    found = F.filter(highlights, lambda h: (h != "") & F.lower(line).contains(F.lower(h)))
    best = F.aggregate(found, F.lit(""), lambda a, h: F.when(F.length(h) > F.length(a), h).otherwise(a))
    at = F.instr(F.lower(line), F.lower(best))
    marked = F.concat(F.substr(line, F.lit(1), at - 1), F.lit("*"), F.substr(line, at, F.length(best)), F.lit("*"), F.substr(line, at + F.length(best)))
    return F.when(best == "", line).otherwise(marked), best


def highlighted(line1: Column, line2: Column, highlights: Column) -> tuple[Column, Column]:
    """Both lines with one highlight each at most; a highlight that line one used is not used again."""
    one, used = _marked(line1, highlights)
    place = F.array_position(highlights, used)
    left = F.filter(highlights, lambda h, i: (used == "") | (i + 1 != place))
    return one, _marked(line2, left)[0]


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc"""
    s = F.greatest(F.lit(0.0), seconds)
    return F.format_string("%d:%02d:%05.2f", F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"), s % 60)


def safe_caption(text: Column) -> Column:
    return F.trim(F.translate(text, "{}\\", "()/"))
