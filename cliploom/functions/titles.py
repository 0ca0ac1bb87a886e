"""Title rules over two lines, highlights and a hook word.

The rules are column expressions; ``finished`` applies them to a table, step by step, with each
step's result evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import schema as S
from cliploom.functions.text import first_name, first_number, manual_title, name_phrases, unique_strings

_NUMBER, _FULL_NUMBER = f"(?i){S.TITLE_NUMBER}", f"(?i)^(?:{S.TITLE_NUMBER})$"


def tidy(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(line, F.lit("."), F.lit("")), r"\s+", " "))


def generic(title: Column, text: Column) -> Column:
    """Whether a number-rule title is too generic for a transcript that tells of a promotion."""
    low, shown = F.lower(F.coalesce(text, F.lit(""))), F.lower(title)
    story = (low.contains("promot") | low.contains("career")) & (low.contains("twice") | low.contains("quickly")) & (first_number(F.coalesce(text, F.lit(""))) != "")
    return story & shown.contains("rule") & (shown.contains("nobody talks about") | (F.length(shown) - F.length(F.replace(shown, F.lit(" "), F.lit(""))) <= 5))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def layout(line1: Column, line2: Column, highlights: Column) -> Column:
    """Struct of lines and highlights: up to five words in one line; a second line only after five
    words; a stub of up to three words loses its highlights; orphans are dropped."""
    one, two = tidy(line1), tidy(line2)
    words = _words(F.concat_ws(" ", one, two))
    n = F.size(words)
    join = lambda part: F.array_join(part, " ")
    cut = F.greatest(F.lit(5), F.floor((n + 1) / 2).cast("int"))
    short, again = n.between(1, 5), (two != "") & (F.size(_words(one)) < 5)
    new1 = F.when(short, F.substring(join(words), 1, 48)).when(again, join(F.slice(words, F.lit(1), cut))).otherwise(one)
    new2 = F.when(short, "").when(again, join(F.slice(words, cut + 1, F.greatest(F.lit(0), n - cut)))).otherwise(two)
    stub = F.size(_words(new2)).between(1, 3)
    inside = lambda h, line: F.lower(line).contains(F.lower(h))
    kept = F.filter(highlights, lambda h: (F.trim(h) != "") & ~(stub & inside(h, new2)) & inside(h, F.concat_ws(" ", new1, new2)))
    return F.struct(new1.alias("line1"), new2.alias("line2"), kept.alias("highlights"))


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0))


def _title_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(S.TITLE_WORD), F.lit(0))


def _strong(words: Column) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*S.WEAK_WORDS))


def _has(line: Column, part: Column) -> Column:
    return F.lower(line).contains(F.lower(part))


def heuristic_highlights(text: Column) -> Column:
    """Names, numbers and the first strong word: four at most."""
    words = F.filter(_strong(_title_words(text)), lambda w: ~w.rlike(_FULL_NUMBER))
    return F.slice(unique_strings(F.concat(name_phrases(text), _numbers(text), F.slice(words, 1, 1))), 1, 4)


def clean_highlight(h: Column) -> Column:
    return F.trim(F.replace(F.translate(h, "{}\\", "()/"), F.lit("."), F.lit("")))


def fitted(candidate: Column, line: Column, names: Column) -> Column:
    """What a candidate highlights in a line, or null.

    A single word that is part of a name there stands for the name; a name inside a longer candidate for itself;
    any other phrase comes down to one word of it, a number or the first strong one.
    """
    single = F.size(_words(F.regexp_replace(candidate, r"\s+", " "))) == 1
    whole = F.get(F.filter(names, lambda n: F.array_contains(F.split(F.lower(n), " "), F.lower(candidate))), F.lit(0))
    inner = F.get(F.filter(name_phrases(candidate), lambda n: _has(line, n)), F.lit(0))
    words = F.filter(_title_words(candidate), lambda w: _has(line, w))
    word = F.coalesce(F.get(F.filter(words, lambda w: w.rlike(_FULL_NUMBER)), F.lit(0)), F.get(_strong(words), F.lit(0)))
    return F.coalesce(F.when(single, whole), F.when(_has(line, candidate), F.coalesce(inner, F.when(single, candidate).otherwise(word))))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row (the optimizer does not look through a generator)."""
    return df.withColumn("_step", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).withColumns({n: F.col(f"_step.{n}") for n in columns}).drop("_step")


def finished(rows: DataFrame, line1: str = "line1", line2: str = "line2", highlights: str = "highlights", hook: str = "hook_word") -> DataFrame:
    """Rows with their two lines, highlights and hook word under all title rules.

    Lines are laid out (see ``layout``); then at most one highlight per line is chosen, candidates in order, a line two
    of up to three words gets none, and line one gets one from its own words if nothing fits.  A given hook word that
    stands in the title is kept; else a name, a number (money first) or the longest strong word is taken, and joins the highlights.
    """
    none = F.array().cast("array<string>")
    df = _once(rows, _laid=layout(F.coalesce(line1, F.lit("")), F.coalesce(line2, F.lit("")), F.coalesce(highlights, none)))
    df = df.withColumns({line1: F.col("_laid.line1"), line2: F.col("_laid.line2")})
    one, two = F.col(line1), F.col(line2)
    df = _once(df, _both=F.concat_ws(" ", one, two), _cands=unique_strings(F.transform("_laid.highlights", clean_highlight)), _n1=name_phrases(one), _n2=name_phrases(two))
    df = _once(df, _cands=F.when(F.size("_cands") > 0, F.col("_cands")).otherwise(heuristic_highlights(F.concat(one, F.lit(" "), two))))
    df = _once(df, _fit=F.transform("_cands", lambda c: F.struct(fitted(c, one, F.col("_n1")).alias("one"), F.when(F.size(_words(two)) > 3, fitted(c, two, F.col("_n2"))).alias("two"))))
    null = F.lit(None).cast("string")
    step = lambda a, x: (
        F.when(a["one"].isNull() & x["one"].isNotNull(), F.struct(x["one"].alias("one"), a["two"].alias("two")))
        .when(a["two"].isNull() & x["two"].isNotNull(), F.struct(a["one"].alias("one"), x["two"].alias("two")))
        .otherwise(a)
    )
    df = _once(df, _won=F.aggregate("_fit", F.struct(null.alias("one"), null.alias("two")), step))
    own = F.get(F.filter(F.transform(heuristic_highlights(one), lambda c: fitted(c, one, F.col("_n1"))), lambda h: h.isNotNull()), F.lit(0))
    first = F.when(F.col("_won.one").isNull() & F.col("_won.two").isNull(), own).otherwise(F.col("_won.one"))
    df = _once(df, **{highlights: F.filter(F.array(first, F.col("_won.two")), lambda h: h.isNotNull())})
    kept = F.when(_has(F.col("_both"), F.col(hook)) & (F.col(hook) != ""), F.col(hook)) if hook in rows.columns else null
    df = _once(df, **{hook: F.coalesce(kept, hook_word(one, two), F.get(F.col(highlights), F.lit(0)), F.get(_words(one), F.lit(0)))})
    joined = F.exists(highlights, lambda h: F.lower(h) == F.lower(F.col(hook)))
    df = df.withColumn(highlights, F.when(joined | F.col(hook).isNull(), F.col(highlights)).otherwise(F.concat(highlights, F.array(hook))))
    return df.drop("_laid", "_both", "_cands", "_n1", "_n2", "_fit", "_won")


def hook_word(line1: Column, line2: Column) -> Column:
    """First name that stands in the title, else number (money first), else the longest strong word of line one, else of both."""
    both = F.concat(line1, F.lit(" "), line2)
    numbers = _numbers(both)
    money = F.filter(numbers, lambda n: F.lower(n).rlike("[$kmb]"))
    longest = lambda line: F.nullif(F.aggregate(_strong(_title_words(line)), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a)), F.lit(""))
    name = F.get(F.filter(name_phrases(both), lambda n: _has(both, n)), F.lit(0))
    return F.coalesce(name, F.get(money, F.lit(0)), F.get(numbers, F.lit(0)), longest(line1), longest(both))


#: Words of which a template wants one, by the name of the flag that says so.
_MENTIONED = {
    "promoted": ("promot", "career"), "soon": ("twice", "quickly"), "ai": ("ai",), "customer": ("customer",), "killing": ("kill", "faster horse"),
    "iphone": ("iphone",), "company": ("company", "business"), "firm": ("company", "business", "startup"), "kill_company": ("kill", "company"),
}


def mentions(text: Column, low: Column) -> Column:
    """What a transcript mentions, and whether it is empty; ``low``: its lower case."""
    flags = [F.greatest(*[low.contains(w) for w in words], F.lit(False)).alias(name) for name, words in _MENTIONED.items()]
    return F.struct((F.trim(low) == "").alias("empty"), first_name(text).alias("name"), F.nullif(first_number(text), F.lit("")).alias("number"), *flags)


def templated_rows(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the struct ``title`` that ``templated`` makes of a column; what it asks for is worked out once per row."""
    rows = _once(rows, _low=F.lower(F.coalesce(text, F.lit(""))))
    rows = _once(rows, _said=mentions(F.col(text), F.col("_low")))
    return rows.withColumn("title", _template(F.col("_said"))).drop("_low", "_said")


def templated(text: Column) -> Column:
    """A raw title from what a transcript mentions (``finished`` applies the rules): one decision list over name, number and key words.

    The test for "ai" is on letters, so it is also met inside other words.
    """
    return _template(mentions(text, F.lower(F.coalesce(text, F.lit("")))))


def _template(said: Column) -> Column:
    has = lambda flag: said[flag]
    name, number = said["name"], said["number"]
    named, numbered = name.isNotNull(), number.isNotNull()
    rise = numbered & has("promoted") & has("soon")

    def made(one, two, *marks) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_column(one).alias("line1"), as_column(two).alias("line2"), F.array(*map(as_column, marks)).alias("highlights"))

    rule, technique = F.concat(name, F.lit("'s Secret Rule")), F.concat(name, F.lit("'s Secret Technique"))
    twice, aged = F.concat(name, F.lit(" Got Promoted Twice")), F.concat(F.lit("This "), number, F.lit("-Year-Old Got Promoted Twice"))
    rules = [
        (said["empty"], made("The Secret Clip", "You Need To See", "Secret")),
        (named & rise & has("ai"), made(twice, F.concat(F.lit("At "), number, F.lit(" With One AI Move")), name, "AI")),
        (named & rise, made(twice, F.concat(F.lit("At Just "), number, F.lit(" Years Old")), name, number)),
        (named & has("customer") & has("killing"), made(rule, "For Ignoring Customers", name, "Customers")),
        (named & has("iphone"), made(rule, "For Building The iPhone", name, "iPhone")),
        (named & numbered & has("company"), made(rule, F.concat(F.lit("To Build A "), number, F.lit(" Company")), name, number)),
        (named & has("firm"), made(technique, "For Building Companies", name, "Companies")),
        (named, made(technique, "That Changed Everything", name, "Secret")),
        (has("customer") & has("kill_company"), made("The Customer Trap", "That Kills Companies", "Customer", "Kills")),
        (rise & has("ai"), made(aged, "After One AI Move", number, "AI")),
        (rise, made(aged, "After One Bold Move", number, "Twice")),
        (numbered, made(F.concat(F.lit("The "), number, F.lit(" Rule")), "Nobody Talks About", number, "Rule")),
        (has("ai"), made("The AI Secret", "Nobody Is Saying", "AI", "Secret")),
    ]
    chain = F.when(*rules[0])
    for condition, title in rules[1:]:
        chain = chain.when(condition, title)
    return chain.otherwise(made("The Secret Rule", "Behind This Clip", "Secret", "Rule"))


def route(mode: Column, reference_title: Column, text: Column) -> Column:
    """Where a title comes from: manual, pattern (of the reference's title), generated or fixed."""
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(mode == "manual", "manual").when((mode == "replicate") & some(reference_title), "pattern").when(some(text), "generated").otherwise("fixed")


def routed(rows: DataFrame, mode: str, manual: str, reference_title: str, text: str, answer1: str, answer2: str) -> DataFrame:
    """Rows with ``route`` and a finished title (line1, line2, highlights, hook_word).

    A manual text is split in two; an answer of a model serves if it is not too generic for the text, else the
    templates do.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    way = route(F.col(mode), F.col(reference_title), F.col(text))
    one, two = manual_title(blank(manual))
    heuristic = heuristic_highlights(F.concat(one, F.lit(" "), two))
    answered = way.isin("pattern", "generated") & F.col(answer1).isNotNull() & ~generic(F.concat(F.col(answer1), F.lit(" "), blank(answer2)), F.col(text))
    title = lambda a, b, h: F.struct(a.alias("line1"), b.alias("line2"), h.alias("highlights"))
    raw = F.when(way == "manual", title(one, two, heuristic)).when(answered, title(F.col(answer1), blank(answer2), F.array().cast("array<string>"))).otherwise(templated(F.when(way == "fixed", F.lit("")).otherwise(F.col(text))))
    df = _once(rows, route=way, _raw=raw)
    return finished(df.withColumns({"line1": F.col("_raw.line1"), "line2": F.col("_raw.line2"), "highlights": F.col("_raw.highlights")}).drop("_raw"))
