"""Personal data by base patterns and bootstrapped contexts, DataFrame-only.

Base: e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers, found
by regular expressions that read each text once from left to right.  Their quantifiers are
possessive where nothing can be given back, and a run is entered only at its start (or where the
last match ended), so matching is linear even in very long runs.  Positions follow from the lengths
of what lies between matches; they count code points.

Method: base finds are seeds, and so are access key ids and hexadecimal strings that change often between digits
and letters (kind ``secret``), which random strings mostly do and other ones hardly.  An
instance is a run of tokens with digits or an at sign.  Its lexical patterns are the two tokens before it, the token
before it with the shape of the run, and the key that stands before ``=`` or ``:`` in the run's own token.
Patterns and instances form a graph.  In each of ``ROUNDS`` rounds a pattern's confidence for a kind is the score
of the instances behind it over all instances behind it, those of no known kind counted half, and an instance that is no seed gets the noisy-or of the
confident patterns it stands behind.  Patterns with at least ``SUPPORT`` different instances of that
kind and a confidence of ``CONFIDENT`` or more mark every instance behind them: unseen identifiers.

Added spans carry the kind of their pattern; seeds of kind ``secret`` are added too.  Base spans always stay;
``n_email`` to ``n_phone`` count base spans, ``n_secret_seeds`` and ``n_discovered`` those that seeds and patterns add.

Defined results: null and empty texts have no spans; rows are reported one by one; instances of
equal rows count once for a pattern's support; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed_once, packed, stored, unpacked

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
_LOCAL, _OCTET = "[A-Za-z0-9._%+-]", r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
INSTANCE = r"(?<!\S)(?=\S*[0-9@])\S++(?:\x20(?=[0-9().+-]*[0-9])[0-9().+-]++(?!\S))*+"
#: What is surely a secret: an access key id, or 16 and more hexadecimal digits of one case in at least eight changes from
#: digits to letters.  One in eight random strings of 40 digits has fewer: those are left to the patterns.
_MIXED = "(?=[0-9{x}]{{16,}}+$)[{x}]*+(?:[0-9]++[{x}]++){{8,}}+[0-9]*+"
SECRET_VALUE = f"^(?:AKIA[A-Z0-9]{{16}}|{_MIXED.format(x='a-f')}|{_MIXED.format(x='A-F')})$"
KEYED = r"^[\p{L}_][\p{L}0-9_.-]*[=:]"
SUPPORT, CONFIDENT, ROUNDS, CHUNK = 5, 0.8, 3, 256
#: Weight of an instance of no known kind against a pattern: less than one of another kind, which is surely none.
UNKNOWN = 0.5
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _scanned(pairs: Column, start: Column, step, made: str) -> Column:
    """``step(state, pair)`` gives the next state and an element (null for none); all elements, in order.

    Pairs are folded in chunks, so that elements are copied about ``CHUNK`` times each, not once for every other one.
    """
    none = F.array().cast(f"array<{made}>")

    def each(a: Column, p: Column) -> Column:
        state, element = step(a["state"], p)
        return F.struct(state.alias("state"), F.when(p["hit"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(element))).alias("out"))

    def chunk(a: Column, c: Column) -> Column:
        last = F.aggregate(c, F.struct(a["last"]["state"].alias("state"), none.alias("out")), each)
        return F.struct(last.alias("last"), F.concat(a["done"], F.array(a["last"]["out"])).alias("done"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)))
    first = F.struct(F.struct(start.alias("state"), none.alias("out")).alias("last"), F.array().cast(f"array<array<{made}>>").alias("done"))
    return F.aggregate(chunks, first, chunk, lambda a: F.flatten(F.concat(a["done"], F.array(a["last"]["out"]))))


def _pairs(text: str, pattern: str) -> Column:
    """The gaps between the matches, each with the match that follows it."""
    return F.arrays_zip(F.split(F.col(text), pattern, -1).alias("gap"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hit"))


def _spans(text: str, pattern: str, fields) -> Column:
    """Start and end of the matches that ``fields`` accepts: positions follow from the gaps between them."""

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + F.length(p["gap"])
        return start + F.coalesce(F.length(p["hit"]), F.lit(0)), F.struct(p["hit"].alias("hit"), start.alias("start"))

    every = _scanned(_pairs(text, pattern), F.lit(0), step, "struct<hit:string,start:int>")
    return F.transform(F.filter(every, lambda m: fields(m["hit"])), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["hit"])).alias("end")))


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substr(backwards, i, F.lit(1)).cast("int")).otherwise(
            (lambda d: d * 2 - F.when(d > 4, 9).otherwise(0))(F.substr(backwards, i, F.lit(1)).cast("int"))
        ),
    )
    return total % 10 == 0


def _valid(kind: str):
    digits = lambda hit: F.length(F.regexp_replace(hit, "[^0-9]", ""))
    if kind == "ip":
        return lambda hit: hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return lambda hit: F.when(digits(hit).between(16, 19), _luhn(F.translate(hit, " -", ""))).otherwise(F.lit(False))
    if kind == "phone":
        return lambda hit: digits(hit).between(8, 15)
    return lambda hit: F.lit(True)


def base_spans(text: str = "text") -> Column:
    """All base spans of a non-null text column: structs of kind number, start and end, in that order."""
    sign = {"email": F.col(text).contains("@"), "phone": F.col(text).contains("+")}
    digit = F.col(text).rlike("[0-9]")
    none = F.array().cast(_SPAN)
    parts = []
    for number, kind in enumerate(KINDS):
        spans = F.transform(_spans(text, PATTERNS[kind], _valid(kind)), lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        parts.append(F.when(sign.get(kind, digit), spans).otherwise(none))
    return F.concat(*parts)


def _tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def _runs() -> Column:
    """Structs of hit, start and place (tokens before it) of every run in ``body``.

    A run begins and ends with whole tokens, so the counts of gaps and hits add up.
    """
    counted = lambda text: F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))

    def step(a: Column, p: Column) -> tuple[Column, Column]:
        start, place = a["at"] + F.length(p["gap"]), a["place"] + counted(p["gap"])
        run = F.struct(p["hit"].alias("hit"), start.alias("start"), place.alias("place"))
        return F.struct((start + F.coalesce(F.length(p["hit"]), F.lit(0))).alias("at"), (place + counted(p["hit"])).alias("place")), run

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("place"))
    return _scanned(_pairs("body", INSTANCE), start, step, "struct<hit:string,start:int,place:int>")


def _shape(text: Column) -> Column:
    """Digits as 9 and letters as a, runs of one sign as one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{L}+", "a"), "[0-9]+", "9"), r"([^a9])\1+", "$1")


def _scan(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, start, end, contexts, instance, kind) of every identifier-like run.

    ``base`` stands in the first row of a document only, and in its one row, without a run, if it has none.

    A run is a token with a digit or an at sign and the number tokens that follow it; what stands before its
    key's ``=`` or ``:`` is no part of the instance.

    ``kind`` is that of the base span it overlaps, or ``SECRET``, if any.  ``contexts`` holds the hashes of its
    patterns.  Only hashes and positions leave the row of a text.
    """
    open_text = F.col("body").rlike("[0-9@]")
    none = F.array().cast("array<struct<hit:string,start:int,place:int>>")
    each = computed_once(rows, "runs", F.when(open_text, _runs()).otherwise(none))
    each = computed_once(each, "t", F.when(F.size("runs") > 0, _tokens("body")))
    each = each.select("doc_id", "text_hash", "t", "base", F.posexplode_outer("runs").alias("at", "r"))
    key = F.coalesce(F.regexp_extract("r.hit", KEYED, 0), F.lit(""))
    each = computed_once(each, "k", F.struct(key.alias("key"), F.substr("r.hit", F.length(key) + 1).alias("value")))
    lead, tail = F.length(F.regexp_extract("k.value", r"^[^\p{L}0-9+@(]*", 0)), F.length(F.regexp_extract("k.value", r"[^\p{L}0-9)]*$", 0))
    start, end = F.col("r.start") + F.length("k.key") + lead, F.col("r.start") + F.length("r.hit") - tail
    each = each.select("*", start.alias("start"), end.alias("end"), F.substr("k.value", lead + 1, F.length("k.value") - lead - tail).alias("value"))
    known = F.get(F.filter("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))), F.lit(0))["kind"]
    kind = F.coalesce(known, F.when(F.col("value").rlike(SECRET_VALUE), SECRET))
    before = lambda n: F.get("t", F.col("r.place") - n)
    contexts = F.array_compact(F.array(
        F.when(F.col("r.place") >= 2, F.xxhash64(F.lit("two"), before(2), before(1))),
        F.when(F.col("r.place") >= 1, F.xxhash64(F.lit("shape"), before(1), _shape(F.col("k.value")))),
        F.when(F.col("k.key") != "", F.xxhash64(F.lit("key"), F.lower("k.key"))),
    ))
    first = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("base")).alias("base")
    return each.select("doc_id", "text_hash", first, "start", "end", contexts.alias("contexts"), F.xxhash64(F.lower("value")).alias("instance"), kind.alias("kind"))


def _instances(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, contexts, instance, kind): the runs that hold anything."""
    return _runs_of(_scan(rows))


def _runs_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("end > start").drop("base")


def discovered(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, seed) that secrets and confident patterns add to the base spans.

    ``rows``: doc_id, text_hash, body and base of every document, which are read once.
    """
    return _bootstrapped(stored(_scan(rows), "pii-instances"))


def _bootstrapped(scanned: DataFrame) -> DataFrame:
    """The same from the stored rows of ``_scan``; a round looks at every pattern with enough scored instances of a kind."""
    edges = _runs_of(scanned)
    each = edges.select(F.explode("contexts").alias("context"), "instance", "kind").groupBy("context", "instance", "kind").agg(F.count(F.lit(1)).alias("times"))
    # A context with fewer different instances of any kind can never get enough of one kind.
    totals = each.groupBy("context").agg(F.countDistinct("instance").alias("n"), F.sum(F.col("times") * F.when(F.col("kind").isNull(), UNKNOWN).otherwise(1.0)).alias("total")).where(F.col("n") >= SUPPORT).select("context", "total")
    graph = stored(each.join(totals, "context"), "pii-graph")
    seeds = graph.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = seeds
    for number in range(ROUNDS):
        mass = graph.drop("kind").join(scores, "instance").groupBy("context", "kind").agg(
            F.sum(F.col("times") * F.col("score")).alias("mass"), F.countDistinct("instance").alias("different"), F.first("total").alias("total")
        )
        patterns = mass.select("context", "kind", F.least(F.lit(1.0), F.col("mass") / F.col("total")).alias("confidence"), "different")
        patterns = stored(patterns.where((F.col("different") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)).drop("different"), f"pii-confident-{number}")
        if number < ROUNDS - 1:
            found = graph.where("kind is null").drop("kind").join(patterns, "context").groupBy("instance", "kind").agg(
                (1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("score")
            )
            scores = stored(seeds.unionByName(found.join(seeds, "instance", "left_anti")), f"pii-scores-{number}")
    where = ["doc_id", "text_hash", "start", "end"]
    behind = edges.where("kind is null").select(*where, F.explode("contexts").alias("context")).join(patterns, "context")
    unseen = behind.groupBy(*where).agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    secret = edges.where(F.col("kind") == SECRET).select(*where, "kind", F.lit(True).alias("seed"))
    return unseen.withColumn("seed", F.lit(False)).unionByName(secret).select("doc_id", "text_hash", "kind", "start", "end", "seed")


def _prepared(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return computed_once(docs.select("doc_id", F.xxhash64(body).alias("text_hash"), body.alias("body")), "base", base_spans("body"))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, spans, n_secret_seeds, n_discovered) of every row: base spans, and with those the patterns add."""
    scanned = stored(_scan(_prepared(docs)), "pii-instances")
    count = lambda test: F.size(F.collect_set(F.when(test, F.struct("start", "end")))).cast("long")
    added = _bootstrapped(scanned).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("added"), count(F.col("seed")).alias("seeds"), count(~F.col("seed")).alias("discovered")
    )
    added = stored(added, "pii-added")
    base = scanned.where("base is not null").select("doc_id", "text_hash", "base")
    joined = base.join(added, (base["text_hash"] == added["text_hash"]) & base["doc_id"].eqNullSafe(added["doc_id"]), "left")
    every = F.array_sort(F.array_union("base", F.coalesce(F.col("added").cast(_SPAN), F.array().cast(_SPAN))))
    zero = F.lit(0).cast("long")
    return joined.select(base["doc_id"], base["text_hash"], "base", every.alias("spans"), F.coalesce("seeds", zero).alias("n_secret_seeds"), F.coalesce("discovered", zero).alias("n_discovered"))


def _printed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "secret")])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)]
    return found(docs).select("doc_id", *counts, F.sha2(_printed("base"), 256).alias("base_sha256"), _printed("spans").alias("spans"), "n_secret_seeds", "n_discovered")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all columns kept."""
    added = discovered(_prepared(docs)).groupBy(F.col("doc_id").alias("pii_id"), "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    added = stored(added, "pii-added")
    body = F.coalesce(F.col("text"), F.lit(""))
    marked = computed_once(packed(docs).withColumns({"pii_body": body, "pii_hash": F.xxhash64(body)}), "pii_spans", base_spans("pii_body"))
    if not added.isEmpty():
        same = (marked["pii_hash"] == added["text_hash"]) & marked["doc_id"].eqNullSafe(added["pii_id"])
        marked = marked.join(added, same, "left").withColumn(
            "pii_spans", F.array_union("pii_spans", F.coalesce(F.col("added").cast(_SPAN), F.array().cast(_SPAN)))
        )
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "secret")])
    by_start = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    clean = F.aggregate(
        by_start,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], -s["back"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct((-s["back"]).alias("at"), F.concat(a["out"], F.substr(F.col("pii_body"), a["at"] + 1, s["start"] - a["at"]), F.get(kinds, s["kind"])).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substr(F.col("pii_body"), a["at"] + 1, F.length("pii_body"))),
    )
    text = F.when(F.size("pii_spans") > 0, clean).otherwise(F.col("text"))
    return unpacked(marked, docs, text=text)
