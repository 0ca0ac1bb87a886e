"""Language by compression: the dictionary under which a text shrinks most names its language.

Each language has a zstandard raw-content dictionary, a run of excerpts of its texts.  A text is folded
(lower case, every run of other characters than letters one space), cut into pieces of ``PIECE``
bytes, so that the dictionary and not the text itself explains each piece, and every piece of the
whole text is compressed under every dictionary.  The language with the smallest sum of sizes is
named.  Where the second is larger by less than ``MARGIN`` of the smallest, the answer is ``rejected``: it
is still the best guess, and the flag says that it should not be relied on.

Bound: a dictionary holds ``FILL`` bytes of excerpts of ``EXCERPT`` characters, each from another labelled text
outside the held-out fold, drawn by hash; with many languages less, so that all of them together
hold at most ``TOTAL`` bytes.  Counts of the languages are over all of those rows.

Defined results: a null text, or one without any letter, is ``und`` with score 0; so is every text
where nothing was learned.  Equal sizes go to the language of more labelled rows, then to the first by
name.  Rows are judged one by one, repeated or not; very long texts are coded piece by piece; an
empty table gives an empty table; extra columns are kept, those named like a new one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, with_made

FILL, EXCERPT, TOTAL = 32_768, 512, 16 << 20
PIECE, LEVEL, MARGIN = 1024, 5, 0.01
UNKNOWN = "und"
_OTHERS = re.compile(r"[\W\d_]+")
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def folded(text: str | None) -> bytes:
    """The letters of a text in words, or nothing."""
    plain = _OTHERS.sub(" ", text.lower()).strip() if text else ""
    return f" {plain} ".encode("utf-8", "surrogatepass") if any(map(str.isalpha, plain)) else b""


@dataclass
class Model:
    """Languages, the most frequent first, and the content of their dictionaries."""

    names: list[str] = field(default_factory=list)
    contents: list[bytes] = field(default_factory=list)


class Coder:
    def __init__(self, model: Model):
        import zstandard

        self.model, self.sizes_of = model, []
        for content in model.contents:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.sizes_of.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, **plain).compress)

    def sizes(self, form: bytes) -> np.ndarray:
        """Bytes of all pieces under each dictionary."""
        pieces = [form[at : at + PIECE] for at in range(0, len(form), PIECE)]
        return np.array([sum(len(compress(x)) for x in pieces) for compress in self.sizes_of])

    def judged(self, text: str | None) -> tuple[str, float, bool]:
        form = folded(text)
        if not form or not self.sizes_of:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(form)
        best = int(sizes.argmin())
        others = np.delete(sizes, best) - sizes[best]
        # Each byte more halves the weight of a language.
        score = 1.0 / (1.0 + float(np.exp2(-np.minimum(others, 1000.0)).sum()))
        return self.model.names[best], score, bool(len(others)) and float(others.min()) < MARGIN * float(sizes[best])

    def __call__(self, texts: list[str | None]) -> list[list]:
        got = [self.judged(x) for x in texts]
        return [list(x) for x in zip(*got)] if got else [[], [], []]


def learn(docs: DataFrame) -> Model:
    """Dictionaries from labelled rows outside the held-out fold.

    Rows are drawn by a hash with a chance that a language's count sets, so a few times the wanted
    number of excerpts remains of each; copies collapse before they meet.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 5, 0))
    # A row per language.
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model()
    fill = max(1, min(FILL, TOTAL // len(counts)))
    wanted = 4 * -(-fill // EXCERPT) + 16
    rows = usable.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("draw"))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * wanted / n))])
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    start = F.pmod(F.shiftright("draw", 8), F.greatest(F.lit(1), F.length("text") - EXCERPT).cast("long")).cast("int") + 1
    excerpts = drawn.groupBy("lang", "draw").agg(F.min(F.substring("text", start, F.lit(EXCERPT))).alias("excerpt"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw", "excerpt"))
    sample = excerpts.withColumn("nth", nth).where(F.col("nth") <= wanted).orderBy("lang", "nth").collect()  # wanted per language

    found: dict[str, dict[bytes, int]] = {}
    for row in sample:
        mine = found.setdefault(row["lang"], {})
        if (form := folded(row["excerpt"])) and sum(mine.values()) < fill:
            mine[form] = len(form)
    names = sorted((k for k, v in found.items() if v), key=lambda k: (-counts[k], k))
    return Model(names, [b"".join(found[k])[:fill] for k in names])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row: a map over whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def maker() -> Callable[[list], list]:
        return Coder(shared.value)

    return with_made(docs, "text", FIELDS, maker)
