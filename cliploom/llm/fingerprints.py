"""Canonical exact digests of documents.

The canonical form of a text is its Unicode NFKC form, case-folded, with every run of white space
made one space and the ends trimmed.  Its fingerprint is the 128-bit xxh3 digest of the UTF-8
bytes.  Rows are grouped by that digest; inside a bucket of several rows the canonical bytes are
compared, and if they ever differ those fingerprints are lengthened by another hash, so that
equal fingerprints mean equal canonical texts.

Likeness of two fingerprints is 1.0 if they are equal and else 0.0: an exact digest has no other.

Defined results: a null text counts as empty; repeated rows are fingerprinted one by one; an empty
table gives an empty table; a null id sorts before all others.  ``next`` means the next row by
ascending id (ties by text), and the first row after the last; a single row follows itself.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import noted, sketch, stored


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def mark_of(form: bytes) -> str:
    """xxh3-128 of the canonical bytes, then 16 digits of another hash, used only if that collides."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(form) + hashlib.blake2b(form, digest_size=8).hexdigest()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _row(doc_id, text: str, mark: str, following: str, following_mark: str) -> tuple:
    changed = edited(text, following)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), sha, mark, mark if changed == text else mark_of(canonical(changed)), following_mark)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next text.

    Texts are moved once, range-partitioned by id.  A task reads its range in order and finishes
    each row when it sees the next; its last row meets the first row of the next filled range by a
    join on the range's number.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ordered = source.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text")
    )
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        edges = []
        for frame in batches:
            out = []
            for doc_id, body in zip(frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None), frame["text"]):
                mark = mark_of(canonical(body))
                if held is None:
                    edges.append((doc_id, mark, "first", body))
                else:
                    out.append(_row(*held, body, mark))
                held = (doc_id, body, mark)
            if out:
                done = pd.DataFrame(out, columns=names)
                done["part"], done["edge"], done["body"] = None, None, None
                yield _typed(done)
        if held is not None:
            edges.append((held[0], held[2], "last", held[1]))
            ends = pd.DataFrame(edges, columns=["doc_id", "fingerprint", "edge", "body"])
            ends["part"] = TaskContext.get().partitionId()
            yield _typed(ends.reindex(columns=[*names, "part", "edge", "body"]))

    return _joined_ends(stored(ordered.mapInPandas(run, f"{_COLUMNS}, part long, edge string, body string"), "fingerprints"), names)


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    frame["n_chars"] = frame["n_chars"].astype("Int64")
    if "part" in frame:
        frame["part"] = frame["part"].astype("Int64")
    return frame.astype({c: object for c in frame.columns if c not in ("doc_id", "n_chars", "part")}).where(frame.notna(), None)


def _joined_ends(rows: DataFrame, names: list[str]) -> DataFrame:
    """The last row of each range with the first row of the next range that has rows."""
    ends = rows.where(F.col("edge").isNotNull())
    # The one window without partitions sees a number per filled range, and no text.  Ranges are numbered in
    # the order of their ids, and a repeated id lies in one range.
    in_order = W.orderBy("part")
    every = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = ends.where("edge = 'last'").select("part").select("part", F.coalesce(F.lead("part").over(in_order), F.first("part").over(every)).alias("next_part"))
    starts = ends.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("body").alias("b"), F.col("fingerprint").alias("f"))
    pairs = ends.where("edge = 'last'").join(follows, "part").join(starts, "next_part")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = [_row(None if pd.isna(i) else int(i), *rest) for i, *rest in frame.itertuples(index=False)]
            yield _typed(pd.DataFrame(out, columns=names))

    finished = pairs.select("doc_id", "body", "fingerprint", "b", "f").mapInPandas(finish, _COLUMNS)
    return rows.where(F.col("edge").isNull()).select(*names).unionByName(finished)


def collisions(docs: DataFrame, marks: DataFrame, text: str = "text") -> DataFrame:
    """The digests (first 32 digits of a mark) under which different canonical bytes meet.

    Digests that occur once need no comparison.  The others are found by count and noted in a bit
    sketch of fixed size; the texts of noted digests are compared as bytes.  The aggregate merges
    the copies within a task before they move.
    """
    several = marks.select(F.substring("fingerprint", 1, 32).alias("digest")).groupBy("digest").count().where("count > 1")

    def canonical_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            forms = [canonical(x) for x in frame["body"]]
            yield pd.DataFrame({"digest": [mark_of(x)[:32] for x in forms], "form": forms})

    forms = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body")).mapInPandas(canonical_rows, "digest string, form binary")
    candidates = noted(forms, "digest", sketch(several, "digest")).where("noted")
    return candidates.groupBy("digest").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("digest")


def likeness(left: str | Column, right: str | Column) -> Column:
    return F.when(F.col(left) == F.col(right), F.lit(1.0)).otherwise(F.lit(0.0))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The contract's rows, with byte comparison inside equal buckets."""
    rows = with_next(docs)
    clash = stored(collisions(docs, rows), "collisions")
    marks = ("fingerprint", "edited_fingerprint", "next_fingerprint")
    if clash.isEmpty():
        rows = rows.withColumns({c: F.substring(c, 1, 32) for c in marks})
    else:
        for c in marks:
            known = clash.select(F.col("digest").alias("d"), F.lit(True).alias("several"))
            rows = rows.join(known, F.substring(c, 1, 32) == F.col("d"), "left")
            rows = rows.withColumn(c, F.when("several", F.col(c)).otherwise(F.substring(c, 1, 32))).drop("d", "several")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
