"""Shards of near-equal size by sampled splitters, in DataFrame operations only.

The range key of a row is (CRC-32 of its text, row id), so equal texts lie together.  A sample of
keys is drawn with a chance in proportion to the size; its quantiles cut the key space into fine
ranges, each about 1/``FINE`` of a shard.  Ranges that came out overfull (one text repeated often, a
rare streak), or hold more than ``PART_BYTES``, are subdivided by a hash of the row.  Whole rows then move once to their ranges, where a
running sum gives each row its place, and are stored, so that hash is drawn once.  Exact bytes per
range give each range its offset in the total, and the row's shard is where its middle byte falls:
``shard = floor(16 * middle / total)``.  Shards therefore differ from total/16 by less than one row's
size on either end.

Law: ``bytes`` (sizes near equal).  ``records`` returns the rows with all their columns, their shard and their
slot; ``sharded`` derives sizes and checksums from those rows.

Defined results: a null text has size 1 and CRC 0; repeated rows are rows of their own (ties are
broken by size, then arbitrarily but gaplessly); an empty table gives an empty table; a null id
sorts first; very long texts move like others; extra columns are kept, those named ``shard`` or ``slot`` replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

LAW = "bytes"
#: Fine ranges per shard, sampled keys per fine range, and the overfull factor that subdivides.
FINE, PER_RANGE, OVERFULL = 16, 24, 2.0
#: Bytes of a subdivision at most, so that a task's sort stays small and many tasks work at any size.
PART_BYTES = 1 << 29


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, size, text_crc32, spread, draw): the whole row in one column, and its keys."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"), _size(text).alias("size"), _crc32(text).alias("text_crc32"),
    ).withColumns({"spread": F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), "draw": F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << 30)) / float(1 << 30)})


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _crc32(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def splitters(rows: DataFrame, total: int, shards: int) -> list[int]:
    """Distinct quantile boundaries of a size-weighted key sample, at most FINE * shards of them.

    A row is drawn if its draw in [0, 1) is below size * rate, so the expected sample is
    FINE * shards * PER_RANGE keys at any input size.
    """
    wanted = FINE * shards * PER_RANGE
    sample = rows.where(F.col("draw") < F.col("size") * F.lit(wanted / max(1, total)))
    cuts = ",".join(str(i / (FINE * shards)) for i in range(1, FINE * shards))
    found = sample.agg(F.expr(f"percentile_approx(text_crc32, array({cuts}), 100000)").alias("q")).head()["q"]
    return sorted(set(found or []))


def ranged(rows: DataFrame, keys: DataFrame, total: int, shards: int) -> DataFrame:
    """Add ``range`` (position of the key among the splitters) and ``part`` (its subdivision) to the rows of these keys."""
    cuts = splitters(keys, total, shards)
    where = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("text_crc32"))) if cuts else F.lit(0)
    # One row per range, FINE * shards at most: a proven bound.  Subdivisions have about the size of a
    # range, and PART_BYTES where ranges are larger than that.
    fair = min(max(1.0, total / (FINE * shards)), PART_BYTES)
    sizes = keys.groupBy(where.alias("range")).agg(F.sum("size").alias("filled"))
    parts = sizes.select("range", F.when(F.col("filled") > OVERFULL * fair, F.ceil(F.col("filled") / fair)).otherwise(1).cast("int").alias("parts"))
    return rows.withColumn("range", where).join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.col("spread"), F.col("parts")).cast("int"))


def placed(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, shard, slot): every whole row, stored in its range, with its shard and its place there."""
    rows = keyed(docs, doc_id, text)
    keys = stored(rows.select("size", "text_crc32", "draw"), "shard-keys")
    total = keys.agg(F.sum("size").alias("t")).head()["t"] or 0
    inside = W.partitionBy("range", "part").orderBy("text_crc32", F.col("doc_id").asc_nulls_first(), "size")
    rows = ranged(rows, keys, total, shards).select(
        "row", "range", "part", "size",
        F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("end"), F.row_number().over(inside).alias("nth"),
    )
    rows = stored(rows, "shard-rows")
    # Offsets of the ranges: at most a few times FINE * shards rows and one per half PART_BYTES,
    # which is some 20 MB for 100 TB.
    before = W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("range", "part").agg(F.sum("size").alias("filled")).select(
        "range", "part", F.coalesce(F.sum("filled").over(before), F.lit(0)).alias("offset")
    )
    middle = F.col("offset") + F.col("end") - (F.col("size") + 1) / 2
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total))).cast("int"))
    rows = rows.join(F.broadcast(offsets), ["range", "part"]).withColumn("shard", shard)
    # Slots: rows of the shard in earlier ranges, then the position among those of this range.
    counts = rows.groupBy("shard", "range", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("low"))
    earlier = W.partitionBy("shard").orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "range", "part", "low", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    slot = (F.col("first") + F.col("nth") - F.col("low")).cast("long")
    return rows.join(F.broadcast(counts), ["shard", "range", "part"]).select("row", "shard", slot.alias("slot"))


def records(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, and ``shard`` and ``slot`` behind them, which replace columns of those names."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed(docs, shards, doc_id, text).select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", "slot")


def sharded(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's rows, derived from the records."""
    return placed(docs, shards, doc_id, text).select(
        F.col("row").getField(doc_id).cast("long").alias("doc_id"), F.col("row").getField(text).alias("text"), "shard", "slot"
    ).select(
        "doc_id", _size("text").alias("size"), _crc32("text").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
