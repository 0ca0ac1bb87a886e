"""Benchmark decontamination by size-partitioned MinHash containment search, DataFrame-only.

Texts are lower-cased and cut into words of letters and digits.  An item's set holds its distinct
five-word shingles (the whole word sequence, if shorter).  A document leaks an item if it holds at
least ``THRESHOLD`` of the item's shingles.

Items are put into size partitions by powers of two.  A partition whose items have at most u
shingles keeps of each item the ``u - ceil(THRESHOLD * u) + 1`` smallest shingle hashes: its bottom-k
MinHash signature.  A document that holds the wanted share misses fewer shingles than that, so it
holds at least one signature hash of the item: the search loses nothing, however long the document
is.  Documents too small for a partition's smallest item are not compared with it.  Candidates are
verified by counting the item's shingles, as strings, in the document.

Defined results: null or empty texts and items have no words and match nothing; rows equal in id
and text count once; items equal in id and text count once; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed_once, noted, packed, sketch, stored, unpacked

WIDTH, THRESHOLD = 5, 0.75
#: Signature rows (24 MB) and characters of item shingles up to which they are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 1_000_000, 16_000_000


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(array: str, width: int, combine) -> Column:
    """``combine`` of each run of ``width`` elements of an array column; none if it is shorter."""
    count = F.size(array)
    runs = F.transform(F.sequence(F.lit(0), count - width), lambda i: combine([F.get(F.col(array), i + k) for k in range(width)]))
    return F.when(count >= width, runs)


def hashed_shingles(array: str, widths: list[int]) -> Column:
    """Distinct 64-bit hashes of the shingles of all the given widths."""
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(*[F.coalesce(_windows(array, w, lambda x: F.xxhash64(*x)), none) for w in widths])) if widths else none


def _strings(array: str, widths: list[int]) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(_windows(array, w, lambda x: F.concat_ws(" ", *x)), none) for w in widths]))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, width, shingles, hashes, n) of the distinct items that have words."""
    base = computed_once(benchmark.select("item_id", "text").distinct(), "w", words("text")).where(F.size("w") > 0)
    base = base.withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    pick = lambda f: F.coalesce(*[F.when(F.col("width") == k, f("w", [k])) for k in range(1, WIDTH + 1)])
    return base.select("item_id", "width", pick(_strings).alias("shingles"), pick(hashed_shingles).alias("hashes")).withColumn("n", F.size("shingles"))


def _signatures(items: DataFrame) -> DataFrame:
    """(item_id, h, least) - the signature hashes and the shingles that a document must have."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    length = (upper - F.ceil(upper * THRESHOLD) + 1).cast("int")
    smallest = F.slice(F.array_sort("hashes"), 1, length)
    lowest = F.floor(upper / 2) + 1
    return items.select("item_id", F.explode(smallest).alias("h"), F.when(F.col("n") == 1, 1).otherwise(F.ceil(lowest * THRESHOLD)).alias("least"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_item, n_shared, containment) of every leak."""
    items = stored(_items(benchmark), "benchmark-items")
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # five at most
    signatures = _signatures(items)
    small = signatures.count() <= BROADCAST_ROWS
    chars = items.agg(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 16))).head()[0] or 0
    keyed = computed_once(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), "w", words("text")).drop("text")
    hashed = computed_once(keyed, "s", hashed_shingles("w", widths)).select("doc_id", "text_hash", F.size("s").alias("size"), F.explode("s").alias("h"))
    hits = hashed.join(F.broadcast(signatures) if small else signatures, "h").where("size >= least")
    candidates = stored(hits.select("doc_id", "text_hash", "item_id").distinct(), "leak-candidates")
    # Only noted documents are read into the exact count.
    again = noted(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), "text_hash", sketch(candidates, "text_hash")).where("noted")
    wanted = candidates.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "item_id")
    again = again.join(wanted, (F.col("text_hash") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("id")))
    again = again.select("doc_id", "text_hash", "item_id", "text").dropDuplicates(["doc_id", "text_hash", "item_id"])
    exact = computed_once(again.join(F.broadcast(items) if chars <= BROADCAST_CHARS else items, "item_id"), "w", words("text"))
    exact = computed_once(exact, "n_shared", F.size(F.array_intersect("shingles", _strings("w", widths or [WIDTH]))).cast("long"))
    return exact.select("doc_id", "text_hash", "item_id", F.col("n").cast("long").alias("n_item"), "n_shared").where(
        F.col("n_shared") >= F.ceil(F.col("n_item") * THRESHOLD)
    ).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, all columns kept."""
    found = stored(leaks(docs, benchmark).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).distinct(), "leaks")
    marked = noted(packed(docs).withColumn("text_hash", F.xxhash64("text")), "text_hash", sketch(found, "th"))
    same = (F.col("text_hash") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("id"))
    clean = marked.where("not noted").select("row").unionByName(marked.where("noted").join(found, same, "left_anti").select("row"))
    return unpacked(clean, docs)


ORACLE = """
WITH d AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> ''] AS w FROM documents),
i AS (SELECT item_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> ''] AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
sh AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_item FROM sh GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN sh USING (s) GROUP BY 1, 2),
few AS (SELECT DISTINCT item_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM i WHERE len(w) BETWEEN 1 AND 4)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM c JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.75)
UNION ALL SELECT DISTINCT doc_id, item_id, 1, 1, 1.0 FROM few JOIN d ON contains(' ' || array_to_string(d.w, ' ') || ' ', few.s)
"""
