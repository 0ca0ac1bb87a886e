"""Media catalog, clip index, ingest of JSON documents, result export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.functions.features import MEDIA_SUFFIX
from cliploom.operators.transcripts import words_from_segments

INDEX_VERSION = 1


def media_files(spark: SparkSession, *roots: str, suffix: str = MEDIA_SUFFIX) -> DataFrame:
    """path, mtime and size of the files below the roots whose name fits ``suffix``; file contents are never read.

    A root that is not there has no files; a file below two roots is listed once.
    """
    every = None
    for root in roots:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        every = files if every is None else every.unionByName(files)
    files = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary") if every is None else every
    rows = files.select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return rows.where(F.lower("path").rlike(suffix)).dropDuplicates(["path"])


def index_actions(catalog: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Each catalog row with ``hit``, ``changed`` or ``new`` against the index (path, mtime, size)."""
    old = index.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    action = F.when(F.col("old_mtime").isNull(), "new").when(same & ~F.lit(force), "hit").otherwise("changed")
    return catalog.join(old, "path", "left").withColumn("action", action).drop("old_mtime", "old_size")


def index_report(actions: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """total, hits, extracted; with the rows that an extractor returned (path, error) also indexed, failed and skipped.

    ``skipped`` are rows that went to the extractor and did not come back.
    """
    missed = F.col("action") != "hit"
    if extracted is None:
        return actions.agg(F.count(F.lit(1)).alias("total"), F.count_if(~missed).alias("hits"), F.count_if(missed).alias("extracted"))
    back = actions.join(extracted.select("path", F.col("error").isNotNull().alias("bad")), "path", "left")
    return back.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~missed).alias("hits"), F.count_if(missed & ~F.col("bad")).alias("extracted"),
        F.count_if(~missed | ~F.col("bad")).alias("indexed"), F.count_if(missed & F.col("bad").isNull()).alias("skipped"), F.count_if(missed & F.col("bad")).alias("failed"),
    )


def extracted_batches(rows: DataFrame, hook, schema: str) -> DataFrame:
    """Run a batch extractor over the misses: ``hook`` takes a DataFrame of rows and returns one with ``path`` and the schema's columns.

    Rows that it leaves out are skipped; a batch that fails is returned row by row with ``error`` set.
    """
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for frame in batches:
            try:
                made = hook(frame).assign(error=None)
            except Exception as error:  # the hook is foreign code: its failures are data
                made = pd.DataFrame({"path": frame["path"], **{n: None for n in names}, "error": str(error)})
            yield made[["path", *names, "error"]]

    return rows.mapInPandas(run, f"path string, {schema}, error string")


def extracted(rows: DataFrame, hook, schema: str) -> DataFrame:
    """Run a pluggable extractor over the misses only; a failure becomes a row with ``error`` set.

    ``hook`` takes a dict and returns a dict of the schema's columns.
    """
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                try:
                    out.append({**{n: None for n in names}, **hook(row), "path": row["path"], "error": None})
                except Exception as error:  # the hook is foreign code: its failures are data
                    out.append({**{n: None for n in names}, "path": row["path"], "error": str(error)})
            yield pd.DataFrame(out, columns=["path", *names, "error"])

    return rows.mapInPandas(run, f"path string, {schema}, error string")


def write_index(rows: DataFrame, root: str, version: int) -> str:
    """Write a new index version beside the old ones; the commit makes it whole or absent."""
    path = f"{root}/v={version}"
    rows.withColumn("schema_version", F.lit(INDEX_VERSION)).write.mode("errorifexists").parquet(path)
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the live schema version with usable times and sizes."""
    return spark.read.parquet(path).where((F.col("schema_version") == INDEX_VERSION) & F.col("mtime").isNotNull() & (F.col("size") >= 0))


def legacy_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON index file: version gate, bad entries dropped."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "version int, clips map<string, struct<mtime: double, size: bigint, features: string>>").alias("j"))
    rows = parsed.where(F.col("j.version") == INDEX_VERSION).select(F.explode("j.clips").alias("path", "clip"))
    return rows.select("path", "clip.*").where("mtime is not null and size is not null")


def invalidated(index: DataFrame, paths: DataFrame) -> DataFrame:
    return index.join(paths.select("path").distinct(), "path", "left_anti")


def timed_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(asset_id, pos, word, start_s, end_s): the words, and for assets without any the words of their segments, timed by length."""
    bare = words_from_segments(segments.join(words.select("asset_id").distinct(), "asset_id", "left_anti"))
    order = W.partitionBy("asset_id").orderBy("seg_idx", "pos")
    made = bare.select("asset_id", (F.row_number().over(order) - 1).alias("pos"), "word", F.col("start_s2").alias("start_s"), F.col("end_s2").alias("end_s"))
    return words.select("asset_id", "pos", "word", "start_s", "end_s").unionByName(made)


def due_shares(shares: DataFrame, now: int, hours: float = 12.0) -> DataFrame:
    """Shares that were not synced within the last ``hours``: (share, synced_at in seconds, or null)."""
    return shares.where(F.col("synced_at").isNull() | (F.lit(now) - F.col("synced_at") >= hours * 3600))


def transcript_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, words) of verbose transcript JSON in ``asset_id, value``; blank texts are dropped."""
    schema = "text string, segments array<struct<text: string, start: double, end: double>>, words array<struct<word: string, start: double, end: double>>"
    parsed = raw.select("asset_id", F.from_json("value", schema).alias("j"))
    time = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    segments = parsed.select("asset_id", F.posexplode("j.segments").alias("seg_idx", "s")).where(F.trim("s.text") != "")
    words = parsed.select("asset_id", F.posexplode("j.words").alias("pos", "w")).where(F.trim("w.word") != "")
    return (
        segments.select("asset_id", "seg_idx", F.trim("s.text").alias("text"), time("s.start").alias("start_s"), time("s.end").alias("end_s")),
        words.select("asset_id", "pos", F.trim("w.word").alias("word"), time("w.start").alias("start_s"), time("w.end").alias("end_s")),
    )


def search_lines(lines: DataFrame) -> DataFrame:
    """Search results of JSON lines; the url falls back to other fields, then to the id."""
    schema = "id string, url string, webpage_url string, original_url string, title string, duration double"
    rows = lines.where(F.trim("value").startswith("{")).select(F.from_json("value", schema).alias("j")).where("j is not null").select("j.*")
    url = F.coalesce("url", "webpage_url", "original_url", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("id")))
    return rows.select("id", url.alias("url"), "title", "duration").where("id is not null")


def json_object(text) -> object:
    """The object inside a chat answer: one code fence off, then the first brace to the last."""
    bare = F.regexp_replace(text, "(?i)```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def frame_answers(text) -> object:
    parts = F.split(text, r"\n\n---\n\n|\n---\n|\n###\n")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def job_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def sync_plan(assets: DataFrame, local: DataFrame) -> DataFrame:
    """What to download of a share manifest: the largest ready transcode of each asset.

    ``assets``: asset_id, name, transcodes (status, url, filesize); ``local``: name, size.
    """
    ready = F.filter("transcodes", lambda t: (t["status"] == "SUCCESS") & (F.coalesce(t["url"], F.lit("")) != ""))
    best = F.aggregate(ready, F.lit(None).cast("struct<status:string,url:string,filesize:bigint>"), lambda a, t: F.when(a.isNull() | (t["filesize"] > a["filesize"]), t).otherwise(a))
    safe = F.regexp_replace("name", r'[<>:"/\\|?*]', "_")
    named = F.when(F.lower(safe).rlike(MEDIA_SUFFIX), safe).otherwise(F.concat(safe, F.lit(".mp4")))
    rows = assets.select("asset_id", named.alias("file"), best.alias("best")).join(local.select(F.col("name").alias("file"), F.col("size").alias("have")), "file", "left")
    close = F.col("have").isNotNull() & ((F.coalesce(F.col("best.filesize"), F.lit(0)) == 0) | (F.abs(F.col("have") - F.col("best.filesize")) < 1024))
    return rows.select("asset_id", "file", F.col("best.url").alias("url"), F.when(F.col("best").isNull(), "none").when(close, "skip").otherwise("download").alias("action"))


def share_id(url: str):
    return F.nullif(F.regexp_extract(url, r"/(?:share|s|r|presentations)/([A-Za-z0-9-]+)", 1), F.lit(""))


def result_packs(items: DataFrame, key: str, order: str, references: DataFrame | None = None, diagnostics: DataFrame | None = None) -> DataFrame:
    """One JSON document per reference: its key, its items, nested, in order, its own features and its diagnostics.

    ``references`` and ``diagnostics``: the key and any columns; without a row of theirs a document has null there.
    """
    rest = [c for c in items.columns if c not in (key, order)]
    listed = F.array_sort(F.collect_list(F.struct(order, *rest)))
    packs = items.groupBy(key).agg(listed.alias("items"))
    parts = [key, "items"]
    for name, rows in (("reference", references), ("diagnostics", diagnostics)):
        if rows is not None:
            packs = packs.join(rows.select(key, F.struct(*[c for c in rows.columns if c != key]).alias(name)), key, "left")
            parts.append(name)
    return packs.select(key, F.to_json(F.struct(*parts)).alias("pack"))


def json_object_or_text(text) -> object:
    """The object inside a chat answer, else the whole answer where that is one, else null."""
    whole = F.trim(text)
    return F.coalesce(json_object(text), F.when(whole.startswith("{"), whole))
