"""Small row and group operators over frame metrics, detections, jobs and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom import schema as S
from cliploom.functions.features import first_words


def visual_energy(lit: Column, mean: Column, std: Column, edges: Column) -> Column:
    """A frame bright enough, or dark but textured."""
    bright = (lit > 0.28) & (mean > 20) & ((std > 12) | (edges > 0.01))
    return bright | ((lit > 0.10) & (std > 14) & (edges > 0.018))


def renderable(start: Column, end: Column, clip: Column, least: float = 0.08) -> Column:
    return (F.least(end, clip) - start >= least) & (start < clip)


def live_tags(tags: DataFrame, version: int) -> DataFrame:
    """Tags made under the live prompt version."""
    return tags.where(F.col("prompt_version") == version)


def scene_tag(fields: Column, name: str, scalar: bool = False) -> Column:
    """A field of a tag answer: unknown words are absent ('' or no elements), not defaults.

    Lists are trimmed, lower-cased and capped; moods are from their vocabulary.  ``scalar``: a list field that came as one text.
    """
    value = fields.getField(name)
    if name in S.LIST_CAPS:
        value = F.array(value) if scalar else value
        clean = F.filter(F.transform(value, lambda v: F.lower(F.trim(v))), lambda v: v.isin(*S.MOODS) if name == "mood" else v != "")
        return F.coalesce(F.slice(clean, 1, S.LIST_CAPS[name]), F.array().cast("array<string>"))
    low = F.lower(F.trim(value))
    return F.coalesce(F.when(low.isin(*S.ENUMS[name]), low), F.lit(""))


def legacy_query() -> Column:
    """Subjects, setting and query, else category (or b roll) and action; eight words."""
    tags = F.concat_ws(" ", F.array_join(F.slice("subjects", 1, 3), " "), F.array_join(F.slice("setting", 1, 2), " "), F.col("query"))
    kind = F.when(F.col("category").isin("", "other"), "b roll").otherwise(F.col("category"))
    return first_words(F.when(F.trim(tags) != "", tags).otherwise(F.concat_ws(" ", kind, F.array_join("action", " "))))


def face_centre(boxes: DataFrame) -> DataFrame:
    """Area-weighted centre of the largest box of each frame, in [0, 1]: (clip_id, x, y)."""
    largest = boxes.groupBy("clip_id", "frame").agg(F.max_by(F.struct("x", "y", "w", "h"), F.col("w") * F.col("h")).alias("b"))
    area = F.col("b.w") * F.col("b.h")
    middle = lambda p, s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum((F.col(f"b.{p}") + F.col(f"b.{s}") / 2) * area) / F.sum(area)))
    return largest.groupBy("clip_id").agg(middle("x", "w").alias("x"), middle("y", "h").alias("y"))


def error_summary(errors: DataFrame, only_search: bool = False) -> DataFrame:
    """(job_id, first_error, different, errors, outcome): the different errors of a job in order; they fail a job that has no other source."""
    made = errors.groupBy("job_id", "error").agg(F.min("pos").alias("pos")).groupBy("job_id").agg(
        F.min_by("error", "pos").alias("first_error"), F.count(F.lit(1)).alias("different"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "error"))), lambda x: x["error"]).alias("errors")
    )
    return made.withColumn("outcome", F.lit("failed" if only_search else "warning"))


def job_summary(jobs: DataFrame, base: str = "/outputs") -> DataFrame:
    """The public view of a job: urls of its pack items in (span, rank) order and of its variations, forecast, timings, warning.

    ``jobs``: job_id, status, items (span_index, rank), variations (their number), eta_s, timings (stage, seconds), warning.
    """
    items = F.array_sort(F.transform("items", lambda i: F.struct(i["span_index"].alias("s"), i["rank"].alias("r"))))
    urls = F.transform(items, lambda i: F.concat_ws("/", F.lit(base), F.col("job_id"), F.concat(i["s"], F.lit("_"), i["r"], F.lit(".mp4"))))
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("variations"))), lambda v: v > 0)
    made = F.transform(numbers, lambda v: F.concat_ws("/", F.lit(base), F.col("job_id"), F.concat(F.lit("v"), v, F.lit(".mp4"))))
    timings = F.map_from_entries(F.transform("timings", lambda t: F.struct(t["stage"], F.round(t["seconds"], 1))))
    return jobs.select("job_id", "status", urls.alias("urls"), made.alias("variation_urls"), F.when(F.col("status").isin(*S.TERMINAL), 0.0).otherwise(F.col("eta_s")).alias("eta_s"), timings.alias("timings"), F.coalesce("warning", F.lit("")).alias("warning"))
