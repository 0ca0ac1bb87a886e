"""Cutaway spans in frame sequences: cuts, leader clusters, segments, gaps and islands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FPS, MIN_SPAN, MAX_SPANS = 10.0, 0.08, 24
CUT, NEAR = 0.85, 0.78


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def shot_cuts(frames: DataFrame) -> DataFrame:
    """Frames at which a new shot starts: the vector moved at least CUT from the frame before."""
    order = W.partitionBy("video_id").orderBy("frame_idx")
    feat = F.col("feat").cast("array<double>")
    return frames.withColumn("is_cut", F.coalesce(distance(feat, F.lag(feat).over(order)) >= CUT, F.lit(False)))


class _Leaders:
    """Leader clusters of one video, fed frame by frame: unit centres, sums and counts."""

    def __init__(self, width: int):
        self.centres, self.sums, self.counts = np.zeros((0, width)), np.zeros((0, width)), np.zeros(0, np.int64)

    def add(self, frame: np.ndarray) -> None:
        if len(self.centres):
            gaps = np.sqrt(((self.centres - frame) ** 2).sum(axis=1))
            k = int(gaps.argmin())
            if gaps[k] < NEAR:
                self.sums[k] += frame
                self.counts[k] += 1
                mean = self.sums[k] / self.counts[k]
                self.centres[k] = mean / (np.linalg.norm(mean) or 1)
                return
        self.centres, self.sums = np.vstack([self.centres, frame]), np.vstack([self.sums, frame])
        self.counts = np.append(self.counts, 1)

    def centre(self) -> list[float]:
        return self.centres[int(self.counts.argmax())].tolist()


def primary_centres(frames: DataFrame) -> DataFrame:
    """(video_id, centre): the centre of the largest leader cluster of each video, the first on ties.

    Clusters depend on the order of frames.  Videos are dealt by id and sorted; a task goes through its frames
    batch by batch and carries the clusters of the open video, never its frames.
    """
    rows = frames.select("video_id", "frame_idx", F.col("feat").cast("array<double>").alias("feat")).repartition("video_id").sortWithinPartitions("video_id", "frame_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, open_, out = None, None, []
        for frame in batches:
            for name, feat in zip(frame["video_id"].tolist(), frame["feat"]):
                feat = np.asarray(feat, np.float64)
                if open_ is None or name != video:
                    if open_ is not None:
                        out.append((video, open_.centre()))
                    video, open_ = name, _Leaders(len(feat))
                open_.add(feat)
            yield pd.DataFrame(out, columns=["video_id", "centre"])
            out = []
        if open_ is not None:
            yield pd.DataFrame([(video, open_.centre())], columns=["video_id", "centre"])

    return rows.mapInPandas(run, f"video_id {rows.schema['video_id'].dataType.simpleString()}, centre array<double>")


def primary_flags(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, is_primary): near the centre of the video's largest leader cluster."""
    near = distance(F.col("feat").cast("array<double>"), F.col("centre")) <= NEAR
    return frames.join(primary_centres(frames), "video_id").select("video_id", "frame_idx", near.alias("is_primary"))


def segment_spans(flags: DataFrame, most_primary: float = 0.45, least_visual: float = 0.5) -> DataFrame:
    """Segments between cuts that are rarely primary and mostly visual, the first MAX_SPANS of a video.

    ``flags``: video_id, frame_idx, is_cut, primary, visual.
    """
    order = W.partitionBy("video_id").orderBy("frame_idx")
    segments = flags.withColumn("segment", F.sum(F.col("is_cut").cast("int")).over(order))
    share = lambda c: F.avg(F.col(c).cast("double"))
    made = segments.groupBy("video_id", "segment").agg(share("primary").alias("p"), share("visual").alias("v"), F.min("frame_idx").alias("a"), (F.max("frame_idx") + 1).alias("b"))
    return _first_spans(made.where((F.col("p") <= most_primary) & (F.col("v") >= least_visual)))


def filled(flags: DataFrame, flag: str) -> DataFrame:
    """Single False frames between two True ones become True, judged on the original flags."""
    order = W.partitionBy("video_id").orderBy("frame_idx")
    both = F.coalesce(F.lag(flag).over(order), F.lit(False)) & F.coalesce(F.lead(flag).over(order), F.lit(False))
    return flags.withColumn(flag, F.col(flag) | both)


def flag_spans(flags: DataFrame, flag: str) -> DataFrame:
    """Maximal runs of True frames: gaps and islands."""
    order = W.partitionBy("video_id").orderBy("frame_idx")
    runs = filled(flags, flag).where(flag).withColumn("island", F.col("frame_idx") - F.row_number().over(order))
    return _first_spans(runs.groupBy("video_id", "island").agg(F.min("frame_idx").alias("a"), (F.max("frame_idx") + 1).alias("b")))


def _first_spans(rows: DataFrame) -> DataFrame:
    spans = rows.select("video_id", (F.col("a") / FPS).alias("start_s"), (F.col("b") / FPS).alias("end_s")).where(F.col("end_s") - F.col("start_s") >= MIN_SPAN)
    order = W.partitionBy("video_id").orderBy("start_s")
    return spans.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MAX_SPANS)


def longest_run(rows: DataFrame, key: str, position: str, test: Column) -> DataFrame:
    """The first longest run of rows that pass: (key, run_start, run_length)."""
    order = W.partitionBy(key).orderBy(position)
    runs = rows.where(test).withColumn("island", F.col(position) - F.row_number().over(order)).groupBy(key, "island").agg(F.min(position).alias("run_start"), F.count(F.lit(1)).alias("run_length"))
    best = W.partitionBy(key).orderBy(F.desc("run_length"), "run_start")
    return runs.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "island")


def motion(frames: DataFrame) -> DataFrame:
    """Mean absolute change between neighbouring frames of each video, and the mean of its present metrics."""
    order = W.partitionBy("video_id").orderBy("frame_idx")
    feat = F.col("feat").cast("array<double>")
    change = F.aggregate(F.zip_with(feat, F.lag(feat).over(order), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, d: s + d) / F.size(feat)
    return frames.withColumn("change", change).groupBy("video_id").agg(F.round(F.avg("change"), 6).alias("motion"))


def sampled_frames(spans: DataFrame, frames: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Frames of each span at the given shares of its frame range, which ends at the video's last frame."""
    ends = frames.groupBy("video_id").agg(F.max("frame_idx").alias("final"))
    first, last = F.least(F.floor(F.col("start_s") * FPS), F.col("final")), F.least(F.floor(F.col("end_s") * FPS), F.col("final") + 1)
    picks = F.array_distinct(F.array(*[F.least(F.floor(first + (last - first) * s), F.col("final")) for s in shares]))
    wanted = spans.join(ends, "video_id").select(*[F.col(c) for c in spans.columns], F.explode(picks).alias("frame_idx")).withColumn("frame_idx", F.col("frame_idx").cast("int"))
    return wanted.join(frames, ["video_id", "frame_idx"])


def content_band(rows: DataFrame, key: str = "clip_id", bright: float = 20.0, least: float = 0.2, whole: bool = True) -> DataFrame:
    """(key, top, height): the first longest run of bright rows of a picture, as shares of its height.

    ``rows``: key, row, mean.  Bands of less than ``least`` are none (a dark scene), and neither are those that fill nearly the whole
    picture (0.9 and more from the top 0.05 on) unless ``whole`` is off.
    """
    heights = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    band = longest_run(rows, key, "row", F.col("mean") > bright).join(heights, key)
    band = band.select(key, (F.col("run_start") / F.col("rows")).alias("top"), (F.col("run_length") / F.col("rows")).alias("height"))
    full = (F.col("height") >= 0.9) & (F.col("top") <= 0.05)
    return band.where(F.col("height") >= least).where(~full if whole else F.lit(True)).select(key, F.round("top", 4).alias("top"), F.round("height", 4).alias("height"))


def metric_means(frames: DataFrame, names: list[str], key: str = "video_id") -> DataFrame:
    """Mean of each metric over the frames that have it, clipped to [0, 1]; 0 where none has."""
    clipped = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.avg(c), F.lit(0.0))))
    return frames.groupBy(key).agg(*[F.round(clipped(n), 6).alias(n) for n in names])


def middle_frames(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """The middle frame of each span's frame range, inside the video: (the columns of spans, frame_idx, ...)."""
    return sampled_frames(spans, frames, (0.5,))
