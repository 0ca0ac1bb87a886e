"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of every whole text (character classes, word shapes, repetition, line structure) are
standardised with means and deviations over all documents.  ``FEATURES`` random cosine features
approximate a Gaussian kernel on them.  Each partition of the labelled rows sums its share of the
normal equations, the sums are added by row, and the driver solves one system of fixed size.
Ridge scores become probabilities by isotonic regression over ``BINS`` equal bins of the score.

Every labelled row outside the held-out fold is used; nothing is sampled.

Defined results: a null or empty text has all statistics 0 and is scored like any other; null
labels are not learned from; a label or document that is repeated counts as often as it stands there; without
labels of both kinds every score is exactly the share of label 1 (0 without any).  Documents are scored row by row, repeated
or not; equal statistics have equal scores; very long texts are read whole, one at a time; an empty
table gives an empty table; only ``doc_id`` and ``text`` are read, so other columns of any name play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored

FEATURES, RIDGE, BINS, SEED = 255, 1e-3, 1000, 11
#: Partitions whose sums are added in one group of the first level.
LANE = 512
NAMES = (
    "log_chars", "log_words", "word_mean", "word_std", "letters", "upper", "digits", "marks", "other_marks", "spaces",
    "distinct_words", "top_word", "repeated_neighbours", "marked_words", "upper_words", "titled_words", "log_lines",
    "line_mean", "distinct_lines", "char_entropy", "ended_lines", "pipes",
)

# Classes of code points: 0 lower or other letters, 1 upper case, 2 digits, 3 sentence marks, 4 other marks, 5 white space.
_CLASS = np.array(
    [5 if chr(c).isspace() else 2 if chr(c).isdigit() else 1 if chr(c).isupper() else 0 if chr(c).isalpha() else 3 if chr(c) in ".,;:'\"-()?" else 4 for c in range(1 << 16)],
    np.uint8,
)


def statistics(text: str | None) -> list[float]:
    words = text.split() if text else []
    if not words:
        return [0.0] * len(NAMES)
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    classes = np.bincount(_CLASS[codes], minlength=6) / len(codes)
    chars = np.bincount(codes[codes < 1024], minlength=1) / len(codes)
    chars = chars[chars > 0]
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    n, counts = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(),
        *classes[:1], *classes[1:6],
        len(counts) / n ** 0.9, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words) / n,
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        np.log1p(len(lines)), np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines),
        float(-(chars * np.log(chars)).sum()), sum(x.rstrip()[-1] in ".?!" for x in lines) / len(lines),
        text.count("|") / n,
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row; stored, for it is read three times and is small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "stats": [np.nan_to_num(statistics(x)).tolist() for x in frame["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInPandas(run, "doc_id long, stats array<double>"), "statistics")


class Fourier:
    """cos(scale(x) W + b): features whose dot products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.weights = rng.normal(0, 1 / np.sqrt(2 * len(mean)), (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ self.weights + self.phase), np.ones(len(x))])


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    columns = [c for i in range(len(NAMES)) for c in (F.avg(F.col("stats")[i]).alias(f"m{i}"), F.stddev_pop(F.col("stats")[i]).alias(f"s{i}"))]
    got = rows.agg(*columns).head()
    return (np.array([got[f"{k}{i}"] or 0.0 for i in range(len(NAMES))]) for k in "ms")


def _normal_equations(train: DataFrame, fourier: Fourier) -> np.ndarray:
    """Sum of x x' beside x y over all rows: partial sums per partition, added by matrix row.

    Two levels: LANE partitions first, then the lanes, so that a group holds at most LANE short rows
    and at 100,000 partitions some 200 in the second level.
    """
    shared = train.sparkSession.sparkContext.broadcast(fourier)
    width = FEATURES + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + 1))
        for frame in batches:
            x = shared.value(np.stack(frame["stats"]))
            total += np.column_stack([x.T @ x, x.T @ frame["quality"].to_numpy(np.float64)])
        lane = TaskContext.get().partitionId() // LANE
        yield pd.DataFrame({"line": range(width), "lane": lane, "sums": [row.tobytes() for row in total]})

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in frame["sums"])
        return pd.DataFrame({"line": [key[0]], "lane": [key[-1]], "sums": [total.tobytes()]})

    schema = "line int, lane int, sums binary"
    lanes = train.select("stats", "quality").mapInPandas(partial, schema).groupBy("line", "lane").applyInPandas(added, schema)
    sums = lanes.groupBy("line").applyInPandas(added, schema)
    rows = sums.orderBy("line").collect()  # FEATURES + 1 rows of fixed width
    return np.stack([np.frombuffer(bytes(r["sums"]), np.float64) for r in rows])


def isotonic(score: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; block centres and block values, both ascending."""
    blocks: list[list[float]] = []
    for s, w, m in zip(score, weight, mean):
        blocks.append([s * w, w, m * w])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 1], table[:, 2] / table[:, 1]


class Model:
    def __init__(self, fourier: Fourier, beta: np.ndarray):
        self.fourier, self.beta = fourier, beta
        self.centres, self.values = np.array([0.0]), np.array([0.0])
        self.constant: float | None = None

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.beta

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        # Between block centres the line keeps the order of raw scores; outside, a narrow logistic tail does.
        level = np.interp(raw, self.centres, self.values)
        return np.clip(0.998 * level + 0.002 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30))), 0, 1)


def learn(rows: DataFrame, labels: DataFrame) -> Model:
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).select("doc_id", "quality")
    train = stored(rows.join(usable, "doc_id"), "labelled")
    fourier = Fourier(*_moments(rows))
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("share")).head()
    if not counts["n"] or counts["share"] in (0.0, 1.0):
        model = Model(fourier, np.zeros(FEATURES + 1))
        model.constant = float(counts["share"] or 0.0)
        return model
    sums = _normal_equations(train, fourier)
    beta = np.linalg.solve(sums[:, :-1] + RIDGE * counts["n"] / FEATURES * np.eye(len(sums)), sums[:, -1])
    model = Model(fourier, beta)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            raw = shared.value.raw(np.stack(frame["stats"]))
            yield pd.DataFrame({"bin": np.clip(raw * BINS, -BINS, 2 * BINS).astype(int), "raw": raw, "y": frame["quality"].astype(float)})

    bins = train.select("stats", "quality").mapInPandas(binned, "bin int, raw double, y double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")
    ).orderBy("bin").toPandas()  # at most 3 * BINS rows
    model.centres, model.values = isotonic(bins["raw"].to_numpy(), bins["n"].to_numpy(float), bins["y"].to_numpy())
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": shared.value(np.stack(frame["stats"]))})

    return rows.select("doc_id", "stats").mapInPandas(run, "doc_id long, score double")
