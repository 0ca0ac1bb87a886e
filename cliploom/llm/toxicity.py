"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character 3-, 4- and 5-grams, ends marked, and itself; each hashes to an
embedding row, and a word's vector is their mean, so a misspelling never seen in training shares
most of its vectors with the word it hides.  A passage of ``WINDOW`` words is the mean of its word
vectors; a linear softmax over that mean gives its log odds.  A document is as toxic as its worst
passage: one insult in a long text is not averaged away.  Every passage of the whole text is read.

Training: a document's log odds are the smooth maximum of its passages' odds, so its label teaches the
passages that decide it.  Embeddings and softmax are updated together by Adam.  ``FOLDS`` models are trained,
each on all folds but one; the corpus is scored by their mean.  The odds that each model gives the fold it has not
seen are calibrated: a logistic fit joins them with the text's length, and isotonic regression makes
the result a probability.

Bound: at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` other labelled documents, the first by a hash of
the id, and of each kind at most ``MAX_CHARS`` characters of whole texts; each model is trained in one
task, and has a fixed size (half a MB).

Defined results: null and empty texts are scored as texts without words; rows are scored one by
one, repeated or not; labels that are null are not learned from; with no usable labels of both
kinds every score is the share of toxic labels (0.0 without any); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, with_made
from .quality import isotonic
from .shingles import mix64

BUCKETS, WIDTH = 1 << 17, 8
WINDOW, STRIDE = 8, 4
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 3000, 16_000_000
GRAMS = (3, 4, 5)
STEPS, CHUNKS, CHUNK_WORDS, RATE, DECAY, LEAST_DOCS, FOLDS = 160, 8, 60_000, 0.03, 1e-5, 2, 6
#: Sharpness of the smooth maximum, and size of the first random embeddings.
SHARP, SCALE = 1.0, 0.05
CACHE_WORDS = 150_000
_DROP = re.compile(r"[\W_]+")


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(embedding rows of all words, bounds of each word in them); marks inside words are dropped."""
    plain = ["<" + _DROP.sub("", w) + ">" for w in words]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in plain], np.int64)
    owner = np.repeat(np.arange(len(plain)), lengths)
    ids = [pd.util.hash_array(np.array(plain, dtype=object), categorize=False)] if plain else [np.zeros(0, np.uint64)]
    owners = [np.arange(len(plain))]
    for n in GRAMS:
        if len(codes) < n:
            continue
        rolled = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            rolled = (rolled ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x100000001B3) + (rolled >> np.uint64(29))
        inside = owner[: len(codes) - n + 1] == owner[n - 1 :]
        ids.append(mix64(rolled[inside]))
        owners.append(owner[: len(codes) - n + 1][inside])
    flat, where = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(where, kind="stable")
    return (flat[order] & np.uint64(BUCKETS - 1)).astype(np.int32), np.searchsorted(where[order], np.arange(len(plain) + 1))


def passage_bounds(n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the passages that cover ``n_words`` words."""
    starts = np.arange(0, max(1, n_words - WINDOW + STRIDE), STRIDE)
    return starts, np.minimum(starts + WINDOW, n_words)


@dataclass
class Model:
    table: np.ndarray  # log odds share of each subword row: embedding times softmax difference
    bias: float
    slope: float = 1.0
    by_length: float = 0.0
    shift: float = 0.0
    centres: np.ndarray | None = None  # isotonic steps: log odds, ascending, and the share of toxic documents
    values: np.ndarray | None = None

    def odds(self, worst: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return self.slope * worst + self.by_length * np.log1p(n_words) + self.shift

    def probability(self, worst: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        z = self.odds(worst, n_words)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # A small logistic share keeps the order of documents on one step.
        return p if self.centres is None else 0.998 * np.interp(z, self.centres, self.values) + 0.002 * p


class Scorer:
    """Scores texts; remembers the log odds of words it has met, up to a bounded number."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def worst_passages(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        split = [words_of(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = set()
        for words in split:
            new.update(words)
        new = [w for w in new if w not in self.known]
        if new:
            ids, bounds = subwords(new)
            total = np.concatenate([[0.0], np.cumsum(self.model.table[ids])])
            means = (total[bounds[1:]] - total[bounds[:-1]]) / (bounds[1:] - bounds[:-1])
            self.known.update(zip(new, means.tolist()))
        get = self.known.__getitem__
        worst = np.full(len(split), self.model.bias)
        for i, words in enumerate(split):
            if words:
                total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(get, words), np.float64, len(words)))])
                starts, ends = passage_bounds(len(words))
                worst[i] += ((total[ends] - total[starts]) / (ends - starts)).max()
        return worst, np.array([len(w) for w in split])


def _fit_embeddings(texts: list[str], labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Joint training; returns the log odds share of each subword row and the bias."""
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    each, keep = [], []
    for i, text in enumerate(texts):
        if words := words_of(text):
            each.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
            keep.append(i)
    lengths = np.array([len(x) for x in each])
    codes = np.concatenate(each)
    del each
    # In blocks, for the work space of a block is many times its result.
    words = list(index)
    blocks = [subwords(words[at : at + 20_000]) for at in range(0, len(words), 20_000)]
    del index, words
    ids, sizes = np.concatenate([x.astype(np.int32) for x, _ in blocks]), np.concatenate([np.diff(b) for _, b in blocks])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    del blocks
    starts_of = np.concatenate([[0], np.cumsum(lengths)])
    chunks = max(CHUNKS, len(codes) // CHUNK_WORDS)

    def rows_of(words: np.ndarray) -> np.ndarray:
        """Subword rows of these words, one after another."""
        n = sizes[words]
        return ids[np.repeat(bounds[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    # Rows that fewer than LEAST_DOCS documents use would only be memorised: they stay zero.
    documents = np.zeros(BUCKETS, np.int32)
    for d in range(len(keep)):
        documents[np.unique(rows_of(np.unique(codes[starts_of[d] : starts_of[d + 1]])))] += 1
    live = np.flatnonzero(documents >= LEAST_DOCS)
    place = np.full(BUCKETS, len(live), np.int32)
    place[live] = np.arange(len(live), dtype=np.int32)
    ids = place[ids]  # the last row stands for all others

    embed = np.vstack([rng.normal(0, SCALE, (len(live), WIDTH)), np.zeros((1, WIDTH))]).astype(np.float32)
    softmax, bias = rng.normal(0, 0.3, (WIDTH, 2)), np.zeros(2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (embed, softmax, bias)]
    place = np.zeros(len(codes), np.int32)
    target = labels[keep].astype(int)
    steps = 0
    for _ in range(-(-STEPS // chunks)):
        for part in np.array_split(rng.permutation(len(keep)), min(chunks, len(keep))):
            starts, ends = zip(*[passage_bounds(int(lengths[d])) for d in part])
            counts = np.array([len(s) for s in starts])
            first, doc = np.cumsum(counts) - counts, np.repeat(np.arange(len(part)), counts)
            starts, ends = (np.concatenate(x) + starts_of[part][doc] for x in (starts, ends))
            at = np.concatenate([np.arange(starts_of[d], starts_of[d + 1]) for d in part])
            words, local = np.unique(codes[at], return_inverse=True)
            place[at] = np.arange(len(at))
            s, e = place[starts], place[ends - 1] + 1
            n = sizes[words]
            rows, line = rows_of(words), np.repeat(np.arange(len(words)), n)
            vectors = np.add.reduceat(embed[rows], np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
            total = np.vstack([np.zeros(WIDTH), np.cumsum(vectors[local], axis=0)])
            mean = (total[e] - total[s]) / (e - s)[:, None]
            logits = mean @ softmax + bias
            odds = logits[:, 1] - logits[:, 0]
            # Passages of one document follow one another; their smooth maximum is the document's odds.
            top = np.maximum.reduceat(odds, first)
            share = np.exp(SHARP * (odds - top[doc]))
            total = np.add.reduceat(share, first)
            pooled = top + np.log(total / counts) / SHARP
            p = 1 / (1 + np.exp(-np.clip(pooled, -30, 30)))
            y = target[part]
            # Both classes carry the same weight in total.
            weight = np.where(y == 0, min(1.0, max(y.sum(), 1) / max((y == 0).sum(), 1)), 1.0)
            pull = ((p - y) * weight / weight.sum())[doc] * share / total[doc]
            error = np.column_stack([-pull, pull])
            g_softmax, g_bias = mean.T @ error, error.sum(axis=0)
            g_mean = (error @ softmax.T) / (e - s)[:, None]
            # A passage's gradient goes to each of its words: difference array, then running sum.
            spread = np.zeros((len(at) + 1, WIDTH))
            g_embed = np.empty((WIDTH, len(embed)), np.float32)
            for k in range(WIDTH):
                spread[:, k] = np.bincount(s, g_mean[:, k], len(at) + 1)[: len(at) + 1] - np.bincount(e, g_mean[:, k], len(at) + 1)[: len(at) + 1]
            per_word = np.cumsum(spread, axis=0)[:-1]
            for k in range(WIDTH):
                to_word = np.bincount(local, per_word[:, k], len(words)) / n
                g_embed[k] = np.bincount(rows, to_word[line], len(embed))
            g_embed[:, -1] = 0.0
            steps += 1
            for value, grad, (m, v) in zip((embed, softmax, bias), (g_embed.T + DECAY * embed, g_softmax + DECAY * softmax, g_bias), moments):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                value -= (RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)).astype(value.dtype)
    direction = softmax[:, 1] - softmax[:, 0]
    table = np.zeros(BUCKETS)
    table[live] = embed[:-1] @ direction
    return table, float(bias[1] - bias[0])


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * beta)
    return beta


def _fold(texts: list[str], labels: np.ndarray, number: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Table and bias of a model of all folds but one, and (worst passage, words, label) of that one."""
    mine = np.arange(len(texts)) % FOLDS == number
    table, bias = _fit_embeddings([t for t, m in zip(texts, mine) if not m], labels[~mine])
    worst, n = Scorer(Model(table, bias)).worst_passages([t for t, m in zip(texts, mine) if m])
    return table, bias, np.column_stack([worst, n, labels[mine]])


def _teaches(labels: np.ndarray) -> bool:
    return len(labels) >= 20 and labels.min() != labels.max()


def _joined(labels: np.ndarray, folds: list[tuple[np.ndarray, float, np.ndarray]]) -> Model:
    """The mean of the folds' models, calibrated; a constant where labels teach nothing."""
    if not folds:
        base = float(labels.mean()) if len(labels) else 0.0
        shift = np.log(max(base, 1e-9) / max(1 - base, 1e-9))
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0, float(np.clip(shift, -30, 30)))
    model = Model(np.mean([f[0] for f in folds], axis=0).astype(np.float32).astype(np.float64), float(np.mean([f[1] for f in folds])))
    worst, n, y = np.concatenate([f[2] for f in folds]).T
    model.slope, model.by_length, model.shift = map(float, _fit_logistic(np.column_stack([worst, np.log1p(n)]), y))
    z = model.odds(worst, n)
    order = np.argsort(z, kind="stable")
    model.centres, model.values = isotonic(z[order], np.ones(len(z)), y[order])
    return model


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """The model of some labelled texts, in this process."""
    labels = np.asarray(labels)
    return _joined(labels, [_fold(texts, labels, k) for k in range(FOLDS)] if _teaches(labels) else [])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents outside the held-out fold, within the bounds above.

    The ids are chosen from the labels alone; then only their texts are fetched.  The models of the
    folds are trained side by side, a task each.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)).select("doc_id", "toxic")
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(usable.where("toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    # A bounded table of ids: MAX_TOXIC + MAX_CLEAN rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    first = W.partitionBy("toxic").orderBy(*order, "text")
    rows = rows.withColumns({"nth": F.row_number().over(first), "chars": F.sum(F.length("text")).over(first.rowsBetween(W.unboundedPreceding, 0))})
    rows = rows.where((F.col("nth") <= F.when(F.col("toxic") == 1, MAX_TOXIC).otherwise(MAX_CLEAN)) & ((F.col("chars") <= MAX_CHARS) | (F.col("nth") == 1)))

    def train(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"]).sample(frac=1.0, random_state=3)
        texts, truth = frame["text"].tolist(), frame["toxic"].to_numpy()
        if not _teaches(truth):
            return pd.DataFrame({"labels": [truth.astype(float).tolist()], "table": [None], "bias": [0.0], "seen": [[]]})
        table, bias, seen = _fold(texts, truth, key[0])
        return pd.DataFrame({"labels": [[]], "table": [table.astype(np.float32).tobytes()], "bias": [bias], "seen": [seen.ravel().tolist()]})

    each = rows.select("doc_id", "text", "toxic", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"))
    # FOLDS rows: a table of fixed size, and the odds of at most MAX_TOXIC + MAX_CLEAN documents in all.
    made = each.groupBy("fold").applyInPandas(train, "labels array<double>, table binary, bias double, seen array<double>").collect()
    folds = [(np.frombuffer(bytes(r["table"]), np.float32), r["bias"], np.array(r["seen"]).reshape(-1, 3)) for r in made if r["table"] is not None]
    return _joined(np.array(made[0]["labels"]) if made else np.zeros(0), folds)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Add the score to every row (under a name not yet taken): a map over whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def maker() -> Callable[[list], list]:
        scorer = Scorer(shared.value)
        return lambda texts: [shared.value.probability(*scorer.worst_passages(texts))]

    return with_made(docs, "text", [T.StructField(name, T.DoubleType())], maker)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score stays below the threshold; all columns kept."""
    name = "score_" + "_".join(docs.columns)[:40]
    return scored(docs, learn(docs, labels), name).where(F.col(f"`{name}`") < threshold).drop(name)
