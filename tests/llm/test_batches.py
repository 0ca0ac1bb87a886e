"""Batches of bounded text, the long-piece merge, and the classifiers on the given tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import byte_bpe, common, toxicity
from cliploom.llm.queries import bpe_vocabulary, op5_toxicity


def test_slices_cover_every_row():
    sizes = np.array([5, 3 << 20, 0, 1, 1 << 20, 7])
    cuts = list(common._cuts(sizes))
    assert cuts[0][0] == 0 and cuts[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and list(common._cuts(np.zeros(0))) == []


def test_long_pieces_equal_the_library():
    import tiktoken

    path, pattern = bpe_vocabulary()
    ranks = byte_bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    model = byte_bpe.ByteBPE(list(ranks.items()), *byte_bpe.mergeable_pairs(ranks), pattern)
    rnd = random.Random(5)
    texts = ["a" * 5001, "ab" * 1500, "the" * 900, "é" * 700, " " * 3000] + ["".join(rnd.choice("abcdeintoshr") for _ in range(rnd.randint(257, 4000))) for _ in range(12)]
    for text in texts:
        assert np.frombuffer(model._merge_wide(text.encode()), "<u4").tolist() == np.frombuffer(model._merge_matrix([text.encode()])[0], "<u4").tolist()
        assert np.frombuffer(model.encode_batch([text])[0], "<u4").tolist() == known.encode_ordinary(text)


@pytest.mark.parametrize("sf, recall", [("0.01", 0.1), ("0.1", 0.7)])
def test_toxicity_on_held_out_labels(spark, sf, recall):
    got = op5_toxicity(spark, f"/root/testdata/sf{sf}").where("held_out")
    labels = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").toPandas()
    caught = rows[rows.predicted == 1]
    assert (caught.toxic == 1).sum() >= recall * (rows.toxic == 1).sum() and (caught.toxic == 1).mean() > 0.85


def test_worst_passage_equals_brute_force():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.3)
    words = [f"w{i % 17}" for i in range(41)]
    of = lambda w: model.table[toxicity.subwords([w])[0]].mean()
    for n in (1, 7, 8, 9, 12, 13, 41):
        worst, count = toxicity.Scorer(model).worst_passages([" ".join(words[:n])])
        starts = range(0, max(1, n - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        want = max(np.mean([of(w) for w in words[s : min(n, s + toxicity.WINDOW)]]) for s in starts)
        assert abs(worst[0] - 0.3 - want) < 1e-9 and count[0] == n


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(90)], "doc_id long, quality int, toxic int")
    rows = [(i, ("idiot " if i % 2 else "fine ") + "one two three") for i in range(90)] * 2 + [(200, None), (201, ""), (202, "word " * 200_000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id >= 200").count() == 3
    assert {r.doc_id % 2 for r in kept.where("doc_id < 90").select("doc_id").collect()} == {0} and kept.where(F.col("doc_id") < 90).count() == 90
    assert toxicity.without_toxic(df.limit(0), labels).count() == 0
