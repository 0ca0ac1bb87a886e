"""What the method itself finds in the given tables, clashing columns, constant models, odd rows and bounds by bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import chat, common, ngram_join, pii, quality, sharding, toxicity, warc
from cliploom.llm.queries import op7_pii


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_patterns_find_identifiers_that_no_rule_names(spark, sf, monkeypatch):
    """Discovered spans are secrets that the seed rule misses; without confident patterns there are none."""
    path = f"/root/testdata/sf{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    rows = op7_pii(spark, path).where("n_secret_seeds + n_discovered > 0").collect()
    values = []
    for r in rows:
        for span in r.spans.split(","):
            kind, start, end = span.split(":")
            if kind == "secret":
                values.append(texts[r.doc_id][int(start) : int(end)])
    missed = [v for v in values if not spark.range(1).select(F.lit(v).rlike(pii.SECRET_VALUE)).head()[0]]
    assert len(values) == sum(r.n_secret_seeds + r.n_discovered for r in rows) and len(missed) == sum(r.n_discovered for r in rows) > 0
    # Precision: all of them are strings of 40 hexadecimal digits.
    assert all(len(v) == 40 and set(v.lower()) <= set("0123456789abcdef") for v in missed)
    monkeypatch.setattr(pii, "CONFIDENT", 2.0)
    assert op7_pii(spark, path).agg(F.sum("n_discovered")).head()[0] == 0


def test_shards_replace_columns_of_their_names(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}" * (i % 5), "a", i) for i in range(50)] + [(None, None, None, None)], "doc_id long, text string, Shard string, slot int")
    got = sharding.records(df, 4)
    assert got.columns == ["doc_id", "text", "shard", "slot"] and got.count() == 51
    got.write.parquet(str(tmp_path / "out"))
    for shard, rows in got.groupBy("shard").agg(F.sort_array(F.collect_list("slot"))).collect():
        assert list(rows) == list(range(len(rows)))
    assert sharding.records(df.limit(0)).count() == 0


@pytest.mark.parametrize("ones", [0, 12, 40])
def test_quality_of_one_kind_is_its_share(spark, ones):
    docs = spark.createDataFrame([(i, f"some words {i}", "x") for i in range(40)] + [(1, "some words 1", "x"), (99, None, "x"), (98, "long " * 300_000, "x")], "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(i, 1 if i < ones else 0) for i in range(40)] + [(1, None)], "doc_id long, quality int")
    rows = quality.described(docs)
    scores = [r.score for r in quality.scored(rows, quality.learn(rows, labels)).collect()]
    assert len(scores) == 43 and all(0 <= s <= 1 for s in scores)
    if ones in (0, 40):
        assert set(scores) == {ones / 40}
    none = quality.described(docs.limit(0))
    assert quality.scored(none, quality.learn(none, labels)).count() == 0
    bare = quality.learn(rows, labels.limit(0))
    assert {r.score for r in quality.scored(rows, bare).collect()} == {0.0}


def test_quality_scores_equal_a_whole_brute_force(spark, data):
    """Statistics, standardisation, features, ridge and calibration once more, on one table in this process."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.described(docs)
    got = {r.doc_id: r.score for r in quality.scored(rows, quality.learn(rows, labels)).collect()}
    import zlib

    texts = {r.doc_id: r.text for r in docs.collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    stats = np.array([quality.statistics(texts[i]) for i in sorted(texts)])
    place = {i: k for k, i in enumerate(sorted(texts))}
    fourier = quality.Fourier(stats.mean(axis=0), stats.std(axis=0))
    ids = [i for i in truth if i in place]
    z, y = fourier(stats[[place[i] for i in ids]]), np.array([truth[i] for i in ids], float)
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) / quality.FEATURES * np.eye(z.shape[1]), z.T @ y)
    raw = z @ beta
    bins = np.clip(raw * quality.BINS, -quality.BINS, 2 * quality.BINS).astype(int)
    at = np.unique(bins)
    model = quality.Model(fourier, beta)
    model.centres, model.values = quality.isotonic(np.array([raw[bins == b].mean() for b in at]), np.array([(bins == b).sum() for b in at], float), np.array([y[bins == b].mean() for b in at]))
    want = model(stats)
    assert max(abs(got[i] - want[place[i]]) for i in texts) < 1e-6


def test_toxicity_of_repeated_ids(spark):
    """Ids repeated in documents and labels: each row is scored, bounded rows teach, nothing multiplies without end."""
    labels = spark.createDataFrame([(i % 30, 1, i % 2) for i in range(90)], "doc_id long, quality int, toxic int")
    rows = [(i % 30, ("idiot " if i % 2 else "fine ") + "one two three") for i in range(300)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    scored = toxicity.scored(df.drop("score"), toxicity.learn(df, labels))
    assert scored.count() == 300 and scored.groupBy("text").agg(F.countDistinct("score")).where("count(DISTINCT score) > 1").count() == 0


def test_chat_of_odd_rows(spark):
    long = "word " * 60_000
    rows = [(1, 0, "user", long, "x"), (1, 1, "assistant", "a" * 100_000, "x"), (2, 0, "user", None, "x"), (2, 1, "assistant", "", "x"), (3, 0, "user", "same", "x"), (3, 0, "user", "same", "x"), (3, 1, "assistant", "twice", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, loss_chars string")
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[2].loss_chars, got[3].n_turns, got[3].loss_chars) == (2, 100_000, 2, 0, 3, 5)
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_warc_of_very_long_pages(spark):
    body = "<p>é" * 3_000_000
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame([(1, "u", body, "x"), (2, "v", body, "x")], "page_id long, url string, html string, payload_bytes string")).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == len(body.encode()) and got[2].refers_to == 1 and got[1].record_type == "response"


def test_blocks_of_large_cells_by_bytes(spark, monkeypatch):
    """Members with long sets are dealt to more blocks; the links stay those of brute force."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    shared = " ".join(f"s{i}" for i in range(40))
    texts = [(i, f"{shared} " + " ".join(f"w{i // 2}x{k}" for k in range(60 if i % 4 < 2 else 6))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    whole = sorted((r.doc_id, r.component_id) for r in ngram_join.linked(df).collect())
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.linked(df).collect()) == whole


def test_intermediate_tables_can_be_cleared(spark):
    folder = common.scratch(spark, "t").rsplit("/", 1)[0]
    common.stored(spark.range(3).toDF("a"), "t").count()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert store.exists(path)
    common.clear(spark)
    assert not store.exists(path)
