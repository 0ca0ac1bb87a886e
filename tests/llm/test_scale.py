"""Groups of bounded size: small bounds must leave results as they are; the given tables against SQL and plain sums."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm import flat, plain_components, words

from cliploom.llm import components, ngram_join, quality, queries, sharding, warc


def test_askers_of_a_large_cell_are_dealt_to_blocks(spark, monkeypatch):
    """Texts that share an ending: with twelve own words none link, with eight all do, at exactly 0.75."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rows = []
    for corpus in range(3):
        shared = words(60, 3 + corpus).split()
        for i in range(42):
            own = 12 if i < 30 else 8
            rows.append((len(rows), " ".join([f"own{corpus}x{i}x{k}" for k in range(own)] + shared[own:])))
    seen = []
    plain = ngram_join.cross_links

    def watched(rest, *more):
        # Everything asks, as if no link were known: the blocks alone must find the components.
        alone = plain(rest.withColumns({"root": F.col("node"), "main": F.lit(-1).cast("long")}), *more)
        groups = components.components(alone).groupBy("root").count().collect()
        seen.append((*rest.agg(F.max("asking"), F.max("blocks")).head(), sorted(r["count"] for r in groups)))
        return plain(rest, *more)

    monkeypatch.setattr(ngram_join, "cross_links", watched)
    got = flat(ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_components(rows) and len({r[2] for r in got}) == 93
    assert min(seen[0][:2]) > 1 and seen[0][2] == [12, 12, 12]


def test_normal_equations_in_levels(spark, monkeypatch):
    monkeypatch.setattr(quality, "LANE", 2)
    rnd = np.random.default_rng(3)
    stats, y = rnd.normal(size=(90, len(quality.NAMES))), rnd.integers(0, 2, 90)
    train = spark.createDataFrame([(s.tolist(), int(v)) for s, v in zip(stats, y)], "stats array<double>, quality int").repartition(7)
    fourier = quality.Fourier(stats.mean(axis=0), stats.std(axis=0))
    x = fourier(stats)
    assert np.allclose(quality._normal_equations(train, fourier), np.column_stack([x.T @ x, x.T @ y]))


def test_statistics_of_a_text():
    got = dict(zip(quality.NAMES, quality.statistics("Ab cd cd.\n12 | x")))
    assert got["log_words"] == pytest.approx(np.log1p(6)) and got["word_mean"] == pytest.approx(11 / 6)
    assert got["digits"] == pytest.approx(2 / 16) and got["upper"] == pytest.approx(1 / 16) and got["spaces"] == pytest.approx(5 / 16)
    assert got["log_lines"] == pytest.approx(np.log1p(2)) and got["ended_lines"] == 0.5 and got["pipes"] == pytest.approx(1 / 6)


def test_isotonic_blocks_rise():
    centres, values = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 2, 1]), np.array([0.2, 0.8, 0.2, 0.9]))
    assert values.tolist() == pytest.approx([0.2, 0.4, 0.9]) and centres.tolist() == pytest.approx([0, 5 / 3, 3])


def test_small_ranges_keep_the_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 300)
    rows = [(i, "same text" if i % 3 == 0 else words(1 + i % 40, i)) for i in range(900)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    filled = got.groupby("shard")["size"].sum()
    assert len(got) == 900 and len(filled) == 16 and filled.max() - filled.min() <= 2 * got["size"].max()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_archives_roll(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(warc, "FILE_CHUNKS", 2)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{'x' * (200 + i % 5)}{i % 60}") for i in range(120)], "page_id long, url string, html string").coalesce(1)
    warc.write_arc(pages, f"file://{tmp_path}/arc")
    assert len(list((tmp_path / "arc").glob("*.gz"))) > 4
    got = warc.round_trip(pages).toPandas().sort_values("page_id")
    assert got["page_id"].tolist() == list(range(120)) and got["record_type"].tolist() == ["response"] * 60 + ["revisit"] * 60
    assert got["refers_to"].tolist()[60:] == list(range(60))


@pytest.mark.parametrize("name", ["op8_warc", "op9_chat_formatting"])
def test_given_tables_equal_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    want = want.df()[columns]
    got = queries.QUERIES[name](spark, data).toPandas()
    assert sorted(got.columns) == columns
    plain = lambda frame: sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))
    assert plain(got.convert_dtypes()) == plain(want.convert_dtypes())
