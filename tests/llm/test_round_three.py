"""Whitening, the Merkle manifest and language ID: brute force, edge cases, held-out accuracy."""

import hashlib
import random
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import langid, merkle, whitening
from cliploom.llm.queries import op11_whitening, op13_language_id

DOC = "doc_id long, text string, lang string, source string, n_chars long, tree string, block int, item string, lang_pred int"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, repeated rows and ids, long and empty texts, ties, clashing extra columns."""
    rnd = random.Random(3)
    rows = [(i, f"Text {rnd.random()} Ü {i}", rnd.choice(["en", "en", "en", "fr", None, ""]), rnd.choice(["s", None]), i if i % 5 else None) for i in range(300)]
    rows += [(7, "again", "en", "s", 1), (7, "again", "en", "s", 1), (7, "other", "en", "s", 1), (None, "no id", "en", None, None), (None, None, None, None, None)]
    rows += [(900, "", "solo", "s", 0), (901, "Word " * 100_000, "fr", "s", 500_000), (-5, "12 34", "en", "s", 5), (902, None, "fr", "s", None)]
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOC)


# 12


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def plain_tree(nodes):
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            steps[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        at, nodes = [p // 8 for p in at], [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], steps


def plain_manifest(rows):
    lower = str.maketrans(merkle._UPPER, merkle._LOWER)
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
    built = [plain_tree([plain_leaf(r, r["text"]) for r in trees[name]]) for name in names]
    root, above = plain_tree([b[0] for b in built])
    out = []
    for name, (subroot, steps), top in zip(names, built, above):
        for r, mine in zip(trees[name], steps):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            got = plain_leaf(r, r["text"].translate(lower) if tampered else r["text"])
            for before, after in mine + top:
                got = sha(before, got, after)
            out.append((r["doc_id"], plain_leaf(r, r["text"]), subroot, root, sha(*[x for s in mine + top for x in s]), got, got == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_brute_force(docs, levels):
    got = merkle.manifest(docs, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n", [1, 8, 9, 65, 513])
def test_manifest_of_ragged_trees(spark, n):
    docs = spark.range(n).selectExpr("id as doc_id", "'T' || id as text", "cast(null as string) as lang", "'s' as source", "id as n_chars").repartition(5)
    assert sorted(map(tuple, merkle.manifest(docs, 1).collect()), key=repr) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_many_trees(spark):
    docs = spark.range(150).selectExpr("id as doc_id", "'T' as text", "'l' || (id div 2) as lang", "'s' as source", "id as n_chars")
    assert sorted(map(tuple, merkle.manifest(docs, 1).collect()), key=repr) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_nothing(docs):
    assert merkle.manifest(docs.where("false")).collect() == []


# 11


@pytest.mark.parametrize("kind", ["random", "close", "equal", "low rank", "blocks", "one"])
def test_spectral_divide_and_conquer(kind):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    values = {"random": rng.uniform(0, 3, 24), "close": 1 + 1e-7 * np.arange(24), "equal": np.repeat([3.0, 2.0, 1.0], 8), "low rank": np.r_[np.arange(1.0, 6), np.zeros(19)], "blocks": np.r_[np.full(23, 1.0), 9], "one": np.full(24, 2.0)}[kind]
    a = q @ np.diag(values) @ q.T
    got, vectors = whitening.eigen(a)
    assert np.allclose(got, np.sort(values)[::-1], atol=1e-13 * 24) and np.allclose(vectors.T @ vectors, np.eye(24), atol=1e-13)
    assert np.linalg.norm(a @ vectors - vectors * got) < 1e-12


def test_polar_factor():
    a = np.random.default_rng(1).normal(size=(9, 9))
    a = a + a.T
    u = whitening.polar(a)
    w, v = np.linalg.eigh(a)
    assert np.allclose(u, v @ np.diag(np.sign(w)) @ v.T, atol=1e-12)


def plain_whitening(vectors, k):
    x = np.array([[int(np.floor(max(min(float(c), 2.0**40), -(2.0**40)) * 64)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    mean = np.array([Decimal(int(a)) / n for a in s])
    centre = lambda rows: np.array([[float(Decimal(int(v)) - m) for v, m in zip(r, mean)] for r in rows])
    c = centre(fit)
    w, v = np.linalg.eigh(c.T @ c / n)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    return n, [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x], centre(x) @ v / np.sqrt(w), w, float(np.trace(c.T @ c / n))


def test_whitening_equals_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, z, w, trace = plain_whitening([r["embedding"] for r in rows], 16)
    got = op11_whitening(spark, data).orderBy("vec_id", "component").toPandas()
    assert got.component.tolist() == list(range(1, 17)) * len(rows) and set(got.n) == {n} and got.deviation.tolist()[::16] == deviation
    mine = got.whitened.to_numpy().reshape(-1, 16)
    assert np.allclose(mine * np.sign((mine * z).sum(axis=0)), z, atol=1e-9) and np.allclose(got.explained[:16], w / trace, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, x int, row string, z int, at int"
    good = [(i % 3 or None, [float(i), float(i % 4), 2.0 * i, 5.0]) for i in range(20)]
    bad = [(50, None), (51, [1.0, None, 1.0, 1.0]), (52, [1.0, float("nan"), 1.0, 1.0]), (53, [float("inf"), 1.0, 1.0, 1.0]), (54, []), (55, [1.0])]
    df = spark.createDataFrame([(*r, 1, "r", 2, 3) for r in good + good[:5] + bad], schema)
    got = whitening.report(df).toPandas()
    assert len(got) == 25 * 4 and set(got.n) == {20} and got.vec_id.isna().sum() >= 4
    by = {c: g for c, g in got.groupby("component")}
    # Two of four directions have variance: the third entry follows the first, the fourth is constant.
    assert by[1].whitened.notna().all() and by[2].whitened.notna().all() and by[3].whitened.isna().all() and (by[4].explained == 0).all()
    assert got.identity_error.max() < 1e-9 and abs(got.groupby("component").explained.first().sum() - 1) < 1e-9
    assert whitening.report(df.where("vec_id >= 50")).where("vec_id < 55").count() == 0 and whitening.report(df.limit(0)).count() == 0
    one = whitening.report(df.where("vec_id is null").limit(1)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in one)


def test_whitening_of_extreme_entries(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [3.0, 5.0], [3.0, 4.5]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    _, deviation, z, _, _ = plain_whitening(vectors, 2)
    got = whitening.report(df).where("component = 1").orderBy("vec_id").collect()
    assert [int(r.deviation_exact) for r in got] == deviation and got[0].deviation is None and got[2].deviation is not None
    assert np.allclose(np.abs([r.whitened for r in got]), np.abs(z[:, 0]), rtol=1e-9)


# 13


def test_language_on_held_out_rows(spark):
    got = op13_language_id(spark, "/root/testdata/sf0.01")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()
    kept = rows[~rows.rejected]
    assert len(kept) > 0.9 * len(rows) and (kept.lang == kept.lang_pred).mean() > 0.98


def test_language_equals_brute_force():
    import zstandard

    model = langid.Model(["a", "b"], [b" some plain english words here " * 9, b" ein paar deutsche worte hier " * 9])
    coder = langid.Coder(model)
    for text in ["Some WORDS, here!", "deutsche 12 Worte", "x", "paar " * 900 + "english " * 400]:
        form, sizes = langid.folded(text), []
        for content in model.contents:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=langid.LEVEL)
            one = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(one.compress(form[k : k + langid.PIECE])) for k in range(0, len(form), langid.PIECE)))
        name, score, rejected = coder.judged(text)
        assert name == ("b" if sizes[1] < sizes[0] else "a") and rejected == (max(sizes) - min(sizes) < langid.MARGIN * min(sizes))
        assert abs(score - 1 / (1 + 2.0 ** -min(1000, max(sizes) - min(sizes)))) < 1e-12


def test_language_edge_cases(spark, docs):
    rnd = random.Random(8)
    speak = {"en": "the of and with that house", "fr": "le de et avec que maison"}
    rows = [(i, " ".join(rnd.choice(speak[k].split()) for _ in range(30)), k) for i, k in enumerate(["en", "fr"] * 60)]
    rows += [(500, None, "en"), (501, "", "fr"), (502, "12 ... 34", "en"), (503, "que maison " * 50_000, None), (None, "the house with that", None), (0, "the of", "en"), (0, "the of", "en")]
    df = spark.createDataFrame([(*r, 3, "s") for r in rows], "doc_id long, text string, lang string, score int, source string")
    got = langid.identified(df, langid.learn(df))
    assert got.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "rejected"] and got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert {by[i].lang_pred for i in (500, 501, 502)} == {"und"} and {by[i].score for i in (500, 501, 502)} == {0.0}
    assert by[503].lang_pred == "fr" and by[503].score > 0.99 and by[None].lang_pred == "en"
    assert all(r.lang_pred == r.lang for r in by.values() if r.doc_id and r.doc_id < 120)
    assert {r.lang_pred for r in langid.identified(df, langid.learn(df.limit(0))).collect()} == {"und"}
    assert langid.identified(df.limit(0), langid.learn(df)).collect() == []


def test_language_ties_and_many_languages(spark):
    # Nothing tells the two apart: the more frequent language is named, and the answer is rejected.
    rows = [(i, "same words in each", "zz" if i % 3 else "aa") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.rejected) for r in langid.identified(df, langid.learn(df)).select("lang_pred", "rejected").collect()} == {("zz", True)}
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id") % 700).alias("lang"))
    model = langid.learn(many)
    assert len(model.names) > 690 and sum(map(len, model.contents)) <= langid.TOTAL
