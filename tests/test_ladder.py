"""Ladders, caption cues and other folds against plain loops; what each rung is asked."""

import random

import pytest
from pyspark.sql import functions as F

from cliploom.operators import ladder as L
from cliploom.operators import media as M
from cliploom.operators import transcripts as T
from cliploom.plans.views import view
from cliploom.sources import catalog as C

KEYS = ["job_id", "span_idx"]


@pytest.fixture(scope="module")
def ladder(spark):
    rnd = random.Random(2)
    spans = [(j, s, rnd.choice([0.5, 0.9, 1.0, 3.0])) for j in range(12) for s in range(4)]
    local = [(j, s, f"c{rnd.randint(0, 9)}{k}", k + 1, round(0.9 - 0.25 * k - rnd.random() * 0.5, 3)) for j, s, _ in spans for k in range(rnd.randint(0, 4))]
    found = [(j, s, rnd.choice(["c00", "y1", "y2", "y3", "y1"]), k) for j, s, _ in spans for k in range(rnd.randint(0, 3))]
    return spans, local, found


def plain(ladder, size, padded):
    spans, local, found = ladder
    out, asked = {}, []
    for j, s, length in spans:
        mine = sorted((r[3], r[2], r[4]) for r in local if r[:2] == (j, s))
        seen = []
        for item in sorted((k, i) for jj, ss, i, k in found if (jj, ss) == (j, s)):
            if item[1] not in [x for _, x in seen]:
                seen.append(item)
        rows = []
        if padded:
            if mine and mine[0][2] >= 0.35:
                rows = [(i, "local") for _, i, score in mine[:size] if score > 0]
            confident = bool(rows) and mine[0][2] >= 0.35 * 1.5
            if len(rows) < size and length >= 1.0 and not confident:
                asked.append((j, s))
                rows += [(i, "search") for _, i in seen[:1] if i not in [x for x, _ in rows]]
            if not rows:
                rows = [("crop", "reference_crop")]
            rows += [rows[-1]] * (size - len(rows))
        else:
            rows = [(i, "local") for _, i, score in mine if score > 0][:size]
            if len(rows) < size and length >= 1.0:
                asked.append((j, s))
                rows += [(i, "search") for _, i in seen[: size - len(rows)] if i not in [x for x, _ in rows]]
            if len(rows) < size:
                rows.append(("crop", "reference_crop"))
        out[j, s] = rows[:size]
    return out, sorted(asked)


@pytest.mark.parametrize("size", [1, 2, 3])
@pytest.mark.parametrize("padded", [False, True])
def test_ladders_equal_brute_force_and_ask_only_open_spans(spark, ladder, size, padded):
    spans, local, found = (spark.createDataFrame(rows, schema) for rows, schema in zip(ladder, ("job_id int, span_idx int, length_s double", "job_id int, span_idx int, item string, rank int, score double", "job_id int, span_idx int, item string, rank int")))
    scored = []

    def search(open_):
        scored.append(open_)
        return found.join(open_.select(*KEYS), KEYS)

    made = (L.pool if padded else L.pack)(spans, local, search, size, KEYS)
    got = {}
    for r in made.orderBy(*KEYS, "rank").collect():
        got.setdefault((r.job_id, r.span_idx), []).append((r.item, r.rung))
    want, asked = plain(ladder, size, padded)
    assert got == want
    assert sorted((r.job_id, r.span_idx) for r in scored[0].collect()) == asked and len(asked) < len(ladder[0])


def test_first_rung(spark):
    asked = spark.createDataFrame([(i,) for i in range(6)], "k int")
    opened = []
    rung = lambda *rows: lambda open_: (opened.append(sorted(r.k for r in open_.collect())), spark.createDataFrame(list(rows), "k int, item string, score double").join(open_, "k"))[1]
    got = L.first_rung(asked, "k", [("a", 0.55, rung((0, "x", 0.6), (0, "y", 0.55), (1, "x", 0.5))), ("b", 0.5, rung((0, "z", 0.9), (1, "z", 0.5), (2, "z", 0.4)))])
    assert sorted((r.k, r.item or "", r.rung) for r in got.collect()) == [(0, "x", "a"), (0, "y", "a"), (1, "z", "b"), *[(k, "", "reference_crop") for k in (2, 3, 4, 5)]]
    assert opened == [[0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5]]


def plain_cues(words, duration, most=3, gap=1.0):
    groups = []
    for start, _, end, word in sorted(words):
        if start >= duration:
            break
        n = len(word.split())
        if groups and sum(len(w[2].split()) for w in groups[-1]) + n <= most and start - groups[-1][-1][1] <= gap:
            groups[-1].append((start, end, word))
        else:
            groups.append([(start, end, word)])
    cues = [(max(0.0, g[0][0]), min(duration, max(g[-1][1], g[0][0] + 0.3)), " ".join(w.replace("{", "(").replace("}", ")").replace("\\", "/").strip() for _, _, w in g)) for g in groups]
    cues = [c for c in cues if c[1] > c[0]]
    cues = [(a, min(b, cues[i + 1][0]) if i + 1 < len(cues) else b, t) for i, (a, b, t) in enumerate(cues)]
    return [c for c in cues if c[1] > c[0]]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_cues_equal_brute_force(spark, batch):
    rnd = random.Random(4)
    rows, lengths = [], []
    for asset in range(25):
        at = 0.0
        for pos in range(rnd.randint(1, 40)):
            at += rnd.choice([0.0, 0.2, 0.5, 1.4])
            rows.append((asset, pos, round(at, 2), round(at + rnd.choice([0.0, 0.1, 0.4, 1.0]), 2), rnd.choice(["a", "b c", "{x}", "d e f g", "h\\"])))
        lengths.append((asset, round(at * rnd.choice([0.5, 1.0, 1.5]) + 0.1, 2)))
    words = spark.createDataFrame(rows, "asset_id long, pos int, start_s double, end_s double, word string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = T.caption_cues(words, spark.createDataFrame(lengths, "asset_id long, duration double")).orderBy("asset_id", "cue").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for asset, duration in lengths:
        assert [(r.start, r.end, r.text) for r in got if r.asset_id == asset] == plain_cues([(s, p, e, w) for a, p, s, e, w in rows if a == asset], duration)


def test_caption_files(spark, data):
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, "hi"), (1, 1, 1.0, 2.5, "you"), (2, 0, 0.0, 1.0, "x")], "asset_id long, cue int, start double, end double, text string")
    titles = spark.createDataFrame([(1, 61.0, "How Jeff Bezos Won", "", ["Jeff Bezos"]), (3, 2.0, "Only", "a {title}", []), (4, 1.0, "", "", [])], "asset_id long, duration double, line1 string, line2 string, highlights array<string>")
    got = {r.asset_id: r.value.split("\n") for r in T.caption_file(cues, titles).collect()}
    assert got[1] == ["Dialogue: 1,0:00:00.00,0:01:01.00,Title,,0,0,0,,How *Jeff Bezos* Won", "Dialogue: 0,0:00:00.00,0:00:01.00,Caption,,0,0,0,,hi", "Dialogue: 0,0:00:01.00,0:00:02.50,Caption,,0,0,0,,you"]
    assert got[3] == ["Dialogue: 1,0:00:00.00,0:00:02.00,Title,,0,0,0,,Only\\Na (title)"] and set(got) == {1, 2, 3}
    assert {r.asset_id for r in T.caption_file(cues, titles, add_caption=False).collect()} == {1, 3}


def test_outline_of_words_without_segments(spark):
    words = spark.createDataFrame([(1, i, i * 1.0, i + 0.5, f"w{i}") for i in range(10)] + [(2, 0, 0.0, 1.0, "other")], "asset_id long, pos int, start_s double, end_s double, word string")
    segments = spark.createDataFrame([(2, 0, 0.0, 3.0, " said ")], "asset_id long, seg_idx int, start_s double, end_s double, text string")
    got = {r.asset_id: r.outline for r in T.outline(segments, words).collect()}
    assert got[2] == "[0.00-3.00] said" and got[1].split("\n")[0] == "[0.00-8.00] w0 w1 w2 w3 w4 w5 w6 w7" and len(got[1].split("\n")) == 3


def test_tags_and_batches(spark):
    rows = spark.createDataFrame([("Tense ", " CITY "), ("odd", None)], "mood string, subjects string").select(F.struct("mood", "subjects").alias("f"))
    got = rows.select(M.scene_tag(F.col("f"), "mood", scalar=True), M.scene_tag(F.col("f"), "subjects", scalar=True)).collect()
    assert [list(r) for r in got] == [[["tense"], ["city"]], [[], []]]
    files = spark.createDataFrame([("a", 1), ("b", 2), ("bad", 3)], "path string, n int").coalesce(1)
    made = C.extracted_batches(files, lambda frame: frame[frame.n < 3][["path"]].assign(tag="t"), "tag string").collect()
    assert sorted((r.path, r.tag, r.error) for r in made) == [("a", "t", None), ("b", "t", None)]

    def broken(frame):
        raise ValueError("no")

    assert sorted((r.path, r.error) for r in C.extracted_batches(files, broken, "tag string").collect()) == [("a", "no"), ("b", "no"), ("bad", "no")]


def test_legacy_index(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"version": 1, "clips": {"a": {"mtime": 1.0, "size": 2, "features": "f"}, "b": {"mtime": null, "size": 2}}}')
    assert [(r.path, r.mtime, r["size"]) for r in C.legacy_index(spark, str(tmp_path / "i.json")).collect()] == [("a", 1.0, 2)]
    (tmp_path / "i.json").write_text('{"version": 0, "clips": {"a": {"mtime": 1.0, "size": 2}}}')
    assert C.legacy_index(spark, str(tmp_path / "i.json")).count() == 0


def test_cues_of_the_given_words(spark, data):
    words = view(spark, data, "words")
    got = {}
    for r in T.caption_cues(words).orderBy("asset_id", "cue").collect():
        got.setdefault(r.asset_id, []).append((r.start, r.end, r.text))
    by = {}
    for r in words.where("asset_id % 20 = 0").collect():
        by.setdefault(r.asset_id, []).append((r.start_s, r.pos, r.end_s, r.word))
    for asset, rows in by.items():
        assert got[asset] == plain_cues(rows, max(e for _, _, e, _ in rows))


def test_keys_of_files(spark):
    import hashlib

    from cliploom.functions import features as X

    contents = [b"", b"short", bytes(range(256)) * 5000, b"ab" * (1 << 19) + b"tail"]
    got = [r[0] for r in spark.createDataFrame([(bytearray(c),) for c in contents], "c binary").select(X.file_key(F.col("c"))).collect()]
    mib = 1 << 20
    want = [hashlib.md5(f"size:{len(c)}\n".encode() + c[:mib] + (c[-mib:] if len(c) > mib else b"")).hexdigest() for c in contents]
    assert got == want


def test_answers_without_fences(spark):
    rows = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 1',), ("no object",), ('say {"b": {}} end',)], "t string")
    assert [r[0] for r in rows.select(C.json_object_or_text(F.col("t"))).collect()] == ['{"a": 1}', '{"a": 1', None, '{"b": {}}']
