"""N-gram Jaccard self-join of documents with count-vector R-trees.

A text's set holds its distinct five-word shingles.  Two documents link when 100 * |both| is at
least 75 * |either|.  Texts with equal sets form a class and are handled once.

Points.  A class hashes its shingles into groups (about one group per three shingles, a power of
two) and counts each group: a point.  For two points the sum over groups of the smaller count
bounds the overlap from above; for a box of points, whose corner holds the largest counts, the same
sum bounds the overlap with every point inside.  ``CountTree`` packs points into such boxes.

Cells.  A tree over all points alone would not scale: boxes of unrelated high-dimensional points
overlap, every search would visit most of them, and the work would grow with the square of the
corpus.  The top of the tree is therefore cut by shared shingles.  Two linked sets must meet in
the first ``n // 4 + 1`` shingles of any common order; the order puts shingles with many documents
last (counted exactly over all documents) and else follows the hash.  Each such shingle is a cell.

Search.  Small cells pair their members; large cells pair members with a pivot of each size.
Pairs with sizes or count vectors that cannot reach the threshold end there; the rest are verified
on the full sets.  After that only members of a large cell that fell into different components
can still link: they are searched in a tree over the cell's points, in blocks, and verified there.
Pairs inside one component need no test, so a group of k near copies costs about k, not k * k.

Shingles are 64-bit hashes.  A class has a 128-bit digest and is named by 55 bits of it and its size; that no two
digests share a name is tested over all documents, and if some do, all names are drawn anew.

Defined results: null, empty and blank texts have no shingles and link with nothing, not even each
other; a text of fewer than five words has its word sequence as its only shingle; repeated rows
link with each other; a component's id is its smallest document id (null only if all are null);
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import noted, packed, sketch, stored, text_frames, unpacked
from .components import components
from .shingles import mix64, set_digest, shingle_sets

#: Documents from which a shingle counts as frequent, and members from which a cell is large.
FREQUENT = 32
#: Frequent shingles that are told to the tasks (16 MB), the most frequent first.  Any order of
#: shingles gives the same links; this one only decides how even the cells are.
TOLD = 1 << 20
BLOCK, FLUSH = 4096, 1_500_000
#: Bytes of full sets in a block of a large cell, one set at least.
BLOCK_BYTES = 64 << 20
_ROW = "kind int, bucket int, doc_id long, text_hash long, a long, b long, n long, keys binary, owners binary"
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]
#: Whole numbers travel without nulls, for pandas would make them floats: no class is -1, no id this.
NO_CLASS, NO_ID = -1, -(2**63)
DOC, POINT, KEYS, PAIR, MEMBER = range(5)


def class_name(digest: bytes, size: int, salt: int = 0) -> int:
    """55 bits of the set's digest and 8 bits of its size on a scale of tenths."""
    code = min(255, int(np.log(size) / np.log(1.1)))
    drawn = hashlib.blake2b(digest, digest_size=8, salt=bytes([salt])).digest()
    return (int.from_bytes(drawn, "little") >> 9) << 8 | code


def comparable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False where the size parts of two names rule out a ratio of 3 to 4."""
    return np.abs((a & 255) - (b & 255)) <= 4


def count_vector(values: np.ndarray) -> np.ndarray:
    groups = 1 << max(4, int(np.ceil(np.log2(max(1, len(values) / 3)))))
    return np.bincount((values & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype("<u2" if len(values) < 65536 else "<u4")


def _vector(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if n < 65536 else "<u4").astype(np.int32)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The vector over fewer groups: groups that meet there are added."""
    return vector.reshape(-1, groups).sum(axis=0) if len(vector) > groups else vector


def may_link(overlap: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """100 * i >= 75 * (n_a + n_b - i), in whole numbers."""
    return 7 * overlap >= 3 * (n_a + n_b)


class CountTree:
    """Boxes of count vectors, packed by label and size, with corners of the largest counts."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((sizes, labels))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > self.FAN:
            corner, least = self.levels[-1]
            starts = np.arange(0, len(corner), self.FAN)
            self.levels.append((np.maximum.reduceat(corner, starts), np.minimum.reduceat(least, starts)))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions of the points that may link with the given one."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            bound = np.minimum(corner[at], point).sum(axis=1)
            at = at[may_link(bound, least[at], size)]
            if depth and len(at):
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def _classes(sets: list[np.ndarray], seen: set[int], salt: int) -> tuple[list[int], list[bytes | None], list[int]]:
    """Name (NO_CLASS if empty) and digest of each set, and the positions of those not met before in this task."""
    names, digests, new = [], [], []
    for i, values in enumerate(sets):
        digest = set_digest(values) if len(values) else None
        name = NO_CLASS if digest is None else class_name(digest, len(values), salt)
        names.append(name)
        digests.append(digest)
        if name != NO_CLASS and name not in seen:
            seen.add(name)
            new.append(i)
    return names, digests, new


def _split_key(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket: the first bits, key: the next 32) of sorted or unsorted hashes."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes >> np.uint64(32 - bits)).astype(np.uint32)


def frequent_shingles(source: DataFrame, bits: int) -> DataFrame:
    """(key, documents) of the shingles in more than FREQUENT classes, counted over all texts.

    A task sends, for each bucket of the hash range, the sorted shingles it has met and their counts
    as two byte strings, so that a shingle costs a few bytes on the way.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held, size = [], 0

        def rows() -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket, key = _split_key(values, bits)
            there, starts = np.unique(bucket, return_index=True)
            ends = np.append(starts[1:], len(bucket))
            counts = counts.astype("<u4")
            return pd.DataFrame({"bucket": there, "keys": [key[s:e].tobytes() for s, e in zip(starts, ends)], "counts": [counts[s:e].tobytes() for s, e in zip(starts, ends)]})

        for frame in batches:
            for part in text_frames(frame):
                sets = shingle_sets(part["text"])
                for i in _classes(sets, seen, 0)[2]:
                    held.append(sets[i])
                    size += len(sets[i])
                if size > FLUSH:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, "<u4") for x in frame["keys"]])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in frame["counts"]])
        order = np.argsort(keys, kind="stable")
        there, starts = np.unique(keys[order], return_index=True)
        total = np.add.reduceat(counts[order].astype(np.int64), starts)
        many = total > FREQUENT
        return pd.DataFrame({"key": (int(key[0]) << 32) | there[many].astype(np.int64), "documents": total[many]})

    sent = source.select("text").mapInPandas(local, "bucket int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(added, "key long, documents long")


def _told(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most TOLD frequent shingles, sorted by key: a proven bound for what tasks are told."""
    rows = frequent.orderBy(F.desc("documents"), "key").limit(TOLD).toPandas() if frequent.count() > TOLD else frequent.toPandas()
    rows = rows.sort_values("key")
    return rows["key"].to_numpy(np.uint64), rows["documents"].to_numpy(np.int64)


def cells(source: DataFrame, frequent: tuple[np.ndarray, np.ndarray], bits: int, salt: int) -> DataFrame:
    """One stored table of documents, points, candidate pairs and members of large cells."""
    shared = source.sparkSession.sparkContext.broadcast(frequent)

    def prefix(values: np.ndarray) -> np.ndarray:
        told, documents = shared.value
        length = len(values) // 4 + 1
        if not len(told):
            return values[:length]
        key = values >> np.uint64(32 - bits)
        at = np.minimum(np.searchsorted(told, key), len(told) - 1)
        many = told[at] == key
        rare = values[~many]
        if len(rare) >= length:
            return rare[:length]
        # Equal truncated keys share their count and keep the order of the full hash.
        rest = values[many][np.argsort(documents[at[many]], kind="stable")]
        return np.concatenate([rare, rest])[:length]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held, owners, size = [], [], 0

        def keys() -> pd.DataFrame:
            values, owner = np.concatenate(held), np.concatenate(owners)
            bucket, key = _split_key(values, bits)
            order = np.argsort(bucket, kind="stable")
            bucket, key, owner = bucket[order], key[order], owner[order]
            there, starts = np.unique(bucket, return_index=True)
            ends = np.append(starts[1:], len(bucket))
            made = pd.DataFrame({"bucket": there, "keys": [key[s:e].tobytes() for s, e in zip(starts, ends)], "owners": [owner[s:e].tobytes() for s, e in zip(starts, ends)]})
            return _typed(made.assign(kind=KEYS))

        for frame in batches:
            for part in text_frames(frame):
                sets = shingle_sets(part["text"])
                names, digests, new = _classes(sets, seen, salt)
                mixed = mix64(part["doc_id"].to_numpy(np.int64).view(np.uint64) ^ part["text_hash"].to_numpy(np.int64).view(np.uint64))
                spread = (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)
                ids = {"doc_id": part["doc_id"].to_numpy(), "text_hash": part["text_hash"].to_numpy()}
                yield _typed(pd.DataFrame({"kind": DOC, "bucket": spread, **ids, "a": names, "n": [len(s) for s in sets], "owners": digests}))
                if new:
                    points = [count_vector(sets[i]).tobytes() for i in new]
                    yield _typed(pd.DataFrame({"kind": POINT, "bucket": spread[new], "a": [names[i] for i in new], "n": [len(sets[i]) for i in new], "keys": points}))
                for i in new:
                    first = prefix(sets[i])
                    held.append(first)
                    owners.append(np.full(len(first), names[i], "<i8"))
                    size += len(first)
                if size > FLUSH // 2:
                    yield keys()
                    held, owners, size = [], [], 0
        if held:
            yield keys()

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held = None, []
        for frame in batches:
            other = frame["kind"] != KEYS
            if other.any():
                yield frame[other]
            mine = frame[~other]
            for number, keys, owners in zip(mine["bucket"].tolist(), mine["keys"], mine["owners"]):
                if number != bucket and held:
                    yield from _candidates(bucket, held)
                    held = []
                bucket = number
                held.append((keys, owners))
        if held:
            yield from _candidates(bucket, held)

    sent = source.mapInPandas(send, _ROW)
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInPandas(gather, _ROW), "ngram-cells", partition_by="kind")


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.reindex(columns=_COLUMNS)
    for c in ("doc_id", "text_hash", "a", "b", "n"):
        frame[c] = 0 if frame[c].isna().all() else frame[c].astype("int64")
    for c in ("keys", "owners"):
        frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
    return frame.astype({"kind": "int32", "bucket": "int32"})


def _candidates(bucket: int, held: list[tuple[bytes, bytes]]) -> Iterator[pd.DataFrame]:
    """Pairs and large-cell members of one bucket of cells."""
    keys = np.concatenate([np.frombuffer(k, "<u4") for k, _ in held])
    owners = np.concatenate([np.frombuffer(o, "<i8") for _, o in held])
    # By cell, then by size, then by name; copies of a class from several tasks fall together.
    order = np.lexsort((owners, owners & 255, keys))
    keys, owners = keys[order], owners[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[fresh], owners[fresh]
    there, starts, counts = np.unique(keys, return_index=True, return_counts=True)
    pairs = []
    for size in np.unique(counts[(counts > 1) & (counts <= FREQUENT)]):
        block = owners[starts[counts == size][:, None] + np.arange(size)]
        i, j = np.triu_indices(size, 1)
        pairs.append(np.column_stack([block[:, i].ravel(), block[:, j].ravel()]))
    members = []
    for key, start, count in zip(there[counts > FREQUENT], starts[counts > FREQUENT], counts[counts > FREQUENT]):
        mine = owners[start : start + count]
        codes, first = np.unique(mine & 255, return_index=True)
        pivots = mine[first]
        pairs.append(np.column_stack([np.repeat(pivots, np.diff(np.append(first, count))), mine]))
        i, j = np.triu_indices(len(pivots), 1)
        pairs.append(np.column_stack([pivots[i], pivots[j]]))
        members.append(pd.DataFrame({"kind": MEMBER, "bucket": bucket, "a": (bucket << 32) | int(key), "b": mine}))
    if pairs:
        both = np.concatenate(pairs)
        both = both[(both[:, 0] != both[:, 1]) & comparable(both[:, 0], both[:, 1])]
        both = np.unique(np.sort(both, axis=1), axis=0) if len(both) else both
        for at in range(0, len(both), 100_000):
            part = both[at : at + 100_000]
            yield _typed(pd.DataFrame({"kind": PAIR, "bucket": bucket, "a": part[:, 0], "b": part[:, 1]}))
    for frame in members:
        yield _typed(frame)


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose count vectors leave the threshold within reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            keep = []
            for n_a, n_b, v_a, v_b in zip(frame["n_a"], frame["n_b"], frame["v_a"], frame["v_b"]):
                left, right = _vector(v_a, n_a), _vector(v_b, n_b)
                groups = min(len(left), len(right))
                keep.append(bool(may_link(np.minimum(folded(left, groups), folded(right, groups)).sum(), n_a, n_b)))
            yield frame.loc[keep, ["a", "b"]]

    side = lambda s: points.select(F.col("a").alias(s), F.col("n").alias(f"n_{s}"), F.col("keys").alias(f"v_{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a")
    return near.select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInPandas(run, "a long, b long")


def class_sets(source: DataFrame, wanted: DataFrame, docs: DataFrame, salt: int) -> DataFrame:
    """(a, s): the full shingle set of each wanted class, made from one of its texts."""
    texts = docs.groupBy("a").agg(F.min("text_hash").alias("text_hash")).join(wanted, "a")
    texts = stored(texts.select("text_hash").distinct(), "ngram-texts")
    near = noted(source.select("text", "text_hash"), "text_hash", sketch(texts, "text_hash")).where("noted").select("text", "text_hash")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in batches:
            for part in text_frames(frame):
                sets = shingle_sets(part["text"])
                names, _, new = _classes(sets, seen, salt)
                if new:
                    yield pd.DataFrame({"a": [names[i] for i in new], "s": [sets[i].tobytes() for i in new]})

    # One row per class: copies that tasks hold are equal, so any of them serves.
    sets = near.mapInPandas(run, "a long, s binary").join(wanted, "a", "left_semi").dropDuplicates(["a"])
    return stored(sets, "ngram-sets")


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of the others."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    return np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum([0] + [len(x) for x in others[:-1]]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes that link, tested on their full sets."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            keep = []
            for s_a, s_b in zip(frame["s_a"], frame["s_b"]):
                left, right = np.frombuffer(s_a, np.uint64), np.frombuffer(s_b, np.uint64)
                keep.append(bool(may_link(overlaps(left, [right])[0], len(left), len(right))))
            yield frame.loc[keep, ["a", "b"]]

    side = lambda s: sets.select(F.col("a").alias(s), F.col("s").alias(f"s_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInPandas(test, "a long, b long")


def open_members(members: DataFrame, labels: DataFrame, points: DataFrame) -> DataFrame:
    """Members of the large cells that still hold several components.

    (cell, node, root, main, blocks, asking, cells): ``main`` is the cell's largest component, ``blocks`` and
    ``asking`` count the blocks of all members and of those outside it, by rows and by bytes of their sets;
    ``cells`` are all such cells of the node.
    """
    placed = members.select(F.col("a").alias("cell"), F.col("b").alias("node")).join(labels, "node", "left")
    placed = placed.join(points.select(F.col("a").alias("node"), "n"), "node").select("cell", "node", F.coalesce("root", "node").alias("root"), "n")
    sizes = placed.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("held"))
    most = F.max(F.struct("k", "root", "held"))
    several = sizes.groupBy("cell").agg(most.alias("most"), F.sum("k").alias("members"), F.sum("held").alias("held"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    several = several.withColumn("main", F.col("most.root"))
    deal = lambda k, n: F.greatest(F.ceil(k / BLOCK), F.ceil(n * 8 / BLOCK_BYTES)).cast("int")
    counts = (deal(F.col("members"), F.col("held")).alias("blocks"), deal(F.col("members") - F.col("most.k"), F.col("held") - F.col("most.held")).alias("asking"))
    rows = stored(placed.join(several, "cell").select("cell", "node", "root", "main", *counts), "ngram-open")
    return rows.join(rows.groupBy("node").agg(F.collect_list("cell").alias("cells")), "node")


def cross_links(rows: DataFrame, points: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a cell that are in different components.

    A cell's members are dealt to blocks; each block is a tree.  Members outside the main component
    are dealt to asking blocks too, and each of those asks every block in a group of its own, so that a
    group holds about two blocks however large the cell is.  What the tree leaves is verified on the
    full sets in the same task, so only links come out.  A pair that shares several cells is tested in
    the first of them only, and once two components have met in a task they are not compared again there.
    """
    full = rows.join(points.select(F.col("a").alias("node"), "n", F.col("keys").alias("point")), "node").join(sets.select(F.col("a").alias("node"), "s"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    asks = F.col("root") != F.col("main")
    asker = F.when(asks, F.pmod(F.xxhash64("node", F.lit(1)), F.col("asking")).cast("int")).otherwise(-1)
    # A member stands in its own block for every asking block, and asks every other block from its asking block.
    stands = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda q: F.struct(F.col("own").alias("block"), q.alias("from")))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: t != F.col("own"))
    asked = F.when(F.col("asker") >= 0, F.transform(others, lambda t: F.struct(t.alias("block"), F.col("asker").alias("from")))).otherwise(F.array())
    dealt = full.select("cell", "node", "root", "n", "point", "s", "cells", own.alias("own"), asker.alias("asker"), "blocks", "asking").select(
        "cell", "node", "root", "n", "point", "s", "cells", "own", "asker", F.inline(F.concat(stands, asked))
    )

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        vectors = [_vector(p, n) for p, n in zip(frame["point"], frame["n"])]
        groups = min(map(len, vectors))
        points = np.stack([folded(v, groups) for v in vectors])
        sets = [np.frombuffer(s, np.uint64) for s in frame["s"]]
        n, node, root, asker = (frame[c].to_numpy() for c in ("n", "node", "root", "asker"))
        asking = asker == key[2]
        inside = np.flatnonzero(frame["own"].to_numpy() == key[1])
        cells = frame["cells"].tolist()
        earlier: dict[int, np.ndarray] = {}

        def before(i: int) -> np.ndarray:
            """The cells of a row that are searched before this one; made for hits only."""
            if i not in earlier:
                own = np.asarray(cells[i], np.int64)
                earlier[i] = np.sort(own[own < key[0]])
            return earlier[i]

        def met_before(i: int, j: int) -> bool:
            a, b = sorted((before(i), before(j)), key=len)
            at = np.searchsorted(b, a)
            return bool(len(b)) and bool((b[np.minimum(at, len(b) - 1)] == a).any())

        met = {r: r for r in root.tolist()}

        def of(r: int) -> int:
            while met[r] != r:
                met[r] = met[met[r]]
                r = met[r]
            return r

        links = []
        if len(inside):
            tree = CountTree(points[inside], n[inside], root[inside])
            for q in np.flatnonzero(asking):
                hit = inside[tree.search(points[q], n[q])]
                hit = hit[4 * np.minimum(n[hit], n[q]) >= 3 * np.maximum(n[hit], n[q])]
                # Two asking members would meet twice: here, or in the group where the other asks.
                hit = hit[(asker[hit] < 0) | (node[hit] < node[q])]
                hit = np.array([h for h in hit.tolist() if of(int(root[h])) != of(int(root[q])) and not met_before(h, q)], np.int64)
                if len(hit):
                    linked = hit[may_link(overlaps(sets[q], [sets[h] for h in hit]), n[hit], n[q])]
                    for h in linked.tolist():
                        if of(int(root[h])) != of(int(root[q])):
                            met[of(int(root[h]))] = of(int(root[q]))
                            links.append((node[q], node[h]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("cell", "block", "from").applyInPandas(search, "a long, b long")


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every document."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # Four buckets a partition, so they follow the session's partitions; a bucket's number has 30 bits at most.
    bits = min(30, max(8, int(np.ceil(np.log2(parts * 4)))))
    frequent = stored(frequent_shingles(source, bits), "ngram-frequent")
    for salt in range(256):
        rows = cells(source, _told(frequent), bits, salt)
        named = rows.where((F.col("kind") == DOC) & (F.col("a") != NO_CLASS)).groupBy("a")
        if named.agg(F.min("owners").alias("low"), F.max("owners").alias("high")).where("low <> high").isEmpty():
            break
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    documents = rows.where(F.col("kind") == DOC).select(real, "text_hash", "a", "n")
    pairs = rows.where(F.col("kind") == PAIR).select("a", "b").distinct()
    members = rows.where(F.col("kind") == MEMBER).select("a", "b")
    points = rows.where(F.col("kind") == POINT).select("a", "n", "keys").dropDuplicates(["a"])
    with_class = documents.where(F.col("a") != NO_CLASS)
    near = stored(bounded(pairs, points), "ngram-bounded")
    wanted = near.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    edges = stored(verified(near, class_sets(source, wanted, with_class, salt)), "ngram-edges")
    labels = components(edges, "ngram-first")
    rest = stored(open_members(members, labels, points), "ngram-members")
    if not rest.isEmpty():
        sets = class_sets(source, rest.select(F.col("node").alias("a")).distinct(), with_class, salt)
        labels = components(edges.unionByName(cross_links(rest, points, sets)), "ngram-second")
    first = with_class.groupBy("a").agg(F.min("doc_id").alias("first"))
    named = first.join(labels.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = named.join(smallest, "root").select("a", "component_id")
    done = with_class.join(of_class, "a").select("doc_id", "text_hash", "n", "component_id")
    alone = documents.where(F.col("a") == NO_CLASS).select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"))
    return done.unionByName(alone).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component; all columns kept.

    Rows that go are sketched by text, so that most rows that stay never move.
    """
    rows = stored(linked(docs), "ngram-linked")
    same = rows.groupBy("doc_id", "text_hash", "component_id", "n_shingles").agg(F.count(F.lit(1)).alias("times"))
    going = same.where("n_shingles > 0 and (times > 1 or not doc_id <=> component_id)").select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")
    )
    going = stored(going, "ngram-going")
    body = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    marked = noted(packed(docs).withColumn("text_hash", body), "text_hash", sketch(going, "th"))
    again = marked.where("noted").join(going, (F.col("text_hash") == F.col("th")) & F.col("doc_id").cast("long").eqNullSafe(F.col("id")), "left")
    settled = again.where("stays is null").select("row")
    # Equal rows of one id: the first stays.
    repeated = again.where("stays").dropDuplicates(["id", "th"]).select("row")
    return unpacked(marked.where("not noted").select("row").unionByName(settled).unionByName(repeated), docs)


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
"""
