"""A Merkle manifest of a dataset: one tree per language, one over their roots, a proof for every row.

A leaf is the SHA-256 of the row's fields; every ``FANOUT`` consecutive nodes become the SHA-256 of
their hexadecimal digests.  Rows are numbered by range partitions and their counts, and cut into
blocks of ``FANOUT ** LEVELS`` consecutive leaves, which hash their own subtrees.

Above the blocks runs a butterfly exchange.  In round r, blocks whose numbers differ in digit r
only (to the base ``FANOUT``) form a group of at most ``FANOUT``; they swap the roots of the subtrees
they stand in, and every one of them hashes the parent.  After the last round each block holds the root and
all it needs of the upper proofs: nothing travels down again.  At the ragged end of a level, where
a subtree has fewer blocks than its neighbours, its blocks also serve the groups in which it has no block.
A round moves one short row per block.  The roots of the trees are numbered, cut and exchanged in
the same way.

A proof is kept as steps from the leaf up, each with the digests before and after the node in its run.

Defined results: null fields hash as ``-``; a null language has a tree of its own, the first; a null
id stands before all others and is not tampered with; rows of one id and language are ordered by
their leaf; repeated rows are leaves of their own; an empty table gives an empty table; other columns
of any name play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import computed_once, stored

FANOUT, LEVELS = 8, 4
#: Blocks of one tree that share a copy of its upper proof.
SPREAD = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A length-prefixed field, so that no two rows hash the same bytes."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, item): a row's leaf, and the leaf of its tampered text where it is tampered with.

    The tree's name orders trees as asked: null first, then by the bytes of the language.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.struct(
            F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("digest"),
            F.when(tampered, leaf_of(F.translate("text", _UPPER, _LOWER))).alias("changed"),
        ).alias("item"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` (from 0, within the tree by ``order``) and ``total`` (items of the tree).

    Ranges of (tree, order) are numbered each for itself; a range's offset is the sum of the counts
    before it, one row per range and tree.
    """
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.withColumn("nth", F.monotonically_increasing_id()), "merkle-ranges").withColumn("part", F.shiftright("nth", 33))
    parts = ranged.groupBy("tree", "part").agg(F.min("nth").alias("low"), F.count(F.lit(1)).alias("n"))
    tree = W.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("tree", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(tree).alias("total"))
    return ranged.join(parts, ["tree", "part"]).withColumn("place", F.col("nth") - F.col("low") + F.col("first")).drop("nth", "part", "low", "first")


def _joined(digests: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(digests, start, length), "")


def _parents(digests: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(_joined(digests, i * FANOUT + 1, F.lit(FANOUT)), 256))


def blocks(rows: DataFrame, fanout_levels: int = LEVELS) -> DataFrame:
    """(tree, block, blocks, items, levels, digest): aligned runs of leaves with their subtree.

    ``levels`` holds the digests of each level in which runs are hashed, leaves first.
    """
    width = FANOUT**fanout_levels
    cut = rows.withColumns({"block": F.floor(F.col("place") / width), "blocks": F.ceil(F.col("total") / width)})
    made = cut.groupBy("tree", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("items"))
    made = made.withColumn("items", F.transform("items", lambda x: x["item"]))
    made = computed_once(made, "level0", F.transform("items", lambda x: x["digest"]))
    levels, top = [], F.element_at("level0", 1)
    for k in range(fanout_levels):
        # A block among others is hashed up to its height, one alone only to its root.
        goes_on = (F.col("blocks") > 1) | (F.size(f"level{k}") > 1)
        made = computed_once(made, f"level{k + 1}", F.when(goes_on, _parents(F.col(f"level{k}"))).otherwise(F.slice(f"level{k}", 1, 1)))
        levels.append(F.when(goes_on, F.col(f"level{k}")))
        top = F.element_at(f"level{k + 1}", 1)
    return made.select("tree", "block", "blocks", "items", F.filter(F.array(*levels), lambda x: x.isNotNull()).alias("levels"), top.alias("digest"))


def _step(digests: Column, place: Column) -> Column:
    """What stands before and after a node in its run."""
    inside = place % FANOUT
    start = place - inside + 1
    return F.struct(_joined(digests, start, inside).alias("before"), _joined(digests, place + 2, FANOUT - 1 - inside).alias("after"))


def exchanged(nodes: DataFrame, rounds: int) -> DataFrame:
    """Butterfly over (tree, block, blocks, digest): adds ``steps``; ``digest`` becomes the tree's root in every block."""
    state = nodes.withColumn("steps", F.expr("cast(array() as array<struct<before: string, after: string>>)"))
    for r in range(rounds):
        span = FANOUT**r  # blocks below one node of this level
        subtree, low = F.floor(F.col("block") / span), F.pmod("block", F.lit(span))
        held = F.least(F.lit(span), F.col("blocks") - F.col("subtree") * span)  # blocks of this subtree
        sent = state.withColumns({"subtree": subtree, "low": low}).withColumn(
            "to", F.when(F.col("blocks") <= span, F.array("low")).otherwise(F.sequence("low", F.lit(span - 1).cast("long"), held))
        )
        sent = sent.withColumn("to", F.explode("to"))
        own = F.when(F.col("to") == F.col("low"), F.struct("block", "steps"))
        group = sent.groupBy("tree", "blocks", F.floor(F.col("subtree") / FANOUT).alias("group"), "to").agg(
            F.sort_array(F.collect_list(F.struct("subtree", "digest", own.alias("own")))).alias("members")
        )
        digests = F.transform("members", lambda m: m["digest"])
        done = F.col("blocks") <= span
        group = computed_once(group, "digests", digests)
        group = computed_once(group, "parent", F.when(done, F.col("digests")[0]).otherwise(F.sha2(F.array_join("digests", ""), 256)))
        each = group.select("tree", "blocks", "digests", "parent", F.posexplode("members").alias("at", "m")).where("m.own is not null")
        state = each.select(
            "tree", F.col("m.own.block").alias("block"), "blocks", F.col("parent").alias("digest"),
            F.when(F.col("blocks") <= span, F.col("m.own.steps")).otherwise(F.concat("m.own.steps", F.array(_step(F.col("digests"), F.col("at"))))).alias("steps"),
        )
    return state


def _rounds(made: DataFrame) -> int:
    most, rounds = made.agg(F.max("blocks").alias("n")).head()["n"] or 1, 0
    while FANOUT**rounds < most:
        rounds += 1
    return rounds


def _siblings(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def _folded(leaf: Column, steps: Column) -> Column:
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def _proved(made: DataFrame, upper: DataFrame, key: list[str]) -> DataFrame:
    """(the columns of ``upper``, item, steps) of every item: its steps inside the block, then those above."""
    joined = made.select("tree", "block", "items", "levels").join(upper, key)
    inner = F.transform(
        "items",
        lambda item, i: F.struct(
            item.alias("item"),
            F.transform("levels", lambda level, k: _step(level, F.floor(i / F.pow(F.lit(FANOUT), k)).cast("int"))).alias("inner"),
        ),
    )
    return computed_once(joined.drop("block"), "proofs", inner).drop("items", "levels")


def manifest(docs: DataFrame, fanout_levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    made = stored(blocks(numbered(leaves(docs), ["item"]), fanout_levels), "merkle-blocks")
    state = stored(exchanged(made.select("tree", "block", "blocks", "digest"), _rounds(made)), "merkle-exchange")

    # The roots of the trees are the leaves of one more tree.
    roots = state.where("block = 0").select(F.lit("").alias("tree"), F.struct(F.col("tree").alias("name"), F.col("digest")).alias("item"), "blocks")
    top = stored(blocks(numbered(roots.withColumnRenamed("blocks", "below"), ["item"]).drop("below"), fanout_levels), "merkle-roots")
    above = exchanged(top.select("tree", "block", "blocks", "digest"), _rounds(top))
    proofs = _proved(top, above.select("tree", "block", F.col("digest").alias("root"), F.col("steps").alias("above")), ["tree", "block"])
    proofs = proofs.select("root", "above", F.explode("proofs").alias("p")).select(
        F.col("p.item.name").alias("tree"), "root", F.concat("p.inner", "above").alias("top_steps")
    )
    sizes = roots.select(F.col("item.name").alias("tree"), "blocks")
    copies = proofs.join(sizes, "tree").select("tree", "root", "top_steps", F.explode(F.expr(f"sequence(0, (blocks - 1) div {SPREAD})")).alias("copy"))

    upper = state.withColumn("copy", F.expr(f"block div {SPREAD}")).join(copies, ["tree", "copy"]).select(
        "tree", "block", F.col("digest").alias("subroot"), "root", F.concat("steps", "top_steps").alias("above")
    )
    rows = _proved(made, upper, ["tree", "block"])
    return rows.select("subroot", "root", F.inline(F.transform("proofs", lambda p: _result(p, F.col("above"))))).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _result(p: Column, above: Column) -> Column:
    item = p["item"]
    steps = F.concat(p["inner"], above)
    return F.struct(
        item["doc_id"].alias("doc_id"), item["digest"].alias("leaf"),
        F.sha2(F.concat(_siblings(p["inner"]), _siblings(above)), 256).alias("proof_sha256"),
        _folded(F.coalesce(item["changed"], item["digest"]), steps).alias("folded_root"),
    )


def _oracle(levels: int) -> str:
    """SQL for ``manifest``: a node's level after level, up to FANOUT ** levels leaves a tree."""
    crc = (
        "list_reduce(list_prepend(4294967295, list_transform(range(1, length(d) + 1), lambda i: ascii(substr(d, i, 1))::BIGINT)), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
    )

    def digest(text: str) -> str:
        part = lambda c: f"COALESCE(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"

    def climb(name: str, leaves: str) -> list[str]:
        """Levels name0, name1, ... of (tree, pos, digest, n) and steps of (tree, pos, level, before, after)."""
        made = [f"{name}0 AS ({leaves})"]
        for k in range(1, levels + 1):
            made.append(
                f"{name}{k} AS (SELECT tree, pos // {FANOUT} AS pos, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest, "
                f"(any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{k - 1} GROUP BY tree, pos // {FANOUT})"
            )
        return made

    def steps(name: str, k: int) -> str:
        low = f"a.pos // {FANOUT**k}"
        return (
            f"SELECT a.tree, a.pos, {k} AS level, COALESCE(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < {low}), '') AS before, "
            f"COALESCE(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > {low}), '') AS after FROM {name}0 a JOIN {name}{k} b "
            f"ON a.tree = b.tree AND {low} // {FANOUT} = b.pos // {FANOUT} WHERE b.n > 1 GROUP BY a.tree, a.pos"
        )

    def path(name: str) -> str:
        return f"{name}p AS (SELECT tree, pos, list([before, after] ORDER BY level) AS steps FROM ({' UNION ALL '.join(steps(name, k) for k in range(levels))}) GROUP BY tree, pos)"

    folded = "list_reduce(list_prepend([x, ''], {steps}), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1]"
    parts = [
        f"d AS (SELECT *, doc_id::VARCHAR AS d, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {digest('text')} AS leaf FROM documents)",
        f"t AS (SELECT *, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {digest(lower)} ELSE leaf END AS x FROM d)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM t)",
        *climb("l", "SELECT tree, pos, leaf AS digest, n FROM r"),
        path("l"),
        f"s AS (SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM l{levels})",
        *climb("u", "SELECT '' AS tree, pos, digest, n FROM s"),
        path("u"),
        "j AS (SELECT r.doc_id, r.leaf, r.x, s.digest AS subroot, list_concat(COALESCE(lp.steps, []), COALESCE(up.steps, [])) AS steps FROM r JOIN s ON s.name = r.tree "
        "LEFT JOIN lp ON lp.tree = r.tree AND lp.pos = r.pos LEFT JOIN up ON up.pos = s.pos)",
        f"f AS (SELECT *, {folded.format(steps='steps')} AS folded_root, (SELECT digest FROM u{levels}) AS root, "
        "sha256(COALESCE(array_to_string(list_transform(steps, lambda s: s[1] || s[2]), ''), '')) AS proof_sha256 FROM j)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"


#: Six levels: trees of up to 262,144 leaves.
ORACLE = _oracle(6)
