"""Merkle manifest of a dataset: checkpoint and recompute.

Rows become leaves; the leaves of a group, in order of a key, form a tree in which every
FAN consecutive nodes are hashed to one, and the groups' roots form a tree of the same shape above.  Only
every STEP-th level is written: a stored node stands for an aligned subtree of up to FAN ** STEP
nodes of the stored level below, and those are one row, in order.  Proofs are taken from
the top down: the levels between two stored ones are hashed again from a subtree's stored
descendants, their siblings go into the proofs of the nodes below, and they are forgotten.

Texts are read once, for the leaves.  Positions come from a range sort and the counts of its
partitions, so no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, let, stage, table

FAN, STEP = 16, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*map(field, values))


def _numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): rows in range order with ``_part`` and ``_no``; a row per part and group with its first ``_no`` and ``_ahead``, the group's rows in the parts before."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    # The number grows along a partition, whose number stands in its upper bits.
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_no", F.monotonically_increasing_id())
    rows = stage(ranged.withColumn("_part", F.shiftright("_no", 33)), label)
    parts = rows.groupBy("_part", *group).agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    ahead = Window.partitionBy(*group or [F.lit(0)]).orderBy("_part")  # a row per part of the range sort
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows, parts


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null is a value like any other."""
    whole = F.struct(F.lit(0), *keys)
    return left.withColumn("_k", whole).join(right.withColumn("_k", whole).drop(*keys), "_k").drop("_k")


def _runs(nodes: Column) -> Column:
    """The nodes of the next level."""
    firsts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(firsts, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def _level(n: Column, k: int) -> Column:
    """How many nodes a group of n has k levels higher."""
    return F.ceil(n / F.lit(FAN**k)).cast("long")


def _higher(nodes: Column, n: Column, k: int) -> Column:
    """A subtree's nodes k levels above its stored ones; levels above a group's root repeat it."""
    for up in range(k):
        nodes = F.when(_level(n, up) > 1, let(nodes, _runs)).otherwise(nodes)
    return nodes


def _subtrees(nodes: DataFrame, more: Sequence[str]) -> DataFrame:
    """(g, n, block, nodes): (g, n, pos, digest, more...) rows by aligned subtrees."""
    held = F.struct("pos", "digest", *more)
    grouped = nodes.groupBy("g", F.floor(F.col("pos") / FAN**STEP).cast("long").alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(held)).alias("nodes"))
    return grouped.select("g", "n", "block", "nodes")


def _stored_levels(nodes: DataFrame, largest: int, more: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """(stored levels from the lowest, (g, root) rows) of the trees of all groups."""
    levels, roots = [], None
    while True:
        level = stage(_subtrees(nodes, more), "merkle-level")
        levels.append(level)
        own = F.transform("nodes", lambda x: x.digest)
        tops = level.select("g", "n", F.col("block").alias("pos"), F.get(_higher(own, F.col("n"), STEP), F.lit(0)).alias("digest"))
        done = tops.filter(_level(F.col("n"), STEP) == 1).select("g", F.col("digest").alias("root"))
        roots = done if roots is None else roots.union(done)
        if largest <= FAN**STEP:
            return levels, stage(roots, "merkle-roots")
        nodes = tops.select("g", _level(F.col("n"), STEP).alias("n"), "pos", "digest").filter("n > 1")
        largest, more = -(-largest // FAN**STEP), ()


_SIDES = "array<struct<left:string,right:string>>"


def _sides(nodes: Column, at: Column) -> Column:
    """The digests left and right of the node at ``at`` in its run."""
    start = F.floor(at / FAN).cast("int") * FAN
    return F.struct(F.array_join(F.slice(nodes, start + 1, at - start), "").alias("left"), F.array_join(F.slice(nodes, at + 2, start + FAN - 1 - at), "").alias("right"))


def _paths(levels: list[DataFrame], above: DataFrame, more: Sequence[str], tags: Sequence[str] = ()) -> DataFrame:
    """(g, pos, digest, more..., tags..., path) of the lowest level; ``above``: (g, path, tags...) of the roots.

    A path has the siblings of each level from the node's own up to the root, as two strings.
    """
    tops = above.withColumn("pos", F.lit(0).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        held = [] if k else list(more)
        level, n = levels[k], F.col("n")
        # The top of a group's tree stands in its only subtree; the others' tops are nodes of the stored level above.
        joined = level.withColumnRenamed("block", "pos").join(tops, ["g", "pos"])
        own = joined.withColumn("d0", F.transform("nodes", lambda x: x.digest))
        for up in range(1, STEP):
            own = own.withColumn(f"d{up}", F.when(_level(n, up - 1) > 1, let(F.col(f"d{up - 1}"), _runs)))
        # A run's nodes share what lies above it, so that is made once a run.
        runs = F.sequence(F.lit(0), F.floor((F.size("nodes") - 1) / FAN).cast("int"))
        run = own.withColumn("run", F.explode(runs))
        higher = [F.when(_level(n, up) > 1, F.array(_sides(F.col(f"d{up}"), F.floor(F.col("run") / FAN ** (up - 1)).cast("int")))).otherwise(F.array().cast(_SIDES)) for up in range(1, STEP)]
        run = run.select("g", "n", F.slice("nodes", F.col("run") * FAN + 1, F.lit(FAN)).alias("nodes"), F.concat(*higher, "path").alias("path"), *tags)
        node = run.select("g", "n", "path", *tags, F.transform("nodes", lambda x: x.digest).alias("d"), F.posexplode("nodes").alias("i", "x"))
        lowest = F.when(F.col("n") > 1, F.array(_sides(F.col("d"), F.col("i")))).otherwise(F.array().cast(_SIDES))
        tops = node.select("g", "x.pos", "x.digest", *[f"x.{c}" for c in held], *tags, F.concat(lowest, "path").alias("path"))
        if k:
            done = above.join(_done_at(levels, k), "g").select("g", F.lit(0).cast("long"), "path", *tags)
            tops = stage(tops.select("g", "pos", "path", *tags).union(done), "merkle-paths")
    return tops


def _done_at(levels: list[DataFrame], k: int) -> DataFrame:
    """(g) of the groups whose root is the top of level k - 1."""
    return levels[k - 1].filter(_level(F.col("n"), STEP) == 1).select("g").distinct()


@dataclass
class Manifest:
    """``groups``: (the group column, g, subroot); ``root``: one row, none for an empty table; levels: what is stored."""

    groups: DataFrame
    root: DataFrame
    levels: list[DataFrame]
    top_levels: list[DataFrame]
    group: str
    key: str
    more: tuple[str, ...]


def build_manifest(leaves: DataFrame, group: str, key: str) -> Manifest:
    """The tree over ``leaves`` (group, key, leaf and further columns, which stay with their leaf).

    Leaves of a group ascend by key, null first, then by leaf, so rows that repeat a key have a defined place;
    groups ascend bytewise, null first.  An empty table has no root.
    """
    more = tuple(c for c in leaves.columns if c not in (group, key, "leaf"))
    named = leaves.select(F.col(group).alias("_group"), F.col(key).alias("_key"), "leaf", *more)
    read = stage(named, "merkle-leaves")
    rows, parts = _numbered(read, ["_group"], ["_key", "leaf"], "merkle-order")
    discard(read)
    sizes = parts.groupBy("_group").agg(F.sum("_rows").alias("n"))
    ordered, group_parts = _numbered(sizes, [], ["_group"], "merkle-groups")
    placed = ordered.join(group_parts, "_part").select("_group", "n", (F.col("_ahead") + F.col("_no") - F.col("_first")).alias("g"))
    placed = stage(placed, "merkle-groups", drop=[ordered])
    largest, groups = placed.agg(F.max("n"), F.count(F.lit(1))).first()
    heads = _on(parts, placed, ["_group"]).select("_group", "_part", "g", "n", (F.col("_ahead") - F.col("_first")).alias("_move"))
    own = _on(rows, heads, ["_group", "_part"])
    held = ("key", *more)
    nodes = own.select("g", "n", (F.col("_no") + F.col("_move")).alias("pos"), F.col("leaf").alias("digest"), F.col("_key").alias("key"), *more)
    levels, roots = _stored_levels(nodes, largest or 1, held)
    discard(rows)
    tops = roots.select(F.lit(0).cast("long").alias("g"), F.lit(groups).cast("long").alias("n"), F.col("g").alias("pos"), F.col("root").alias("digest"))
    top_levels, root = _stored_levels(tops, groups or 1, ())
    return Manifest(placed.join(roots, "g").select(F.col("_group").alias(group), "g", F.col("root").alias("subroot")), root.select("root"), levels, top_levels, group, key, held)


def proofs(manifest: Manifest) -> DataFrame:
    """(group, key, leaf, further columns, subroot, path) of every leaf; path: siblings left and right per level, from the leaf's up to the root's."""
    empty = manifest.root.select(F.lit(0).cast("long").alias("g"), F.array().cast(_SIDES).alias("path"))
    above = _paths(manifest.top_levels, empty, ())
    # The group and its root come down with the paths of subtrees, so no leaf is joined to its group.
    roots = above.select(F.col("pos").alias("g"), "path").join(manifest.groups.withColumnRenamed(manifest.group, "_group"), "g")
    found = _paths(manifest.levels, roots, manifest.more, ("_group", "subroot"))
    return found.select(F.col("_group").alias(manifest.group), F.col("key").alias(manifest.key), F.col("digest").alias("leaf"), *manifest.more[1:], "subroot", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x.left, node, x.right), 256))


def lowered(text: Column) -> Column:
    """A-Z in lower case; texts without other letters take the faster way."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", fields(F.col("text")).alias("leaf"), F.when(altered, fields(lowered(F.col("text")))).alias("tampered"))
    manifest = build_manifest(leaves, "source", "doc_id")
    found = proofs(manifest).join(F.broadcast(manifest.root), F.lit(True))  # one row
    folded = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x.left, x.right)), "")
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(t: str, given: str, levels: int) -> str:
    """CTEs of one tree per g: t0, t1, ... (g, n, pos, digest, l, r) with the digests left and right in a node's run, and the roots tr.  Levels above a root have no rows."""
    sides = f"coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
    over = f"WINDOW w AS (PARTITION BY g, pos // {FAN} ORDER BY pos)"
    each = [f"{t}0 AS (SELECT *, {sides} FROM ({given}) {over})"]
    for k in range(1, levels):
        up = f"SELECT g, (n + {FAN - 1}) // {FAN} AS n, pos // {FAN} AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {t}{k - 1} WHERE n > 1 GROUP BY g, n, pos // {FAN}"
        each.append(f"{t}{k} AS (SELECT *, {sides} FROM ({up}) {over})")
    roots = " UNION ALL ".join(f"SELECT g, digest AS root FROM {t}{k} WHERE n = 1" for k in range(levels))
    return ",\n".join([*each, f"{t}r AS ({roots})"])


def _folds_sql(t: str, p: str, given: str, group: str, pos: str, levels: int) -> str:
    """CTEs p0, p1, ...: rows with the digest folded (f) and the siblings (sib) so far, up one tree."""
    each = [f"{p}0 AS ({given})"]
    for k in range(levels):
        each.append(
            f"{p}{k + 1} AS (SELECT c.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || f || s.r) ELSE f END AS f, CASE WHEN s.n > 1 THEN sib || s.l || s.r ELSE sib END AS sib)"
            f" FROM {p}{k} c LEFT JOIN {t}{k} s ON s.g = {group} AND s.pos = {pos} // {FAN**k})"
        )
    return ",\n".join(each)


def _leaf_sql(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


_LOW = f"translate(text, '{UPPER}', '{LOWER}')"
_SHIFT = "list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))), lambda c, x: {_SHIFT}))"
_GROUPED = "SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest FROM leaf JOIN grp ON leaf.source IS NOT DISTINCT FROM grp.source"
_TOPS = "SELECT 0 AS g, count(*) OVER () AS n, g AS pos, root AS digest FROM ar"
_START = "SELECT doc_id, leaf, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, t AS f, '' AS sib FROM leaf JOIN grp ON leaf.source IS NOT DISTINCT FROM grp.source"

QUERIES = {"op11_merkle": op11_merkle}
ORACLES = {
    "op11_merkle": f"""
WITH leaf AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql(_LOW)} ELSE {_leaf_sql('text')} END AS t FROM documents),
grp AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) AS n FROM leaf GROUP BY source),
{_tree_sql('a', _GROUPED, 8)},
{_tree_sql('b', _TOPS, 6)},
{_folds_sql('a', 'p', _START, 'c.g', 'c.pos', 8)},
{_folds_sql('b', 'q', 'SELECT * FROM p8', '0', 'c.g', 6)}
SELECT doc_id, leaf, ar.root AS subroot, br.root AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = br.root AS verified
FROM q6 JOIN ar ON ar.g = q6.g CROSS JOIN br"""
}
