"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors of a label are one class.  Classes are brought to length 1 and turned into
their principal components, largest first.  Per label and length they are put into cells
of the first two components, as wide as two vectors at the threshold can be apart, sorted
by the third and cut into tiles.  Tiles of the same and of adjacent cells are compared
if the boxes of their leading components can hold vectors as near as the threshold
asks.  Within a pair of tiles the products of the leading dimensions are summed first;
by Cauchy-Schwarz the rest of a product is at most the product of the two suffix
norms, so comparing stops, for whole rows and columns, as soon as no cosine can reach the
threshold.  What survives is confirmed on the original vectors in double precision.

A pair of tiles gives each class's number of linked vectors and a spanning forest of the
links, never the links themselves, so groups of copies cost no more rows than others.
Tiles hold the vectors as they came; a task turns them again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stage, table
from .components import connected_components

THRESHOLD = 0.98
#: Classes of a tile.
TILE = 1024
#: Leading dimensions after which a comparison may stop.
STEPS = (4, 12, 32)
#: Components whose ranges decide whether two tiles are compared at all.
BOX = 4
SLACK = 1e-9
#: Vectors of a length from which its axes are fitted; fewer are compared as they are, which gives the same links.
MIN_FIT = 256
#: Matrices of moments are summed by so many tasks before the last one.
SUMMERS = 8


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, with the largest component in [0.5, 1): cosines stay the same, squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def good(v: Column) -> Column:
    """Whether a vector isn't null, empty or zero and holds finite numbers only."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def by_length(b: pa.RecordBatch, column: int):
    """(length, rows of that length) of a batch."""
    lengths = b.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        yield dim, b.take(pa.array(np.flatnonzero(lengths == dim)))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By length, where there are MIN_FIT vectors: eigenvectors of the second moments of the unit vectors, largest first.

    A task sums one matrix per length; SUMMERS tasks and then one add them up as they come.
    """
    lengths = {r[0] for r in vectors.groupBy(F.size("v")).count().filter(F.col("count") >= MIN_FIT).collect()}  # lengths, not vectors

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in by_length(b, 0):
                if dim in lengths:
                    x = unit(matrix(part.column(0), dim))
                    total[dim] = total.get(dim, 0) + x.T @ x
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["dim", "m"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[dim] = total.get(dim, 0) + np.frombuffer(m).reshape(dim, dim)
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["dim", "m"])

    kind = "dim int, m binary"
    summed = vectors.mapInArrow(moments, kind).repartition(SUMMERS).mapInArrow(add, kind).coalesce(1).mapInArrow(add, kind)
    return {r.dim: np.linalg.eigh(np.frombuffer(r.m).reshape(r.dim, r.dim))[1][:, ::-1].copy() for r in summed.collect()}


def tile_links(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of links between two tiles (i < j within one): a, b in rotated unit form, ua, ub scaled originals."""
    rows, cols = np.arange(len(a)), np.arange(len(b))
    product = np.zeros((len(a), len(b)))
    at = 0
    for upto in [*[s for s in STEPS if s < a.shape[1]], a.shape[1]]:
        product += a[rows, at:upto] @ b[cols, at:upto].T
        rest = np.linalg.norm(a[rows, upto:], axis=1)[:, None] * np.linalg.norm(b[cols, upto:], axis=1)[None, :]
        may = product + rest >= threshold - SLACK
        keep_r, keep_c = may.any(axis=1), may.any(axis=0)
        rows, cols, product, may = rows[keep_r], cols[keep_c], product[np.ix_(keep_r, keep_c)], may[np.ix_(keep_r, keep_c)]
        if not len(rows):
            break
        at = upto
    i, j = np.nonzero(may) if len(rows) else (np.empty(0, int), np.empty(0, int))
    i, j = rows[i], cols[j]
    if same:
        i, j = i[i < j], j[i < j]
    links = []
    for k in range(0, len(i), 1 << 15):
        x, y = ua[i[k : k + (1 << 15)]], ub[j[k : k + (1 << 15)]]
        cosine = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        links.append(cosine >= threshold)
    ok = np.concatenate(links) if links else np.empty(0, bool)
    return i[ok], j[ok]


def forest(pairs_a: np.ndarray, pairs_b: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of the components of the pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(pairs_a.tolist(), pairs_b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in parent if root(x) != x]


def embedding_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``df``; vec_id is an integer.

    Vectors that are null, zero or hold null or non-finite numbers, and rows without a
    label, link with nothing.  Vectors of different length don't link.  Very small and very large
    components neither vanish nor overflow.  Rows that
    repeat a vec_id are vectors of their own; they share a component.  A null vec_id is
    counted by its partners, and its component_id is the smallest id it reaches, or null; then it is kept.
    An empty table gives an empty result; other columns aren't used.
    """
    held = getattr(df.schema[vector].dataType, "elementType", None)
    kind = "array<float>" if isinstance(held, T.FloatType) else "array<double>"
    # Equal vectors of a label have equal keys; a null label and a bad vector have none.
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "label", "v")), 16, "0")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("key", F.when(F.col("label").isNotNull() & good(F.col("v")), F.unhex(F.concat(half(1), half(2)))))
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("k"))
    classes = stage(classes, "classes")
    axes = df.sparkSession.sparkContext.broadcast(principal_axes(classes.select("v")))
    tiles = stage(_tiles(classes, axes, threshold), "tiles", drop=[classes])
    compared = stage(_compare(tiles, axes, threshold), "tile-links")

    counts = compared.select(F.explode("counts").alias("c")).select("c.uid", "c.n").groupBy("uid").agg(F.sum("n").alias("n"))
    edges = compared.select(F.explode("links").alias("e")).select("e.a", "e.b")
    placed = tiles.select(F.posexplode(F.arrays_zip("keys", "ks")).alias("pos", "c"), "tile").select((F.col("tile") * TILE + F.col("pos")).alias("uid"), F.col("c.keys").alias("key"), F.col("c.ks").alias("k"))
    placed = placed.join(counts, "uid", "left").select("uid", "key", (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n_links"))
    vectors = stage(rows.filter("key IS NOT NULL").select("vec_id", "key").join(placed, "key").select("vec_id", "uid", "n_links"), "vectors", drop=[tiles])
    # Rows that repeat a vec_id meet in one component through their smallest class.
    first = vectors.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("uid").alias("b"), F.max("uid").alias("last")).filter("b < last")
    repeated = vectors.join(first, "vec_id").select(F.col("uid").alias("a"), "b").filter("a <> b")
    parts = connected_components(edges.union(repeated))
    discard(compared)
    vectors = vectors.join(parts.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    smallest = vectors.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = vectors.join(smallest, "component").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # An id may also stand in rows that link with nothing; then all its rows share one component.
    same = linked.groupBy("vec_id").agg(F.min("component_id").alias("c"))
    alone = alone.join(same.filter("vec_id IS NOT NULL"), "vec_id", "left").select("vec_id", "n_links", F.coalesce("c", "component_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _turned(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    return unit(x) if axes is None else unit(x) @ axes


def _tiles(classes: DataFrame, axes, threshold: float) -> DataFrame:
    """Tiles of up to TILE classes of one label, length and cell, sorted by the third component."""
    label_kind = classes.schema["label"].dataType.simpleString()
    held = "<f4" if isinstance(classes.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    width = _cell_width(threshold)

    def cells(batches):
        for b in batches:
            for dim, part in by_length(b, 1):
                x = matrix(part.column(1), dim)
                own = axes.value.get(dim)
                r = np.zeros((len(x), BOX))
                r[:, : min(dim, BOX)] = _turned(x, None if own is None else own[:, :BOX])[:, :BOX]
                cell = np.floor(r[:, :2] / width).astype(np.int32)
                binary = [pa.array([y.tobytes() for y in z], pa.binary()) for z in (r, x.astype(held))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array([dim] * len(x), pa.int32()), pa.array(cell[:, 0]), pa.array(cell[:, 1]), pa.array(r[:, 2]), *binary],
                    ["key", "label", "k", "dim", "c0", "c1", "third", "r", "v"],
                )

    def cut(batches):
        part = TaskContext.get().partitionId()
        if part >= 1 << 21:
            raise ValueError("tile numbers hold 2,097,152 partitions")
        tile = part << 32
        group: list[tuple] = []

        def out():
            nonlocal tile
            r = np.stack([np.frombuffer(h[7]) for h in group])
            values = [tile, *group[0][1:2], *group[0][3:6], r.min(0), r.max(0), [h[0] for h in group], [h[2] for h in group], b"".join(h[8] for h in group)]
            kinds = [pa.int64(), kind, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
            tile += 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["tile", "label", "dim", "c0", "c1", "lo", "hi", "keys", "ks", "v"])

        for b in batches:
            kind = b.column(1).type
            for row in zip(*[b.column(k).to_pylist() for k in range(9)]):
                if group and (group[-1][1] != row[1] or group[-1][3:6] != row[3:6] or len(group) == TILE):
                    yield out()
                    group = []
                group.append(row)
        if group:
            yield out()

    celled = classes.select("key", "v", "label", "k").mapInArrow(cells, f"key binary, label {label_kind}, k long, dim int, c0 int, c1 int, third double, r binary, v binary")
    order = ["label", "dim", "c0", "c1", "third", "key"]  # a large label or cell is spread over many tasks
    return celled.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        cut, f"tile long, label {label_kind}, dim int, c0 int, c1 int, lo array<double>, hi array<double>, keys array<binary>, ks array<long>, v binary"
    )


def _cell_width(threshold: float) -> float:
    """|x - y|^2 = 2 - 2 cos for unit vectors, so linked ones are no further apart than this in any component."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold) + 4 * SLACK))


def _compare(tiles: DataFrame, axes, threshold: float) -> DataFrame:
    """(counts, links) of every pair of tiles of the same or adjacent cells whose boxes are near enough."""
    gap = lambda k: F.greatest(F.lit(0.0), F.get("a.lo", F.lit(k)) - F.get("b.hi", F.lit(k)), F.get("b.lo", F.lit(k)) - F.get("a.hi", F.lit(k)))
    apart = sum((gap(k) * gap(k) for k in range(1, BOX)), gap(0) * gap(0))
    bare = tiles.select("tile", "label", "dim", "c0", "c1", "lo", "hi")
    near = F.array(*[F.struct((F.col("c0") + x).alias("c0"), (F.col("c1") + y).alias("c1")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    around = bare.withColumn("c", F.explode(near)).select("tile", "label", "dim", "lo", "hi", "c.c0", "c.c1")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("label", "dim", "c0", "c1")]
    pairs = around.alias("a").join(bare.alias("b"), [*same, F.col("a.tile") <= F.col("b.tile"), apart <= _cell_width(threshold) ** 2])
    pairs = pairs.select(F.col("a.tile").alias("ta"), F.col("b.tile").alias("tb"))
    side = lambda k, *more: tiles.select(F.col("tile").alias(f"t{k}"), F.col("v").alias(f"v{k}"), F.col("ks").alias(f"k{k}"), *more)
    joined = pairs.join(side("b"), "tb").join(side("a", "dim"), "ta").select("ta", "tb", "dim", "va", "vb", "ka", "kb")

    def run(batches):
        last = (None, None)
        for b in batches:
            for n in range(b.num_rows):
                ta, tb, dim, va, vb, ka, kb = (b.column(i)[n].as_py() for i in range(7))
                own = axes.value.get(dim)

                def opened(raw, ks):
                    x = scaled(np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * len(ks) else "<f8").astype(np.float64).reshape(-1, dim))
                    return x, _turned(x, own)

                if last[0] != ta:  # pairs of a tile follow each other
                    last = ta, opened(va, ka)
                ua, ra = last[1]
                ub, rb = (ua, ra) if ta == tb else opened(vb, kb)
                i, j = tile_links(ra, rb, ua, ub, threshold, ta == tb)
                ka, kb = np.array(ka, np.int64), np.array(kb, np.int64)
                uid, at = np.unique(np.concatenate([ta * TILE + i, tb * TILE + j]), return_inverse=True)
                n_links = np.zeros(len(uid), np.int64)
                np.add.at(n_links, at, np.concatenate([kb[j], ka[i]]))
                counts = [{"uid": int(u), "n": int(c)} for u, c in zip(uid, n_links)]
                links = [{"a": u, "b": r} for u, r in forest(ta * TILE + i, tb * TILE + j)]
                kinds = [pa.list_(pa.struct([("uid", pa.int64()), ("n", pa.int64())])), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array([counts], kinds[0]), pa.array([links], kinds[1])], ["counts", "links"])

    return joined.mapInArrow(run, "counts array<struct<uid:long,n:long>>, links array<struct<a:long,b:long>>")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLES = {
    "op4_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {THRESHOLD}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM good UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
part AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, v.vec_id) AS component_id,
       v.vec_id = coalesce(component_id, v.vec_id) AS kept
FROM v LEFT JOIN part USING (vec_id) LEFT JOIN n USING (vec_id)"""
}
