"""MinHash near-dedup with fast similarity sketches.

A document is the set of its distinct word shingles (64-bit hashes).  Its sketch has
BINS coordinates.  In round i every shingle is thrown by a hash into a bin with the
value i + (hash in [0, 1)), each bin keeps its smallest value, and rounds go on until
every bin is filled; from round BINS on, round i fills bin i - BINS from all shingles, so
that at most 2 * BINS rounds do.  A large set needs one or two rounds, and the share of
equal coordinates is as concentrated around the similarity as with BINS independent
samples.

Documents with equal sets are one class.  Classes that agree in a whole band of
coordinates share a bucket.  Texts with so many shingles of their own that they can't
reach the threshold drop out.  Each of the others is compared with two heads of its
bucket, the member with the fewest shingles of its own and a random one; buckets whose
members are then in one component are done.  Members of the rest are paired across
components by their rarest shingles: two sets that reach the threshold have their first
common shingle, in an order from rare to frequent, so early in both that the shingles
after it can still make up the intersection.  That is exact, so no link between
components is lost, and drifted copies of one text, whose rare shingles are their own
edits, meet hardly anyone.  No pair of one component is listed.  All pairs are confirmed
on their full sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, stage, table
from .components import connected_components

WIDTH, PERCENT = 5, 80
BANDS, ROWS = 52, 6
BINS = BANDS * ROWS
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SEEDS = np.array([xxhash.xxh64_intdigest(str(i)) for i in range(2 * BINS)], np.uint64)
#: Texts that are hashed together: at most so many, and up to so many bytes (a longer text is alone).
BATCH, BATCH_BYTES = 512, 1 << 20
#: Bytes whose words are hashed in one step.
STEP_BYTES = 1 << 19
_SEPARATES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint64)
EMPTY = np.iinfo(np.uint64).max


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of ``x`` over the word."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of UTF-8 bytes; A-Z count as a-z.  A hash is a sum over (place in the word, byte)."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + STEP_BYTES)
        while end < len(raw) and not _SEPARATES[raw[end]]:
            end += 1
        part = raw[at:end]
        inside = np.flatnonzero(~_SEPARATES[part])
        if len(inside):
            first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
            start = inside[first]
            place = inside - np.repeat(start, np.diff(first, append=len(inside)))
            each = mix((_LOWER[part[inside]] + np.uint64(1)) ^ (place.astype(np.uint64) + np.uint64(1)) * _MIX2)
            hashes.append(mix(np.add.reduceat(each, first)))
            starts.append(start + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes of its shingles."""
    coded = [(t or "").encode(errors="surrogatepass") for t in texts]
    h, start = word_hashes(np.frombuffer(b"\n".join(coded), np.uint8))
    ends = np.searchsorted(start, np.cumsum([len(c) + 1 for c in coded]))
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled + h[k : k + len(rolled)] + np.uint64(k))
    out, at = [], 0
    for end in ends.tolist():
        if end - at >= width:
            out.append(np.unique(rolled[at : end - width + 1]))
        elif end > at:
            out.append(mix(np.array([xxhash.xxh64_intdigest(h[at:end].tobytes(), end - at)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


def batches_of(texts: list[str | None]):
    """Slices of ``texts`` within BATCH and BATCH_BYTES."""
    at = size = 0
    for i, t in enumerate(texts):
        more = len(t or "")
        if i > at and (i - at == BATCH or size + more > BATCH_BYTES):
            yield slice(at, i)
            at, size = i, 0
        size += more
    if at < len(texts):
        yield slice(at, len(texts))


def sliced(batches):
    """(BATCH rows, the texts in their second column): a batch's texts aren't all held as Python strings at once."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            yield part, part.column(1).to_pylist()


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values per set: the round above 32 bits of hash; EMPTY for an empty set."""
    out = np.full((len(sets), BINS), EMPTY, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    done = 0
    while len(h) and done < 2 * BINS:
        # Rounds beyond the last needed one change nothing, so several go at once.
        rounds = np.arange(done, done + max(1, min(2 * BINS - done, (1 << 15) // len(h))))
        x = mix(h[None, :] ^ _SEEDS[rounds][:, None])
        bins = (x >> np.uint64(32)) % np.uint64(BINS)
        late = rounds >= BINS
        bins[late] = (rounds[late] - BINS).astype(np.uint64)[:, None]
        x = (rounds.astype(np.uint64)[:, None] << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, (bins.view(np.int64) + owner[None, :] * BINS).ravel(), x.ravel())
        done += len(rounds)
        open_ = (out == EMPTY).any(axis=1)[owner]
        if not open_.all():
            h, owner = h[open_], owner[open_]
    return out


def sketch_documents(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sig): bands are 64-bit keys, sig a byte of each coordinate."""

    def run(batches):
        numbers = np.arange(BANDS, dtype=np.uint64) * _MIX2
        for b, texts in sliced(batches):
            for part in batches_of(texts):
                sets = shingle_sets(texts[part], width)
                c = sketches(sets)
                h = np.repeat(numbers[None, :], len(sets), axis=0)
                for k in range(ROWS):
                    h = mix(h ^ c[:, k::ROWS])
                sig = (mix(c) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(part.start, len(sets)),
                        pa.array(map(len, sets), pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([x if len(s) else x[:0] for s, x in zip(sets, h.view(np.int64))], pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands", "sig"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"
    )


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches allow the threshold, give or take five standard deviations."""
    t = percent / 100
    need = max(0.0, t - 5 * float(np.sqrt(t * (1 - t) / BINS)))
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("sig").alias(f"s{k}"))

    @F.pandas_udf("boolean")
    def agree(sa: pd.Series, sb: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(sa), np.uint8).reshape(-1, BINS)
        b = np.frombuffer(b"".join(sb), np.uint8).reshape(-1, BINS)
        same = (a == b).mean(axis=1) if len(a) else np.empty(0)
        return pd.Series((same - 1 / 256) / (1 - 1 / 256) >= need)

    return pairs.join(side("a"), "a").join(side("b"), "b").filter(agree("sa", "sb")).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs that reach the threshold on their full sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(parts):
        for ta, tb in parts:
            out = np.zeros(len(ta), bool)
            both = [t for pair in zip(ta, tb) for t in pair]
            for part in batches_of(both):
                # A pair's first text may end the part before.
                lo, hi = part.start // 2 * 2, part.stop // 2 * 2
                own = list(dict.fromkeys(both[lo:hi]))
                sets = dict(zip(own, shingle_sets(own, width)))
                for k in range(lo, hi, 2):
                    a, b = sets[both[k]], sets[both[k + 1]]
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    out[k // 2] = 100 * shared >= percent * (len(a) + len(b) - shared) and shared > 0
            yield pd.Series(out)

    same = F.pandas_udf(run, "boolean", F.PandasUDFType.SCALAR_ITER)
    return pairs.join(left, "a").join(right, "b").filter(same("ta", "tb")).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; doc_id is an integer.

    Null and wordless texts have an empty set and link with nothing; fewer than
    ``width`` words make one shingle.  Rows that repeat a doc_id are one node: they
    share its component.  A null doc_id links with nothing: component_id is null and
    the row is kept.  Texts of any length are read whole; a set of equal size and content is compared once.
    An empty table gives an empty result; other columns aren't used.
    """
    rows = stage(sketch_documents(docs, doc_id, text, width), "sketches")
    usable = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Documents with equal sets are stood for by the smallest.
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    classes = stage(classes.select("set_key", "node"), "classes")
    copies = usable.select("doc_id", "set_key").join(classes, "set_key").filter("doc_id <> node").select("doc_id", "node").distinct()
    copies = stage(copies, "copies")
    keyed = usable.select("doc_id", F.explode("bands").alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key"), "keys")
    met = keyed.join(shared, "key").join(copies, "doc_id", "left").select("key", F.coalesce("node", "doc_id").alias("node")).distinct()
    met = stage(met, "met", drop=[classes, shared])
    some = stage(met.select("node").distinct(), "nodes")
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text")).join(some, "node", "left_semi")
    texts = stage(texts, "texts", drop=[some])
    sets = stage(_hashed(texts, width), "sets")
    shareable = stage(_shareable(sets, percent), "shareable")
    # The member with the fewest shingles of its own is the likeliest centre of a group.
    central = met.join(shareable, "node").withColumn("own", F.round(1 - F.col("most") / F.col("n"), 3))
    heads = [F.min_by(F.struct("node", "n", "most"), F.struct(*first, F.xxhash64("node"), F.col("node"))) for first in ((F.col("own"),), ())]
    heads = central.groupBy("key").agg(F.array_distinct(F.array(*heads)).alias("heads"), F.countDistinct("node").alias("k")).filter("k > 1")
    heads = stage(heads.select("key", "heads"), "heads")
    bucketed = stage(central.join(heads, "key").select("key", "node", "n", "most", "heads").distinct(), "buckets", drop=[met, shareable, heads])
    some = stage(bucketed.select("node").distinct(), "nodes")
    nodes = usable.join(some, F.col("doc_id") == F.col("node")).select("node", "sig", "set_key").dropDuplicates(["node", "set_key"])
    nodes = stage(nodes.drop("set_key"), "nodes", drop=[some])

    stars = bucketed.select("node", "n", "most", F.explode("heads").alias("head")).filter("node <> head.node")
    stars = stars.filter(f"least(most, head.most) * (100 + {percent}) >= {percent} * (n + head.n) AND 100 * least(n, head.n) >= {percent} * greatest(n, head.n)")
    stars = stars.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
    likely = stage(_likely(stars, nodes, percent), "candidates", drop=[nodes])
    edges = stage(_confirmed(likely, texts, width, percent), "edges", drop=[likely])
    parts = connected_components(edges)

    # Buckets that still hold several components.
    placed = bucketed.select("key", "node").distinct().join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    open_ = stage(open_.select("key", F.col("top.component").alias("top")), "open")
    members = placed.join(open_, "key").groupBy("node").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("top")).alias("rest"))
    members = stage(members, "members", drop=[bucketed, open_, edges])
    across = _across(sets, members, percent)
    discard(sets, members)
    found = stage(_confirmed(across, texts, width, percent), "edges", drop=[across, texts])
    joined = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = connected_components(joined.union(found).union(copies))
    discard(copies, found)
    return (
        rows.select("doc_id", "n_shingles")
        .join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def _hashed(texts: DataFrame, width: int) -> DataFrame:
    """(node, row, n, shingles) of texts; row tells apart texts that share a node."""

    def run(batches):
        for b, texts in sliced(batches):
            for part in batches_of(texts):
                sets = shingle_sets(texts[part], width)
                row = [xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(part.start, len(sets)), pa.array(row, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["node", "row", "n", "shingles"],
                )

    sets = texts.select("node", "text").mapInArrow(run, "node long, row long, n long, shingles array<long>")
    return sets.filter("n > 0")


def _shareable(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, most) of those texts that may have a link among them.

    A shingle that no other of the texts holds can't be shared, so ``most`` = n less
    those bounds the intersection with any of them.  Edited copies that drifted too far
    from their group drop out here, without being compared with each member.
    """
    held = sets.select("node", "row", "n", F.explode("shingles").alias("shingle"))
    single = held.groupBy("shingle").agg(F.min(F.struct("node", "row", "n")).alias("id"), F.count(F.lit(1)).alias("k")).filter("k = 1")
    alone = single.groupBy("id.node", "id.row", "id.n").agg(F.count(F.lit(1)).alias("alone"))
    most = sets.select("node", "row", "n").join(alone, ["node", "row", "n"], "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
    return most.filter(100 * F.col("most") >= percent * F.col("n"))


def _across(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components that may link, one of them outside its bucket's largest component.

    A set's order: first the shingles that only its component holds, which no such
    pair shares, then the others from rare to frequent.  ``at`` is a shingle's place in
    it.  A pair that shares ``least`` shingles has its first common one at a place of at
    most n - least on either side.
    """
    held = sets.join(members, "node").select("node", "row", "n", "component", "rest", F.explode("shingles").alias("shingle"))
    common = held.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo <> hi")
    lists = (
        held.join(common.select("shingle", "k"), "shingle").groupBy("node", "row", "n", "component", "rest")
        .agg(F.sort_array(F.collect_set(F.struct("k", "shingle"))).alias("s"))
        .withColumn("early", F.size("s") - F.ceil(percent * F.col("n") / 100) + 1)
        .filter("early > 0")
        .select("node", "n", "component", "rest", (F.col("n") - F.size("s")).alias("skipped"), F.posexplode(F.expr("slice(s, 1, early)")).alias("i", "x"))
        .select("node", "n", "component", "rest", (F.col("skipped") + F.col("i")).alias("at"), "x.shingle")
    )
    lists = stage(lists, "rarest")
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "component", "rest", "at")]
    x, y = lists.filter("rest").select("shingle", *side("x")), lists.select(F.col("shingle").alias("shingle_y"), *side("y"))
    least = f"ceil({percent} * (n_x + n_y) / {100 + percent})"
    pairs = x.join(
        y,
        F.expr(
            # A pair of two members outside is met from either side; the lower node's will do.
            "shingle = shingle_y AND component_x <> component_y AND (NOT rest_y OR node_x < node_y) "
            f"AND at_x <= n_x - {least} AND at_y <= n_y - {least}"
        ),
    )
    return stage(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "candidates", drop=[lists])


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, one document of each group: the one with the smallest doc_id; of rows that repeat a doc_id, one.

    Rows without a doc_id and rows with a null, empty or wordless text are kept as groups of their own (of a repeated doc_id
    still one).  An empty table gives an empty result; columns of any name stay as they are.
    """
    doc_id = options.get("doc_id", "doc_id")
    kept = near_duplicates(docs, **options).filter("kept").select("doc_id").distinct().toDF(own := fresh("kept"))
    known = docs.filter(F.col(doc_id).isNotNull()).join(kept, F.col(doc_id) == F.col(own), "left_semi").dropDuplicates([doc_id])
    return known.unionByName(docs.filter(F.col(doc_id).isNull()))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES = {}
