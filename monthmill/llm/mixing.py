"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / source_size times.  The whole
part is certain; the fractional parts are rounded dependently: units are paired,
the mass of one moves to the other at random until one of them is 0 or 1, and the
rest goes on to the next pair.  Units are grouped into blocks of like size (so
that moving mass hardly changes the words taken); a block leaves at most one
fractional unit, and these residuals form the next level of the reduction tree,
until each source has one, which is rounded to the nearer side.  All random numbers are
hashes of the unit, so reruns agree.  Rows that are equal to the mix are one unit with
their joint share, whose whole part is certain as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, stage, table, uniform

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Units of a block on average; a block's units are one array of small structs.
BLOCK = 128
EPS = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> also ``target``.  One row per source goes through here.

    Needs one row per source in one task, as sources number thousands at most.
    Sources in code point order, null last, weigh ``weights``, repeating.  A target
    stops at ``most`` times the source's size; what is over is shared by weight among
    the others.  With sources ordered by cap / weight this is one pass of running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumns({"w": w, "cap": F.col("source_size") * float(most)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after),
    ).withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    # Beyond the first uncapped source the running level only falls.
    s = s.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    return s.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"),
    )


def _fold(unit: str) -> str:
    """SQL of one block's pivotal rounding; ``unit`` is the type of a unit's key, which holds its size.

    The carried unit and the next one exchange words: either as many as make one of
    them integral upwards, or downwards, with odds that leave both expectations as
    they were.  The words of the pair stay the same.
    """
    entry = f"struct<key:{unit},f:double,u:double>"
    done = f"array<struct<key:{unit},x:int>>"
    a, b = "acc.c.key.size", "e.key.size"
    up = f"least((1 - acc.c.f) * {a}, e.f * {b})"
    down = f"least(acc.c.f * {a}, (1 - e.f) * {b})"
    moved = f"CASE WHEN e.u < {down} / ({up} + {down}) THEN {up} ELSE -{down} END"
    whole = lambda f: f"({f} < {EPS} OR {f} > 1 - {EPS})"
    settled = lambda who, f: f"named_struct('key', {who}.key, 'x', cast(round({f}) as int))"
    carry = lambda who, f: f"named_struct('key', {who}.key, 'f', {f}, 'u', {who}.u)"
    return f"""aggregate(units, named_struct('c', cast(null as {entry}), 'd', cast(array() as {done})), (acc, e) -> CASE
      WHEN acc.c IS NULL THEN named_struct('c', e, 'd', acc.d)
      ELSE transform(transform(array({moved}), m -> named_struct('a', acc.c.f + m / {a}, 'b', e.f - m / {b})), n -> CASE
        WHEN {whole("n.a")} AND {whole("n.b")} THEN named_struct('c', cast(null as {entry}), 'd', concat(acc.d, array({settled("acc.c", "n.a")}, {settled("e", "n.b")})))
        WHEN {whole("n.a")} THEN named_struct('c', {carry("e", "n.b")}, 'd', concat(acc.d, array({settled("acc.c", "n.a")})))
        ELSE named_struct('c', {carry("acc.c", "n.a")}, 'd', concat(acc.d, array({settled("e", "n.b")}))) END)[0] END)"""


def pivotal_round(units: DataFrame, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(source, key with its size, f with 0 < f < 1) -> (source, key, x in 0, 1); sums of f * size per source are kept to within one unit."""
    kind = units.schema["key"].dataType.simpleString()
    level, settled, depth = units, None, 0
    while True:
        slots = level.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("slots")).withColumnRenamed("source", "_source")
        draw = uniform(F.col("key"), F.col("source"), F.lit(depth), F.lit(seed))
        unit = F.struct(F.col("key.size").alias("size"), "key", "f", draw.alias("u"))
        blocks = (
            level.join(slots, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("slot", F.pmod(F.xxhash64("key", F.lit(depth), F.lit(seed)), F.col("slots")))
            .groupBy("source", "slot")
            .agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"))
            .withColumn("units", F.transform("units", lambda x: F.struct(*[x.getField(n).alias(n) for n in ("key", "f", "u")])))
            .select("source", F.expr(_fold(kind)).alias("r"))
            .select("source", F.col("r.c").alias("c"), F.col("r.d").alias("d"))
        )
        blocks = stage(blocks, "pivotal")
        got = blocks.select("source", F.explode("d").alias("x")).select("source", "x.key", "x.x")
        settled = got if settled is None else settled.unionByName(got)
        left = blocks.filter("c IS NOT NULL")
        if (left.groupBy("source").count().agg(F.max("count")).first()[0] or 0) <= 1:
            last = F.when(F.col("c.f") >= 0.5, F.lit(1)).otherwise(F.lit(0))
            return settled.unionByName(left.select("source", F.col("c.key").alias("key"), last.alias("x")))
        depth += 1
        level = left.select("source", F.col("c.key").alias("key"), F.col("c.f").alias("f"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights=WEIGHTS,
    most: int = MAX_COPIES,
    seed: int = 42,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of ``docs``.

    Null text: size 0, taken 0.  Null source: the last source.  Null doc_id: an id
    like any other.  Rows with equal id, source and size share their copies as evenly as they go.
    Documents without words are never taken.  An empty table gives an empty result.
    """
    return _mixed(docs, doc_id, source, text, weights, most, seed).drop("mark", "no")


def number_repeats(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with numbers 0, 1, ... for rows of equal keys; only repeated keys are numbered, in parts, so many equal rows are no hot key."""
    own = [fresh(k) for k in keys]
    repeated = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(k).alias(o) for k, o in zip(keys, own)]), "repeats")
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)])
    once = df.join(repeated, equal, "left_anti").withColumn(name, F.lit(0).cast("long"))
    part, before = fresh("part"), fresh("before")
    # Written, so that every use sees the same parts.
    some = stage(df.join(repeated, equal, "left_semi").withColumn(part, F.spark_partition_id()), "repeated-rows")
    counts = some.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    counts = counts.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(part).alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(*keys, part).orderBy(F.lit(0))) - 1
    many = some.withColumn(name, inside).join(counts, equal & (F.col(part) == F.col("p"))).withColumn(name, F.col(name) + F.col(before))
    return once.unionByName(many.select(*once.columns))


def _with_texts_ahead(d: DataFrame) -> DataFrame:
    """``d`` with ``ahead``: rows of the same id, source and size whose text's hash is smaller."""
    unit = ["doc_id", "source", "size"]
    several = d.groupBy(*unit).agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).filter("NOT lo <=> hi").select(F.struct(*unit).alias("_m"))
    marks = d.join(several, F.struct(*unit).eqNullSafe(F.col("_m")), "left_semi").groupBy(*unit, "mark").agg(F.count(F.lit(1)).alias("n"))
    marks = stage(marks.withColumn("part", F.coalesce(F.shiftright("mark", 56), F.lit(-129))), "marks")  # 257 parts in order of the hash
    parts = marks.groupBy(*unit, "part").agg(F.sum("n").alias("n"))
    before = lambda *order: F.coalesce(F.sum("n").over(Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.struct(*unit, "part").alias("_p"), before(*unit, "part").alias("parts_ahead"))
    marks = marks.withColumn("inside", before(*unit, "part", "mark")).join(parts, F.struct(*unit, "part").eqNullSafe(F.col("_p")))
    marks = marks.select(F.struct(*unit, "mark").alias("_m"), (F.col("inside") + F.col("parts_ahead")).alias("ahead"))
    return d.join(marks, F.struct(*unit, "mark").eqNullSafe(F.col("_m")), "left").withColumn("ahead", F.coalesce("ahead", F.lit(0))).drop("_m")


def _mixed(docs: DataFrame, doc_id: str, source: str, text: str, weights, most: int, seed: int) -> DataFrame:
    """``mix`` with a hash of the text and the number of the row among those that are equal to it."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("mark"))
    d = stage(d, "sizes")
    sources = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    sources = sources.withColumn("p", F.coalesce(share, F.lit(0.0)))
    sources = sources.withColumns({"base": F.floor(F.col("p") + EPS).cast("int"), "f": F.greatest(F.col("p") - F.floor(F.col("p") + EPS), F.lit(0.0))})
    sources = stage(sources, "sources").withColumnRenamed("source", "_source")
    units = (
        d.filter("size > 0").groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
        .join(sources.filter(f"f > {EPS}").select("_source", "f"), F.col("source").eqNullSafe(F.col("_source")))
        .select("source", F.struct("doc_id", "size").alias("key"), "rows", (F.col("rows") * F.col("f")).alias("share"))
        .withColumn("whole", F.floor(F.col("share") + EPS)).withColumn("f", F.col("share") - F.col("whole"))
    )
    drawn = pivotal_round(units.filter(f"f > {EPS}").select("source", "key", "f"), seed=seed).select(F.struct("source", "key").alias("_d"), "x")
    extra = units.join(drawn, F.struct("source", "key").eqNullSafe(F.col("_d")), "left")
    extra = extra.select(F.struct("key.doc_id", "source", "key.size").alias("_u"), (F.col("whole") + F.coalesce("x", F.lit(0))).alias("x"))
    more = (F.coalesce("x", F.lit(0)) > F.col("no") + F.col("ahead")).cast("int")
    return (
        _with_texts_ahead(number_repeats(d, ("doc_id", "source", "size", "mark"), "no")).join(sources, F.col("source").eqNullSafe(F.col("_source")))
        .join(extra, F.struct("doc_id", "source", "size").eqNullSafe(F.col("_u")), "left")
        .withColumn("copies", F.when(F.col("size") > 0, F.col("base") + more).otherwise(F.lit(0)))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "mark", "no")
    )


def repeat_by_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights=WEIGHTS,
    most: int = MAX_COPIES,
    seed: int = 42,
) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it: 0 to ``most`` times.

    Null, empty and wordless texts have no size and are never taken.  Equal rows share their copies; a null source is a source of its own,
    a null doc_id a document like others.  An empty table gives an empty result; columns of any name stay as they are.
    """
    mark, no, unit, taken_unit, copies = map(fresh, ("mark", "no", "unit", "taken", "copies"))
    taken = _mixed(docs, doc_id, source, text, weights, most, seed).filter("copies > 0").select(F.struct("doc_id", "source", "mark", "no").alias(taken_unit), F.col("copies").alias(copies))
    numbered = number_repeats(docs.withColumn(mark, F.xxhash64(text)), (doc_id, source, mark), no)
    own = F.struct(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(mark).alias("mark"), F.col(no).alias("no"))
    return (
        numbered.withColumn(unit, own).join(taken, F.col(unit).eqNullSafe(F.col(taken_unit)))
        .withColumn(no, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {}
