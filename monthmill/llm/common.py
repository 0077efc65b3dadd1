"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and \x09-\x0D.  Everything else is part of a word.
SEPARATORS = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one in local mode and an error on a cluster."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir


_staged: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stage(df: DataFrame, label: str, drop: Sequence[DataFrame] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``drop``: staged tables that nothing needs any more once ``df`` is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _staged[out] = path
    discard(*drop)
    return out


def discard(*staged: DataFrame) -> None:
    """Remove the files of staged tables; other DataFrames are left alone."""
    for df in staged:
        if path := _staged.pop(df, None):
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(name: str) -> str:
    """A column name that no caller's table has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps it out of inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null: none)."""
    return F.coalesce(F.filter(F.split(text, SEPARATORS, -1), lambda w: w != ""), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the columns' values."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
