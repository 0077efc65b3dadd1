"""The serving step as a stream: each micro-batch of new panel rows is predicted once.

Predictions and checkpoints of a step become visible together: their files are written to
folders of their own first, then one small commit file names them.  A commit's number is the one
after the state that the step has read, and its file can be made only once, so of two writers
that read the same state one has to start over.  A step that crashed before its commit has left files that nobody reads;
one that is repeated after it finds its rows behind the checkpoints and adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import serving
from ..sources.panel import ID, TIME

PREDICTIONS = f"{ID} string, prediction double, route string, model_version string, {TIME} date"
CHECKPOINTS = f"{ID} string, last_month date"


#: How often a step starts over because another writer was faster.
ATTEMPTS = 10


class Conflict(RuntimeError):
    """Another writer has committed on the same state."""


@dataclass(frozen=True)
class Version:
    """A state: its number, the folders of predictions, and the folder of the checkpoints."""

    number: int = 0
    predictions: tuple[str, ...] = ()
    checkpoints: str | None = None


class ServingTables:
    """Predictions (partitioned by month) and checkpoints under one folder, in committed versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._path = hadoop.Path
        self._files = self._path(self.root).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._path(self.root).toUri(), conf)

    def current(self) -> Version:
        folder = self._path(f"{self.root}/commits")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        if not (numbers := [int(n) for n in names if n.isdigit()]):
            return Version()
        stream = self._files.open(self._path(f"{self.root}/commits/{max(numbers)}"))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(max(numbers), tuple(told["predictions"]), told["checkpoints"])

    def predictions(self, at: Version | None = None) -> DataFrame:
        folders = (at or self.current()).predictions
        if not folders:
            return self.spark.createDataFrame([], PREDICTIONS)
        base = f"{self.root}/predictions"
        read = self.spark.read.option("basePath", base).schema(f"{PREDICTIONS}, step string").parquet(*[f"{base}/step={f}" for f in folders])
        return read.drop("step")

    def checkpoints(self, at: Version | None = None) -> DataFrame:
        folder = (at or self.current()).checkpoints
        return self.spark.read.schema(CHECKPOINTS).parquet(f"{self.root}/checkpoints/{folder}") if folder else self.spark.createDataFrame([], CHECKPOINTS)

    def commit(self, on: Version, new: DataFrame, checkpoints: DataFrame) -> Version:
        """The state after ``on`` with the predictions ``new`` added and ``checkpoints`` in place; Conflict if there is one already."""
        step = uuid.uuid4().hex
        new.write.partitionBy(TIME).parquet(f"{self.root}/predictions/step={step}")
        checkpoints.write.parquet(f"{self.root}/checkpoints/{step}")
        return self._publish(Version(on.number + 1, (*on.predictions, step), step))

    def _publish(self, version: Version) -> Version:
        own, final = self._path(f"{self.root}/commits/_{uuid.uuid4().hex}"), self._path(f"{self.root}/commits/{version.number}")
        out = self._files.create(own, True)
        out.writeBytes(json.dumps({"predictions": version.predictions, "checkpoints": version.checkpoints}))
        out.close()
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(own, final, none)  # fails where the name is taken
        except Exception as e:
            self._files.delete(own, False)
            if self._files.exists(final):
                raise Conflict(f"version {version.number} is taken") from e
            raise
        return version


def serve_rows(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], tables: ServingTables, floor: DataFrame, version: str = "v1") -> None:
    """One step: predict the rows behind the checkpoints, add those without a prediction and move the checkpoints, in one commit."""
    seen = tables.current()
    known = tables.checkpoints(seen)
    served = predict(serving.pending_rows(rows, known, floor)).persist()
    try:
        new = served.filter("route <> 'skip'").select(ID, "prediction", "route", F.lit(version).alias("model_version"), TIME).dropDuplicates([ID, TIME])
        # Only these months' files of what is there are read.
        months = [r[0] for r in served.select(TIME).distinct().collect()]
        if not months:
            return
        there = tables.predictions(seen).filter(F.col(TIME).isin(months)).select(ID, TIME)
        tables.commit(seen, new.join(there, [ID, TIME], "left_anti"), serving.advance_checkpoints(known, served))
    finally:
        served.unpersist()


def serve_stream(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], tables: ServingTables, floor: DataFrame, checkpoint: str, version: str = "v1") -> StreamingQuery:
    """Start serving ``rows``, a stream with features and history_id.

    ``predict`` adds prediction and route to a batch.  Rows up to a user's checkpoint, or up to
    ``floor`` (one row, floor_month) for a user without one, were served before and are left out.
    """

    def step(batch: DataFrame, number: int) -> None:
        for _ in range(ATTEMPTS):
            try:
                return serve_rows(batch, predict, tables, floor, version)
            except Conflict:
                continue
        raise Conflict(f"batch {number}: other writers were faster {ATTEMPTS} times")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
