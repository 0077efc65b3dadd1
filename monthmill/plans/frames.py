"""The frames that many queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, models, segments, splits
from ..operators.ordered import quantile_columns
from ..sources import tables
from ..sources.panel import ID, LAGS, LAST, TARGET, TIME, supplier_panel

BASELINES = ("persistence", "three_month_average")


def windowed(spark: SparkSession, d: str) -> DataFrame:
    return features.window_features(supplier_panel(spark, d))


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return segments.assign_all(windowed(spark, d))


def sided(df: DataFrame, side: str) -> DataFrame:
    return df.filter(F.col("side") == side)


def labelled(panel: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Split rows of the panel: keys, target, lags and the columns in ``more``.

    What is kept is only these, so columns and windows that nothing reads aren't made, and months, statistics and
    scores all read it.
    """
    columns = dict.fromkeys((ID, TIME, "month_index", TARGET, *LAGS, *more))
    return splits.holdout_labels(tables.kept(panel.select(*columns)))


def training(panel: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The training rows of ``labelled``, kept by themselves: fits read them in hundreds of jobs, which then needn't find the split again."""
    return tables.kept(sided(labelled(panel, more), "train"))


def baselines(panel: DataFrame, averages: dict[str, int] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Split rows with both baselines, further averages by name and months, and the columns in ``more``."""
    rows = labelled(panel, more)
    return models.with_baselines(rows, sided(rows, "train"), averages)


def predictions(panel: DataFrame, keep: tuple[str, ...] = (ID, TIME, "side")) -> DataFrame:
    return models.long_predictions(baselines(panel, more=tuple(c for c in keep if c != "side")), BASELINES, keep)


def fold_predictions(panel: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Validation rows of the folds over the training months, with each fold's own median."""
    tagged = splits.expanding_folds(sided(labelled(panel, keep), "train"))
    med = quantile_columns(tagged.filter("fold_side = 'train'"), TARGET, {"median_target": 0.5}, ("fold",))
    rows = tagged.filter("fold_side = 'validate'").join(F.broadcast(med), "fold")
    one, three = F.col(LAST), features.row_mean(LAGS)
    rows = rows.withColumns({"persistence": F.coalesce(one, "median_target"), "three_month_average": F.coalesce(three, "median_target")})
    return models.long_predictions(rows, BASELINES, ("fold", *keep))
