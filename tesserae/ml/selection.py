"""Model selection over DataFrames: pipelines, stratified folds, cross-validation and grid search."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.ml.base import Estimator
from tesserae.operators.order import numbered


class Pipeline(Estimator):
    """Steps that transform, and a last one that predicts or transforms."""

    def __init__(self, *steps):
        self.steps = steps

    def fit(self, df: DataFrame, y: str = "y", **kw) -> Pipeline:
        for s in self.steps[:-1]:
            df = _fit(s, df, y).transform(df)
        _fit(self.steps[-1], df, y, **kw)
        return self

    def _through(self, df: DataFrame) -> DataFrame:
        for s in self.steps[:-1]:
            df = s.transform(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return self.steps[-1].transform(self._through(df))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.steps[-1].predict(self._through(df))

    def score(self, df: DataFrame, y: str = "y") -> float:
        return self.steps[-1].score(self._through(df), y)


def _fit(step, df, y, **kw):
    import inspect

    return step.fit(df, **({"y": y} if "y" in inspect.signature(step.fit).parameters else {}), **kw)


def stratified_folds(df: DataFrame, y: str = "y", cv: int = 5, seed: int = 0, id_: str = "id") -> DataFrame:
    """df with column fold: the rows of each label, in the order of a hash of their ids, go round the folds; rows without a label have none.

    Rows are numbered within parts of a label's hash range, so no task has all rows of a label.
    """
    h = F.xxhash64(F.col(id_), F.lit(seed))
    rows = df.where(F.col(y).isNotNull()).withColumn("__h", h)
    out = numbered(rows, [y], F.shiftright("__h", 48), ["__h", id_], "__n")
    return out.withColumn("fold", (F.col("__n") % cv).cast("int")).drop("__n", "__h")


def group_folds(df: DataFrame, group: str, cv: int = 5, seed: int = 0) -> DataFrame:
    """df with column fold: all rows of a group are in one."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(cv)).cast("int"))


def cross_validate(make: Callable[[], Estimator], df: DataFrame, cv: int = 5, y: str = "y", id_: str = "id", seed: int = 0, group: str | None = None) -> np.ndarray:
    """Scores of new models on the folds, each fitted on all others."""
    rows = (group_folds(df.where(F.col(y).isNotNull()), group, cv, seed) if group else stratified_folds(df, y, cv, seed, id_)).persist()
    try:
        scores = []
        for k in range(cv):
            test = rows.where(F.col("fold") == k).drop("fold")
            if test.limit(1).count():
                scores.append(_fit(make(), rows.where(F.col("fold") != k).drop("fold"), y).score(test, y))
        return np.array(scores)
    finally:
        rows.unpersist()


def grid_search(make: Callable[..., Estimator], grid: dict[str, list], df: DataFrame, cv: int = 5, y: str = "y", id_: str = "id", seed: int = 0) -> tuple[dict, list[tuple[dict, np.ndarray]]]:
    """The parameters with the best mean score (the first of equal ones), and the scores of all; every combination sees the same folds."""
    tried = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values))
        tried.append((params, cross_validate(lambda p=params: make(**p), df, cv, y, id_, seed)))
    return max(tried, key=lambda t: t[1].mean())[0], tried


__all__ = ["Pipeline", "cross_validate", "grid_search", "group_folds", "stratified_folds"]
