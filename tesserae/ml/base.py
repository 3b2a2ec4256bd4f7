"""What all estimators share."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRIC_KEYS = ("mean", "distance", "map", "dist")


def metric_of(metric, key: str) -> str:
    """A metric given as one name, or as a dict with keys mean, distance and map (or dist)."""
    if isinstance(metric, dict):
        if key == "distance" and "dist" in metric:
            return metric["dist"]
        if key not in metric:
            raise KeyError(f"metric lacks {key!r}")
        return metric[key]
    if isinstance(metric, str) or callable(metric):
        return metric
    raise TypeError("metric is a name, a dict or a callable")


class Estimator:
    """Parameters by keyword, learned state in attributes that end with an underscore."""

    def get_params(self) -> dict:
        return {k: v for k, v in vars(self).items() if not k.endswith("_")}

    def fit_transform(self, df: DataFrame, **kw) -> DataFrame:
        return self.fit(df, **kw).transform(df)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            pickle.dump(self, f)

    @staticmethod
    def load(path: str) -> Estimator:
        with open(path, "rb") as f:
            return pickle.load(f)


class Classifier(Estimator):
    def score(self, df: DataFrame, y: str = "y") -> float:
        """Accuracy."""
        return self.predict(df).agg(F.avg((F.col("prediction").cast("string") == F.col(y).cast("string")).cast("double"))).first()[0]


class Regressor(Estimator):
    def score(self, df: DataFrame, y: str = "y") -> float:
        """Coefficient of determination."""
        p = self.predict(df)
        m = p.agg(F.avg(y)).first()[0]
        r = p.agg(F.sum(F.pow(F.col(y) - F.col("prediction"), 2)), F.sum(F.pow(F.col(y) - m, 2))).first()
        return 1 - r[0] / r[1]


def label_type(df: DataFrame, y: str):
    return df.schema[y].dataType


def by_label(values: list, kind) -> list:
    """Group keys (strings) in the order of the labels' own type."""
    text = kind.typeName() == "string"
    return sorted(values, key=lambda v: v if text else float(v))


def argmin_label(df: DataFrame, distances: str, classes: list[str], kind) -> DataFrame:
    """df with `prediction`: the class with the smallest distance, the first of equal ones."""
    labels = F.array(*(F.lit(c).cast(kind) for c in classes))
    at = F.array_position(F.col(distances), F.array_min(distances)).cast("int")
    return df.withColumn("prediction", F.element_at(labels, at))


def probabilities(distances: str):
    """softmax(-d^2)."""
    from tesserae.columns import softmax

    return softmax(F.transform(F.col(distances), lambda d: -d * d))


def eigh_pencil(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Generalised eigenvalues and vectors of (a, b), ascending, vectors normalised by b."""
    low = np.linalg.cholesky(b)
    inv = np.linalg.inv(low)
    w, v = np.linalg.eigh(inv @ a @ inv.conj().T)
    return w, inv.conj().T @ v
