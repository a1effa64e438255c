"""Saving and loading fitted feature spaces."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from trackspark.operators.prep import FeatureSpace


def save_space(space: FeatureSpace, path: str, spark: SparkSession, **settings) -> None:
    """Write a fitted space, and what else a search needs to know (metric, number of neighbours), as one row of JSON."""
    model = {
        "columns": space.columns,
        "weights": space.weights,
        "mean": space.mean,
        "std": space.std,
        "components": space.components,
        "explained": space.explained,
        "fill_missing": space.fill_missing,
        "settings": settings,
    }
    row = spark.createDataFrame([(json.dumps(model),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/space")


def load_model(path: str, spark: SparkSession) -> tuple[FeatureSpace, dict]:
    """The space and the settings it was saved with."""
    try:
        text = spark.read.text(f"{path}/space").head()
    except AnalysisException as e:
        raise FileNotFoundError(f"no model at {path}") from e
    if text is None:
        raise ValueError(f"incomplete model at {path}")
    m = json.loads(text.value)
    if "mean" not in m:
        raise ValueError(f"the model at {path} is of an older layout: fit and save it again")
    components = None if m["components"] is None else tuple(map(tuple, m["components"]))
    space = FeatureSpace(tuple(m["columns"]), tuple(m["weights"]), tuple(m["mean"]), tuple(m["std"]), components, m["explained"], m["fill_missing"])
    return space, m["settings"]


def load_space(path: str, spark: SparkSession) -> FeatureSpace:
    return load_model(path, spark)[0]
