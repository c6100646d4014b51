"""Models as one-row Parquet tables: what they hold is as large as their parameters, not as the data."""

from __future__ import annotations

import copy
import json

import numpy as np
from pyspark.sql import SparkSession


class Stored:
    """save, load and copy for a class whose attributes are numbers, texts, lists and numpy arrays."""

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the fitted model below path, whatever store that is in."""
        state = {k: {"array": v.tolist(), "type": v.dtype.str} if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}
        spark.createDataFrame([(type(self).__name__, json.dumps(state, default=_plain))], "model string, state string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        row = spark.read.parquet(path).first()
        if row.model != cls.__name__:
            raise ValueError(f"{path} holds a {row.model}, not a {cls.__name__}")
        out = cls.__new__(cls)
        for k, v in json.loads(row.state).items():
            setattr(out, k, np.array(v["array"], v["type"]) if isinstance(v, dict) and set(v) == {"array", "type"} else v)
        return out

    def copy(self):
        return copy.deepcopy(self)


def _plain(value):
    if isinstance(value, np.generic):
        return value.item()
    raise TypeError(f"can't store {type(value).__name__}")
