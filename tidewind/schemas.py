"""Explicit schemas of the published tables."""

from __future__ import annotations

from pyspark.sql import types as T

from tidewind.config import Config, feature_names


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in columns.items()])


D, DAY, S, L, I, B = T.DoubleType(), T.DateType(), T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
BARS = _struct(Date=DAY, Open=D, High=D, Low=D, Close=D, Volume=D)
PREDICTIONS = _struct(fold=I, Date=DAY, regime=S, y_true=D, y_pred=D)
OOS = _struct(Date=DAY, prediction=D, actual_return_5d=D, regime=S, fold_id=I)
DICTIONARY = _struct(column=S, role=S, dtype=S, formula=S, window=S, timestamp_semantics=S, unit=S, missing_value_policy=S, source=S)


def canonical(cfg: Config = Config()) -> T.StructType:
    return _struct(Date=DAY, **{c: D for c in feature_names(cfg.features)}, **{cfg.target.column: D}, regime=S)
