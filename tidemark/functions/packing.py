"""Wide feature rows to the vector form a model is served: typed maps plus a status map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Feature status codes.
PRESENT, MISSING, STALE = 1, 2, 3


def _to_map(pairs: list[tuple[str, Column]], value_type: str) -> Column:
    if not pairs:
        return F.create_map().cast(f"map<string,{value_type}>")
    filled = F.map_from_arrays(
        F.array(*[F.lit(name) for name, _ in pairs]),
        F.array(*[column.cast(value_type) for _, column in pairs]),
    )
    return F.map_filter(filled, lambda _, value: value.isNotNull())


def feature_vector(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """``numeric`` and ``text`` maps; a feature's type picks its map at plan time, nulls are left out."""
    numeric, text = [], []
    for name in features:
        kind = df.schema[name].dataType
        is_number = isinstance(kind, T.NumericType | T.BooleanType)
        (numeric if is_number else text).append((name, F.col(name)))
    return {"numeric": _to_map(numeric, "double"), "text": _to_map(text, "string")}


def status_map(statuses: dict[str, Column]) -> Column:
    return _to_map(list(statuses.items()), "int")
