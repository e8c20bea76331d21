"""Views computed at request time: typed inputs from a row, features as expressions over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import ratio_or_zero


@dataclass(frozen=True)
class DerivedView:
    """``inputs`` is DDL; ``features`` maps a feature to its expression, built when it is selected."""

    inputs: str
    features: Mapping[str, Callable[[], Column]]

    def unmet(self, schema: T.StructType) -> list[str]:
        """What a frame of this schema lacks: absent inputs and inputs of a type that can't widen."""
        given = {f.name.lower(): f.dataType for f in schema}
        lacks = []
        for need in T.StructType.fromDDL(self.inputs):
            kind = given.get(need.name.lower())
            numbers = isinstance(kind, T.NumericType) and isinstance(need.dataType, T.NumericType)
            if kind is None:
                lacks.append(f"no {need.name}")
            elif kind != need.dataType and not numbers:
                lacks.append(f"{need.name} is {kind.simpleString()}, not {need.dataType.simpleString()}")
        return lacks


def _share(of: str) -> Callable[[], Column]:
    return lambda: ratio_or_zero(F.col("amount"), F.col(of))


DERIVED = {
    "amount_to_avg_ratio": DerivedView(
        "amount double, txn_amount_avg_30d double",
        {"amount_to_avg_ratio": _share("txn_amount_avg_30d")},
    ),
    "transaction_ratios": DerivedView(
        "amount double, txn_amount_avg_30d double, txn_amount_sum_30d double",
        {
            "amount_to_avg_ratio": _share("txn_amount_avg_30d"),
            "amount_to_sum_ratio": _share("txn_amount_sum_30d"),
        },
    ),
}


def usable(df: DataFrame, names: Iterable[str], views: Mapping[str, DerivedView] = DERIVED) -> list[str]:
    """Those of the names that are views whose inputs the frame has."""
    return [n for n in names if n in views and not views[n].unmet(df.schema)]


def with_derived(
    df: DataFrame, names: Iterable[str], views: Mapping[str, DerivedView] = DERIVED
) -> DataFrame:
    """The frame with the features of all named views, as one select list.

    The names are validated together: a LookupError lists everything that is wrong with any of them.
    Use ``usable`` first to leave out what can't be computed.
    """
    wrong = {n: views[n].unmet(df.schema) if n in views else ["not a derived view"] for n in names}
    wrong = {n: lacks for n, lacks in wrong.items() if lacks}
    if wrong:
        raise LookupError("; ".join(f"{n}: {', '.join(lacks)}" for n, lacks in wrong.items()))
    features = {f: build for n in names for f, build in views[n].features.items()}
    return df.withColumns({f: build() for f, build in features.items()})
