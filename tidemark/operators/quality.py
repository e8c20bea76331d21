"""Expectations on feature columns, the gate before materialization, and contract checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import parse_duration_text
from tidemark.sources.feature_table import instant

# Type names a rule may ask for.
TYPE_NAMES = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "string": (T.StringType,),
    "bool": (T.BooleanType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType),
}


class QualityError(RuntimeError):
    """A batch failed its expectations."""


def _broken(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _outside(column: Column, missing: Column, _: T.DataType, bounds: dict[str, Any]) -> Column:
    return _broken(~missing & ~column.between(bounds["min"], bounds["max"]))


def _of_another_type(_: Column, __: Column, dtype: T.DataType, wanted: dict[str, Any]) -> Column:
    return _broken(F.lit(not isinstance(dtype, TYPE_NAMES[wanted["type"]])))


#: How many rows break a rule, as an aggregate over the column, its missing rows, type and parameters.
#: Missing values (null and NaN) pass ``between``, fail ``in_set`` and count against ``unique``.
KINDS: dict[str, Callable[[Column, Column, T.DataType, dict[str, Any]], Column]] = {
    "not_null": lambda column, missing, dtype, _: _broken(missing),
    "in_set": lambda column, missing, dtype, given: _broken(missing | ~column.isin(*given["values"])),
    "unique": lambda column, missing, dtype, _: F.count(F.lit(1)) - F.count_distinct(F.when(~missing, column)),
    "between": _outside,
    "of_type": _of_another_type,
}


@dataclass(frozen=True)
class Expectation:
    """A rule of one of the ``KINDS`` on a column.

    ``mostly`` tolerates a failing share of ``1 - mostly`` whatever the run's own tolerance is.
    """

    column: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    mostly: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"rules are {', '.join(sorted(KINDS))}; {self.kind} is none of them")

    def failing(self, df: DataFrame) -> Column:
        """Aggregate counting the rows that break the rule."""
        column, dtype = F.col(self.column), df.schema[self.column].dataType
        floating = isinstance(dtype, T.FloatType | T.DoubleType)
        missing = column.isNull() | F.isnan(column) if floating else column.isNull()
        return KINDS[self.kind](column, missing, dtype, self.params)


# The rules of the declared user view.
USER_FEATURE_RULES = (
    Expectation("entity_id", "not_null"),
    Expectation("txn_count_30d", "between", {"min": 0, "max": 100_000}),
    Expectation("chargeback_rate_90d", "between", {"min": 0.0, "max": 1.0}, mostly=0.999),
    Expectation("home_country", "not_null"),
    Expectation("txn_amount_avg_30d", "of_type", {"type": "float"}),
)


def quality_report(
    df: DataFrame, rules: Sequence[Expectation], *, fail_fraction: float = 0.0
) -> DataFrame:
    """One row per rule from one pass: ``column_name, kind, failing, fraction, passed``.

    A missing column or an empty frame fails the whole rule (fraction 1).
    """
    present = [(i, r) for i, r in enumerate(rules) if r.column in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[r.failing(df).cast("long").alias(f"_f{i}") for i, r in present],
    )
    known = {i for i, _ in present}
    results = []
    for i, rule in enumerate(rules):
        failing = F.col(f"_f{i}") if i in known else F.col("_rows")
        whole = F.col("_rows") == 0 if i in known else F.lit(True)
        fraction = F.when(whole, F.lit(1.0)).otherwise(failing / F.nullif(F.col("_rows"), F.lit(0)))
        tolerance = max(fail_fraction, round(1.0 - rule.mostly, 12))
        passed = (~whole & (failing == 0)) | (fraction <= tolerance)
        results.append(
            F.struct(
                F.lit(rule.column).alias("column_name"),
                F.lit(rule.kind).alias("kind"),
                failing.alias("failing"),
                fraction.alias("fraction"),
                passed.alias("passed"),
            )
        )
    return counts.select(F.explode(F.array(*results)).alias("_rule")).select("_rule.*")


def require_quality(
    df: DataFrame, rules: Sequence[Expectation], *, fail_fraction: float = 0.0
) -> None:
    """Raise if any rule fails; only the failed rules' rows come to the driver."""
    failed = quality_report(df, rules, fail_fraction=fail_fraction).where(~F.col("passed")).collect()
    if failed:
        texts = [f"{r['column_name']} {r['kind']}: {r['fraction']:.2%} of rows fail" for r in failed]
        raise QualityError("; ".join(texts))


@dataclass(frozen=True)
class ContractColumn:
    name: str
    type: str  # Spark DDL type
    nullable: bool = True


@dataclass(frozen=True)
class Contract:
    name: str
    version: int
    columns: tuple[ContractColumn, ...]
    freshness: str  # duration text
    ts: str = "event_ts"


def contract_report(df: DataFrame, contract: Contract, now: datetime) -> DataFrame:
    """Conformance of a table: one row per contract column, per undeclared column, and freshness.

    Presence and type are read off the schema; nulls and the newest time come from one pass.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    declared = {c.name for c in contract.columns}
    wanted = {c.name: T.StructType.fromDDL(f"c {c.type}")["c"].dataType for c in contract.columns}
    counted = [c for c in contract.columns if c.name in types]
    facts = df.agg(
        F.max(contract.ts).alias("_newest"),
        *[F.count(F.when(F.col(c.name).isNull(), 1)).alias(f"_n_{c.name}") for c in counted],
    )

    def row(item: str, check: str, violations: Column, ok: Column) -> Column:
        return F.struct(
            F.lit(item).alias("item"),
            F.lit(check).alias("check"),
            violations.cast("long").alias("violations"),
            ok.alias("ok"),
        )

    rows = []
    for c in contract.columns:
        if c.name not in types:
            rows.append(row(c.name, "removed", F.lit(1), F.lit(False)))
            continue
        same = types[c.name] == wanted[c.name].simpleString()
        rows.append(row(c.name, "type", F.lit(0 if same else 1), F.lit(same)))
        if not c.nullable:
            nulls = F.col(f"_n_{c.name}")
            rows.append(row(c.name, "not_null", nulls, nulls == 0))
    for name in types:
        if name not in declared:
            rows.append(row(name, "undeclared", F.lit(0), F.lit(True)))
    limit = instant(now) - F.lit(parse_duration_text(contract.freshness))
    fresh = F.coalesce(F.col("_newest") >= limit, F.lit(False))
    rows.append(row(contract.ts, "freshness", (~fresh).cast("long"), fresh))
    return facts.select(F.explode(F.array(*rows)).alias("_check")).select(
        F.lit(f"{contract.name}.v{contract.version}").alias("contract"), "_check.*"
    )


def removed_features(old: T.StructType, new: T.StructType) -> list[str]:
    """Features a new version of a view no longer has."""
    return sorted(set(old.names) - set(new.names))
