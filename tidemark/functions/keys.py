"""Entity ids: one injective string per (possibly composite) key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _escaped(value: Column) -> Column:
    doubled = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("|"), F.lit("\\|"))


def entity_id(keys: Mapping[str, Column]) -> Column:
    """Key values in key-name order, backslash and pipe escaped, joined by a pipe; null if any is."""
    parts = [_escaped(keys[name]) for name in sorted(keys)]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("|"), part)
    return joined


def entity_id_parts(encoded: Column) -> Column:
    """The key values inside an entity id, unescaped, as an array."""
    # Every value follows the start or a bare separator; it may be empty.
    pieces = F.regexp_extract_all(F.concat(F.lit("|"), encoded), F.lit(r"\|((?:[^\\|]|\\.)*)"), F.lit(1))
    return F.transform(pieces, lambda piece: F.regexp_replace(piece, r"\\(.)", "$1"))


def online_key(view: str | Column, keys: Mapping[str, Column]) -> Column:
    view = F.lit(view) if isinstance(view, str) else view
    return F.concat(view, F.lit(":"), entity_id(keys))
