"""Sums of doubles with the special values of IEEE arithmetic: NaN, and infinities of either sign.

``double_sum`` adds up: whole parts and fractions are summed apart, so that rounding hardly reaches the result. Where values
are taken out of a sum again (windows), limbs hold it exactly, in any order: a double is cut into integers below 2^52, one
for each stretch of 52 binary places, and each of them is summed for itself. NaN and infinities are counted, so a sum is NaN
or infinite only while it holds one. A finite value of 2^156 (9e46) or more is an error, and places beyond the 156th after
the point are cut off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CUT = float(2**52)
#: Weights of the limbs, as powers of two. A limb's sum is a decimal, as the sum of many may pass 64 bits.
WEIGHTS = {"huge": 104, "large": 52, "whole": 0, "part": -52, "rest": -104, "least": -156}
SPECIAL = ("nan", "up", "down")
#: Names of a sum's columns.
PARTS = (*WEIGHTS, *SPECIAL)
SUMMED = "decimal(38,0)"
#: As many limbs (of squares too, below 2^53 each) add up within 64 bits in any order.
FEW = 1_000
#: A limb's sum is read as two doubles, parted here.
_HALF = 1 << 40


def limbs(x: Column) -> dict[str, Column]:
    """A double as summable long columns; most are null for most values, and all are for null."""
    size = F.abs(x)
    small, mid = size < _CUT, (size >= _CUT) & (size < _CUT**2)
    big = (size >= _CUT**2) & (size < _CUT**3)

    def cut(value: Column) -> Column:
        # Spark may compute a shared cast before it looks at the condition above it.
        return value.try_cast("long")

    whole = cut(x)
    fraction = (x - whole.cast("double")) * _CUT
    rest = (fraction - cut(fraction).cast("double")) * _CUT
    upper, top = x / _CUT, x / _CUT**2
    beyond = F.raise_error(F.lit("a value to be summed is beyond 2^156")).cast("long")
    return {
        "huge": F.when(big, cut(top)).when((size >= _CUT**3) & (size < float("inf")), beyond),
        "large": F.when(mid, cut(upper)).when(big, cut((top - cut(top).cast("double")) * _CUT)),
        "whole": F.when(small, whole).when(mid, cut((upper - cut(upper).cast("double")) * _CUT)),
        "part": F.when(small, cut(fraction)),
        "rest": F.when(small & (rest != 0), cut(rest)),
        "least": F.when(small & (rest != 0), cut((rest - cut(rest).cast("double")) * _CUT)),
        "nan": F.when(F.isnan(x), F.lit(1).cast("long")),
        "up": F.when(x == float("inf"), F.lit(1).cast("long")),
        "down": F.when(x == float("-inf"), F.lit(1).cast("long")),
    }


def with_limbs(df: DataFrame, value: str, name: str, squared: str | None = None) -> DataFrame:
    """Add the limbs of a column as ``<name>_<part>``; given ``squared``, those of its exact square as well.

    A square is the rounded product and what that is off by, which is a double again. The steps are columns of their own,
    so that no expression is written out more than once.
    """
    x = F.col(f"{name}_x")
    out = df.withColumn(f"{name}_x", F.col(value).cast("double"))
    added = {f"{name}_{k}": v for k, v in limbs(x).items()}
    if squared is None:
        return out.withColumns(added).drop(f"{name}_x")
    square, off = (F.col(f"{squared}_{k}") for k in ("s", "o"))
    rounded, error = two_product(x, x)
    out = out.withColumns({f"{squared}_s": rounded, f"{squared}_o": F.when(F.abs(x) < _CUT**1.5, error)})
    one = {f"{squared}_1{k}": v for k, v in limbs(square).items()}
    other = {f"{squared}_2{k}": v for k, v in limbs(off).items() if k in WEIGHTS}
    out = out.withColumns(added | one | other)

    def both(part: str) -> Column:
        a, b = F.col(f"{squared}_1{part}"), F.col(f"{squared}_2{part}")
        return F.coalesce(a + b, a, b) if part in WEIGHTS else a

    steps = [f"{squared}_s", f"{squared}_o", f"{name}_x", *one, *other]
    return out.withColumns({f"{squared}_{part}": both(part) for part in PARTS}).drop(*steps)


def _special(of: Callable[[str], Column], otherwise: Column) -> Column:
    """What the counted special values make of a sum."""
    nan, up, down = (F.coalesce(of(name), F.lit(0)) > 0 for name in SPECIAL)
    return (
        F.when(nan | up & down, float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(otherwise)
    )


def joined(of: Callable[[str], Column]) -> Column:
    """The double that summed limbs stand for; ``of`` gives the column of a part."""
    terms = [F.coalesce(of(k).cast("double"), F.lit(0.0)) * F.lit(2.0**w) for k, w in WEIGHTS.items()]
    return _special(of, terms[0] + terms[1] + (terms[2] + (terms[3] + (terms[4] + terms[5]))))


def two_product(a: Column, b: Column) -> tuple[Column, Column]:
    """A rounded product and what it is off by."""

    def halves(x: Column) -> tuple[Column, Column]:
        # Two halves with few enough digits for their products to be exact.
        far = x * F.lit(float(2**27 + 1))
        high = far - (far - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _pair(of: Callable[[str], Column], kind: str | None) -> Column:
    """Summed limbs (of type ``kind``, None: long) as a struct of two doubles, the second what the first is off by."""
    terms = []
    for name, weight in WEIGHTS.items():
        if kind is None:
            total = F.coalesce(of(name), F.lit(0).cast("long"))
            high = F.call_function("div", total, F.lit(_HALF).cast("long"))
            low = total - high * F.lit(_HALF).cast("long")
        else:
            total = F.coalesce(of(name).cast(kind), F.lit(0).cast(kind))
            high = F.call_function("div", total, F.lit(_HALF).cast(kind))
            low = (total - high.cast(kind) * F.lit(_HALF).cast("decimal(13,0)")).cast("long")
        terms += [high.cast("double") * F.lit(2.0**weight * _HALF), low.cast("double") * F.lit(2.0**weight)]

    def add(so_far: Column, x: Column) -> Column:
        a = so_far["h"]
        s = a + x
        t = s - a
        return F.struct(s.alias("h"), (so_far["l"] + ((a - (s - t)) + (x - t))).alias("l"))

    start = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("l"))
    return F.aggregate(F.array(*terms), start, add, lambda r: F.struct((r["h"] + r["l"]).alias("h"), (r["l"] - ((r["h"] + r["l"]) - r["h"])).alias("l")))


def with_variance(
    df: DataFrame,
    out: str,
    sums: Callable[[str], Column],
    squares: Callable[[str], Column],
    n: Column,
    kind: str | None = SUMMED,
) -> DataFrame:
    """Add the sample variance of ``n`` values from their summed limbs and those of their squares (of type ``kind``, None: long).

    ``n * squares - sum * sum`` is taken in pairs of doubles (about 106 bits), so a spread above some 1e-14 of
    the mean is found. What is left below the limbs' own resolution counts as 0, so equal values have no variance. Null for fewer
    than two values, NaN where one is not finite.
    """
    count = n.cast("double")
    s, q = F.col(f"{out}_s"), F.col(f"{out}_q")
    df = df.withColumns({f"{out}_s": _pair(sums, kind), f"{out}_q": _pair(squares, kind)})
    (p, p_off), (r, r_off) = two_product(s["h"], s["h"]), two_product(q["h"], count)
    steps = {"p": p, "r": r, "o": (r_off + count * q["l"]) - (p_off + 2 * s["h"] * s["l"])}
    df = df.withColumns({f"{out}_{k}": v for k, v in steps.items()})
    p, spread = F.col(f"{out}_p"), (F.col(f"{out}_r") - F.col(f"{out}_p")) + F.col(f"{out}_o")
    least = count * count * F.lit(2.0**-153) * (1 + 2 * F.abs(s["h"]) / count) + p * F.lit(2.0**-101)
    variance = F.when(spread > least, spread / (count * (count - 1))).otherwise(0.0)
    variance = F.when(n > 1, F.when(_special(sums, F.lit(0.0)) == 0, variance).otherwise(float("nan")))
    return df.withColumn(out, variance).drop(*[f"{out}_{k}" for k in ("s", "q", *steps)])


def double_parts(x: Column) -> tuple[Column, Column]:
    """Whole part and fraction of a double, to be summed apart; NaN, infinities and null are in the first."""
    x = x.cast("double")
    split = F.abs(x) < _CUT
    fraction = x % F.lit(1.0)
    whole = F.when(split, x - fraction).otherwise(x)
    return whole, F.when(split, fraction).otherwise(F.when(x.isNotNull(), 0.0))


def double_sum(column: str | Column) -> Column:
    """The sum of a double column where nothing is taken out again, as plain arithmetic has it; null without values.

    Whole parts add up without rounding (below 2^53), so only the sum of the fractions is rounded.
    """
    whole, fraction = double_parts(F.col(column) if isinstance(column, str) else column)
    return F.sum(whole) + F.sum(fraction)
