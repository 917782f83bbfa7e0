"""Column expressions (JVM side, codegen friendly) shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed as FX

# A string counts as a number when it looks like one; anything else becomes
# null, as a "coerce" numeric conversion does.  (A plain cast would accept
# Java literals such as '1d'.)
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def nan_to_null(c: Column) -> Column:
    """Missing is null: NaN would compare true against thresholds and poison sums."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_number(df: DataFrame, name: str) -> Column:
    """Numeric view of column ``name``: bad strings and NaN become null."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(NUMERIC_PATTERN), F.trim(c).try_cast("double"))  # the pattern admits no NaN
    elif isinstance(dtype, T.IntegralType):
        return c  # already a number, cannot hold NaN
    else:
        num = c.cast("double")
    return nan_to_null(num)


def clean_name(c: Column) -> Column:
    """Remove every '*' and strip surrounding whitespace (tabs and non-breaking spaces included)."""
    return F.regexp_replace(F.regexp_replace(c, r"\*", ""), r"(?U)^\s+|\s+$", "")


def nearest_even(c: Column, digits: int) -> Column:
    """``c`` scaled, rounded half to even and scaled back, as NumPy's ``round`` does."""
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def exact_round(c: Column, digits: int) -> Column:
    """``c`` rounded by its exact binary value, exact ties to even, as Python's ``round`` does.

    Where the scaled value looks like a tie, the sign of what the multiplication rounded away decides:
    that error is exact, as the upper 26 bits of ``c`` times the scale need no rounding."""
    scale = float(10 ** digits)
    y = c * scale
    upper = c * 134217729.0 - (c * 134217729.0 - c)
    error = (upper * scale - y) + (c - upper) * scale
    tie = y - F.floor(y) == 0.5
    whole = F.when(tie & (error > 0), F.ceil(y).cast("double")).when(tie & (error < 0), F.floor(y).cast("double")).otherwise(F.rint(y))
    return whole / scale


def position_code(pos: Column, rules: Iterable[tuple[str, int]], default: int) -> Column:
    """First rule whose token occurs in ``pos`` wins; null stays null."""
    expr = None
    for token, code in rules:
        cond = pos.contains(token)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    expr = F.lit(default) if expr is None else expr.otherwise(F.lit(default))
    return F.when(pos.isNotNull(), expr).cast("int")


def round6(df: DataFrame, cols=None, digits: int = 6) -> DataFrame:
    """Round double columns (all, or the listed ones) at the edge of a query.

    Only results whose value depends on summation order (averages, sums of
    doubles) need it; exact arithmetic on identical inputs is left alone.
    """
    wanted = None if cols is None else set(cols)
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (wanted is None or f.name in wanted):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def fixed(x: Column, digits: int) -> Column:
    """``x`` printed with ``digits`` decimals: ``floor(|x| * 10^d + 0.5)``, half
    up on the value scaled in floating point.  Values within a rounding error
    of a tie can differ in the last digit from C/Python printf, which rounds
    the exact binary value (2.675 prints 2.68 here, 2.67 there); the SQL twin
    uses the same expression, so both engines agree exactly."""
    scale = float(10 ** digits)
    scaled = F.abs(x) * F.lit(scale)
    # beyond 2^53 a double has no fraction left to round (and floor's long
    # result would overflow)
    rounded = F.when(scaled < F.lit(9.0e15), F.floor(scaled + F.lit(0.5)) / F.lit(scale)).otherwise(F.abs(x))
    # beyond 38 digits the decimal form does not exist: fall back to printf
    mag = F.coalesce(rounded.try_cast(T.DecimalType(38, digits)).cast("string"),
                     F.format_string(f"%.{digits}f", rounded))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), mag)


def signed_fixed(x: Column, digits: int) -> Column:
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("+")), fixed(F.abs(x), digits))


def _bands(x: Column, bands, otherwise: str) -> Column:
    expr = None
    for limit, word in bands:
        expr = F.when(x >= limit, word) if expr is None else expr.when(x >= limit, word)
    return expr.otherwise(otherwise)


def confidence_band(*probs: Column) -> Column:
    """Band of the largest class probability (limits and words in agewise.fixed)."""
    return _bands(F.greatest(*probs), FX.CONFIDENCE_BANDS, FX.CONFIDENCE_ELSE)


def risk_band(p: Column) -> Column:
    """Risk words from the probability of reaching the outcome."""
    return _bands(p, FX.RISK_BANDS, FX.RISK_ELSE)


def signal_direction(delta: Column) -> Column:
    """Direction word of a change: missing or zero is flat."""
    return (F.when(delta.isNull() | F.isnan(delta), FX.SIGNAL_FLAT)
            .when(delta > 0, FX.SIGNAL_UP)
            .when(delta < 0, FX.SIGNAL_DOWN)
            .otherwise(FX.SIGNAL_FLAT))


def lookup(mapping: dict, key: Column, default: str | None = None) -> Column:
    """Small fixed dictionary lookup as a literal map (no join)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = F.try_element_at(m, key)
    return F.coalesce(out, F.lit(default)) if default is not None else out
