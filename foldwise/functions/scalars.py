"""Scalar expressions. All of them are Catalyst expressions, none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Missing tokens, label tokens, numeric tolerances, normal quantile for 95 %.
MISSING_TOKENS = ("", "na", "n/a")
POSITIVE_TOKENS = ("responder", "response", "r", "positive")
NEGATIVE_TOKENS = ("non-responder", "nonresponder", "nr", "negative")
ABS_TOL, REL_TOL = 1e-12, 1e-10
Z95 = 1.959963984540054


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_name(x: Column | str) -> Column:
    """Trimmed, inner white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(x), r"\s+", " ")))


def clean_key(x: Column | str) -> Column:
    return F.lower(F.trim(col(x)))


def clean_id(x: Column | str) -> Column:
    """Integral decimals lose their fraction, other text is trimmed, leading zeros in text survive."""
    text = F.trim(col(x))
    return F.when(text.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def is_missing_token(x: Column | str) -> Column:
    return F.lower(F.trim(col(x))).isin(*MISSING_TOKENS)


def parse_number(x: Column | str) -> Column:
    """Text to double; missing tokens, unparsable text, NaN and infinities become NULL."""
    number = F.trim(col(x)).try_cast("double")
    return F.when(~is_missing_token(x) & finite(number), number)


def parse_label(x: Column | str) -> Column:
    """0/1 from numbers, booleans and class tokens; underscores count as hyphens; else NULL."""
    token = F.regexp_replace(clean_name(x), "_", "-")
    number = token.try_cast("double")
    return (
        F.when(token.isin(*POSITIVE_TOKENS, "true"), 1)
        .when(token.isin(*NEGATIVE_TOKENS, "false"), 0)
        .when(number == 1.0, 1)
        .when(number == 0.0, 0)
    )


def parse_bool(x: Column | str) -> Column:
    token = F.lower(F.trim(col(x)))
    return F.when(token == "true", True).when(token == "false", False)


def exact_integer(x: Column | str) -> Column:
    """Text to bigint only when no fraction would be lost; else NULL."""
    number = F.trim(col(x)).try_cast("double")
    return F.when(finite(number) & (number == F.floor(number)), number.try_cast("bigint"))


def finite(x: Column | str) -> Column:
    c = col(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def is_probability(x: Column | str) -> Column:
    c = col(x)
    return finite(c) & c.between(0.0, 1.0)


def is_strict_probability(x: Column | str) -> Column:
    c = col(x)
    return finite(c) & (c > 0.0) & (c < 1.0)


def transform_value(v: Column | str, transform: Column | str) -> Column:
    """log1p or identity; a negative value under log1p gives NULL, never an error mid-job."""
    v, transform = col(v), col(transform)
    return F.when(transform == "log1p", F.when(v >= 0, F.log1p(v))).otherwise(v)


def logit(p: Column | str) -> Column:
    p = col(p)
    return F.when(is_strict_probability(p), F.log(p / (F.lit(1.0) - p)))


def expit(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def prior_adjusted(p: Column | str, positive: Column | str, negative: Column | str) -> Column:
    """Undo balanced class weights: shift the log odds by the training fold's ln(n1/n0)."""
    return expit(logit(p) + F.log(col(positive) / col(negative)))


def close(a: Column | str, b: Column | str) -> Column:
    """Equal within 1e-12 absolute plus 1e-10 relative; two NULLs are equal, one is not."""
    a, b = col(a), col(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(
        F.abs(a - b) <= F.lit(ABS_TOL) + F.lit(REL_TOL) * F.abs(b)
    )


def wilson(positive: Column | str, n: Column | str) -> tuple[Column, Column]:
    """Wilson 95 % bounds from exact counts, clipped to [0, 1]."""
    n = col(n).cast("double")
    share = col(positive) / n
    scale = 1 + Z95 * Z95 / n
    centre = (share + Z95 * Z95 / (2 * n)) / scale
    half = Z95 * F.sqrt(share * (1 - share) / n + Z95 * Z95 / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def digest(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by '|': the portable source of every random order and draw."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1) from the first six hex digits of the digest."""
    return F.conv(F.substring(digest(*parts), 1, 6), 16, 10).cast("double") / 16777216.0


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, NULL for a zero denominator."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))
