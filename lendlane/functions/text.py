"""Column helpers for text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: every character that counts as white space at the ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clamp_text(c: Column, limit: int = 120) -> Column:
    """NULL becomes empty; otherwise the first `limit` characters of the trimmed text."""
    return F.substring(strip(F.coalesce(c, F.lit(""))), 1, limit)


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), ""
    )


def whole(x: Column) -> Column:
    """Drop the fraction of a double, keeping it a double (no overflow for large values)."""
    return x - x % F.lit(1.0)


def grouped(x: Column) -> Column:
    """Thousands-grouped integer part, e.g. 1234567 -> 1,234,567."""
    return F.format_number(whole(x.cast("double")), 0)


def plain_number(x: Column) -> Column:
    """Integral values without a fraction, others with theirs; never in scientific notation below 9e18."""
    integral = (x == F.floor(x).cast("double")) & (F.abs(x) < F.lit(9e18))
    scientific = (F.abs(x) >= F.lit(1e7)) | (F.abs(x) < F.lit(1e-3))
    spelled_out = F.regexp_replace(x.try_cast("decimal(38,15)").cast("string"), "0+$", "")
    return (
        F.when(integral, x.try_cast("bigint").cast("string"))
        .when(scientific, F.coalesce(spelled_out, x.cast("string")))
        .otherwise(x.cast("string"))
    )


def grouped_number(x: Column) -> Column:
    """Thousands-grouped; a fraction, if there is one, is kept behind the grouped part."""
    text = plain_number(x)
    fraction = F.regexp_extract(text, r"(\.[0-9]+)$", 1)
    return F.concat(grouped(x), fraction)


def bullets(items: Column, prefix: str, when_empty: str = "") -> Column:
    """One line per item, each behind `prefix`."""
    lines = F.array_join(F.transform(items, lambda i: F.concat(F.lit(prefix), i)), "\n")
    return F.when(F.size(items) > 0, lines).otherwise(F.lit(when_empty))


def present(*candidates: Column) -> Column:
    """Array of the candidates that are not NULL, in the order given.

    Put together from arrays of one or none rather than filtered with a lambda:
    lambdas are interpreted row by row, this is compiled.
    """
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(c.isNotNull(), F.array(c)).otherwise(none) for c in candidates])


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def quoted(c: Column) -> Column:
    """Text in single quotes; double quotes where the text holds only single ones."""
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    only_single = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(c.isNull(), F.lit("None")).when(
        only_single, F.concat(F.lit('"'), escaped, F.lit('"'))
    ).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def quoted_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))
