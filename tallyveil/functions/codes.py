"""Cleaning of area codes, counts, weights, identifiers and cited numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms, in order.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"

# Identifier prefixes removed one after the other.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi.org/", "doi:")

MAX_EVENTS_PER_RECORD = 50  # fixed value: larger multiplicities are treated as 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_space(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def zero_pad(c: Column | str, width: int = 6) -> Column:
    """Left-pad with zeros; a longer code is kept whole (bare ``lpad`` would cut it)."""
    text = _col(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def compose_area(department: Column, province: Column, district: Column) -> Column:
    """Six-digit area code; NULL as soon as one part is NULL."""
    return F.concat(*[zero_pad(p.cast("bigint"), 2) for p in (department, province, district)])


def strict_int(c: Column | str) -> Column:
    """Digits only, otherwise NULL (signs, decimals and blanks are refused)."""
    text = strip_space(c)
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def comma_decimal(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(","), F.lit(".")).try_cast("double")


def weight_or_null(c: Column | str) -> Column:
    """Survey weight with a decimal comma; unreadable, zero or negative becomes NULL."""
    value = comma_decimal(c)
    return F.when(value > 0, value)


def weight_or_zero(c: Column | str) -> Column:
    """The other rule for weights: an unreadable weight counts as zero, the row stays."""
    return F.coalesce(comma_decimal(c), F.lit(0.0))


def fold_text(c: Column | str) -> Column:
    """Lower case, accents removed, outer white space removed."""
    return strip_space(F.translate(F.lower(_col(c)), ACCENTED, PLAIN))


def event_multiplicity(raw: Column) -> Column:
    """Events behind one record: 1..50 as given, anything else counts as one."""
    return F.when(raw.between(1, MAX_EVENTS_PER_RECORD), raw).otherwise(F.lit(1).cast("bigint"))


def capped_subcount(raw: Column, multiplicity: Column, fallback: Column) -> Column:
    """Sub-count limited by the multiplicity; a missing one falls back to the binary flag."""
    return F.least(F.coalesce(raw, fallback.cast("bigint")), multiplicity)


def normalise_doi(c: Column | str) -> Column:
    text = strip_space(F.lower(_col(c)))
    for prefix in DOI_PREFIXES:
        text = F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
    return strip_space(text)


def canonical_round(c: Column | str, decimals: int, mode: str = "half_up") -> Column:
    """Round the decimal text of a number to at most 18 decimals: ``half_up``, ``half_even`` or ``floor``."""
    exact = _col(c).cast("string").cast("decimal(38,18)")
    if mode == "half_up":
        rounded = F.round(exact, decimals)
    elif mode == "half_even":
        rounded = F.bround(exact, decimals)
    elif mode == "floor":
        rounded = F.floor(exact, F.lit(decimals))
    else:
        raise ValueError(f"unknown rounding mode {mode!r}")
    return rounded.cast(f"decimal({20 + decimals},{decimals})")


def canonical_display(c: Column | str, decimals: int, mode: str = "half_up") -> Column:
    return canonical_round(c, decimals, mode).cast("string")


def parse_cited(c: Column | str) -> Column:
    """Numeral as written in a text: multiplication signs and tildes are stripped;
    commas count as thousands separators only when a decimal point is present."""
    text = F.regexp_replace(strip_space(c), r"^[×xX~]+", "")
    text = F.replace(text, F.lit(" "), F.lit(""))
    both = F.contains(text, F.lit(",")) & F.contains(text, F.lit("."))
    text = F.when(both, F.replace(text, F.lit(","), F.lit(""))).otherwise(text)
    return F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast("decimal(38,18)"))


def cited_decimals(c: Column | str) -> Column:
    text = F.regexp_extract(_col(c), r"\.([0-9]+)\s*$", 1)
    return F.length(text).cast("bigint")


def per_100k(value: Column, population: Column) -> Column:
    """Rate per 100,000; NULL where the population is missing or zero."""
    return F.when(population > 0, value / population * F.lit(1e5))


def log_target(c: Column | str) -> Column:
    return F.log1p(_col(c))


def back_transform(c: Column | str) -> Column:
    return F.expm1(F.greatest(_col(c), F.lit(0.0)))


def finite_pair(x: Column, y: Column) -> Column:
    inf = float("inf")

    def ok(c: Column) -> Column:
        d = c.cast("double")
        return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(inf))

    return ok(x) & ok(y)


def salton(shared: Column, left: Column, right: Column) -> Column:
    """Shared items over the geometric mean of both list lengths; zero if a list is empty."""
    return F.when((left > 0) & (right > 0), shared / (F.sqrt(left * right) + F.lit(1e-9))).otherwise(F.lit(0.0))
