"""Column expressions.  All are built-in Spark expressions (no Python UDF),
so they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from aqlens import constants as K

MISSING_TEXT = K.MISSING_TEXT
# The feed's own layout is tried first; the grammar reads all others.
FEED_TIME_FORMAT = "d-M-yyyy H:m:s"
# day, month and year (or year, month, day); then time, half of the day and zone
TIME_GRAMMAR = (
    r"^([0-9]{1,2}|[0-9]{4})(?:[-/. ]|, ?)+([0-9]{1,2}|[A-Za-z]{3,9})(?:[-/. ]|, ?)+([0-9]{4}|[0-9]{1,2})"
    r"(?:[T ,]+([0-9]{1,2})[:.]([0-9]{2})(?:[:.]([0-9]{2})(?:[.,]([0-9]{1,6})[0-9]*)?)?"
    r" ?(?:([AaPp])\.?[Mm]\.?)? ?([Zz]|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
MONTHS = "january february march april may june july august september october november december".split()
# Two-digit years below this belong to the 2000s.
CENTURY_CUT = 69


def lookup(key: Column, mapping: Mapping, default=None) -> Column:
    """Map literal as a CASE chain (null, or ``default``, when absent)."""
    items = list(mapping.items())
    if not items:
        return F.lit(default)
    expr = F.when(key == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def clean_name(name: str) -> str:
    """Header cleaning: strip blanks and zero-width characters."""
    return name.strip().replace("\u200b", "").replace("\ufeff", "")


def strip_text(c: Column) -> Column:
    """trim + drop zero-width characters (``translate`` deletes them by
    character mapping, cheaper per row than a regular expression)."""
    return F.trim(F.translate(c, "\u200b\ufeff", ""))


def finite(c: Column) -> Column:
    """NaN and +-inf become null (Spark orders NaN above every number)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def to_number(c: Column) -> Column:
    """Numeric coercion, bad text -> null."""
    return finite(c.try_cast("double"))


def parse_float(c: Column, missing_as_zero: bool = False) -> Column:
    """Reading text to double: None, '', 'NA', 'N/A' and unparsable text are
    missing.  Missing is null by default, or 0 (``missing_as_zero``)."""
    t = strip_text(c.cast("string"))
    v = F.when(t.isin(*MISSING_TEXT), F.lit(None).cast("double")).otherwise(to_number(t))
    return F.coalesce(v, F.lit(0.0)) if missing_as_zero else v


def parse_reading_time(c: Column) -> Column:
    """Day-first timestamp text to timestamp; bad text -> null.

    Beside the feed's own layout: '-', '/', '.' or blanks between day, month
    and year, month names, two-digit years, ISO order, a time with or without
    seconds, fractions, AM/PM, and a zone (Z, UTC, GMT, +hh:mm).  Without a zone
    a time is one of the session's zone; a zone fixes the instant."""
    t = F.trim(F.regexp_replace(strip_text(c), r"\s+", " "))
    return F.coalesce(F.try_to_timestamp(F.translate(t, "/", "-"), F.lit(FEED_TIME_FORMAT)), _time_by_grammar(t))


def _time_by_grammar(t: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(t, TIME_GRAMMAR, k), F.lit(""))
    number = lambda k: part(k).try_cast("int")
    year_first = F.length(part(1)) == 4
    year, year_text = F.when(year_first, number(1)).otherwise(number(3)), F.when(year_first, part(1)).otherwise(part(3))
    year = F.when(F.length(year_text) == 4, year).when(
        F.length(year_text) == 2, year + F.when(year < CENTURY_CUT, F.lit(2000)).otherwise(F.lit(1900))
    )
    names = {name: k for k, m in enumerate(MONTHS, 1) for name in {m, m[:3], *(["sept"] if m == "september" else [])}}
    month = F.coalesce(number(2), lookup(F.lower(part(2)), names))
    day = F.when(year_first, number(3)).otherwise(number(1))
    half = F.lower(part(8))
    hour = F.when(half.isNull(), F.coalesce(number(4), F.lit(0))).when(
        number(4).between(1, 12), number(4) % 12 + F.when(half == "p", F.lit(12)).otherwise(F.lit(0))
    )
    second = F.concat(F.coalesce(part(6), F.lit("0")), F.lit("."), F.coalesce(part(7), F.lit("0"))).try_cast("decimal(16,6)")
    zone = F.upper(part(9))
    zone = F.when(zone == "Z", F.lit("UTC")).otherwise(F.regexp_replace(zone, r"^([+-][0-9]{2}):?([0-9]{2})$", r"$1:$2"))
    parts = (year, month, day, hour, F.coalesce(number(5), F.lit(0)), second)
    return F.when(zone.isNull(), F.try_make_timestamp(*parts)).otherwise(F.try_make_timestamp(*parts, zone))


def canonical_pollutant(raw: Column) -> Column:
    """Alias look-up on the upper-cased id; unknown ids keep their own name."""
    t = strip_text(raw)
    return F.coalesce(lookup(F.upper(t), K.POLLUTANT_ALIASES), t)


def season_index(month: Column) -> Column:
    """1 Winter (Dec-Feb), 2 Spring, 3 Summer, 4 Fall."""
    return F.floor((F.pmod(month, F.lit(12)) + 3) / 3).cast("int")


def season_name(month: Column) -> Column:
    return lookup(season_index(month), K.SEASON_NAMES)


def season_code(month: Column) -> Column:
    """Alphabetical season code (Fall 0, Spring 1, Summer 2, Winter 3), the
    training encoding; one encoding for training and scoring."""
    order = {name: i for i, name in enumerate(sorted(K.SEASON_NAMES.values()))}
    return lookup(season_name(month), order).cast("int")


def _by_category(aqi: Column, pick: int) -> Column:
    expr = None
    for upper, *labels in K.AQI_CATEGORIES:
        value = F.lit(labels[pick])
        if upper is None:
            expr = expr.when(aqi.isNotNull(), value)
        elif expr is None:
            expr = F.when(aqi <= upper, value)
        else:
            expr = expr.when(aqi <= upper, value)
    return expr


def aqi_category(aqi: Column) -> Column:
    """Good .. Severe; null AQI -> null."""
    return _by_category(aqi, 0)


def health_message(aqi: Column) -> Column:
    return _by_category(aqi, 1)


def category_colour(aqi: Column) -> Column:
    return _by_category(aqi, 2)


def pollutant_unit(pollutant: Column) -> Column:
    return lookup(pollutant, K.POLLUTANT_UNITS, default="")


def sub_index_for(pollutant: str, conc: Column) -> Column:
    """Sub-index of one pollutant: first bin with lo < c <= hi (c > 0),
    linear interpolation, truncated; above the last bin the index is 401.
    Null when c is null or <= 0 or the pollutant has no breakpoints."""
    bins = K.AQI_BREAKPOINTS.get(pollutant)
    if bins is None:
        return F.lit(None).cast("int")
    expr = F.when(conc.isNull() | (conc <= 0), F.lit(None).cast("int"))
    for lo, hi, alo, ahi in bins:
        slope = (ahi - alo) / (hi - lo)
        expr = expr.when(conc <= F.lit(float(hi)), (F.lit(slope) * (conc - F.lit(float(lo))) + F.lit(float(alo))).cast("int"))
    return expr.otherwise(F.lit(K.TOP_BIN_AQI))


def _dlit(x: float) -> str:
    """Spark SQL double literal that parses to exactly ``float(x)``."""
    return f"{float(x)!r}D"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sub_index_sql(pollutant: str, conc: str) -> str:
    """Spark SQL text of ``sub_index_for`` over the column named ``conc``."""
    bins = K.AQI_BREAKPOINTS.get(pollutant)
    if bins is None:
        return "CAST(NULL AS INT)"
    c = _ident(conc)
    parts = [f"WHEN {c} IS NULL OR {c} <= 0 THEN CAST(NULL AS INT)"]
    for lo, hi, alo, ahi in bins:
        slope = (ahi - alo) / (hi - lo)
        parts.append(f"WHEN {c} <= {_dlit(hi)} THEN CAST({_dlit(slope)} * ({c} - {_dlit(lo)}) + {_dlit(alo)} AS INT)")
    return "CASE " + " ".join(parts) + f" ELSE {K.TOP_BIN_AQI} END"


def sub_index_by_name(pollutant: str, conc: str) -> Column:
    """``sub_index`` for column names, built as one SQL expression (one call
    to the JVM instead of hundreds; the same Catalyst expression)."""
    p = _ident(pollutant)
    parts = " ".join(f"WHEN {p} = '{name}' THEN {sub_index_sql(name, conc)}" for name in K.AQI_BREAKPOINTS)
    return F.expr(f"CASE {parts} END")


def sub_index(pollutant: Column, conc: Column) -> Column:
    """Long form: sub-index by a pollutant column (generated CASE)."""
    expr = None
    for p in K.AQI_BREAKPOINTS:
        branch = sub_index_for(p, conc)
        expr = F.when(pollutant == p, branch) if expr is None else expr.when(pollutant == p, branch)
    return expr


def overall_aqi_wide(cols: Mapping[str, Column | str]) -> Column:
    """Wide form: max of the sub-indices of the given pollutants; none -> 50.
    Values may be column names (one SQL expression) or Columns."""
    if all(isinstance(c, str) for c in cols.values()):
        subs = [sub_index_sql(p, c) for p, c in cols.items() if p in K.AQI_BREAKPOINTS]
        inner = f"greatest({', '.join(subs)})" if len(subs) > 1 else subs[0]
        return F.expr(f"coalesce({inner}, {K.AQI_WHEN_NO_POLLUTANT})")
    subs = [sub_index_for(p, c) for p, c in cols.items() if p in K.AQI_BREAKPOINTS]
    return F.coalesce(F.greatest(*subs), F.lit(K.AQI_WHEN_NO_POLLUTANT)) if len(subs) > 1 else F.coalesce(subs[0], F.lit(K.AQI_WHEN_NO_POLLUTANT))


def linear_estimate(pm25: Column) -> Column:
    """PM2.5-only AQI estimate."""
    return F.lit(K.LINEAR_SLOPE) * pm25 + F.lit(K.LINEAR_INTERCEPT)


def expected_range(pm25: Column) -> tuple[Column, Column]:
    """(low, high) expected AQI for a PM2.5 level."""
    lo = hi = None
    for upper, elo, ehi in K.SANITY_RANGES:
        if upper is None:
            lo, hi = lo.otherwise(F.lit(elo)), hi.otherwise(F.lit(ehi))
        elif lo is None:
            lo, hi = F.when(pm25 <= upper, F.lit(elo)), F.when(pm25 <= upper, F.lit(ehi))
        else:
            lo, hi = lo.when(pm25 <= upper, F.lit(elo)), hi.when(pm25 <= upper, F.lit(ehi))
    return lo, hi


EXACT_DECIMAL = "decimal(38,10)"
EXACT_LIMIT = 1e15


def exact_avg(c: Column | str) -> Column:
    """Mean with an exact decimal sum (10 decimals), returned as double.

    A double sum depends on the order rows meet in, which depends on the
    partitioning; a decimal sum does not, so a mean that is exactly 39.0 (a
    sub-index boundary) or a rounding tie comes out the same on every run,
    cluster size and engine.  The sum holds 28 integer digits; a group with a
    value beyond EXACT_LIMIT gets the mean of the doubles instead."""
    col = F.col(c) if isinstance(c, str) else c
    fits = F.abs(col) <= EXACT_LIMIT
    exact = F.avg(F.when(fits, col.cast("double")).try_cast(EXACT_DECIMAL)).cast("double")
    return F.when(F.max(F.abs(col)) <= EXACT_LIMIT, exact).otherwise(F.avg(col.cast("double")))


def hsum(cols: list[Column]) -> Column:
    """Horizontal sum, nulls counted as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])


def safe_pct(num: Column, den: Column) -> Column:
    """num / den * 100 with 0/0 (and x/0) -> 0."""
    return F.coalesce(F.try_divide(num, den) * 100, F.lit(0.0))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def rnd(c: Column, digits: int = 6) -> Column:
    """Round half up as floor(x * 10^d + 0.5) / 10^d.  Written the same way in
    the SQL oracle so equal inputs round equally in both engines."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
