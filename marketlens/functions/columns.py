"""Scalar and aggregate column helpers.

Every helper returns a ``pyspark.sql.Column`` built from built-in functions,
so expressions stay inside whole-stage codegen.  The rules they implement are
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "clean_str", "zip5", "try_int", "try_dec", "try_ts", "left_str",
    "days_between", "month_start", "late_by_day", "late_by_time", "weekday0",
    "money", "msum", "msum_nullable", "avg6", "ratio", "pct", "safe_div",
    "category_label", "plus_days",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------- cleaning

def clean_str(c) -> Column:
    """Trim both sides; blank or empty -> NULL."""
    return F.nullif(F.trim(col_(c)), F.lit(""))


def zip5(c) -> Column:
    """R2: rightmost five characters of '00000' || zip (not lpad)."""
    return F.right(F.concat(F.lit("00000"), clean_str(c)), F.lit(5))


_INT_RE = r"^[+-]?[0-9]+$"
_DEC_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
_TS_RE = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})([ T]([0-9]{1,2}):([0-9]{2})(:([0-9]{2})([.][0-9]+)?)?)?$"


def try_int(c) -> Column:
    """Integer text -> int, anything else (incl. '12.0', '1e3', overflow) -> NULL."""
    s = clean_str(c)
    return F.when(s.rlike(_INT_RE), s.try_cast("int"))


def try_dec(c, precision: int = 18, scale: int = 2) -> Column:
    """Plain decimal text -> decimal(p,s) (rounded half up); exponents -> NULL."""
    s = clean_str(c)
    return F.when(s.rlike(_DEC_RE), s.try_cast(f"decimal({precision},{scale})"))


def try_ts(c) -> Column:
    """R3: 'yyyy-MM-dd[ HH:mm[:ss[.f]]]' -> timestamp_ntz in whole seconds, half up; invalid dates -> NULL.

    The shape is checked first (a bare year such as '2018' is rejected), then
    ``try_cast`` to ``timestamp_ntz`` turns impossible dates into NULL; no
    session time zone is involved and nothing raises under ANSI mode.
    """
    s = clean_str(c)
    # most texts have no fraction, and need no pattern for it
    fraction = s.contains(".")
    whole = F.when(fraction, F.regexp_replace(s, "[.][0-9]+$", "")).otherwise(s).try_cast("timestamp_ntz")
    up = F.when(fraction & s.rlike("[.][5-9][0-9]*$"), 1).otherwise(0)
    return F.when(s.rlike(_TS_RE), F.timestamp_add("SECOND", up, whole))


def left_str(c, n: int) -> Column:
    return F.left(clean_str(c), F.lit(n))


# ----------------------------------------------------------------- dates

def days_between(start, end) -> Column:
    """DATEDIFF(DAY, start, end) = midnights crossed, sign end - start."""
    return F.datediff(col_(end), col_(start))


def month_start(ts) -> Column:
    return F.trunc(col_(ts), "MM")


def late_by_day(delivered, estimated) -> Column:
    """R6 (view grain): 1 when the delivery *date* is after the estimated date."""
    d, e = col_(delivered), col_(estimated)
    return F.when(d.isNotNull() & e.isNotNull() & (F.to_date(d) > F.to_date(e)), 1).otherwise(0)


def late_by_time(delivered, estimated) -> Column:
    """R6 (timestamp grain): delivered strictly after the estimated timestamp."""
    return col_(delivered) > col_(estimated)


def weekday0(ts) -> Column:
    """0 = Monday .. 6 = Sunday, independent of locale settings."""
    return F.weekday(col_(ts))


def plus_days(ts, n) -> Column:
    return F.timestamp_add("DAY", n if isinstance(n, Column) else F.lit(n), col_(ts))


# ------------------------------------------------------- money and exact averages

def money(c) -> Column:
    """Sum input type: decimal(38,2) so totals at 100 TB scale cannot overflow."""
    return col_(c).cast("decimal(38,2)")


def msum(c) -> Column:
    """SUM(ISNULL(x, 0)): 0 when every value is NULL (foundations, V01/V02/V05)."""
    return F.sum(money(F.coalesce(col_(c), F.lit(0))))


def msum_nullable(c) -> Column:
    """SUM(x): NULL when every value is unknown ("unknown is not 0", C09/B02/B03)."""
    return F.sum(money(c))


def avg6(c, scale: int = 0) -> Column:
    """AVG(CAST(x AS DECIMAL(p, scale))) as an exact decimal(38,6), half up.

    The reference averages decimals, whose result has six fractional digits.
    We sum exactly and divide once, so the value does not depend on the order
    rows arrive in (unlike a DOUBLE average) and equals the exact quotient
    rounded half up to six digits.
    """
    x = col_(c)
    return (F.sum(x.cast(f"decimal(38,{scale})")) / F.nullif(F.count(x), F.lit(0))).cast("decimal(38,6)")


def safe_div(n, d) -> Column:
    """X / NULLIF(d, 0)."""
    return col_(n) / F.nullif(col_(d), F.lit(0))


def ratio(n, d, scale: int = 4) -> Column:
    """Exact decimal ratio n / d rounded half up to ``scale`` digits; NULL when d = 0."""
    return F.round(safe_div(col_(n).cast("decimal(38,2)"), col_(d).cast("decimal(38,2)")), scale) \
        .cast(f"decimal(38,{scale})")


def pct(n, d, scale: int = 2) -> Column:
    """Exact ROUND(n * 100 / NULLIF(d, 0), scale) as decimal(38, scale)."""
    num = col_(n).cast("decimal(38,4)") * F.lit(100)
    return F.round(safe_div(num.cast("decimal(38,4)"), col_(d).cast("decimal(38,4)")), scale) \
        .cast(f"decimal(38,{scale})")


# ------------------------------------------------------------------------- labels

def category_label(english, native, default: str) -> Column:
    return F.coalesce(col_(english), col_(native), F.lit(default))


def ordered_list(value: str, *order: str, sep: str = ", ") -> Column:
    """The values of a group as one text, in the order of other columns (``STRING_AGG ... WITHIN GROUP``)."""
    return F.expr(f"listagg({value}, '{sep}') WITHIN GROUP (ORDER BY {', '.join(order)})")
