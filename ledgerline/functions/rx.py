"""Scalar extraction functions (Column in, Column out).

Every function here is a composition of built-in Spark expressions, so it
runs inside whole-stage codegen with no Python worker. Patterns are searched
anywhere in the text (first match), like a regex *search*.

Regex dialect: patterns are prefixed with ``(?U)`` so that ``\\d \\w \\s \\D``
are Unicode-aware (a no-break space between a label and an amount must still
count as whitespace). ``regexp_extract`` returns '' for no match or for an
optional group that did not take part; ``rx`` turns that into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import MONEY

# ---------------------------------------------------------------------------
# Three-letter month prefixes and their numbers.
MONTH_PREFIX = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
# English month names, used when rendering pages.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]
# ---------------------------------------------------------------------------



def _month_map() -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in MONTH_PREFIX.items()) + ")")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(text, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` in ``text``, capture ``group``; NULL if absent."""
    return F.nullif(F.regexp_extract(_col(text), "(?U)" + pattern, group), F.lit(""))


def month_number(name) -> Column:
    """Month name (any length >= 3, any case) -> 1..12, NULL if unknown."""
    return F.try_element_at(_month_map(), F.lower(F.substring(_col(name), 1, 3)))


long_month_number = month_number


def to_int(s) -> Column:
    return _col(s).try_cast("int")


def to_decimal(amount) -> Column:
    """Drop thousands commas, round to 2 places half-up; NULL if not a number."""
    return F.regexp_replace(_col(amount), ",", "").try_cast(MONEY)


def account_number(text, pattern: str, group: int = 1) -> Column:
    """Capture group with spaces removed; NULL when absent or empty."""
    return F.nullif(F.replace(rx(text, pattern, group), F.lit(" "), F.lit("")), F.lit(""))


def unmask(account) -> Column:
    """Drop mask stars from an account number."""
    return F.replace(_col(account), F.lit("*"), F.lit(""))


def make_date(d: Column, m: Column, y: Column) -> Column:
    """Date struct {d, m, y}; NULL unless all three parts are present."""
    return F.when(d.isNotNull() & m.isNotNull() & y.isNotNull(),
                  F.struct(d.alias("d"), m.alias("m"), y.alias("y")))


def date3(text, pattern: str) -> Column:
    """Groups (month name, day, year) -> {d, m, y}; NULL when no match."""
    return make_date(to_int(rx(text, pattern, 2)), month_number(rx(text, pattern, 1)),
                     to_int(rx(text, pattern, 3)))


def date2(text, pattern: str, year) -> Column:
    """Groups (month name, day) plus a supplied year Column."""
    y = year if isinstance(year, Column) else F.lit(year)
    return make_date(to_int(rx(text, pattern, 2)), month_number(rx(text, pattern, 1)), y.cast("int"))


def money(text, pattern: str, group: int = 1) -> Column:
    """Amount of a capture group, sign in the text is not seen."""
    return to_decimal(rx(text, pattern, group))


def signed_money(text, pattern: str, marker: str, amount_group: int = 2,
                 marker_group: int = 1) -> Column:
    """Amount, negated when the marker group equals ``marker`` ('-', 'CR', ...)."""
    amt = money(text, pattern, amount_group)
    neg = F.coalesce(rx(text, pattern, marker_group) == F.lit(marker), F.lit(False))
    return F.when(neg, -amt).otherwise(amt)


def date_pair(text, general: str, short: str) -> tuple[Column, Column]:
    """Two dates from groups 1 and 2 of ``general``; both or neither."""
    sd = date3(rx(text, general, 1), short)
    ed = date3(rx(text, general, 2), short)
    both = sd.isNotNull() & ed.isNotNull()
    return F.when(both, sd), F.when(both, ed)


def date_pair_shared_year(text, full: str, short_start: str, date_pat: str,
                          start_pat: str, short_text=None) -> tuple[Column, Column]:
    """Full dates on both sides, else the start takes the end's year.
    ``short_text``: where the short form is searched, if not in ``text``."""
    text, short_text = _col(text), _col(text if short_text is None else short_text)
    f_sd, f_ed = date_pair(text, full, date_pat)
    s_ed = date3(rx(short_text, short_start, 2), date_pat)
    s_sd = date2(rx(short_text, short_start, 1), start_pat, s_ed.getField("y"))
    full_ok = rx(text, full, 1).isNotNull()
    return (F.when(full_ok, f_sd).otherwise(s_sd), F.when(full_ok, f_ed).otherwise(s_ed))


def period_parts(period, pattern: str) -> Column:
    """The six parts of a printed period, each searched once: start month, day and year, end month, day and year."""
    names = ("m0", "d0", "y0", "m1", "d1", "y1")
    return F.struct(*[rx(period, pattern, g).alias(n) for g, n in enumerate(names, 1)])


def period_dates(parts) -> tuple[Column, Column]:
    """X10 over ``period_parts``: both dates or neither; a start without a year takes the end's."""
    part = _col(parts).getField
    year = to_int(part("y1"))
    start = make_date(to_int(part("d0")), month_number(part("m0")), F.when(part("y0").isNull(), year).otherwise(to_int(part("y0"))))
    end = make_date(to_int(part("d1")), month_number(part("m1")), year)
    both = start.isNotNull() & end.isNotNull()
    return F.when(both, start), F.when(both, end)


def page_number(text, pattern: str, group: int = 1) -> Column:
    """X11: integer page number from a capture group, NULL if absent."""
    return to_int(rx(text, pattern, group))


def close_to(a, b, epsilon: float = 0.01) -> Column:
    """|a - b| < epsilon (strict)."""
    return F.abs(_col(a) - _col(b)) < F.lit(epsilon)


def not_contains(text, needle: str) -> Column:
    """Case-sensitive substring absence."""
    return ~F.contains(_col(text), F.lit(needle))


def default_zero(c) -> Column:
    """Missing amount counts as zero."""
    return F.coalesce(_col(c), F.lit(0).cast(MONEY))


def fmt_money(x) -> Column:
    """Render an amount as the statements print it: '-$1,234.50' / '$0.00'."""
    x = _col(x)
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"),
                    F.format_number(F.abs(x), 2))


def fmt_amount(x) -> Column:
    """Unsigned amount with thousands commas: '1,234.50'."""
    return F.format_number(F.abs(_col(x)), 2)


def month_name(month) -> Column:
    return F.element_at(F.expr("array(" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + ")"), _col(month))


def fmt_long_date(d) -> Column:
    """'December 8, 2020'."""
    d = _col(d)
    return F.concat(month_name(F.month(d)), F.lit(" "), F.dayofmonth(d).cast("string"),
                    F.lit(", "), F.year(d).cast("string"))
