"""Text rendering as column expressions (no UDFs).

Numbers in report texts are printed from exact integer arithmetic so that the
result does not depend on the engine's float formatter: :func:`fixed2` prints a
value given as an exact fraction of hundredths with two decimals, rounding half
to even like C's printf on an exact value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column, b: Column) -> Column:
    """Integer division truncating toward zero (SQL ``a div b``)."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def lpad_keep(s: Column, width: int) -> Column:
    """Right-align to ``width`` like printf's %Nd / %N.2f (never truncates)."""
    return F.when(F.length(s) < width, F.lpad(s, width, " ")).otherwise(s)


def fixed2(num: Column, den: Column) -> Column:
    """Two-decimal text of ``num / den`` hundredths; NULL when den is 0/NULL."""
    a = F.abs(num).cast("bigint")
    d = F.when(den != 0, F.abs(den).cast("bigint"))
    q = idiv(a, d)
    r = a - q * d
    n = q + F.when((r * 2 > d) | ((r * 2 == d) & (q % 2 == 1)), 1).otherwise(0)
    neg = ((num < 0) != (den < 0)) & (num != 0)
    body = F.concat(idiv(n, F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(d.isNull(), F.lit(None).cast("string")) \
            .otherwise(F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), body))


def pct2(num: Column, den: Column) -> Column:
    """``printf('%.2f', 100.0 * num / den)`` for integer num, den."""
    return fixed2(num * 10000, den)


def slurm_time(seconds: Column) -> Column:
    """SLURM duration text ``[Y-]D-HH:MM:SS`` of a non-negative number of seconds (UTC)."""
    s = seconds.cast("bigint")
    days = idiv(s, F.lit(86400))
    day = F.date_from_unix_date(days.cast("int"))
    years = (F.year(day) - 1970).cast("string")
    doy = (F.dayofyear(day) - 1).cast("string")
    sod = s - days * 86400
    hh = F.lpad(idiv(sod, F.lit(3600)).cast("string"), 2, "0")
    mm = F.lpad(idiv(sod % 3600, F.lit(60)).cast("string"), 2, "0")
    ss = F.lpad((sod % 60).cast("string"), 2, "0")
    return F.concat(F.ltrim(F.concat(years, F.lit("-")), F.lit("0-")), doy,
                    F.lit("-"), hh, F.lit(":"), mm, F.lit(":"), ss)


def rtrim_chars(s: Column, chars: str) -> Column:
    """SQL ``rtrim(s, chars)``: strip any trailing character of ``chars``."""
    return F.rtrim(s, F.lit(chars))
