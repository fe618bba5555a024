"""Scalar column functions.  All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.config import CAT_MISSING, CLIP_HI, CLIP_LO, NUM_MISSING
from riskloom.functions.timecols import col_of

# Fixed values that must equal the reference for equal results.
TRUE_TOKENS = ("YES", "TRUE", "1", "Y")
CURRENCY_STRIP = r"[$,\s]"


def parse_currency(c: str | Column) -> Column:
    """F1: '$-77.00', ' $1,234.56 ' -> double; unparsable -> NULL (ANSI-safe)."""
    cleaned = F.regexp_replace(col_of(c).cast("string"), CURRENCY_STRIP, "")
    return cleaned.try_cast("double")


def parse_bool_flag(c: str | Column) -> Column:
    """trim+upper in {YES, TRUE, 1, Y} -> 1 else 0 (NULL -> 0)."""
    s = F.upper(F.trim(col_of(c).cast("string")))
    return F.coalesce(s.isin(*TRUE_TOKENS), F.lit(False)).cast("int")


def parse_month_year(c: str | Column) -> Column:
    """'MM/yyyy' -> timestamp at the first of the month; bad -> NULL."""
    return F.try_to_timestamp(F.trim(col_of(c).cast("string")), F.lit("MM/yyyy"))


def acct_age_days(date: str | Column, opened: str | Column) -> Column:
    """whole days from the open date to the row date, floored, clipped at
    0; NULL when the open date is missing (guard: greatest() skips NULL)."""
    d, o = col_of(date), col_of(opened)
    secs = F.unix_micros(d.cast("timestamp")) - F.unix_micros(o.cast("timestamp"))
    days = F.floor(secs / F.lit(86_400_000_000)).cast("long")
    return F.when(o.isNotNull() & d.isNotNull(), F.greatest(F.lit(0).cast("long"), days))


def weekday_mon0(date: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6 (Spark's ``weekday``)."""
    return F.weekday(col_of(date))


def parse_yes_no(c: str | Column) -> Column:
    """trim+lower == 'yes' -> 1 else 0."""
    return F.coalesce((F.lower(F.trim(col_of(c).cast("string"))) == "yes"), F.lit(False)).cast("int")


def fill_cat(c: str | Column) -> Column:
    """NULL or the string 'nan' -> '__missing__'."""
    s = col_of(c).cast("string")
    return F.coalesce(F.nullif(s, F.lit("nan")), F.lit(CAT_MISSING))


def fill_num(c: str | Column) -> Column:
    """Numeric model-matrix fill: NULL/NaN -> -999."""
    x = col_of(c).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(NUM_MISSING))


def no_nan(c: str | Column) -> Column:
    """NaN -> NULL (no NaN ever enters a stored table)."""
    x = col_of(c)
    return F.nanvl(x, F.lit(None).cast("double"))



def clip_prob(c: str | Column, lo: float = CLIP_LO, hi: float = CLIP_HI) -> Column:
    """clip into [1e-6, 1 - 1e-6]."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col_of(c)))


def display_value(c: str | Column, max_len: int = 40) -> Column:
    """-999 -> '(missing)'; strings longer than 40 chars cut with '...'."""
    x = col_of(c)
    s = x.cast("string")
    return (F.when(x.isNull(), F.lit("(missing)"))
            .when(s.try_cast("double") == F.lit(NUM_MISSING), F.lit("(missing)"))
            .when(F.length(s) > max_len, F.concat(F.substring(s, 1, max_len), F.lit("...")))
            .otherwise(s))


def psi_term(cur_pct: Column, ref_pct: Column) -> Column:
    """(c - r) * ln(c / r)."""
    return (cur_pct - ref_pct) * F.log(cur_pct / ref_pct)


def json_field(payload: str | Column, key: str) -> Column:
    """one top-level JSON key as string."""
    return F.get_json_object(col_of(payload), f"$.{key}")
