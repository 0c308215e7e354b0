"""Text helpers: cells of CSV files, HTML, identifiers, and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberfold.functions.numbers import num_or_null


def csv_cell(x: Column) -> Column:
    """A cell that no spreadsheet reads as a formula, quoted where needed."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    risky = s.rlike("^[=+@]") | (s.rlike("^-") & num_or_null(s).isNull())
    s = F.when(risky, F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def escape_html(x: Column) -> Column:
    out = F.coalesce(x.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def id_suffix(x: Column) -> Column:
    """Runs of characters that identifiers don't have become one dash."""
    return F.regexp_replace(x, "[^A-Za-z0-9_.:-]+", "-")


def hhmm(date: Column, time: Column) -> Column:
    """ISO time of a date and a time of up to four digits, padded on the left; longer times are not cut."""
    t = F.coalesce(time, F.lit(""))
    t = F.when(F.length(t) < 4, F.lpad(t, 4, "0")).otherwise(t)
    return F.concat(date, F.lit("T"), F.substring(t, 1, 2), F.lit(":"), t.substr(F.lit(3), F.length(t)), F.lit(":00Z"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without a zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(1000.0)


def age_text(minutes: Column) -> Column:
    """Days and hours, hours and minutes, or minutes."""
    m = F.greatest(F.lit(0), F.floor(minutes)).cast("int")
    d, h, r = F.floor(m / 1440), F.floor((m % 1440) / 60), m % 60
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), F.when(b > 0, F.concat(F.lit(" "), b.cast("string"), F.lit(y))).otherwise(""))
    return F.when(m < 1, "<1min").when(d > 0, two(d, "d", h, "h")).when(h > 0, two(h, "h", r, "min")).otherwise(F.concat(r.cast("string"), F.lit("min")))


def slot_ms(ms: Column, minutes: int = 10) -> Column:
    """Beginning of the slot that holds a time in milliseconds."""
    step = minutes * 60_000
    return F.floor(ms / step) * step
