"""Voltages in free text, and their classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?<![\w.])-?\d+(?:[.,]\d+)?"


def positive_numbers(x: Column) -> Column:
    """Every positive number of a text, decimal commas allowed; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(x.cast("string"), F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit(".")).cast("double")), lambda v: v > 0)


def kv_of_tag(x: Column) -> Column:
    """A raw tag, always in volts, as sorted distinct kilovolts."""
    return F.array_sort(F.array_distinct(F.transform(positive_numbers(x), lambda v: v / 1000.0)))


def kv_of_feature(voltage: Column, voltage_raw: Column, *explicit: Column) -> Column:
    """The raw tag if there is one (the first that is not empty); only else the explicit kilovolt fields."""
    full = lambda c: c.isNotNull() & (c.cast("string") != "")
    given = F.array_sort(F.array_distinct(F.concat(*map(positive_numbers, explicit)))) if explicit else F.array().cast("array<double>")
    return F.when(full(voltage), kv_of_tag(voltage)).when(full(voltage_raw), kv_of_tag(voltage_raw)).otherwise(given)


def voltage_class(kv: Column) -> Column:
    return F.when(kv.between(300, 550), "400").when((kv >= 50) & (kv < 300), "154")


def kv_text(kv: Column) -> Column:
    """Shortest text of a number of kilovolts, with its unit."""
    return F.when(kv.isNotNull(), F.concat(F.regexp_replace(kv.cast("string"), r"\.0$", ""), F.lit(" kV"))).otherwise("unknown voltage")


def shown_voltage(x: Column) -> Column:
    """A number in kilovolts as it is; of other text the largest number, above 10,000 taken as volts."""
    most = F.array_max(positive_numbers(x))
    kv = F.when(most > 10_000, most / 1000).otherwise(most)
    n = F.when(x.rlike(r"^\s*\d+(\.\d+)?\s*$"), x.try_cast("double"))
    v = F.when(n > 0, n).otherwise(kv)
    return F.when(v.isNotNull(), F.concat(F.when(v % 1 == 0, v.cast("long").cast("string")).otherwise(F.format_string("%.2f", v)), F.lit(" kV")))
