"""Time series kept as arrays, and the short texts and drawings made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yearly_series(df: DataFrame, key: str, year: Column, value: Column) -> DataFrame:
    """key, series: ARRAY<STRUCT<year, value>> of yearly sums in order of years."""
    sums = df.groupBy(key, year.alias("year")).agg(F.sum(value).alias("value"))
    return sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("year", "value"))).alias("series"))


def series_facts(series: Column) -> Column:
    """STRUCT of a series' first, last, least and greatest value, and its trend: rose (also if level) or fell."""
    values = F.transform(series, lambda p: p["value"])
    first, last = F.get(values, F.lit(0)), F.try_element_at(values, F.lit(-1))
    return F.struct(first.alias("first"), last.alias("last"), F.array_min(values).alias("least"), F.array_max(values).alias("greatest"), F.when(last >= first, "rose").otherwise("fell").alias("trend"))


def value_text(value: Column, unit: str = "") -> Column:
    """A value as texts name it: percentages with one decimal, values from 100 without, others with two; halves go to the
    even number."""
    if unit == "%":
        return F.concat(F.format_string("%.1f", F.bround(value.cast("double"), 1)), F.lit("%"))
    behind = f" {unit}" if unit else ""
    large = F.format_number(F.bround(value, 0), 0)
    return F.concat(F.when(F.abs(value) >= 100, large).otherwise(F.format_string("%.2f", F.bround(value.cast("double"), 2))), F.lit(behind))


def trend_sentence(name: Column, series: Column, unit: str = "", less_is_better: bool = False) -> Column:
    """One sentence about a series of at least two points; null for shorter ones."""
    first, last = F.get(series, F.lit(0)), F.try_element_at(series, F.lit(-1))
    rose = last["value"] >= first["value"]
    verb = F.when(rose, "Rose").otherwise("Fell")
    good = F.when(rose == F.lit(not less_is_better), "").otherwise(" (the wrong way)")
    say = lambda v: value_text(v, unit)
    text = F.concat(name, F.lit(": "), verb, F.lit(" from "), say(first["value"]), F.lit(" in "), first["year"].cast("string"), F.lit(" to "), say(last["value"]), F.lit(" in "), last["year"].cast("string"), good, F.lit("."))
    return F.when(F.size(series) >= 2, text)


def sparkline(series: Column, width: int = 320, height: int = 96, pad: int = 8) -> Column:
    """An SVG polyline of a series, scaled to its least and greatest value; empty for fewer than two points."""
    values = F.transform(series, lambda p: p["value"].cast("double"))
    low, high, n = F.array_min(values), F.array_max(values), F.size(values)

    def point(v: Column, i: Column) -> Column:
        x = pad + i * (width - 2 * pad) / (n - 1)
        y = height - pad - F.coalesce(F.try_divide(v - low, high - low), F.lit(0.5)) * (height - 2 * pad)
        return F.format_string("%.1f,%.1f", x.cast("double"), y.cast("double"))

    line = F.array_join(F.transform(values, point), " ")
    svg = F.concat(F.lit(f'<svg viewBox="0 0 {width} {height}"><polyline points="'), line, F.lit('"/></svg>'))
    return F.when(n >= 2, svg).otherwise("")
