"""Deterministic checks of a draft against its evidence. All are row-local expressions: (status, details)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X

MOST_DETAILS = 20
TOLERANCE, LOOSE = 0.005, 0.05


def _result(details: Column, bad: str = "fail") -> Column:
    """STRUCT<status, details>: pass without details, else bad with the first twenty."""
    return X.bound(details, lambda d: F.struct(F.when(F.size(d) == 0, "pass").otherwise(bad).alias("status"), F.slice(d, 1, MOST_DETAILS).alias("details")))


def _close(value: Column, other: Column, tolerance: float) -> Column:
    return (value == other) | ((other != 0) & (F.abs(value - other) <= tolerance * F.abs(other)))


def numbers(draft: Column, evidence: Column) -> Column:
    """Every figure of the draft, years apart, is one of the evidence within 0.5 %, or within 5 % if marked as rough."""
    rough = "|".join(re.escape(w) for w in X.APPROXIMATORS)

    def unsupported(f: Column, known: Column, low: Column) -> Column:
        year = F.rlike(f["surface"], F.lit(r"^(?:19|20)\d{2}$"))
        near = F.exists(known, lambda v: _close(f["value"], v, TOLERANCE))
        nearly = F.exists(known, lambda v: (v != 0) & (F.abs(f["value"] - v) <= LOOSE * F.abs(v)))
        marked = nearly & F.rlike(low, F.concat(F.lit(rf"\b(?:{rough})\s+\Q"), F.lower(f["surface"]), F.lit(r"\E")))
        return ~year & ~near & ~marked

    of = lambda known, low: F.filter(X.figures(draft), lambda f: unsupported(f, known, low))
    bad = X.bound(F.array_distinct(F.transform(X.figures(evidence), lambda f: f["value"])), lambda known: X.bound(F.lower(draft), lambda low: of(known, low)))
    return _result(F.transform(bad, lambda f: F.concat(F.lit("no evidence for the figure "), f["surface"])))


def dates(draft: Column, evidence: Column) -> Column:
    """Years and days of the draft stand in the evidence, and the draft has no relative dates."""
    lost_years = F.transform(F.array_except(X.years(draft), X.years(evidence)), lambda y: F.concat(F.lit("no evidence for the year "), y))
    lost_days = F.transform(F.array_except(X.day_months(draft), X.day_months(evidence)), lambda d: F.concat(F.lit("no evidence for the day "), d))
    relative = X.relative_dates(draft)
    words = F.when(F.size(relative) > 0, F.array(F.concat(F.lit("dates relative to today: "), F.array_join(relative, ", ")))).otherwise(F.array().cast("array<string>"))
    return _result(F.concat(lost_years, lost_days, words))


def quotes(draft: Column, evidence: Column) -> Column:
    """Every quotation of the draft stands in the evidence word by word."""
    bad = X.bound(F.lower(X.norm_space(evidence)), lambda low: F.filter(X.quotations(draft), lambda q: ~F.contains(low, F.lower(X.norm_space(q)))))
    return _result(F.transform(bad, lambda q: F.concat(F.lit("no evidence for the quotation “"), F.substring(q, 1, 80), F.lit("”"))))


# Names that need no evidence.
SAFE_NAMES = ["united states", "united kingdom", "european union"]


def entities(draft: Column, evidence: Column, allowed: Column | None = None) -> Column:
    """Names of the draft stand in the evidence or among those allowed (SAFE_NAMES, and the array allowed, which may be null),
    as they are or without a leading article and a trailing possessive; those that don't are a warning."""
    core = lambda n: F.regexp_replace(F.regexp_replace(F.lower(n), "^(?:the|an?) ", ""), "['’s]+$", "")
    names = F.transform(X.capital_runs(draft), X.norm_space)
    safe = F.array(*[F.lit(n) for n in SAFE_NAMES])
    known = safe if allowed is None else F.array_union(safe, F.transform(F.coalesce(allowed, F.array().cast("array<string>")), F.lower))

    def missing(low: Column, known: Column) -> Column:
        there = lambda n: F.contains(low, n) | F.array_contains(known, n)
        return F.filter(names, lambda n: ~there(F.lower(n)) & ~there(core(n)))

    bad = X.bound(known, lambda k: X.bound(F.lower(X.norm_space(evidence)), lambda low: missing(low, k)))
    return _result(F.transform(F.array_sort(bad), lambda n: F.concat(F.lit("no evidence for the name "), n)), "warn")


def hype(draft: Column, evidence: Column, words: list[str] | None = None) -> Column:
    """Strong words are used only where the evidence uses them."""
    words = words or X.HYPE_WORDS
    bad = F.array_except(X.words_used(draft, words), X.words_used(evidence, words))
    return _result(F.transform(bad, lambda w: F.concat(F.lit("'"), w, F.lit("' is stronger than the evidence"))))


def copying(draft: Column, sources: Column, run: int = 12, short: int = 5, most: float = 0.15) -> Column:
    """The draft, its quotations apart, shares no run of 12 words with a source, nor over 15 % of its runs of five."""
    words = lambda t: X.tokens(t, "[a-z0-9']+")
    own = words(F.regexp_replace(draft, "[\"“][^\"”]*[\"”]", " "))

    def of(long_runs: Column, short_runs: Column, theirs: Column, number: Column) -> Column:
        copied = F.size(F.array_intersect(long_runs, X.shingles(theirs, run))) > 0
        share = F.try_divide(F.size(F.array_intersect(short_runs, X.shingles(theirs, short))), F.size(short_runs))
        text = lambda s: F.when(s > most, F.concat(F.round(s * 100).cast("int").cast("string"), F.lit("% of its runs of five words stand in source "), number))
        return F.array_compact(F.array(F.when(copied, F.concat(F.lit("twelve words in a row stand in source "), number)), X.bound(share, text)))

    def against(runs: Column) -> Column:
        return F.flatten(F.transform(sources, lambda s, i: X.bound(words(s), lambda theirs: of(runs["long"], runs["short"], theirs, (i + 1).cast("string")))))

    return _result(X.bound(X.bound(own, lambda w: F.struct(X.shingles(w, run).alias("long"), X.shingles(w, short).alias("short"))), against))


def structure(body: Column, title: Column, primary: Column, least: int = 120, most: int = 900, dek: Column | None = None, why: Column | None = None, limits: Column | None = None) -> Column:
    """A body of 120 to 900 words, a title, a primary source, and, where they are given, a line that sums up, a reason why it
    matters, and at least one limitation that isn't blank."""
    n = F.size(F.filter(F.split(F.coalesce(body, F.lit("")), X.SPACE + "+"), lambda w: w != ""))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    problems = [F.when(n < least, F.lit(f"article under {least} words")), F.when(n > most, F.lit(f"article over {most} words")), F.when(blank(title), F.lit("missing title"))]
    if dek is not None:
        problems.append(F.when(blank(dek), F.lit("missing dek")))
    if why is not None:
        problems.append(F.when(blank(why), F.lit("missing why it matters")))
    if limits is not None:
        problems.append(F.when(~F.coalesce(F.exists(limits, lambda x: ~blank(x)), F.lit(False)), F.lit("no limitations stated")))
    problems.append(F.when(~F.coalesce(primary, F.lit(False)), F.lit("no primary source")))
    return _result(F.array_compact(F.array(*problems)))


def public_text(*parts: Column) -> Column:
    """All that readers see of a draft as one text: strings, and arrays of strings, a line each; null ones are left out."""
    return F.concat_ws("\n", *parts)


def run_all(df: DataFrame, draft: str, evidence: str, sources: str, body: str | None = None, structured: Column | None = None, allowed: Column | None = None) -> DataFrame:
    """df with a struct column of every check: of the whole public text (draft), and of copying in the body alone, where that is
    another column; structured, if given, is the check of the structure."""
    d, e = F.coalesce(F.col(draft), F.lit("")), F.coalesce(F.col(evidence), F.lit(""))
    own = F.coalesce(F.col(body or draft), F.lit(""))
    found = {"numbers": numbers(d, e), "dates": dates(d, e), "quotes": quotes(d, e), "entities": entities(d, e, allowed), "hype": hype(d, e), "copying": copying(own, F.col(sources))}
    return df.withColumns(found | ({} if structured is None else {"structure": structured}))


def free_of_failures(results: list[Column]) -> Column:
    """No result failed; warnings pass."""
    return ~F.exists(F.array(*[r["status"] for r in results]), lambda s: s == "fail")


def as_map(names: list[str]) -> Column:
    """MAP<check, STRUCT<status, details>> of the columns of these checks."""
    return F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]))


def long_form(df: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """key, check, status, details: one row per check."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c)["status"].alias("status"), F.col(c)["details"].alias("details")) for c in checks]))
    return df.select(key, each)
