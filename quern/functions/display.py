"""Texts as they are shown: quotes, names of sections, dates, figures with units, and the bars drawn for them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import bound, slug

# Sections whose words are joined by an ampersand, and the name of an item without a section.
AMPERSAND_SECTIONS, NO_SECTION = ["science-health", "business-work"], "News"
# Fixed value: a figure with what stands before and behind it.
_QUANTITY = r"^([^\d\-−.]*)(\d[\d,]*(?:\.\d+)?|\.\d+)(.*)$"


def smart_quotes(text: Column) -> Column:
    """Typographic quotes and ellipses: a quote opens at the beginning, after white space, a bracket or a dash, else it closes."""
    opens = r"(^|[\s(\[{—–/-])"
    t = F.replace(text, F.lit("..."), F.lit("…"))
    t = F.regexp_replace(F.regexp_replace(t, r"'(\d0s\b)", "’$1"), opens + '"', "$1“")
    t = F.regexp_replace(F.replace(t, F.lit('"'), F.lit("”")), opens + r"'(\w)", "$1‘$2")
    return F.replace(t, F.lit("'"), F.lit("’"))


def section_name(section: Column, given: Column | None = None) -> Column:
    """A section's own name, or else its slug's words with capitals."""
    plain = F.trim(F.coalesce(section, F.lit("")))
    words = F.transform(F.filter(F.split(plain, "-"), lambda w: w != ""), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
    made = F.when(plain == "", NO_SECTION).otherwise(F.when(plain.isin(AMPERSAND_SECTIONS), F.array_join(words, " & ")).otherwise(F.array_join(words, " ")))
    return made if given is None else F.coalesce(F.nullif(given, F.lit("")), made)


def short_date(time: Column) -> Column:
    return F.date_format(time, "dd/MM/yyyy")


def long_date(time: Column) -> Column:
    return F.date_format(time, "d MMMM yyyy")


def item_id(time: Column, title: Column, address: Column) -> Column:
    """Date, at most 40 characters of the title's slug, and six digits of the address's sha256."""
    return F.concat_ws("-", F.date_format(time, "yyyy-MM-dd"), F.regexp_replace(F.left(slug(title), F.lit(40)), "-+$", ""), F.left(F.sha2(address, 256), F.lit(6)))


def slug_or_title(given: Column, title: Column) -> Column:
    """The slug that an item has, or else one made of its title."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), slug(title))


def charset(content_type: Column) -> Column:
    """The encoding that a content type names, utf-8 where it names none."""
    return F.coalesce(F.nullif(F.regexp_extract(content_type, r"charset=([\w-]+)", 1), F.lit("")), F.lit("utf-8"))


def quantity(value: Column) -> Column:
    """STRUCT<prefix, number, suffix> of a figure such as "€1,480 per household"; null where there is none."""
    part = lambda k: F.regexp_extract(F.trim(value), _QUANTITY, k)
    made = F.struct(F.trim(part(1)).alias("prefix"), F.replace(part(2), F.lit(","), F.lit("")).cast("double").alias("number"), F.trim(part(3)).alias("suffix"))
    return F.when(F.rlike(F.trim(value), F.lit(_QUANTITY)), made)


def bar_scale(before: Column, after: Column) -> Column:
    """STRUCT<before, after>: lengths from 0 to 1 of two figures with equal units: percentages up to 100 of 100, others of
    the larger one; null where the units differ or nothing is above 0."""

    def scaled(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        larger = F.greatest(a["number"], b["number"])
        top = F.when(F.startswith(a["suffix"], F.lit("%")) & (larger <= 100), F.lit(100.0)).otherwise(larger)
        same = (a["prefix"] == b["prefix"]) & (a["suffix"] == b["suffix"])
        return F.when(same & (top > 0), F.struct((a["number"] / top).alias("before"), (b["number"] / top).alias("after")))

    return bound(F.struct(quantity(before).alias("a"), quantity(after).alias("b")), scaled)


def split_unit(before: Column, after: Column) -> Column:
    """STRUCT<before, after, unit>: the unit in words that two figures share, taken out of both; null where there is none."""
    part = lambda v, k: F.regexp_extract(F.trim(v), _QUANTITY, k)
    unit = F.trim(part(before, 3))
    bare = lambda v: F.trim(F.concat(part(v, 1), part(v, 2)))
    both = F.rlike(F.trim(before), F.lit(_QUANTITY)) & F.rlike(F.trim(after), F.lit(_QUANTITY))
    return F.when(both & (unit == F.trim(part(after, 3))) & F.rlike(unit, F.lit(r"\p{L}")), F.struct(bare(before).alias("before"), bare(after).alias("after"), unit.alias("unit")))


def slide_texts(slides: Column, dek: Column, chunks: Column, title: Column, most: int = 5) -> Column:
    """The texts given, or else the dek and the chunks, or else the title; blank ones left out, at most most."""
    some = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    own = F.concat(some(F.array(F.coalesce(dek, F.lit("")))), F.slice(some(chunks), 1, most - 1))
    made = bound(own, lambda a: F.when(F.size(a) > 0, a).otherwise(some(F.array(F.coalesce(title, F.lit(""))))))
    return bound(some(slides), lambda a: F.slice(F.when(F.size(a) > 0, a).otherwise(made), 1, most))


def reading_pace(items: Column, seconds: int = 40) -> Column:
    """Minutes that so many items take, begun minutes included."""
    return F.floor(items * seconds / 60).cast("int") + 1


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width characters, filled word by word; a longer word stands alone."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def step(lines: Column, w: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        fits = F.length(last) + 1 + F.length(w) <= width
        longer = F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), w)))
        return F.when(F.size(lines) == 0, F.array(w)).when(fits, longer).otherwise(F.array_append(lines, w))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def clean_of(text: str | None) -> str:
    """NFC, without control, format and unassigned characters; blanks of any kind as one, line breaks kept, at most two in a row."""
    lines = unicodedata.normalize("NFC", text or "").replace("\r\n", "\n").translate({0x0D: "\n", 0x2028: "\n", 0x2029: "\n", 0x09: " "}).split("\n")
    kinds = lambda line: "".join(" " if unicodedata.category(c)[0] == "Z" else c for c in line if unicodedata.category(c)[0] != "C")
    kept: list[str] = []
    for line in (" ".join(kinds(x).split()) for x in lines):
        if line or (kept and kept[-1]):
            kept.append(line)
    return "\n".join(kept).strip()


def _clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([clean_of(t) for t in texts.to_pylist()], pa.string())


_clean.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def clean_text(text: Column) -> Column:
    """clean_of as a column; Unicode composition has no expression in Spark."""
    return F.arrow_udf(_clean, T.StringType())(text)
