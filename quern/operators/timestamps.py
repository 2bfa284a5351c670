"""Problem 4: one unambiguous instant for timestamps written in many notations and zones.

Raw strings are reduced to a dictionary of distinct (text, zone, country). Each entry is parsed once, by every notation
below; the dictionary may be kept in a folder, to which later runs add only entries it lacks. Instants are then joined
back to the rows.

Defined results: null, empty, unreadable and impossible texts, dates without a time of day, zoneless texts without a
known zone, abbreviations with several meanings and no country, and local times that occur twice or never give null.
Fractions beyond milliseconds are dropped; missing seconds count as 0; weekday names are ignored.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.skew import hot_keys, join_small_per_key
from quern.session import Scratch


# Month names, as a feed writes them (lower case, without marks and final points), by number.
_MONTHS = {
    1: "january jan janvier janv januar janner jan enero ene ιανουαριου ιανουαριος ιαν января январь янв जनवरी มกราคม ม.ค يناير yanvar gennaio",
    2: "february feb fevrier fevr februar feber febrero φεβρουαριου φεβρουαριος φεβ февраля февраль фев फरवरी กุมภาพันธ์ ก.พ فبراير fevral febbraio",
    3: "march mar mars marz maerz marzo μαρτιου μαρτιος μαρ марта март мар मार्च มีนาคม มี.ค مارس mart",
    4: "april apr avril avr abril abr απριλιου απριλιος απρ апреля апрель апр अप्रैल เมษายน เม.ย أبريل ابريل aprel aprile",
    5: "may mai mayo μαιου μαιος μαι мая май मई พฤษภาคม พ.ค مايو maggio",
    6: "june jun juin juni junio ιουνιου ιουνιος ιουν июня июнь июн जून มิถุนายน มิ.ย يونيو iyun giugno",
    7: "july jul juillet juil juli julio ιουλιου ιουλιος ιουλ июля июль июл जुलाई กรกฎาคม ก.ค يوليو iyul luglio",
    8: "august aug aout agosto ago αυγουστου αυγουστος αυγ августа август авг अगस्त สิงหาคม ส.ค أغسطس اغسطس avgust",
    9: "september sept sep septembre septiembre setiembre σεπτεμβριου σεπτεμβριος σεπ сентября сентябрь сен сент सितंबर सितम्बर กันยายน ก.ย سبتمبر sentabr settembre",
    10: "october oct octobre oktober okt octubre οκτωβριου οκτωβριος οκτ октября октябрь окт अक्टूबर अक्तूबर ตุลาคม ต.ค أكتوبر اكتوبر oktabr ottobre",
    11: "november nov novembre noviembre νοεμβριου νοεμβριος νοε ноября ноябрь ноя нояб नवंबर नवम्बर พฤศจิกายน พ.ย نوفمبر noyabr",
    12: "december dec decembre dezember dez diciembre dic δεκεμβριου δεκεμβριος δεκ декабря декабрь дек दिसंबर दिसम्बर ธันวาคม ธ.ค ديسمبر dekabr dicembre",
}

# Zone abbreviations with one meaning everywhere, in minutes east of Greenwich.
_ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "ICT": 420, "PKT": 300, "UZT": 300, "NZST": 720, "NZDT": 780,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "EDT": -240, "CDT": -300, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "NST": -210, "NDT": -150,
}
# Abbreviations whose meaning depends on the country.
_ZONES_OF = {
    "IST": {"IE": 60, "IN": 330, "IL": 120},
    "CST": {"US": -360, "CA": -360, "MX": -360, "CN": 480, "TW": 480, "CU": -300, "AU": 570},
    "BST": {"GB": 60, "BD": 360},
    "EST": {"US": -300, "CA": -300, "AU": 600},
    "MST": {"US": -420, "CA": -420, "MX": -420, "MY": 480},
    "AST": {"CA": -240, "US": -240, "SA": 180, "AE": 180},
    "ADT": {"CA": -180},
    "GST": {"AE": 240, "GU": 600},
    "SST": {"SG": 480, "AS": -660},
    "WST": {"AU": 480, "WS": 780},
    "PST": {"US": -480, "CA": -480, "PH": 480},
    "CDT": {"US": -300, "CA": -300, "CN": 540, "AU": 630},
    "EDT": {"US": -240, "CA": -240, "AU": 660},
}
#: Countries that write the month before the day, and the year first.
_MONTH_FIRST, _YEAR_FIRST = {"US", "PH", "FM"}, {"CN", "JP", "KR", "TW", "HU", "MN", "LT", "KZ"}
#: Years counted from the Buddha's death where the country does so: from this year on.
_BUDDHIST, _BUDDHIST_FROM, _BUDDHIST_OFFSET = {"TH"}, 2400, 543
#: First years of Japanese eras, by the names' usual spellings.
_ERAS = {"令和": 2019, "平成": 1989, "昭和": 1926, "reiwa": 2019, "heisei": 1989}

_TIME = r"(?P<h>\d{1,2})[:.h時时](?P<mi>\d{2})分?(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d+))?)?秒?"
_HALF = r"(?:\s*(?P<half>[ap]\.?\s?m\.?|午前|午後|上午|下午))?"
_OFFSET = r"(?:\s*(?P<off>(?:(?:gmt|utc)\s*)?[+\-−]\d{1,2}(?::?\d{2})?(?!\d)|[a-z]{1,5}(?![a-z])))?"
_TAIL = rf"{_HALF}(?:\s*(?:uhr|uur|hrs?|h))?{_OFFSET}(?:\s*\([^)]*\))?$"
_WORD = r"[^\W\d_][^\s\d,]*"
_NOTATIONS = [
    ("ymd", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:\s*t\s*|\s+|,\s*){_TIME}{_TAIL}")),
    ("ymd", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{_TAIL}")),
    ("ymd", re.compile(rf"(?:(?P<era>令和|平成|昭和))?(?P<y>\d{{1,4}}|元)\s*年\s*(?P<m>\d{{1,2}})\s*月\s*(?P<d>\d{{1,2}})\s*日\s*(?:\([^)]*\)\s*)?(?P<half>午前|午後|上午|下午)?\s*{_TIME}{_TAIL.replace('P<half>', 'P<half2>')}")),
    ("ymd", re.compile(rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})[,\s]\s*{_TIME}{_TAIL}")),
    ("num", re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[/.\-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})[,\s]\s*(?:a\s*|um\s*|at\s*)?{_TIME}{_TAIL}")),
    ("dmy", re.compile(rf"(?:{_WORD}\.?,?\s+)?(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th|ª|º)?[\s\-](?:de\s+)?(?P<mon>{_WORD})\.?[\s\-](?:de\s+|del\s+)?(?P<y>\d{{4}}|\d{{2}})(?:\s*(?:г\.?|года))?[,\s]\s*(?:a\s+|um\s+|at\s+|a las\s+|στις\s+|в\s+)?{_TIME}{_TAIL}")),
    ("dmy", re.compile(rf"(?:{_WORD}\.?,?\s+)?(?P<mon>{_WORD})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})[,\s]\s*(?:at\s+)?{_TIME}{_TAIL}")),
    ("dmy", re.compile(rf"(?:{_WORD}\.?,?\s+)?(?P<mon>{_WORD})\.?\s+(?P<d>\d{{1,2}})\s+{_TIME}(?:\s+(?P<off>[a-z]{{1,5}}|[+-]\d{{4}}))?\s+(?P<y>\d{{4}})$")),
]
_EPOCH = re.compile(r"(?P<n>\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:\.(?P<f>\d+))?$")
_UTC0 = dt.datetime(1970, 1, 1)


def _plain(text: str) -> str:
    """Lower case without accents, with ASCII digits and single blanks. Marks of scripts that need them stay."""
    if not text.isascii():
        text = "".join(str(unicodedata.digit(c)) if c.isdigit() and unicodedata.digit(c, None) is not None else c for c in text)
        parts = unicodedata.normalize("NFKD", text)
        text = unicodedata.normalize("NFC", "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F and c not in "\u200e\u200f\u061c\ufeff\u200b"))
    return " ".join(text.lower().split())


@lru_cache(1)
def _month_numbers() -> dict[str, int]:
    return {_plain(w): n for n, words in _MONTHS.items() for w in words.split()}


@lru_cache(1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def local_to_epoch_ms(naive: dt.datetime, zone: str | None) -> int | None:
    """Milliseconds of a wall-clock time; None if zone is unknown or the time occurs twice or never there."""
    tz = _zone(zone) if zone else None
    if tz is None:
        return None
    first, second = naive.replace(tzinfo=tz, fold=0).utcoffset(), naive.replace(tzinfo=tz, fold=1).utcoffset()
    if first != second:
        return None
    return (naive - _UTC0 - first) // dt.timedelta(milliseconds=1)


def _offset(mark: str, country: str | None) -> int | None:
    """Minutes east of Greenwich."""
    mark = mark.strip()
    if m := re.fullmatch(r"(?:gmt|utc)?\s*([+\-−])(\d{1,2}):?(\d{2})?", mark):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 15 or minutes > 59:
            return None
        return (hours * 60 + minutes) * (1 if m[1] == "+" else -1)
    name = mark.upper()
    if name in _ZONES_OF and country in _ZONES_OF[name]:
        return _ZONES_OF[name][country]
    return _ZONES.get(name)


def parse_instant(text: str | None, zone: str | None = None, country: str | None = None) -> int | None:
    """Milliseconds since 1970-01-01T00:00:00Z of the one instant that text denotes, else None."""
    if not text:
        return None
    plain = _plain(text)
    if m := _EPOCH.match(plain):
        digits = m["n"]
        scale = {9: 0, 10: 0, 12: 3, 13: 3, 15: 6, 16: 6, 18: 9, 19: 9}[len(digits)]
        return int(digits) * 1000 // 10**scale if scale else int(digits) * 1000 + int(((m["f"] or "") + "000")[:3])
    for kind, notation in _NOTATIONS:
        m = notation.match(plain)
        if not m:
            continue
        part = m.groupdict()
        year = part["y"]
        if part.get("era"):
            year = _ERAS[part["era"]] - 1 + (1 if year == "元" else int(year))
        elif year == "元":
            return None
        else:
            year = int(year) + (0 if len(year) != 2 else 2000 if int(year) < 50 else 1900)
        if country in _BUDDHIST and year >= _BUDDHIST_FROM:
            year -= _BUDDHIST_OFFSET
        if kind == "num":
            month_first = country in _MONTH_FIRST and part["sep"] != "."
            month, day = (int(part["a"]), int(part["b"])) if month_first else (int(part["b"]), int(part["a"]))
        elif kind == "dmy":
            month = _month_numbers().get(part["mon"].rstrip("."))
            if month is None:
                continue
            day = int(part["d"])
        else:
            month, day = int(part["m"]), int(part["d"])
        hour, half = int(part["h"]), part.get("half") or part.get("half2")
        if half:
            if hour > 12:
                return None
            late = half[0] == "p" or half in ("午後", "下午")
            hour = hour % 12 + (12 if late else 0)
        fraction = ((part.get("f") or "") + "000")[:3]
        try:
            naive = dt.datetime(year, month, day, hour, int(part["mi"]), int(part["s"] or 0), int(fraction) * 1000)
        except ValueError:
            return None
        if part.get("off"):
            minutes = _offset(part["off"], country)
            if minutes is None:
                return None
            return (naive - _UTC0 - dt.timedelta(minutes=minutes)) // dt.timedelta(milliseconds=1)
        return local_to_epoch_ms(naive, zone)
    return None


@F.pandas_udf(T.LongType())
def _parsed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, zones, countries in batches:
        found = [parse_instant(*x) for x in zip(texts.tolist(), zones.tolist(), countries.tolist())]
        yield pd.Series(found, dtype="Int64")


_KEY = ["raw", "zone", "country"]


#: Version of the notations; entries of a dictionary that another version parsed aren't used.
PARSER = 1


def _dictionary(keys: DataFrame, folder: str | None) -> DataFrame:
    """raw, zone, country, epoch_ms of every distinct key; with a folder, entries it lacks are parsed and added first."""
    spark = keys.sparkSession
    parse = lambda x: x.withColumn("epoch_ms", _parsed("raw", "zone", "country"))
    if folder is None:
        return parse(keys)
    folder = f"{folder}/parser-{PARSER}"
    if _exists(spark, folder):
        known = spark.read.parquet(folder)
        match = [keys[c].eqNullSafe(known[c]) for c in _KEY]
        keys = keys.join(known, match, "left_anti")
    parse(keys).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and any(str(x.getPath().getName()).endswith(".parquet") for x in fs.listStatus(path))


def normalise_timestamps(df: DataFrame, raw: Column | str, zone: Column | str, country: Column | str, out: str = "epoch_ms", dictionary: str | None = None) -> DataFrame:
    """df with the column out (BIGINT, milliseconds): the instant that raw denotes, or null.

    zone is the IANA name of the clock for texts without a zone, country the ISO code whose usage settles abbreviations,
    the order of day and month and the counting of years. dictionary names a folder that keeps parsed strings between
    runs. All rows of df come out, in any order; a column named out is replaced.
    """
    as_col = lambda x: F.col(f"`{x}`") if isinstance(x, str) else x
    drop = [c for c in df.columns if c.lower() == out.lower()]
    key = F.struct(F.trim(as_col(raw)).alias("raw"), as_col(zone).alias("zone"), as_col(country).alias("country"))
    rows = df.withColumn("__key", F.when(F.length(F.trim(as_col(raw))) > 0, key)).drop(*drop)
    counts = rows.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    counts = Scratch(df.sparkSession, "timestamps").write(counts.select(F.xxhash64("__key").alias("hash"), "__key.*", "n"), "keys")
    hot = hot_keys(counts, "hash", "n")
    known = _dictionary(counts.select(*_KEY), dictionary)
    # Two runs at once may have added the same entry; it counts once.
    table = known.groupBy(F.struct(*_KEY).alias("__key")).agg(F.first("epoch_ms").alias(out))
    # Rows without text would all meet in one task, so they take no part in the join.
    hit = join_small_per_key(rows.where(F.col("__key").isNotNull()), table, "__key", hot, "left", by=F.xxhash64("__key")).drop("__key")
    none = rows.where(F.col("__key").isNull()).drop("__key").withColumn(out, F.lit(None).cast("bigint"))
    return hit.unionByName(none)
