"""Problem 9: sentence units of texts in many languages and scripts, in SQL expressions only.

1. Points that end nothing are masked by a private-use character of the same length: those inside numbers and
   addresses, after initials and after abbreviations that something must follow.
2. Blank lines cut the text into blocks; lines of lists, headings, questions and answers are units of their own.
3. In the other blocks a private-use character is put behind each terminator of the script at hand: points, question
   and exclamation marks with their closing quotes before a blank and a possible beginning; the full stops of Chinese,
   Japanese and Hindi wherever they stand; the Greek question mark; in Thai the blank between clauses. Words that
   attribute a quotation stay with it, since they begin small, with a dash, or with a particle.
4. The text is split at the marks. All masks have the length of what they hide, so the lengths of the parts give places
   in the original text, from which units are read: so it is restored exactly.

Defined results: null, empty and blank texts have no units. Places count code points from 0, ends are exclusive, units
have no white space around them. Private-use characters of the text itself are kept. A line break inside a paragraph is
no boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import bound
from quern.session import spread

_MASK, _SEP, _KEPT = "", "", ""

# Abbreviations that something follows in the same sentence, even if it has a capital letter or is a digit.
ABBREVIATIONS = (
    # English
    "Dr Mr Mrs Ms Prof Capt Col Gen Lt Sgt Maj Cmdr Rev Hon Gov Sen Rep Pres St Mt Ft Messrs Mx Fr Sr "
    "e.g i.e No Nos no nos Nr nr Vol vol vols Ch ch Sec sec secs Fig fig figs Tab tab Eq eq App app Art art arts Para para pp pg ed eds vs approx est cf viz "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Tues Wed Thu Thurs Fri Sat Sun "
    # German
    "Hr Fr Fa Dipl Ing Mag Abs Bd Kap Tel Str ca bzw inkl exkl zzgl vgl evtl ggf Mio Mrd Tsd sog Ver "
    # French
    "MM Mgr env ex av bd chap tabl pag "
    # Spanish
    "Sr Sra Srta Sres Dra Dña Lic Ing aprox pág págs núm núms ej fig cap Avda Av art "
    # Russian, Greek, Hindi, Thai
    "проф акад доц табл рис стр гл ст им ул просп млн млрд тыс руб см ср напр "
    "Δρ δρ καθ Καθ κκ εκατ δισ χλμ σελ αρ Αρ "
    "डॉ प्रो श्री कि.मी कि मी पृ ดร ศ ผศ รศ พ.ศ ค.ศ"
)
# Single letters that end with a point inside a sentence.
_LETTERS = "a-zκσтисвкпд"
# German months, before which a number's point makes an ordinal.
_MONTHS_DE = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# Thai words that continue a clause after a name, a share or another word.
_THAI_GOES_ON = (
    "เป็น|จะ|ใน|คือ|เริ่ม|ที่|และ|ได้|ของ|จาก|ให้|กับ|ว่า|ไม่|ก็|ถึง|เพื่อ|เพิ่ม|ช่วย|รายงาน|กล่าว|อยู่|ซึ่ง|หรือ|แล้ว|ไป|มา|ต่อ|โดย|แต่|บอก|ระบุ|เผย|ๆ|"
    "ล้าน|พัน|คน|บาท|ครัวเรือน|แห่ง|เมตร|กิโล|มกราคม|กุมภาพันธ์|มีนาคม|เมษายน|พฤษภาคม|มิถุนายน|กรกฎาคม|สิงหาคม|กันยายน|ตุลาคม|พฤศจิกายน|ธันวาคม"
)
_THAI_NO_END = "เพิ่ม|ลด|ดร\\.|นาย|นาง|นางสาว|ชื่อ|โครงการ"

_CLOSE = "[\"'”’»“‘›)\\]}]"
_KINDS = (r"[•‣▪●◦*\-]\s", r"[–—]\s", r"\d{1,3}[.)]\s", rf"[QA][.:{_MASK}]\s")
_ITEM = rf"(?:#{{1,6}}\s|{'|'.join(_KINDS)})"


def _masked(text: Column) -> Column:
    words = "|".join(sorted({w.replace(".", r"\.") for w in ABBREVIATIONS.split()}, key=lambda w: (-len(w), w)))
    for mark in (_MASK, _SEP):  # plain replacements are many times faster than a translation
        text = F.replace(text, F.lit(mark), F.lit(_KEPT))
    # Numbers and addresses.
    text = F.regexp_replace(text, r"(?<=[\p{L}\p{N}])\.(?=[\p{L}\p{N}/])", _MASK)
    dot = rf"[.{_MASK}]"
    words = words.replace(r"\.", dot)
    before = r"(?<![\p{L}\p{M}\p{N}])"
    rules = [
        rf"(?<={before}(?:{words})\.)",
        rf"(?<={before}(?<!{_MASK})[{_LETTERS}]\.)",
        rf"(?<=(?<![\p{{L}}\p{{N}}.°{_MASK}])(?<!\be\. )\p{{Lu}}\.)(?=\s+[\p{{Lu}}\d])",
        rf"(?<={before}\p{{IsArabic}}\.)",
        rf"(?<=\d\.)(?=\s+(?:{_MONTHS_DE}))",
    ]
    return F.regexp_replace(text, rf"\.(?=\s)(?:{'|'.join(rules)})", _MASK)


def _bullets(block: Column) -> Column:
    """Marks before headings and bullets, which need no blank line before them."""
    return F.regexp_replace(block, r"\n(?=[^\S\n]*(?:[•‣▪●◦]|#{1,6})\s)", "\n" + _SEP)


def _headings(block: Column) -> Column:
    """Marks behind heading lines."""
    return F.when(F.contains(block, F.lit("#")), F.regexp_replace(block, rf"(^|{_SEP})([^\S\n]*#{{1,6}}\s[^\n]*\n)(?=[^{_SEP}])", "$1$2" + _SEP)).otherwise(block)


def _items(part: Column) -> Column:
    """Marks between the lines of a list, or of questions and answers: lines that begin as the first one does."""
    cases = F
    for kind in _KINDS:
        cases = cases.when(F.rlike(part, F.lit(rf"^\s*{kind}")), F.regexp_replace(part, rf"\n(?=[^\S\n]*{kind})", "\n" + _SEP))
    return cases.otherwise(part)


# A lambda's variable is worked out once, an expression once for every use; so each of these is a lambda of its own.
_BEGINS = r"(?![\p{Ll},;:.!?)\]}»”…]|[—–-][\s\p{Ll}\d]|\((?![^()]{0,400}[.!?][\"”’]*\))|\[(?:…|\.\.\.)\])"
_SPACED = rf"([.!?؟…‽]+{_CLOSE}*(?:[\s\u00a0\u202f]?»)?|(?<=\p{{IsGreek}})[;\u037e]{_CLOSE}*)(?=\s+{_BEGINS}\S)"
_FULL = r"([。！？｡]+[」』”’）)》〉]+(?!と|って|など|、|，)|[。！？｡]+(?![」』”’）)》〉。！？｡])|[।॥۔]+[\"'”’)]*)"
_THAI = (
    rf"(?<=[฀-๿])(?<!(?:^|[^฀-๿])(?:{_THAI_NO_END}))(\s+)(?=[฀-๿])(?!\s*(?:{_THAI_GOES_ON}))"
    rf"|(?<=[A-Za-z%])(\s+)(?=[฀-๿])(?!\s*(?:{_THAI_GOES_ON}))"
)


def _spaced(part: Column) -> Column:
    """Marks behind sentences that a blank follows."""
    return F.when(F.rlike(part, F.lit(rf"^\s*{_ITEM}")), part).otherwise(F.regexp_replace(part, _SPACED, "$1" + _SEP))


def _full(part: Column) -> Column:
    """Marks behind the full stops of scripts without blanks after them."""
    some = F.rlike(part, F.lit("[。！？｡।॥۔]")) & ~F.rlike(part, F.lit(rf"^\s*{_ITEM}"))
    return F.when(some, F.regexp_replace(part, _FULL, "$1" + _SEP)).otherwise(part)


def _thai(part: Column) -> Column:
    """Marks before the blanks between Thai clauses."""
    some = F.rlike(part, F.lit("[฀-๿]")) & ~F.rlike(part, F.lit(rf"^\s*{_ITEM}"))
    return F.when(some, F.regexp_replace(part, _THAI, _SEP + "$1$2")).otherwise(part)


def sentence_spans(text: Column) -> Column:
    """ARRAY<STRUCT<start_pos: INT, end_pos: INT>>: places of the units of text."""
    masked = _masked(text)
    blocks = F.split(F.regexp_replace(masked, r"(\n(?:[^\S\n]*\n)+)", "$1" + _SEP), _SEP)
    parts = F.split(F.array_join(F.transform(F.transform(blocks, _bullets), _headings), _SEP), _SEP)
    lines = F.split(F.array_join(F.transform(parts, _items), _SEP), _SEP)
    for mark in (_spaced, _full, _thai):
        lines = F.transform(lines, mark)
    marked = F.array_join(lines, _SEP)
    parts = F.transform(
        F.split(marked, _SEP),
        lambda p: F.struct(
            F.length(p).alias("n"), F.length(F.regexp_replace(p, r"(?U)^\s+", "")).alias("from_first"), F.length(F.regexp_replace(p, r"(?U)\s+$", "")).alias("to_last")
        ),
    )
    return _places(parts)


#: Parts that are placed together; the work on a text grows with its parts times this number, not with their square.
_TOGETHER = 128


def _places(parts: Column) -> Column:
    """Places of the parts that aren't blank. Parts are gathered in groups: the groups' beginnings are added up first, then the
    parts' places in each group."""
    none = F.array().cast("array<struct<start_pos:int,end_pos:int>>")

    def grouped(all_parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / _TOGETHER).cast("int"))
        return F.transform(numbers, lambda k: F.slice(all_parts, k * _TOGETHER + 1, F.lit(_TOGETHER)))

    def begun(groups: Column) -> Column:
        sizes = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda n, p: n + p["n"]))
        add = lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.array_append(acc["out"], acc["pos"]).alias("out"))
        return F.aggregate(sizes, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])

    step = lambda acc, p: F.struct(
        (acc["pos"] + p["n"]).alias("pos"),
        F.when(p["from_first"] > 0, F.array_append(acc["out"], F.struct((acc["pos"] + p["n"] - p["from_first"]).alias("start_pos"), (acc["pos"] + p["to_last"]).alias("end_pos")))).otherwise(acc["out"]).alias("out"),
    )
    placed = lambda g, at: F.aggregate(g, F.struct(at.alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    several = lambda groups: bound(begun(groups), lambda starts: F.flatten(F.transform(groups, lambda g, k: placed(g, F.get(starts, k)))))
    return bound(parts, lambda p: F.when(F.size(p) <= _TOGETHER, placed(p, F.lit(0))).otherwise(bound(grouped(p), several)))


def split_sentences(df: DataFrame, ident: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """ident, start_pos, end_pos (and the unit) of every sentence unit of every row. There is no shuffle, unless the table
    has fewer partitions than there are cores."""
    col = F.col("__text")
    rows = spread(df.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{ident}`"), F.col(f"`{text}`").alias("__text")))
    rows = rows.select(F.col(f"`{ident}`"), *([col] if with_text else []), F.explode(sentence_spans(col)).alias("span"))
    unit = [F.substring("__text", F.col("span.start_pos") + 1, F.col("span.end_pos") - F.col("span.start_pos")).alias("unit")] if with_text else []
    return rows.select(F.col(f"`{ident}`"), "span.start_pos", "span.end_pos", *unit)
