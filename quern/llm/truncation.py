"""Problem 2: texts that lost their end, found by where their last words usually stand.

All texts are cut into words (characters in scripts without blanks), with numbers, addresses and names replaced by
marks of their kind, and every run of three words is counted: how often in all, and how often at an end (of a text, or
of a block of it; texts with the same last words count once). Words are counted as they are, with their punctuation,
and by the class of their last characters: letter, comma, stop, closing bracket, whole bracket. A text's last three
words are joined with the counts and the text is a case if they are frequent inside texts but almost never stand at an
end.

* Where the three words themselves are too rare to tell, the last two count, and where those are too rare, the three
  words' classes: three classes are frequent anywhere, so a last word that is broken, and so unknown, is judged by how
  often texts end in a word of its class behind such words.
* A last word that may be a broken one (it ends in a letter, a digit or a bracket opened before) must also be a usual
  continuation of the words before it, or it is a broken form of what follows there.
* A text whose last sentence is closed, by its script's full stop and outside any quotation, is a case only if its last
  words stand at ends so much less often than sentences do that chance is no explanation ("... with those of vs.").
* A mark that replaces the rest is taken off first. Then the last words would have to be at ends nearly always.

Texts are cut into words once, whole; the words are written to the shared folder and counted from there. Counts and
joins are SQL expressions over all texts; nothing is collected or broadcast.

Defined results: null, empty and blank texts are no cases; the flag `truncated` isn't read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import Scratch

#: Words seen in fewer places say too little; one word less is looked at then.
SEEN = 12
#: Last words are usual at ends if they stand there in USUAL of their places, follow the words before them in FOLLOWS of
#: those words' places, and stand at ends of LEAST texts or blocks.
USUAL, FOLLOWS, LEAST = 0.05, 0.015, 3
#: A single last word is usual at ends if it stands inside texts KNOWN times, and WHOLE of its places are ends.
KNOWN, WHOLE = 8, 0.12
#: With a mark for the lost rest, only last words that stand at ends in MARKED of their places are taken for an end.
MARKED = 0.9
#: Closed sentences stand at an end in at least CLOSED of their places; chance must be out by so many deviations.
CLOSED, DEVIATIONS = 0.03, 3.5
#: Texts with the same last words count as one end; so many words are compared.
TAIL = 10

# Links to the whole text, and marks that replace a lost rest.
_MORE = ["Read more", "Continue reading", "Weiterlesen", "Lire la suite", "Leer más", "Seguir leyendo", "Читать далее", "続きを読む", "阅读全文"]
_MARKS = ["[…]", "[...]", "[&hellip;]", "…", "...", "&hellip;", "�"]
_MARKED_END = r"(?:\s*+(?:\[(?:…|\.\.\.|&hellip;)\]|…|\.\.\.+|&hellip;|�+))+$"
# Escapes of marks that matter for ends.
_ESCAPES = {"&ldquo;": "“", "&rdquo;": "”", "&lsquo;": "‘", "&rsquo;": "’", "&laquo;": "«", "&raquo;": "»", "&bdquo;": "„", "&quot;": '"', "&#39;": "'", "&apos;": "'",
            "&mdash;": "—", "&ndash;": "–", "&nbsp;": " ", "&euro;": "€", "&amp;": "&", "&hellip;": "…", "&#8220;": "“", "&#8221;": "”", "&#8217;": "’", "&#8230;": "…"}


def _unescaped(text: Column) -> Column:
    plain = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ESCAPES.items(), text)
    return F.when(F.rlike(text, F.lit("&#?[a-z0-9]{2,6};")), plain).otherwise(text)


_UPPER, _LOWER, _CJK = "[A-ZÀ-ÞΑ-ΩА-Я]", "[a-zà-ÿ'’α-ώа-я]", "\u3040-\u30ff\u3400-\u9fff"
_BLANKS = "\n\t\r\u00a0\u202f\u2009\u3000"
_STOP = "\f"  # stands as a word between two blocks


def _split_words(df: DataFrame, text: Column) -> DataFrame:
    """df with words: those of text with their punctuation, kinds in place of numbers, addresses and names.

    In steps, since an expression used twice in one step is worked out twice.
    """
    lines = r"\n(?:[^\S\n]*\n)+|\n(?=\s*(?:[•*#–—\-]|\d{1,2}[.)])\s)"
    name = rf"{_UPPER}{_LOWER}{{3,}}+(?:-[a-z]{{2}}-{_UPPER}{_LOWER}++)?+"
    rows = df.withColumn("words", text)
    rows = rows.withColumn("words", F.when(F.contains("words", F.lit("\n")), F.regexp_replace("words", lines, "\f")).otherwise(F.col("words")))
    t = F.regexp_replace("words", r"(?<=[a-z0-9])\.[a-z]{3,}+(?:/[\w./?=&%-]*+)?", ".U")
    t = F.regexp_replace(t, rf"{name}(?![:：])(?:[ \n]{name}(?!:))*+", "X")
    rows = rows.withColumn("words", F.regexp_replace(t, "[0-9](?:[.,\u00a0\u202f]?[0-9])*+", "0"))
    apart = F.regexp_replace("words", f"([{_CJK}。！？、，：；「」『』（）])", " $1 ")
    rows = rows.withColumn("words", F.when(F.rlike("words", F.lit(f"[{_CJK}]")), apart).otherwise(F.col("words")))
    t = F.col("words")
    # Plain replacements are many times faster than a translation or an expression here.
    for old, new in [(c, " ") for c in _BLANKS] + [("\f", f" {_STOP} ")] + [("    ", " "), ("  ", " "), ("  ", " ")]:
        t = F.replace(t, F.lit(old), F.lit(new))
    return rows.withColumn("words", F.split(F.trim(t), " "))


def _before(words: Column, i: Column, k: int) -> Column:
    """The word k places before the i-th, null where its block begins in between."""
    near = F.get(words, i - 1)
    if k == 1:
        return F.when(near != _STOP, near)
    far = F.get(words, i - 2)
    return F.when((near != _STOP) & (far != _STOP), far)


#: Characters that close a sentence, that may follow those, that only interrupt, and that open a bracket.
_STOPS, _CLOSERS, _PAUSES, _OPENERS = ".!?。！？।॥؟۔", "\"'”’»“)]」』）", ",;:、，：；،–—-", "(（[「『“„«\""
_WHITE = " \t\n\r\f\x0b\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x85\x1c\x1d\x1e\x1f"
PLAIN, PAUSE, STOP, CLOSER, CLOSED_IN, WHOLE_IN, NONE = range(7)
_CLASS_OF = [PLAIN] + [PAUSE] * len(_PAUSES) + [STOP] * len(_STOPS) + [CLOSER] * len(_CLOSERS)


def _mark(char: Column) -> Column:
    """PLAIN, PAUSE, STOP or CLOSER, whichever a character is; null for null."""
    return F.get(F.lit(_CLASS_OF), F.instr(F.lit(_PAUSES + _STOPS + _CLOSERS), char))


def _class(word: Column) -> Column:
    """The class of a last word: PLAIN letters and digits, PAUSE, STOP (perhaps with closing marks behind it), CLOSED_IN
    closing marks of a bracket opened before, WHOLE_IN of one opened in the word itself."""
    at = lambda k: _mark(F.substring(word, -k, 1))
    inner = F.when((at(2) == STOP) | (at(2) == CLOSER) & (at(3) == STOP), STOP).when(F.left(word, F.lit(1)).isin(*_OPENERS), WHOLE_IN).otherwise(CLOSED_IN)
    return F.when(at(1) == CLOSER, inner).otherwise(at(1))


def _keys(a: Column, b: Column, c: Column) -> list[Column]:
    """Hashes of three, two and one words, and the three classes; nulls stand for what is before the first of a block."""
    near = lambda w: F.coalesce(_mark(F.right(w, F.lit(1))), F.lit(NONE))
    return [F.xxhash64(a, b, c).alias("h3"), F.xxhash64(b, c).alias("h2"), F.xxhash64(c).alias("h1"), (near(a) * 64 + near(b) * 8 + _class(c)).alias("k3")]


def _positions(texts: DataFrame) -> DataFrame:
    """h3, h2, h1, k3, end of every word but the texts' last ones: end says whether a block ends there.

    The words are one array per text, exploded with their places, so all of this is generated code.
    """
    words, i, c = F.col("words"), F.col("i"), F.col("c")
    each = texts.select("words", F.posexplode("words").alias("i", "c")).where((c != _STOP) & (i < F.size(words) - 1))
    return each.select(*_keys(_before(words, i, 2), _before(words, i, 1), c), (F.get(words, i + 1) == _STOP).cast("int").alias("end"))


def _last(words: Column) -> list[Column]:
    """The keys of the last word, the hashes before2 and before1 of the words before it, and tail, of all words
    of the ending."""
    i = F.size(words) - 1
    a, b, c = _before(words, i, 2), _before(words, i, 1), F.get(words, i)
    tail = F.xxhash64(words)
    return [*_keys(a, b, c), F.when(b.isNotNull(), F.xxhash64(a, b)).alias("before2"), F.when(b.isNotNull(), F.xxhash64(b)).alias("before1"), tail.alias("tail")]


def _stripped(text: Column, marks: str) -> Column:
    """text without the characters of marks at its end; most texts have none, and are left alone."""
    return F.when(F.right(text, F.lit(1)).isin(*marks), F.rtrim(text, F.lit(marks))).otherwise(text)


def _closed(text: Column) -> Column:
    """The last sentence of a text has a full stop of its script, and no quotation is open in its last block."""
    bare = _stripped(text, _CLOSERS)
    stop = F.right(bare, F.lit(1)).isin(*_STOPS) | F.right(bare, F.lit(1)).isin(";", "\u037e") & F.rlike(F.right(bare, F.lit(2)), F.lit(r"\p{IsGreek}"))
    block = F.substring_index(F.replace(text, F.lit("\r"), F.lit("")), "\n\n", -1)

    def balanced(t: Column) -> Column:
        opened = F.rlike(t, F.lit(r"(?:«[^»]*+|「[^」]*+|\([^)]*+|（[^）]*+|„[^“”]*+)$"))
        return ~opened & (F.contains(t, F.lit("„")) | ~F.rlike(t, F.lit("“[^”]*+$")))

    return stop & F.get(F.transform(F.array(block), lambda t: ~F.rlike(t, F.lit("[«「(（„“]")) | balanced(t)), F.lit(0))


def _prepared(df: DataFrame, kind: str, ident: str, text: str, by: str) -> DataFrame:
    """kind, row_no, source, marked, t: the texts that aren't blank, without marks and white space at their end."""
    col = F.col(f"`{text}`")
    rows = df.where(F.length(F.trim(col)) > 0).select(F.lit(kind).alias("kind"), F.col(f"`{ident}`").cast("bigint").alias("row_no"), F.col(f"`{by}`").alias("source"), _unescaped(col).alias("t"))
    rows = rows.withColumn("t", _stripped(F.col("t"), _WHITE))
    link = reduce(lambda c, m: c.when(F.endswith("t", F.lit(m)), F.rtrim(F.left("t", F.length("t") - len(m)), F.lit(_WHITE))), _MORE[1:], F.when(F.endswith("t", F.lit(_MORE[0])), F.rtrim(F.left("t", F.length("t") - len(_MORE[0])), F.lit(_WHITE))))
    rows = rows.withColumn("t", link.otherwise(F.col("t")))
    rows = rows.withColumn("marked", reduce(lambda a, b: a | b, [F.endswith("t", F.lit(m)) for m in _MARKS]))
    return rows.withColumn("t", F.when(F.col("marked"), _stripped(F.regexp_replace("t", _MARKED_END, ""), _WHITE)).otherwise(F.col("t")))


def find_truncated(parts: Sequence[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """kind, row_no, source, marked, closed, cut, by and the counts of every text that isn't blank.

    parts: (table, kind, identifier column, text column, source column); the counts are taken over all parts together.
    cut says whether the text lost its end; by names the counts that settled it: 3 words, 2 words, 1 word or classes.
    """
    scratch = Scratch(parts[0][0].sparkSession, "truncation")
    texts = reduce(DataFrame.unionByName, [_prepared(*p) for p in parts])
    texts = _split_words(texts.withColumn("closed", _closed(F.col("t"))), F.col("t"))
    ending = F.slice("words", F.greatest(F.lit(1), F.size("words") + 1 - TAIL), F.lit(TAIL)).alias("ending")
    # No filter on the words before they are written: it would be worked out at the scan, once more.
    texts = scratch.write(texts.select("kind", "row_no", "source", "marked", "closed", ending, "words"), "texts").where(F.get("ending", F.lit(0)) != "")
    places = _positions(texts)
    first = [F.first(x).alias(x) for x in ("h2", "h1", "k3")]
    count3 = scratch.write(places.groupBy("h3").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("e"), *first), "count3")

    last = texts.select("kind", "row_no", "source", "marked", "closed", *_last(F.col("ending")))
    # Texts that end alike, a third of all perhaps, are one row from here on.
    keys = ["h3", "h2", "h1", "k3", "before2", "before1"]
    tails = last.groupBy(*keys, "tail").agg(F.count_if(~F.col("marked")).alias("texts"))
    ends = tails.groupBy(*keys).agg(F.sum("texts").alias("texts"), F.count_if(F.col("texts") > 0).alias("ends"))
    ends = scratch.write(ends, "ends")

    def counted(key: str, k: int) -> DataFrame:
        """n: places; e: ends, of texts that end alike only one; t: ends, all of them; i: places inside texts."""
        here = ends.groupBy(key).agg(F.sum("ends").alias("x"), F.sum("texts").alias("all"))
        places = count3.groupBy(key).agg(F.sum("n").alias("n"), F.sum("e").alias("b"))
        both = here.join(places, key, "left").na.fill(0, ["n", "b"])
        return both.select(key, (F.col("n") + F.col("x")).alias(f"n{k}"), (F.col("b") + F.col("x")).alias(f"e{k}"), (F.col("b") + F.col("all")).alias(f"t{k}"), (F.col("n") - F.col("b")).alias(f"i{k}"))

    n2, n1 = count3.groupBy("h2").agg(F.sum("n").alias("n")), count3.groupBy("h1").agg(F.sum("n").alias("n"))
    table = ends.drop("texts", "ends").join(counted("h3", 3), "h3").join(counted("h2", 2), "h2").join(counted("h1", 1), "h1").join(counted("k3", 0), "k3")
    table = table.join(n2.select(F.col("h2").alias("before2"), F.col("n").alias("c2")), "before2", "left").join(n1.select(F.col("h1").alias("before1"), F.col("n").alias("c1")), "before1", "left")

    fair = lambda k: (F.col(f"e{k}") >= LEAST) & (F.col(f"e{k}") >= USUAL * F.col(f"n{k}"))
    # A word that stands inside texts and, often enough, at ends isn't a broken one; a mark of a kind says too little alone.
    # Nor is one broken that ends in a stop or in a bracket of its own. Others must be usual behind the words before them.
    mark = reduce(lambda a, b: a | b, [F.col("h1") == F.xxhash64(F.lit(x)) for x in "0XU"])
    known = ~mark & (F.col("i1") >= KNOWN) & (F.col("t1") >= WHOLE * (F.col("i1") + F.col("t1")))
    whole_word = (F.col("k3") % 8).isin(STOP, WHOLE_IN)
    follows = lambda k, before: whole_word | known | (F.col(f"e{k}") >= FOLLOWS * F.coalesce(F.col(before), F.lit(0)))
    classes = F.when(whole_word, fair(0)).otherwise(known)
    alone = F.col("before1").isNull()
    seen3, seen2 = ~alone & (F.col("n3") >= SEEN), ~alone & (F.col("n2") >= SEEN)
    usual = F.when(seen3, fair(3) & follows(3, "c2")).when(seen2, fair(2) & follows(2, "c1")).otherwise(classes)
    by = F.when(seen3, "3 words").when(seen2, "2 words").when(F.col("i1") >= KNOWN, "1 word").otherwise("classes")
    never = reduce(lambda a, b: a | b, [F.col(f"t{k}") + DEVIATIONS * F.sqrt(F.col(f"t{k}")) + DEVIATIONS < CLOSED * F.col(f"n{k}") for k in (3, 2, 1)])
    table = table.select("h3", usual.alias("usual"), never.alias("never"), by.alias("by"), *[f"{x}{k}" for k in (3, 2, 1, 0) for x in "neti"], "c2", "c1")
    # The last three words settle the two before the last, so h3 alone is the key.
    table = table.dropDuplicates(["h3"])
    most = F.col("e3") >= F.greatest(F.lit(LEAST), MARKED * F.col("n3"))
    cut = F.when(F.col("marked"), ~(F.col("closed") & most)).when(F.col("closed"), F.col("never")).otherwise(~F.col("usual"))
    return last.join(table, "h3").select("kind", "row_no", "source", "marked", "closed", cut.alias("cut"), "by", "usual", "never", "n3", "e3", "n2", "e2", "n1", "e1", "n0", "e0", "c2", "c1", "i1")


def truncation_report(found: DataFrame) -> DataFrame:
    """kind, source, texts, cut, cut_share: how often each source's texts lost their end."""
    n, cut = F.count(F.lit(1)), F.count_if("cut")
    return found.groupBy("kind", "source").agg(n.alias("texts"), cut.alias("cut"), (cut / n).alias("cut_share"))
