"""Problem 5: the blocks of a page that belong to its article.

A page's markup becomes a tree of containers with the visible blocks in order. Each block gets features of its place in
the tree (what its containers are called and hold, how dense in text and links they are, what stands beside it), of its
text, and of the blocks before and after it. Boosted trees, trained here, give each block log-odds; a decoding from the
leaves up then chooses, container by container, whether it holds any of the article, so that no block is chosen in a
container that as a whole speaks against it.

There are no labels in the data. They are made on a bounded sample of SAMPLE pages with clear markup: the article is
what stands in the innermost container of the heading, without by-lines, dates and references, and without texts that
mostly stand elsewhere on other pages. Every training page is used three times: as it is, with its containers hidden,
and with containers and heading hidden, so that the trees also learn to do without them where markup is missing, broken
or misleading.

A trained model is kept below the shared folder under the fingerprint of the pages' files, so the same pages train once.

Defined results: pages with null or empty html or text have no blocks. Blocks are those of `text` (parts between empty
lines); where the markup yields others, they are matched by their words. Without any page clear enough for training, the
labelling rules themselves decide.
"""

from __future__ import annotations

import hashlib
import html as markup
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.trees import BoostedTrees
from quern.session import fingerprint, read_json, shared_dir, spread, write_json

#: Training pages: those whose identifiers have the smallest hashes.
SAMPLE = 1500
#: Version of features, labels and training; models of another version aren't used.
VERSION = 2
#: Log-odds that a container has to win back before any of its blocks is chosen.
PENALTY = 1.0

# Elements of HTML that hold others, that run within a line, and whose text isn't seen.
_CONTAINERS = frozenset("html body div section article main nav header footer aside table tbody tr td th ul ol dl form figure center details".split())
_INLINE = frozenset("a abbr b bdi big cite code dfn em font i kbd label mark q s small span strike strong sub sup time tt u var wbr img".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\w[^>]*>|<(script|style|noscript|template|svg|head)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|width)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-ZÀ-ÞΑ-ΩА-Я][a-zà-ÿα-ωά-ώа-яё'’]{3,}(?:-on-[A-Z]\w*)?(?:[  ][A-ZÀ-ÞΑ-ΩА-Я][a-zà-ÿα-ωά-ώа-яё'’]{3,}(?:-on-[A-Z]\w*)?)*")
_NUMBER = re.compile(r"\d[\d.,:   ]*")
_END = re.compile(r"[.!?。！？।؟;…][\"'”’»“)\]」』）]*$")
# By-lines and dates, and references to other pages, in the forms that such lines have anywhere.
_META = re.compile(r"^(?:By|Von|Par|Por|Di|От|Του)\s+\S+(?:\s+\S+){0,3}$|^(?:[^\s.!?]+(?:\s[^\s.!?]+)?[,:]?\s)?\d{1,2}\.?\s(?:de\s)?[^\W\d]+\.?\s(?:de\s)?\d{4}(?:[,\s]+\d{1,2}[:.h]\d{2})?$|^(?:Published|Updated|Posted|Last updated)\b.{0,40}\d")
_REFERENCE = re.compile(r"^(?:See also|Read (?:also|more|next)|Also read|More|Related|Lesen Sie auch|Siehe auch|Mehr dazu|À lire(?: aussi)?|Lire aussi|Voir aussi|Lea también|Ver también|Leer más|Читайте также|См\. также|Διαβάστε επίσης|関連記事|相关阅读|اقرأ أيضا|यह भी पढ़ें|อ่านเพิ่มเติม)\s?[:：]", re.I)


def key_of(text: str) -> str:
    """The text with names and numbers replaced, to find the same phrase again. Where little is left, names stay."""
    key = _NAME.sub("X", text)
    if len(key) - key.count("X") < 5:
        key = text.lower()
    return _NUMBER.sub("0", key)


class Page:
    """Blocks of a page in order: text, tag, link characters, container; and the containers: token, parent."""

    __slots__ = ("texts", "tags", "links", "homes", "tokens", "parents")

    def __init__(self, source: str):
        self.texts, self.tags, self.links, self.homes = [], [], [], []
        self.tokens, self.parents = ["body"], [-1]
        stack, leaf, linked, inside, parts, at = [("body", 0)], "", 0, False, [], 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = _SPACE.sub(" ", markup.unescape("".join(parts))).strip()
                parts.clear()
                if text:
                    self.texts.append(text)
                    self.tags.append(leaf)
                    self.links.append(min(linked, len(text)))
                    self.homes.append(stack[-1][1])
            linked = 0

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at : m.start()]
                parts.append(piece)
                if inside:
                    linked += len(piece)
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name, closing = name.lower(), bool(m[2])
            if name == "a":
                inside = not closing
            elif name == "br":
                parts.append(" ")
            elif name in _INLINE:
                pass
            elif name in _CONTAINERS:
                flush()
                leaf = ""
                if name in ("html", "body"):
                    continue
                if not closing:
                    found = {a[1].lower(): (a[2] or a[3] or a[4] or "").lower() for a in _ATTRIBUTE.finditer(m[4])} if m[4] else {}
                    token = name + "".join(f" {k}={v}" for k, v in sorted(found.items()))
                    self.tokens.append(token)
                    self.parents.append(stack[-1][1])
                    stack.append((name, len(self.tokens) - 1))
                elif any(n == name for n, _ in stack[1:]):
                    while stack.pop()[0] != name:
                        pass
            else:
                flush()
                leaf = "" if closing else name
        if at < len(source):
            parts.append(source[at:])
        flush()


def blocks_of(text: str) -> list[str]:
    return [_SPACE.sub(" ", b).strip() for b in text.split("\n\n")]


def aligned(page: Page, text: str) -> list[int]:
    """For every block of text the block of the page with the same words, -1 where there is none."""
    wanted = blocks_of(text)
    if wanted == page.texts:
        return list(range(len(wanted)))
    places = defaultdict(list)
    for i, t in enumerate(page.texts):
        places[t].append(i)
    found, last = [], -1
    for w in wanted:
        i = next((i for i in places.get(w, ()) if i > last), -1)
        found.append(i)
        last = max(last, i)
    return found


def heading_of(page: Page) -> int:
    return next((i for i, t in enumerate(page.tags) if t == "h1"), -1)


def chain(page: Page, home: int) -> list[int]:
    out = []
    while home >= 0:
        out.append(home)
        home = page.parents[home]
    return out


def rule_labels(page: Page) -> np.ndarray | None:
    """1 for blocks in the innermost container of the heading, 0 for others; None where that says little."""
    top = heading_of(page)
    n = len(page.texts)
    if top < 0:
        return None
    root = page.homes[top]
    inside = np.array([root in chain(page, h) for h in page.homes])
    if root == 0 or not inside[top:].sum() >= 3 or inside.sum() > 0.85 * n or inside[-1] or not (~inside[top:]).sum() >= 3:
        return None
    return inside.astype(float)


def _cleaned(page: Page, labels: np.ndarray) -> np.ndarray:
    out = labels.copy()
    for i, t in enumerate(page.texts):
        if out[i] and (_META.search(t) or _REFERENCE.search(t)):
            out[i] = 0.0
    return out


class Phrases:
    """How often a phrase, or a container's name, belongs to articles."""

    def __init__(self):
        self.sums: dict[str, list[float]] = {}

    def add(self, key: str, y: float) -> None:
        s = self.sums.setdefault(key, [0.0, 0])
        s[0] += y
        s[1] += 1

    def rate(self, key: str, prior: float, without: float | None = None, weight: float = 3.0) -> tuple[float, float]:
        s, n = self.sums.get(key, (0.0, 0))
        if without is not None and n:
            s, n = s - without, n - 1
        return (s + weight * prior) / (n + weight), float(n)


_TAGS = ["p", "h1", "h2", "h3", "li", "blockquote", "figcaption"]


def features(page: Page, phrases: Phrases, names: Phrases, labels: np.ndarray | None = None, hide: int = 0) -> np.ndarray:
    """A row per block. labels: those of this page in training, left out of the rates. hide: 1 containers, 2 heading too."""
    n = len(page.texts)
    lengths = np.array([len(t) for t in page.texts], float)
    links = np.array(page.links, float)
    tags = page.tags
    ends = np.array([bool(_END.search(t)) for t in page.texts], float)
    prior = 0.5
    rates = [phrases.rate(key_of(t), prior, None if labels is None else labels[i]) for i, t in enumerate(page.texts)]
    rate, seen = np.array([r for r, _ in rates]), np.array([s for _, s in rates])
    top = -1 if hide == 2 else heading_of(page)
    foreign = (rate < 0.2) & (seen >= 3)
    head_like = np.array([t in ("h2", "h3", "h4", "h5", "h6") for t in tags]) | ((lengths < 40) & (ends == 0))
    link_li = links > 0.8 * lengths
    prose = (lengths > 40) & (ends == 1) & (links < 0.3 * lengths)
    index = np.arange(n)
    after_top = index >= top if top >= 0 else np.zeros(n, bool)
    # A foreign heading before links or teasers starts a list of other pages.
    starts = foreign & head_like & np.append(link_li[1:], False)
    tail = np.cumsum(starts & (index > max(top, 0)))
    linked_runs = np.cumsum(link_li)
    prose_before, prose_after = np.cumsum(prose) - prose, prose[::-1].cumsum()[::-1] - prose
    foreign_before, foreign_after = np.cumsum(foreign) - foreign, foreign[::-1].cumsum()[::-1] - foreign
    own = (rate > 0.7) & (seen >= 1) | prose & (rate >= 0.5)
    own_after = own[::-1].cumsum()[::-1] - own

    def shifted(v: np.ndarray, k: int, fill: float) -> np.ndarray:
        out = np.full(n, fill)
        if k > 0:
            out[k:] = v[:-k] if k < n else v[:0]
        elif -k < n:
            out[:k] = v[-k:]
        return out

    since_link = index - np.maximum.accumulate(np.where(link_li, index, -99))
    to_link = np.minimum.accumulate(np.where(link_li, index, n + 99)[::-1])[::-1] - index
    since_foreign = index - np.maximum.accumulate(np.where(foreign, index, -99))
    since_tail = index - np.maximum.accumulate(np.where(starts, index, -99))
    if hide:
        place = np.full((n, 9), -1.0)
    else:
        held, chars, linked, proses = Counter(), Counter(), Counter(), Counter()
        for i, h in enumerate(page.homes):
            held[h] += 1
            chars[h] += lengths[i]
            linked[h] += links[i]
            proses[h] += prose[i]
        by_home = {}
        for h in set(page.homes):
            up = chain(page, h)
            r = [names.rate(page.tokens[c], prior)[0] for c in up if c]
            near = names.rate(page.tokens[h], prior)[0] if h else 0.5
            by_home[h] = [near, min(r, default=0.5), max(r, default=0.5), len(up), held[h], chars[h] / max(1, held[h]), linked[h] / max(1.0, chars[h]), proses[h] / held[h], float(top >= 0 and page.homes[top] == h)]
        place = np.array([by_home[h] for h in page.homes])
    title = np.array([page.texts[top] == t for t in page.texts], float) if top >= 0 else np.zeros(n)
    meta = np.array([2.0 if _META.search(t) else 1.0 if _REFERENCE.search(t) else 0.0 for t in page.texts])
    marks = np.array([sum(t.count(c) for c in "|›>·") for t in page.texts], float)
    odd = np.array([("©" in t) + 2 * ("cookie" in t.lower()) for t in page.texts], float)
    digits = np.array([sum(c.isdigit() for c in t) for t in page.texts], float) / np.maximum(1, lengths)
    shapes = np.array([[float(t == k) for k in _TAGS] for t in tags]) if n else np.zeros((0, len(_TAGS)))
    if hide == 2 and n:
        shapes[:, 1] = 0.0
    return np.column_stack([
        shapes, np.log1p(lengths), links / np.maximum(1, lengths), ends, rate, np.log1p(seen), marks, odd, digits, meta, title,
        np.where(top >= 0, np.clip(index - top, -20, 40), -50), after_top, index / max(1, n), n - index,
        tail, np.minimum(linked_runs, 20), np.minimum(prose_before, 10), np.minimum(prose_after, 10), np.minimum(foreign_before, 15), np.minimum(foreign_after, 15), np.minimum(own_after, 15),
        np.minimum(since_link, 30), np.minimum(to_link, 30), np.minimum(since_foreign, 30), np.minimum(since_tail, 30),
        shifted(rate, 1, 0.3), shifted(rate, 2, 0.3), shifted(rate, -1, 0.3), shifted(rate, -2, 0.3), shifted(prose, 1, 0), shifted(prose, -1, 0), shifted(link_li, 1, 0), shifted(link_li, -1, 0),
        shifted(np.log1p(lengths), 1, 0), shifted(np.log1p(lengths), -1, 0), shifted(head_like, 1, 0),
        place,
    ]).astype(float)


class Model:
    def __init__(self, phrases: Phrases, names: Phrases, trees: BoostedTrees | None):
        self.phrases, self.names, self.trees = phrases, names, trees

    def to_json(self) -> dict:
        trees = None if self.trees is None else {"base": self.trees.base, **{k: getattr(self.trees, k).tolist() for k in ("features", "cuts", "leaves")}}
        return {"phrases": self.phrases.sums, "names": self.names.sums, "trees": trees}

    @classmethod
    def from_json(cls, kept: dict) -> Model:
        phrases, names, trees = Phrases(), Phrases(), None
        phrases.sums, names.sums = kept["phrases"], kept["names"]
        if kept["trees"] is not None:
            trees = BoostedTrees()
            trees.base = kept["trees"]["base"]
            trees.features, trees.cuts, trees.leaves = (np.array(kept["trees"][k]) for k in ("features", "cuts", "leaves"))
        return cls(phrases, names, trees)

    def log_odds(self, pages: list[Page]) -> list[np.ndarray]:
        if self.trees is None:
            found = [rule_labels(p) for p in pages]
            return [(_cleaned(p, f if f is not None else np.ones(len(p.texts))) - 0.5) * 4 for p, f in zip(pages, found)]
        x = [features(p, self.phrases, self.names) for p in pages]
        sizes = np.cumsum([len(v) for v in x])[:-1]
        return np.split(self.trees.log_odds(np.concatenate(x)), sizes) if pages else []


def decode(page: Page, odds: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The blocks chosen: the best consistent choice of containers, from the innermost out."""
    kids, blocks = defaultdict(list), defaultdict(list)
    for c, p in enumerate(page.parents):
        if p >= 0:
            kids[p].append(c)
    for i, h in enumerate(page.homes):
        blocks[h].append(i)
    gain = np.zeros(len(page.parents))
    for c in range(len(page.parents) - 1, -1, -1):  # containers come after their parents
        total = sum(max(0.0, odds[i]) for i in blocks[c]) + sum(gain[k] for k in kids[c])
        gain[c] = max(0.0, total - (penalty if c else 0.0))
    open_ = np.zeros(len(page.parents), bool)
    for c in range(len(page.parents)):
        open_[c] = (c == 0 or open_[page.parents[c]]) and (c == 0 or gain[c] > 0)
    # An exact check: an article begins with its heading, where it has one.
    top = heading_of(page)
    return np.array([odds[i] > 0 and open_[h] and i >= top for i, h in enumerate(page.homes)], bool)


def train(sources: list[str]) -> Model:
    """A model of pages' markup; the labels are made here."""
    pages = [Page(s) for s in sources]
    first = [(p, y) for p in pages if (y := rule_labels(p)) is not None]
    phrases, names = Phrases(), Phrases()
    where: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for p, y in first:
        for t, v in zip(p.texts, y):
            where[key_of(t)][int(v)] += 1
    ready = []
    for p, y in first:
        y = _cleaned(p, y)
        top = heading_of(p)
        for i, t in enumerate(p.texts):
            out, into = where[key_of(t)]
            if y[i] and i != top and out >= 3 and out > into and p.tags[i] in ("p", "", "h2", "h3", "li", "div") and len(t) < 160:
                y[i] = 0.0
        ready.append((p, y))
        for t, v in zip(p.texts, y):
            phrases.add(key_of(t), v)
        for c in range(1, len(p.tokens)):
            inside = [y[i] for i, h in enumerate(p.homes) if c in chain(p, h)]
            if inside:
                names.add(p.tokens[c], sum(inside) / len(inside))
    if len(ready) < 5:
        return Model(phrases, names, None)
    x = np.concatenate([features(p, phrases, names, y, hide) for hide in (0, 1, 2) for p, y in ready])
    y = np.concatenate([y for _ in range(3) for _, y in ready])
    slim = Phrases()
    slim.sums = {k: v for k, v in phrases.sums.items() if v[1] >= 2}
    return Model(slim, names, BoostedTrees().fit(x, y))


def _model(pages: DataFrame, rows: DataFrame, ident: str, sample: int) -> Model:
    """The kept model of these files, or a new one: identifiers are read alone to choose the sample, then its markup."""
    spark, path = pages.sparkSession, None
    if (files := fingerprint(pages)) is not None:
        key = hashlib.sha256(json.dumps([VERSION, sample, ident, files]).encode()).hexdigest()[:24]
        path = f"{shared_dir(spark)}/quern-kept/boilerplate-{key}.json"
        if (kept := read_json(spark, path)) is not None:
            return Model.from_json(kept)
    chosen = [r[0] for r in pages.select(F.col(f"`{ident}`").alias("ident")).orderBy(F.xxhash64("ident"), "ident").limit(sample).collect()]
    model = train([r[0] for r in rows.where(F.col("ident").isin(chosen)).select("html").limit(2 * sample).collect()])
    if path is not None:
        write_json(spark, path, model.to_json())
    return model


def article_blocks(pages: DataFrame, ident: str = "page_id", source: str = "html", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """ident, block_no of every block of every page that belongs to the article. Pages stay where they are, unless the
    table has fewer partitions than there are cores."""
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{source}`").alias("html"), F.col(f"`{text}`").alias("text")).where((F.length("html") > 0) & (F.length("text") > 0))
    model = _model(pages, rows, ident, sample)
    shared = spark.sparkContext.broadcast(model)  # phrases of at most `sample` pages and the trees

    def chosen_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parsed = [Page(h) for h in part["html"].to_pylist()]
                kept = [i for i, p in enumerate(parsed) if p.texts]
                odds = shared.value.log_odds([parsed[i] for i in kept])
                names, texts = part["ident"].to_pylist(), part["text"].to_pylist()
                for i, o in zip(kept, odds):
                    take = decode(parsed[i], o)
                    for number, place in enumerate(aligned(parsed[i], texts[i])):
                        if place >= 0 and take[place]:
                            ids.append(names[i])
                            numbers.append(number)
            yield pa.record_batch([pa.array(ids, batch.schema.field("ident").type), pa.array(numbers, pa.int32())], ["ident", "block_no"])

    kind = rows.schema["ident"].dataType.simpleString()
    return spread(rows).mapInArrow(chosen_blocks, f"ident {kind}, block_no INT").withColumnRenamed("ident", ident)
