"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score above zero and tags below,
by weights learnt from pages that mark their article themselves; the stretch
with the highest sum is the content, found in one scan.  Menus, forms, adverts
and the like are left out by their own markup.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's own element kinds.
RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|title|select"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements, and words of class, id or role, that are never article text.
ASIDE = frozenset("nav footer aside form button dialog menu fieldset head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "consent disqus dialog feedback footer login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
CONTENT = frozenset("article main".split())

# A tag ends before the next "<" outside of quotes, so an open one is given up at once.
INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b{INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)({INSIDE})>|</?[a-zA-Z][^<>]*+>|<[!?/][^<>]*+>",
    re.S | re.I,
)
#: Parts of a name that say something is not there, or only beside: no-sidebar, has-banner, ad-free.
QUALIFIERS = frozenset("no non not without with has have hide hidden free".split())
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")

TEXT, OPEN, CLOSE = range(3)
FOUND = "page_id long, url string, text string"
UNKNOWN_WORD, UNKNOWN_TAG, LEAST, MOST = 1.0, -1.0, 0.05, 4.0
PAGES_AT_ONCE = 64


def _named_aside(attributes: str) -> bool:
    for match in NAMED.finditer(attributes):
        value = match[1] or match[2] or match[3] or ""
        for name in value.split():
            parts = [p.lower() for p in PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
            if parts and (parts[0] in ASIDE_WORDS or parts[-1] in ASIDE_WORDS) and not (parts[0] in QUALIFIERS or parts[-1] in QUALIFIERS):
                return True
    return False


def parse(page: str) -> list[tuple[int, str, bool]]:
    """(kind, tag or text, aside) in page order; raw elements and comments are gone."""
    tokens: list[tuple[int, str, bool]] = []
    at = 0
    for match in TOKEN.finditer(page):
        if match.start() > at:
            tokens.append((TEXT, page[at : match.start()], False))
        at = match.end()
        name = (match[3] or "").lower()
        if name:
            tokens.append((CLOSE, name, False) if match[2] else (OPEN, name, name in ASIDE or bool(match[4]) and _named_aside(match[4])))
        elif match[1]:
            tokens.append((OPEN, match[1].lower(), False))
    if at < len(page):
        tokens.append((TEXT, page[at:], False))
    return tokens


def matched(tokens: list[tuple[int, str, bool]]) -> dict[int, int]:
    """Where each element that closes does so, by the place of its start."""
    waiting: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, (kind, name, _) in enumerate(tokens):
        if kind == OPEN and name not in VOID:
            waiting.setdefault(name, []).append(i)
        elif kind == CLOSE and waiting.get(name):
            ends[waiting[name].pop()] = i
    return ends


def visible(tokens: list[tuple[int, str, bool]], ends: dict[int, int]) -> list[int]:
    """Places of the tokens outside elements that are never article text.

    Such an element that never closes hides nothing but its tag.  A page header
    stands before the article; one inside it holds its title.  What holds an
    article or main element is a wrapper, whatever its name, and so is, on a page
    without any, what holds most of the words.
    """
    words, marks = [0], [0]
    for kind, name, _ in tokens:
        words.append(words[-1] + (len(name.split()) if kind == TEXT else 0))
        marks.append(marks[-1] + (kind == OPEN and name in CONTENT))

    def wraps(i: int, end: int) -> bool:
        if marks[-1]:
            return marks[end] > marks[i]
        return tokens[i][1] not in ASIDE and 2 * (words[end] - words[i]) > words[-1]

    out, i, inside = [], 0, 0
    while i < len(tokens):
        kind, name, aside = tokens[i]
        if kind != TEXT and name in CONTENT:
            inside = max(0, inside + (1 if kind == OPEN else -1))
        elif kind == OPEN and name not in ("html", "body") and (aside or name == "header" and not inside) and not wraps(i, ends.get(i, i)):
            i = ends.get(i, i) + 1
            continue
        out.append(i)
        i += 1
    return out


def classes(tokens: list[tuple[int, str, bool]], places: list[int]) -> list[str]:
    """What each visible token counts as: a tag by its name, words by their block."""
    block, out = "", []
    for i in places:
        kind, name, _ = tokens[i]
        if kind == TEXT:
            out.append("w " + block)
            continue
        if name not in INLINE and name != "br":
            block = name if kind == OPEN else ""
        out.append("t " + name)
    return out


def counted(page: str) -> tuple[Counter, Counter] | None:
    """Token classes inside and outside the article of a page that marks one."""
    tokens = parse(page)
    ends = matched(tokens)
    marked = [(i, e) for i, e in ends.items() if tokens[i][1] in CONTENT]
    if not marked:
        return None
    first, last = max(marked, key=lambda m: (tokens[m[0]][1] == "article", m[1] - m[0]))
    places = visible(tokens, ends)
    within, outside = Counter(), Counter()
    for i, name in zip(places, classes(tokens, places)):
        if i not in (first, last):
            n = len(tokens[i][1].split()) if tokens[i][0] == TEXT else 1
            (within if first < i < last else outside)[name] += n
    return within, outside


def learn(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample_rows: int = 2000) -> dict[str, float]:
    """Weight of each token class, from pages that mark their article.

    The sample is at most ``sample_rows`` of those pages, taken by hash of their
    id.  Words weigh at least 0.05 and tags at most -0.05.
    """
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)\b") & F.col(id_col).isNotNull())
    ids = marked.select(F.col(id_col).alias("page_id")).orderBy(F.xxhash64("page_id")).limit(sample_rows)
    sample = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).join(F.broadcast(ids.distinct()), "page_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            within, outside = Counter(), Counter()
            for page in batch["html"].to_pylist():
                both = counted(page or "")
                if both:
                    within += both[0]
                    outside += both[1]
            rows = [{"name": n, "within": within[n], "outside": outside[n]} for n in within | outside]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("name", pa.string()), ("within", pa.int64()), ("outside", pa.int64())]))

    sums = sample.select("html").mapInArrow(run, "name string, within long, outside long").groupBy("name").agg(F.sum("within").alias("a"), F.sum("outside").alias("b"))
    out = {}
    for row in sums.collect():
        odds = math.log((row["a"] + 1) / (row["b"] + 1))
        out[row["name"]] = min(max(odds, LEAST), MOST) if row["name"].startswith("w ") else max(min(odds, -LEAST), -MOST)
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First and one past the last index of the contiguous run with the largest sum.

    Of equal runs the earliest and longest; (0, 0) where nothing scores above 0.
    """
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best or total == best > 0 and start == found[0]:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best stretch, joined by single spaces."""
    tokens = parse(page or "")
    places = visible(tokens, matched(tokens))
    scores = []
    for i, name in zip(places, classes(tokens, places)):
        if tokens[i][0] == TEXT:
            scores.append(len(tokens[i][1].split()) * weights.get(name, UNKNOWN_WORD))
        else:
            scores.append(weights.get(name, UNKNOWN_TAG))
    first, last = best_stretch(scores)
    blocks, block = [], []
    for i in places[first:last]:
        kind, value, _ = tokens[i]
        if kind == TEXT:
            block.append(value)
        elif value not in INLINE:
            blocks.append(block)
            block = []
    blocks.append(block)
    joined = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks if b)
    return " ".join(b for b in joined if b)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; empty where it has no content.

    Null, empty and tagless html are taken as they are: nothing, nothing, and
    text.  Rows that repeat stay; a page of any length is read whole; other
    columns are left out.  Weights are learnt from the pages unless given.
    """
    weights = learn(pages, id_col=id_col, html_col=html_col) if weights is None else weights
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                texts = [main_text(p, weights) for p in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return plain.mapInArrow(run, FOUND).withColumn("n_chars", F.length("text").cast("long"))
