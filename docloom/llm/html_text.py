"""Main text of web pages: flat text blocks, described by word count and link density of themselves and their neighbours and by where
they stand, classified by a decision tree that is trained on a small labelled table.

Cases: a null or empty page has an empty text; so has a page without a block of content; unclosed tags, comments and scripts end where
the next enclosing tag or the page ends; a tag whose quotes stay open ends at the first ">"; repeated rows are extracted each by itself; an empty table gives no rows; columns
other than id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame

from .common import map_arrow

# Tags by role, and words of class, id and role attributes that mark what is not the article.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|button|title|datalist|audio|video"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form menu dialog head fieldset search".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget comment comments disqus reply replies respond discussion pagination pager toolbar masthead copyright legal disclaimer complementary contentinfo search dialog hidden offscreen paywall toc tags".split()
)
WEAK = frozenset("header footer top bottom meta foot head".split())
CONTENT = frozenset("article content entry post story main body text".split())

#: A tag's attributes up to its end, with the ends inside of quotes left out; and as far as the first end of any kind.
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>").match
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*+)").match
#: Tags of a page whose quotes may stay open up to its end; after so many, a tag ends at the first ">".
OPEN_QUOTES = 16
_RAW = frozenset(RAW.split("|"))
_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I).search for name in _RAW}
_MARKS = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "chrome", "marked", "place", "heading")
# The labelled table. place: 2 in the page's article or main part, 1 if the page has none, 0 outside of it.
TABLE = """
words links words_before links_before words_after links_after chrome marked place heading content
   1  1.0    0  0.0    1  1.0  1 0 0 0  no
   1  1.0    1  1.0    9  0.0  1 0 0 0  no
   1  1.0    1  1.0    1  1.0  1 0 0 0  no
   2  1.0    2  1.0    3  1.0  1 0 1 0  no
   3  1.0    4  1.0   60  0.0  0 0 1 0  no
   1  1.0    1  1.0    1  1.0  0 0 1 0  no
   4  0.9    3  1.0    2  1.0  0 0 1 0  no
   9  0.0    1  1.0   12  0.0  0 1 0 0  no
  25  0.1   40  0.0   30  0.0  0 1 2 0  no
  80  0.0   90  0.0   70  0.0  0 1 2 0  no
  14  0.0    2  1.0   70  0.0  0 1 1 0  no
  40  0.0   35  0.0    6  0.0  0 1 1 0  no
  11  0.0   60  0.0    0  0.0  1 0 0 0  no
  60  0.0   60  0.0    0  0.0  1 0 0 0  no
  45  0.2   30  0.0   10  0.5  1 0 1 0  no
  12  0.0   55  0.0   10  0.0  1 0 2 0  no
  70  0.0   50  0.0   40  0.0  1 0 2 0  no
   5  0.0    8  0.0   90  0.0  1 0 2 1  no
   9  0.0   12  0.0   40  0.0  0 0 0 0  no
  30  0.0    9  0.5   10  0.0  0 0 0 0  no
  55  0.0   70  0.0    3  1.0  0 0 0 0  no
   6  0.0    1  1.0   20  0.0  0 0 0 1  no
   8  0.0    9  0.0   80  0.0  0 0 2 1  yes
   3  0.0    9  0.0    4  0.0  0 0 2 1  yes
   1  0.0   30  0.0   60  0.0  0 0 2 0  yes
   2  0.0    3  0.0    1  1.0  1 0 0 0  no
   2  0.0   70  0.0    2  0.0  0 0 2 0  yes
   4  0.0    5  0.0    5  0.0  0 0 2 0  yes
  10  0.0    4  0.0   11  0.0  0 0 2 0  yes
  12  0.4   40  0.0   33  0.0  0 0 2 0  yes
   5  1.0   60  0.0   52  0.0  0 0 2 0  yes
   3  1.0    3  1.0    3  1.0  0 0 2 0  yes
   4  0.0    4  0.0    3  0.0  0 0 2 0  yes
   4  0.0    4  0.0   60  0.0  0 0 2 0  yes
   5  0.0    1  0.0    0  0.0  0 0 2 0  yes
   1  0.0    2  0.0    0  0.0  0 0 2 0  yes
   2  0.0    0  0.0    2  0.0  0 0 2 0  yes
   3  0.0    0  0.0   80  0.0  0 0 2 1  yes
   2  1.0    2  0.0    1  1.0  0 0 2 0  yes
   1  1.0    1  1.0    1  1.0  0 0 2 0  yes
  40  0.9   40  0.9   20  0.9  0 0 2 0  yes
   6  0.0    0  0.0    0  0.0  0 0 2 0  yes
   3  1.0    9  0.0   20  0.0  0 0 2 0  yes
   1  1.0   50  0.0    2  0.0  0 0 2 0  yes
   4  1.0    3  1.0    0  0.0  0 0 2 0  yes
   2  1.0    0  0.0   40  0.0  0 0 1 0  no
   4  1.0   60  0.0   20  0.0  0 0 1 0  no
   7  0.0    2  1.0    0  0.0  0 0 2 0  yes
   2  0.0    1  0.0    1  1.0  0 0 2 0  yes
  90  0.0   10  0.0   11  0.0  0 0 2 0  yes
 300  0.0  120  0.0    9  0.0  0 0 2 0  yes
  50  0.1    8  0.0   70  0.0  0 0 2 0  yes
  20  0.0   30  0.0    0  0.0  0 0 2 0  yes
  60  0.0    3  1.0   70  0.0  0 0 1 0  yes
  90  0.1   60  0.0   80  0.0  0 0 1 0  yes
  25  0.0   60  0.0   70  0.0  0 0 1 0  yes
 200  0.0    1  1.0    9  0.0  0 0 1 0  yes
  18  0.0   50  0.0   35  0.0  0 0 1 0  yes
   3  0.0   60  0.0   50  0.0  0 0 1 0  yes
   6  0.0    2  1.0   70  0.0  0 0 1 1  yes
   7  0.0   40  0.0   55  0.0  0 0 1 1  yes
   4  0.0    0  0.0   45  0.0  0 0 1 1  yes
  40  0.0    9  0.0   12  0.0  0 0 1 0  yes
  16  0.1   20  0.0   14  0.0  0 0 1 0  yes
  27  0.0   22  0.0    2  1.0  0 0 1 0  yes
  35  0.0   45  0.0    1  1.0  0 0 1 0  yes
  21  0.0   30  0.0    3  0.7  0 0 1 0  yes
  24  0.0   14  0.0    0  0.0  0 0 1 0  yes
  22  0.1    6  0.0   18  0.0  0 0 1 0  yes
   4  0.0    2  1.0    1  1.0  0 0 1 1  no
   3  0.0    2  1.0    4  0.5  0 0 1 0  no
   8  0.0    1  1.0    3  1.0  0 0 1 0  no
   7  0.0   60  0.0    2  1.0  0 0 1 0  no
   5  0.0    3  0.0    0  0.0  0 0 1 0  no
  30  0.8   40  0.0   20  0.7  0 0 1 0  no
  12  0.6   12  0.6   12  0.6  0 0 1 0  no
"""


class Block:
    __slots__ = ("text", "words", "links", "chrome", "marked", "inside", "heading")

    def __init__(self, text: str, links: int, chrome: bool, marked: bool, inside: bool, heading: bool):
        self.text, self.words = text, text.count(" ") + 1
        self.links = min(1.0, links / self.words)
        self.chrome, self.marked, self.inside, self.heading = chrome, marked, inside, heading


def marks(attributes: str) -> tuple[bool, bool]:
    """Whether a tag's attributes mark it as something beside the article, or as the article's frame."""
    if _HIDDEN.search(attributes):
        return True, False
    names: set[str] = set()
    for found in _MARKS.finditer(attributes):
        names.update(x.lower() for x in _PARTS.findall(found[1] or found[2] or found[3] or ""))
    content = bool(names & CONTENT)
    return bool(names & MARKED) or bool(names & WEAK) and not content, content


def tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag name, whether it closes, attributes) of each tag in order, the last with the name "". Comments, declarations and
    raw elements are left out; their place is a space. One pass: what is searched for and not there ends the page."""
    at = done = failed = 0
    some: list[str] = []
    while True:
        start = page.find("<", at)
        if start < 0:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start) + 1 or len(page)
        else:
            name = _NAME(page, start + 1)
            if not name:
                at = start + 1
                continue
            tag = name[1].lower()
            quoted = _QUOTED(page, name.end()) if failed < OPEN_QUOTES else None
            failed += not quoted
            end = quoted.end() if quoted else page.find(">", name.end()) + 1 or len(page)
            closes = page[start + 1] == "/"
            if tag not in _RAW:
                some.append(page[done:start])
                yield "".join(some), tag, closes, page[name.end() : end]
                some.clear()
                at = done = end
                continue
            if not closes and not page.startswith("/>", end - 2):
                closing = _ENDS[tag](page, end)
                end = closing.end() if closing else len(page)
        some += page[done:start], " "
        at = done = end
    some.append(page[done:])
    yield "".join(some), "", False, ""


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. A stack of open tags says what each stands in."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, chrome, marked, inside an article or main part
    opened: Counter = Counter()  # tags in the stack
    some: list[str] = []
    links = anchor = 0
    heading = False

    def flush() -> None:
        nonlocal links
        if some:
            text = " ".join(entities.unescape("".join(some)).split())
            if text:
                _, chrome, marked, inside = stack[-1] if stack else ("", False, False, False)
                out.append(Block(text, links, chrome, marked, inside, heading))
        some.clear()
        links = 0

    def put(name: str, chrome: bool, marked: bool, inside: bool) -> None:
        stack.append((name, chrome, marked, inside))
        opened[name] += 1

    def drop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    for piece, name, closes, attributes in tags(page):
        if piece:
            some.append(piece)
            if anchor:
                links += len(entities.unescape(piece).split())
        if name == "a":
            anchor = 0 if closes else 1
            continue
        if name == "br":
            some.append(" ")
            continue
        if name not in BLOCKS:
            if name in VOID or name in ("td", "th"):
                some.append(" ")
            if not name:
                flush()
            elif not closes and name not in VOID and attributes != ">" and marks(attributes)[0]:
                # an inline element that is marked, such as a hidden span, stands by itself
                flush()
                _, chrome, _, inside = stack[-1] if stack else ("", False, False, False)
                put(name, chrome, True, inside)
            elif closes and opened[name]:
                flush()
                while drop() != name:
                    pass
            continue
        flush()
        if closes:
            if opened[name]:
                while drop() != name:
                    pass
        elif name not in VOID:
            if name == "body" and not opened["body"] and opened["head"]:
                # the head that the first body ends
                stack = [s for s in stack if s[0] != "head"]
                opened["head"] = 0
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name in ("li", "dt", "dd", "td", "th", "tr")):
                drop()
            _, chrome, marked, inside = stack[-1] if stack else ("", False, False, False)
            beside, content = marks(attributes) if attributes != ">" else (False, False)
            inside = inside or name in ("article", "main") and not beside
            chrome = chrome or name in CHROME or name == "header" and not inside
            put(name, chrome, marked or beside and name not in ("html", "body"), inside)
        heading = name in ("h1", "h2", "h3", "h4", "h5", "h6") and not closes
        anchor = 0
    return out


def described(found: list[Block]) -> list[tuple[float, ...]]:
    article = any(b.inside and not b.chrome and not b.marked for b in found)
    none = (0, 0.0)
    out = []
    for k, b in enumerate(found):
        before = (found[k - 1].words, found[k - 1].links) if k else none
        after = (found[k + 1].words, found[k + 1].links) if k + 1 < len(found) else none
        out.append((b.words, b.links, *before, *after, b.chrome, b.marked, (2 if b.inside else 0) if article else 1, b.heading))
    return out


def grow(rows: list[tuple[tuple[float, ...], bool]], depth: int):
    """A decision tree by the Gini index: a share of content, or (feature, limit, tree up to the limit, tree above)."""
    share = sum(y for _, y in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(len(FEATURES)):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:], strict=False):
            limit = (low + high) / 2
            sides = [y for x, y in rows if x[f] <= limit], [y for x, y in rows if x[f] > limit]
            cost = sum(2 * sum(s) * (len(s) - sum(s)) / len(s) for s in sides)
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, limit
    if best is None:
        return share
    _, f, limit = best
    return f, limit, grow([r for r in rows if r[0][f] <= limit], depth - 1), grow([r for r in rows if r[0][f] > limit], depth - 1)


def labelled() -> list[tuple[tuple[float, ...], bool]]:
    """The table, and each content block of it again as chrome, as marked and as outside of the article: then it is none."""
    rows = [line.split() for line in TABLE.strip().splitlines()[1:]]
    table = [(tuple(map(float, r[:-1])), r[-1] == "yes") for r in rows]
    moved = [("chrome", 1.0), ("marked", 1.0), ("place", 0.0)]
    other = [tuple(v if n == name else old for n, old in zip(FEATURES, x, strict=True)) for x, y in table if y for name, v in moved]
    return table + [(x, False) for x in other]


@cache
def tree():
    return grow(labelled(), depth=12)


def is_content(row: tuple[float, ...]) -> bool:
    node = tree()
    while isinstance(node, tuple):
        f, limit, low, high = node
        node = low if row[f] <= limit else high
    return node > 0.5


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, described(found), strict=True) if is_content(row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars. A narrow map; a task holds one Arrow batch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from docloom.llm.html_text import main_text

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.selectExpr(f"cast(`{id_col}` as long) page_id", f"cast(`{url_col}` as string) url", f"cast(`{html_col}` as string) html"), run, "page_id long, url string, text string, n_chars long")
