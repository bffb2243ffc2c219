"""HTML extraction by line-block distribution.

The markup is stripped into lines, one per block element, in page order.  What
names itself as no article text (menus, page headers and footers, sidebars,
notices, adverts, forms, scripts, styles, comments, hidden parts) leaves an
empty line.  Lengths are summed in sliding windows of lines; a run of lines begins
where the sums surge from zero and ends where they dive to zero again, and the text
between is kept if the surge is strong enough, measured against the page's strongest.

What counts towards a length depends on what the page says about itself.  If lines
marked as article or main hold at least half of the page's own text (``MARKED``), a
marked line counts with all of its text, links included, and is kept whatever its
surge; others count nothing.  If the marks hold less, they are teasers, and if there
are none, only text that is no link counts, within the smallest container of all
such text and the title right before it; kept runs are then completed by the lines
that belong to them, those of links included.  A list of links to other pages under
a heading that says so, at the end of the text, is a menu.

Edge cases: a null or empty page, and one without text, give the empty text; a page
of links alone gives their text; character references are decoded once; tags may be
unclosed, wrongly nested or cut off; time and memory grow in proportion to the page;
repeated rows give equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import table

#: lines in a window
SPAN = 3
#: a run is kept if its largest window reaches this, or this share of the page's largest
SURGE = 60
SHARE = 0.3
#: share of a page's own text from which on its marks say where the article is
MARKED = 0.5

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote counts where it begins a value, elsewhere it is a character of a name or a bare value
    # and a tag that another one begins in before it ends was none
    r"|<(/?)([a-zA-Z][^\s/><]*)((?:[^><\"'=]++|=\s*(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: their content is text for the parser up to the end tag, and never article text
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_CONTAINER = {"article", "center", "div", "main", "section", "table", "td"}
_PARA = {"blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "p", "pre"}
_DROP = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "svg", "canvas", "audio", "video",
         "object", "applet", "head", "search", "datalist", "label", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog",
          "alertdialog", "alert", "status", "toolbar", "tablist"}
#: words that may come before and after the one that names a part
_BEFORE = frozenset("site page global top bottom main left right user reader post article blog web mobile sticky fixed "
                    "inline primary secondary js google".split())
_AFTER = frozenset("area bar block box btn button bottom container content footer form group header inner item items label "
                   "left link links list main message module outer overlay panel right row section slot text thread title "
                   "top unit widget wrap wrapper".split())
_NAMES = frozenset("ad ads alert alerts advert adverts advertisement advertisements advertising adsense adsbygoogle banner "
                   "breadcrumb breadcrumbs comment comments commentary consent cookie cookies disclaimer disqus footer gdpr "
                   "header hidden login masthead menu menus modal nav navbar navigation navi newsletter notice notices "
                   "notification notifications outbrain pager pagination popup popover privacy promo promos promoted "
                   "promotion recommended recommendations related replies reply respond responses search share sharing "
                   "shares sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola "
                   "tags toolbar topbar topnav warning widget widgets".split())
#: names that may follow one of these, as in cookie-notice
_ABOUT = frozenset("cookie cookies consent gdpr privacy".split())
_FURTHER = frozenset("alert banner consent disclaimer modal notice notification popup warning".split())
_LONGEST = max(map(len, _BEFORE | _AFTER | _NAMES))


def _names_part(word: str) -> bool:
    """Whether a class or id is one of the names, with words before and after, apart or written together.

    Reads the word once, keeping what it may be so far: nothing yet, a word before, a
    name, one that a further name may follow.  Digits may follow a name.
    """
    n = len(word)
    may: list[set[str]] = [set() for _ in range(n + 1)]
    may[0].add("start")
    for i, c in enumerate(word):
        now = may[i]
        if not now:
            continue
        named = now & {"name", "about"}
        if c in "-_":
            may[i + 1] |= now - {"start"}
        elif c.isdigit():
            may[i + 1] |= {"name"} if named else set()
        for j in range(i + 1, min(i + _LONGEST, n) + 1):
            part = word[i:j]
            if "start" in now and part in _BEFORE:
                may[j].add("before")
            if now & {"start", "before"} and part in _NAMES:
                may[j].add("about" if part in _ABOUT else "name")
            if named and part in _AFTER or "about" in now and part in _FURTHER:
                may[j].add("name")
    return bool(may[n] & {"name", "about"})


#: the title of a text, wherever it stands
_TITLE = re.compile(r"(?:(?:post|article|entry|blog|story|content)[-_]*)(?:header|title)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACES = re.compile(r"\s+")
#: what stands over links to other pages, the whole of a line
_ELSEWHERE = re.compile(r"(?:(?:more|other|related|recommended|latest|popular|similar|further|top) "
                        r"(?:stories|articles|posts|news|reading|links|content|from .{1,40})|you (?:may|might) also like|"
                        r"see also|read (?:more|next)|related|recommended|up next|don't miss)[.:!]?", re.I)


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _DROP:
        return True
    if tag == "header":
        return not in_article
    if not attrs.strip(" /"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"(display\s*:\s*none|visibility\s*:\s*hidden)", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for word in value.split():
                word = _CAMEL.sub("-", word)
                if _names_part(word.lower()) and not _TITLE.fullmatch(word) and not (in_article and word.lower() == "header"):
                    return True
    return False


class _Line:
    __slots__ = ("parts", "linked", "text", "size", "own", "box", "article", "title", "para")

    def __init__(self, box: int, article: bool, tag: str = ""):
        self.parts, self.linked, self.text, self.size, self.own = [], [], "", 0, False
        self.box, self.article, self.title, self.para = box, article, tag in ("h1", "h2"), tag in _PARA


def lines(page: str) -> tuple[list[_Line], list[int]]:
    """The page's lines; an empty one stands for each unwanted part.  And the container around each container.

    Containers have ascending numbers from 1, 0 is the page.
    """
    out: list[_Line] = []
    around = [0]
    stack: list[tuple[str, bool, int]] = []  # open elements: tag, unwanted, container number
    open_: dict[str, int] = {}  # open elements of each tag
    box = dropped = links = articles = 0
    line = _Line(box, False)

    def close_line(gap: bool = False):
        nonlocal line
        if line.parts:
            line.text = _SPACES.sub(" ", html.unescape("".join(line.parts))).strip()
            linked = _SPACES.sub(" ", html.unescape("".join(line.linked))).strip()
            line.size = max(0, len(line.text) - len(linked))
            # what stands between links, such as bars and dots, is no text of its own
            line.own = line.size > 0 and (line.own or not linked)
            if line.text:
                out.append(line)
        if gap and (not out or out[-1].text):
            out.append(_Line(box, articles > 0))
        line = _Line(box, articles > 0)

    def pop():
        nonlocal dropped, articles, box
        tag, unwanted, container = stack.pop()
        open_[tag] -= 1
        dropped -= unwanted
        if tag in ("article", "main"):
            articles -= 1
        if container:
            box = around[container]

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text and not dropped:
            line.parts.append(text)
            if links:
                line.linked.append(text)
            elif not line.own:
                line.own = any(map(str.isalnum, html.unescape(text)))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        attrs = m[3] or ""
        block = tag in _BLOCK
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br" or tag == "p" and not open_.get("p"):
                line.parts.append(" ")
            depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag) if open_.get(tag) else -1
            if block:
                close_line()
            if depth >= 0 and (block or not any(s[0] in _BLOCK for s in stack[depth + 1:])):
                gone = any(s[1] for s in stack[depth:])
                while len(stack) > depth:
                    pop()
                line = _Line(box, articles > 0) if block else line
                if gone and not dropped and block:
                    close_line(gap=True)
            if block:
                links = 0 if tag != "a" else links
            continue
        if block:
            close_line()
            # a paragraph ends where a block begins, an item where the next one does
            while stack and stack[-1][0] == "p":
                pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                pop()
            line = _Line(box, articles > 0)
            links = 0
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            if tag == "br":
                line.parts.append(" ")
            continue
        unwanted = not dropped and _unwanted(tag, attrs, articles > 0)
        if unwanted and block:
            close_line(gap=True)
        if tag == "a":
            links += 1
            continue
        if block or unwanted:
            container = 0
            if tag in _CONTAINER:
                container = len(around)
                around.append(box)
                box = container
            if tag in ("article", "main"):
                articles += 1
            dropped += unwanted
            stack.append((tag, unwanted, container))
            open_[tag] = open_.get(tag, 0) + 1
            line = _Line(box, articles > 0, tag) if block else line
    close_line()
    return out, around


def _content(all_lines: list[_Line], around: list[int]) -> list[_Line]:
    """The lines of the smallest container that leaves only links outside, and the title right before it."""
    within = [0] * len(around)  # own lines in each container
    for x in all_lines:
        within[x.box] += x.own
    for k in range(len(around) - 1, 0, -1):
        within[around[k]] += within[k]
    if not within[0]:
        return all_lines
    # those with all own lines stand in one another; the last begun is the smallest
    smallest = max(k for k, n in enumerate(within) if n == within[0])
    if not smallest:
        return all_lines
    inside = [False] * len(around)
    for k in range(smallest, len(around)):
        inside[k] = k == smallest or inside[around[k]]
    at = [k for k, x in enumerate(all_lines) if inside[x.box]]
    first = at[0]
    return all_lines[first - 1:first] * (first > 0 and all_lines[first - 1].title) + [all_lines[k] for k in at]


def _completed(found: list[_Line], kept: list[bool]) -> list[bool]:
    """``kept`` and the lines that belong to what is kept.

    Lines with text of their own belong to it if they stand in one container with a
    kept one.  Lines of links do so too, except right in the page's body, where they
    may be its menu; so do those between kept lines, and the paragraphs and headings
    right beside one.
    """
    held = {x.box for x, k in zip(found, kept) if k and x.own}
    kept = [k or bool(x.text) and x.box in held and (x.own or bool(x.box)) for x, k in zip(found, kept)]
    at = [i for i, k in enumerate(kept) if k]
    if at:
        kept[at[0]:at[-1]] = [k or bool(x.text) and not x.own
                              for x, k in zip(found[at[0]:at[-1]], kept[at[0]:at[-1]])]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        beside = False
        for i in order:
            if found[i].text:  # a gap doesn't part a paragraph from the text
                beside = kept[i] = kept[i] or beside and not found[i].own and found[i].para
    return kept


def surges(sizes: list[int], span: int = SPAN) -> list[tuple[int, int, int]]:
    """(begin, end, strength) of the runs of lines between a surge of the window sums and their dive to zero."""
    sums, total = [0] * len(sizes), 0
    for i in range(len(sizes) - 1, -1, -1):
        total += sizes[i] - (sizes[i + span] if i + span < len(sizes) else 0)
        sums[i] = total
    out, begin = [], None
    for i, n in enumerate([*sums, 0]):
        if n and begin is None:
            begin = i
        elif not n and begin is not None:
            out.append((begin, i, max(sums[begin:i])))
            begin = None
    return out


def _without_links_elsewhere(kept: list[_Line]) -> list[_Line]:
    """The lines without a last heading that announces other pages and the links under it."""
    end = len(kept)
    while end and not kept[end - 1].own:
        end -= 1
    if 1 < end < len(kept) and _ELSEWHERE.fullmatch(kept[end - 1].text):
        return kept[:end - 1]
    return kept


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    found, around = lines(page)
    own, marked = sum(x.size for x in found), sum(x.size for x in found if x.article)
    marks = any(x.article and x.text for x in found) and marked >= MARKED * own
    if not marks:
        found = _content(found, around)
    sizes = [(len(x.text) if x.article else 0) if marks else x.size for x in found]
    runs = surges(sizes)
    if not runs:  # no text but that of links
        return "\n\n".join(x.text for x in found if x.text)
    enough = min(SURGE, SHARE * max(strength for _, _, strength in runs))
    kept = [False] * len(found)
    for begin, end, strength in runs:
        if marks or strength >= enough:
            kept[begin:end] = [bool(x.text) and (x.article or not marks) for x in found[begin:end]]
    kept = kept if marks else _completed(found, kept)
    return "\n\n".join(x.text for x in _without_links_elsewhere([x for x, k in zip(found, kept) if k]))


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars (its code points)."""
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType),
                           T.StructField("url", pages.schema[url].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=schema.names)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
