"""Main text of web pages from the events of the standard library's HTML parser.

Every block is a line with its characters and tags.  The text-to-tag ratio per line is smoothed with a
Gaussian and split into two clusters at a threshold; the lines above it tell the region that holds the content:
where article or main elements hold the majority of their text, the innermost element of each outermost one that
has all its dense lines, else the innermost element of the page that has them all.  All blocks of that region are
the text, with a first heading that stands right above it, and without those inside menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments.

Class and id names tell of such elements as follows.  A whole name of adverts, or a name with comments or replies
as a word of it, is believed unless the element holds an article or a first heading, or has all text above the
threshold while what no name tells of is less than a tenth of it.  Another whole name (sidebar, left-menu), and a form, is believed of an element that can hold blocks, unless that
element holds more than half of the page's text above the threshold and no article stands elsewhere.  A name
with more words to it (share-price-report) is believed only where the ratio says the same: if less than half
of the element's text is above the threshold.  Paragraphs, headings, items and cells are dropped for no name
but one of the first sort.

Defined results: a null, empty or textless page has the empty string; truncated pages end where they end,
with their open elements closed; white space, also no-break spaces, becomes one space; repeated rows are
handled row by row; an empty table has no rows; other columns are not looked at.  What is never closed (a tag, a
quote, a comment, a declaration) ends the page, as in browsers.  Work and memory follow the length of the page,
however deep its elements are nested and whatever is left open.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser, locatestarttagend_tolerant
from typing import NamedTuple

from pyspark.sql import DataFrame

from gossamer.llm.common import arrow_map

SIGMA = 1.5
#: Elements that never hold article text.
DROPPED = {"head", "title", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "button", "select", "textarea", "svg", "iframe", "object", "canvas", "menu", "dialog", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt", "rp"}
#: An open element of the same kind ends where one of these begins.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_KINDS = "ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side-bar|aside|nav(?:bar|igation)?|menu|breadcrumbs?|footer|header|masthead|comments?|comment-list|disqus|replies|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend(?:ed|ations)?|widget|pagination|pager|toolbar|skip"
_PLACE = "main|site|page|global|top|bottom|left|right|primary|secondary|mobile|cookie|login|search|share|social|user|sticky|fixed"
#: A whole name, which may tell where the element is or what it is made of.
_WHOLE = re.compile(rf"(?:(?:{_PLACE})[_-])*(?:{_KINDS})(?:[_-](?:{_PLACE}|bar|box|block|area|list|links?|buttons?|form|wrapper|container|inner))*\d*", re.IGNORECASE)
_PART = re.compile(rf"(?:^|[\s_-])(?:{_KINDS})(?=$|[\s_-]|\d)", re.IGNORECASE)
#: Names that tell of something else on the page, not of the element itself.
_ABOUT = re.compile(r"(?:has|have|with|without|no|non|not|hide|hides|show|shows)[_-]|.*[_-](?:free|less)$", re.IGNORECASE)
_CERTAIN = re.compile(r"(?:ads?|adverts?|advertisement|sponsor(?:ed)?|disqus)\d*", re.IGNORECASE)
_COMMENTS = re.compile(r"(?:.*[_-])?(?:comments?|replies)(?:$|[_-]|\d).*", re.IGNORECASE)
#: Names that tell whether there may be comments.
_SWITCH = re.compile(r".*[_-](?:open|opened|closed|enabled|disabled|on|off|allowed|count|free|less)$", re.IGNORECASE)
#: Elements that hold text themselves.
TEXTUAL = {"p", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "pre", "blockquote", "figcaption", "caption"}
_COMMENT_END = re.compile("--!?>")
_NONE, _MAYBE, _LIKELY, _SURE = 0, 1, 2, 3


class _Element(NamedTuple):
    tag: str
    #: The innermost region and the innermost element named as noise, both numbered from 1; 0 is the page.
    region: int
    named: int
    dropped: bool


class Line(NamedTuple):
    text: str
    tags: int
    region: int
    named: int
    first_heading: bool


class Lines(HTMLParser):
    """Collects lines from parser events as they come; regions and named elements point to the ones around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Element("", 0, 0, False)]
        #: Where each tag is in `open`.
        self.places: dict[str, list[int]] = {}
        self.kinds, self.above = ["page"], [0]
        #: Of each named element the one around it, how it is named and the region around it.
        self.over, self.level, self.place = [0], [_NONE], [0]
        #: Named elements around articles and first headings.
        self.holds: dict[int, int] = {}
        self.lines: list[Line] = []
        self.text: dict[int, list[str]] = {}
        self.tags = 0

    def _push(self, tag: str, region: int, named: int, dropped: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(_Element(tag, region, named, dropped))

    def _flush(self) -> None:
        if self.text:
            for named, parts in self.text.items():
                if text := " ".join("".join(parts).split()):
                    self.lines.append(Line(text, self.tags, self.open[-1].region, named, bool(self.places.get("h1"))))
                    self.tags = 0
            self.text = {}

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _pop(self, tags: set[str], until: set[str]) -> None:
        """Closes the innermost of `tags` with all inside it, unless one of `until` is further in."""
        k = self._last(tags)
        if k and k > self._last(until - tags):
            self._flush()
            for element in reversed(self.open[k:]):
                self.places[element.tag].pop()
            del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.setdefault(self.open[-1].named, []).append(" ")
            elif tag not in INLINE:
                self._flush()
            return
        if tag in CLOSES:
            self._pop(CLOSES[tag], {"ul", "ol", "dl", "table", "div", "article", "section", "body"})
        elif tag in ENDS_P:
            self._pop({"p"}, {"div", "article", "section", "td", "li", "body"})
        over = self.open[-1]
        if tag in INLINE:
            dropped, level = over.dropped or self._hidden(attrs), self._named(attrs)
            if dropped != over.dropped or level or tag == "label":
                self._push(tag, over.region, self._name(over, level), dropped)
            return
        self._flush()
        named = self._named(attrs)
        whole = tag in ("html", "body", "article", "main")
        dropped = over.dropped or tag in DROPPED or not whole and self._hidden(attrs)
        if whole:
            level = _SURE if named == _SURE and tag in ("article", "main") and _is_comment(attrs) else _NONE
        else:
            level = named if named == _SURE else _NONE if tag in TEXTUAL else _LIKELY if tag == "form" else named
        article = level != _SURE and (tag in ("article", "main") or ("role", "main") in attrs)
        if article or tag == "h1":
            self.holds[over.named] = 1
        region = over.region
        if tag not in TEXTUAL:
            self.kinds.append("article" if article else tag)
            self.above.append(region)
            region = len(self.kinds) - 1
        self._push(tag, region, self._name(over, level), dropped)

    def _name(self, over: _Element, level: int) -> int:
        if level == _NONE:
            return over.named
        self.over.append(over.named)
        self.level.append(level)
        self.place.append(over.region)
        return len(self.over) - 1

    @staticmethod
    def _named(attrs: list[tuple[str, str | None]]) -> int:
        names = [n for name, value in attrs if name in ("class", "id") and value for n in value.split()] if attrs else ()

        def level(n: str) -> int:
            if _CERTAIN.fullmatch(n) or _COMMENTS.fullmatch(n) and not _ABOUT.match(n) and not _SWITCH.match(n):
                return _SURE
            return _LIKELY if _WHOLE.fullmatch(n) else _MAYBE if _PART.search(n) and not _ABOUT.match(n) else _NONE

        return max(map(level, names), default=_NONE)

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name == "role" and (value or "").lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none", value or "", re.IGNORECASE):
                return True
        return False

    # What is never closed goes up to the end of the page

    def parse_starttag(self, i: int) -> int:
        k = super().parse_starttag(i)
        if k >= 0:
            return k
        k = self.rawdata.find(">", i) if locatestarttagend_tolerant.match(self.rawdata, i).end() < len(self.rawdata) else -1
        return k + 1 if k >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        for short in (">", "->"):
            if self.rawdata.startswith(short, i + 4):
                return i + 4 + len(short)
        found = _COMMENT_END.search(self.rawdata, i + 4)
        return found.end() if found else len(self.rawdata)

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        return self.parse_bogus_comment(i)  # in a page it is no more than that

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        return self._closed(super().parse_bogus_comment(i, report))

    def parse_html_declaration(self, i: int) -> int:
        return self._closed(super().parse_html_declaration(i))

    def parse_pi(self, i: int) -> int:
        return self._closed(super().parse_pi(i))

    def parse_endtag(self, i: int) -> int:
        return self._closed(super().parse_endtag(i))

    def _closed(self, k: int) -> int:
        return k if k > 0 else len(self.rawdata)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in INLINE:
            if self.open[-1].tag == tag:
                self.places[tag].pop()
                self.open.pop()
            return
        self._pop({tag}, set() if tag not in CLOSES else {"article", "body"})

    def handle_data(self, data: str) -> None:
        if not self.open[-1].dropped:
            self.text.setdefault(self.open[-1].named, []).append(data)

    def finish(self) -> None:
        self.close()
        self._flush()


def _is_comment(attrs) -> bool:
    return any(name in ("class", "id") and value and re.search(r"comment|repl(y|ies)", value, re.IGNORECASE) for name, value in attrs)


def _summed(above: list[int], sizes: dict[int, int]) -> list[int]:
    """Sizes with those of all that point to them; what points comes after what it points to."""
    out = [sizes.get(k, 0) for k in range(len(above))]
    for k in range(len(above) - 1, 0, -1):
        out[above[k]] += out[k]
    return out


def _spread(above: list[int], flags: list[bool]) -> list[bool]:
    """Flags that hold for what points to a flagged one, too."""
    out = list(flags)
    for k in range(1, len(above)):
        out[k] = out[k] or out[above[k]]
    return out


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        pairs = [(k, ratios[i + d]) for d, k in zip(range(-reach, reach + 1), kernel, strict=True) if 0 <= i + d < len(ratios)]
        out.append(sum(k * r for k, r in pairs) / sum(k for k, _ in pairs))
    return out


def threshold(values: list[float]) -> float:
    """The middle between the means of two clusters (two-means in one dimension); 0 if one is not twice the other: then
    there are no two kinds of lines."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not below or not above:
            break
        now = sum(below) / len(below), sum(above) / len(above)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2 if low * 2 < high else 0.0


def _ratios(lines: list[Line]) -> tuple[list[float], float]:
    smooth = smoothed([len(line.text) / max(1, line.tags) for line in lines])
    return smooth, threshold(smooth) if smooth else 0.0


def _by(lines: list[Line], key: str) -> dict[int, int]:
    out: dict[int, int] = {}
    for line in lines:
        out[getattr(line, key)] = out.get(getattr(line, key), 0) + len(line.text)
    return out


def _named_text(page: Lines, lines: list[Line]) -> tuple[list[int], list[int]]:
    """The letters in each named element, and those of them in lines above the threshold."""
    smooth, cut = _ratios(lines)
    dense = [line for line, value in zip(lines, smooth, strict=True) if value >= cut]
    return _summed(page.over, _by(lines, "named")), _summed(page.over, _by(dense, "named"))


def _without(page: Lines, lines: list[Line], noise: list[bool]) -> list[Line]:
    """The lines outside flagged elements; their tags count for the next line."""
    noise, out, more = _spread(page.over, noise), [], 0
    for line in lines:
        if noise[line.named]:
            more += line.tags
        else:
            out.append(line._replace(tags=line.tags + more))
            more = 0
    return out


def _without_noise(page: Lines) -> list[Line]:
    """The lines outside the elements whose names are believed: first adverts and comments, then the others."""
    lines = page.lines
    if not any(line.named for line in lines):
        return lines
    every = range(1, len(page.over))
    if _SURE in page.level:
        all_of, dense_of = _named_text(page, lines)
        holds, firm = _summed(page.over, page.holds), _spread(page.over, [level >= _LIKELY for level in page.level])
        plain = sum(len(line.text) for line in lines if not firm[line.named])
        sure = [k for k in every if page.level[k] == _SURE and not holds[k] and (dense_of[k] < dense_of[0] or plain * 10 >= all_of[k])]
        lines = _without(page, lines, _flags(page.over, sure))
        if not lines:
            return lines
    all_of, dense_of = _named_text(page, lines)
    inside = _spread(page.above, [kind == "article" for kind in page.kinds])
    elsewhere = any(inside[line.region] and not line.named for line in lines)
    less = [k for k in every if page.level[k] == _MAYBE and dense_of[k] * 2 < all_of[k]]
    less += [k for k in every if page.level[k] == _LIKELY and (dense_of[k] * 2 <= dense_of[0] or elsewhere and not inside[page.place[k]])]
    return _without(page, lines, _flags(page.over, less))


def _flags(over: list[int], places: list[int]) -> list[bool]:
    out = [False] * len(over)
    for k in places:
        out[k] = True
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    lines = _without_noise(page)
    if not lines:
        return ""
    smooth, cut = _ratios(lines)
    dense = _by([line for line, value in zip(lines, smooth, strict=True) if value >= cut], "region")
    mass = _summed(page.above, dense)
    # the outermost articles with dense lines, if they have the majority; else the page
    inside = _spread(page.above, [kind == "article" for kind in page.kinds])
    tops = [r for r, kind in enumerate(page.kinds) if kind == "article" and mass[r] and not inside[page.above[r]]]
    if sum(mass[r] for r in tops) * 2 < mass[0] or not tops:
        tops = [0]
    chosen, inner = set(tops), {r: r for r in tops}
    top = [-1] * len(mass)
    for r in range(len(mass)):  # of each the innermost element that has all its dense lines
        top[r] = r if r in inner else top[page.above[r]] if r else -1
        if top[r] >= 0 and mass[r] == mass[top[r]]:
            inner[top[r]] = r
    chosen = set(inner.values())
    within = _spread(page.above, [r in chosen for r in range(len(mass))])
    keep = [within[line.region] for line in lines]
    if not any(line.first_heading for line, kept in zip(lines, keep, strict=True) if kept):
        # the first heading right above the region, outside it
        around, first = set(), keep.index(True)
        r = lines[first].region
        while r:
            r = page.above[r]
            around.add(r)
        above = [i for i in range(first) if lines[i].first_heading and lines[i].region in around]
        if above:
            keep[above[-1]] = True
    return "\n".join(line.text for line, kept in zip(lines, keep, strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html)."""

    def rows(columns):
        ids, urls, html = columns
        texts = [main_text(h) for h in html]
        yield {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", rows)


#: The article of generated pages, whose markup is known: what the extraction must find on them.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1) AS inner_html FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(inner_html, '<br\s*/?>', ' ', 'g'), '</?(?:b|i|em|strong|a|span)\b[^>]*>', '', 'g'), '</?[a-z][a-z0-9]*\b[^>]*>') AS blocks FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&#39;', ''''), '&#x27;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '[\s\x{A0}]+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, length(coalesce(array_to_string(blocks, chr(10)), ''))::BIGINT AS n_chars FROM c
"""
