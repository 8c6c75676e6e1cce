"""HTML main text by the maximum-scoring subsequence of words and tags.

A page is read as a sequence of word and tag tokens. Words score positive, tags
and words of boilerplate negative; a linear scan finds the contiguous run with
the highest sum, and what lies in the run, widened to whole blocks, is the text:
menus, headers, footers and whatever else surrounds the article score negative
and stay outside. Boilerplate between the first and the last content word of the
run (an advert within the article) is left out. Character references are
decoded, white space in a block made one space, blocks joined by a newline.

The kind of a token is its tag name, or for a word whether it is in a link, in
boilerplate (by element name, role, or class and id words), and inside or
outside the element that declares the content (article or main). A run doesn't
cross the border of a declaring element.

Weights: log odds of each kind inside against outside the declared content, on a
bounded sample of at most ``SAMPLE_PAGES`` pages with such an element and the
smallest url hashes. Each page is counted twice, as it is and with its
declaration hidden, so pages that declare nothing have learned weights too.
Signs are kept: content words stay positive, all else negative.

Edge cases: null, empty or wordless pages give the empty text; text outside any
element counts; unclosed and stray tags are tolerated; an unclosed comment,
script or style swallows the rest, as in browsers; repeated rows stay; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean

SAMPLE_PAGES = 400

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr", "math", "mi", "mn", "mo", "mrow", "msub", "msup", "mfrac", "svg", "object",
}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "audio", "video", "canvas", "applet", "noscript", "template", "select", "svg"}
CONTENT = {"article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|topbar|header|masthead|footer|foot|sidebar|side|aside|ads?|advert|advertisement|adverts|adsense|banner|cookies?|consent|gdpr|notice|notices"
    r"|popup|modal|overlay|promo|promotion|sponsor|sponsored|newsletter|subscribe|subscription|share|sharing|social|breadcrumbs?|pagination|pager|comments?|disqus|replies|reply|respond"
    r"|related|recommended|widget|login|signin|signup|search|toolbar|copyright|disclaimer|skip|form)(?:$|[\s_-])"
)
_ARTICLE_MARKS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|story|main)(?:$|[\s_-])")


class _Element:
    __slots__ = ("name", "off", "root", "link", "within", "up")

    def __init__(self, name: str, off: int, root: bool, link: bool, within: bool, up: _Element | None) -> None:
        self.name, self.off, self.root, self.link, self.within, self.up = name, off, root, link, within, up


#: How an element is known as boilerplate: by its name or role, or by words of its class or id.
STRUCTURE, MARKED = 1, 2


def _boilerplate(name: str, attributes: str, inside: bool) -> int:
    if name in BOILERPLATE or name == "header" and not inside:
        return STRUCTURE
    if not attributes or name in ("html", "body"):
        return 0
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "role" and value.strip() in _ROLES or key == "aria-hidden" and value == "true":
            return STRUCTURE
        if key == "style" and "display:none" in value.replace(" ", ""):
            return STRUCTURE
        if key in ("class", "id") and _MARKS.search(value) and not (name in CONTENT and _ARTICLE_MARKS.search(value) and not re.search("comment|repl", value)):
            return 0 if inside and name in ("h1", "h2", "h3", "h4", "h5", "h6", "header", "p") else MARKED
    return 0


def tokens(page: str) -> Iterator[tuple]:
    """("text", decoded, element) and ("tag", name, element, closing) in page order."""
    root = _Element("", 0, False, False, False, None)
    top, at, n, had_root = root, 0, len(page), False
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", _html.unescape(page[at:]), top
            return
        if lt > at:
            yield "text", _html.unescape(page[at:lt]), top
        follow = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if follow in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = follow == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", top
                at = lt + 1
            continue
        name, stop = m.group().lower(), m.end()
        end = page.find(">", stop)
        if end < 0:
            return
        if "=" in page[stop:end]:  # a quoted value may hold ">"
            end = _tag_end(page, stop, end)
        attributes, at = page[stop:end], end + 1
        if closing:
            e = top
            while e is not root and e.name != name:
                if name in INLINE and e.name not in INLINE:
                    e = root  # an inline end tag doesn't close blocks
                    break
                e = e.up
            if e is not root:
                top = e.up
            yield "tag", name, top, True
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            yield "tag", name, top, False
            continue
        if name not in INLINE:  # a block start ends an open paragraph, and list items end their like
            if top.name == "p" or top.up is not None and top.name in INLINE and _open_p(top):
                while top.name != "p":
                    top = top.up
                top = top.up
            if name in ("li", "td", "th", "tr", "dd", "dt", "option") and top.name == name:
                top = top.up
        if name not in VOID and not attributes.endswith("/"):
            inside = top.root
            own = _boilerplate(name, attributes, inside)
            is_root = name in CONTENT and not own
            off = 0 if is_root and not _declared_off(top, had_root) else top.off or own
            had_root = had_root or is_root and not off
            within = (top.root or is_root) and not off
            top = _Element(name, off, within, top.link or name == "a", top.within or within, top)
        yield "tag", name, top, False


def _declared_off(e: _Element, had_root: bool) -> bool:
    """An article inside boilerplate isn't the page's own once that was seen (comments, related items), nor ever in an aside or the like.

    Before the page's own article, the boilerplate around it was never closed.
    """
    while e is not None and e.name:
        if e.off and (had_root or e.name in ("aside", "footer", "dialog")):
            return True
        e = e.up
    return False


def _open_p(e: _Element) -> bool:
    while e is not None and e.name in INLINE:
        e = e.up
    return e is not None and e.name == "p"


def _tag_end(page: str, start: int, end: int) -> int:
    """The ">" that ends a tag, past those in quoted values; the first one if a quote never ends."""
    first, at, n = end, start, len(page)
    while True:
        eq = page.find("=", at, end)
        if eq < 0:
            return end
        at = eq + 1
        while at < n and page[at].isspace():
            at += 1
        quote = page[at : at + 1]
        if quote in ('"', "'") and quote:
            close = page.find(quote, at + 1)
            if close < 0:
                return first
            at = close + 1
            if at > end:
                end = page.find(">", at)
                if end < 0:
                    return first


_KNOWN = INLINE | VOID | RAW | BOILERPLATE | CONTENT | {"p", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody", "thead", "blockquote", "pre", "header", "body", "html", "figure", "figcaption", "center"}
_SOFT = INLINE | {"p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "ul", "ol", "td", "tr"}
#: For pages without a sample to learn from.
DEFAULT = {"word": 2.0, "word:in": 2.0, "word:link": -0.5, "word:out": -2.0, "word:off": -2.0, "word:marked": -0.02, "tag": -0.5, "tag:in": -0.02, "tag:marked": -3.0} | {f"tag:{t}": -0.02 for t in _SOFT}
#: What a run pays to cross the border of an element that declares the content.
BORDER = -1e12


def kind_of(token: tuple, declared: bool) -> str:
    """The kind by which a token is weighed; ``declared``: some element of the page declares its content."""
    e = token[2]
    if token[0] == "text":
        if e.off:
            return "word:marked" if e.off == MARKED or declared and e.within else "word:off"
        return ("word:in" if e.root else "word:out") if declared else "word:link" if e.link else "word"
    if declared and e.within:
        return "tag:in"
    if e.off == MARKED:
        return "tag:marked" if not token[3] and not e.up.off else "tag:in"
    return "tag:" + (token[1] if token[1] in _KNOWN else "other")


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of content by kind of token; content words at least 0.1, all else at most -0.02."""
    inside, outside = (sum(n for (_, i), n in counts.items() if i == side) for side in (True, False))
    if not inside or not outside:
        return dict(DEFAULT)
    found = dict(DEFAULT)
    for kind in {k for k, _ in counts} - {"tag:in", "word:marked"}:
        odds = math.log((counts.get((kind, True), 0) + 1) / (inside + 1)) - math.log((counts.get((kind, False), 0) + 1) / (outside + 1))
        found[kind] = max(0.1, min(3.0, odds)) if kind in ("word", "word:in") else max(-4.0, min(-0.02, odds))
    return found


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """The contiguous run with the highest positive sum as (first, end); the first and longest of equals."""
    best, span, total, start = 0.0, None, 0.0, 0
    for k, s in enumerate(scores):
        if total < 0 or k == 0:
            total, start = 0.0, k
        total += s
        if total > best or span is not None and total == best and span[0] == start:
            best, span = total, (start, k + 1)
    return span


def scores_of(seen: list[tuple], weights: dict[str, float], declared: bool) -> list[float]:
    """The score of each token; a text counts once for each of its words."""
    tag, out, inside = weights["tag"], [], False
    for t in seen:
        w = weights.get(kind_of(t, declared), tag)
        if t[0] == "text":
            out.append(w * len(t[1].split()))
            continue
        crossed = declared and t[2].within != inside
        inside = t[2].within
        out.append(BORDER if crossed else w)
    return out


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    seen = list(tokens(page or ""))
    scores = scores_of(seen, weights, any(t[2].root for t in seen))
    run = best_run(scores)
    return "" if run is None else _blocks(seen, scores, *run)


def _ends_block(t: tuple) -> bool:
    return t[0] == "tag" and t[1] not in INLINE and t[1] not in ("script", "style")


def _blocks(seen: list[tuple], scores: list[float], first: int, end: int) -> str:
    """The blocks of a run, without the boilerplate between its first and last content words."""
    content = [k for k in range(first, end) if scores[k] > 0]
    low, high = content[0], content[-1]
    while first > 0 and not _ends_block(seen[first]) and not seen[first - 1][2].off:
        first -= 1
    while end < len(seen) and not _ends_block(seen[end]) and not seen[end][2].off:
        end += 1
    out, block = [], []

    def close() -> None:
        if line := " ".join("".join(block).split()):
            out.append(line)
        block.clear()

    for k in range(first, end):
        t = seen[k]
        if t[0] == "tag":
            if _ends_block(t):
                close()
        elif not (t[2].off and low < k < high):
            block.append(t[1])
    close()
    return "\n".join(out)


def count_kinds(page: str | None) -> Counter:
    """Tokens by (kind, inside the declared content), with the declaration seen and hidden."""
    found: Counter = Counter()
    for t in tokens(page or ""):
        n, inside = len(t[1].split()) if t[0] == "text" else 1, t[2].root
        for declared in (True, False):
            found[kind_of(t, declared), inside] += n
    return found


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total: Counter = Counter()
        for page in b.column("html").to_pylist():
            total += count_kinds(page)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], ["kind", "inside", "n"])


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``sample`` pages that declare their content."""
    declared = pages.filter(F.lower("html").rlike("<(article|main)[ >]")).select("html", F.xxhash64("url").alias("o"))
    rows = declared.orderBy("o").limit(sample).mapInArrow(lean(_sample_counts), "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()  # as many rows as kinds
    return weights_from({(r.kind, r.inside): r.n for r in rows})


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    weights = weights or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p, weights) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars long")
