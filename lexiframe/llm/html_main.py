"""Main text of web pages by tree scoring.

A page becomes a tree of its elements. Each block of text passes points to its element and, less and less, to
the ancestors: one point, one per comma, one per hundred characters up to three, all discounted by the share
of its text that is link text. The element with most points is the article; its siblings that score or read
like it are kept with it. What stands in page furniture (by element, role or class) is left out before scoring.
A class or a form can mislead, so what it leaves out is weighed too: an element that holds the article, or most of
the page's points where little is left without it, is no furniture.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table, text_or_empty

START = re.compile(r"</?[a-zA-Z]")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
BLIND_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in (
    "script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt "
             "ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = set("head nav footer aside button select option input label fieldset dialog menu svg canvas audio "
                "video object map".split()) | set(RAW)
ROLES = set("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
#: words of a class or id that mark page furniture, whatever stands beside them
NEVER = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments "
            "disqus respond reply replies sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie "
            "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
            "login share sharing social related recommended recommendations widget toolbar pagination pager "
            "skip hidden banner masthead paywall survey".split())
#: words that do so unless one of ARTICLE stands beside them
WEAK = set("header head top bottom meta info tools tags byline".split())
ARTICLE = set("article post entry story content main body text page".split())
#: a name that begins with one of these tells what the element has beside it, not what it is
BESIDE = set("has no with without".split())
#: an open element of the first kind ends where one of the second begins
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"},
        "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
ENDED_BY: dict[str, list[str]] = {}
for _open, _by in ENDS.items():
    for _tag in _by or ():
        ENDED_BY.setdefault(_tag, ["p"]).append(_open)
SCOPE = ("table", "td", "th", "div", "article", "section", "ul", "ol", "blockquote")
#: end tags of the first kind reach no further up than the innermost open element of the second
SHORT = {"p", "li", "dt", "dd", "td", "th", "tr"}
BARS = ("table", "ul", "ol", "dl", "article", "div", "section")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", *HEADINGS}  # their points go to the element around them


class Node:
    """``mark``: the nearest element, this one or above, that a class or a form marks as furniture; ``article``: in an
    article or main element, without a mark between. Marked elements have the points, plain characters and article
    of their blocks: ``own`` without those of marked elements inside, ``all`` with them; and ``cut``."""

    __slots__ = ("tag", "parent", "furniture", "order", "points", "chars", "linked", "mark", "article", "own", "all", "cut", "far")

    def __init__(self, tag, parent, furniture, order, marked=False):
        self.tag, self.parent, self.furniture, self.order = tag, parent, furniture, order
        self.points, self.far, self.chars, self.linked = 0.0, 0.0, 0, 0
        above = parent is not None and parent.article
        if tag in ("article", "main"):
            self.mark, self.article = parent.mark, above or not marked  # an article of class comment is not the article
        else:
            self.mark, self.article = (self, False) if marked else (parent and parent.mark, above)
        if self.mark is self:
            self.own, self.all, self.cut = [0.0, 0, False], [0.0, 0, False], True


def is_furniture(tag: str, attributes: str, inside_article: bool) -> bool:
    """By element, role or style, whatever it holds."""
    if tag in FURNITURE or (tag == "header" and not inside_article):
        return True
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES and not (tag == "form" and value == "form"):
            return True
    return False


def is_marked(tag: str, attributes: str) -> bool:
    """By class or id, or as a form: furniture unless it holds the article."""
    if tag == "form":
        return True
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id") and tag not in ("body", "html"):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                words = re.split(r"[^a-z]+", token)
                if words[0] not in BESIDE and (not NEVER.isdisjoint(words) or not WEAK.isdisjoint(words) and ARTICLE.isdisjoint(words)):
                    return True
    return False


def parse(page: str) -> list[tuple[Node, str, int]]:
    """Blocks of text in page order: (element, text, characters of it in links). Text of inline elements
    belongs to the block that they stand in; furniture is left out, but not marked elements; line breaks are
    white space. Time is linear in the page: it is read forward only, and of each tag the places where it is open are known."""
    root = Node("html", None, False, 0)
    stack, blocks = [root], []  # open block elements
    inline: dict[str, list[bool]] = {}  # tag -> whether each open inline element of it is furniture
    where: dict[str, list[int]] = {}  # tag -> places in ``stack``
    run: list[str] = []
    linked, at, order, links, muted, articles = 0, 0, 0, 0, 0, 0

    def flush():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((stack[-1], text, min(linked, len(text))))
            run.clear()
        linked = 0

    def close(depth):
        """Close block elements down to ``depth``, with the inline elements left open in them."""
        nonlocal links, muted, articles
        flush()
        while len(stack) > depth:
            gone = stack.pop().tag
            where[gone].pop()
            articles -= gone in ("article", "main")
        inline.clear()
        links = muted = 0

    def innermost(tags):
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def add(text):
        nonlocal linked
        if not stack[-1].furniture and not muted and text:
            text = entities.unescape(text)
            run.append(text)
            if links:
                linked += len(" ".join(text.split()))

    pos, at, size = 0, 0, len(page)  # text begins at ``pos``, the next token is sought from ``at``
    last_open, last_end, blind = page.rfind("<"), page.rfind(">"), False
    while pos < size:
        at = page.find("<", at)
        if at < 0:
            add(page[pos:])
            break
        m, end = None, 0
        if page.startswith("<!--", at):
            found = COMMENT_END.search(page, at + 4)
            end = found.end() if found else size
        elif at > last_end:  # no tag ends any more
            if at == last_open and page[at + 1 : at + 2].isascii() and re.match("[a-zA-Z/!?]", page[at + 1 : at + 2]):
                end = size
        elif page[at + 1] in "!?":
            end = page.index(">", at) + 1
        elif START.match(page, at):
            m = None if blind else TAG.match(page, at)
            if m is None:  # a quote is not closed: from here on tags end at the next >, so that none is sought in vain again
                blind = True
                m = BLIND_TAG.match(page, at)
            end = m.end() if m else 0
        if not end:
            at += 1
            continue
        add(page[pos:at])
        pos = at = end
        if m is None:
            continue
        tag = m[2]
        tag, closing, attributes = tag.lower(), bool(m[1]), m[3] or ""
        if tag in RAW and not closing:
            end = RAW[tag].search(page, pos)
            pos = at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag in VOID:
                continue
            elif closing:
                if inline.get(tag):
                    links -= tag == "a"
                    muted -= inline[tag].pop()
            elif not attributes.endswith("/"):
                name = tag if tag != "label" else "span"
                mute = bool(attributes) and (is_furniture(name, attributes, True) or is_marked(name, attributes)) or tag == "label"
                inline.setdefault(tag, []).append(mute)
                links += tag == "a"
                muted += mute
            continue
        if closing:
            i = innermost((tag,))
            if i > (innermost(BARS) if tag in SHORT else 0):
                close(i)
            else:
                flush()
            continue
        ended = innermost(ENDED_BY.get(tag, ("p",)))  # ends where this one begins
        if ended and ended >= innermost(SCOPES.get(tag, SCOPE)):
            close(ended)
        flush()
        if tag in VOID or attributes.endswith("/"):
            continue
        order += 1
        inside = stack[-1]
        if tag == "body":
            continue
        where.setdefault(tag, []).append(len(stack))
        stack.append(Node(tag, inside, inside.furniture or is_furniture(tag, attributes, articles > 0), order, is_marked(tag, attributes)))
        articles += tag in ("article", "main")
        links, muted = 0, 0
        inline.clear()
    flush()
    return blocks


def score_of(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def weigh(blocks: list[tuple[Node, str, int]], least: int = 250) -> None:
    """Undo the marks (``cut``) of elements that hold the article of the page, if no text is in one elsewhere, or most
    of the page's points and ``least`` characters, if less than a quarter of the points is left without marks."""
    free, marks = [0.0, 0, False], {}

    def add(to, what):
        to[0] += what[0]
        to[1] += what[1]
        to[2] |= what[2]

    for node, text, linked in blocks:
        add(node.mark.own if node.mark else free, (score_of(text, linked), len(text) - linked, node.article))
        m = node.mark
        while m is not None and m.order not in marks:
            marks[m.order] = m
            m = m.parent.mark
    top, inner, total = [], {}, free[0]
    for order in sorted(marks, reverse=True):  # inner elements have higher numbers
        m = marks[order]
        add(m.all, m.own)
        up = m.parent.mark
        if up is None:
            top.append(m)
            total += m.all[0]
        else:
            add(up.all, m.all)
            inner.setdefault(up.order, []).append(m)
    while top:
        m = max(top, key=lambda n: (n.all[2] and not free[2], n.all[0], -n.order))
        if not (m.all[2] and not free[2] and m.all[0] > free[0]
                or 2 * m.all[0] > total and 4 * free[0] < total and m.all[1] >= least):
            break
        m.cut = False
        top.remove(m)
        top += inner.get(m.order, [])
        add(free, m.own)
    for order in sorted(marks):
        m = marks[order]
        m.cut = m.cut or m.parent.mark is not None and m.parent.mark.cut


def hand_up(blocks: list[tuple[Node, str, int]]) -> dict[int, Node]:
    """Pass the points of the blocks to their elements and all above: in full, a half, a sixth, a ninth, then twelfths."""
    candidates: dict[int, Node] = {}
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        points = score_of(text, linked)
        up = node.parent if node.tag in PARAGRAPHS and node.parent else node
        for share in (1, 2, 6, 9):
            if up is not None:
                up.points += points / share
                candidates[up.order] = up
                up = up.parent
        if up is not None:  # this element and all above get a twelfth
            up.far += points
            candidates[up.order] = up
    for up in list(candidates.values()):
        while up.parent is not None and up.parent.order not in candidates:
            up = up.parent
            candidates[up.order] = up
    for order in sorted(candidates, reverse=True):  # inner elements have higher numbers
        node = candidates[order]
        node.points += node.far / 12
        if node.parent is not None:
            node.parent.far += node.far
    return candidates


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, joined by a line feed. A page without text has an empty one."""
    found = parse(page or "")
    weigh(found)
    blocks = [b for b in found if not (b[0].mark and b[0].mark.cut)]
    candidates = hand_up(blocks)
    if not candidates:
        return ""
    best = max(candidates.values(), key=lambda n: (n.points * (1.5 if n.tag in ("article", "main") else 1.0), -n.order))
    while best.parent is not None and best.parent.parent is not None and (
            best.tag not in ("article", "main") and (best.parent.tag in ("article", "main") or best.parent.points >= 0.75 * best.points)):
        best = best.parent
    kept = {best.order}
    beside = best.parent is not None and best.tag not in ("article", "main")
    if beside:
        bar = max(10.0, 0.2 * best.points)
        kept |= {n.order for n in candidates.values() if n.parent is best.parent and n.points >= bar}
    places: dict[int, Node | None] = {}

    def place(node):
        """The element kept or beside the best that ``node`` is in, itself included."""
        path, found = [], None
        while node is not None:
            path.append(node.order)
            if node.order in places:
                found = places[node.order]
                break
            if node.order in kept or beside and node.parent is best.parent:
                found = node
                break
            node = node.parent
        places.update(dict.fromkeys(path, found))
        return found

    def inside(node, text, linked):
        found = place(node)
        if found is None or found.order in kept:
            return found is not None
        dense = linked / len(text)
        return found is node and (
            node.tag in HEADINGS and node.order < best.order and dense < 0.5
            or node.tag == "p" and dense < 0.25 and (len(text) > 80 or dense == 0 and text[-1] in ".!?"))

    def stays(node, text, linked):
        if not (node.mark and node.mark.cut):
            return inside(node, text, linked)
        # a marked paragraph of the article that reads like one
        if node.mark is not node or node.tag not in ("p", "blockquote", "pre") or len(text) <= 80 or linked >= 0.25 * len(text):
            return False
        up = node.parent
        if up.mark and up.mark.cut:
            return False
        found = place(up)
        return found is not None and found.order in kept

    return "\n".join(text for node, text, linked in found if stays(node, text, linked))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars`` (code points).

    Null html is empty; a page without text gives the empty text and 0. Pages of any length are read whole.
    Null ids and urls pass through; rows that repeat an id are pages of their own. No rows give no rows."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        text_or_empty(F.col(html_col)).alias("html"))
    return mapped(rows, run, f"id {kind}, url string, text string, n_chars long").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op2_html_main(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_main": (op2_html_main, None)}
