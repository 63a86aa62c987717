"""Main text of web pages by scoring the element tree.

A page is read into a tree of elements, leniently: elements may be left open,
an unclosed paragraph ends where the next block begins, and what scripts,
styles and comments hold is no markup.  Parts that are never main text (menus,
headers and footers of the page, sidebars, forms, adverts, notices, reader
comments; told by tag, role, class and id) are set aside.  Each paragraph of
the rest gives points for its length and its commas: all of them to its
parent, half to the grandparent, and less above.  An element's points count
less the more of its text is in links.  If the best element is inside an
article or main with few links, the outermost of those is taken; otherwise it
is kept with all its siblings that are not mostly links, and with what reads
like prose beside the elements around it, as far as it holds most of their
text.  Names of class and id set no element aside that holds the page's
heading or nearly all its text: such a name is one of the layout.

Every block of what is kept is a line: white space inside a block is one
space, ends are trimmed, empty blocks go, and nothing is cut off.

Edge cases: a null page is empty and has no text; a page without any text
block gives the empty text; other columns pass through.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import applied, released

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: What is left of a tag after its name.  It stops at another ``<``, so tags that never end cost no more than their length.
_REST = re.compile(r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title canvas select audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p pre td blockquote li dd figcaption div section article h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of the main text.
ASIDE = frozenset("nav footer aside form button menu dialog fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Those of them that may stand round a whole page: what they hold is the text if there is hardly any other.
SOFT, SOFT_ROLES = frozenset("form fieldset dialog".split()), frozenset("form search dialog alertdialog".split())
#: Words of class and id names that tell such parts.
_ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|toolbar|widget|site-header|page-header|topbar|toc|tags)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Words that only say what shape such a part has; beside others, a name is of a topic (``related-work``, ``notice-period``).
_SHAPES = re.compile(
    r"(?:^|[\s_-])(?:area|articles?|bar|block|body|bottom|box|buttons?|cards?|center|col|column|container|content|footer|form|group|header|heading|holder|icons?|inner|items?|left|links?|list|main|module|outer|page|panel|posts?|reader|right|row|section|site|slot|stor(?:y|ies)|title|top|unit|user|wrap|wrapper|\d+)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Names of articles that are a reader's.
_READER_ARTICLE = re.compile(r"(?:^|\s)(?:div-)?(?:comment|reply)(?:-(?:body|content|entry|item|\d+))?(?=\s|$)", re.IGNORECASE)
_READERS = re.compile("comment|disqus|repl(?:y|ies)|respond", re.IGNORECASE)
_MAIN_NAMES = re.compile(r"article|body|content|entry|main|post|story|text", re.IGNORECASE)
_ENDS_P = BLOCKS - {"body", "html"}
#: An open element of the first kind ends where one of the second begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_CLOSED_BY = {tag: tuple(o for o, by in CLOSES.items() if tag in by) for tag in CLOSES}
_STOPS = tuple("ul ol dl table div section article".split())
#: What is open inside a cell stays in it, whatever ends, but for what holds whole tables.
_CELLS = ("td", "th", "table")
_ENDS_CELLS = frozenset("table tr tbody thead tfoot div section article body html".split())
#: A page with fewer unlinked letters has its text where only names set it aside.
LITTLE = 140


class Node:
    __slots__ = ("tag", "names", "parent", "children", "points", "letters", "linked", "aside", "named", "soft")

    def __init__(self, tag: str, names: str, parent: Node | None, aside: bool):
        self.tag, self.names, self.parent, self.aside, self.named, self.soft = tag, names, parent, aside, False, False
        self.children: list[Node | str] = []
        self.points, self.letters, self.linked = 0.0, 0, 0


def _is_aside(tag: str, attributes: str, in_main: bool) -> tuple[bool, str, bool, bool]:
    """Whether an element is set aside by what it is, its names, whether it is set aside by them, and whether it may be round a whole page."""
    names, hidden, role = "", False, ""
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += " " + value
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
    if tag in ASIDE or hidden or role in ROLES:
        return True, names, False, tag in SOFT or (hidden or role in SOFT_ROLES) and tag not in ASIDE
    if tag == "header" and not in_main or tag == "article" and _READER_ARTICLE.search(names):
        return True, names, False, False
    return False, names, bool(names and tag not in ("html", "body", "article", "main") and _ASIDE_NAMES.search(names)), False


def _of_topic(names: str) -> bool:
    """Whether each name that sets an element aside has another word in it that tells a topic."""
    told = [n for n in names.split() if _ASIDE_NAMES.search(n)]
    rest = (_SHAPES.sub(" ", _ASIDE_NAMES.sub("-", _ASIDE_NAMES.sub("-", n))) for n in told)
    return bool(told) and not _READERS.search(names) and all(re.search("[A-Za-z]{3}", r) for r in rest)


def _marks(page: str):
    """(start, end, tag, whether it ends one, its attributes) of every piece of markup; tag None for comments and the like.

    One pass: no character is read more than a few times, however broken the page is.
    """
    at, last = page.find("<"), page.rfind(">")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None, False, ""
        elif page.startswith("<![CDATA[", at) and (end := page.find("]]>", at)) >= 0:
            end += 3
            yield at, end, None, False, ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or len(page)
            yield at, end, None, False, ""
        elif at < last and (name := _NAME.match(page, at)):
            rest = _REST.match(page, name.end())
            end = rest.end() if rest else page.find(">", name.end()) + 1
            yield at, end, name[1].lower(), page[at + 1] == "/", page[name.end() : end - 1]
        else:
            end = at + 1
        at = page.find("<", end)


class _Open:
    """The elements that are open, and how deep the innermost of each tag lies."""

    def __init__(self, root: Node):
        self.path, self.depths = [root], {}

    def deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Close everything from a depth on."""
        while len(self.path) > depth:
            self.depths[self.path.pop().tag].pop()


def tree(page: str) -> Node:
    root = Node("html", "", None, False)
    now = _Open(root)
    at = 0
    for start, stop, tag, ends, attributes in _marks(page):
        if start < at:
            continue
        here = now.path[-1]
        if start > at:
            here.children.append(page[at:start])
        at = stop
        if tag is None:
            continue
        if ends:
            if tag == "br" or (tag == "p" and not now.depths.get("p")):
                here.children.append(Node("br", "", here, False))
                continue
            depth = now.deepest((tag,))
            if depth and (tag in _ENDS_CELLS or depth >= now.deepest(_CELLS)):
                now.cut(depth)
            continue
        empty = attributes.endswith("/")
        if tag in RAW:
            if not empty:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P and now.depths.get("p"):
            now.cut(now.depths["p"][-1])
        if tag in CLOSES and (depth := now.deepest(_CLOSED_BY[tag])) > now.deepest(_STOPS):
            now.cut(depth)
        if tag in HEADINGS and now.path[-1].tag in HEADINGS:
            now.cut(len(now.path) - 1)
        here = now.path[-1]
        aside, names, named, soft = _is_aside(tag, attributes, bool(now.depths.get("article") or now.depths.get("main")))
        node = Node(tag, names, here, aside or named)
        node.named, node.soft = named, soft
        here.children.append(node)
        if tag not in VOID and not empty or tag in BLOCKS and empty:
            now.push(node)
    if at < len(page):
        now.path[-1].children.append(page[at:])
    return root


def _measure(root: Node) -> list[Node]:
    """Letters, linked letters and points of every element; the elements in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.aside:
            continue
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    own: dict[int, list[str]] = {}
    for node in reversed(order):
        text = [c for c in node.children if isinstance(c, str)]
        inline = []
        for c in node.children:
            if isinstance(c, str):
                inline.append(c)
            elif not c.aside:
                node.letters += c.letters
                node.linked += c.letters if c.tag == "a" else c.linked
                if c.tag not in BLOCKS:
                    inline += own.get(id(c), [])
        node.letters += sum(len(_SPACE.sub(" ", t).strip()) for t in text)
        own[id(node)] = inline
    for node in order:
        if node.tag not in PROSE:
            continue
        text = _SPACE.sub(" ", "".join(own[id(node)])).strip()
        if len(text) < 25 and node.tag[0] != "h":
            continue
        share = 1 - (node.linked / node.letters if node.letters else 0)
        gain = (1 + len(re.findall("[,،、，]", text)) + min(len(text) / 100, 30)) * share
        up, part = node.parent if node.tag not in ("div", "section", "article") else node, 1.0
        for _ in range(4):
            if up is None:
                break
            up.points += gain * part
            up, part = up.parent, part / 2 if part == 1 else part / 1.5
    return order


def _score(node: Node) -> float:
    tell = 1.25 if node.tag in ("article", "main") else 1.1 if node.names and _MAIN_NAMES.search(node.names) else 1.0
    return node.points * (1 - (node.linked / node.letters if node.letters else 0)) * tell


def _lines(node: Node, out: list[str], line: list[str]) -> None:
    """Add the blocks of a subtree to ``out``; ``line`` is the block that is open."""
    work: list[tuple[Node, int]] = [(node, 0)]
    while work:
        node, k = work.pop()
        if k == 0 and node.tag in BLOCKS:
            _end(out, line)
        while k < len(node.children):
            c = node.children[k]
            k += 1
            if isinstance(c, str):
                line.append(c)
            elif c.aside:
                continue
            elif c.tag == "br":
                line.append(" ")
            else:
                work += [(node, k), (c, 0)]
                break
        else:
            if node.tag in BLOCKS:
                _end(out, line)


def _end(out: list[str], line: list[str]) -> None:
    if line:
        text = _SPACE.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()


def _links(node: Node) -> float:
    return node.linked / node.letters if node.letters else 0.0


def _held(top: Node) -> tuple[int, bool, int, int]:
    """An element's unlinked letters, whether it holds the page's heading or main part, its linked letters, and the unlinked ones of long texts."""
    letters, heading, linked, prose, stack = 0, top.tag in ("main", "article"), 0, 0, [(top, False)]
    while stack:
        node, inside = stack.pop()
        for c in node.children:
            if isinstance(c, str):
                n = len(_SPACE.sub(" ", c).strip())
                linked += n * inside
                letters += n * (not inside)
                prose += n * (not inside and n >= 40)
            elif not c.aside:
                heading = heading or c.tag in ("h1", "main", "article")
                stack.append((c, inside or c.tag == "a"))
    return letters, heading, linked, prose


def _set_aside(root: Node) -> list[Node]:
    """The elements that are set aside by their names or may be round a whole page, without those inside others."""
    out, stack = [], [root]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                if c.aside:
                    out += [c] * (c.named or c.soft)
                else:
                    stack.append(c)
    return out


def _measured(root: Node) -> list[Node]:
    """Measure a page, taking back what was set aside though it holds the page's text, or unlinked prose under a name of a topic."""
    while True:
        order = _measure(root)
        left = root.letters - root.linked
        back = []
        for n in _set_aside(root):
            held, heading, linked, prose = _held(n)
            if held > left and heading or left < LITTLE and held > 4 * left or n.tag == "form" and prose > 2 * left:
                back.append((2, held, n))
            elif n.named and prose >= 80 and linked < 0.25 * held and _of_topic(n.names):
                back.append((1, held, n))
        if not back:
            return order
        most = max(back, key=lambda x: x[:2])
        for kind, _, n in back:  # of those that hold the page's text one at a time
            n.aside = n.aside and kind == 2 and n is not most[2]
        for n in order:
            n.points, n.letters, n.linked = 0.0, 0, 0


def _beside(best: Node, near: bool) -> list[list[Node | str]]:
    """An element with what is kept of its siblings: all that isn't mostly links, or (not ``near``) only prose.

    Text and inline elements that follow each other are one part.
    """
    parts: list[list[Node | str]] = []
    inline = False
    for c in best.parent.children:
        flows = isinstance(c, str) or c.tag not in BLOCKS and c is not best
        if flows and inline:
            parts[-1].append(c)
        elif not (isinstance(c, Node) and c.aside):
            parts.append([c])
        else:
            continue
        inline = flows
    return [p for p in parts if p[0] is best or _kept(p, near)]


def _kept(part: list[Node | str], near: bool) -> bool:
    letters = linked = 0
    for c in part:
        if isinstance(c, str):
            letters += len(_SPACE.sub(" ", c).strip())
        elif not c.aside:
            letters += c.letters
            linked += c.letters if c.tag == "a" else c.linked
    if not letters or linked >= (0.5 if near else 0.25) * letters:
        return False
    return near or letters > 80 or isinstance(part[0], Node) and re.fullmatch("h[1-6]", part[0].tag) is not None or "." in _plain(part)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    order = _measured(root)
    best = max(order, key=_score, default=root)
    if _score(best) <= 0:
        best = root
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main") and _links(up) < 0.5:
            best = up
        up = up.parent
    before: list[list[Node | str]] = []
    after: list[list[Node | str]] = []
    near = best.tag not in ("article", "main")
    here = best
    while near and here.parent is not None:
        parts = _beside(here, here is best)
        at = next(i for i, p in enumerate(parts) if p[0] is here)
        before, after = parts[:at] + before, after + parts[at + 1 :]
        up = here.parent
        if up.parent is None or 2 * (here.letters - here.linked) < up.letters - up.linked:
            break
        here = up
    if best.tag == "article" and best.parent is not None:  # others beside it that are as much of an article
        own = best.letters - best.linked
        full = [c for c in best.parent.children if isinstance(c, Node) and c.tag == "article" and not c.aside and c is not best and _links(c) < 0.25 and c.letters - c.linked >= max(250, own / 4)]
        at = {id(c): i for i, c in enumerate(best.parent.children)}
        before = [[c] for c in full if at[id(c)] < at[id(best)]] + before
        after += [[c] for c in full if at[id(c)] > at[id(best)]]
    out: list[str] = []
    for part in [*before, [best], *after]:
        _read(part, out)
    return "\n".join(out)


def _read(part: list[Node | str], out: list[str]) -> None:
    line: list[str] = []
    for c in part:
        if isinstance(c, str):
            line.append(c)
        elif c.tag == "br":
            line.append(" ")
        elif not c.aside:
            _lines(c, out, line)
    _end(out, line)


def _plain(part: list[Node | str]) -> str:
    out: list[str] = []
    _read(part, out)
    return " ".join(out)


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` for every row of ``pages`` (html); kept columns of these names give way."""

    def run(batches):
        for column in batches:
            text = [main_text(h.as_py()) for h in column]
            yield [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
        released()

    return applied(pages, keep, run, "text string, n_chars long", text="html")
