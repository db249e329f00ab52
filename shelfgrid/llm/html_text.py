"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"[\s ]+")
#: Elements whose content is not markup, elements without content, elements that open a new block.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never main text, by element; and what a word of class, id or role says, if it is all the name (else see ``_noise``).
DROPPED = RAW | frozenset(
    "head nav footer header aside form button select option input template svg math canvas object audio video dialog menu label".split()
)
NOISE = frozenset(
    "ad ads adv advert advertisement adbox banner sponsored sponsor promo cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary widget header masthead footer contentinfo comment comments "
    "disqus respond replies related recommended share sharing social newsletter subscribe subscription signup login search form pagination pager "
    "toolbar hidden dialog skip".split()
)
#: A name that begins so says what an element has or lacks, not what it is.
_ABOUT = frozenset("has have with without no not is hide show".split())
_ROOTS = frozenset("html body main article".split())
_CLOSES_P = BLOCK - frozenset("html body".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "noise", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, noise: int = 0):
        self.tag, self.parent, self.dropped, self.noise = tag, parent, dropped, noise
        self.children: list = []  # nodes and texts in page order
        self.score = 0.0
        self.chars = self.linked = 0


def _noise(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is never main text, by its kind or because it is hidden; and how far its names speak against it.

    2: an attribute is one word of ``NOISE`` and nothing else. 1: one is among its words or parts of words, which also
    wrappers of the whole page have.
    """
    if tag in DROPPED:
        return True, 0
    if not attributes.strip():
        return False, 0
    noise = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if tag in _ROOTS:
            continue
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and _NONE.search(value):
            return True, 0
        if name in ("class", "id", "role"):
            words = value.split()
            if len(words) == 1 and words[0] in NOISE:
                noise = 2
            for word in words:
                parts = re.split(r"[_\-]+", word)
                if parts[0] not in _ABOUT and not NOISE.isdisjoint(parts):
                    noise = max(noise, 1)
    return False, noise


class Scanner:
    """Tags of a page in one pass. A quote only quotes directly behind ``=``, and only if it is closed."""

    def __init__(self, html: str):
        self.html, self.unclosed = html, set()

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it is an end tag, attributes) of the next tag; an empty name for a comment and the like."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), "", False, ""
            if html.find(">", start) < 0:
                return None  # nor does any later tag end
            if html[start + 1 : start + 2] in ("!", "?"):
                return start, html.find(">", start) + 1, "", False, ""
            closing = html.startswith("</", start)
            name = _NAME.match(html, start + 1 + closing)
            if name is None:
                at = start + 1
                continue
            end = self.tag_end(name.end())
            if end is None:
                return None
            return start, end, name[0].lower(), closing, html[name.end() : end - 1]
        return None

    def tag_end(self, at: int) -> int | None:
        while found := _END.search(self.html, at):
            at = found.end()
            if found[0] == ">":
                return at
            quote = found[0][-1]
            if quote not in self.unclosed:
                close = self.html.find(quote, at)
                if close < 0:
                    self.unclosed.add(quote)  # nor is any later one
                else:
                    at = close + 1
        return None


def parse(html: str) -> Node:
    """The element tree; paragraphs, list items and cells end where the next one begins, unknown end tags are ignored."""
    root = node = Node("#", None, False)
    at, scanner, seen = 0, Scanner(html), set()
    while True:
        found = scanner.next(at)
        text = html[at:found[0] if found else len(html)]
        if text:
            node.children.append(text)
        if not found:
            return root
        _, at, tag, closing, attributes = found
        if not tag:
            continue
        if closing:
            up = node if tag in seen else None
            while up is not None and up.tag != tag:
                # An inline element does not end beyond its block.
                up = up.parent if tag in BLOCK or up.tag not in BLOCK else None
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag in VOID:
            node.children.append(None if tag in ("br", "hr") else "")
            continue
        if tag in _CLOSES_P:
            node = _closed(node, "p")
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            node = _closed(node, "dd" if tag == "dt" else "dt" if tag == "dd" else tag)
            node = _closed(node, tag)
        child = Node(tag, node, *_noise(tag, attributes))
        node.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif not attributes.endswith("/") or tag not in ("path", "rect", "circle"):
            node = child
            seen.add(tag)


def _closed(node: Node, tag: str) -> Node:
    """Where to go on once an open ``tag`` ends, if one is open inside the nearest container."""
    up = node
    while up is not None and up.tag != tag:
        if up.tag in BLOCK and up.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            return node
        up = up.parent
    return up.parent if up is not None and up.parent is not None else node


def _blocks(node: Node, holder: Node, linked: bool, out: list) -> None:
    """(block element, text, characters in links) in page order, without what is never main text. No recursion."""
    parts: list[tuple[str, bool]] = []
    stack = [(node, holder, linked, iter(node.children))]

    def flush(owner: Node) -> None:
        text = _SPACE.sub(" ", unescape("".join(p for p, _ in parts))).strip()
        if text:
            out.append((owner, text, min(len(text), sum(len(p.strip()) for p, link in parts if link))))
        parts.clear()

    while stack:
        current, owner, in_link, rest = stack[-1]
        child = next(rest, stack)
        if child is stack:
            stack.pop()
            if current.tag in BLOCK or not stack:
                flush(owner)
        elif child is None:
            parts.append((" ", False))
        elif isinstance(child, str):
            parts.append((child, in_link))
        elif not child.dropped:
            if child.tag in BLOCK:
                flush(owner)
                stack.append((child, child, in_link, iter(child.children)))
            else:
                stack.append((child, owner, in_link or child.tag == "a", iter(child.children)))
        elif child.tag in BLOCK:
            flush(owner)


def main_text(html: str | None) -> str:
    """Blocks of the best container and of its good siblings, one a line.

    Each block gives its parent a point, one for each comma and up to three for its length, half of them to the
    grandparent and a third, a quarter, ... to those above, up to eight. A container's points are discounted by the share of its text in
    links. Siblings stay if they have a fifth of the best points, or are paragraphs of over 80 characters with few links.

    Elements named like navigation, comments and so on go first, but not those that hold most of the page's points under a
    name of which that word is only a part. If nothing is left, the outermost of them come back, then all.
    """
    if not html:
        return ""
    root = parse(html)
    named = _named(root)
    if named:
        _judge(root, named)
    found = _best_text(root)
    for back in (lambda: [n for n in _named(root) if n.dropped], lambda: named):
        if not found and (nodes := back()):
            for node in nodes:
                node.dropped = False
            found = _best_text(root)
    return found


def _named(root: Node) -> list[Node]:
    """Elements with a name that speaks against them, in page order, but for those inside of dropped ones."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.noise:
            out.append(node)
        if not node.dropped:
            stack += [c for c in reversed(node.children) if isinstance(c, Node) and (c.noise or not c.dropped)]
    return out


def _judge(root: Node, named: list[Node]) -> None:
    """Drop elements by name; those of which only a part of the name tells stay if most of the page's points are theirs."""
    for node in named:
        node.dropped = node.noise == 2
    if all(n.dropped for n in named):
        return
    points_of = _points(root)
    total, within = sum(points_of.values()), dict(points_of)
    for node in reversed(_elements(root)):
        if node.parent is not None and node in within:
            within[node.parent] = within.get(node.parent, 0.0) + within[node]
    for node in named:
        node.dropped = node.dropped or within.get(node, 0.0) <= total / 2


def _elements(root: Node) -> list[Node]:
    """Elements that are not dropped, each behind its parent."""
    out = [root]
    for node in out:
        out += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    return out


def _points(root: Node) -> dict[Node, float]:
    """The points of each block's text, without what is in links."""
    blocks: list[tuple[Node, str, int]] = []
    _blocks(root, root, False, blocks)
    out: dict[Node, float] = {}
    for block, text, linked in blocks:
        out[block] = out.get(block, 0.0) + _worth(text) * (1 - linked / len(text))
    return out


def _worth(text: str) -> float:
    return (1 if len(text) >= 25 else 0.1) + text.count(",") + min(len(text) / 100, 3)


def _best_text(root: Node) -> str:
    """The text of the best container and its good siblings."""
    blocks: list[tuple[Node, str, int]] = []
    _blocks(root, root, False, blocks)
    for block, text, linked in blocks:
        level = block if block.tag not in _PARAGRAPHS else block.parent or block
        level.chars += len(text)
        level.linked += linked
        points, share = _worth(text), 1
        while level is not None and share <= _REACH:
            level.score += points / share
            share += 1
            level = level.parent
    elements = _elements(root)
    for node in reversed(elements):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    scored = [n for n in elements if n.chars]
    if not scored:
        return ""
    for node in scored:
        node.score *= 1 - node.linked / node.chars
    best = max(scored, key=lambda n: n.score)
    kept = {id(best)}
    own = {id(b): (t, linked) for b, t, linked in blocks}
    for sibling in best.parent.children if best.parent is not None else ():
        if isinstance(sibling, Node) and not sibling.dropped:
            text, linked = own.get(id(sibling), ("", 0))
            if sibling.score >= max(10, best.score / 5) or sibling.tag == "p" and len(text) > 80 and linked < len(text) / 4:
                kept.add(id(sibling))
    lines, inside = [], {}
    for block, text, _ in blocks:
        up, path = block, []
        while up is not None and id(up) not in inside and id(up) not in kept:
            path.append(id(up))
            up = up.parent
        found = up is not None and (id(up) in kept or inside[id(up)])
        inside.update(dict.fromkeys(path, found))
        if found:
            lines.append(text)
    return "\n".join(lines)


_REACH = 8  # ancestors that a block gives points to
_PARAGRAPHS = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption summary".split())


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` (empty if there is none) and ``n_chars`` (its code points).

    Null counts as empty html; broken markup, unclosed elements and very deep or long pages are read like any other, whole.
    Every row gives a row, repeated ones too; an empty table none. Columns named like a new one are replaced. A page is one
    row and needs no other, so nothing is shuffled.
    """
    pages = pages.drop("text", "n_chars")
    rest = pages.drop(html)
    kept = rest.columns

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(html).to_pylist()]
            columns = [batch.column(n) for n in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.record_batch(columns, names=[*kept, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return pages.mapInArrow(extract, f"{schema + ', ' if schema else ''}text string, n_chars long")
