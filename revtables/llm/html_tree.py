"""HTML as a tree of elements and text blocks, by one pass of a regular expression."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict

# Elements of the HTML standard by how they take part in a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template".split())
#: A raw element that is not closed hides the rest of the page if it is one of these; others hide nothing.
HIDES_REST = frozenset({"script", "style"})
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del "
    "math annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: What may stand in head; the first other tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noscript".split()) | RAW
#: These stand inside a paragraph and do not end it, nor does what is in them.
EMBEDDED = frozenset("svg noscript iframe button select datalist".split())
#: An opening tag ends an open element of these, up to the nearest element that bounds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


class Node:
    """An element, or a block of text (tag ``#text``) with its whole text and linked characters."""

    __slots__ = ("tag", "parent", "depth", "names", "text", "linked", "label", "children")

    def __init__(self, tag: str, parent: int, depth: int, names: str = "", label: int = -1) -> None:
        self.tag, self.parent, self.depth, self.names, self.label = tag, parent, depth, names, label
        self.text, self.linked, self.children = "", 0, 0


def parse(page: str) -> list[Node]:
    """The nodes of a page in document order; node 0 is the root.

    Void and raw elements, comments and what may stand in head are left out; head ends at
    its end tag, or at the first tag or text that cannot stand in it. Inline elements
    are no nodes: their text belongs to the block around them. A block is the text between
    two bounds of other elements, character references decoded, white space made one space.
    No tag looks through the open elements one by one, so deep pages take no longer a tag.
    Elements that are not closed end with their parent, or where a next one must end them.
    """
    nodes = [Node("#root", -1, 0)]
    stack: list[int] = [0]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of a tag
    inline: list[str] = []
    inside: Counter = Counter()  # how often each tag is in ``inline``
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if not parts:
            return
        text = SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
        if text:
            node = Node("#text", stack[-1], len(stack))
            node.text = text
            node.linked = sum(len(SPACE.sub(" ", p)) for p, link in parts if link)
            node.label = nodes[stack[-1]].label
            nodes[stack[-1]].children += 1
            nodes.append(node)
        parts.clear()

    def add(text: str) -> None:
        if text:
            parts.append((html.unescape(text), inside["a"] > 0))

    def close(to: int) -> None:
        """Cut the stack down to ``to`` open elements."""
        flush()
        for k in range(len(stack) - 1, to - 1, -1):
            opened[nodes[stack[k]].tag].pop()
        del stack[to:]
        inline.clear()
        inside.clear()

    at, in_head, began = 0, False, False
    while at < len(page):
        token = TOKEN.search(page, at)
        text = page[at : token.start() if token else len(page)]
        if text.strip():
            in_head, began = False, True
        if not in_head:
            add(text)
        if token is None:
            break
        at = token.end()
        end, tag, rest = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not end:
            if not rest.endswith("/"):
                closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                if closing or tag in HIDES_REST:
                    at = closing.end() if closing else len(page)
            if tag not in INLINE:
                flush()
            continue
        if tag == "head":
            in_head = not end and not began
            continue
        if in_head and (tag in IN_HEAD or end and tag not in ("body", "html", "br")):
            continue
        in_head = False
        began = began or tag != "html"
        if tag == "br" or tag == "wbr" or tag == "img":
            parts.append((" " if tag == "br" else "", False))
            continue
        if tag in VOID:
            flush()
            continue
        if tag in INLINE:
            if not end:
                inline.append(tag)
                inside[tag] += 1
            elif inside[tag]:
                k = len(inline) - 1
                while inline[k] != tag:
                    k -= 1
                del inline[k]
                inside[tag] -= 1
            continue
        if end:
            if opened[tag]:
                close(opened[tag][-1])
            else:
                flush()
            continue
        ended, bounds = ENDS.get(tag, ({"p"}, {"button", "td", "th", "table", "li", "div", "section", "article"}))
        upto = len(stack)
        if tag not in EMBEDDED:
            ended = ended | {"p"}
            bound = max((opened[name][-1] for name in (bounds | EMBEDDED) - ended if opened[name]), default=0)
            for name in ended:
                k = bisect_right(opened[name], bound)
                upto = min(upto, opened[name][k]) if k < len(opened[name]) else upto
        close(upto)
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
        names = " ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label"))
        label = found.get("data-y")
        node = Node(tag, stack[-1], len(stack), names.lower(), int(label) if label in ("0", "1") else nodes[stack[-1]].label)
        nodes[stack[-1]].children += 1
        nodes.append(node)
        if not rest.endswith("/"):
            opened[tag].append(len(stack))
            stack.append(len(nodes) - 1)
    flush()
    return nodes
