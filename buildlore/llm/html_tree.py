"""A forgiving reader of HTML: the block elements of a page as a tree, and the page's text runs in order.

Inline elements belong to the block around them. Markup errors that browsers forgive are forgiven: missing end tags, stray end tags, quotes
that never close, comments that never end.
"""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript textarea select button svg math iframe object canvas title head".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend address details summary dialog menu center hgroup search".split()
)
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in RAW}


class Node:
    """A block element."""

    __slots__ = ("tag", "parent", "depth", "tokens", "own", "links", "marks", "inner", "children", "place", "total", "all_links", "all_marks")

    def __init__(self, tag: str, parent: int, depth: int, attributes: str, place: int):
        self.tag, self.parent, self.depth, self.place = tag, parent, depth, place
        self.tokens = ["<" + tag]
        if attributes:
            for found in ATTRIBUTE.finditer(attributes):
                self.tokens += [p.lower() for p in PART.findall(found[1] or found[2] or found[3] or "")]
        self.own = self.links = self.marks = self.inner = 0
        self.children: list[int] = []


class Page:
    """nodes: block elements in page order, the first stands for the page. runs: (node, block, text), texts decoded but not yet trimmed."""

    def __init__(self, source: str):
        self.nodes = [Node("#page", -1, 0, "", 0)]
        self.runs: list[tuple[int, int, str]] = []
        self.length = max(1, len(source))
        self._read(source)
        self._sum()

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]
        at, node, block, silent, links, n = 0, 0, 0, 0, 0, len(source)
        nodes, runs = self.nodes, self.runs
        while at < n:
            m = TOKEN.search(source, at)
            start = m.start() if m else n
            if start > at and not silent:
                text = source[at:start]
                if "&" in text:
                    text = html.unescape(text)
                runs.append((node, block, text))
                if not text.isspace():
                    size = len(text.strip())
                    own = nodes[node]
                    own.own += size
                    own.marks += text.count(".") + text.count(",")
                    if links:
                        own.links += size
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:  # an end tag
                k = len(stack) - 1
                while k > 0 and stack[k][0] != tag:
                    if tag == "p" and stack[k][0] in BLOCK:
                        k = 0
                        break
                    k -= 1
                if k > 0:
                    for name, _ in stack[k:]:
                        silent -= name in SILENT
                        links -= name == "a"
                        block += name in BLOCK
                    del stack[k:]
                    node = stack[-1][1]
                continue
            attributes = m[3] if m[3] is not None else m[6] or ""
            if tag in VOID:
                if tag == "hr":
                    block += 1
                elif tag == "br" and not silent:
                    runs.append((node, block, "\n"))
                nodes[node].inner += 1
                continue
            if tag in RAW:
                end = _CLOSING[tag].search(source, at)
                at = end.start() if end else n
                close = source.find(">", at) if end else -1
                at = close + 1 if close >= 0 else n
                continue
            if tag == "a" and links:
                stack, node, links, silent, block = self._pop(stack, ("a",), tuple(BLOCK), links, silent, block)
            if tag in BLOCK:
                if silent and tag != "html":
                    stack, node, links, silent, block = self._pop(stack, ("head",), (), links, silent, block)
                if tag in CLOSES_ITSELF:
                    stack, node, links, silent, block = self._pop(stack, CLOSES_ITSELF[tag], SCOPE.get(tag, ()), links, silent, block)
                elif tag not in ("html", "body"):
                    stack, node, links, silent, block = self._pop(stack, ("p",), ("article", "section", "div", "td", "th", "li", "main", "body"), links, silent, block)
                block += 1
                nodes.append(Node(tag, node, nodes[node].depth + 1, attributes, start))
                nodes[node].children.append(len(nodes) - 1)
                node = len(nodes) - 1
            else:
                nodes[node].inner += 1
                silent += tag in SILENT
                links += tag == "a"
            stack.append((tag, node))

    @staticmethod
    def _pop(stack: list, tags: tuple, scope: tuple, links: int, silent: int, block: int) -> tuple:
        """Close the innermost open element of `tags`, unless one of `scope` lies in between."""
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k][0]
            if name in tags:
                for gone, _ in stack[k:]:
                    links -= gone == "a"
                    silent -= gone in SILENT
                    block += gone in BLOCK
                stack = stack[:k]
                break
            if name in scope:
                break
        return stack, stack[-1][1], links, silent, block

    def _sum(self) -> None:
        for x in self.nodes:
            x.total, x.all_links, x.all_marks = x.own, x.links, x.marks
        for x in reversed(self.nodes):
            if x.parent >= 0:
                up = self.nodes[x.parent]
                up.total += x.total
                up.all_links += x.all_links
                up.all_marks += x.all_marks
                up.inner += x.inner + 1

    def text(self, wanted: list[bool]) -> str:
        """The blocks' texts in page order, from the nodes wanted, white space inside a block as one space, a line a block."""
        out, last, pieces = [], -1, []
        for node, block, text in self.runs:
            if block != last:
                if pieces:
                    out.append(" ".join("".join(pieces).split()))
                    pieces = []
                last = block
            if wanted[node]:
                pieces.append(text)
        if pieces:
            out.append(" ".join("".join(pieces).split()))
        return "\n".join(x for x in out if x)
