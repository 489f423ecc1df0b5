"""A small HTML tree and the CSS selectors that extraction needs. Lives inside Python workers only."""

from __future__ import annotations

import re
from collections.abc import Iterator

from webloom.functions.tokens import CLOSE, OPEN, RAWTEXT, TEXT, VOID, attributes, tokens

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"} | {"dd", "dt", "li"}
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Closing one of these reaches past open inline elements, never past another of these.
_BARRIERS = frozenset("table td th caption button object html".split())


class Node:
    """An element, or a text node (tag ``#text``)."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node) -> Node:
        if child.parent is not None:
            child.remove()
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace_with(self, *nodes: Node) -> None:
        parent = self.parent
        at = next(i for i, c in enumerate(parent.children) if c is self)
        for n in nodes:
            if n.parent is not None and n is not self:
                n.parent.children = [c for c in n.parent.children if c is not n]
            n.parent = parent
        parent.children[at : at + 1] = nodes
        self.parent = None

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def elements(self, *tags: str) -> list[Node]:
        """Elements below this one; of these tags only, where given."""
        return [n for n in self.walk() if n is not self and n.tag != "#text" and (not tags or n.tag in tags)]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.tag in tags), None)

    def content(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag == "#text")

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    @property
    def names(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"

    def inner(self) -> str:
        return "".join(map(serialize, self.children))


def serialize(root: Node) -> str:
    """HTML of a node; without recursion, so depth doesn't matter."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "#text":
            raw = n.parent is not None and n.parent.tag in ("script", "style")
            out.append(n.text if raw else n.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif n.tag == "#document":
            stack.extend(reversed(n.children))
        else:
            attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
            out.append(f"<{n.tag}{attrs}>")
            if n.tag not in VOID:
                stack.append(f"</{n.tag}>")
                stack.extend(reversed(n.children))
    return "".join(out)


def parse(html: str) -> Node:
    """The tree of a page: html, head and body are always there; implied end tags and open formatting are handled."""
    doc = Node("#document")
    root = doc.append(Node("html"))
    head, body = root.append(Node("head")), root.append(Node("body"))
    stack: list[Node] = [body]
    in_head = True
    reopen: list[Node] = []

    def close(tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                reopen.extend(n for n in stack[i + 1 :] if n.tag in _FORMATTING and n.tag != "a")
                del stack[i:]
                return True
            if stack[i].tag in barrier:
                return False
        return False

    def resume() -> None:
        for n in reopen[-8:]:
            stack.append(stack[-1].append(Node(n.tag, dict(n.attrs))))
        reopen.clear()

    for kind, value, extra in tokens(html):
        if kind == TEXT:
            if in_head and not value.strip():
                continue
            in_head = False
            if value.strip():
                resume()
            stack[-1].append(Node("#text", text=value))
        elif kind == RAWTEXT:
            stack[-1].append(Node("#text", text=value))
        elif kind == OPEN:
            attrs = attributes(extra) if extra and not extra.isspace() else {}
            if value == "html":
                root.attrs = attrs | root.attrs
                continue
            if value == "head":
                continue
            if value == "body":
                body.attrs, in_head = attrs | body.attrs, False
                continue
            if in_head and value in ("title", "meta", "link", "base", "style", "script", "noscript", "template"):
                node = head.append(Node(value, attrs))
                if value not in VOID:
                    stack.append(node)
                continue
            in_head = False
            if value in _CLOSES_P:
                close({"p"}, _BARRIERS)
            if value in _SIBLINGS:
                tags, barrier = _SIBLINGS[value]
                while close(tags, barrier):
                    pass
            if value == "a":
                close({"a"}, BLOCK)
                reopen.clear()
            elif value not in BLOCK and value not in VOID:
                resume()
            node = stack[-1].append(Node(value, attrs))
            if value not in VOID and not extra.endswith("/"):
                stack.append(node)
        elif kind == CLOSE and value not in VOID and value not in ("html", "body"):
            if value == "head":
                del stack[1:]
                continue
            close({value}, _BARRIERS if value not in ("table", "td", "th", "button", "caption", "tr", "tbody", "thead", "tfoot") else frozenset())
            if value in _FORMATTING:
                reopen[:] = [n for n in reopen if n.tag != value]
    return doc


# Selectors: compounds of tag, #id, .class and [attribute] tests, descendant combinators, comma lists.
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:([*^$~|]?)=(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+)))?\]")


def _compound(source: str) -> list[tuple]:
    tests, at = [], 0
    for m in _COMPOUND.finditer(source):
        if m.start() != at:
            raise ValueError(f"selector not understood: {source}")
        at = m.end()
        if m[1]:
            tests.append(("tag", m[1].lower()))
        elif m[2]:
            tests.append(("id", m[2]))
        elif m[3]:
            tests.append(("class", m[3]))
        else:
            value = next((x for x in (m[6], m[7], m[8]) if x is not None), None)
            tests.append(("attr", m[4].lower(), m[5] or ("=" if value is not None else ""), value))
    if at != len(source) or not tests:
        raise ValueError(f"selector not understood: {source}")
    return tests


def compile_selector(selector: str) -> list[list[list[tuple]]]:
    """ValueError for what isn't understood."""
    return [[_compound(c) for c in one.split()] for one in _split_list(selector)]


def _split_list(selector: str) -> list[str]:
    parts, depth, quote, now = [], 0, "", ""
    for c in selector:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
        if c == "," and not quote and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*parts, now] if p.strip()]


def _test(node: Node, tests: list[tuple]) -> bool:
    for t in tests:
        if t[0] == "tag":
            if t[1] not in ("*", node.tag):
                return False
        elif t[0] == "id":
            if node.attrs.get("id") != t[1]:
                return False
        elif t[0] == "class":
            if t[1] not in node.attrs.get("class", "").split():
                return False
        else:
            have = node.attrs.get(t[1])
            ok = have is not None and {
                "": lambda: True, "=": lambda: have == t[3], "*": lambda: bool(t[3]) and t[3] in have, "^": lambda: have.startswith(t[3]),
                "$": lambda: have.endswith(t[3]), "~": lambda: t[3] in have.split(), "|": lambda: have == t[3] or have.startswith(t[3] + "-"),
            }[t[2]]()
            if not ok:
                return False
    return True


def select(root: Node, selector: str | list[list[list[tuple]]]) -> list[Node]:
    """Elements below ``root`` that a selector matches, in document order."""
    chains = compile_selector(selector) if isinstance(selector, str) else selector
    out = []
    for n in root.elements():
        for chain in chains:
            if _test(n, chain[-1]):
                rest, up = len(chain) - 2, n.parent
                while rest >= 0 and up is not None:
                    if _test(up, chain[rest]):
                        rest -= 1
                    up = up.parent
                if rest < 0:
                    out.append(n)
                    break
    return out
