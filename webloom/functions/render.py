"""Renderings of a tree: plain text and markdown, and the regular-expression clean-ups in their Python form."""

from __future__ import annotations

import re

from webloom.functions import fixed
from webloom.functions.dom import BLOCK, Node, parse

_MARKDOWN = [re.compile(p) for p in fixed.MARKDOWN_STEPS]
_SPACE = re.compile(r"[ \t\n\r]+")
_WIDE = re.compile(r"[\s ]+")
_HIDDEN = frozenset({"script", "style", "noscript", "template", "head", "title", "meta", "link", "iframe", "svg", "object"})


def plain_text(html: str) -> str:
    """All text of the document, blanks collapsed. Scripts' and styles' text is part of it."""
    return _SPACE.sub(" ", parse(html).content()).strip()


def clean_markdown(md: str) -> str:
    for step in _MARKDOWN:
        md = step.sub("", md)
    return md


def markdown(html: str) -> str:
    return clean_markdown(to_markdown(parse(html)))


def _escape(text: str) -> str:
    return re.sub(r"([\\`*_\[\]])", r"\\\1", text)


class _Lines:
    """Blocks of markdown, a blank line between them."""

    def __init__(self) -> None:
        self.blocks: list[str] = []
        self.inline: list[str] = []

    def flush(self, prefix: str = "") -> None:
        text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(self.inline))).strip()
        self.inline.clear()
        if text:
            self.blocks.append(prefix + text)


def to_markdown(root: Node) -> str:
    out = _Lines()
    _block(root, out, 0)
    out.flush()
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(b for b in out.blocks if b.strip())).strip()


def _nested(n: Node, depth: int) -> str:
    inner = _Lines()
    for c in n.children:
        _block(c, inner, depth + 1)
    inner.flush()
    return "\n\n".join(inner.blocks)


def _block(n: Node, out: _Lines, depth: int) -> None:
    tag = n.tag
    if tag in _HIDDEN:
        return
    if tag == "#text" or tag not in BLOCK and tag != "#document" or depth > 200:
        out.inline.append(_inline(n) if depth <= 200 else _escape(_WIDE.sub(" ", n.content())))
        return
    out.flush()
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        text = _WIDE.sub(" ", "".join(map(_inline, n.children))).strip()
        if text:
            out.blocks.append("#" * int(tag[1]) + " " + text)
    elif tag == "pre":
        out.blocks.append("```\n" + n.content().strip("\n") + "\n```")
    elif tag == "blockquote":
        inner = _nested(n, depth)
        if inner:
            out.blocks.append("\n".join(("> " + line).rstrip() for line in inner.split("\n")))
    elif tag in ("ul", "ol"):
        items, k = [], 0
        for c in n.children:
            if c.tag == "#text" and not c.text.strip():
                continue
            text = _nested(c, depth) if c.tag == "li" else "".join([_inline(c)]).strip()
            if text:
                k += 1
                mark = f"{k}. " if tag == "ol" else "- "
                items.append(mark + text.replace("\n\n", "\n").replace("\n", "\n" + " " * len(mark)))
        if items:
            out.blocks.append("\n".join(items))
    elif tag == "table":
        rows = [[_WIDE.sub(" ", "".join(map(_inline, c.children))).strip().replace("|", "\\|") for c in r.children if c.tag in ("td", "th")] for r in n.elements("tr")]
        rows = [r for r in rows if r]
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            out.blocks.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
    elif tag == "hr":
        out.blocks.append("* * *")
    else:
        for c in n.children:
            _block(c, out, depth + 1)
        out.flush()


def _inline(n: Node, depth: int = 0) -> str:
    if n.tag == "#text":
        return _escape(_WIDE.sub(" ", n.text))
    if n.tag in _HIDDEN:
        return ""
    if n.tag == "br":
        return "  \n"
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')})"
    text = "".join(_inline(c, depth + 1) for c in n.children) if depth < 100 else _escape(n.content())
    bare = text.strip()
    around = lambda mark: text.replace(bare, f"{mark}{bare}{mark}", 1) if bare else text
    if n.tag in ("b", "strong"):
        return around("**")
    if n.tag in ("i", "em"):
        return around("*")
    if n.tag in ("s", "del", "strike"):
        return around("~~")
    if n.tag == "code":
        return f"`{n.content()}`" if n.content() else ""
    if n.tag == "a" and n.attrs.get("href") and bare:
        return f"[{bare}]({n.attrs['href']})"
    return text
