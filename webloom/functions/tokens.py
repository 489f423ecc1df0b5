"""A tolerant, linear HTML tokenizer: the one place that splits markup into tags and text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no markup.
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "noembed", "noframes"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}

TEXT, OPEN, CLOSE, RAWTEXT = 0, 1, 2, 3


def attributes(source: str) -> dict[str, str]:
    """Names lower-cased, character references decoded, the first of equal names wins."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        name = name.lower()
        if name not in out:
            value = a or b or c
            out[name] = unescape(value) if "&" in value else value
    return out


def tokens(html: str) -> Iterator[tuple[int, str, str]]:
    """(TEXT, decoded text, ''), (OPEN, tag, attribute source), (CLOSE, tag, ''), (RAWTEXT, text, tag)."""
    at, size = 0, len(html)
    search = _TAG.search
    while at < size:
        m = search(html, at)
        if m is None:
            break
        if m.start() > at:
            text = html[at : m.start()]
            yield TEXT, unescape(text) if "&" in text else text, ""
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            yield CLOSE, tag, ""
            continue
        attrs = m[3] if m[2] else m[6]
        yield OPEN, tag, attrs
        if tag in RAW and not attrs.endswith("/"):
            end = _ENDS[tag].search(html, at)
            stop = end.start() if end else size
            raw = html[at:stop]
            yield RAWTEXT, unescape(raw) if tag in ("title", "textarea") and "&" in raw else raw, tag
            yield CLOSE, tag, ""
            at = end.end() if end else size
    if at < size:
        text = html[at:]
        yield TEXT, unescape(text) if "&" in text else text, ""
