"""Main-content extraction over a tree: the published readability scoring, and a selector-tier extractor."""

from __future__ import annotations

import re
from math import sqrt

from webloom.functions import fixed
from webloom.functions.dom import BLOCK, Node, compile_selector, parse, select, serialize

_UNLIKELY, _MAYBE = re.compile(fixed.UNLIKELY), re.compile(fixed.MAYBE)
_POSITIVE, _NEGATIVE = re.compile(fixed.POSITIVE), re.compile(fixed.NEGATIVE)
_BYLINE, _VIDEO = re.compile(fixed.BYLINE), re.compile(fixed.EMBEDDED_VIDEO)
_SPACES = re.compile(r"\s{2,}")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_SCORED = frozenset("section h2 h3 h4 h5 h6 p td pre".split())
_DIV_BLOCKS = frozenset("a blockquote div dl img ol p pre select table ul".split())
_PHRASING = frozenset(
    "#text abbr audio b bdo br button cite code data datalist dfn em embed i img input kbd label mark math meter noscript object output progress q ruby samp script select small span strong sub sup textarea time var wbr".split()
)
_DROPPED_ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog".split())
_START = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
#: Bytes that an attempt must give before the flags are relaxed.
ENOUGH = 500


_size = lambda s: len(s.encode("utf-8", "surrogatepass"))


def inner_text(n: Node) -> str:
    return _SPACES.sub(" ", n.content().strip())


def visible(n: Node) -> bool:
    return not (_HIDDEN.search(n.attrs.get("style", "")) or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" and "fallback-image" not in n.attrs.get("class", ""))


def link_density(n: Node) -> float:
    total = _size(inner_text(n))
    return sum(_size(inner_text(a)) * (0.3 if a.attrs.get("href", "").startswith("#") else 1.0) for a in n.elements("a")) / total if total else 0.0


def class_weight(n: Node) -> int:
    return sum(25 * (bool(_POSITIVE.search(v)) - bool(_NEGATIVE.search(v))) for v in (n.attrs.get("class", ""), n.attrs.get("id", "")) if v)


def is_readable(html: str) -> bool:
    """Whether visible paragraphs of over 140 bytes add up: sum of sqrt(length - 140) above 20."""
    score = 0.0
    doc = parse(html)
    nodes = doc.elements("p", "pre") + [br.parent for br in doc.elements("br") if br.parent is not None and br.parent.tag == "div"]
    for n in dict.fromkeys(nodes):
        if not visible(n) or _UNLIKELY.search(n.names) and not _MAYBE.search(n.names):
            continue
        if any(a.tag == "li" for a in n.ancestors()) and n.tag == "p":
            continue
        size = _size(n.content().strip())
        if size >= 140:
            score += sqrt(size - 140)
            if score > 20:
                return True
    return False


class Article:
    """The result of an extraction: title, byline and the content's HTML."""

    __slots__ = ("byline", "content", "excerpt", "length", "title")

    def __init__(self, title: str, byline: str | None, content: str, excerpt: str | None, length: int):
        self.title, self.byline, self.content, self.excerpt, self.length = title, byline, content, excerpt, length


def article_title(doc: Node) -> str:
    """The document's title without the site's name, by separators, colons and lengths; the only h1 if it is no good."""
    node = doc.first("title")
    whole = title = _SPACES.sub(" ", node.content().strip()) if node else ""
    hierarchical = False
    if re.search(r" [|\-\\/>»] ", title):
        hierarchical = bool(re.search(r" [\\/>»] ", title))
        title = re.sub(r"(?s)(.*)[|\-\\/>»] .*", r"\1", whole)
        if len(title.split()) < 3:
            title = re.sub(r"(?s)[^|\-\\/>»]*[|\-\\/>»](.*)", r"\1", whole)
    elif ": " in title:
        if not any(h.content().strip() == title for h in doc.elements("h1", "h2")):
            title = whole[whole.rfind(":") + 1 :]
            if len(title.split()) < 3:
                title = whole[whole.find(":") + 1 :]
            elif len(whole[: whole.find(":")].split()) > 5:
                title = whole
    elif not 15 <= len(title) <= 150:
        heads = doc.elements("h1")
        if len(heads) == 1:
            title = inner_text(heads[0])
    title = _SPACES.sub(" ", title.strip())
    words = len(title.split())
    if words <= 4 and (not hierarchical or words != len(re.sub(r"[|\-\\/>»]+", "", whole).split()) - 1):
        title = whole
    return title


def _prepare(doc: Node) -> None:
    for n in doc.elements("script", "noscript", "style", "template"):
        n.remove()
    for n in doc.elements("font"):
        n.tag = "span"
    for br in doc.elements("br"):  # a run of line breaks ends a paragraph
        if br.parent is None:
            continue
        siblings = br.parent.children
        at = next((i for i, c in enumerate(siblings) if c is br), None)
        if at is None:
            continue
        end = at + 1
        breaks = 1
        while end < len(siblings) and (siblings[end].tag == "br" or siblings[end].tag == "#text" and not siblings[end].text.strip()):
            breaks += siblings[end].tag == "br"
            end += 1
        if breaks < 2:
            continue
        stop = end
        while stop < len(siblings) and siblings[stop].tag in _PHRASING and siblings[stop].tag != "br":
            stop += 1
        moved = siblings[end:stop]
        p = Node("p")
        parent = br.parent
        for extra in siblings[at + 1 : end]:
            extra.remove()
        br.replace_with(p)
        for m in moved:
            p.append(m)
        if parent.tag == "p":
            parent.tag = "div"


def _phrasing(n: Node) -> bool:
    return n.tag in _PHRASING or n.tag in ("a", "del", "ins") and all(_phrasing(c) for c in n.children)


def _empty(n: Node) -> bool:
    return not n.content().strip() and all(c.tag in ("#text", "br", "hr") for c in n.children)


def _grab(doc: Node, title: str, flags: frozenset[str]) -> tuple[Node | None, str | None]:
    body = doc.first("body") or doc
    byline: str | None = None
    scored: list[Node] = []
    for n in body.elements():
        if n.parent is None or not any(a is body for a in n.ancestors()):
            continue
        if not visible(n) or n.attrs.get("role") in _DROPPED_ROLES:
            n.remove()
            continue
        if byline is None and (n.attrs.get("rel") == "author" or "author" in n.attrs.get("itemprop", "") or _BYLINE.search(n.names)) and 0 < _size(n.content().strip()) < 100:
            byline = n.content().strip()
            n.remove()
            continue
        if "unlikely" in flags and n.tag not in ("body", "a", "html", "article", "main") and _UNLIKELY.search(n.names) and not _MAYBE.search(n.names):
            if not any(a.tag in ("table", "code") for a in n.ancestors()):
                n.remove()
                continue
        if n.tag in ("div", "section", "header", "h1", "h2", "h3", "h4", "h5", "h6") and _empty(n):
            n.remove()
            continue
        if n.tag in _SCORED:
            scored.append(n)
        if n.tag == "div":
            kids = [c for c in n.children if c.tag != "#text" or c.text.strip()]
            if len(kids) == 1 and kids[0].tag == "p" and link_density(n) < 0.25:
                n.replace_with(kids[0])
                scored.append(kids[0])
            elif not any(d.tag in _DIV_BLOCKS for d in n.elements()):
                n.tag = "p"
                scored.append(n)
            else:
                run: Node | None = None
                for c in list(n.children):
                    if _phrasing(c):
                        if run is None and (c.tag != "#text" or c.text.strip()):
                            run = Node("p")
                            c.replace_with(run)
                            run.append(c)
                            scored.append(run)
                        elif run is not None:
                            run.append(c)
                    else:
                        run = None
    scores: dict[Node, float] = {}
    for n in dict.fromkeys(scored):
        text = inner_text(n)
        if n.parent is None or _size(text) < 25:
            continue
        score = 1 + text.count(",") + min(_size(text) // 100, 3)
        for level, up in enumerate(list(n.ancestors())[:3]):
            if up.parent is None or up.tag in ("html", "#document"):
                break
            if up not in scores:
                scores[up] = _START.get(up.tag, 0) + (class_weight(up) if "weights" in flags else 0)
            scores[up] += score / (1 if level == 0 else 2 if level == 1 else level * 3)
    for n in scores:
        scores[n] *= 1 - link_density(n)
    best = sorted(scores, key=lambda n: -scores[n])[:5]
    if not best:
        top = Node("div")
        for c in list(body.children):
            top.append(c)
        body.append(top)
        scores[top] = 0.0
    else:
        top = best[0]
        others = [set(map(id, n.ancestors())) for n in best[1:] if scores[n] / max(scores[top], 1e-9) >= 0.75]
        if len(others) >= 3:
            for up in top.ancestors():
                if up.tag in ("body", "html", "#document"):
                    break
                if sum(id(up) in o for o in others) >= 3:
                    top = up
                    scores.setdefault(top, 0.0)
                    break
        last, least, up = scores.get(top, 0.0), scores.get(top, 0.0) / 3, top.parent
        while up is not None and up.tag not in ("body", "html", "#document"):
            s = scores.get(up)
            if s is not None:
                if s < least:
                    break
                if s > last:
                    top = up
                    break
                last = s
            up = up.parent
        while top.parent is not None and top.parent.tag not in ("body", "html", "#document") and sum(c.tag != "#text" for c in top.parent.children) == 1:
            top = top.parent
        scores.setdefault(top, 0.0)
    content = Node("div")
    home = top.parent
    threshold = max(10.0, scores[top] * 0.2)
    bonus_class = top.attrs.get("class", "")
    for s in list(top.parent.children) if top.parent is not None else [top]:
        keep = s is top
        if not keep and s.tag != "#text":
            bonus = scores[top] * 0.2 if bonus_class and s.attrs.get("class", "") == bonus_class else 0.0
            if s in scores and scores[s] + bonus >= threshold:
                keep = True
            elif s.tag == "p":
                text, density = inner_text(s), link_density(s)
                keep = _size(text) > 80 and density < 0.25 or 0 < _size(text) <= 80 and density == 0 and bool(re.search(r"\.( |$)", text))
        if keep:
            content.append(s)
    _add_story_parts(content, home)
    _clean(content, title, flags)
    return content, byline


def is_story_part(n: Node) -> bool:
    """Whether names or attributes say that a node holds article text."""
    return any(x in n.names for x in fixed.STORY_NAMES) or any(n.attrs.get(k) == v for k, v in fixed.STORY_ATTRIBUTES)


def _story_parts(home: Node) -> list[Node]:
    """Story containers of over 100 bytes under ``home``, then around it, level by level, until a level shows none."""
    seen, found = set(), []

    def look(root: Node) -> bool:
        before = len(found)
        for n in root.walk():
            if n.tag != "#text" and id(n) not in seen:
                seen.add(id(n))
                if is_story_part(n) and _size(inner_text(n)) > 100:
                    found.append(n)
        return len(found) > before

    look(home)
    for up in home.ancestors():
        if up.tag == "body" or not any([look(c) for c in list(up.children) if c.tag != "#text"]):
            break
    return found


def _add_story_parts(content: Node, home: Node | None) -> None:
    """Story containers that were left out join the article, unless it holds their first 100 bytes."""
    parts = _story_parts(home) if home is not None else []
    if len(parts) < 2:
        return
    have = inner_text(content)
    for n in parts:
        text = inner_text(n)
        first = text.encode("utf-8", "surrogatepass")[:100].decode("utf-8", "ignore")
        if _size(text) > 100 and first not in have and not any(a is n for a in content.ancestors()):
            if n.tag not in ("div", "article", "section", "p"):
                n.tag = "div"
            content.append(n)
            have += " " + text


def article_metadata(doc: Node) -> tuple[str | None, str | None, str | None]:
    """(title, byline, excerpt) that the page's meta elements state, by their chains of names."""
    values: dict[str, str] = {}
    for m in doc.elements("meta"):
        content = m.attrs.get("content", "")
        if not content:
            continue
        names = re.findall(fixed.META_PROPERTY, m.attrs.get("property", ""))
        if not names and re.search(fixed.META_NAME, m.attrs.get("name", "")):
            names = [m.attrs["name"].replace(".", ":")]
        for name in reversed(names):
            values["".join(name.lower().split())] = content.strip()
    first = lambda chain: next((values[x] for x in chain if x in values), None)
    return first(fixed.ARTICLE_TITLES), first(fixed.ARTICLE_BYLINES), first(fixed.ARTICLE_EXCERPTS)


def _table_size(t: Node) -> tuple[int, int]:
    rows = columns = 0
    num = lambda v: int(v) if v.isdigit() else 1
    for tr in t.elements("tr"):
        rows += num(tr.attrs.get("rowspan", "1")) or 1
        columns = max(columns, sum(num(td.attrs.get("colspan", "1")) or 1 for td in tr.elements("td")))
    return rows, columns


def _data_table(t: Node) -> bool:
    if t.attrs.get("role") == "presentation" or t.attrs.get("datatable") == "0":
        return False
    if t.attrs.get("summary") or t.first("caption", "col", "colgroup", "tfoot", "thead", "th"):
        return True
    if t.first("table"):
        return False
    rows, columns = _table_size(t)
    return rows >= 10 or columns > 4 or rows * columns > 10


def _clean(content: Node, title: str, flags: frozenset[str]) -> None:
    data = {id(t) for t in content.elements("table") if _data_table(t)}
    for n in content.elements():
        for name in ("style", "align", "background", "bgcolor", "border", "cellpadding", "cellspacing", "frame", "hspace", "rules", "valign", "vspace"):
            n.attrs.pop(name, None)

    def conditionally(*tags: str) -> None:
        if "conditional" not in flags:
            return
        for n in reversed(content.elements(*tags)):
            if id(n) in data or any(id(a) in data for a in n.ancestors()) or any(a.tag == "code" for a in n.ancestors()):
                continue
            weight = class_weight(n) if "weights" in flags else 0
            if weight < 0:
                n.remove()
                continue
            text = inner_text(n)
            if text.count(",") >= 10:
                continue
            count = lambda *t: len(n.elements(*t))  # noqa: E731, B023
            p, img, li, inputs = count("p"), count("img"), count("li") - 100, count("input")
            embeds = sum(not _VIDEO.search(" ".join(e.attrs.values())) for e in n.elements("embed", "object", "iframe"))
            density, size = link_density(n), len(text)
            is_list = n.tag in ("ul", "ol")
            figure = any(a.tag == "figure" for a in n.ancestors())
            if (
                img > 1 and p / img < 0.5 and not figure
                or not is_list and li > p
                or inputs > p // 3
                or not is_list and size < 25 and (img == 0 or img > 2) and not figure
                or not is_list and weight < 25 and density > 0.2
                or weight >= 25 and density > 0.5
                or embeds == 1 and size < 75
                or embeds > 1
            ):
                n.remove()

    conditionally("form", "fieldset")
    for n in content.elements("object", "embed", "footer", "link", "aside"):
        if n.tag in ("object", "embed") and _VIDEO.search(" ".join(n.attrs.values())):
            continue
        n.remove()
    for n in content.elements():
        if re.search("share", n.names) and len(n.content()) < ENOUGH and n.parent is not content:
            n.remove()
    heads = content.elements("h2")
    if len(heads) == 1:
        text = heads[0].content()
        if title and abs(len(text) - len(title)) / len(title) < 0.5 and (title in text or text in title):
            heads[0].remove()
    for n in content.elements("iframe", "input", "textarea", "select", "button"):
        if n.tag == "iframe" and _VIDEO.search(" ".join(n.attrs.values())):
            continue
        n.remove()
    if "weights" in flags:
        for n in content.elements("h1", "h2"):
            if class_weight(n) < 0:
                n.remove()
    conditionally("table", "ul", "div")
    for n in content.elements("h1"):
        n.tag = "h2"
    for n in content.elements("p"):
        if not n.content().strip() and not n.elements("img", "embed", "object", "iframe"):
            n.remove()
    for n in content.elements():
        if n.attrs.get("class") and "page" not in n.attrs["class"].split():
            n.attrs.pop("class")


def readability(html: str, url: str = "") -> Article:
    """The article of a page. Attempts relax what is stripped until one gives ENOUGH characters; else the longest wins."""
    from webloom.functions.url import resolve

    flags = ["unlikely", "weights", "conditional"]
    best: tuple[int, Node, str | None] | None = None
    title: str | None = None
    while True:
        doc = parse(html)
        if title is None:
            meta_title, meta_byline, meta_excerpt = article_metadata(doc)
            title = article_title(doc)
        _prepare(doc)
        content, byline = _grab(doc, title, frozenset(flags))
        size = _size(inner_text(content))
        if best is None or size > best[0]:
            best = (size, content, byline)
        if size >= ENOUGH or not flags:
            break
        flags.pop(0)
    _, content, byline = best
    if url:
        for n in content.elements("a", "img"):
            name = "href" if n.tag == "a" else "src"
            if n.attrs.get(name):
                n.attrs[name] = resolve(url, n.attrs[name]) or n.attrs[name]
    first = content.first("p")
    excerpt = meta_excerpt or (inner_text(first) if first else None)
    return Article(meta_title or title, meta_byline or byline, content.inner(), excerpt, len(inner_text(content)))


# The selector-tier extractor.


def is_noise_wrapper(names: str, role: str = "") -> bool:
    """Whether class and id (lower-cased, joined) or role mark a wrapper of noise."""
    if any(p in names for p in fixed.NOISE_PHRASES):
        return True
    words = names.split()
    return any(w in fixed.NOISE_TOKENS or w.startswith(fixed.NOISE_PREFIXES) for w in words) or role.lower() in fixed.NOISE_ROLES


def boost(names: str, role: str = "") -> float:
    hay = f"{names} {role}".lower()
    b = 1.0 + 0.25 * sum(h in hay for h in fixed.CONTENT_HINTS) - 0.35 * sum(p in hay for p in fixed.NOISE_PHRASES)
    return max(0.25, b + (0.4 if role.lower() in ("main", "article") else 0.0))


def content_score(text_len: int, html_len: int, link_len: int, factor: float) -> float:
    """Length times squared density, less linked text, times the boost; a quarter more for over 500 bytes."""
    if text_len < 50 or not html_len:
        return 0.0
    return text_len * (text_len / html_len) ** 2 * (1 - min(link_len / text_len, 0.85)) * factor * (1.25 if text_len > 500 else 1.0)


_PRIORITY, _TIERS, _INNER = ([compile_selector(s) for s in group] for group in (fixed.PRIORITY_SELECTORS, fixed.SCORED_SELECTORS, fixed.INNER_SELECTORS))


def _enough(html: str) -> bool:
    return _size(html) > 200 and _size(parse(html).content().strip()) / _size(html) > 0.1


def candidate_score(n: Node) -> float:
    """The score of an element as the main content; 0 for very short ones."""
    inner = n.inner()
    if _size(inner) < 80:
        return 0.0
    text, links = n.content().strip(), "".join(a.content() for a in n.elements("a")).strip()
    return content_score(_size(text), _size(inner), _size(links), boost(n.names, n.attrs.get("role", "")))


def _best(doc: Node, selectors) -> str:
    top, found = 0.0, ""
    for chain in selectors:
        for n in select(doc, chain):
            score = candidate_score(n)
            if score > top:
                top, found = score, n.inner()
    return found


def main_content(html: str) -> str:
    """Inner HTML of the main content: known containers first, then the best scored, then generic elements, then the body."""
    doc = parse(html)
    for tier in (_PRIORITY, _TIERS):
        found = _best(doc, tier)
        if found and _enough(found):
            return _refined(found)
    found = _best(doc, [compile_selector(s) for s in ("section", "div", "td")])
    if found and _enough(found):
        return _refined(found)
    body = doc.first("body")
    return body.inner() if body else html


def _refined(html: str, levels: int = 3) -> str:
    for _ in range(levels):
        inner = _best(parse(html), _INNER)
        if _size(inner) < 150 or _size(inner) >= _size(html):
            break
        html = inner
    return html


def without_noise(html: str) -> str:
    """The document without noise wrappers; semantic elements are never dropped for their names."""
    doc = parse(html)
    for n in doc.elements():
        if n.parent is not None and n.tag not in fixed.SEMANTIC_TAGS and n.tag not in ("html", "body", "head") and is_noise_wrapper(n.names.lower(), n.attrs.get("role", "")):
            n.remove()
    return serialize(doc)


def preprocess(html: str, include: list[str] | None = None, exclude: list[str] | None = None, css: str | None = None) -> str:
    """Head dropped, filters applied: ``css`` keeps the first match, ``include`` the matches' text, ``exclude`` drops matches."""
    doc = parse(html)
    head = doc.first("head")
    if head:
        head.remove()
    for n in doc.elements("script", "style", "noscript", "iframe", "svg", "button"):
        n.remove()
    if css:
        found = select(doc, css)
        return found[0].inner() if found else ""
    for s in exclude or []:
        for n in select(doc, s):
            n.remove()
    if include:
        found = [n for s in include for n in select(doc, s)]
        if found:
            return "\n".join(n.content() for n in found)
    return without_noise(serialize(doc))


def structural(html: str) -> str:
    """Tables of two rows or more and lists of five items or more as markdown, where that gives 40 bytes."""
    from webloom.functions.render import clean_markdown, to_markdown

    out = []
    for n in parse(html).elements("table", "ul", "ol"):
        if n.tag == "table" and len(n.elements("tr")) >= 2 or n.tag != "table" and len(n.elements("li")) >= 5:
            wrapper = Node("#document")
            copy = parse(serialize(n)).first(n.tag)
            if copy is not None:
                wrapper.append(copy)
                md = clean_markdown(to_markdown(wrapper))
                if _size(md) >= 40:
                    out.append(md)
    return "\n\n".join(out)


__all__ = ["BLOCK", "Article", "article_title", "boost", "content_score", "is_noise_wrapper", "is_readable", "main_content", "preprocess", "readability", "structural", "without_noise"]
