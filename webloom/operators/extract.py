"""Document extraction: one Arrow operator that parses each page once and returns only the renderings asked for."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.base import any_of
from webloom.functions.color import named_points, nearest
from webloom.functions.dom import Node, parse, select, serialize
from webloom.functions.links import page_images, page_links
from webloom.functions.tokens import OPEN, RAWTEXT, attributes, tokens
from webloom.functions.readability import Article, boost, candidate_score, is_readable, main_content, preprocess, readability, structural
from webloom.functions.render import markdown, plain_text
from webloom.functions.url import resolve

FORMATS = ("markdown", "html", "rawHtml", "plainText", "links", "imageLinks", "json")
ALIASES = {"extract": "json", "llm-extract": "json"}
EXTRACTORS = ("auto", "readability", "legacy")

_META_FIELDS = ("title", "description", "og_title", "og_description", "og_image", "canonical_url", "language", "author", "published_time", "modified_time")
#: Sources of each field, the first that has a value wins: (attribute of meta, its value).
_META_SOURCES = {
    "description": (("name", "description"),),
    "og_title": (("property", "og:title"),),
    "og_description": (("property", "og:description"),),
    "og_image": (("property", "og:image"),),
    "author": (("name", "author"), ("property", "article:author"), ("name", "byl")),
    "published_time": (("property", "article:published_time"), ("name", "pubdate"), ("name", "date"), ("itemprop", "datePublished")),
    "modified_time": (("property", "article:modified_time"), ("name", "lastmod"), ("itemprop", "dateModified")),
}


def parse_formats(names: list[str] | None) -> list[str]:
    """Known formats, each once; ValueError for others; markdown for none."""
    out: list[str] = []
    for n in names or []:
        n = ALIASES.get(n.strip(), n.strip())
        if n not in FORMATS:
            raise ValueError(f"unknown format {n!r}")
        if n not in out:
            out.append(n)
    return out or ["markdown"]


_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
_LATER = re.compile(r"<(?:meta|link|title)\b", re.I)


def _head(html: str) -> tuple[list[dict[str, str]], list[dict[str, str]], str | None, dict[str, str]]:
    """(metas, links, title, attributes of html) from the tags alone, without a tree; only the head is read where no more can follow."""
    end = _HEAD_END.search(html)
    if end and not _LATER.search(html, end.end()):
        html = html[: end.start()]
    metas, links, title, root = [], [], None, None
    for kind, value, attrs in tokens(html):
        if kind == OPEN:
            if value == "meta":
                metas.append(attributes(attrs))
            elif value == "link":
                links.append(attributes(attrs))
            elif value == "html" and root is None:
                root = attributes(attrs)
            elif value == "title" and title is None:
                title = ""
        elif kind == RAWTEXT and attrs == "title" and title == "":
            title = value
    return metas, links, title, root or {}


def metadata(html: str) -> dict[str, str | None]:
    """Ten fields of a page; a field is null without a source, empty where its source is blank."""
    metas, links, title, root = _head(html)
    out: dict[str, str | None] = dict.fromkeys(_META_FIELDS)

    def put(name: str, value: str | None) -> bool:
        if value:
            out[name] = value.strip()
        return bool(value)

    put("title", title)
    for field, sources in _META_SOURCES.items():
        for attr, value in sources:
            hit = next((m for m in metas if m.get(attr) == value), None)
            if hit is not None and put(field, hit.get("content")):
                break
    put("canonical_url", next((x.get("href") for x in links if x.get("rel") == "canonical"), None))
    put("language", root.get("lang"))
    return out


def resolved_title(meta: dict[str, str | None]) -> str:
    og = meta.get("og_title")
    if og:
        m = re.search(r"[|–—-]", og)
        return og[: m.start()].strip() if m and m.start() else og.strip()
    return (meta.get("title") or "").strip()


def display_date(iso: str) -> str:
    from datetime import datetime, timezone

    try:
        when = datetime.fromisoformat(iso.replace("Z", "+00:00"))
    except ValueError:
        return iso
    return when.astimezone(timezone.utc).strftime("%d %b %Y, %H:%M UTC") if when.tzinfo else iso


def header(meta: dict[str, str | None]) -> str:
    parts = [f"# {resolved_title(meta)}"] if resolved_title(meta) else []
    for label, field in (("By ", "author"), ("Published ", "published_time"), ("Updated ", "modified_time")):
        if meta.get(field):
            parts.append(label + (display_date(meta[field]) if field != "author" else meta[field]))
    return "\n\n".join(parts)


def best_candidate(candidates: list[str]) -> str:
    """The longest in bytes after trimming; the earliest of equals."""
    return max(candidates, key=lambda c: len(c.strip().encode("utf-8", "surrogatepass")), default="")


def content_html(html: str, url: str, extractor: str, include: list[str] | None, exclude: list[str] | None, css: str | None, compat: bool = False) -> str:
    """Main content. ``auto`` is the scoring extractor with the selector tiers where that gives nothing; filters hold for all."""
    if extractor not in EXTRACTORS:
        raise ValueError(f"unknown extractor {extractor!r}")
    if extractor == "legacy" or not compat and (include or exclude or css):
        cleaned = preprocess(html, include, exclude, css)
        if include or css:
            return cleaned
        if extractor == "legacy":
            return main_content(cleaned)
        html = cleaned
    article: Article = readability(html, url)
    if extractor == "auto" and not article.length:
        return main_content(html)
    return article.content


def to_document_markdown(html: str, url: str, body: str, meta: dict[str, str | None]) -> str:
    """Best markdown candidate with header and description."""
    first = markdown(body)
    options = [first]
    if len(first.strip().encode("utf-8", "surrogatepass")) < 300:
        options += [markdown(preprocess(html)), structural(html), plain_text(body)]
    md = best_candidate(options)
    title = resolved_title(meta)
    if title and not re.sub(r"^\s*#*\s*", "", md).startswith(title):
        md = header(meta) + "\n\n" + md
    for d in (meta.get("description"), meta.get("og_description")):
        if d and len(d.encode("utf-8", "surrogatepass")) >= 80:
            if len(md.encode("utf-8", "surrogatepass")) < 1500 and d[:120] not in md and d != title:
                md += "\n\n" + d
            break
    for pattern, by in fixed.REFLOWED:
        md = re.sub(pattern, by, md)
    return md.strip()


def rendering(html: str, url: str, formats: list[str], extractor: str = "auto", include: list[str] | None = None, exclude: list[str] | None = None, css: str | None = None, compat: bool = False) -> dict:
    """The renderings of one page that were asked for; the others are null."""
    out: dict = dict.fromkeys(("markdown", "html", "raw_html", "plain_text", "links", "image_links"))
    meta = metadata(html)
    if {"markdown", "html", "plainText"} & set(formats):
        body = content_html(html, url, extractor, include, exclude, css, compat)
        if "markdown" in formats:
            out["markdown"] = to_document_markdown(html, url, body, meta)
        if "html" in formats:
            title = resolved_title(meta)
            out["html"] = (f"<h1>{title.replace('&', '&amp;').replace('<', '&lt;').replace('>', '&gt;')}</h1>\n" if title and "<h1" not in body else "") + body
        if "plainText" in formats:
            out["plain_text"] = plain_text(body)
    if "rawHtml" in formats:
        out["raw_html"] = html
    if "links" in formats:
        out["links"] = page_links(html, url)
    if "imageLinks" in formats:
        out["image_links"] = page_images(html, url)
    return out | meta


_TEXTS = ("markdown", "html", "raw_html", "plain_text")
SCHEMA = ", ".join(["page_id long", "url string", *(f"{t} string" for t in _TEXTS), "links array<string>", "image_links array<string>", *(f"{f} string" for f in _META_FIELDS)])


def scrape(pages: DataFrame, formats: list[str] | None = None, extractor: str = "auto", include: list[str] | None = None, exclude: list[str] | None = None, css: str | None = None, compat: bool = False) -> DataFrame:
    """pages (page_id, url, html) -> one row a page: the renderings asked for and ten fields of metadata, which need no tree.

    Formats that aren't asked for are null and cost nothing. Null html counts as empty. Where pages have ``raw`` and
    ``content_type``, a PDF's text is its markdown and plain text.
    """
    from webloom.operators.pdf import pdf_info, pdf_text

    wanted = parse_formats(formats)
    with_raw = {"raw", "content_type"} <= set(pages.columns)

    def one(html: str, url: str, raw: bytes | None) -> dict:
        if raw is None:
            return rendering(html, url, wanted, extractor, include, exclude, css, compat)
        text = pdf_text(raw)
        return dict.fromkeys((*_TEXTS, "links", "image_links", *_META_FIELDS)) | {"markdown": text if "markdown" in wanted else None, "plain_text": text if "plainText" in wanted else None, "title": pdf_info(raw)[1]}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raws = part.column("raw").to_pylist()
                rows = [one(h or "", u or "", raw) for h, u, raw in zip(part.column("html").to_pylist(), part.column("url").to_pylist(), raws, strict=True)]
                texts = [pa.array([r[t] for r in rows], pa.string()) for t in _TEXTS]
                lists = [pa.array([r[t] for r in rows], pa.list_(pa.string())) for t in ("links", "image_links")]
                metas = [pa.array([r[f] for r in rows], pa.string()) for f in _META_FIELDS]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *texts, *lists, *metas], names=["page_id", "url", *_TEXTS, "links", "image_links", *_META_FIELDS])

    raw = F.when(F.col("content_type") == "application/pdf", F.col("raw")) if with_raw else F.lit(None).cast("binary")
    return spread(pages.select("page_id", "url", "html", raw.alias("raw"))).mapInArrow(run, SCHEMA)


#: Tables of fewer bytes a core than this are dealt out before Python works on them.
SPREAD_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table are dealt over all cores before Python works on them; a large one has splits enough and stays as it is.

    Judged by the plan's estimate of size alone: nothing runs.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPREAD_BYTES else rows


def _per_page(pages: DataFrame, schema: str, one, keep: tuple[str, ...] = ()) -> DataFrame:
    """``one`` (html, url) -> the fields of ``schema`` after page_id; string columns ``keep`` go along."""
    schema = ", ".join([schema, *(f"{c} string" for c in keep)])

    def run(batches):
        for batch in batches:
            rows = [one(h or "", u or "") for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True)]
            target = pa.schema(_fields)
            columns = [batch.column("page_id"), *(pa.array([r[k] for r in rows], target.field(k + 1).type) for k in range(len(target) - 1 - len(keep)))]
            columns += [batch.column(c).cast(target.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    _fields = list(to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema))
    return spread(pages.select("page_id", "url", "html", *keep)).mapInArrow(run, schema)


def page_metadata(pages: DataFrame, given: tuple[str, ...] = ()) -> DataFrame:
    """Ten fields a page. Those named in ``given`` are columns of ``pages`` already and go along as they are."""
    read = tuple(f for f in _META_FIELDS if f not in given)

    def one(h: str, u: str):
        found = metadata(h)
        return tuple(found[f] for f in read)

    return _per_page(pages, ", ".join(["page_id long", *(f"{f} string" for f in read)]), one, given).select("page_id", *_META_FIELDS)


def page_text(pages: DataFrame) -> DataFrame:
    return _per_page(pages, "page_id long, plain_text string", lambda h, u: (plain_text(h),))


def page_readable(pages: DataFrame) -> DataFrame:
    return _per_page(pages, "page_id long, readable boolean", lambda h, u: (is_readable(h),))


def page_article(pages: DataFrame) -> DataFrame:
    def one(h: str, u: str):
        a = readability(h, u)
        return a.title, a.byline, a.excerpt, a.content, a.length

    return _per_page(pages, "page_id long, title string, byline string, excerpt string, content string, length long", one)


def selected(pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, n, first_html) of the elements that a CSS selector matches."""

    def one(h: str, u: str):
        found = select(parse(h), selector)
        return len(found), serialize(found[0]) if found else None

    return _per_page(pages, "page_id long, n long, first_html string", one)


def best_renderings(rows: DataFrame, key: str, options: list[str]) -> DataFrame:
    """(key, pick): the number of the longest option in bytes, trimmed, from 0; the first of equals. As :func:`best_candidate`, JVM-side."""
    sizes = [F.octet_length(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")) for c in options]
    best = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-i).alias("i")) for i, n in enumerate(sizes))))
    return rows.select(key, (-best["i"]).cast("long").alias("pick"))


def noise_flags(rows: DataFrame, key: str, names: str, role: str) -> DataFrame:
    """(key, noise): whether class and id, or the role, mark a wrapper of noise. As :func:`is_noise_wrapper`, JVM-side."""
    own, kind = F.coalesce(F.col(names), F.lit("")), F.lower(F.coalesce(F.col(role), F.lit("")))
    words = F.split(own, r"(?U)[\s\x1c-\x1f]+")
    phrase = any_of(F.contains(own, F.lit(p)) for p in fixed.NOISE_PHRASES)
    word = F.exists(words, lambda w: w.isin(*fixed.NOISE_TOKENS) | any_of(F.startswith(w, F.lit(p)) for p in fixed.NOISE_PREFIXES))
    return rows.select(key, (phrase | word | kind.isin(*fixed.NOISE_ROLES)).alias("noise"))


def candidate_scores(pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, boost, score) of the first element that a selector matches, as a candidate for the main content."""

    def one(h: str, u: str):
        found = select(parse(h), selector)
        if not found:
            return None, None
        n = found[0]
        return boost(n.names, n.attrs.get("role", "")), candidate_score(n)

    return _per_page(pages, "page_id long, boost double, score double", one)


def page_brand_links(pages: DataFrame) -> DataFrame:
    """(page_id, links): for each keyword the first anchor that has it."""
    return _per_page(pages, "page_id long, links map<string,string>", lambda h, u: (list(brand_links(parse(h), _domain(u)).items()),))


# Brand.


def _domain(url: str) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url)
    return re.sub(r"^www\.", "", m[1].lower()) if m else ""


def _format(url: str, kind: str) -> str:
    ext = re.search(r"\.[^./]*$", url)
    return fixed.IMAGE_EXTENSIONS.get(ext[0].lower() if ext else "") or fixed.IMAGE_TYPES.get(kind, "unknown")


def logos(doc: Node, url: str) -> list[dict]:
    out: dict[str, dict] = {}
    for n in doc.elements("link"):
        rel, href = n.attrs.get("rel", "").lower().split(), n.attrs.get("href", "")
        if not href or "mask-icon" in rel or not {"icon", "apple-touch-icon", "apple-touch-icon-precomposed"} & set(rel):
            continue
        where = resolve(url, href)
        if where and where not in out:
            sizes = [int(w) for w, x, h in (p.partition("x") for p in n.attrs.get("sizes", "").split()) if x and re.fullmatch(r"[+-]?[0-9]+", w) and "x" not in h]
            out[where] = {"url": where, "format": _format(where, n.attrs.get("type", "")), "sizes": sizes}
    found = list(out.values())
    icon = f"https://{_domain(url)}/favicon.ico"
    if (not found or len(found) == 1 and found[0]["format"] == "ico") and icon not in out:
        found.append({"url": icon, "format": "ico", "sizes": []})
    return found


def _social(href: str) -> tuple[str, str] | None:
    low = href.lower()
    if any(x in low for x in fixed.SOCIAL_EXCLUDED):
        return None
    full = "https:" + href if href.startswith("//") else href if "://" in href else "https://" + href
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", full)
    if not m or not m[1]:
        return None
    host, path = re.sub(r"^www\.", "", m[1].lower()), re.sub(r"/$", "", m[2])
    for kind, hosts, patterns, excluded in fixed.SOCIAL_PLATFORMS:
        if not any(host == h or host.endswith("." + h) for h in hosts):
            continue
        for p in patterns:
            hit = re.search(p, path)
            if hit:
                groups = [g for g in hit.groups() if g]
                if len(hit.groups()) > 1:
                    groups[0] = groups[0].lower()
                account = "/".join(groups)
                if account.lower() not in excluded:
                    return kind, f"https://{hosts[0]}/{account}"
                break
    return None


def socials(doc: Node) -> list[dict]:
    out: dict[str, dict] = {}
    for n in select(doc, ", ".join(fixed.SOCIAL_SELECTORS)):
        hit = _social(n.attrs.get("href", "").strip()) if n.attrs.get("href", "").strip() else None
        if hit and hit[1] not in out:
            out[hit[1]] = {"type": hit[0], "url": hit[1]}
    return list(out.values())


def brand_links(doc: Node, domain: str) -> dict[str, str]:
    """The first anchor of each keyword, in text or href."""
    out: dict[str, str] = {}
    for a in doc.elements("a"):
        href, hay = a.attrs.get("href", ""), a.content().lower() + "\n" + a.attrs.get("href", "").lower()
        for w in fixed.BRAND_LINK_WORDS:
            if w not in out and w in hay and href:
                out[w] = href if re.match("https?://", href) else "https:" + href if href.startswith("//") else f"https://{domain}/{href.lstrip('/')}"
    return out


def brand_of(html: str, url: str, names: list | None = None) -> tuple:
    doc = parse(html)
    metas = doc.elements("meta")
    first = lambda test: next((m.attrs.get("content", "") for m in metas if test(m) and m.attrs.get("content")), "")
    title = first(lambda m: m.attrs.get("property") in ("og:title", "og:site_name"))
    if not title:
        node = next((t for t in doc.elements("title") if t.content()), None)
        title = node.content() if node else ""
    description = first(lambda m: m.attrs.get("property") == "og:description" or m.attrs.get("name") == "description")
    root = doc.first("html")
    language = (root.attrs.get("lang", "") if root else "") or first(lambda m: m.attrs.get("http-equiv", "").lower() == "content-language")
    css = "\n".join(s.content() for s in doc.elements("style"))
    colors = [c for c in dict.fromkeys(x.lower() for x in re.findall("#[0-9a-fA-F]{3,8}", css)) if len(c) in (4, 7, 9)] or ["#000000"]
    image = first(lambda m: m.attrs.get("property") == "og:image")
    domain = _domain(url)
    text = doc.content()
    address = None
    if any(w in text.lower() for w in fixed.ADDRESS_WORDS):
        found = {n: (m[1].strip() if (m := re.search(p, text)) else "") for n, p in fixed.ADDRESS_FIELDS}
        address = found if found["city"] or found["country"] else None
    return (
        domain, title.strip(), description.strip(), (language.split("-")[0] or "english"), colors, [nearest(c, names or named_points()) for c in colors], logos(doc, url),
        [resolve(url, image) or image] if image else [], socials(doc), brand_links(doc, domain), address,
    )


BRAND_SCHEMA = (
    "page_id long, domain string, title string, description string, language string, colors array<string>, color_names array<string>, "
    "logos array<struct<url:string,format:string,sizes:array<int>>>, backdrops array<string>, socials array<struct<type:string,url:string>>, "
    "links map<string,string>, address struct<city:string,country:string,postal_code:string,state_province:string>"
)


def brand(pages: DataFrame, names: dict[str, str] | None = None, tokens: DataFrame | None = None) -> DataFrame:  # noqa: F811
    """One row a page of brand facts. ``tokens`` (page_id, colors) adds colours read elsewhere, after the page's own.

    ``names`` (hex -> name) is the table of colour names that ``color_names`` come from, as
    :func:`webloom.sources.readers.color_names` reads it; the built-in one is short.
    """
    from webloom.functions.color import merged_colors

    points = named_points(names)
    out = _per_page(pages, BRAND_SCHEMA, lambda h, u: tuple(list(v.items()) if isinstance(v, dict) and k == 9 else v for k, v in enumerate(brand_of(h, u, points))))
    if tokens is not None:
        more = tokens.select(F.col("page_id"), F.col("colors").alias("_more"))
        out = out.join(more, "page_id", "left").withColumn("colors", merged_colors("colors", "_more")).drop("_more")
    return out
