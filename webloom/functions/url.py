"""URL functions: normalising, parts, safety, cache keys."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.base import any_of, bound, col

#: Addresses that must not be fetched: loopback, private, link-local, unspecified, shared.
PRIVATE_V4 = r"^(?:127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)[0-9.]*$"
PRIVATE_V6 = r"^\[(?:::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*)\]$"


def normalize_url(url: Column | str) -> Column:
    """Without fragment and one trailing slash, all in lower case."""
    return F.lower(F.regexp_replace(F.substring_index(col(url), "#", 1), "/$", ""))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def origin(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain(url: Column | str) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def same_origin(a: Column | str, b: Column | str) -> Column:
    return origin(a) == origin(b)


def is_safe_url(url: Column | str) -> Column:
    """http(s), at most 2048 bytes, no NUL, a public host."""
    u, h = col(url), host(url)
    return (
        (F.octet_length(u) <= 2048)
        & ~F.contains(u, F.lit("\x00"))
        & ~F.contains(u, F.lit("%00"))
        & u.rlike(r"^(?i:https?)://")
        & (h != "")
        & (h != "localhost")
        & ~F.endswith(h, F.lit(".localhost"))
        & ~h.rlike(PRIVATE_V4)
        & ~h.rlike(PRIVATE_V6)
    )


def is_excluded_scheme(href: Column | str) -> Column:
    return col(href).rlike(fixed.EXCLUDED_SCHEME)


def is_binary_path(url: Column | str) -> Column:
    p = F.lower(path(url))
    return any_of(F.endswith(p, F.lit(s)) for s in fixed.BINARY_SUFFIXES)


def clean_content_type(raw: Column | str) -> Column:
    return F.lower(F.trim(F.substring_index(col(raw), ";", 1)))


def is_binary_content_type(content_type: Column | str) -> Column:
    ct = F.lower(F.trim(col(content_type)))
    text = F.startswith(ct, F.lit("text/")) | ct.isin(*fixed.TEXT_TYPES) | (ct == "")
    return ~text & (any_of(F.startswith(ct, F.lit(p)) for p in fixed.BINARY_FAMILIES) | ct.isin(*fixed.BINARY_TYPES))


def is_pdf_content_type(content_type: Column | str) -> Column:
    return col(content_type) == "application/pdf"


def status_text(code: Column | str) -> Column:
    out = F.lit("Error")
    for k, v in fixed.STATUS_TEXT.items():
        out = F.when(col(code) == k, v).otherwise(out)
    return out


def cache_key(url: Column | str, formats: Column | str, mode: Column | str, *more: Column | str, prefix: str = "page:", version: str = "v3") -> Column:
    """Key of a rendering: every parameter that changes the result takes part."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", col(url), col(formats), col(mode), *(col(m) for m in more), F.lit(version)), 256))


def normalize_formats(formats: Column | str) -> Column:
    """Sorted; markdown where none is asked for."""
    f = col(formats)
    return F.when(f.isNull() | (F.size(f) == 0), F.array(F.lit("markdown"))).otherwise(F.array_sort(f))


def safesearch_level(name: Column | str) -> Column:
    n = F.lower(F.trim(col(name)))
    return F.when(n == "strict", 2).when(n == "moderate", 1).when(n == "off", 0).otherwise(0)


def brand_resolve(src: Column | str, base: Column | str) -> Column:
    """Absolute URLs stay, ``//x`` becomes https, anything else is a path of the base's origin."""
    s = col(src)
    rooted = F.when(F.startswith(s, F.lit("/")), s).otherwise(F.concat(F.lit("/"), s))
    escaped = F.replace(F.replace(rooted, F.lit("?"), F.lit("%3F")), F.lit("#"), F.lit("%23"))
    return (
        F.when(s == "", "")
        .when(s.rlike("^https?://"), s)
        .when(F.startswith(s, F.lit("//")), F.concat(F.lit("https:"), s))
        .otherwise(F.concat(origin(base), escaped))
    )


#: Scheme, authority, path, query and fragment of a reference; the last two with their mark.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: An authority that can be read; the port is judged besides.
AUTHORITY = r"^(?:[^@]*@)?(?:\[[^\[\]]*\]|[^\[\]:@ ]*)(?::([0-9]*))?$"
#: Characters that stay as they are in a path, and in a query or fragment; others become percent-encoded UTF-8.
SAFE_PATH, SAFE_QUERY = r"A-Za-z0-9/%:@!$&'()*+,;=~\-._", r"A-Za-z0-9/%:@!$&'()*+,;=~\-._?\[\]\"<>^`{|}\\"
_BAD_ESCAPE, CONTROL, _DOTS = "%(?![0-9A-Fa-f]{2})", r"[\x00-\x1f\x7f]", r"(?:^|/)\.\.?(?:/|$)"


def encoded(x: Column, safe: str) -> Column:
    """``x`` with every character outside the class ``safe`` percent-encoded, run by run."""
    runs = F.regexp_extract_all(x, F.lit(f"[{safe}]+|[^{safe}]+"), F.lit(0))
    coded = F.transform(runs, lambda r: F.when(r.rlike(f"^[{safe}]"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))))
    return F.when(x.rlike(f"[^{safe}]"), F.array_join(coded, "")).otherwise(x)


def without_dots(path_: Column) -> Column:
    """A rooted path without its ``.`` and ``..`` segments, folded from the left; ``..`` at the root is dropped."""
    parent = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, s: F.when(s == ".", done).when(s == "..", parent(done)).otherwise(F.concat(done, F.array(s)))
    fold = lambda segments: F.struct(F.aggregate(segments, F.array().cast("array<string>"), step).alias("kept"), F.element_at(segments, -1).isin(".", "..").alias("open"))
    shown = lambda t: F.concat(F.lit("/"), F.array_join(t["kept"], "/"), F.when(t["open"] & (F.size(t["kept"]) > 0), "/").otherwise(""))
    return F.when(path_.rlike(_DOTS), bound(bound(F.split(F.substr(path_, F.lit(2)), "/", -1), fold), shown)).otherwise(path_)


def parts(x: Column) -> Column:
    """A reference's scheme, host, path, query and fragment, and whether it names a host."""
    found = (F.regexp_extract(x, PARTS, k).alias(n) for k, n in enumerate(("scheme", "host", "path", "query", "fragment"), 1))
    return F.struct(*found, x.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//").alias("hosted"))


def resolved(base: Column | str, href: Column | str) -> Column:
    """``href`` against ``base`` (RFC 3986), JVM-side; null where it can't be read. As :func:`resolve`.

    Dot segments go, also from absolute references; a scheme without ``//`` is opaque and stays; a base without a path
    counts as its root; bytes that a path may not hold are percent-encoded.
    """
    b, h = F.coalesce(col(base), F.lit("")), col(href)
    readable = ~h.rlike(CONTROL)
    return F.when(readable, bound(F.struct(parts(h).alias("h"), parts(b).alias("b")), lambda t: resolved_parts(t["b"], t["h"])))


def resolved_parts(b: Column, h: Column) -> Column:
    """:func:`resolved` for :func:`parts` of a base and of a reference without control characters."""
    own, opaque = h["hosted"] | (h["scheme"] != ""), (h["scheme"] != "") & ~h["hosted"]
    rooted = lambda p: F.when((p == "") | F.startswith(p, F.lit("/")) | opaque, p).otherwise(F.concat(F.lit("/"), p))
    folder = F.regexp_extract(b["path"], "(?s)^(.*/)?", 1)
    joined = F.when(own | F.startswith(h["path"], F.lit("/")), h["path"]).when(h["path"] == "", b["path"]).otherwise(F.concat(folder, h["path"]))
    steps = F.struct(
        bound(joined, rooted).alias("path"), F.when(own, h["host"]).otherwise(b["host"]).alias("host"), F.lower(F.when(h["scheme"] != "", h["scheme"]).otherwise(b["scheme"])).alias("scheme"),
        F.when(~own & (h["path"] == "") & (h["query"] == ""), b["query"]).otherwise(h["query"]).alias("query"),
    )

    def address(t: Column) -> Column:
        scheme = F.when(t["scheme"] != "", F.concat(t["scheme"], F.lit(":"))).otherwise("")
        authority = F.when(h["hosted"] | ~own & b["hosted"], F.concat(F.lit("//"), t["host"])).otherwise("")
        place = bound(F.when(opaque, t["path"]).otherwise(without_dots(t["path"])), lambda p: encoded(p, SAFE_PATH))
        query = F.when(t["query"].rlike(r"[^\x00-\x7f]"), encoded(t["query"], SAFE_QUERY)).otherwise(t["query"])
        fragment = F.when(h["fragment"] != "#", encoded(h["fragment"], SAFE_QUERY + "#")).otherwise("")
        port = F.regexp_extract(t["host"], AUTHORITY, 1)
        bad = h["path"].rlike(_BAD_ESCAPE) | ~t["host"].rlike(AUTHORITY) | (F.char_length(port) > 5) | F.coalesce(F.when(port != "", port.try_cast("int")) > 65535, F.lit(False))
        return F.when(~bad, F.concat(scheme, authority, place, query, fragment))

    return bound(steps, address)


_PARTS, _AUTHORITY, _UNREADABLE, _DOT_SEGMENT = re.compile(PARTS.removesuffix("$") + r"\Z"), re.compile(AUTHORITY), re.compile(CONTROL), re.compile(_DOTS)
_QUOTED_PATH, _QUOTED_QUERY = "/%:@!$&'()*+,;=~-._", "/%:@!$&'()*+,;=~-._?[]\"<>^`{|}\\"


def resolve(base: str, href: str) -> str | None:
    """:func:`resolved` for one reference, where a page is in a worker's hands already."""
    scheme, host_, path_, query, fragment = _PARTS.match(href).groups()
    base_scheme, base_host, place, base_query, _ = _PARTS.match(base).groups()
    own = scheme is not None or host_ is not None
    authority = _AUTHORITY.match((host_ if own else base_host) or "")
    if _UNREADABLE.search(href) or re.search(_BAD_ESCAPE, path_) or not authority or len(authority[1] or "") > 5 or int(authority[1] or 0) > 65535:
        return None
    if not own and not path_ and query is None:
        query = base_query
    joined = path_ if own or path_.startswith("/") else place[: place.rfind("/") + 1] + path_ if path_ else place
    if scheme is None or host_ is not None:
        joined = "/" + joined if joined and joined[0] != "/" else joined
        if _DOT_SEGMENT.search(joined):
            kept: list[str] = []
            for segment in (segments := joined[1:].split("/")):
                kept = kept[:-1] if segment == ".." else kept if segment == "." else [*kept, segment]
            joined = "/" + "/".join(kept) + ("/" if kept and segments[-1] in (".", "..") else "")
    query = query or ""
    shown, authority_ = (scheme or base_scheme or "").lower(), host_ if own else base_host
    start = (shown + ":" if shown else "") + ("" if authority_ is None else "//" + authority_)
    end = "" if fragment in (None, "#") else quote(fragment, safe=_QUOTED_QUERY + "#")
    return start + quote(joined, safe=_QUOTED_PATH) + (query if query.isascii() else quote(query, safe=_QUOTED_QUERY)) + end
