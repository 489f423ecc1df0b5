"""DuckDB twins of the queries, over views named like the tables."""

from __future__ import annotations

from webloom.functions import fixed
from webloom.functions.pattern import compiled, valid
from webloom.functions.url import AUTHORITY, PARTS, PRIVATE_V4, PRIVATE_V6, SAFE_PATH, SAFE_QUERY
from webloom.plans import fixtures as fx
from webloom.plans import queries as q

ORACLES: dict[str, str] = {}
_s = fx.quoted


def has(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {_s(n)})" for n in needles) + ")"


def rep(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {_s(pattern)}, {_s(by)}, 'g')"


def chain(x: str, *steps) -> str:
    for s in steps:
        x = rep(x, *s) if isinstance(s, tuple) else rep(x, s)
    return x


def digest(x: str) -> str:
    return f"md5({x})"


# Building blocks.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
host = lambda u: f"lower(regexp_extract({u}, {_s(HOST)}, 1))"
origin = lambda u: f"lower(regexp_extract({u}, {_s('^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)')}, 1))"
path = lambda u: f"regexp_extract({u}, {_s('^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)')}, 1)"
norm = lambda u: f"lower(regexp_replace(split_part({u}, '#', 1), '/$', ''))"
strip = lambda x: chain(x, fixed.SCRIPT_BLOCK, fixed.STYLE_BLOCK)
body = lambda low: strip(f"regexp_extract({low}, {_s(fixed.BODY)}, 1)")
visible = lambda x: chain(x, fixed.ANY_TAG, (r"[ \t\n\r]+", " "))
body_bytes = lambda low: f"CASE WHEN NOT contains({low}, '<body') THEN 1000 ELSE strlen({visible(body(low))}) END"


def unescape(x: str) -> str:
    for a, b in fixed.ENTITIES:
        x = f"replace({x}, {_s(a)}, {_s(b)})"
    return x


def escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = f"replace({x}, {_s(a)}, {_s(b)})"
    return x


STATUS_SQL = "SELECT *, CASE page_id % 10 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END AS status FROM {}"
MARKED = "(SELECT page_id, url, (CASE page_id % {n} {whens} END) || html AS html FROM pages)".format(
    n=len(fx.MARKERS), whens=" ".join(f"WHEN {i} THEN {_s(m)}" for i, m in enumerate(fx.MARKERS))
)

_n = body_bytes("low")
needs_js = (
    f"(({_n}) < 200 AND {has('low', fixed.SPA_MARKERS)}) OR (contains(low, '<noscript>') AND contains(low, 'enable javascript')) "
    f"OR (({_n}) < 500 AND {has('low', fixed.BUILDER_MARKERS)}) OR (({_n}) < 1000 AND (len(regexp_extract_all(low, '<script')) >= 5 OR {has('low', fixed.STORYBOOK_MARKERS)}))"
)
thin = f"({body_bytes('html')}) < 200"
weak = " + ".join(f"contains(low, {_s(m)})::INT" for m in fixed.CF_WEAK)
challenge = f"(strlen(html) <= 80000 AND ({has('low', fixed.CF_STRONG)} OR ({weak}) >= 2))"
wall = f"(strlen(html) <= 80000 AND strlen({visible(body('low'))}) <= 600 AND {has(visible(body('low')), fixed.WALL_PHRASES)})"


def vendor_case() -> str:
    whens = []
    for name, groups in fixed.VENDOR_MARKERS:
        test = " OR ".join("(" + " AND ".join(f"contains(lhead, {_s(m)})" for m in g) + ")" for g in groups)
        if name == "akamai":
            test += f" OR regexp_matches(head, {_s(fixed.AKAMAI_REFERENCE)})"
        whens.append(f"WHEN {test} THEN {_s(name)}")
    return f"CASE WHEN strlen(html) > 200000 THEN '' {' '.join(whens)} ELSE '' END"


#: DuckDB cuts by characters; no stored page reaches a byte limit inside its first 15 000 characters' markers.
def heads(source: str) -> str:
    return f"(SELECT *, lower(html) AS low, html AS head, lower(html) AS lhead FROM {source})"


escalation = (
    f"CASE WHEN {needs_js} THEN 'SPA shell detected' WHEN status IN {fixed.SOFT_BLOCK_STATUS} THEN 'soft-block status HTTP ' || status "
    f"WHEN status BETWEEN 200 AND 299 AND {thin} THEN 'thin HTML content' WHEN status BETWEEN 200 AND 299 AND {challenge} THEN 'Cloudflare challenge detected' "
    f"WHEN status BETWEEN 200 AND 299 AND {wall} THEN 'generic anti-bot wall detected' "
    f"WHEN status BETWEEN 200 AND 299 AND ({vendor_case()}) <> '' THEN 'anti-bot vendor block: ' || ({vendor_case()}) ELSE '' END"
)
_staged = heads(f"({STATUS_SQL.format('pages')})")
ORACLES["page_body_bytes"] = f"SELECT page_id, CAST({body_bytes('lower(html)')} AS BIGINT) AS body_bytes FROM pages"
ORACLES["page_escalation"] = f"SELECT page_id, {escalation} AS reason FROM {_staged}"
ORACLES["escalation_by_host"] = f"SELECT {host('url')} AS host, {escalation} AS reason, count(*) AS n FROM {_staged} GROUP BY 1, 2"
ORACLES["fetch_plan"] = f"SELECT reason, count(*) AS n FROM (SELECT {escalation} AS reason FROM {_staged}) WHERE reason <> '' GROUP BY 1"
ORACLES["page_vendor_block"] = f"SELECT page_id, {vendor_case()} AS vendor FROM {heads(MARKED)}"
ORACLES["page_challenge"] = f"SELECT page_id, CAST({weak} AS BIGINT) AS weak_hits, {challenge} AS challenge, {has('low', fixed.ANTI_BOT_MARKERS)} AS anti_bot FROM {heads(MARKED)}"
ORACLES["page_flags"] = f"SELECT page_id, ({needs_js}) AS needs_js, {thin} AS thin, {wall} AS bot_wall FROM {heads(MARKED)}"
_blocked = has("low", ("just a moment", "attention required", "cf-browser-verification", "cf-challenge", "captcha", "access denied"))
ORACLES["page_warning"] = (
    f"SELECT page_id, CASE WHEN status >= 400 THEN rtrim(decode(encode(trim(html))[1:100]), chr(65533)) WHEN {_blocked} THEN 'blocked by anti-bot protection' END AS warning "
    f"FROM (SELECT *, lower(html) AS low FROM ({STATUS_SQL.format(MARKED)}))"
).replace("rtrim(decode(encode(trim(html))[1:100]), chr(65533))", "left(trim(html), list_max(list_filter(range(0, 101), lambda k: strlen(left(trim(html), k)) <= 100)))")
ORACLES["soft_failure"] = f"SELECT page_id, (status >= 400 AND strlen({visible(body('lower(html)'))}) < 200) AS failed FROM ({STATUS_SQL.format('pages')})"
_text = "CASE status " + " ".join(f"WHEN {k} THEN {_s(v)}" for k, v in fixed.STATUS_TEXT.items()) + " ELSE 'Error' END"
ORACLES["status_rules"] = f"SELECT status, {_text} AS text, status IN {fixed.SOFT_BLOCK_STATUS} AS soft_block, status BETWEEN 502 AND 504 AS retriable FROM {fx.values(fx.STATUS, 'status')}"
_never = has("message", ("certificate has expired", "x509", "certificate is valid for"))
_again = has("message", ("connection refused", "timeout", "deadline exceeded", "no such host", "temporary failure", "i/o timeout", "tls handshake", "EOF", "connection reset"))
ORACLES["error_rules"] = f"SELECT id, (NOT {_never} AND {_again}) AS retriable, {has('message', ('connection refused', 'no such host'))} AS unreachable FROM {fx.values(fx.ERRORS, 'id, message')}"
ORACLES["fetch_routes"] = (
    "SELECT id, CASE WHEN m = 'browser' THEN 'browser' WHEN m IN ('', 'auto') AND reason <> '' THEN 'browser' ELSE 'http' END AS route "
    f"FROM (SELECT *, lower(trim(coalesce(mode, ''))) AS m FROM {fx.values(fx.MODES, 'id, mode, reason')})"
)

# URLs.
ORACLES["url_normalize_dedup"] = f"SELECT {norm('url')} AS norm, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1"
ORACLES["url_parts"] = f"SELECT page_id, {host('url')} AS host, {origin('url')} AS origin, {path('url')} AS path, regexp_replace({host('url')}, '^www\\.', '') AS domain FROM pages"
_binary = lambda u: "(" + " OR ".join(f"ends_with(lower({path(u)}), {_s(x)})" for x in fixed.BINARY_SUFFIXES) + ")"
_h = host("url")
ORACLES["url_safety"] = (
    f"SELECT id, {_h} AS host, (strlen(url) <= 2048 AND NOT contains(url, '%00') AND regexp_matches(url, '^(?i:https?)://') AND {_h} <> '' AND {_h} <> 'localhost' "
    f"AND NOT ends_with({_h}, '.localhost') AND NOT regexp_matches({_h}, {_s(PRIVATE_V4)}) AND NOT regexp_matches({_h}, {_s(PRIVATE_V6)})) AS safe, "
    f"{_binary('url')} AS binary, regexp_matches(url, {_s(fixed.EXCLUDED_SCHEME)}) AS excluded FROM {fx.values(fx.URLS, 'id, url')}"
)
_ct = "lower(trim(split_part(ct, ';', 1)))"
ORACLES["content_types"] = (
    f"SELECT id, c AS clean, (NOT (starts_with(c, 'text/') OR c IN {fixed.TEXT_TYPES} OR c = '') AND ({' OR '.join(f'starts_with(c, {_s(p)})' for p in fixed.BINARY_FAMILIES)} "
    f"OR c IN {fixed.BINARY_TYPES})) AS binary, c = 'application/pdf' AS pdf FROM (SELECT id, {_ct} AS c FROM {fx.values(fx.CONTENT_TYPES, 'id, ct')})"
)
_key = lambda u: f"'page:' || sha256({u} || '|markdown|auto|v3')"
ORACLES["cache_keys"] = f"SELECT page_id, {_key('url')} AS key FROM pages"
ORACLES["brand_resolved"] = (
    f"SELECT page_id, src, CASE WHEN src = '' THEN '' WHEN regexp_matches(src, '^https?://') THEN src WHEN starts_with(src, '//') THEN 'https:' || src "
    f"ELSE {origin('url')} || replace(replace(CASE WHEN starts_with(src, '/') THEN src ELSE '/' || src END, '?', '%3F'), '#', '%23') END AS abs_url "
    "FROM (SELECT page_id, url, unnest(['/logo.png', 'a?b#c', '//cdn.example.com/x', 'https://example.com/y']) AS src FROM pages)"
)


def matched(x: str, p: str) -> str:
    kind, v = compiled(p)
    return f"lower({x}) = {_s(v)}" if kind == "exact" else f"regexp_matches({x}, {_s(v)})"


_any = lambda custom: "(" + " OR ".join(matched("url", p) for p in valid((*fixed.BLOCKED_PATTERNS, *custom))) + ")"
ORACLES["blocklist_kept"] = f"SELECT page_id, url FROM pages WHERE NOT {_any(('*.example.net/*',))}"
ORACLES["blocklist_blocked"] = f"SELECT page_id, url FROM pages WHERE {_any(('*.example.net/*', '~/en/[0-9]+$'))}"
ORACLES["pattern_rules"] = f"SELECT id, CASE id {' '.join(f'WHEN {i} THEN {matched(chr(120), p)}' for i, p, _, _ in fx.PATTERNS)} END AS matched FROM {fx.values(fx.PATTERNS, 'id, pattern, x, expected')}"

# Links.
_hrefs = lambda h: f"list_filter(list_transform(regexp_extract_all({h}, {_s(fixed.ANCHOR_HREF)}, 1), lambda h: {unescape('trim(h)')}), lambda h: h <> '')"
_anchors = (
    f"(SELECT page_id, url, ord, raw FROM (SELECT page_id, url, unnest(l) AS raw, unnest(range(len(l))) AS ord FROM (SELECT page_id, url, {_hrefs('html')} AS l FROM pages)) "
    f"WHERE NOT regexp_matches(raw, {_s(fixed.EXCLUDED_SCHEME)}))"
)
ORACLES["links_raw"] = f"SELECT page_id, CAST(ord AS INT) AS ord, raw FROM {_anchors}"
ORACLES["links_per_page"] = f"SELECT page_id, count(*) AS n, count(DISTINCT raw) AS n_distinct FROM {_anchors} GROUP BY 1"
ORACLES["links_rooted"] = (
    f"SELECT page_id, CAST(min(ord) AS INT) AS ord, abs_url FROM (SELECT page_id, ord, {origin('url')} || raw AS abs_url FROM {_anchors} WHERE raw LIKE '/%' AND raw NOT LIKE '//%') GROUP BY page_id, abs_url"
)
ORACLES["top_anchor_targets"] = f"SELECT raw, count(*) AS n FROM {_anchors} GROUP BY 1 ORDER BY n DESC, raw LIMIT 20"
_bare = lambda t: f"list_concat(regexp_extract_all({t}, {_s(fixed.HTTP_URL)}), list_transform(regexp_extract_all({t}, {_s(fixed.WWW_URL)}), lambda w: 'https://' || w))"
ORACLES["bare_urls"] = (
    f"SELECT doc_id, array_to_string({_bare('t')}, ' ') AS urls FROM (SELECT doc_id, text || ' see http://www.example.com/a?b=1, and WWW.example.org)' || doc_id AS t FROM documents)"
)


def _coded(x: str, safe: str) -> str:
    runs = f"regexp_extract_all({x}, {_s(f'[{safe}]+|[^{safe}]+')})"
    return f"array_to_string(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, {_s(f'^[{safe}]')}) THEN r ELSE url_encode(r) END), '')"


def _resolved(rows: str, key: str) -> str:
    """(key, ord, x): the rows' ``raw`` against their ``url``, step by step; those that can't be read left out."""
    parts = lambda c, p: ", ".join(f"regexp_extract({c}, {_s(PARTS)}, {k}) AS {p}{k}" for k in range(1, 6))
    starts = lambda c: f"regexp_matches({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//')"
    fold = "list_reduce(string_split(substr(p, 2), '/'), lambda d, s: CASE WHEN s = '.' THEN d WHEN s = '..' THEN d[:-2] ELSE list_append(d, s) END, []::VARCHAR[])"
    dotted = "regexp_matches(p, '(?:^|/)[.][.]?(?:/|$)')"
    undotted = f"CASE WHEN {dotted} THEN '/' || array_to_string({fold}, '/') || CASE WHEN len({fold}) > 0 AND regexp_matches(p, '/[.][.]?$') THEN '/' ELSE '' END ELSE p END"
    a = f"SELECT *, {parts('raw', 'h')}, {parts('url', 'b')}, {starts('raw')} AS hosted, {starts('url')} AS based FROM ({rows}) WHERE NOT regexp_matches(raw, '[\\x00-\\x1f\\x7f]')"
    b = "SELECT *, hosted OR h1 <> '' AS own, CASE WHEN hosted OR h1 <> '' OR h3 LIKE '/%' THEN h3 WHEN h3 = '' THEN b3 ELSE regexp_extract(b3, '^(.*/)?', 1) || h3 END AS j FROM a"
    c = "SELECT *, CASE WHEN j = '' OR j LIKE '/%' OR h1 <> '' AND NOT hosted THEN j ELSE '/' || j END AS p, CASE WHEN own THEN h2 ELSE b2 END AS host, CASE WHEN NOT own AND h3 = '' AND h4 = '' THEN b4 ELSE h4 END AS q FROM b"
    d = f"SELECT *, CASE WHEN h1 <> '' AND NOT hosted THEN p ELSE {undotted} END AS u, regexp_extract(host, {_s(AUTHORITY)}, 1) AS port FROM c WHERE regexp_matches(host, {_s(AUTHORITY)})"
    e = (
        f"SELECT {key}, ord, CASE WHEN h1 <> '' THEN lower(h1) || ':' WHEN b1 <> '' THEN lower(b1) || ':' ELSE '' END || CASE WHEN hosted OR NOT own AND based THEN '//' || host ELSE '' END || {_coded('u', SAFE_PATH)} "
        f"|| CASE WHEN regexp_matches(q, '[^\\x00-\\x7f]') THEN {_coded('q', SAFE_QUERY)} ELSE q END || CASE WHEN h5 = '#' THEN '' ELSE {_coded('h5', SAFE_QUERY + '#')} END AS x FROM d "
        "WHERE len(port) <= 5 AND coalesce(TRY_CAST(port AS INT), 0) <= 65535 AND NOT regexp_matches(h3, '%(?:[^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)')"
    )
    return f"(WITH a AS ({a}), b AS ({b}), c AS ({c}), d AS ({d}) {e})"


_found = lambda l: f"SELECT page_id, url, unnest(l) AS raw, unnest(range(len(l))) AS ord FROM (SELECT page_id, url, {l} AS l FROM pages)"
_links_of = f"SELECT * FROM ({_found(f'list_concat({_hrefs("html")}, {_bare("html")})')}) WHERE NOT regexp_matches(raw, {_s(fixed.EXCLUDED_SCHEME)})"
_sources = f"list_filter(list_transform(regexp_extract_all(html, {_s(fixed.IMAGE_SRC)}, 1), lambda h: {unescape('trim(h)')}), lambda h: h <> '' AND NOT regexp_matches(h, '^(?:data:|blob:)'))"
ORACLES["extract_links"] = (
    "SELECT page_id, coalesce(l, '') AS links, CAST(coalesce(n, 0) AS INT) AS n_images FROM pages "
    f"LEFT JOIN (SELECT page_id, string_agg(x, chr(10) ORDER BY o) AS l FROM (SELECT page_id, x, min(ord) AS o FROM {_resolved(_links_of, 'page_id')} WHERE x <> '' GROUP BY 1, 2) GROUP BY 1) USING (page_id) "
    f"LEFT JOIN (SELECT page_id, count(DISTINCT x) AS n FROM {_resolved(_found(_sources), 'page_id')} WHERE x <> '' GROUP BY 1) USING (page_id)"
)
ORACLES["images_raw"] = (
    f"SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(html, {_s(fixed.IMAGE_SRC)}, 1), lambda h: {unescape('trim(h)')}), "
    f"lambda h: h <> '' AND NOT regexp_matches(h, '^(?:data:|blob:)')), ' ') AS images FROM {fx.values(fx.IMG_PAGES, 'id, html')}"
)
ORACLES["ordered_union"] = (
    "SELECT page_id, coalesce(string_agg(x, chr(10) ORDER BY o), '') AS links FROM (SELECT page_id, x, min(o) AS o FROM (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS o "
    f"FROM (SELECT page_id, list_concat({_hrefs('html')}, {_bare('html')}) AS l FROM pages)) GROUP BY 1, 2) GROUP BY 1 "
    f"UNION ALL SELECT page_id, '' FROM pages WHERE len(list_concat({_hrefs('html')}, {_bare('html')})) = 0"
)

# Markup and markdown.
_ext = lambda p: f"nullif(regexp_extract(html, {_s(p)}, 1), '')"
ORACLES["title_lang"] = f"SELECT page_id, trim({unescape(_ext(fixed.TITLE))}) AS title, trim({_ext(fixed.HTML_LANG)}) AS lang FROM pages"
_clean = chain("html", *fixed.NOISE_STEPS)
ORACLES["clean_noise"] = f"SELECT page_id, {digest(_clean)} AS digest, CAST(strlen({_clean}) AS INT) AS n_bytes FROM pages"
_stripped = chain(
    "html", fixed.IMG_TAG, (fixed.ANCHOR_PAIR, "\\1"), fixed.ANCHOR_OPEN, fixed.EMPTY_BOX, fixed.EMPTY_BOX, fixed.EMPTY_BOX, (fixed.BLANKS, " "), (fixed.BLANK_LINES, "\n\n"),
    r"^[\t\n\f\r ]+|[\t\n\f\r ]+$",
)
ORACLES["strip_links_images"] = f"SELECT page_id, {digest(_stripped)} AS digest FROM pages"
ORACLES["entities"] = f"SELECT page_id, {digest(unescape('html'))} AS plain, {digest(escape('html'))} AS escaped FROM pages"
_MD = (
    "(SELECT doc_id, '¶ [¶](#x) ![](/) ![a]() ![b](data:x) ![c](http://i/x.png) [link text](http://example.com/p) § 1' || chr(10) || text AS md FROM documents)"
)
_post = chain("md", *fixed.MARKDOWN_STEPS)
_unlinked = rep("md", fixed.MARKDOWN_LINK, "\\1")
ORACLES["markdown_postprocess"] = f"SELECT doc_id, {digest(_post)} AS digest, left({_post}, 40) AS head FROM {_MD}"
ORACLES["markdown_links"] = (
    f"SELECT doc_id, {digest(_unlinked)} AS unlinked, {digest(rep('md', fixed.MARKDOWN_STEPS[-1]))} AS no_images, {digest(f'lower(md || chr(10) || {_unlinked})')} AS searchable FROM {_MD}"
)
_TRIM = r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$"
_lines = lambda x, n: f"list_filter(list_transform(string_split({x}, chr(10)), lambda p: {rep('p', _TRIM)}), lambda p: length(p) > {n})"
ORACLES["phrase_split"] = f"SELECT doc_id, CAST(len({_lines('text', 20)}) AS BIGINT) AS n20, CAST(len({_lines('text', 10)}) AS BIGINT) AS n10 FROM documents"
ORACLES["headings_dropped"] = (
    "SELECT doc_id, md5(array_to_string(list_filter(string_split('# Title' || chr(10) || text || chr(10) || '# End', chr(10)), lambda l: NOT starts_with(l, '# ')), chr(10))) AS digest FROM documents"
)
ORACLES["titles_resolved"] = f"SELECT id, CASE WHEN coalesce(og, '') <> '' THEN trim(regexp_extract(og, {_s('(?s)^(.+?)(?:[|–—-]|$)')}, 1)) ELSE title END AS title FROM {fx.values(fx.TITLES, 'id, og, title')}"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"
ORACLES["dates_displayed"] = (
    f"SELECT id, CASE WHEN regexp_matches(iso, {_s(_ISO)}) THEN strftime(CAST(left(iso, 19) AS TIMESTAMP) - CASE WHEN ends_with(iso, 'Z') THEN INTERVAL 0 MINUTE ELSE to_minutes(CAST(left(right(iso, 6), 1) || '1' AS INT) * (CAST(substr(right(iso, 6), 2, 2) AS INT) * 60 + CAST(right(iso, 2) AS INT))) END, '%d %b %Y, %H:%M UTC') ELSE iso END AS shown FROM {fx.values(fx.DATES, 'id, iso')}"
)
ORACLES["description_appended"] = (
    "SELECT doc_id, md5(CASE WHEN strlen(d) >= 80 AND strlen(text) < 1500 AND NOT contains(text, left(d, 120)) THEN text || chr(10) || chr(10) || d ELSE text END) AS digest "
    "FROM (SELECT doc_id, text, left(text, 60) || ' and then a description that goes on for long enough to count' AS d FROM documents)"
)
ORACLES["header_prepended"] = (
    r"SELECT doc_id, md5(CASE WHEN starts_with(ltrim(regexp_replace(text, '^[\t\n\f\r ]*#*[\t\n\f\r ]*', '', 'g')), source) THEN text "
    "ELSE '# ' || source || chr(10) || chr(10) || 'By ' || lang || chr(10) || chr(10) || 'Published 05 Mar 2024, 14:07 UTC' || chr(10) || chr(10) || text END) AS digest FROM documents"
)
_NL = "' || chr(10) || '"
ORACLES["documents_formatted"] = (
    f"SELECT doc_id, md5('<!DOCTYPE html>{_NL}<html>{_NL}<head>{_NL}  <meta charset=\"utf-8\">{_NL}  <title>' || {escape('source')} || '</title>{_NL}  <meta name=\"description\" content=\"' || "
    f"replace({escape('lang')}, '\"', '&quot;') || '\">{_NL}</head>{_NL}<body>{_NL}' || regexp_replace(text, '(?m)^([^\\n])', '  \\1', 'g') || '{_NL}</body>{_NL}</html>{_NL}') AS digest FROM documents"
)

# Tokens and ranking.
toks = lambda x: f"list_filter(regexp_split_to_array(lower({x}), {_s(fixed.TOKEN_BREAK)}), lambda t: t <> '')"
ORACLES["document_lengths"] = f"SELECT lang, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS avg_tokens FROM (SELECT lang, len({toks('text')}) AS n FROM documents) GROUP BY 1"
_tf = lambda w, t: f"len(list_filter({w}, lambda x: x = {_s(t)}))"
ORACLES["term_frequencies"] = f"SELECT doc_id, CAST({_tf('w', 'the')} AS BIGINT) AS tf_the, CAST({_tf('w', 'de')} AS BIGINT) AS tf_de FROM (SELECT doc_id, {toks('text')} AS w FROM documents)"


def bm25(source: str, keys: str, terms: list[str], by_documents: bool) -> str:
    unique = sorted(set(terms))
    cols = ", ".join(f"{_tf('t', x)} AS t{k}, {_tf('s', x)} AS s{k}" for k, x in enumerate(unique))
    if by_documents:
        dfs = ", ".join(f"sum((t{k} > 0 OR s{k} > 0)::INT) AS df{k}" for k in range(len(unique)))
    else:
        dfs = ", ".join(f"max((t{k} > 0)::INT) + max((s{k} > 0)::INT) AS df{k}" for k in range(len(unique)))
    k1, b = fixed.BM25_K1, fixed.BM25_B
    field = lambda f, k, w: f"CASE WHEN {f}{k} > 0 AND {f}avg > 0 THEN {w} * ({f}{k} * {k1 + 1}::DOUBLE / ({f}{k} + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * ({f}dl / {f}avg)))) ELSE 0 END"
    score = " + ".join(
        f"CASE WHEN df{k} > 0 THEN ln((n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE) + 1.0) * ({field('t', k, '2.0::DOUBLE')} + {field('s', k, '1.0::DOUBLE')}) ELSE 0 END" for k in (unique.index(x) for x in terms)
    )
    return (
        f"WITH w AS (SELECT {keys}, {toks('title')} AS t, {toks('snippet')} AS s FROM {source}), c AS (SELECT {keys}, len(t) AS tdl, len(s) AS sdl, {cols} FROM w), "
        f"g AS (SELECT count(*) AS n, avg(tdl) AS tavg, avg(sdl) AS savg, {dfs} FROM c) SELECT {keys}, round(({score})::DOUBLE, 6) AS score FROM c, g"
    )


_RANKED = "(SELECT doc_id, left(text, 60) AS title, substr(text, 61) AS snippet FROM documents)"
_TERMS = ["the", "and", "of", "que", "the"]
ORACLES["bm25f_field_df"] = bm25(_RANKED, "doc_id", _TERMS, False)
ORACLES["bm25f_doc_df"] = bm25(_RANKED, "doc_id", _TERMS, True)
ORACLES["bm25f_topk"] = f"SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS position, doc_id, score FROM ({bm25(_RANKED, 'doc_id', _TERMS, True)}) ORDER BY score DESC, doc_id LIMIT 10"
ORACLES["conversation_search"] = bm25("(SELECT conv_id, turn, role AS title, text AS snippet FROM conversations)", "conv_id, turn", ["user", "the"], True)
ORACLES["published_dates"] = f"SELECT id, coalesce(nullif(a, ''), nullif(b, '')) AS published FROM {fx.values(fx.HITS, 'id, a, b')}"

# Evaluation.
_EVAL = (
    "(SELECT CAST(doc_id AS VARCHAR) AS url, quality = 1 AS ok, text AS markdown, left(text, 30) || chr(10) || 'this phrase is not in the text at all' || chr(10) || substr(text, 40, 35) AS truth, "
    "CASE WHEN toxic = 1 THEN substr(text, 10, 20) ELSE 'nowhere to be found' END AS lie, CASE WHEN quality <> 1 THEN 'failed in ' || source END AS reason FROM documents JOIN labels USING (doc_id))"
)
_SCORED = (
    "(SELECT url, ok, reason, len(tr) AS n_expected, len(list_filter(tr, lambda p: contains(tx, p))) AS n_found, len(li) AS n_forbidden, len(list_filter(li, lambda p: contains(tx, p))) AS n_leaked FROM "
    f"(SELECT url, ok, reason, CASE WHEN markdown = '' THEN '' ELSE lower(markdown || chr(10) || {rep('markdown', fixed.MARKDOWN_LINK, chr(92) + '1')}) END AS tx, "
    f"list_transform({_lines('truth', 20)}, lambda p: lower(p)) AS tr, list_transform({_lines('lie', 10)}, lambda p: lower(p)) AS li FROM {_EVAL}))"
)
_JUDGED = f"(SELECT *, n_expected > 0 AS has_truth, n_expected > 0 AND n_found / n_expected >= 0.3 AS enough_found, n_forbidden > 0 AND n_leaked / n_forbidden >= 0.5 AS leaked FROM {_SCORED})"
ORACLES["eval_rows"] = f"SELECT url, n_expected, n_found, n_forbidden, n_leaked, has_truth, enough_found, leaked FROM {_JUDGED}"
_rate = lambda a, b: f"CASE WHEN {b} > 0 THEN round(100.0::DOUBLE * {a} / {b}, 2) ELSE 0.0::DOUBLE END"
ORACLES["eval_summary"] = (
    "SELECT *, " + ", ".join(f"{_rate(a, b)} AS {n}" for n, a, b in (
        ("success_rate", "succeeded", "total_urls"), ("match_rate", "matched", "with_truth"), ("match_rate_overall", "matched", "succeeded"), ("clean_rate", "(succeeded - leaked_urls)", "succeeded")))
    + " FROM (SELECT count(*) AS total_urls, CAST(sum(ok::INT) AS BIGINT) AS succeeded, CAST(sum((NOT ok)::INT) AS BIGINT) AS failed, CAST(sum((ok AND has_truth)::INT) AS BIGINT) AS with_truth, "
    "CAST(sum((ok AND has_truth AND enough_found)::INT) AS BIGINT) AS matched, CAST(sum((ok AND leaked)::INT) AS BIGINT) AS leaked_urls, "
    f"CAST(coalesce(sum(n_expected) FILTER (ok AND has_truth), 0) AS BIGINT) AS phrases_expected, CAST(coalesce(sum(n_found) FILTER (ok AND has_truth), 0) AS BIGINT) AS phrases_found FROM {_JUDGED})"
)
ORACLES["failure_top10"] = f"SELECT coalesce(nullif(left(coalesce(reason, ''), 40), ''), 'unknown') AS label, count(*) AS n FROM {_EVAL} WHERE NOT ok GROUP BY 1 ORDER BY n DESC, label LIMIT 10"
ORACLES["latency_percentiles"] = (
    "SELECT round(avg(value), 1) AS avg_ms, " + ", ".join(f"round(quantile_cont(value, {v}), 1) AS {n}" for n, v in (("p50_ms", 0.5), ("p90_ms", 0.9), ("p95_ms", 0.95), ("p99_ms", 0.99))) + ", count(value) AS n FROM events"
)
ORACLES["phrase_hits"] = "SELECT b.item_id, (SELECT count(*) FROM documents d WHERE contains(d.text, b.text)) AS n_docs FROM benchmark b"
ORACLES["spacing_medians"] = (
    "SELECT bucket, round(list_sort(list(value))[CAST(count(*) // 2 + 1 AS INT)], 6) AS median, count(*) AS n FROM "
    "(SELECT CASE WHEN value <= 8 THEN 8 WHEN value <= 16 THEN 16 WHEN value <= 32 THEN 32 WHEN value <= 64 THEN 64 ELSE 999 END AS bucket, value FROM events) GROUP BY 1"
)

# Colours and brand facts.
_six = lambda h: f"CASE WHEN length(regexp_replace(upper({h}), '^#', '')) IN (3, 4) THEN " + " || ".join(f"repeat(substr(regexp_replace(upper({h}), '^#', ''), {i}, 1), 2)" for i in (1, 2, 3)) + f" ELSE substr(regexp_replace(upper({h}), '^#', ''), 1, 6) END"
_byte = lambda h, at: f"(CASE WHEN length(substr({h}, {at}, 2)) = 0 THEN NULL ELSE CAST('0x' || substr({h}, {at}, 2) AS INT) END)"
_RGB = lambda src, keep: f"(SELECT {keep}, six, {_byte('six', 1)} AS r, {_byte('six', 3)} AS g, {_byte('six', 5)} AS b FROM {src})"


def hsl(src: str) -> str:
    return (
        "(SELECT *, CAST(floor((CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE (CASE WHEN hi = rf THEN (gf - bf) / (hi - lo) + CASE WHEN gf < bf THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END "
        "WHEN hi = gf THEN (bf - rf) / (hi - lo) + 2.0::DOUBLE ELSE (rf - gf) / (hi - lo) + 4.0::DOUBLE END) / 6.0::DOUBLE END) * 360) AS INT) AS h, "
        "CAST(floor((CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2.0::DOUBLE - hi - lo) ELSE (hi - lo) / (hi + lo) END) * 100) AS INT) AS s, "
        "CAST(floor(((hi + lo) / 2) * 100) AS INT) AS l FROM (SELECT *, greatest(rf, gf, bf) AS hi, least(rf, gf, bf) AS lo FROM "
        f"(SELECT *, r::DOUBLE / 255.0::DOUBLE AS rf, g::DOUBLE / 255.0::DOUBLE AS gf, b::DOUBLE / 255.0::DOUBLE AS bf FROM {src})))"
    )


ORACLES["color_math"] = (
    "SELECT id, six, (starts_with(hex, '#') AND length(hex) IN (4, 7, 9)) AS valid, r, g, b, h, s, l, (r * 299 + g * 587 + b * 114) / 1000 < 128 AS dark FROM "
    + hsl(_RGB(f"(SELECT id, hex, {_six('hex')} AS six FROM {fx.values(fx.COLORS, 'id, hex')})", "id, hex"))
)
_NAMES = hsl(_RGB("(SELECT name, name_hex AS six FROM " + fx.values(sorted(fixed.COLOR_NAMES.items()), "name_hex, name") + ")", "name"))
_ORDER_HEX = "upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6))"
ORACLES["nearest_color"] = (
    f"SELECT o.o_orderkey, c.color_name, c.color_distance FROM orders o JOIN (SELECT six, arg_min(name, row(d, name)) AS color_name, min(d) AS color_distance FROM (SELECT a.six, n.name, "
    "CAST((a.r - n.r) ** 2 + (a.g - n.g) ** 2 + (a.b - n.b) ** 2 + 2 * ((a.h - n.h) ** 2 + (a.s - n.s) ** 2 + (a.l - n.l) ** 2) AS BIGINT) AS d FROM "
    + hsl(_RGB(f"(SELECT DISTINCT {_ORDER_HEX} AS six, 0 AS k FROM orders)", "k"))
    + f" a, {_NAMES} n) GROUP BY six) c ON c.six = {_ORDER_HEX.replace('o_orderkey', 'o.o_orderkey')}"
)
ORACLES["css_colors"] = "SELECT p_partkey, '#fff,#' || substr(md5(p_name), 1, 6) AS colors FROM part"


def social() -> str:
    full = "CASE WHEN starts_with(trim(href), '//') THEN 'https:' || trim(href) WHEN NOT contains(trim(href), '://') THEN 'https://' || trim(href) ELSE trim(href) END"
    whens_type, whens_url = [], []
    for kind, hosts, patterns, excluded in fixed.SOCIAL_PLATFORMS:
        here = "(" + " OR ".join(f"h = {_s(x)} OR ends_with(h, {_s('.' + x)})" for x in hosts) + ")"
        cases = []
        for p in patterns:
            n = p.count("(") - p.count("(?")
            get = lambda g, p=p: f"regexp_extract(p, {_s(p)}, {g})"
            text = get(1) if n == 1 else f"lower({get(1)})" + "".join(f" || CASE WHEN {get(g)} <> '' THEN '/' || {get(g)} ELSE '' END" for g in range(2, n + 1))
            cases.append(f"WHEN regexp_matches(p, {_s(p)}) THEN {text}")
        account = f"(CASE {' '.join(cases)} ELSE '' END)"
        if excluded:
            account = f"(CASE WHEN lower({account}) IN ({', '.join(map(_s, excluded))}) THEN '' ELSE {account} END)"
        whens_type.append(f"WHEN {here} AND {account} <> '' THEN {_s(kind)}")
        whens_url.append(f"WHEN {here} AND {account} <> '' THEN {_s('https://' + hosts[0] + '/')} || {account}")
    keep = f"NOT {has('lower(href)', fixed.SOCIAL_EXCLUDED)}"
    inner = f"(SELECT id, href, regexp_replace({host('f')}, '^www\\.', '') AS h, regexp_replace({path('f')}, '/$', '') AS p FROM (SELECT id, href, {full} AS f FROM {fx.values(fx.HREFS, 'id, href')}))"
    return f"SELECT id, CASE WHEN {keep} THEN CASE {' '.join(whens_type)} END END AS type, CASE WHEN {keep} THEN CASE {' '.join(whens_url)} END END AS url FROM {inner}"


ORACLES["social_accounts"] = social()
_fmt = "CASE " + " ".join(f"WHEN lower(regexp_extract(url, {_s('([.][^./]*)$')}, 1)) = {_s(k)} THEN {_s(v)}" for k, v in fixed.IMAGE_EXTENSIONS.items()) + " " + " ".join(f"WHEN ct = {_s(k)} THEN {_s(v)}" for k, v in fixed.IMAGE_TYPES.items()) + " ELSE 'unknown' END"
ORACLES["image_formats"] = f"SELECT id, {_fmt} AS format FROM {fx.values(fx.IMAGES, 'id, url, ct')}"
ORACLES["icon_sizes"] = (
    "SELECT id, array_to_string(list_transform(list_filter(string_split(sizes, ' '), lambda p: regexp_matches(p, '^[+-]?[0-9]+x[^x]*$')), lambda p: split_part(p, 'x', 1)), ',') AS widths "
    "FROM (VALUES (1, '16x16 32x32'), (2, 'any'), (3, ''), (4, '48x48 axb 64x'), (5, '180x180')) AS t(id, sizes)"
)
_addr = {n: f"trim(regexp_extract(text, {_s(p)}, 1))" for n, p in fixed.ADDRESS_FIELDS}
_addr_ok = f"({has('lower(text)', fixed.ADDRESS_WORDS)} AND ({_addr['city']} <> '' OR {_addr['country']} <> ''))"
ORACLES["addresses"] = "SELECT id, " + ", ".join(f"CASE WHEN {_addr_ok} THEN {v} END AS {n}" for n, v in _addr.items()) + f" FROM {fx.values(fx.ADDRESSES, 'id, text')}"
ORACLES["noise_wrappers"] = (
    f"SELECT id, ({has('names', fixed.NOISE_PHRASES)} OR len(list_filter(string_split(names, ' '), lambda w: w IN {fixed.NOISE_TOKENS} OR starts_with(w, 'ad-') OR starts_with(w, 'ads-'))) > 0 "
    f"OR lower(role) IN {fixed.NOISE_ROLES}) AS noise FROM {fx.values(fx.WRAPPERS, 'id, names, role')}"
)

# Requests.
_REQ = "(SELECT event_id, user_id || ':' || event_type AS key, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_s, event_id % 4 * 86400 AS ttl_s, event_type, user_id FROM events)"
ORACLES["cache_hit_join"] = (
    f"SELECT r.event_id, max(c.at_s) IS NOT NULL AS hit, max(c.at_s) AS cached_at FROM {_REQ} r LEFT JOIN (SELECT key, at_s FROM {_REQ} WHERE event_type = 'view' AND event_id % 2 = 0) c "
    "ON r.key = c.key AND r.ttl_s > 0 AND r.at_s - c.at_s BETWEEN 0 AND r.ttl_s GROUP BY r.event_id"
)
ORACLES["job_latest_state"] = "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, count(*) AS n_events FROM events GROUP BY 1"
ORACLES["jobs_evicted"] = (
    f"SELECT event_id, status FROM (SELECT event_id, at_s, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM {_REQ}) WHERE status <> 'running' AND 1706000000 - at_s > 86400"
)
ORACLES["pacing"] = (
    "SELECT event_id, lead + i * 60000 AS start_ms, lead + i * 60000 - at_ms AS wait_ms FROM (SELECT *, max(at_ms - i * 60000) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS lead FROM "
    f"(SELECT event_id, user_id, at_s * 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY at_s * 1000, event_id) - 1 AS i FROM {_REQ}))"
)
ORACLES["idle_sessions"] = (
    "SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM "
    "(SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY 1"
)
ORACLES["props_json_field"] = "SELECT event_id, event_type AS name, '' AS props FROM events"

# Traversal.
_EDGE_ROWS = fx.values(fx.edges(), "src, dst, ord")
_CAND = (
    f"(SELECT {norm('src')} AS a, {norm('dst')} AS b FROM {_EDGE_ROWS} WHERE regexp_matches(dst, '^https?://') AND {origin('dst')} = {origin('src')} AND NOT {_binary('dst')})"
)


def bfs(depth: int) -> str:
    return (
        f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT a, b FROM {_CAND}), w(norm, depth) AS (SELECT {_s(q.SEED)}, 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.norm WHERE w.depth < {depth}), "
        "f AS (SELECT norm, min(depth) AS depth FROM w GROUP BY 1) "
    )


ORACLES["crawl_bfs"] = bfs(4) + "SELECT norm, depth FROM f"
ORACLES["map_urls"] = bfs(3) + f"SELECT norm AS url FROM f WHERE norm <> {_s(q.SEED)}"
ORACLES["robots_gate"] = f"SELECT page_id, NOT starts_with({path('url')}, '/fr/') AS robots_allowed FROM pages"
ORACLES["sitemap_locations"] = "SELECT * FROM (VALUES ('https://example.com/sitemap.xml', 0, 'https://example.com/a?x=1&y=2'), ('https://example.com/sitemap.xml', 1, 'https://example.com/b')) AS t(source, ord, loc)"
ORACLES["selector_counts"] = f"SELECT page_id, count(*) AS n FROM {_anchors} WHERE starts_with(raw, '/') GROUP BY 1"

# Operators that run in Python workers, over inputs that SQL can read as well.
_unlinked = rep("text", fixed.MARKDOWN_LINK, chr(92) + "1")
ORACLES["best_candidate"] = (
    "SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS pick FROM "
    f"(SELECT doc_id, strlen({rep(_unlinked, '^' + chr(92) + 's+|' + chr(92) + 's+$')}) AS a, strlen({rep('text', '^' + chr(92) + 's+|' + chr(92) + 's+$')}) AS b, "
    "strlen(trim(substr(text, 2, 50) || ' and a little more', ' ' || chr(10))) AS c FROM documents)"
)
ORACLES["search_with_content"] = (
    "SELECT row_number() OVER (ORDER BY page_id) AS position, h.url, CAST(p.n AS VARCHAR) AS markdown FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '?gone' ELSE url END AS url FROM pages ORDER BY page_id LIMIT 50) h "
    "LEFT JOIN (SELECT url, max(strlen(html)) AS n FROM pages GROUP BY 1) p ON h.url = p.url"
)
ORACLES["search_reranked"] = f"SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS position, doc_id FROM ({bm25(_RANKED, 'doc_id', _TERMS, True)})"
ORACLES["usage_share"] = (
    "SELECT user_id AS page_id, event_type AS family, CAST(round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY user_id)) AS BIGINT) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)"
)
_DOMAIN = f"regexp_replace({host('url')}, '^www\\.', '')"
ORACLES["brand_keywords"] = (
    f"WITH p AS (SELECT page_id, {_DOMAIN} AS d FROM pages) SELECT page_id, 'blog' AS word, 'https://' || d || '/blog-posts' AS target FROM p UNION ALL SELECT page_id, 'pricing', 'https://x.example.com/p' FROM p "
    "UNION ALL SELECT page_id, 'contact', 'https://y.example.com/contact' FROM p UNION ALL SELECT page_id, 'careers', 'https://' || d || '/careers/' FROM p WHERE page_id % 2 = 0"
)
_count = lambda x, words: " + ".join(f"CAST(contains({x}, {_s(w)}) AS INT)" for w in words)
ORACLES["content_scores"] = (
    "WITH p AS (SELECT page_id, substr(regexp_replace(html, '[^A-Za-z ]', '', 'g'), 40, 40 + page_id % 900) AS w, "
    f"{[*fx.CANDIDATE_NAMES]}[page_id % {len(fx.CANDIDATE_NAMES)} + 1] || ' ' AS names FROM pages), "
    f"b AS (SELECT *, greatest(0.25::DOUBLE, 1.0::DOUBLE + 0.25::DOUBLE * ({_count('names', fixed.CONTENT_HINTS)}) - 0.35::DOUBLE * ({_count('names', fixed.NOISE_PHRASES)})) AS f, "
    "CAST(strlen(ltrim(w || 'linked words', ' ')) AS DOUBLE) AS t, CAST(strlen(w) + 26 AS DOUBLE) AS h FROM p) "
    "SELECT page_id, round(f, 6) AS boost, round(CASE WHEN t < 50 OR h < 80 THEN 0.0::DOUBLE ELSE t * pow(t / h, 2) * (1 - least(12 / t, 0.85::DOUBLE)) * f * CASE WHEN t > 500 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END END, 6) AS score FROM b"
)
ORACLES["cache_totals"] = f"SELECT count(DISTINCT {_key('key')}) AS n_keys, count(*) AS n_writes FROM {_REQ} WHERE event_type <> 'error'"
ORACLES["crawl_counters"] = bfs(5) + "SELECT count(*) AS total, least(50, count(*)) AS completed, 'completed' AS status FROM f"
ORACLES["stored_crawl"] = (
    f"WITH p AS (SELECT url, html FROM pages ORDER BY page_id LIMIT 1), l AS (SELECT DISTINCT lower(regexp_replace(split_part(h, '#', 1), '/$', '')) AS n FROM (SELECT unnest({_hrefs('html')}) AS h FROM p)) "
    "SELECT 0 AS depth, 1 AS n UNION ALL SELECT 1, count(*) FROM l"
)
ORACLES["lists_reflowed"] = "SELECT doc_id, " + digest(chain("""'["a":' || chr(10) || chr(10) || ' [1], ("b"),' || chr(10) || '["c",' || chr(10) || ' D' || replace(text, '.', '",')""", *fixed.REFLOWED)) + " AS digest FROM documents"
ORACLES["request_options"] = (
    "SELECT id, CASE WHEN coalesce(f, '') = '' THEN 'markdown' ELSE array_to_string(list_sort(string_split(f, ',')), ',') END AS formats, "
    f"CASE lower(s) WHEN 'strict' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END AS level FROM {fx.values(fx.OPTIONS, 'id, f, s')}"
)
_meta = lambda *cases: "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases) + " END"
_ID = lambda text: f"replace({_s(text)}, 'ID', CAST(page_id AS VARCHAR))"
ORACLES["extract_metadata"] = (
    "SELECT t.page_id, t.title, t.lang AS language, "
    + ", ".join(
        f"{_meta(*((k, _ID(v)) for k, v in cases))} AS {name}"
        for name, cases in {
            "description": [(1, "d ID")], "og_title": [(1, "T ID")], "og_description": [(3, "od ID")], "og_image": [(3, "i.png")], "canonical_url": [(2, "/c/ID")],
            "author": [(2, "A ID"), (4, "B ID")], "published_time": [(3, "P ID"), (4, "2024-01-ID")], "modified_time": [(3, "M & ID"), (4, "N ID")],
        }.items()
    )
    + f" FROM ({ORACLES['title_lang']}) t"
)
ORACLES["rate_limited"] = (
    "WITH RECURSIVE e AS (SELECT event_id, user_id, at_s, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS i FROM " + _REQ + "), "
    "s AS (SELECT user_id, event_id, i, true AS allowed, [at_s] AS live FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, at_s) ELSE kept END FROM "
    "(SELECT e.*, list_filter(s.live, lambda x: e.at_s - x < 86400) AS kept FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)) SELECT event_id, allowed FROM s"
)
ORACLES["rate_limited_minute"] = (
    "WITH RECURSIVE e AS (SELECT event_id, event_type, at_s, row_number() OVER (PARTITION BY event_type ORDER BY at_s, event_id) AS i FROM (SELECT event_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_s FROM events)), "
    "s AS (SELECT event_type, event_id, i, true AS allowed, [at_s] AS live FROM e WHERE i = 1 UNION ALL SELECT event_type, event_id, i, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, at_s) ELSE kept END FROM "
    "(SELECT e.*, list_filter(s.live, lambda x: e.at_s - x < 60) AS kept FROM s JOIN e ON e.event_type = s.event_type AND e.i = s.i + 1)) SELECT event_id, allowed FROM s"
)


def bm25_batch(k: int) -> str:
    """Every document scored for every item that shares a term with it; the k best of each item."""
    part = lambda f, w: f"CASE WHEN {f}tf > 0 AND {f}avg > 0 THEN {w}::DOUBLE * ({f}tf * {fixed.BM25_K1 + 1}::DOUBLE / ({f}tf + {fixed.BM25_K1}::DOUBLE * (1 - {fixed.BM25_B}::DOUBLE + {fixed.BM25_B}::DOUBLE * ({f}dl / {f}avg)))) ELSE 0 END"
    return (
        f"WITH d AS (SELECT doc_id, {toks('title')} AS t, {toks('snippet')} AS s FROM {_RANKED}), g AS (SELECT count(*) AS n, avg(len(t)) AS tavg, avg(len(s)) AS savg FROM d), "
        "x AS (SELECT doc_id, len(t) AS tdl, len(s) AS sdl, unnest(t) AS term, 1 AS a, 0 AS b FROM d UNION ALL SELECT doc_id, len(t), len(s), unnest(s), 0, 1 FROM d), "
        "p AS (SELECT doc_id, term, tdl, sdl, sum(a) AS ttf, sum(b) AS stf FROM x GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), "
        f"q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({toks('text')}) AS term FROM benchmark) GROUP BY 1, 2), "
        f"r AS (SELECT item_id, doc_id, round(sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0) * ({part('t', fixed.TITLE_WEIGHT)} + {part('s', fixed.SNIPPET_WEIGHT)})), 6) AS score "
        "FROM q JOIN f USING (term) JOIN p USING (term), g GROUP BY 1, 2) "
        f"SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS position, doc_id, score FROM r QUALIFY position <= {k}"
    )


ORACLES["bm25f_batch"] = bm25_batch(10)
ORACLES["cache_state"] = (
    "WITH o AS (SELECT CASE WHEN event_type IN ('view', 'purchase') THEN 'set' WHEN event_type = 'click' THEN 'delete' WHEN event_type = 'error' THEN 'flush' WHEN event_id % 500 = 0 THEN 'flush_all' ELSE 'set' END AS op, user_id || ':' || event_id % 5 AS key, "
    "'https://example.com/u' || user_id % 64 AS url, props AS data, event_id % 40 * 43200 AS ttl_s, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_s, event_id AS seq FROM events) "
    f"SELECT key, url, data, ttl_s, at_s, seq FROM o WHERE op = 'set' AND at_s <= {q.CACHE_NOW} AND at_s + CASE WHEN ttl_s > 0 THEN ttl_s ELSE 86400 END > {q.CACHE_NOW} "
    f"AND NOT EXISTS (SELECT 1 FROM o x WHERE x.at_s <= {q.CACHE_NOW} AND (x.at_s > o.at_s OR x.at_s = o.at_s AND x.seq > o.seq) AND (x.op IN ('set', 'delete') AND x.key = o.key OR x.op = 'flush' AND x.url = o.url OR x.op = 'flush_all'))"
)
_JOB_TTL = 2 * 86400
_JOB_WALK = (
    "WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t, seq) AS i FROM (SELECT user_id AS job, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, event_id AS seq, "
    "CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'delete' ELSE 'update' END AS op, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status FROM events)), "
    "s AS (SELECT job, t, seq, i, CASE WHEN op = 'start' THEN t END AS created, CASE WHEN op = 'start' THEN 'in_progress' ELSE 'unknown' END AS state FROM e WHERE i = 1 UNION ALL "
    "SELECT e.job, e.t, e.seq, e.i, CASE WHEN op = 'start' THEN e.t ELSE created END, CASE WHEN op = 'start' THEN 'in_progress' WHEN created IS NULL THEN 'unknown' "
    f"WHEN s.state IN ('gone', 'deleted') OR s.state IN ('completed', 'failed') AND greatest(s.t, created + {_JOB_TTL}) <= e.t THEN 'gone' WHEN op = 'delete' THEN 'deleted' ELSE status END "
    "FROM s JOIN e ON e.job = s.job AND e.i = s.i + 1)"
)
ORACLES["job_states"] = f"{_JOB_WALK} SELECT seq AS event_id, job, created, state FROM s"
_JOBS = (
    f"(SELECT job, created, state AS status, t AS updated FROM (SELECT * FROM s WHERE t <= {q.JOBS_NOW} QUALIFY row_number() OVER (PARTITION BY job ORDER BY t DESC, seq DESC) = 1) "
    f"WHERE state NOT IN ('unknown', 'gone', 'deleted') AND NOT (state IN ('completed', 'failed') AND greatest(t, created + {_JOB_TTL}) <= {q.JOBS_NOW}))"
)
ORACLES["job_registry"] = f"{_JOB_WALK} SELECT * FROM {_JOBS}"
ORACLES["job_health"] = f"{_JOB_WALK} SELECT count(*) AS jobs, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("in_progress", "completed", "failed")) + f" FROM {_JOBS}"
_norm = lambda x: f"lower(regexp_replace(split_part({x}, '#', 1), '/$', ''))"
_above = lambda x: f"regexp_replace({x}, '[^/?#]+/?([?#].*)?$', '')"


def site_crawl(starts: str, room: int) -> str:
    """Three levels from each site's starts, level by level; each adds its first URLs by norm while there is room."""
    out = (
        f"WITH l AS (SELECT DISTINCT p.url AS src, {origin('p.url')} || raw AS dst FROM {_anchors} JOIN pages p USING (page_id) WHERE raw LIKE '/%' AND raw NOT LIKE '//%'), "
        f"a AS (SELECT dst AS src, {_above('dst')} AS dst FROM l WHERE {path(_above('dst'))} <> ''), b AS (SELECT dst AS src, {_above('dst')} AS dst FROM a WHERE {path(_above('dst'))} <> ''), "
        f"e AS MATERIALIZED (SELECT DISTINCT {origin('dst')} AS seed, {_norm('src')} AS parent, {_norm('dst')} AS norm FROM (SELECT * FROM l UNION SELECT * FROM a UNION SELECT * FROM b) WHERE {origin('src')} = {origin('dst')}), "
        f"v0 AS MATERIALIZED (SELECT DISTINCT seed, {_norm('url')} AS norm, 0 AS depth FROM ({starts}))"
    )
    for d in (1, 2, 3):
        out += (
            f", n{d} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY norm) AS r FROM (SELECT DISTINCT e.seed, e.norm FROM v{d - 1} v JOIN e ON e.seed = v.seed AND e.parent = v.norm WHERE v.depth = {d - 1}) x "
            f"WHERE NOT EXISTS (SELECT 1 FROM v{d - 1} v WHERE v.seed = x.seed AND v.norm = x.norm)), "
            f"v{d} AS MATERIALIZED (SELECT * FROM v{d - 1} UNION ALL SELECT seed, norm, {d} FROM n{d} WHERE r <= {room} - (SELECT count(*) FROM v{d - 1} v WHERE v.seed = n{d}.seed))"
        )
    return out


ORACLES["crawl_hosts"] = site_crawl(f"SELECT {origin('url')} AS seed, url FROM pages", 30) + " SELECT seed, norm, depth FROM v3"
ORACLES["crawl_states"] = site_crawl(f"SELECT {origin('url')} AS seed, min(url) AS url FROM pages GROUP BY 1", 5000) + (
    f" SELECT seed, count(*) AS total, count(*) FILTER (r <= 100 AND EXISTS (SELECT 1 FROM pages p WHERE {_norm('p.url')} = norm)) AS completed, 'completed' AS status FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, norm) AS r FROM v3) GROUP BY seed"
)
ORACLES["latency_by_type"] = (
    "SELECT event_type, round(avg(value), 1) AS avg_ms, " + ", ".join(f"round(quantile_cont(value, {v}), 1) AS {n}" for n, v in (("p50_ms", 0.5), ("p90_ms", 0.9), ("p95_ms", 0.95), ("p99_ms", 0.99))) + ", count(value) AS n FROM events GROUP BY 1 HAVING count(value) > 0"
)
ORACLES["page_sizes_by_host"] = f"SELECT host, count(*) AS n, round(quantile_cont(b, 0.5), 4) AS p50, round(quantile_cont(b, 0.9), 4) AS p90 FROM (SELECT {host('url')} AS host, strlen(html)::DOUBLE AS b FROM pages) GROUP BY 1"
ORACLES["events_logged"] = "SELECT event_id, user_id, event_type FROM events"
