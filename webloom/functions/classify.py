"""Page classification: script shells, block pages, thin content, and why a page would need a browser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.base import all_of, any_of, col, contains_any, first_bytes
from webloom.functions.html_text import body_html, body_text_bytes, visible_text


def needs_js(html: Column | str) -> Column:
    low = F.lower(first_bytes(col(html), 500_000))
    return _needs_js(low, body_text_bytes(low))


def _needs_js(low: Column, n: Column) -> Column:
    return (
        ((n < 200) & contains_any(low, fixed.SPA_MARKERS))
        | (F.contains(low, F.lit("<noscript>")) & F.contains(low, F.lit("enable javascript")))
        | ((n < 500) & contains_any(low, fixed.BUILDER_MARKERS))
        | ((n < 1000) & ((F.regexp_count(low, F.lit("<script")) >= 5) | contains_any(low, fixed.STORYBOOK_MARKERS)))
    )


def is_thin(html: Column | str) -> Column:
    return body_text_bytes(first_bytes(col(html), 500_000)) < 200


def is_bot_wall(html: Column | str) -> Column:
    text = visible_text(body_html(F.lower(col(html))))
    return (F.octet_length(col(html)) <= 80_000) & (F.octet_length(text) <= 600) & contains_any(text, fixed.WALL_PHRASES)


def vendor_block(html: Column | str) -> Column:
    """The first vendor whose block page this is; empty for none."""
    head = first_bytes(col(html), 15_000)
    low = F.lower(head)
    out = None
    for vendor, groups in fixed.VENDOR_MARKERS:
        test = any_of(all_of(F.contains(low, F.lit(m)) for m in group) for group in groups)
        if vendor == "akamai":
            test = test | head.rlike(fixed.AKAMAI_REFERENCE)
        out = F.when(test, vendor) if out is None else out.when(test, vendor)
    return F.when(F.octet_length(col(html)) > 200_000, "").otherwise(out.otherwise(""))


def cf_weak_hits(html: Column | str) -> Column:
    low = F.lower(col(html))
    return sum(F.contains(low, F.lit(m)).cast("int") for m in fixed.CF_WEAK)


def is_cf_challenge(html: Column | str) -> Column:
    return (F.octet_length(col(html)) <= 80_000) & (contains_any(F.lower(col(html)), fixed.CF_STRONG) | (cf_weak_hits(html) >= 2))


def is_soft_block(status: Column | str) -> Column:
    return col(status).isin(*fixed.SOFT_BLOCK_STATUS)


def is_anti_bot_page(html: Column | str) -> Column:
    return contains_any(F.lower(col(html)), fixed.ANTI_BOT_MARKERS)


def escalation(html: Column | str, status: Column | str) -> Column:
    """Why a page should be fetched with a browser; empty if it needn't be. The tests run in this order and stop at the first."""
    h, s = col(html), col(status)
    ok = s.between(200, 299)
    vendor = vendor_block(h)
    return (
        F.when(needs_js(h), "SPA shell detected")
        .when(is_soft_block(s), F.concat(F.lit("soft-block status HTTP "), s.cast("string")))
        .when(ok & is_thin(h), "thin HTML content")
        .when(ok & is_cf_challenge(h), "Cloudflare challenge detected")
        .when(ok & is_bot_wall(h), "generic anti-bot wall detected")
        .when(ok & (vendor != ""), F.concat(F.lit("anti-bot vendor block: "), vendor))
        .otherwise("")
    )


def with_escalation(pages: DataFrame, html: str = "html", status: str = "status", out: str = "reason") -> DataFrame:
    """``pages`` with :func:`escalation`, the page's text taken out once instead of once a test."""
    small = F.octet_length(html) <= 500_000
    d = pages.withColumn("_low", F.lower(html)).withColumn("_text", visible_text(body_html("_low")))
    n = F.when(~F.contains("_low", F.lit("<body")), F.lit(1000)).otherwise(F.octet_length("_text"))
    d = d.withColumns({"_n": F.when(small, n).otherwise(body_text_bytes(F.lower(first_bytes(col(html), 500_000)))), "_thin": is_thin(html), "_vendor": vendor_block(html)})
    head = F.when(small, F.col("_low")).otherwise(F.lower(first_bytes(col(html), 500_000)))
    ok, s = col(status).between(200, 299), col(status)
    wall = (F.octet_length(html) <= 80_000) & (F.octet_length("_text") <= 600) & contains_any(F.col("_text"), fixed.WALL_PHRASES)
    weak = sum(F.contains("_low", F.lit(m)).cast("int") for m in fixed.CF_WEAK)
    challenge = (F.octet_length(html) <= 80_000) & (contains_any(F.col("_low"), fixed.CF_STRONG) | (weak >= 2))
    reason = (
        F.when(_needs_js(head, F.col("_n")), "SPA shell detected")
        .when(is_soft_block(s), F.concat(F.lit("soft-block status HTTP "), s.cast("string")))
        .when(ok & F.col("_thin"), "thin HTML content")
        .when(ok & challenge, "Cloudflare challenge detected")
        .when(ok & wall, "generic anti-bot wall detected")
        .when(ok & (F.col("_vendor") != ""), F.concat(F.lit("anti-bot vendor block: "), F.col("_vendor")))
        .otherwise("")
    )
    return d.withColumn(out, reason).drop("_low", "_text", "_n", "_thin", "_vendor")


def fetch_warning(html: Column | str, status: Column | str) -> Column:
    """The head of an error page, or a note that a block page came instead of content; null for neither."""
    low = F.lower(col(html))
    blocked = contains_any(low, ("just a moment", "attention required", "cf-browser-verification", "cf-challenge", "captcha", "access denied"))
    return F.when(col(status) >= 400, first_bytes(F.trim(col(html)), 100)).when(blocked, "blocked by anti-bot protection")


def is_retriable_status(status: Column | str) -> Column:
    return col(status).between(502, 504)


def is_retriable_error(message: Column | str) -> Column:
    never = contains_any(col(message), ("certificate has expired", "x509", "certificate is valid for"))
    again = ("connection refused", "timeout", "deadline exceeded", "no such host", "temporary failure", "i/o timeout", "tls handshake", "EOF", "connection reset")
    return ~never & contains_any(col(message), again)


def is_unreachable_error(message: Column | str) -> Column:
    return contains_any(col(message), ("connection refused", "no such host"))


def is_soft_failure(status: Column | str, markdown: Column | str, text: Column | str) -> Column:
    """An error status with hardly any content: the request counts as failed."""
    n = F.greatest(F.octet_length(F.coalesce(col(markdown), F.lit(""))), F.octet_length(F.coalesce(col(text), F.lit(""))))
    return (col(status) >= 400) & (n < 200)


def fetch_route(mode: Column | str, reason: Column | str) -> Column:
    """Which fetcher a row goes to: http, browser, or - in auto mode - http first and a browser where a reason says so."""
    m = F.lower(F.trim(F.coalesce(col(mode), F.lit(""))))
    return F.when(m == "browser", "browser").when(m.isin("", "auto") & (col(reason) != ""), "browser").otherwise("http")


def error_status(code: Column | str) -> Column:
    """HTTP status of an error code."""
    pairs = {"invalid_url": 400, "invalid_request": 400, "extraction_error": 422, "timeout": 504, "rate_limited": 429, "unsupported_content_type": 415}
    out = F.lit(500)
    for k, v in pairs.items():
        out = F.when(col(code) == k, v).otherwise(out)
    return out
