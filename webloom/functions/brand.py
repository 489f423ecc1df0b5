"""Brand facts that are plain string work: social accounts, image formats, sizes, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.base import any_of, col, contains_any
from webloom.functions.url import host, path


def is_social_excluded(href: Column | str) -> Column:
    return contains_any(F.lower(col(href)), fixed.SOCIAL_EXCLUDED)


def full_href(href: Column | str) -> Column:
    h = F.trim(col(href))
    return F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h)).when(~F.contains(h, F.lit("://")), F.concat(F.lit("https://"), h)).otherwise(h)


def social_account(href: Column | str) -> Column:
    """struct(type, url) of the account an address stands for; null for none."""
    full = full_href(href)
    h = F.regexp_replace(host(full), r"^www\.", "")
    p = F.regexp_replace(path(full), "/$", "")
    out = F.lit(None).cast("struct<type:string,url:string>")
    for kind, hosts, patterns, excluded in reversed(fixed.SOCIAL_PLATFORMS):
        here = any_of((h == x) | F.endswith(h, F.lit("." + x)) for x in hosts)
        account = F.lit("")
        for pattern in reversed(patterns):
            groups = pattern.count("(") - pattern.count("(?")
            parts = [F.regexp_extract(p, pattern, g) for g in range(1, groups + 1)]
            if groups > 1:
                parts[0] = F.lower(parts[0])
            text = parts[0] if groups == 1 else F.concat_ws("/", *(F.when(x != "", x) for x in parts))
            account = F.when(p.rlike(pattern), text).otherwise(account)
        if excluded:
            account = F.when(F.lower(account).isin(*excluded), "").otherwise(account)
        found = F.struct(F.lit(kind).alias("type"), F.concat(F.lit(f"https://{hosts[0]}/"), account).alias("url"))
        out = F.when(here & (account != ""), found).otherwise(out)
    return F.when(~is_social_excluded(href), out)


def image_format(url: Column | str, content_type: Column | str) -> Column:
    out = F.lit("unknown")
    for k, v in fixed.IMAGE_TYPES.items():
        out = F.when(col(content_type) == k, v).otherwise(out)
    ext = F.lower(F.regexp_extract(col(url), r"(\.[^./]*)$", 1))
    for k, v in fixed.IMAGE_EXTENSIONS.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def sizes(attribute: Column | str) -> Column:
    """Widths of a list of ``WxH``."""
    each = F.filter(F.split(col(attribute), "[\\t\\n\\f\\r ]+"), lambda p: p.rlike("^[+-]?[0-9]+x[^x]*$"))
    return F.transform(each, lambda p: F.substring_index(p, "x", 1).cast("int"))


def has_address_word(text: Column | str) -> Column:
    return contains_any(F.lower(col(text)), fixed.ADDRESS_WORDS)


def address(text: Column | str) -> Column:
    """struct(city, country, postal_code, state_province); null without a city or a country."""
    found = {n: F.trim(F.regexp_extract(col(text), p, 1)) for n, p in fixed.ADDRESS_FIELDS}
    return F.when(has_address_word(text) & ((found["city"] != "") | (found["country"] != "")), F.struct(*(v.alias(n) for n, v in found.items())))


def json_string_field(json: Column | str, name: str) -> Column:
    """A string field of a JSON object; empty if absent or no string."""
    raw = F.get_json_object(col(json), f"$.{name}")
    quoted = col(json).rlike(rf'"{name}"[\t\n\r ]*:[\t\n\r ]*"')
    return F.when(quoted, F.coalesce(raw, F.lit(""))).otherwise("")


def fenced_json(text: Column | str) -> Column:
    """A model's answer as VARIANT: code fences dropped; null if it isn't JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"^```(?:json)?[\t\n\f\r ]*", ""), r"[\t\n\f\r ]*```$", "")
    return F.try_parse_json(bare)
