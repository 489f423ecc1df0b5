"""Text primitives over markup and markdown: pure string work, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.base import col, replaced


def unescape_entities(x: Column | str) -> Column:
    out = col(x)
    for a, b in fixed.ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_html(x: Column | str) -> Column:
    out = col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_blocks(x: Column | str) -> Column:
    """Without script and style blocks; one that isn't closed takes the rest along."""
    return replaced(replaced(col(x), fixed.SCRIPT_BLOCK), fixed.STYLE_BLOCK)


def body_html(lower_html: Column | str) -> Column:
    """Between the first ``<body ...>`` and the last ``</body>``, without scripts and styles; empty without either."""
    return strip_blocks(F.regexp_extract(col(lower_html), fixed.BODY, 1))


def visible_text(stripped: Column | str) -> Column:
    return replaced(replaced(col(stripped), fixed.ANY_TAG), r"[ \t\n\r]+", " ")


def body_text_bytes(lower_html: Column | str) -> Column:
    """Bytes of visible body text: 1000 without a body tag, 0 with one that never ends."""
    x = col(lower_html)
    return F.when(~F.contains(x, F.lit("<body")), F.lit(1000)).otherwise(F.octet_length(visible_text(body_html(x)))).cast("long")


def clean_noise(x: Column | str) -> Column:
    out = col(x)
    for step in fixed.NOISE_STEPS:
        out = replaced(out, step)
    return out


def strip_links_images(x: Column | str, rounds: int = 3) -> Column:
    """Images dropped, links unwrapped, empty boxes removed (``rounds`` deep), blanks collapsed, trimmed."""
    out = replaced(replaced(replaced(col(x), fixed.IMG_TAG), fixed.ANCHOR_PAIR, "$1"), fixed.ANCHOR_OPEN)
    for _ in range(rounds):
        out = replaced(out, fixed.EMPTY_BOX)
    out = replaced(replaced(out, fixed.BLANKS, " "), fixed.BLANK_LINES, "\n\n")
    return replaced(out, r"^[\t\n\f\r ]+|[\t\n\f\r ]+$")


def postprocess_markdown(x: Column | str) -> Column:
    out = col(x)
    for step in fixed.MARKDOWN_STEPS:
        out = replaced(out, step)
    return out


def filter_markdown_images(x: Column | str) -> Column:
    return replaced(col(x), fixed.MARKDOWN_STEPS[-1])


def remove_link_syntax(x: Column | str) -> Column:
    return replaced(col(x), fixed.MARKDOWN_LINK, "$1")


def searchable(x: Column | str) -> Column:
    """Lower-cased text with and without link syntax; empty for empty."""
    return F.when(col(x) == "", "").otherwise(F.lower(F.concat(col(x), F.lit("\n"), remove_link_syntax(x))))


def phrases(x: Column | str, longer_than: int) -> Column:
    """Trimmed lines longer than so many characters."""
    lines = F.transform(F.split(col(x), "\n"), lambda p: replaced(p, r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$"))
    return F.filter(lines, lambda p: F.char_length(p) > longer_than)


def title(x: Column | str) -> Column:
    """Trimmed, decoded text of the first title element; null without one."""
    found = F.regexp_extract(col(x), fixed.TITLE, 1)
    return F.when(found != "", F.trim(unescape_entities(found)))


def html_lang(x: Column | str) -> Column:
    found = F.regexp_extract(col(x), fixed.HTML_LANG, 1)
    return F.when(found != "", F.trim(found))


def resolve_title(og_title: Column | str, plain_title: Column | str) -> Column:
    """The social title up to its first separator, else the plain title as it is."""
    cut = F.trim(F.regexp_extract(col(og_title), r"(?s)^(.+?)(?:[|–—-]|$)", 1))
    return F.when(F.coalesce(col(og_title), F.lit("")) != "", cut).otherwise(col(plain_title))


def display_date(iso: Column | str) -> Column:
    """RFC 3339 as ``02 Jan 2006, 15:04 UTC``; what isn't stays."""
    parsed = F.try_to_timestamp(col(iso))
    strict = col(iso).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(strict & parsed.isNotNull(), F.date_format(parsed, "dd MMM yyyy, HH:mm 'UTC'")).otherwise(col(iso))


def article_header(title_: Column | str, author: Column | str, published: Column | str, modified: Column | str) -> Column:
    """Markdown header: title, byline, dates; parts that are missing are left out."""
    filled = lambda c, make: F.when(F.coalesce(col(c), F.lit("")) != "", make(col(c)))
    return F.concat_ws(
        "\n\n",
        filled(title_, lambda c: F.concat(F.lit("# "), c)),
        filled(author, lambda c: F.concat(F.lit("By "), c)),
        filled(published, lambda c: F.concat(F.lit("Published "), display_date(c))),
        filled(modified, lambda c: F.concat(F.lit("Updated "), display_date(c))),
    )


def prepend_header(markdown: Column | str, header: Column | str, title_: Column | str) -> Column:
    """The header before the text, unless the text already starts with the title or there is no header."""
    starts = F.startswith(F.ltrim(replaced(col(markdown), r"^[\t\n\f\r ]*#*[\t\n\f\r ]*")), F.coalesce(col(title_), F.lit("\x00")))
    return F.when((col(header) == "") | starts, col(markdown)).otherwise(F.concat(col(header), F.lit("\n\n"), col(markdown)))


def append_description(markdown: Column | str, description: Column | str, og_description: Column | str, title_: Column | str) -> Column:
    """A description of 80 bytes or more joins a text of under 1500 bytes that doesn't hold its first 120 bytes yet."""
    long_enough = lambda c: F.octet_length(F.coalesce(col(c), F.lit(""))) >= 80
    d = F.when(long_enough(description), col(description)).when(long_enough(og_description), col(og_description))
    new = d.isNotNull() & (F.octet_length(col(markdown)) < 1500) & ~F.contains(col(markdown), F.substring(d, 1, 120)) & ~d.eqNullSafe(col(title_))
    return F.when(new, F.concat(col(markdown), F.lit("\n\n"), d)).otherwise(col(markdown))


def reflow_lists(x: Column | str) -> Column:
    """Line breaks inside quoted, bracketed lists are taken out."""
    out = col(x)
    for pattern, by in fixed.REFLOWED:
        out = replaced(out, pattern, by.replace("\\1", "$1"))
    return out


def drop_first_headings(x: Column | str) -> Column:
    """Without lines that are a first-level heading."""
    return F.array_join(F.filter(F.split(col(x), "\n"), lambda line: ~F.startswith(line, F.lit("# "))), "\n")


def indent(x: Column | str, by: str = "      ") -> Column:
    return replaced(col(x), r"(?m)^(?=[^\n])", by)


def truncate_bytes(x: Column | str, n: int) -> Column:
    from webloom.functions.base import first_bytes

    return first_bytes(col(x), n)


def tokens(x: Column | str) -> Column:
    """Words between white space and punctuation, lower-cased, none empty."""
    return F.filter(F.split(F.lower(col(x)), fixed.TOKEN_BREAK), lambda t: t != "")


def format_document(title_: Column | str, excerpt: Column | str, content: Column | str) -> Column:
    """A whole document around a content fragment."""
    t, e = escape_html(F.coalesce(col(title_), F.lit(""))), escape_html(F.coalesce(col(excerpt), F.lit("")))
    meta = F.when(e != "", F.concat(F.lit('  <meta name="description" content="'), F.replace(e, F.lit('"'), F.lit("&quot;")), F.lit('">\n'))).otherwise("")
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head>\n  <meta charset="utf-8">\n  <title>'), t, F.lit("</title>\n"), meta, F.lit("</head>\n<body>\n"),
        indent(content, "  "), F.lit("\n</body>\n</html>\n"),
    )
