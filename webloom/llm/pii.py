"""Personal data: base patterns plus offset-preserving deobfuscation.

The base patterns run on the text itself. Then transducers rewrite, one after another, what disguises an identifier, and
note for every rewritten stretch where it came from:

1. homoglyphs, full-width forms and invisible characters; character references and percent escapes of signs;
2. mail addresses: ``[at]`` / ``(dot)``, `` at `` / `` dot ``, letters spaced out one by one. A spaced `` at `` counts only
   between a name that isn't a plain word before "at" and a domain with a known ending;
3. numbers: digits in words (compounds and "double" as well), mixed with figures, brackets and dashes; single digits
   spaced out; dots of addresses in brackets or words.

The same patterns run on the rewritten text, and what they find is mapped back to the source characters. A found span
that meets a base span of its kind adds nothing.

The work is linear in the text (possessive runs, anchored starts), so very long texts without white space cost no more
than others. Edge cases: a null or empty text has no spans; ties between readings go to the leftmost, longest one; repeated
rows are judged row by row; an empty table gives an empty result; extra columns are ignored. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from html import unescape
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, core

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(
    zip(
        "авеёкмнорсстухіјѕԁԛԝһӏАВЕКМНОРСТУХІЈЅԌԚԜҺοαενρτυιχκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "abeekmhopcctyxijsdqwhlABEKMHOPCTYXIJSGQWHoaevptuixkABEZHIKMNOPTYX",
        strict=True,
    )
)
# Digit words in English, German, French and Spanish.
DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
    "oh": "0",
}
# Words for signs.
AT_WORDS = ("at", "arroba", "ät", "arobase", "@")
DOT_WORDS = ("dot", "punkt", "point", "punto", ".")
PLUS_WORDS = ("plus", "más", "mas")

# Words that say a digit again.
TIMES_WORDS = {"double": 2, "triple": 3, "doble": 2, "doppel": 2}
# Numbers from ten on in words, in English, German, French and Spanish.
TEENS = {
    **dict(zip("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(10, 20), strict=True)),
    **dict(zip("zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split(), range(10, 20), strict=True)),
    **dict(zip("dix onze douze treize quatorze quinze seize".split(), range(10, 17), strict=True)),
    **dict(zip("diez once doce trece catorce quince".split(), range(10, 16), strict=True)),
}
TENS = {
    **dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True)),
    **dict(zip("zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split(), range(20, 100, 10), strict=True)),
    **dict(zip("vingt trente quarante cinquante soixante".split(), range(20, 70, 10), strict=True)),
    **dict(zip("veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa".split(), range(20, 100, 10), strict=True)),
}
# Endings of domains that a disguise without brackets may have.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz io co ai app dev me tv eu uk us ca au nz ie de at ch fr be nl lu es pt it se no dk fi is pl cz sk hu ro bg gr tr ru ua by "
    "jp cn kr in br mx ar cl pe za ng ke eg il ae sa ir pk bd lk sg hk tw th vn id ph my example test invalid localhost local".split()
)
# Plain words that stand before "at" in prose.
BEFORE_AT = frozenset(
    "look looks looked good bad great better best available are is was were be been am meet met see seen work works working live lives stay arrive arrived stop start not only all it me us him her them you they we he she and or "
    "this that there here stuff found find visit read more us directly sold held based hosted open opens online buy order located listed".split()
)

# Words after which a plain word is a verb, so that "at" after it is prose.
BEFORE_VERB = frozenset("we they i he she who will would can could must shall should may might don't didn't cannot".split())
# Units that make a spoken figure with points a measure, not an address.
UNITS = ("percent", "per cent", "%", "prozent", "pour cent", "por ciento")

_alt = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_UNIT = _alt(DIGIT_WORDS)
_GERMAN = rf"(?:ein|{_alt(w for w in DIGIT_WORDS)})und(?:{_alt(w for w in TENS)})"
_SPELLED = rf"(?:{_GERMAN}|(?:{_alt(TENS)})(?:(?:[\s-]|\sy\s|-et-|\set\s)(?:{_UNIT}|un))?|{_alt(TEENS)}|{_UNIT})"
_SPOKEN_DOT = _alt(w for w in DOT_WORDS if w != ".")
_TIMES = rf"(?:(?:{_alt(TIMES_WORDS)})[\s-]+)?"
_ITEM = rf"(?:{_TIMES}{_SPELLED}|[0-9]++|(?:{_SPOKEN_DOT}))(?!\w)"
_RUN = re.compile(rf"(?<!\w)(?:(?:{_alt(PLUS_WORDS)})[\s-]+|\+\s*)?\(?{_ITEM}(?:(?:[\s,\-()]{{1,4}}|\.){_ITEM}){{2,}}", re.I)
_SAID = frozenset([*DIGIT_WORDS, *TEENS, *TENS])
_IN_RUNS = _SAID | frozenset(w for w in (*DOT_WORDS, *TIMES_WORDS, "y", "et") if w.isalpha())
_WORDS = re.compile(r"\w+")
_GERMAN_WORD = re.compile(_GERMAN)
_PIECE = re.compile(rf"{_GERMAN}|{_alt(TENS)}|{_alt(TEENS)}|{_UNIT}|{_alt(TIMES_WORDS)}|[0-9]+|{_SPOKEN_DOT}|{_alt(PLUS_WORDS)}|[+.]|\sy\s|-?\bet\b-?", re.I)
_GERMAN_PARTS = re.compile(rf"({_alt([*DIGIT_WORDS, 'ein'])})und({_alt(TENS)})", re.I)
_AT_SIGN = re.compile(rf"(?P<hard>\s{{0,20}}[\[({{<]\s{{0,20}}(?:{_alt(AT_WORDS)})\s{{0,20}}[\])}}>]\s{{0,20}})|(?P<soft>(?<=\w)\s{{1,20}}(?:{_alt(AT_WORDS)})\s{{1,20}}(?=\w))|(?P<plain>@)", re.I)
_HARD_DOT = rf"\s{{0,20}}[\[({{<]\s{{0,20}}(?:{_alt(DOT_WORDS)})\s{{0,20}}[\])}}>]\s{{0,20}}"
_SOFT_DOT = rf"\s{{1,20}}(?:{_SPOKEN_DOT})\s{{1,20}}"
_DOT_SIGN = re.compile(rf"(?P<hard>{_HARD_DOT})|(?P<soft>{_SOFT_DOT})|(?P<plain>\.)|(?P<blank>\x20\.\x20)", re.I)
_DOT_BEFORE = re.compile(rf"(?:(?P<hard>{_HARD_DOT})|(?P<soft>{_SOFT_DOT})|(?P<plain>\.)|(?P<blank>\x20\.\x20))\Z", re.I)
_SPACED = re.compile(r"[A-Za-z0-9](?:\x20[A-Za-z0-9](?![A-Za-z0-9]))++(?![A-Za-z0-9])")
_SPACED_BEFORE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9](?:\x20[A-Za-z0-9]){2,}\Z")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_HARD_DOT}|{_SOFT_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_BLANK_DOTTED = re.compile(r"(?<![0-9.])[0-9](?:\x20?[0-9]){0,2}(?:\x20?\.\x20?[0-9](?:\x20?[0-9]){0,2}){3}(?![0-9])")
_ESCAPED = re.compile(r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});|&(?:commat|period|plus|lpar|rpar|lowbar|hyphen|dash);|%(?:40|2[bBeE])")
_MAY_ESCAPE = re.compile(r"&[#a-z]|%[24]")
_MEASURED = re.compile(rf"[\s-]*(?:{_alt(UNITS)})", re.I)
_LAST_WORD = re.compile(r"(?<![\w'])([\w']{1,12})\s{1,20}\Z")
_FULL_STOPS = frozenset("。｡")
_NAME_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
#: Beyond Latin letters and ordinary punctuation: may hold homoglyphs, full-width forms or invisible characters.
_ODD = re.compile(r"[­ɐ-᷿​-‏․⁠-₟℀-⅏①-⓿　。﹒﹫﻿-￯\U0001D400-\U0001D7FF]")
_INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as in KINDS, then start."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            i = m.start()
            while i > last and text[i - 1] in _LOCAL:
                i -= 1
            if i < m.start():
                out.append(("email", i, m.end()))
                last = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Tape:
    """A text with the way back to the source: pieces of equal length map character by character, others as a whole."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0]  # of pieces, in this text
        self.source = [(0, len(text), True)]  # start, end, character by character

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, _, exact = self.source[i]
        first = a + start - self.starts[i] if exact else a
        b, e, exact = self.source[j]
        return first, b + end - self.starts[j] if exact else e

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace ``edits`` (start, end, new text; in order, apart): the mapping carries through."""
        if not edits:
            return self
        out, parts, starts, source, size = Tape(""), [], [], [], 0

        def copy(a: int, b: int) -> None:
            nonlocal size
            while a < b:
                i = bisect_right(self.starts, a) - 1
                stop = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
                s, e, exact = self.source[i]
                starts.append(size)
                source.append((s + a - self.starts[i], s + stop - self.starts[i], True) if exact else (s, e, False))
                parts.append(self.text[a:stop])
                size += stop - a
                a = stop

        at = 0
        for a, b, new in edits:
            copy(at, a)
            if new:
                starts.append(size)
                source.append((*self.back(a, b), False))
                parts.append(new)
                size += len(new)
            at = b
        copy(at, len(self.text))
        out.text, out.starts, out.source = "".join(parts), starts or [0], source or [(0, 0, True)]
        return out


def plain_char(c: str) -> str | None:
    """What an odd character stands for; None if for itself."""
    if c in _INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", c)
    if folded != c and folded.isascii():
        return folded
    return LOOKALIKES.get(folded)


def _joins(text: str, i: int) -> bool:
    """Whether the ideographic full stop at ``i`` stands inside an address: between figures, or before an ending or one more stop."""
    label = _LABEL.match(text, i + 1)
    if not i or not label or not text[i - 1].isascii() or not text[i - 1].isalnum():
        return False
    return label[0].lower() in ENDINGS or label[0].isdigit() and text[i - 1].isdigit() or text[label.end() : label.end() + 1] in _FULL_STOPS


def _glyph_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ODD.finditer(text):
        new = ("." if _joins(text, m.start()) else None) if m[0] in _FULL_STOPS else plain_char(m[0])
        if new is not None:
            out.append((m.start(), m.end(), new))
    return out


def _escape_edits(text: str) -> list[tuple[int, int, str]]:
    """Character references and percent escapes that stand for ASCII signs, letters or digits."""
    out = []
    for m in _ESCAPED.finditer(text):
        new = unquote(m[0]) if m[0][0] == "%" else unescape(m[0])
        if len(new) == 1 and new.isascii() and new.isprintable():
            out.append((m.start(), m.end(), new))
    return out


def _blanks(text: str, a: int, b: int) -> list[tuple[int, int, str]]:
    return [(i, i + 1, "") for i in range(a, b) if text[i] == " "]


def _name_before(text: str, end: int, least: int) -> tuple[int, list, bool, bool]:
    """(start, edits, spaced out, has disguised dots) of the name that ends at ``end``; it starts at ``least`` or later."""
    spaced = _SPACED_BEFORE.search(text, max(least, end - 200), end)
    if spaced and all(len(w) == 1 for w in spaced[0].split(" ")):
        return spaced.start(), _blanks(text, spaced.start(), end), True, False
    edits, at, disguised = [], end, False
    while True:
        i = at
        while i > least and text[i - 1] in _NAME_SIGNS:
            i -= 1
        if i == at:
            break
        start = i
        dot = _DOT_BEFORE.search(text, max(least, i - 60), i)
        if not dot or dot["blank"] or dot.start() <= least or text[dot.start() - 1] not in _NAME_SIGNS:
            break
        if not dot["plain"]:
            edits.append((dot.start(), dot.end(), "."))
            disguised = True
        at = dot.start()
    if at == end and i == end:
        return end, [], False, False
    edits = [e for e in edits if e[0] > start]
    return start, edits, False, disguised


def _after_subject(text: str, start: int) -> bool:
    """Whether the word before ``start`` makes the next one a verb, as in "we sell at"."""
    before = _LAST_WORD.search(text, max(0, start - 40), start)
    return bool(before) and before[1].lower() in BEFORE_VERB


def _mail_edits(text: str) -> list[tuple[int, int, str]]:
    """From each at sign, plain or disguised, to the left for the name and to the right for the domain."""
    edits: list[tuple[int, int, str]] = []
    last = 0
    for m in _AT_SIGN.finditer(text):
        if m.start() < last:
            continue
        start, left, spaced, _ = _name_before(text, m.start(), last)
        if start >= m.start():
            continue
        right, labels, hard, disguised, at, end = [], [], bool(m["hard"]), False, m.end(), None
        while True:
            part = _SPACED.match(text, at) if spaced or len(labels) else None
            part = part or _LABEL.match(text, at)
            if not part or part[0].lower() in DOT_WORDS:
                break
            labels.append(part[0].replace(" ", "").lower())
            right += _blanks(text, part.start(), part.end())
            at = part.end()
            if len(labels) > 1 and (hard or spaced or labels[-1] in ENDINGS):
                end = (at, len(right), disguised)
            dot = _DOT_SIGN.match(text, at)
            if not dot or dot["blank"] and not spaced or dot["plain"] and m["soft"] and not spaced:
                break
            hard = hard or bool(dot["hard"])
            disguised = disguised or not dot["plain"]
            if not dot["plain"]:
                right.append((dot.start(), dot.end(), "."))
            at = dot.end()
        if end is None:
            continue
        at, n, disguised = end
        if m["plain"] and not left and not disguised:
            continue  # the base pattern has it
        if m["soft"] and not spaced and not hard and (text[start : m.start()].lower() in BEFORE_AT or _after_subject(text, start)):
            continue
        edits += sorted(left) + ([] if m["plain"] else [(m.start(), m.end(), "@")]) + right[:n]
        last = at
    return edits


def _spoken(run: str) -> str:
    """The figures, signs and dots that a run of number words says."""
    out, times, tens = "", 1, 0
    for p in _PIECE.findall(run):
        w = p.lower()
        if w.strip(" \t\n-") in ("y", "et"):
            continue
        if tens and (w not in DIGIT_WORDS or DIGIT_WORDS[w] == "0"):
            out, tens = out + str(tens), 0
        german = _GERMAN_PARTS.fullmatch(w)
        if german:
            out += str(TENS[german[2]] + int(DIGIT_WORDS.get(german[1], "1")))
        elif w in TENS:
            tens = TENS[w]
        elif tens:
            out, tens = out + str(tens + int(DIGIT_WORDS[w])), 0
        elif w in TIMES_WORDS:
            times = TIMES_WORDS[w]
        elif w in TEENS:
            out += str(TEENS[w])
        elif w in DIGIT_WORDS or w.isdigit():
            out, times = out + DIGIT_WORDS.get(w, w) * times, 1
        elif w in PLUS_WORDS or w == "+":
            out += "+"
        elif w in DOT_WORDS:
            out += "."
    return out + (str(tens) if tens else "")


def _may_say_numbers(text: str) -> bool:
    """Whether three items of a number run follow one another, one of them in words: as :data:`_RUN` demands, and cheaper."""
    words = _WORDS.findall(text.lower())
    if _SAID.isdisjoint(words) and not any("und" in w and _GERMAN_WORD.fullmatch(w) for w in set(words)):
        return False
    n, said = 0, False
    for w in words:
        known = w in _IN_RUNS or "und" in w and _GERMAN_WORD.fullmatch(w)
        if known or w.isdigit():
            n, said = n + 1, said or bool(known)
            if n >= 3 and said:
                return True
        else:
            n, said = 0, False
    return False


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _RUN.finditer(text):
        if not any(w in _SAID or _GERMAN_WORD.fullmatch(w) for w in _WORDS.findall(m[0].lower())):
            continue
        new = _spoken(m[0])
        if "." in new and _MEASURED.match(text, m.end()):
            continue
        if len(_NOT_DIGITS.sub("", new)) >= 7 or new.count(".") == 3:
            edits.append((m.start(), m.end(), new))
    return edits


def _dotted_edits(text: str) -> list[tuple[int, int, str]]:
    """Addresses whose dots are disguised, or whose digits are spaced out."""
    found = [(m.start(), m.end(), re.sub(r"[^0-9.]+", ".", re.sub(rf"{_HARD_DOT}|{_SOFT_DOT}", ".", m[0], flags=re.I))) for m in _DOTTED.finditer(text) if not _MEASURED.match(text, m.end())]
    for m in _BLANK_DOTTED.finditer(text):
        if re.search(r"[0-9]\x20[0-9]", m[0]):
            found.append((m.start(), m.end(), m[0].replace(" ", "")))
    out, end = [], 0
    for a, b, new in sorted(found):
        if a >= end and new != text[a:b]:
            out.append((a, b, new))
            end = b
    return out


_WORD_TRIGGER = re.compile(rf"[\[({{<]\s{{0,20}}(?:{_alt(AT_WORDS)}|{_alt(DOT_WORDS)})\s{{0,20}}[\])}}>]|\s(?:{_SPOKEN_DOT})\s|[A-Za-z0-9]\x20[.@]\x20[A-Za-z0-9]|\x20[A-Za-z0-9]\x20[@]", re.I)


def disguised_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in source offsets. They meet no base span of their kind, but that an email
    whose base span ends at a look-alike glyph is added whole, around the base span."""
    tape = Tape(text)
    if not text.isascii() and _ODD.search(text):
        tape = tape.rewrite(_glyph_edits(tape.text))
    if _MAY_ESCAPE.search(text):
        tape = tape.rewrite(_escape_edits(tape.text))
    if _WORD_TRIGGER.search(tape.text):
        tape = tape.rewrite(_mail_edits(tape.text))
        tape = tape.rewrite(_dotted_edits(tape.text))
    if _may_say_numbers(tape.text):
        tape = tape.rewrite(_digit_edits(tape.text))
    if len(tape.starts) == 1 and tape.text == text:
        return []
    out, taken = [], {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    for kind, a, b in base_spans(tape.text):
        s, e = tape.back(a, b)
        if all(e <= x or s >= y or kind == "email" and _wider(text, s, e, x, y) for x, y in taken[kind]):
            out.append((kind, s, e))
            taken[kind].append((s, e))
    return out


def _wider(text: str, s: int, e: int, x: int, y: int) -> bool:
    """Whether (s, e) is the whole of an address that odd glyphs cut to (x, y): it goes on over such a glyph, up to a word's edge."""
    if not (s <= x and y <= e) or (s, e) == (x, y) or s and text[s - 1].isalnum():
        return False
    return (s == x or bool(_ODD.match(text[x - 1]))) and (e == y or bool(_ODD.match(text[y])))


def find_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of one text, each by kind, then start."""
    base = base_spans(text or "")
    return base, disguised_spans(text or "", base)


def pii(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id and spans (kind, start, end, base, found: the source characters), by kind, then start."""

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text").to_pylist():
            base, added = find_spans(text)
            rows = [(KINDS.index(k), a, b, k, True) for k, a, b in base] + [(KINDS.index(k), a, b, k, False) for k, a, b in added]
            out.append([{"kind": k, "start": a, "end": b, "base": is_base, "found": text[a:b]} for _, a, b, k, is_base in sorted(rows)])
        return {"doc_id": batch.column("doc_id"), "spans": out}

    return arrow_map(core(docs, "doc_id", "text"), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,found:string>>")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return pii(docs).select("doc_id", *(count(k) for k in KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with every span replaced by its kind in angle brackets."""

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text").to_pylist():
            if text is not None:
                base, added = find_spans(text)
                at, parts = 0, []
                for a, b, kind in sorted(((a, b, k) for k, a, b in base + added), key=lambda x: (x[0], -x[1])):
                    if a >= at:
                        parts += [text[at:a], f"<{kind}>"]
                        at = b
                text = "".join(parts) + text[at:]
            out.append(text)
        return {"doc_id": batch.column("doc_id"), "text": out}

    return arrow_map(core(docs, "doc_id", "text"), run, "doc_id long, text string")


__all__ = ["base_spans", "disguised_spans", "find_spans", "pii", "pii_digest", "redact"]
