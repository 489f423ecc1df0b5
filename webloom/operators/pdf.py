"""PDF text from content streams: literal strings before Tj and TJ, inflated where the stream is deflated."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*T[jJ]|\[((?:[^\[\]\\]|\\.)*)\]\s*TJ", re.S)
_PART = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_TITLE = re.compile(rb"/Title\s*\(((?:[^()\\]|\\.)*)\)", re.S)


def unescape(raw: bytes) -> bytes:
    def one(m: re.Match[bytes]) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x.endswith(b"\n") and x != b"n" else _NAMED.get(x, x)

    return _ESCAPE.sub(one, raw)


def pdf_text(raw: bytes | None) -> str:
    """Shown strings in stream order, a line each; empty for what isn't a PDF."""
    if not raw or not raw.lstrip().startswith(b"%PDF"):
        return ""
    bodies = []
    for m in _STREAM.finditer(raw):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        bodies.append(data)
    out = []
    for body in bodies or [raw]:
        for m in _SHOW.finditer(body):
            text = unescape(m[1]) if m[1] is not None else b"".join(unescape(p) for p in _PART.findall(m[2]))
            line = (text.decode("utf-16", "replace") if text[:2] in (b"\xfe\xff", b"\xff\xfe") else text.decode("latin-1")).strip()
            if line:
                out.append(line)
    return "\n".join(out)


def page_count(raw: bytes) -> int:
    """Page objects, without the page trees."""
    return len(re.findall(rb"/Type\s*/Page(?![s\w])", raw))


def pdf_info(raw: bytes | None) -> tuple[str, str | None, int, bool]:
    """(kind, title, pages, has text): kind is text, image (pictures but hardly any text) or unknown."""
    if not raw or not raw.lstrip().startswith(b"%PDF"):
        return "unknown", None, 0, False
    has = len(pdf_text(raw).encode()) >= 50
    pictures = len(re.findall(rb"/subtype\s*/image", raw.lower()))
    title = _TITLE.search(raw)
    return ("text" if has else "image" if pictures else "unknown"), (unescape(title[1]).decode("latin-1") if title else None), page_count(raw), has


def pdf_documents(files: DataFrame) -> DataFrame:
    """files (path, content), as the binaryFile source gives them -> (path, kind, title, pages, has_text, text)."""

    def run(batches):
        for batch in batches:
            raws = batch.column("content").to_pylist()
            info = [pdf_info(r) for r in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), *(pa.array([i[k] for i in info], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.bool_()))), pa.array([pdf_text(r) for r in raws], pa.string())],
                names=["path", "kind", "title", "pages", "has_text", "text"],
            )

    return files.select("path", "content").mapInArrow(run, "path string, kind string, title string, pages int, has_text boolean, text string")
