"""Text out of file bytes: pure functions on bytes and text, run inside vectorised Python functions.

Formats that need outside programs (PDF, OCR, MOBI, DjVu, old Word files) are read by ``programs``.
"""

from __future__ import annotations

import email
import email.header
import email.policy
import html.entities
import io
import quopri
import re
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser

from ..functions.codecs import decode_bytes
from ..functions.text import fix_mixed_encoding_py
from . import programs

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("noscript", "script", "style"))
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_BLOCKS = _HEADINGS | frozenset(
    "article aside blockquote br dd div dl dt fieldset figcaption figure footer form header hr legend li main nav ol p pre section table td th tr ul".split()
)
_GAPS = _HEADINGS | {"p"}
_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)(\w+;)?")


def _closed(page: str) -> str:
    """Only character references that end in a semicolon stay such; HTML also reads some without, as ``&amp``."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] in html.entities.html5 else "&amp;" + (m[1] or ""), page)


class _Plain(HTMLParser):
    """Every non-blank text node on a line of its own; script and style text and comments are not text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.title: list[str] | None = None
        self._in_title = False
        self._silent = 0
        self._buffer: list[str] = []

    def _flush(self):
        if self._buffer:
            text = "".join(self._buffer)
            self._buffer = []
            if text.strip() and not self._silent:
                self.nodes.append(text.strip())

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in ("script", "style", "template"):
            self._silent += 1
        if tag == "title" and self.title is None:
            self.title, self._in_title = [], True

    def handle_endtag(self, tag):
        self._flush()
        if tag in ("script", "style", "template") and self._silent:
            self._silent -= 1
        if tag == "title":
            self._in_title = False

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        self._buffer.append(data)
        if self._in_title and self.title is not None:
            self.title.append(data)

    def close(self):
        super().close()
        self._flush()


def _parsed(page: str | None, strict: bool) -> _Plain:
    p = _Plain()
    p.feed(_closed(page or "") if strict else page or "")
    p.close()
    return p


def html_text(page: str | None, strict: bool = False) -> str:
    """``strict``, here and below: a character reference needs its semicolon, as in XHTML."""
    return "\n".join(_parsed(page, strict).nodes)


def html_title(page: str | None, strict: bool = False) -> str:
    return "".join(_parsed(page, strict).title or [])


class _Smart(HTMLParser):
    """Lines break at blocks only; headings and paragraphs are followed by a blank line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.line: list[str] = []
        self.open: list[str] = []
        self.hidden = 0

    def _end_line(self):
        if self.line:
            self.lines.append(" ".join(self.line))
            self.line = []

    def _end_block(self, tag):
        self._end_line()
        if tag in _GAPS and self.lines and self.lines[-1]:
            self.lines.append("")

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCKS:
            self._end_line()
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                if last in _BLOCKS:
                    self._end_block(last)
            if tag in _BLOCKS:
                self._end_block(tag)

    def handle_data(self, data):
        text = re.sub(r"\s+", " ", data).strip()
        if text and not self.hidden:
            self.line.append(text)

    def close(self):
        super().close()
        self._end_line()


def html_smart(page: str | None, strict: bool = False) -> str:
    p = _Smart()
    p.feed(_closed(page or "") if strict else page or "")
    p.close()
    lines = [x for i, x in enumerate(p.lines) if x or i == 0 or p.lines[i - 1]]
    return fix_mixed_encoding_py("\n".join(lines).strip())


def docx_text(data: bytes) -> str:
    """Paragraphs, and table rows with cells joined by bars, in document order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            out.append(text(e))
        elif e.tag == f"{w}tbl":
            out += [" | ".join(text(cell) for cell in row.iter(f"{w}tc")) for row in e.iter(f"{w}tr")]
    return "\n".join(x for x in out if x.strip())


def docx_title(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "docProps/core.xml" in z.namelist():
            for e in ElementTree.fromstring(z.read("docProps/core.xml")).iter("{http://purl.org/dc/elements/1.1/}title"):
                if e.text and e.text.strip():
                    return e.text.strip()
    return docx_text(data).partition("\n")[0][:100]


def epub_text(data: bytes) -> str:
    """Chapters in the spine's order, else by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages = [n for n in _spine(z) if n in z.namelist()] or sorted(n for n in z.namelist() if n.lower().endswith((".html", ".xhtml", ".htm")))
        return "\n\n".join(t for n in pages if (t := html_smart(decode_bytes(z.read(n)))))


def _spine(z: zipfile.ZipFile) -> list[str]:
    try:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        root = next(e.attrib["full-path"] for e in box.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(root))
    except (KeyError, StopIteration, ElementTree.ParseError):
        return []
    folder = root.rpartition("/")[0]
    items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item")}
    return [f"{folder}/{items[e.attrib['idref']]}".lstrip("/") for e in package.iter() if e.tag.endswith("}itemref") and e.attrib.get("idref") in items]


def mhtml_html(data: bytes) -> str:
    """The HTML part of a web archive, scripts removed and style sheets inlined."""
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    html, styles = None, {}
    for part in message.walk():
        kind = part.get_content_type()
        if part.is_multipart():
            continue
        body = part.get_payload(decode=True) or b""
        if kind == "text/html" and html is None:
            html = decode_bytes(body)
        elif kind == "text/css":
            styles[part.get("Content-Location", "")] = decode_bytes(body)
    if html is None:  # no MIME frame that can be read
        start = re.search(rb"<(?:!doctype|html)", data, re.I)
        html = decode_bytes(quopri.decodestring(data[start.start() :]) if start and b"=3D" in data else data[start.start() :] if start else data)
    html = re.sub(r"(?is)<script\b.*?</script\s*>", "", html)

    def inline(m):
        href = re.search(r"""href=["']?([^"'\s>]+)""", m[0])
        return f"<style>{styles[href[1]]}</style>" if href and href[1] in styles else m[0]

    return re.sub(r"(?i)<link\b[^>]*>", inline, html)


_HEADERS = {"snapshot-content-location": ("original_url", "source_url"), "date": ("save_date", "mhtml_date"), "subject": ("mhtml_subject",), "from": ("mhtml_from",), "mime-version": ("mime_version",)}
_ARCHIVE = re.compile(r'(?i)<meta\s+name="X-Archive-([^"]+)"\s+content="([^"]+)"')
_ALIASES = {"url": ("original_url", "source_url"), "original_url": ("original_url", "source_url"), "date": ("save_date",), "save_date": ("save_date",), "title": ("title",)}


def mhtml_metadata(data: bytes) -> dict[str, str]:
    """Metadata of a web archive: its headers, or the X-Archive tags of the variant that has those."""
    if '<meta name="X-Archive-' in data[:2048].decode("utf-8", "ignore"):
        out = {"file_type": "mhtml", "extraction_method": "x_archive"}
        for name, value in _ARCHIVE.findall(decode_bytes(data[:100_000])):
            key = name.lower().replace("-", "_")
            out["x_archive_" + key] = value
            out.update(dict.fromkeys(_ALIASES.get(key, ()), value))
        return out
    out = {}
    for line in decode_bytes(data[:8192]).split("\n"):
        line = line.strip()
        if line.startswith(("------", "<html", "<!DOCTYPE")):
            break
        name, colon, value = (x.strip() for x in line.partition(":"))
        if not colon or line.startswith("Content-Type: text/html"):
            continue
        low = name.lower()
        if low == "content-type" and "multipart" in value.lower():
            out["content_type"] = value
            if m := re.search(r'boundary=(?:"([^"]*)"|([^;\s]+))', value):
                out["mhtml_boundary"] = m[1] or m[2]
        elif low in _HEADERS:
            out.update(dict.fromkeys(_HEADERS[low], value))
            if low == "subject" and "=?" in value:
                out["mhtml_subject_decoded"] = str(email.header.make_header(email.header.decode_header(value)))
        else:
            out["mhtml_" + low.replace("-", "_")] = value
    return out | {"file_type": "mhtml", "extraction_method": "mhtml_header_parsing"}


def plain_text(data: bytes) -> str:
    return decode_bytes(data).lstrip("﻿").strip()


_EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    ".txt": plain_text,
    ".md": plain_text,
    ".html": lambda b: html_text(decode_bytes(b)),
    ".htm": lambda b: html_text(decode_bytes(b)),
    ".docx": docx_text,
    ".epub": epub_text,
    ".mhtml": lambda b: html_smart(mhtml_html(b)),
    ".mht": lambda b: html_smart(mhtml_html(b)),
}
_EXTRACTORS |= programs.EXTRACTORS  # these need outside programs


def register_extractor(suffix: str, extractor: Callable[[bytes], str]) -> None:
    """``extractor`` takes a file's bytes; it must be importable on the workers."""
    _EXTRACTORS[suffix.lower()] = extractor


def extract(suffix: str, data: bytes | None, path: str | None = None) -> tuple[str | None, str | None]:
    """(text, error) of a file's bytes; exactly one is set. ``path`` is where results of OCR are kept beside."""
    found = _EXTRACTORS.get(suffix)
    if found is None:
        return None, f"{suffix or 'no suffix'}: unsupported"
    try:
        text = programs.pdf_text(data or b"", path)[0] if suffix == ".pdf" and path and found is programs.EXTRACTORS[".pdf"] else found(data or b"")
    except Exception as e:  # noqa: BLE001 - a bad file is a row with an error
        return None, f"{type(e).__name__}: {e}"
    return (text, None) if text.strip() else (None, "no text in it")
