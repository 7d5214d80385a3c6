"""Formats that outside programs read: PDF with OCR as a last resort, MOBI, DjVu, old Word files, and pages by a text browser.

A program gets a file in the task's own scratch folder, a time-out, and its output is the text. A program that is not
installed is passed over; if none is left the row has an error that names them. OCR results are kept beside the source where that
folder can be written to, so that they are made once.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile

TEXT_SECONDS, OCR_SECONDS = 60, 1800
OCR_SUFFIX = "--OCR.pdf"
OCR_LANGUAGES = "chi_sim+eng"


class Unreadable(ValueError):
    """No program could read a file."""


def run(argv: list[str], timeout: float) -> str | None:
    """A program's output; None if it is absent, fails, takes too long or says nothing."""
    if not shutil.which(argv[0]):
        return None
    try:
        done = subprocess.run(argv, capture_output=True, timeout=timeout, check=False)  # noqa: S603 - fixed programs
    except subprocess.TimeoutExpired:
        return None
    text = done.stdout.decode("utf-8", "replace").strip()
    return text if done.returncode == 0 and text else None


def _in_file(data: bytes, suffix: str, work):
    with tempfile.TemporaryDirectory() as folder:  # of this task alone, gone with it
        path = os.path.join(folder, f"document{suffix}")
        with open(path, "wb") as f:
            f.write(data)
        return work(path, folder)


def garbage(text: str, least: int = 100) -> bool:
    """Hardly any text, one character over and over, or hardly a letter in it."""
    return len(text) < least or re.search(r"(.)\1{20,}", text) is not None or sum(map(str.isalnum, text)) < 0.15 * len(text)


def ocr_path(path: str) -> str:
    stem = path[:-4] if path.lower().endswith(".pdf") else path
    return path if path.endswith(OCR_SUFFIX) else stem + OCR_SUFFIX


def pdf_text(data: bytes, path: str | None = None) -> tuple[str, str]:
    """(text, method): pdftotext, else mutool, else OCR; text that looks broken only if nothing does better."""

    def work(file, folder):
        local = (path or "").removeprefix("file:")
        local = re.sub("^/{2,}", "/", local) if local.startswith("/") else ""
        kept = ocr_path(local) if local else ""
        if kept and os.path.isfile(kept) and (text := run(["pdftotext", kept, "-"], TEXT_SECONDS)):
            return text, "ocr cache"
        poor = None
        for method, argv in (("pdftotext", ["pdftotext", file, "-"]), ("mutool", ["mutool", "draw", "-F", "text", "-o", "-", file])):
            if text := run(argv, TEXT_SECONDS):
                if not garbage(text):
                    return text, method
                poor = poor or (text, f"{method}, poor")
        made = os.path.join(folder, "ocr.pdf")
        if shutil.which("ocrmypdf"):
            try:
                subprocess.run(["ocrmypdf", "-l", OCR_LANGUAGES, "--force-ocr", "--output-type", "pdf", file, made], capture_output=True, timeout=OCR_SECONDS, check=True)  # noqa: S603, S607
            except (subprocess.SubprocessError, OSError):
                made = ""
            if made and os.path.isfile(made) and (text := run(["pdftotext", made, "-"], TEXT_SECONDS)):
                if kept and os.access(os.path.dirname(kept), os.W_OK):
                    shutil.copyfile(made, f"{kept}.part")
                    os.replace(f"{kept}.part", kept)
                return text, "ocrmypdf"
        if poor:
            return poor
        raise Unreadable("no text by pdftotext, mutool or ocrmypdf; is one of them installed?")

    return _in_file(data, ".pdf", work)


def _by(suffix: str, *programs: list[str]):
    """An extractor by the first of some programs that gives text; FILE stands for the file, OUT for a file that it writes."""

    def work(file, folder):
        out = os.path.join(folder, "out.txt")
        for argv in programs:
            text = run([{"FILE": file, "OUT": out}.get(a, a) for a in argv], 5 * TEXT_SECONDS if "OUT" in argv else TEXT_SECONDS)
            if "OUT" in argv and os.path.isfile(out):
                with open(out, encoding="utf-8", errors="replace") as f:
                    text = f.read().strip()
            if text:
                return text
        raise Unreadable(f"no text by {' or '.join(p[0] for p in programs)}; is one of them installed?")

    return lambda data: _in_file(data, suffix, work)


mobi_text = _by(".mobi", ["ebook-convert", "FILE", "OUT"], ["mobitool", "-e", "FILE"])
azw_text = _by(".azw3", ["ebook-convert", "FILE", "OUT"])
djvu_text = _by(".djvu", ["djvutxt", "FILE"])
doc_text = _by(".doc", ["antiword", "FILE"], ["catdoc", "FILE"])
page_text = _by(".html", ["w3m", "-dump", "-T", "text/html", "FILE"], ["chromium", "--headless", "--dump-dom", "FILE"])
EXTRACTORS = {".pdf": lambda data: pdf_text(data)[0], ".mobi": mobi_text, ".azw": azw_text, ".azw3": azw_text, ".djvu": djvu_text, ".doc": doc_text}
