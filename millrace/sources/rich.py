"""Text inside office files, read from their XML; formats that need a program or a library of their own only where one is there."""

from __future__ import annotations

import importlib.util
import io
import re
import shutil
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

#: Rows read of each sheet, pages of a document, seconds a converter may take, the first bytes of the old office formats and of PDF, and the converter for each kind.
SHEET_ROWS, PAGES, SECONDS = 200, 5, 60
OLD, PDF = bytes.fromhex("d0cf11e0a1b11ae1"), b"%PDF-"
CONVERTERS = {"docx": "catdoc", "pptx": "catppt", "xlsx": "xls2csv"}

Reader = Callable[[bytes], "str | None"]


class Unreadable(Exception):
    """The format is known, but the file isn't one."""


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _runs(xml: bytes, text: str, block: str) -> Iterator[str]:
    """A line for each block element: the texts below it, with blanks for breaks and tabs."""
    for e in ElementTree.fromstring(xml).iter():
        if _name(e) == block:
            line = "".join((x.text or "") if _name(x) == text else " " if _name(x) in ("tab", "br", "cr") else "" for x in e.iter())
            if line.strip():
                yield line.strip()


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(re.fullmatch(pattern, n), n) for n in names]
    return [n for _, n in sorted((int(m[1]), n) for m, n in found if m)]


def _workbook(z: zipfile.ZipFile) -> Iterator[str]:
    """Sheet names and rows of a workbook, cells parted by bars."""
    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter() if _name(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _name(si) == "si"] if "xl/sharedStrings.xml" in names else []
    titles = [e.get("name", "") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _name(e) == "sheet"]
    for k, part in enumerate(_numbered(names, r"xl/worksheets/sheet(\d+)\.xml")):
        yield titles[k] if k < len(titles) else f"sheet{k + 1}"
        rows = (e for e in ElementTree.fromstring(z.read(part)).iter() if _name(e) == "row")
        for _, row in zip(range(SHEET_ROWS), rows):
            cells = []
            for c in row:
                value = "".join(x.text or "" for x in c.iter() if _name(x) in ("v", "t"))
                if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                if value:
                    cells.append(value)
            if cells:
                yield " | ".join(cells)


def _open_document(z: zipfile.ZipFile) -> Iterator[str]:
    """Paragraphs and headings of an open document; of its tables the names and rows."""
    body = ElementTree.fromstring(z.read("content.xml"))
    sheets = [e for e in body.iter() if _name(e) == "spreadsheet"]
    if not sheets:
        yield from (line for e in body.iter() if _name(e) in ("p", "h") and (line := "".join(e.itertext()).strip()))
        return
    for table in (e for s in sheets for e in s if _name(e) == "table"):
        yield _attribute(table, "name") or ""
        rows = (e for e in table.iter() if _name(e) == "table-row")
        for _, row in zip(range(SHEET_ROWS), rows):
            cells = [" ".join("".join(p.itertext()) for p in c if _name(p) == "p") for c in row if _name(c) == "table-cell"]
            if any(cells):
                yield " | ".join(c for c in cells if c)


def office(raw: bytes) -> tuple[Iterator[str], str] | None:
    """The lines of an office file in a zip and its format; None for another one."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = z.namelist()
    if "word/document.xml" in names:
        return _runs(z.read("word/document.xml"), "t", "p"), "docx"
    if "xl/workbook.xml" in names:
        return _workbook(z), "xlsx"
    if slides := _numbered(names, r"ppt/slides/slide(\d+)\.xml"):
        return (line for n in slides for line in _runs(z.read(n), "t", "p")), "pptx"
    if "content.xml" in names:
        return _open_document(z), "odf"
    return None


def _converted(raw: bytes, kind: str, charset: str) -> str | None:
    """The text that a converter on this machine gives; None where there is none."""
    program = shutil.which(CONVERTERS.get(kind, ""))
    if program is None:
        return None
    try:
        done = subprocess.run([program, "-s", charset, "-d", "utf-8"], input=raw, capture_output=True, timeout=SECONDS, check=True)
    except (OSError, subprocess.SubprocessError) as e:
        raise Unreadable(str(e)) from e
    return done.stdout.decode("utf-8", "replace")


def _pdf(raw: bytes) -> str | None:
    """The text of the first pages, if a library that reads them is there."""
    if importlib.util.find_spec("pypdf") is None:
        return None
    import pypdf

    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(raw)).pages[:PAGES])


def text_in(raw: bytes, kind: str, max_chars: int, readers: dict[str, Reader] | None = None, charset: str = "cp1250") -> tuple[str | None, str]:
    """(text, method) of a file of a rich kind: the first max_chars characters. Method is the format, `none` for kinds without text and files that can't be read, `no_converter` where what would read it isn't there. A reader given for the kind comes first."""
    try:
        if readers and kind in readers:
            found, method = readers[kind](raw), kind
        elif raw[:8] == OLD:
            found, method = _converted(raw, kind, charset), "converted"
        elif raw[:5] == PDF:
            found, method = _pdf(raw), "pdf"
        elif kind in ("docx", "pptx", "xlsx"):
            if (opened := office(raw)) is None:
                return None, "none"
            lines, method = opened
            held, size = [], 0
            for line in lines:
                held.append(line)
                size += len(line) + 1
                if size > max_chars:
                    break
            found = "\n".join(held)
        else:
            return None, "none"
    except Exception:  # noqa: BLE001  (a file that can't be read is a row without text, whatever its reader raises)
        return None, "none"
    return (found[:max_chars], method) if found is not None else (None, "no_converter")
