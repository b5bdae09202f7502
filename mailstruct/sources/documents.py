"""Text of attached documents, and mail in Outlook's format. Optional libraries are looked for on the worker, per call."""

from __future__ import annotations

import io
import re
import zipfile
from email.message import EmailMessage
from xml.etree import ElementTree

EMPTY_SHEET = "[Empty Excel file]"
CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def text_of_pdf(data: bytes) -> str:
    """The text of a PDF, or a note in brackets if it has none or no reader is installed."""
    try:
        from pdfminer.high_level import extract_text
    except ImportError:
        return "[PDF text extraction not available]"
    try:
        return extract_text(io.BytesIO(data)).strip() or "[No text found in PDF]"
    except Exception as e:  # noqa: BLE001
        return f"[Error extracting PDF text: {e}]"


def sheets_of(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet, read from the file's XML."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{CELL}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{CELL}si")]
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{CELL}sheet")]
        out = []
        for i, title in enumerate(titles, 1):
            if f"xl/worksheets/sheet{i}.xml" not in names:
                continue
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{CELL}row"):
                cells = []
                for c in row.iter(f"{CELL}c"):
                    value = c.find(f"{CELL}v")
                    text = "" if value is None else value.text or ""
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                    elif c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{CELL}t"))
                    cells.append(text)
                rows.append(cells)
            out.append((title, rows))
    return out


def text_of_excel(data: bytes) -> str:
    """Each sheet that isn't empty under its name, columns aligned; a note in brackets if the file can't be read."""
    try:
        parts = []
        for name, rows in sheets_of(data):
            if len(rows) < 2:
                continue
            width = max(map(len, rows))
            table = [r + [""] * (width - len(r)) for r in rows]
            sizes = [max(len(r[c]) for r in table) for c in range(width)]
            lines = [" ".join(x.rjust(n) for x, n in zip(r, sizes, strict=True)) for r in table]
            parts.append(f"=== Sheet: {name} ===\n" + "\n".join(lines))
        return "\n\n".join(parts) or EMPTY_SHEET
    except Exception as e:  # noqa: BLE001
        return f"[Error extracting Excel text: {e}]"


def excel_with_images(data: bytes) -> tuple[str, list[dict]]:
    """Text, and the images within: none are taken."""
    return text_of_excel(data), []


def text_of_word(data: bytes) -> str:
    """Paragraphs of a Word file."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")).strip()
    except Exception as e:  # noqa: BLE001
        return f"[Error extracting Word text: {e}]"


def text_of_plain(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\x00", "")


def text_of_markup(data: bytes) -> str:
    return re.sub(r"<[^>]+>", " ", text_of_plain(data))


#: Extractors by content type, ready for the engine's options.
EXTRACTORS = {
    "application/pdf": text_of_pdf,
    "application/vnd.ms-excel": text_of_excel,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": text_of_excel,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": text_of_word,
    "text/plain": text_of_plain,
    "text/csv": text_of_plain,
    "text/html": text_of_markup,
}


def mail_of_msg(data: bytes) -> bytes:
    """An Outlook message as RFC 5322 bytes: four headers and the body."""
    try:
        import extract_msg
    except ImportError as e:
        raise ImportError("extract-msg is not installed") from e
    source = extract_msg.openMsg(io.BytesIO(data))
    out = EmailMessage()
    for name, value in (("Subject", source.subject), ("From", source.sender), ("To", source.to), ("Date", source.date)):
        out[name] = str(value or "")
    out.set_content(source.body or "")
    return out.as_bytes()
