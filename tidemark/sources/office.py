"""Text and properties of office documents and photographs, in Arrow batches."""

from __future__ import annotations

import contextlib
import io
import re
import signal
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import sniffed
from tidemark.schemas import SNIFF_BYTES
from tidemark.sources.slices import row_by_row

SCHEMA = "id long, doc_type string, title string, author string, page_count long, body_text string, taken string, make string, model string, error string"
_ARROW = pa.schema([(n, pa.int64() if n in ("id", "page_count") else pa.string()) for n in (c.split()[0] for c in SCHEMA.split(", "))])
_FIELDS = _ARROW.names


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(xml: bytes, paragraph: str) -> list[str]:
    """Text runs glued within each paragraph element."""
    return ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in ET.fromstring(xml).iter() if _local(p.tag) == paragraph]


def _properties(archive: zipfile.ZipFile) -> dict:
    try:
        root = ET.fromstring(archive.read("docProps/core.xml"))
    except (KeyError, ET.ParseError):
        return {}
    found = {_local(e.tag): (e.text or "").strip() or None for e in root.iter()}
    return {"title": found.get("title"), "author": found.get("creator")}


def _parts(archive: zipfile.ZipFile, prefix: str) -> list[str]:
    return sorted(n for n in archive.namelist() if n.startswith(prefix) and n.endswith(".xml"))


def docx(archive: zipfile.ZipFile) -> dict:
    return {"body_text": "\n".join(x for x in _paragraphs(archive.read("word/document.xml"), "p") if x)}


def xlsx(archive: zipfile.ZipFile) -> dict:
    """Shared and inline strings of all sheets; numbers are left out."""
    names = archive.namelist()
    shared = _paragraphs(archive.read("xl/sharedStrings.xml"), "si") if "xl/sharedStrings.xml" in names else []
    sheets = _parts(archive, "xl/worksheets/sheet")
    texts = []
    for name in sheets:
        for cell in ET.fromstring(archive.read(name)).iter():
            kind = cell.get("t") if _local(cell.tag) == "c" else None
            if kind == "s":
                value = next((v.text for v in cell if _local(v.tag) == "v"), None)
                if value and value.isdigit() and int(value) < len(shared):
                    texts.append(shared[int(value)])
            elif kind == "inlineStr":
                texts.append("".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t"))
    return {"body_text": "\n".join(x for x in texts if x), "page_count": len(sheets)}


def pptx(archive: zipfile.ZipFile) -> dict:
    slides = _parts(archive, "ppt/slides/slide")
    return {"body_text": "\n".join(x for n in slides for x in _paragraphs(archive.read(n), "p") if x), "page_count": len(slides)}


#: Numbers of EXIF tags (fixed values).
MAKE, MODEL, CHANGED, EXIF_IFD, TAKEN = 0x010F, 0x0110, 0x0132, 0x8769, 0x9003


def exif(content: bytes) -> dict:
    """Date, make and model as the file states them; none for a file without EXIF."""
    if content[:2] == b"\xff\xd8":
        at = content.find(b"Exif\0\0")
        if at < 0:
            return {}
        content = content[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None:
        raise ValueError("no TIFF header")
    tags: dict[int, object] = {}

    def directory(at: int) -> None:
        (n,) = struct.unpack_from(f"{order}H", content, at)
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(f"{order}HHII", content, at + 2 + 12 * k)
            if kind == 2:
                start = at + 10 + 12 * k if count <= 4 else value
                tags.setdefault(tag, content[start : start + count].split(b"\0")[0].decode("utf-8", "replace").strip() or None)
            elif tag == EXIF_IFD:
                tags[tag] = value

    directory(struct.unpack_from(f"{order}I", content, 4)[0])
    if isinstance(tags.get(EXIF_IFD), int):
        directory(tags[EXIF_IFD])
    return {"taken": tags.get(TAKEN) or tags.get(CHANGED), "make": tags.get(MAKE), "model": tags.get(MODEL)}


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|\b(?:Tj|TJ|Td|TD|ET)\b|T\*", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|.)", re.DOTALL)


def _pdf_string(raw: bytes) -> str:
    plain = _ESCAPED.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), raw[1:-1])
    return plain[2:].decode("utf-16-be", "replace") if plain[:2] == b"\xfe\xff" else plain.decode("cp1252", "replace")


def pdf(content: bytes) -> dict:
    """Literal strings that simple pages show, page count, title and author.

    Plain and deflated content streams are read; fonts with encodings of their
    own, object streams and encryption are not.
    """
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    texts = []
    for head, body in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        line = ""
        for token in _SHOWN.findall(body):
            if token[:1] == b"(":
                line += _pdf_string(token)
            elif token not in (b"Tj", b"TJ"):
                texts.append(line)
                line = ""
        texts.append(line)
    said = lambda key: (m := re.search(rb"/" + key + rb"\s*(\((?:\\.|[^\\()])*\))", content, re.DOTALL)) and _pdf_string(m[1]).strip() or None
    return {"body_text": "\n".join(t for t in texts if t), "page_count": len(re.findall(rb"/Type\s*/Page\b", content)), "title": said(b"Title"), "author": said(b"Author")}


#: Seconds after which a document is given up (fixed value).
DEADLINE = 30.0


@contextlib.contextmanager
def deadline(seconds: float):
    """Raise TimeoutError in the worker's main thread if the body takes longer."""

    def late(*_):
        raise TimeoutError(f"took longer than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract_one(doc_type: str, content: bytes, seconds: float = DEADLINE) -> dict:
    """Facts of one document; what fails to parse, or takes too long, gives its error instead."""
    try:
        with deadline(seconds):
            return _facts(doc_type, content)
    except Exception as e:  # noqa: BLE001  one bad file must not end the task
        return {"error": f"{type(e).__name__}: {e}"}


def _facts(doc_type: str, content: bytes) -> dict:
    if doc_type in ("jpeg", "tiff"):
        return exif(content)
    if doc_type == "pdf":
        return pdf(content)
    readers = {"docx": docx, "xlsx": xlsx, "pptx": pptx}
    if doc_type not in readers:
        return {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return readers[doc_type](archive) | _properties(archive)


def extract_named(files: DataFrame) -> DataFrame:
    """Facts of each row of ``files`` (id, name, content), its type told by its first bytes, then by its name."""
    head = F.substring("content", 1, SNIFF_BYTES)
    return extract(files.select("id", sniffed(head, F.col("name")).alias("doc_type"), "content"))


def extract(files: DataFrame) -> DataFrame:
    """Facts of each row of ``files`` (id, doc_type, content)."""

    def facts(id_: int, doc_type: str, content: bytes) -> tuple:
        found = {"id": id_, "doc_type": doc_type} | extract_one(doc_type, content)
        return tuple(found.get(f) for f in _FIELDS)

    return files.select(F.col("id").cast("long").alias("id"), "doc_type", "content").mapInArrow(row_by_row(facts, _ARROW), SCHEMA)
