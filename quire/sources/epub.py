"""Zip-packaged books as rows: read archives into segments, write translated archives back.

One archive is one row of the ``binaryFile`` source; it is opened inside the task that reads it, within
the guards below, and never travels. Archives that break a guard or don't parse give one row with
``error`` set and nothing else.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.dom import minidom

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Guards of an archive, and the elements that are segments.
MAX_ENTRIES, MAX_BYTES, MAX_ENTRY_BYTES = 1000, 100_000_000, 25_000_000
BLOCKS = "h1 h2 h3 h4 h5 h6 p li pre figcaption".split()
VERSE = ("poem", "poetry", "verse", "stanza")
VOID = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"
SPLIT_AT = 1800
LETTER, URL = re.compile(r"[A-Za-z]"), re.compile(r"(?i)(https?://|www\.).+")

ROWS = "path string, title string, chapter_order int, doc_path string, element int, part int, parts int, source_text string, segment_type string, error string"
FRAME = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in ROWS.split(", ")])
ARCHIVES = pa.schema([("path", pa.string()), ("content", pa.binary())])
#: Rows and MB of a batch that a task returns: one batch holds the rows of many small books, or of a part of a large one.
BATCH, BATCH_MB = 4096, 4


class Rejected(ValueError):
    pass


def entries(content: bytes, *, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, max_entry_bytes: int = MAX_ENTRY_BYTES) -> dict[str, bytes]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Rejected("not an archive") from e
    files = [i for i in archive.infolist() if not i.is_dir()]
    if len(files) > max_entries:
        raise Rejected("too many entries")
    out, total = {}, 0
    for i in files:
        name = i.filename.replace("\\", "/")
        if name.startswith("/") or ".." in name.split("/"):
            raise Rejected("unsafe entry name")
        with archive.open(i) as f:
            data = f.read(max_entry_bytes + 1)
        total += len(data)
        if len(data) > max_entry_bytes:
            raise Rejected("entry too large")
        if total > max_bytes:
            raise Rejected("archive too large")
        out[name] = data
    return out


def parse(data: bytes, path: str) -> minidom.Document:
    """A document type is not allowed; HTML is repaired once."""
    text = data.decode("utf-8", "replace")
    try:
        if "<!DOCTYPE" in text[:1000].upper():
            raise ValueError
        return minidom.parseString(text.encode())
    except Exception as e:
        if not path.lower().endswith((".html", ".htm", ".xhtml")):
            raise Rejected(f"{path}: not well-formed") from e
    text = re.sub(r"<!DOCTYPE[^>]*>", "", text.lstrip("﻿"), flags=re.I).replace("&nbsp;", "&#160;")
    text = re.sub(rf"<({VOID})\b([^>]*?)/?>", r"<\1\2/>", text, flags=re.I)
    try:
        return minidom.parseString(text.encode())
    except Exception as e:
        raise Rejected(f"{path}: not well-formed") from e


def _local(e) -> str:
    return (e.localName or e.tagName).split(":")[-1].lower()


def _all(node, name: str) -> list:
    return [e for e in node.getElementsByTagName("*") if _local(e) == name]


def spine(files: dict[str, bytes]) -> tuple[str, list[str]]:
    """Title and paths of the book's documents in reading order; unknown references are dropped."""
    if "META-INF/container.xml" not in files:
        raise Rejected("no container")
    roots = _all(parse(files["META-INF/container.xml"], "container.xml"), "rootfile")
    opf = roots[0].getAttribute("full-path") if roots else ""
    if opf not in files:
        raise Rejected("no package")
    package = parse(files[opf], opf)
    items = {e.getAttribute("id"): e.getAttribute("href") for e in _all(package, "item") if e.getAttribute("media-type") in ("application/xhtml+xml", "text/html")}
    titles = _all(package, "title")
    paths = [items[e.getAttribute("idref")] for e in _all(package, "itemref") if e.getAttribute("idref") in items]
    return (_text(titles[0]) if titles else ""), [posixpath.normpath(posixpath.join(posixpath.dirname(opf), p)) for p in paths]


def _text(node) -> str:
    def walk(n) -> Iterator[str]:
        if n.nodeType in (n.TEXT_NODE, n.CDATA_SECTION_NODE):
            yield n.data
        for c in n.childNodes:
            yield from walk(c)

    return re.sub(r"\s+", " ", "".join(walk(node)), flags=re.A).strip("".join(map(chr, range(33))))


def kind(e) -> str:
    name, classes = _local(e), e.getAttribute("class").lower().split()
    has = lambda *words: any(c == w or f"-{w}" in c or f"{w}-" in c for c in classes for w in words)
    up, inside = e.parentNode, False
    while up is not None and up.nodeType == up.ELEMENT_NODE:
        inside = inside or _local(up) == "blockquote"
        up = up.parentNode
    if name[0] == "h" and name[1:].isdigit():
        return "TITLE"
    if name == "li":
        return "LIST_ITEM"
    if name == "pre" or has(*VERSE):
        return "POETRY"
    if inside or has("quote", "blockquote"):
        return "QUOTE"
    return {"figcaption": "IMAGE_CAPTION", "p": "PARAGRAPH"}.get(name, "OTHER")


def non_translatable(text: str) -> bool:
    import unicodedata

    bare = re.sub(r"\s+", "", text)
    if len(bare) > 3 and LETTER.search(bare):  # most texts
        return bool(URL.match(bare))
    kinds = {unicodedata.category(c)[0] for c in bare}
    marks = kinds <= {"P", "S"}
    return not bare or bool(URL.match(bare)) or marks or kinds == {"N"} or (len(bare) <= 3 and kinds <= {"P", "S", "N"})


def split_long(text: str, limit: int = SPLIT_AT) -> list[str]:
    """Parts that give the text again when joined by a space: at sentences, else punctuation, else words."""
    if len(text) <= limit:
        return [text]
    for pattern in (r"(?<=[.!?。！？]) ", r"(?<=[,;:，；：]) ", r" "):
        pieces = re.split(pattern, text)
        if max(map(len, pieces)) <= limit:
            out = [pieces[0]]
            for p in pieces[1:]:
                if len(out[-1]) + 1 + len(p) <= limit:
                    out[-1] += " " + p
                else:
                    out.append(p)
            return out
    return [text]


def book_rows(path: str, content: bytes) -> list[tuple]:
    try:
        files = entries(content)
        title, paths = spine(files)
        out, chapter = [], 0
        for doc in paths:
            if doc not in files:
                continue
            rows = []
            with parse(files[doc], doc) as tree:  # its nodes go at the end: they refer to one another
                for i, e in enumerate(tree.getElementsByTagName("*")):
                    if _local(e) in BLOCKS and not non_translatable(text := _text(e)):
                        parts = split_long(text)
                        rows += [(path, title, chapter + 1, doc, i, k, len(parts), p, kind(e), None) for k, p in enumerate(parts)]
            if rows:
                chapter += 1
                out += rows
        return out
    except Rejected as e:
        return [(path, None, None, None, None, None, None, None, None, str(e))]


def gathered(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, each with its size, in batches of bounded size."""
    held, size = [], 0
    for r, n in rows:
        held.append(r)
        size += n
        if len(held) >= BATCH or size >= BATCH_MB << 20:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")


def read_books(books: DataFrame) -> DataFrame:
    """Segments of (path, content) rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                for r in book_rows(path.as_py(), content.as_py()):
                    yield r, len(r[7] or "")

    return books.select("path", "content").mapInArrow(lambda batches: gathered(rows(batches), FRAME), ROWS)


def rewrite(content: bytes, replaced: dict[str, dict[int, str]], bilingual: bool) -> bytes:
    """The archive with the text of located elements replaced, or followed by a translated copy."""
    files, out = entries(content), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            if name in replaced:
                with parse(data, name) as doc:
                    elements = list(doc.getElementsByTagName("*"))
                    for i, text in replaced[name].items():
                        old = elements[i]
                        new = old.cloneNode(False)
                        new.appendChild(doc.createTextNode(text))
                        old.parentNode.insertBefore(new, old.nextSibling) if bilingual else old.parentNode.replaceChild(new, old)
                    data = doc.toxml().encode()
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def export_books(books: DataFrame, segments: DataFrame, *, bilingual: bool = False) -> DataFrame:
    """(path, content, size, checksum) of every book whose segments all have a translated_text. Only the
    translations are grouped; an archive meets its own in one join."""
    done = segments.groupBy("path").agg(F.bool_and(F.trim(F.coalesce("translated_text", F.lit(""))) != "").alias("whole"), F.collect_list(F.struct("doc_path", "element", "part", "translated_text")).alias("parts"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for b in batches:
            for path, content, parts in zip(b.column("path"), b.column("content"), b.column("parts"), strict=True):
                by: dict[str, dict[int, str]] = {}
                fields = [parts.values.field(c).to_pylist() for c in ("doc_path", "element", "part", "translated_text")]
                for doc_path, element, _, text in sorted(zip(*fields, strict=True), key=lambda p: p[:3]):
                    doc = by.setdefault(doc_path, {})
                    doc[element] = f"{doc[element]} {text}" if element in doc else text
                new = rewrite(content.as_py(), by, bilingual)
                yield (path.as_py(), new), len(new)

    out = books.join(done.where("whole"), "path").select("path", "content", "parts").mapInArrow(lambda batches: gathered(written(batches), ARCHIVES), "path string, content binary")
    return out.select("path", "content", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("checksum"))
