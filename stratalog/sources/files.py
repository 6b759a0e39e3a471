"""Reading a folder of documents: walk, identity, parsing to addressable blocks.

The walk is Spark's ``binaryFile`` source, or a listing where no file is opened; parsing runs in ``mapInArrow``, one file at a time.  Formats: Markdown and plain text, delimited tables, DOCX and XLSX (both are zipped XML), PDF.
"""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.phrases import is_noise, is_secret
from stratalog.sources import pdf

KINDS = {"md": "markdown", "markdown": "markdown", "txt": "text", "json": "text", "csv": "table", "tsv": "table", "docx": "document", "xlsx": "sheet", "pdf": "pages"}
BLOCKS = "path string, id string, error string, ordinal long, locator string, kind string, text string, start_byte long, end_byte long, sheet string, row long, cells array<string>"


def walk(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """path, name, extension, bytes, modified, reason (why a file is not read, else null) and content.

    Without ``with_content`` the files themselves are not opened, and the folders below are listed by tasks.  Spark's readers
    leave out files of no bytes and those whose names begin with a dot or an underscore, and so does the listing.
    """
    from stratalog.sources import folder

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root) if with_content or not folder.known(root) else folder.listing(spark, root)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(is_secret(name), "secret").when(is_noise(name), "noise").when(F.col("length") == 0, "empty").when(~ext.isin(*KINDS), "unsupported")
    cols = [F.col("path"), name.alias("name"), ext.alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), reason.alias("reason")]
    return files.select(*cols, *([F.col("content")] if with_content else []))


def settled(files: DataFrame, now, seconds: int = 3) -> DataFrame:
    """Files that nobody is still writing: last changed at least so long ago, and not in the future."""
    return files.where(F.col("modified") <= F.lit(now) - F.make_dt_interval(secs=F.lit(seconds)))


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes by extension, from the listing alone."""
    return files.groupBy("extension").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("newest"))


def decode(raw: bytes) -> str:
    """UTF-8, else the Windows code page of central Europe."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1250", errors="replace")


class Rendition:
    """The text that blocks point into: pieces joined by blank lines, with the byte span of each."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.blocks: list[dict] = []
        self.at = 0

    def push(self, text: str, locator: str, kind: str, **more) -> None:
        text = text.strip()
        if text:
            self.at += 2 if self.pieces else 0
            size = len(text.encode())
            self.blocks.append({"ordinal": len(self.blocks), "locator": locator, "kind": kind, "text": text, "start_byte": self.at, "end_byte": self.at + size, **more})
            self.pieces.append(text)
            self.at += size

    def text(self) -> str:
        return "\n\n".join(self.pieces)


class Sections:
    """Numbers like 2.1 for headings, and of the paragraphs under them."""

    def __init__(self) -> None:
        self.counts: list[int] = []
        self.paragraphs = 0

    def heading(self, level: int) -> str:
        self.counts = (self.counts + [0] * level)[:level]
        self.counts[-1] += 1
        self.paragraphs = 0
        return "§" + ".".join(str(max(1, c)) for c in self.counts)

    def paragraph(self) -> str:
        self.paragraphs += 1
        head = "§" + ".".join(str(max(1, c)) for c in self.counts) + " " if self.counts else ""
        return f"{head}¶{self.paragraphs}"


def parse_prose(text: str) -> Rendition:
    """Headings, list items and paragraphs of Markdown or plain text."""
    out, sections, open_lines = Rendition(), Sections(), []

    def close() -> None:
        if open_lines:
            out.push(" ".join(open_lines), sections.paragraph(), "paragraph")
            open_lines.clear()

    for line in text.split("\n"):
        if m := re.match(r"(#{1,6})\s+(.*\S)", line):
            close()
            out.push(m[2], sections.heading(len(m[1])), "heading")
        elif m := re.match(r"\s*(?:[-*+•]|[0-9]{1,3}[.)])\s+(.*\S)", line):
            close()
            out.push(m[1], sections.paragraph(), "item")
        elif line.strip():
            open_lines.append(line.strip())
        else:
            close()
    close()
    return out


def sniff(first_line: str, name: str = "") -> str:
    """The delimiter that the first line has most of; the later of ``,`` tab ``;`` wins a tie."""
    if name.lower().endswith(".tsv"):
        return "\t"
    counts = [(first_line.count(d), i, d) for i, d in enumerate((",", "\t", ";"))]
    best = max(counts)
    return best[2] if best[0] else ","


def split_row(line: str, delimiter: str) -> list[str]:
    """Cells of one line; quotes only count where they open a cell and a matching one closes it."""
    cells, at = [], 0
    while True:
        if line[at : at + 1] == '"' and (m := re.compile(r'"((?:[^"]|"")*)"(?=' + re.escape(delimiter) + r"|$)").match(line, at)):
            cells.append(m[1].replace('""', '"').strip())
            at = m.end()
        else:
            end = line.find(delimiter, at)
            end = len(line) if end < 0 else end
            cells.append(line[at:end].strip())
            at = end
        if at >= len(line):
            return cells
        at += 1
        if at == len(line):
            return [*cells, ""]


def push_rows(out: Rendition, rows: Iterator[tuple[int, list[str]]], sheet: str | None = None) -> None:
    """Rows after the header as blocks; blank ones count but give no block."""
    head = True
    for number, cells in rows:
        if not any(cells):
            continue
        if head:
            head = False
            continue
        out.push(" | ".join(cells), f"{sheet} row {number}" if sheet else f"row {number}", "row", sheet=sheet, row=number, cells=cells)


def parse_table(text: str, name: str) -> Rendition:
    lines = text.replace("\r\n", "\n").split("\n")
    delimiter = sniff(next((x for x in lines if x.strip()), ""), name)
    out = Rendition()
    push_rows(out, ((i, split_row(x, delimiter)) for i, x in enumerate(lines, 1)))
    return out


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def parse_docx(raw: bytes) -> Rendition:
    """Paragraphs of word/document.xml; a style that names a heading level opens a section."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    out, sections = Rendition(), Sections()
    for p in root.iter(f"{W}p"):
        parts = {f"{W}t": lambda e: e.text or "", f"{W}tab": lambda e: "\t", f"{W}br": lambda e: "\n"}
        text = "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)
        style = next((s.get(f"{W}val", "") for s in p.iter(f"{W}pStyle")), "")
        if not text.strip():
            continue
        if m := re.match(r"(?:heading|naslov)\s*([1-9])", style, re.I):
            out.push(text, sections.heading(int(m[1])), "heading")
        else:
            out.push(text, sections.paragraph(), "item" if next(p.iter(f"{W}numPr"), None) is not None else "paragraph")
    return out


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def parse_xlsx(raw: bytes) -> Rendition:
    """Rows of every sheet; the first row that isn't blank is the header; whole numbers print without a fraction."""
    out = Rendition()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{R}id")]) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")]
        for name, target in sheets:
            root = ET.fromstring(z.read("xl/" + target.removeprefix("/xl/")))
            push_rows(out, _sheet_rows(root, shared), name if len(sheets) > 1 else None)
    return out


def _sheet_rows(root: ET.Element, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
    for k, row in enumerate(root.iter(f"{S}row"), 1):
        cells: list[str] = []
        for c in row.iter(f"{S}c"):
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            value = next((v.text or "" for v in c.iter(f"{S}v")), "".join(t.text or "" for t in c.iter(f"{S}t")))
            if c.get("t") == "s" and value:
                value = shared[int(value)]
            elif c.get("t") == "b":
                value = "true" if value == "1" else "false"
            elif c.get("t") is None and re.fullmatch(r"-?[0-9]+\.0+", value):
                value = value.split(".")[0]
            cells[at] = value.strip()
        yield int(row.get("r", k)), cells


def parse_pdf(raw: bytes) -> Rendition:
    """Paragraphs by page; a scan without text has none."""
    out = Rendition()
    for page, k, text in pdf.paragraphs(raw):
        out.push(text, f"page {page}, ¶{k}", "paragraph")
    return out


PARSERS = {"document": parse_docx, "sheet": parse_xlsx, "pages": parse_pdf}


def parse(name: str, raw: bytes) -> Rendition:
    ext = name.rpartition(".")[2].lower()
    kind = KINDS.get(ext)
    if not raw:
        raise ValueError("empty")
    if kind is None:
        raise ValueError("unsupported")
    out = PARSERS[kind](raw) if kind in PARSERS else parse_table(decode(raw), name) if kind == "table" else parse_prose(decode(raw))
    if not out.blocks:
        raise ValueError("no_text")
    return out


def extract(files: DataFrame) -> DataFrame:
    """Blocks of every readable file (path, name, content); a file that can't be read gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(c, kinds[t]) for c, t in (x.split() for x in BLOCKS.split(", "))])
        for batch in batches:
            for path, name, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "content")), strict=True):
                one = {"path": path, "id": "doc:" + hashlib.sha256(raw).hexdigest()[:16]}
                try:
                    rows = [one | b for b in parse(name, raw).blocks]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ET.ParseError, zlib.error) as e:
                    rows = [one | {"error": str(e)}]
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return files.where("reason is null").select("path", "name", "content").mapInArrow(run, BLOCKS)
